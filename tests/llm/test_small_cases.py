"""Each operator against brute force, exact round trips, and its cases of nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from planloom.llm import base, chat, exact_dedup, mixing, ngram_join, packing, personal_data, pieces, quality, suffix_dedup, top_k

SPACE = re.compile("[\x20\x09-\x0d]")


def docs_of(spark, rows, schema="doc_id long, text string, source string"):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS row", "'x' AS key", "2 AS size", "3 AS n").repartition(3)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- exact dedup


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_exact_dedup_cases(spark, monkeypatch, broadcast):
    for module in (exact_dedup, base):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(base, "HOT_ROWS", 2 if not broadcast else 10_000)
    least = -(2**63)
    rows = [(least, "q r", "s"), (least + 1, "qr ", "s"), (5, "a b", "s"), (3, "ab", "s"), (4, "a b", "s"), (9, "a\tb", "s"), (9, "a\tb", "s"), (1, None, "s"), (2, "", None), (7, " \n", "s"), (None, "zz", "s"), (8, "é ", "s")]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows), capacity=1).collect()
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    assert len(got) == len(rows)
    want = Counter((d, min(m)[2], len(m), sha(n)) for n, m in groups.items() for _, _, d in m)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.deduplicated(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, SPACE.sub("", r.text or "")) for r in stay) == Counter((min(m)[2], n) for n, m in groups.items())
    assert "source" in stay[0].asDict()
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).collect() == []


def test_directory_doubling(spark):
    """Overfull buckets are split, others keep their depth; slots of one bucket name the same first slot."""
    keys = [k << 61 for k in range(4)] * 1 + [(1 << 61) + k for k in range(1, 9)]
    slots, depth = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity=3)
    got = {r.slot: (r.bucket, r.depth) for r in slots.collect()}
    buckets = {}
    for k in keys:
        slot = k >> (64 - depth)
        bucket, own = got[slot]
        assert bucket >> (depth - own) << (depth - own) == bucket and slot >> (depth - own) == bucket >> (depth - own)
        buckets.setdefault((bucket, own), set()).add(k)
    assert max(map(len, buckets.values())) <= 3 and depth > 60
    for (bucket, own), held in buckets.items():  # the bucket that this one was split from was over its capacity
        parent = depth - own + 1
        assert own == 0 or sum(k >> (64 - depth) >> parent == bucket >> parent for k in keys) > 3


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    """With a key that all texts share, one bucket has one chain of all texts."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = [(1, "a", "s"), (2, "b", "s"), (3, "a ", "s"), (4, "c", "s")]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows), capacity=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)}


# ---- mixing


def test_mixing_cases(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randrange(30)), rng.choice(["a", "b", "é", None])) for k in range(400)]
    rows += [(500, None, "a"), (501, "", "empty"), (502, "x y", "a"), (502, "x y", "a")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and got and Counter(r.doc_id for r in got)[502] == 2
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(t for _, t in by_target) - total) < 1e-6
    for (size, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 30 and target <= 3 * size + 1e-9
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert Counter(got) == Counter(again)
    times = Counter(r.doc_id for r in mixing.mixed(docs_of(spark, rows)).collect())
    assert all(times[r.doc_id] * r.size == r.taken for r in got if r.size and r.doc_id != 502)
    assert max(times[r.doc_id] for r in got if r.doc_id != 502) <= mixing.MOST
    assert mixing.mix(docs_of(spark, [])).collect() == []


def test_mixing_of_a_capped_source_and_of_null_ids(spark):
    """Documents without words of a source at its cap enter no fourth time; rows without ids enter one by one."""
    rows = [(k, None if k % 3 else "one two", "a") for k in range(30)] + [(None, f"w{k} w", "b") for k in range(2000)]
    times = Counter(r.doc_id for r in mixing.mixed(docs_of(spark, rows)).collect())
    assert all(times[k] <= mixing.MOST for k in range(30)) and times[0] == mixing.MOST
    got = {(r.source_size, r.target): 0 for r in mixing.mix(docs_of(spark, rows)).collect()}
    for r in mixing.mix(docs_of(spark, rows)).collect():
        got[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= 2 for (_, target), taken in got.items())


# ---- chat


def test_chat_cases(spark):
    rows = [
        (1, 0, "user", "a <b> \\l"), (1, 1, "assistant", "</turn>\n<turn assistant>x"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, None, "rest\\"),
        (2, 0, "user", "only"), (None, None, "assistant", "q"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS parts", "3 AS example_no")
    examples = chat.prefix_target_examples(df)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    by_conv = Counter(r.conv_id for r in examples.collect())
    assert by_conv == {1: 3, 2: 1, None: 1, 3: 2}
    assert chat.digests(chat.prefix_target_examples(df.limit(0))).collect() == []


# ---- personal data


def brute_spans(text):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_personal_data_cases(spark):
    rng = random.Random(2)
    alphabet = ["1", "4", "7", "0", ".", "-", " ", "@", "+", "a", "b.c", "é", "(", ")", "255", "_", "4111 1111 1111 1111", "\n", "+49 30 1234567", "x@y.de"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += [None, "", "a" * 30_000, "1" * 30_000, "+" + "1 " * 9000, "1.1.1.1.1.1.1.1 256.1.1.1 001.2.3.4", "a@b.cd_x@y.z", "a@b.c.d@e.f", "IBAN DE89370400440532013000 and ssn: 123-45-6789, 123-45-6789" + " " * 50 + "123-45-6789"]
    got = {r.doc_id: r for r in personal_data.personal_data(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        base = [f"{n}:{s.start}:{s.end}" for n in ("email", "ip", "card", "phone") for s in got[k][n]]
        assert base == brute_spans(text or ""), text
    assert len(got[len(texts) - 1].iban) == 1 and len(got[len(texts) - 1].ssn) == 2


def test_personal_data_scores(spark):
    texts = ["hotel 1.2.3.4 ship", "host: 1.2.3.4", "1.2.3.4 (server), example", "DE89 3704 0044 0532 0130 00", "test DE89370400440532013000", "DE89370400440532013001", "123-45-6789", "123-45-6789 is my SSN", "sample SSN 123-45-6789"]
    got = {r.doc_id: r for r in personal_data.personal_data(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert [s.score for k in range(3) for s in got[k].ip] == [0.4, 0.7, 0.4]
    assert [(s.start, s.end, s.score) for k in (3, 4, 5) for s in got[k].iban] == [(0, 27, 0.8)]
    assert [s.score for k in (6, 7, 8) for s in got[k].ssn] == [0.7]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4097, 20_000])
def test_personal_data_of_many_matches(spark, n):
    text = "".join(f"é{k % 7 * 'x'} u{k}@ab.de," for k in range(n))
    began = time.perf_counter()
    row = personal_data.personal_data(docs_of(spark, [(1, text, "s")])).first()
    assert time.perf_counter() - began < 20
    assert [(s.start, s.end) for s in row.email] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


# ---- quality


def test_quality_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    rows = quality.query(spark, at).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_weights_do_not_run_off():
    """Texts that lie far out: whole Newton steps swing here between no text and every text from 0.7, and never settle."""
    for seed in (17, 18, 23, 64):
        rng = np.random.default_rng(seed)
        good = np.arange(240) % 7 > 0
        base = np.where(good, 1.0, -1.0) * rng.lognormal(0, 0.7, 240) + rng.standard_t(2, 240) * 0.3
        x = np.stack([base, base - rng.lognormal(-1, 1, 240), base + rng.normal(0, 0.1, 240)], axis=1)
        mean, scale = x.mean(0), x.std(0)
        a = quality.design(x, mean, scale)
        weights = quality.calibrated(a, good.astype(float))
        p = quality.probability(x, quality.Model(b"", b"", tuple(mean), tuple(scale), tuple(weights)))
        assert np.abs(a.T @ (good - p) - quality.RIDGE * weights).max() < 1e-2  # the least loss has no slope
        assert 0.75 < (p >= quality.ACCEPTED_FROM).mean() < 0.9 and ((p >= 0.5) == good).mean() > 0.9


def test_quality_without_labels_and_odd_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = docs_of(spark, [(1, None, "s"), (2, "", "s"), (3, "x" * 300_000, None)])
    assert [r.s for r in docs.select(quality.score(F.col("text"), quality.fit(docs, none)).alias("s")).collect()] == [0.5] * 3
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    many = docs_of(spark, [(k, "good prose here " * 9 if k % 2 else "#### $$ @@ " * 9, "s") for k in range(40)] + [(77, None, "s"), (78, "", "s")])
    model = quality.fit(many, labels)
    assert all(0 <= r.s <= 1 for r in many.select(quality.score(F.col("text"), model).alias("s")).collect())


# ---- top-k


@pytest.mark.parametrize("block, floor", [(8192, 512), (7, 20)])
def test_top_k_cases(spark, monkeypatch, block, floor):
    for name in ("CANDIDATES_A_BLOCK", "QUERIES_A_BLOCK"):
        monkeypatch.setattr(top_k, name, block)
    monkeypatch.setattr(top_k, "FLOOR_ROWS", floor)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).round(1).tolist()) for k in range(300)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (200, rows[200][1]), (7, None), (400, [1.0, None] + [0.0] * 6), (401, [float("nan")] * 8), (402, [float("inf")] * 8), (None, [0.0] * 8), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS dim", "3 AS block")
    good = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all()]
    want = set()
    for query_id in {i for i, _ in good if i % 100 == 0}:
        q = min((v.tolist() for i, v in good if i == query_id))
        best = sorted((-int(v @ q), i) for i, v in good if i != query_id)[:10]
        want |= {(query_id, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df).collect()}
    assert got == want
    assert top_k.top_k(df.limit(0)).collect() == []


def test_top_k_eliminates_where_vectors_cluster(spark):
    """Exact lists, and under a tenth of all candidates evaluated, on vectors around 40 centres."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 0.02
    x /= np.sqrt((x**2).sum(1))[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    ints = np.floor(1024 * x).astype(np.int64)
    want = set()
    for q in range(0, 6000, 100):
        scores = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df).collect()} == want
    share = sum(r.evaluated for r in top_k.evaluated(df).collect()) / (60 * 5999)
    assert share < 0.1, share


# ---- SentencePiece and packing

ODD = ["", " ", "  a  b ", "\n\n x", "é①\U0001f600 ok\t", "x" * 5000, "<s> </s>", "Don't stop.Now\nIt's <0x0A>", " " * 70 + "b"]


def unigram_model():
    """The model file with its type set to unigram: field 3 of the trainer's settings, which are field 2."""
    data = open(pieces.MODEL_FILE, "rb").read()
    at = data.rfind(b"\x18\x02", 0, len(data))
    for at in (m.start() for m in re.finditer(rb"\x18\x02", data)):
        changed = data[:at] + b"\x18\x01" + data[at + 2 :]
        try:
            sp = sentencepiece.SentencePieceProcessor(model_proto=changed)
        except RuntimeError:
            continue
        if sp.encode("unbelievable") != sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE).encode("unbelievable"):
            return changed
    return None


def test_ids_are_the_library_s(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(-1, None, "s")])
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE).encode(texts)
    encoded = pieces.encode(docs)
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(list(got[k].ids) == ids and got[k].round_trip for k, ids in enumerate(want))
    assert list(got[-1].ids) == []
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {**dict(enumerate(texts)), -1: ""}


def test_unigram_scores_are_the_best():
    data = unigram_model()
    if data is None:
        pytest.skip("the model's type could not be changed")
    model, sp = pieces.Encoder(kind="unigram", model_bytes=data), sentencepiece.SentencePieceProcessor(model_proto=data)
    words = sorted(set("the quick brown foxes jumped over unbelievable lazinesses in internationalization".split()))
    for ids, score, text in zip(*model.encode_texts(words), words, strict=True):
        total = lambda x: sum(sp.get_score(i) for i in x)
        assert "".join(map(sp.id_to_piece, ids)) == "▁" + text and score == pytest.approx(total(ids)) and total(ids) >= total(sp.encode(text))


def test_scores_against_an_exhaustive_search():
    model, rng = pieces.Encoder(kind="unigram"), random.Random(8)
    words = ["".join(rng.choice("aein rst①") for _ in range(rng.randrange(1, 10))) for _ in range(200)]

    def best(marked):
        """Over all cuts into pieces, and characters without a piece."""
        if not marked:
            return 0.0
        heads = (marked[:n] for n in range(1, len(marked) + 1))
        return max((model.score[model.ids[h]] if h in model.ids else model.least) + best(marked[len(h) :]) for h in heads if h in model.ids or len(h) == 1)

    ids, scores = model.encode_texts(words)
    for word, pieces_, score in zip(words, ids, scores, strict=True):
        assert score == pytest.approx(best("▁" + word.replace(" ", "▁"))) and model.decode(pieces_) == word


def test_bounds_of_what_a_worker_remembers(monkeypatch):
    """Ids stay the library's while words and pairs are forgotten; long words aren't remembered."""
    monkeypatch.setattr(pieces, "CACHED_CHARS", 500)
    monkeypatch.setattr(pieces, "BESIDE_PAIRS", 20)
    model, library = pieces.Encoder(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeeiou ") for _ in range(400)) for _ in range(30)] + ["z" * 100_000, "ab" * 3000]
    for text in texts * 2:
        assert model.encode_texts([text])[0] == [library.encode(text)]
        held = [*model.known, *model.before]
        assert model.cached <= 250 and all(len(w) <= pieces.LONGEST_CACHED for w in held)
        assert sum(map(len, model.beside)) <= 20


def test_packing_is_lossless_and_best_fit(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(-1, None, "s")])
    rows = packing.pack(docs, length=256).collect()
    encoding = packing.encoding(packing.RANKS_FILE)
    got = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 256 and (ids[r.n_tokens :] == packing.PAD_ID).all() and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got.setdefault(s.doc_id, []).append((s.piece, ids[a:b].tolist()))
    whole = {k: sum((x for _, x in sorted(v)), []) for k, v in got.items()}
    assert all(v[-1] == packing.END_ID for v in whole.values())
    assert {k: encoding.decode(v[:-1]) for k, v in whole.items()} == dict(enumerate(texts)) | {-1: ""}


def test_ids_around_long_runs_of_white_space():
    model, rng = packing.encoding(packing.RANKS_FILE), random.Random(10)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "1", "'s", "?", " ", "é", "\u3000", "\x1c"]) + rng.choice(" \n\t\u2003") * rng.choice([0, 1, 2, 1023, 1024, 1025, 3000]) for _ in range(6))
        assert packing.token_ids(text, model) == model.encode_ordinary(text)


def test_packing_of_very_long_runs(spark):
    texts = ["x" + " " * 1_000_000, "\n" * 1_000_000 + "y", "z" * 1_000_000]
    rows = packing.pack(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    got, model = {}, packing.encoding(packing.RANKS_FILE)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got.setdefault(s.doc_id, {})[s.piece] = ids[a:b].tolist()
    assert {k: model.decode(sum((v[p] for p in sorted(v)), [])[:-1]) for k, v in got.items()} == dict(enumerate(texts))


def test_best_fit_against_a_plain_scan():
    rng = random.Random(4)
    for _ in range(50):
        length = rng.randrange(1, 40)
        lengths = [rng.randrange(1, length + 1) for _ in range(rng.randrange(60))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(length - n)
            else:
                rooms[rooms.index(fit)] -= n
        packed = packing.best_fit(lengths, length)
        assert sorted(length - sum(lengths[p] for p in row) for row in packed) == sorted(rooms)
        assert sorted(p for row in packed for p in row) == list(range(len(lengths)))


# ---- suffix dedup


def brute_removed(texts):
    n = suffix_dedup.LENGTH
    where = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if where[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("task, shard, broadcast", [(60_000, 32_768, 1_000_000), (120, 900, 0), (20, 100_000, 0)])
def test_suffix_dedup_cases(spark, monkeypatch, task, shard, broadcast):
    monkeypatch.setattr(suffix_dedup, "TASK_WINDOWS", task)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ANCHORS", broadcast)
    monkeypatch.setattr(base, "HOT_ROWS", 2 if not broadcast else 10_000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long_ = prose(60), prose(300)
    texts = [prose(150) + shared + prose(50), shared[7:] + prose(90), prose(80) + shared[:-20], long_, long_, long_[300:900] + prose(40)]
    texts += ["a" * 450, "ab" * 300, None, "", "x" * 199, "x" * 200, "y" * 201, prose(30) + long_[:210], prose(20) + long_[:150]]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(3, long_, "s"), (None, prose(5) + shared, "s")]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("h")).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute_removed([(t or "").encode() for _, t, _ in rows]), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [0, 2])
def test_suffix_dedup_of_a_hot_phrase(spark, monkeypatch, copies):
    """A phrase too short for a window, and one just long enough, in hundreds of surroundings: an anchor over the bound."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    monkeypatch.setattr(suffix_dedup, "TASK_WINDOWS", 3000)
    phrase = noise(190 + 15 * copies)
    texts = [noise(120) + phrase + noise(120) for _ in range(300)]
    texts += [noise(50) + texts[k][110:330] + noise(50) for k in range(copies)]
    owners = suffix_dedup.slices([t.encode() for t in texts])
    assert max(Counter(owners[1].tolist()).values()) > 200
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("h")).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute_removed([t.encode() for t in texts]), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.n_removed for r in got) >= 400 * copies


def test_suffix_dedup_of_many_equal_rows(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdef ") for _ in range(2500))
    rows = [(1, text, "s")] * 4000 + [(2, text[:700] + "!" * 9, "s")]
    got = Counter(map(tuple, suffix_dedup.remove_repeats(docs_of(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()))
    assert got == Counter({(1, 2500, 2500, 1): 4000, (2, 709, 700, 1): 1})


@pytest.mark.parametrize("shard", [300, 3000, 10**6])
def test_merged_transforms_against_brute_force(monkeypatch, shard):
    """Few letters and long repeats, within a shard and across: intervals of the interleave against counted windows."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(shard)
    for _ in range(40):
        stock = ["".join(rng.choice("ab") for _ in range(rng.choice([20, 230, 400]))) for _ in range(4)] + ["a" * 300]
        parts = ["".join(rng.choice(stock)[rng.randrange(15) :] for _ in range(rng.randrange(1, 4))).encode() for _ in range(12)]
        where = Counter(p[i : i + 200] for p in parts for i in range(len(p) - 199))
        for part, found in zip(parts, suffix_dedup.repeated_starts(parts), strict=True):
            assert found.tolist() == [where[part[i : i + 200]] > 1 and i + 200 <= len(part) for i in range(len(part))]


# ---- n-gram join


def test_null_texts_beside_candidates_of_their_doc_id(spark):
    words = [f"w{k}" for k in range(120)]
    near = lambda k: " ".join([*words[:-1], f"x{k}"])
    rows = [(7, near(1), "s"), (7, None, "s"), (8, near(2), "s"), (None, near(3), "s"), (None, None, "s")]
    got = Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect())
    assert got == Counter([(7, 7, 2, True), (8, 7, 2, False), (None, 7, 2, False), (7, 7, 0, True), (None, None, 0, True)])
