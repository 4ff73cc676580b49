"""Clustering, extraction and periodic runs against brute force, and their cases of nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import base, clusters, exact_dedup, main_text, mixing, ngram_join, periodic, personal_data, suffix_dedup, top_k

# ---- periodic runs


def runs_by_force(words):
    """(start, length, period) of the runs, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        at = 0
        for equal, group in groupby(same):
            k = len(list(group))
            if equal and k + q >= max(6, 4 * q) and not any(s <= at and at + k + q <= s + length and q % p == 0 for s, length, p in found):
                found[at, k + q, q] = True
            at += k
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_of(rng, kind, n):
    letters = "ab" if kind == "two" else "abcdefgh"
    if kind == "periodic":
        root = rng.choices(letters[: rng.randint(1, 4)], k=rng.randint(1, 9))
        return rng.choices(letters, k=rng.randint(0, 5)) + (root * n)[:n] + rng.choices(letters, k=rng.randint(0, 5))
    if kind == "fibonacci":
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    return rng.choices(letters, k=n)


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [text_of(rng, kind, n) for kind in ("two", "eight", "periodic", "fibonacci") for n in (0, 1, 5, 6, 7, 8, 12, 40, 150) for _ in range(30 if kind == "periodic" else 6)]
    numbers = {w: k for k, w in enumerate("abcdefgh")}
    words = np.array([numbers[w] for t in texts for w in t], np.int64)
    found = list(zip(*(x.tolist() for x in periodic.runs_of(words, np.array(list(map(len, texts))))), strict=True))
    for k, text in enumerate(texts):
        assert [(s, n, p) for t, s, n, p in found if t == k] == runs_by_force(text), text
    assert len(found) > 100


def test_smaller_half_bounds_the_moves(monkeypatch):
    """Positions that are moved stay within n log n, where a text of one word would move n * n."""
    moved = []
    real = periodic.Classes.refine
    monkeypatch.setattr(periodic.Classes, "refine", lambda self, small: moved.append(len(small)) or real(self, small))
    n = 4000
    for words in (np.zeros(n, np.int64), np.arange(n) % 7, np.random.default_rng(1).integers(0, 2, n)):
        moved.clear()
        periodic.runs_of(words, np.array([n]))
        assert sum(moved) <= 4 * n * np.log2(n)


def tailed(doc_id, text):
    """The query's words of a document."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digests_by_force(doc_id, text):
    words = tailed(doc_id, text)
    runs = runs_by_force(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id,
        len(runs),
        *best,
        best[1] and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_periodic_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(text_of(rng, rng.choice(["two", "eight", "periodic"]), rng.randint(0, 60)))) for i in range(300)]
    rows += [(7, "x \t y\x0b\n" * 30), (7, "x \t y\x0b\n" * 30), (1000, None), (1001, ""), (1002, " \n"), (1003, "é é é é é é é é"), (2**60 + 1, "a b " * 9), (-5, "w " * 3000)]
    rows += [(next(i for i in range(2000, 9999) if zlib.crc32(str(i).encode()) % 10 == 0), t) for t in (None, "", "q r s t u v w x y z " * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS words", "3 AS h").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digests_by_force(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 100


def test_periodic_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b " * 5), (2**60 + 1, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.collapsed(periodic.with_tails(rows)).collect()}
    assert got[None].collapsed == "a b" and [tuple(r) for r in got[None].runs] == [(0, 10, 2)]
    assert got[2**60 + 1].collapsed == "c" and got[2**60 + 1].n_words == 1
    assert periodic.collapsed(rows.limit(0)).collect() == []


def test_long_periodic_text_takes_bounded_time():
    began = time.perf_counter()
    text, start, length, period = periodic.runs_of(np.arange(60_000) % 15_000, np.array([60_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [60_000], [15_000])
    assert time.perf_counter() - began < 30


# ---- centroid clustering


def kmeans_by_force(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    centroids = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for done in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, centroids[c], strict=True)), c)) for _, x in kept]
        if done < rounds:
            for c in range(len(centroids)):
                own = [x for (_, x), to in zip(kept, near, strict=True) if to == c]
                if own:
                    centroids[c] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return sorted((i, to, sum((a - b) ** 2 for a, b in zip(x, centroids[to], strict=True))) for (i, x), to in zip(kept, near, strict=True)), centroids


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS x", "3 AS ids").repartition(3)


@pytest.mark.parametrize("tree_rows", [4096, 7])
def test_clusters_equal_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(clusters.ball_trees, "__defaults__", (tree_rows,))
    rng = np.random.default_rng(3)
    rows = [(int(i) + 2**60, (rng.normal(size=5) * 0.1 + 3 * (i % 6)).tolist()) for i in range(900)]
    rows += [rows[0], rows[0], (5, [0.5] * 5), (6, [0.5] * 5), (7, [-0.5] * 5), (1, None), (2, [1.0] * 4), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [float("nan")] * 5), (8, [float("inf")] * 5), (9, [])]
    for k in (6, 1):
        got, centroids = clusters.clustered(vectors_of(spark, rows), k=k, rounds=3, dim=5, scale=64)
        want, last = kmeans_by_force(rows, k, 3, 5, 64)
        assert sorted(map(tuple, got.collect())) == want and centroids.tolist() == last


def test_whole_balls_are_assigned(spark):
    """On vectors around centres most go to a centroid by their ball's count and sum; none is lost."""
    rng = np.random.default_rng(4)
    rows = clusters.usable(vectors_of(spark, [(i, (rng.normal(size=5) * 0.05 + 9 * (i % 4)).tolist()) for i in range(4000)]), 5, 64)
    sums = clusters.round_sums(clusters.ball_trees(rows), np.array([[576 * c] * 5 for c in range(4)])).agg(F.sum("n"), F.sum("whole")).first()
    assert sums[0] == 4000 and sums[1] >= 4000 - 3 * 3 * clusters.LEAF_ROWS  # three trees, in each three leaves of two centres


def test_clusters_few_repeated_and_large(spark):
    assert clusters.clustered(vectors_of(spark, [(1, None)]))[0].collect() == []
    same = [(3, [0.25] * 64)] * 40 + [(4, [0.25] * 64)]
    got, centroids = clusters.clustered(vectors_of(spark, same))
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0)} and got.count() == 41 and len(centroids) == 16
    got, centroids = clusters.clustered(vectors_of(spark, [(None, [1.0] * 64), (2, [2.0] * 64)]))
    assert sorted(map(tuple, got.collect()), key=repr) == [(2, 0, 0), (None, 1, 0)]
    with pytest.raises(Exception, match="larger than"):
        clusters.clustered(vectors_of(spark, [(1, [1e9] * 64)]))


# ---- main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar comments-open"><div id="site-header"><h1>The site</h1></div><div class="topnav"><a href="/">Home</a> <a href="/b">B</a></div>
<div class="wrap"><div class="content"><h2>The  title</h2><p>First &lt;para&gt;, with a <a href="x">link</a>, and&nbsp;more<br>words in it.
<p>Second one, <b>bold <i>both</b> here</i>, that is not closed<div class="ad-slot">Buy, buy, buy this now, it is very good.</div>
<p>caf&eacute; &#8211; short</p><ul><li><a href="1">One thing</a></li><li><a href="2">Another</a></li></ul><ul><li>a point<li>b point</ul>
<form><label>Mail</label><input name=q><p>Sign up, for this long letter, please.</p></form></div>
<div class="sidebar-right"><p>Side text, rather long, with commas, many of them, more than the rest has, surely.</p></div></div>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I like it, a lot, and write about it, at length.</p></div></div>
<div style="display: none">Hidden, long text that no one sees on the page.</div><div class="cookie-consent">We use cookies, for you.</div>
<footer><p>&copy; us, and all of the others, in the world.</p></footer>"""
TEXT = "The title\n\nFirst <para>, with a link, and more words in it.\n\nSecond one, bold both here, that is not closed\n\ncafé – short\n\na point\n\nb point"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE, TEXT),
        ("<article><header><h1>A title</h1><p>by me</p></header><section><p>One, two, three, and some more.</p></section><section><p>Four.</p></section><aside>x</aside></article><p>After it, a text outside of the article.</p>", "A title\n\nOne, two, three, and some more.\n\nFour."),
        ("<main><h1>H</h1><div><p>A paragraph, of the main part.</p></div><div role=navigation><p>Not, this, one, at all, ever.</p></div></main>", "H\n\nA paragraph, of the main part."),
        ("<body><form id=all><div><p>A page, which is one form.</p></div></form>", "A page, which is one form."),
        ("<nav><a href=x>Home</a></nav><footer>end</footer>", ""),
        ("only text &amp; no tags &am", "only text & no tags &am"),
        ("<p>It breaks off, in the midst <a href='", "It breaks off, in the midst"),
        ("<div><p>1 < 2, and 3 > 2, as <!-- not --> everyone knows.</p></div>", "1 < 2, and 3 > 2, as everyone knows."),
        ("<p>Text with <span class='advert'>no <b>such</b></span> thing.</p><pre>a\n  b</pre>", "Text with thing.\n\na b"),
        ("<div><article class='teaser'><p>Read this, too, if you like.</p></article><article class='post category-ads'><p>The text, of the post.</p></article></div>", "The text, of the post."),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(html, text):
    assert main_text.main_text(html or "") == text


def test_odd_html_takes_bounded_time():
    began = time.perf_counter()
    for part in ("<div>", '<p a="', "<b ", "<!--", "<a href=x>", "<li>", "<table><tr><td>", "<script>", "&", "< ", "</div>", "<span class=ad>", "<a b='c' d=e/>"):
        main_text.main_text(part * 50_000)
    assert time.perf_counter() - began < 30


def test_extraction_keeps_rows(spark):
    pages = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (2**60 + 1, "w", "<p>é, " + "long " * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars").repartition(3)
    got = sorted(map(tuple, main_text.extracted(df).collect()), key=repr)
    assert got == sorted(((i, u, main_text.main_text(h or "")) for i, u, h in pages), key=repr)
    assert len(max((t for _, _, t in got), key=len)) == 2 + 300_000 * 5 + 1 - 1
    assert main_text.extracted(df.limit(0)).collect() == []


# ---- numbers of 64 bits beside nulls, clashing columns, long periodic texts


@pytest.mark.parametrize("block", [8192, 7])
def test_top_k_of_large_ids_and_scores(spark, monkeypatch, block):
    """Ids from 2^60 on, scores of about 10^18 that differ in their last digits, and blocks with and without results."""
    for name in ("CANDIDATES_A_BLOCK", "QUERIES_A_BLOCK"):
        monkeypatch.setattr(top_k, name, block)
    monkeypatch.setattr(top_k, "FLOOR_ROWS", 3)
    monkeypatch.setattr(top_k, "BROADCAST_ROWS", 300_000 if block > 7 else 0)
    base_id, rng = 2**60 // 100 * 100, np.random.default_rng(8)
    rows = [(base_id + k, [900_000.0 + float(rng.integers(0, 7)) / 1024, float(rng.integers(-3, 3)) / 1024]) for k in range(220)]
    rows += [(None, [1.0, 1.0]), (base_id + 1000, [2.0]), (base_id + 1100, None)]
    ints = {i: [int(np.floor(1024 * v)) for v in x] for i, x in rows if i and x and len(x) == 2}
    want = set()
    for q in [i for i in ints if i % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in ints.items() if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in top_k.top_k(df).collect()}
    assert got == want and min(r[3] for r in got) > 2**59


def removed_by_force(rows, n=suffix_dedup.LENGTH):
    """(doc_id, bytes, removed, runs, digest of the rest) of each row."""
    where = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            where[b[i : i + n]] = where.get(b[i : i + n], 0) + 1
    out = []
    for doc_id, t in rows:
        b, upto, gone = (t or "").encode(), 0, bytearray(len((t or "").encode()))
        for i in range(len(b) - n + 1):
            if where[b[i : i + n]] > 1:
                a, upto = max(upto, i), i + n
                gone[a:upto] = b"\x01" * (upto - a)
        runs = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS anchor", "2 AS first").repartition(3)
    return sorted(map(tuple, suffix_dedup.remove_repeats(df).withColumn("text", F.sha2("text", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "text").collect()), key=repr)


@pytest.mark.parametrize("task", [60_000, 120])
def test_suffix_dedup_of_large_ids_beside_null(spark, monkeypatch, task):
    monkeypatch.setattr(suffix_dedup, "TASK_WINDOWS", task)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(400)
    rows = [(doc_id, noise(80) + shared[k:] + noise(90)) for k, doc_id in enumerate((2**60 + 1, 2**60 + 3, None, None, -(2**60) - 1))]
    assert removed(spark, rows) == removed_by_force(rows)


@pytest.mark.parametrize(("task", "block"), [(60_000, 500_000), (100, 500_000), (60_000, 700), (150, 450)])
def test_suffix_dedup_of_periodic_texts(spark, monkeypatch, task, block):
    """Stretches of several periods, broken off, within and across texts and blocks; windows of one that stand elsewhere once."""
    monkeypatch.setattr(suffix_dedup, "TASK_WINDOWS", task)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(task + block)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    roots = ["a", "ab", "abcdefg", noise(31), noise(33), noise(90), noise(168), noise(190)]
    rows = [(k, noise(rng.randrange(60)) + (root * 900)[: rng.randrange(300, 900)] + noise(rng.randrange(250))) for k, root in enumerate(roots * 2)]
    rows += [(100 + k, noise(50) + (root * 300)[5:235] + noise(20)) for k, root in enumerate(roots)]
    broken = (roots[3] * 30)[:700]
    rows += [(200, broken[:350] + "#" + broken[351:]), (201, broken[:100] + "#" + broken[101:]), (None, "a" * 700), (300, "é" * 300), (301, "a" * 201), (302, "b" * 201)]
    assert removed(spark, rows) == removed_by_force(rows)


@pytest.mark.parametrize("period", ["a", "abcdefg"])
def test_slices_of_a_long_periodic_text_are_few(period):
    import resource

    text = (period * 20_000_000)[:20_000_000].encode()
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for block in suffix_dedup.in_blocks([text]):
        texts = [t for _, _, t in block]
        n += len(suffix_dedup.folded(texts, *suffix_dedup.slices(texts))[0])
    assert n < 100 * (len(text) / suffix_dedup.BLOCK_BYTES + 1)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


INTERNAL = "gone_id gone_kept gone_digest gone_rows _gone_id _gone_kept _gone_digest _source _copies _below _target _times _copy mix_source mix_copies mix_below mix_again _score digest row n kept hash size other key slot bucket"


def test_columns_of_any_name_pass(spark):
    """Every name that an operator uses itself, as an extra column, comes back with its values."""
    names = [*INTERNAL.split(), "a.b", "c`d"]
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(k, t, s) for k, (t, s) in enumerate([(text, "a"), (text, "a"), (text + " x", "b"), ("y z", None), ("y z ", "b"), (None, "c"), (text[::-1], "c")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.select("*", *(F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(name) for k, name in enumerate(names)))
    for stage in (exact_dedup.deduplicated, ngram_join.one_of_each, mixing.mixed):
        got = stage(df)
        assert got.columns == df.columns
        rows_ = got.collect()
        assert rows_ and all(r[3 + k] == f"{k}:{r.doc_id}" for r in rows_ for k in range(len(names)))


def test_unused_names():
    assert base.unused(["a", "_A", "b"], "a", "b", "c") == ["__a", "_b", "_c"]


def test_ngram_join_with_one_bucket_of_most_rows(spark, monkeypatch):
    """Near copies of one text share buckets and one hub: beyond HOT_ROWS their rows are joined by broadcast."""
    monkeypatch.setattr(base, "HOT_ROWS", 10)
    words = [f"w{k}" for k in range(200)]
    rows = [(2**60 + k, " ".join([*words[:-1], f"x{k}"])) for k in range(60)] + [(k, f"other text {k} of its own words {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {2**60 + k: (2**60, 59, k == 0) for k in range(60)} | {k: (k, 0, True) for k in range(20)}


def test_account_numbers_end_where_their_country_says(spark):
    texts = {
        "to DE89 3704 0044 0532 0130 00 AND MORE": "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432XYZ": "GB82WEST12345698765432", "NO93 8601 1117 947 12": "NO93 8601 1117 947",
        "DE89 3704 0044 0532 0130 01 AND": None, "DE89 3704 0044": None, "BE68 5390 0754 7034": "BE68 5390 0754 7034",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.iban for r in personal_data.personal_data(rows).collect()}
    for k, (text, want) in enumerate(texts.items()):
        assert [text[s.start : s.end] for s in got[k]] == ([want] if want else [])
