"""Every stage of the pipeline against a plain version of it, on what its predecessor kept."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from planloom.llm import pieces, quality
from planloom.llm.base import written

from .test_ngram_join import brute_force

AT = "/root/testdata/sf0.001"


def plain_scores(texts, model):
    """Scores from the two dictionaries and the weights alone, text by text and part by part."""
    packers = []
    for content in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(content)
        packers.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False))

    def difference(part):
        good, bad = (len(p.compress(part)) for p in packers)
        return (bad - good) / (bad + good)

    out = []
    for text in texts:
        data = (text or "").encode()
        parts = [data[k : k + 512] for k in range(0, len(data), 512)] or [b""]
        if len(parts) > 1 and len(parts[-1]) < 256:
            parts.pop()
        some = [difference(p) for p in parts]
        z = [(v - m) / s for v, m, s in zip((difference(data), min(some), sum(some) / len(some)), model.mean, model.scale, strict=True)]
        terms = [1.0, *z] + [z[i] * z[j] for i in range(3) for j in range(i, 3)]
        out.append(1 / (1 + math.exp(-sum(w * t for w, t in zip(model.weights, terms, strict=True)))))
    return out


def plain_quality(rows, spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{AT}/labels.parquet"))
    return Counter(r.doc_id for r, p in zip(rows, plain_scores([r.text for r in rows], model), strict=True) if p >= 0.7)


def test_quality_query_against_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{AT}/{name}.parquet") for name in ("documents", "labels"))
    rows = docs.collect()
    want = {r.doc_id: p for r, p in zip(rows, plain_scores([r.text for r in rows], quality.fit(docs, labels)), strict=True)}
    got = quality.query(spark, AT).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_learns_from_nothing_held_out(spark):
    """Labels of the held-out fold, and labels that contradict each other, change no score."""
    docs, labels = (spark.read.parquet(f"{AT}/{name}.parquet") for name in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, turned) == quality.fit(docs, labels)
    both = labels.limit(40).unionByName(labels.limit(40).withColumn("quality", 1 - F.col("quality")))
    assert quality.fit(docs, both).constant == 0.5


def plain_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    return Counter(min(g)[1] for g in groups.values())


def plain_near_copies(rows):
    return Counter({c for _, c, _ in brute_force([(r.doc_id, r.text) for r in rows])})


def plain_mix(rows):
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not full:
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    out = Counter()
    for s in sources:
        copies = min(3, int(target[s] // total[s]))
        rest, upto = target[s] - copies * total[s], 0
        ids = sorted((int(hashlib.md5(f"{r.doc_id}:{r.source}:{r.text}".encode()).hexdigest()[:15], 16), r.doc_id) for r in rows if r.source == s)
        taking = rest > 0 and copies < 3
        for _, doc_id in ids:
            if taking and upto + size[doc_id] > rest:
                taking = False
                once = upto + size[doc_id] - rest < rest - upto
            else:
                once = taking
            upto += size[doc_id]
            out[doc_id] = copies + once
    return +out


def test_stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").selectExpr("*", "'kept' AS extra")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = written(stage(spark, docs, AT), f"stage-{number}")
        got = Counter(r.doc_id for r in out.select("doc_id").collect())
        if number < 4:
            assert out.columns == docs.columns
        if number == 0:
            assert got == plain_quality(rows, spark, docs) and 0 < sum(got.values()) < len(rows)
        if number == 1:
            assert got == plain_copies(rows)
        if number == 2:
            assert got == plain_near_copies(rows)
        if number == 3:
            assert got == plain_mix(rows)
        if number == 4:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
            want = Counter((r.doc_id, tuple(library.encode(r.text))) for r in rows)
            assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
        docs = out


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    for rows in ([], [(1, None, None, None, None, 1), (None, "a b", "en", None, 3, 1), (2, "a b", "en", "s", 3, 1), (2, "a b", "en", "s", 3, 1)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, AT), "odd")
        assert docs.count() <= len(rows)
