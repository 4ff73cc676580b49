"""Queries without SQL take all of their input: against plain versions on small fixtures."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from oracle import AT
from planloom import catalogue
from planloom.functions import wordlists as w
from planloom.operators import extraction, retrieval


def run(spark, tmp_path, query, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return catalogue.queries()[query](spark, str(tmp_path)).collect()


def test_document_rules_take_every_sentence(spark, tmp_path):
    texts = [
        "The phone is slow. Restart the phone. It stays slow. Open the Settings app! Tap on Display. restart it. Restart The Phone. Was that all?",
        "Tap on Battery. Tap on Display. Tap on Sound. Tap on Storage. Go. Open the lid",
        "One sentence only",
        "",
        None,
    ]
    rows = run(spark, tmp_path, "document_rules", documents=([(k, x, "en", "s") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    assert len(rows) == len(texts)
    for r in rows:
        sentences = [x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'])", texts[r.doc_id] or "") if x]
        steps = {}
        for x in sentences:
            if len(x.split()) >= 2:
                steps.setdefault(x.lower().rstrip("."), x if x[-1] in ".!?" else x + ".")
        assert r.steps == list(steps.values())
        assert r.imperative == [x if x.split()[0].lower().strip(",.:") in w.IMPERATIVE_VERBS else None for x in sentences]
    assert max(len(r.steps) for r in rows) > 3


def test_map_actions_has_every_supplier(spark):
    suppliers = sorted(r.s_suppkey for r in spark.read.parquet(f"{AT}/supplier.parquet").collect())
    names = sorted({r.n for r in spark.read.parquet(f"{AT}/part.parquet").select(F.initcap("p_name").alias("n")).collect()})
    rows = catalogue.queries()["map_actions"](spark, AT).select("action_id").collect()
    assert sorted(r.action_id for r in rows) == sorted(f"{k}:{names[k % len(names)]}" for k in suppliers)


def test_hybrid_ranks_as_over_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("wifi sound display battery touch zoom theme storage".split())
    # "phone" in nearly all entries has a negative weight, so that entries without it rank before them.
    texts = [" ".join(word() for _ in range(rng.randrange(1, 4))) + " phone" * (k % 9 > 0) for k in range(60)]
    entries = spark.createDataFrame([(f"e{k:02}", x) for k, x in enumerate(texts)], "entry_id string, text string")
    asked = ["phone", "phone wifi", "qqq", "", "touch sound", "battery phone phone zoom"]
    queries = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "query_id long, text string")
    model = retrieval.tfidf_fit(entries)
    lexical = {(r.query_id, r.entry_id): r.bm25 for r in retrieval.bm25_scores(queries, retrieval.bm25_weights(entries)).collect()}
    dense = {(r.query_id, r.entry_id): r.dense for r in retrieval.sparse_scores(retrieval.tfidf_vectors(queries, "query_id", model), retrieval.tfidf_vectors(entries, "entry_id", model)).collect()}
    for k in (2, 5, 15):
        got = {(r.query_id, r["rank"]): r for r in retrieval.hybrid(queries, entries, k).collect()}
        assert len(got) == k * len(asked)
        for q in range(len(asked)):
            fused = {}
            for scores in (lexical, dense):
                best = sorted((-round(scores.get((q, f"e{e:02}"), 0.0), 9), f"e{e:02}") for e in range(len(texts)))[: 4 * k]
                for at, (_, e) in enumerate(best):
                    fused[e] = fused.get(e, 0.0) + 1.0 / (w.RRF_K + at + 1)
            want = [e for _, e in sorted((-round(x, 12), e) for e, x in fused.items())[:k]]
            assert [got[q, n].entry_id for n in range(k)] == want
            assert all(abs(got[q, n].bm25 - lexical.get((q, e), 0.0)) < 1e-9 and abs(got[q, n].dense - dense.get((q, e), 0.0)) < 1e-9 for n, e in enumerate(want))


def test_rule_extract_takes_every_turn(spark, tmp_path):
    turns = [
        (1, 0, "user", "dark mode is stuck"), (1, 3, "assistant", "Restart the tablet. Open the camera."), (1, 1, "assistant", "Tap on Battery."), (1, 2, "user", "battery and camera fail"),
        (1, 5, "assistant", None), (2, 0, "user", "nobody answers"), (3, 0, "assistant", "Tap on Sound."), (4, 0, "user", None), (4, 1, "assistant", "Tap on Zoom."), (1, 4, "user", "restart"),
    ]
    rows = run(spark, tmp_path, "rule_extract", conversations=(turns, "conv_id long, turn long, role string, text string"))
    asked = []
    for conv, turn, role, text in turns:
        if role == "user":
            said = [x for _, x in sorted((t, x) for c, t, r, x in turns if c == conv and r == "assistant" and x is not None)]
            content = "## Try This\n1. Tap on Display. Then turn on Dark mode. " + "\n".join(said) if said else None
            asked.append((conv, turn, text, "Dark mode problem on your phone", content))
    plain = extraction.extract(spark.createDataFrame(asked, "conv_id long, turn long, query string, title string, content string")).collect()
    want = {(r.conv_id, r.turn): (r.fallback, r.relevance, len(r.actions), len(r.dropped_steps)) for r in plain}
    assert len(rows) == len(want) and {(r.query_id, r.turn): (r.fallback, r.relevance, r.n_actions, r.n_dropped) for r in rows} == want
    # Words of the second assistant turn are part of what the second complaint is held against.
    steps = [s for r in plain if (r.conv_id, r.turn) == (1, 2) for a in r.actions for s in a.steps]
    assert any("camera" in s for s in steps) and any("Battery" in s for s in steps)
