"""What is alike is worked out once, and tasks hold a slice of their block."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from oracle import AT
from planloom import queries_plans
from planloom.functions import vectors
from planloom.operators import mapping, retrieval


def test_alike_actions_are_mapped_once(spark, monkeypatch):
    entries = retrieval.usable_entries(queries_plans._catalog(spark, AT))
    key = entries.orderBy("entry_id").first().key
    said = [(f"Adjust {key}", "auto", ["Open Settings.", f"Turn on {key}."]), (None, "auto", ["Tap on the menu."]), ("Clean it", "manual", None), (f"Adjust {key}", "auto", ["Open Settings.", f"Turn off {key}."])]
    rows = [(f"a{k}", *said[k % 4], k) for k in range(80)]
    actions = spark.createDataFrame(rows, "action_id string, name string, category string, steps array<string>, extra long")
    counts, texts = [], []
    best, search = mapping.best_entries, retrieval._hybrid
    monkeypatch.setattr(mapping, "best_entries", lambda a, *rest: counts.append(a.count()) or best(a, *rest))
    monkeypatch.setattr(retrieval, "_hybrid", lambda q, *rest: texts.append(q.count()) or search(q, *rest))
    done = mapping.map_actions(actions, entries)
    assert sorted(done.columns) == sorted([*actions.columns, "kind", "link", "check", "chosen_id", "name_score"])
    got = {r.action_id: r for r in done.collect()}
    assert len(got) == 80 and counts == [3] and texts == [3]
    for k in range(80):
        r = got[f"a{k}"]
        assert r.extra == k and r.name == said[k % 4][0] and r.steps == said[k % 4][2]
        assert r.chosen_id == {0: f"{key}:onURL", 3: f"{key}:offURL"}.get(k % 4)
        assert (r.kind, r.category) == [("catalog", "auto"), ("dummy", "auto"), ("none", "manual"), ("catalog", "auto")][k % 4]


def test_equal_texts_are_searched_once(spark, monkeypatch):
    entries = retrieval.usable_entries(queries_plans._catalog(spark, AT))
    texts = []
    search = retrieval._hybrid
    monkeypatch.setattr(retrieval, "_hybrid", lambda q, *rest: texts.append(q.count()) or search(q, *rest))
    queries = spark.createDataFrame([(f"q{k}", ["turn on almond", None, "", "disable blue"][k % 4]) for k in range(40)], "query_id string, text string")
    rows = retrieval.hybrid(queries, entries, 5).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.query_id, []).append((r["rank"], r.entry_id, r.fused, r.bm25, r.dense))
    assert texts == [3] and len(rows) == 40 * 5
    assert all(sorted(lists[f"q{k}"]) == sorted(lists[f"q{k % 4}"]) for k in range(40))


def test_a_task_holds_the_products_of_a_slice():
    rng = np.random.default_rng(1)
    n, m = vectors.QUERIES_A_BLOCK, vectors.ENTRIES_A_BLOCK
    q = pd.DataFrame({"query_id": range(n), "article": None, "asked_vec": list(rng.normal(size=(n, 4)))})
    d = pd.DataFrame({"plan_id": [str(k % 9) for k in range(m)], "held": None, "entry_id": range(m), "vec": list(rng.normal(size=(m, 4)))})
    tracemalloc.start()
    found = vectors.two_of_block(q, d)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All products at once are n * m doubles, 134 MB, and several arrays of that size.
    assert most < 60e6 and len(found) == 2 * n
    scores = np.stack(q.asked_vec) @ np.stack(d.vec).T
    best = np.array([scores[:, k::9].max(1) for k in range(9)])
    assert np.allclose(found.similarity.to_numpy().reshape(n, 2), -np.sort(-best, axis=0)[:2].T)


def test_alike_rows_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    from planloom.operators import relational

    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shout(x):
        counted.add(1)
        return None if x is None else x.upper()

    rows = spark.createDataFrame([(k, [None, "a", "b"][k % 3], k % 2) for k in range(60)], "k long, x string, y int")
    got = relational.once_each(rows, ["x", "y"], {"z": shout(F.col("x"))}).collect()
    assert sorted((r.k, r.x, r.y, r.z) for r in got) == [(k, x := [None, "a", "b"][k % 3], k % 2, x and x.upper()) for k in range(60)]
    assert counted.value == 6


def test_frequent_grams_are_not_brought_together(spark, monkeypatch):
    texts = spark.createDataFrame([(k, ["ab cd", "ab", None, " "][k % 4]) for k in range(40)], "entry_id long, text string")
    model = retrieval.tfidf_fit(texts)
    plain = {}
    for r in retrieval.tfidf_vectors(texts, "entry_id", model).collect():
        plain.setdefault(r.entry_id, set()).add((r.gram, round(r.weight, 9)))
    cut = []
    whole = retrieval.tfidf_vectors
    monkeypatch.setattr(retrieval, "tfidf_vectors", lambda t, *rest: cut.append(t.count()) or whole(t, *rest))
    got = {r.entry_id: {(v.gram, round(v.weight, 9)) for v in r.vector} for r in retrieval.tfidf_arrays(texts, "entry_id", model).collect()}
    assert got == plain and len(got) == 20 and cut == [4]
    assert "BroadcastHashJoin" in whole(texts, "entry_id", model)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_gates_pass_all_that_the_searches_change(spark):
    """Texts at the gates' edges, cleaned with and without them."""
    from pyspark.sql import functions as F

    from planloom.functions import text as t
    from planloom.functions import wordlists as w

    said = [
        "See\u00a0. Go to x", "V\u0131\u017fit!", "\u017fee at", "Clic\u212a here now", "Read more\u2003deta\u0130ls", "learn MORE", "onl\u0131ne at home", "a  b ,c", "x..y", "a\u0085b\u2028", "\u3000Tap it\u3000", "www.\u00e9.com a@b.co",
        "Please then also tap it.", "You can also please let's try to tap the key", "If it rings, you should tap it", "if, tap it", "for x: tap: go on", "Tap, as follows", "some steps: tap it", "\u2003Tap\u2003it -", "- tap -", "", " ", "a", None, "WWW.X go", "[a](b) tap HTTP://x y", "at", "to\t.", "x\n,",
    ]
    plain_strip = lambda x, c=r"\s": F.regexp_replace(x, f"(?U)^[{c}]+|[{c}]+$", "")

    def plain_scrub(out):
        for pattern in (w.MD_LINK, w.SCHEME_URL, w.WWW, w.EMAIL, w.DOMAIN):
            out = F.regexp_replace(out, pattern, "$1" if pattern == w.MD_LINK else "")
        out = F.regexp_replace(F.regexp_replace(out, w.DANGLING, ""), r"(?U)\s+([.,;:!?])", "$1")
        return plain_strip(F.regexp_replace(F.regexp_replace(out, r"([.,;:!?])\1+", "$1"), r"(?U)\s{2,}", " "), " ,;:")

    def plain_step(x):
        s = plain_strip(F.regexp_replace(plain_scrub(F.coalesce(x, F.lit(""))), w.BULLET, ""))
        for _ in range(3):
            s = plain_strip(F.regexp_replace(s, w.LEAD_FILLER, ""))
        s = plain_strip(F.regexp_replace(s, r"(?U)\s+", " "), r" \-")
        capital = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))
        return F.when((F.size(t.words(s)) >= 2) & ~s.rlike(w.STEP_NOISE), F.when(capital.rlike(r"[.!?]$"), capital).otherwise(F.concat(capital, F.lit("."))))

    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in said], "x string")
    got = rows.select("x", t.strip(x).alias("a"), plain_strip(x).alias("b"), t.scrub(x).alias("c"), plain_scrub(x).alias("d"), t.clean_step(x).alias("e"), plain_step(x).alias("f")).collect()
    assert len(got) == len(said)
    for r in got:
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), r.x
    once = rows.select(t.first_of_each(F.array(F.lit("B"), F.lit("a"), F.lit("b"), x, F.lit("A"), F.lit("c"))).alias("y"), "x").collect()
    for r in once:
        seen, want = set(), []
        for v in ["B", "a", "b", r.x, "A", "c"]:
            if v is not None and v.lower() not in seen:
                seen.add(v.lower())
                want.append(v)
        assert r.y == want
