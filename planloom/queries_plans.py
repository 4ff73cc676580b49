"""Queries of retrieval, cache, evaluation and plan operators over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import similarity
from .functions import text as t
from .functions import wordlists as w
from .operators import audit as rules
from .operators import cache, door_index, evaluation, extraction, mapping, ordering, relational, retrieval
from .queries_text import NORM, TOKENS, table
from .session import settled, spread
from .sources import readers

COSINE = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


# ---- relational


def equi_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with their first order."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    out = relational.equi_pair(c, o, F.col("c_custkey") == F.col("o_custkey"), F.col("o_orderkey").asc_nulls_last(), key=["c_custkey"])
    return out.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


EQUI_PAIR_SQL = """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey NULLS LAST) = 1
"""


def semi_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return relational.cached(d, l, "doc_id").select("doc_id", "source")


def anti_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return relational.uncached(d, l, "doc_id").select("doc_id", "source")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("norm", t.normalize_query(F.col("text")))
    return relational.first_of(d, ["norm"], F.col("doc_id")).select("doc_id", "lang")


DEDUPE_SQL = f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY {NORM.format('text')} ORDER BY doc_id) = 1"


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("l"))
    return e.select("user_id", "event_type", "l.event_id", "l.value")


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    out = relational.upsert(o.where("o_orderkey % 3 = 0"), new, "o_orderkey")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


UPSERT_SQL = """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0
) GROUP BY o_orderstatus
"""


def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_linenumber").cast("long"))
    out = relational.merge_by_name(l, ["l_orderkey", "l_returnflag"], "seq", "l_suppkey")
    return out.select("l_orderkey", "l_returnflag", "first_at", F.array_join(F.transform("merged", lambda x: x.cast("string")), ",").alias("merged"))


MERGE_SQL = """
SELECT l_orderkey, l_returnflag, min(pos) AS first_at, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY pos, l_suppkey) AS merged FROM (
  SELECT l_orderkey, l_returnflag, l_suppkey, min(CAST(l_linenumber AS BIGINT)) AS pos FROM lineitem GROUP BY ALL) GROUP BY ALL
"""


def running_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    seen = relational.running_seen(l, F.col("l_returnflag") == "R", ["l_orderkey"], *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    rows = l.select("l_orderkey", "l_linenumber", "l_returnflag", seen.alias("seen"))
    return rows.groupBy("l_returnflag").agg(F.count_if("seen").alias("after_return"), F.count("*").alias("n"))


RUNNING_SQL = """
SELECT l_returnflag, CAST(count(*) FILTER (seen) AS BIGINT) AS after_return, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT l_returnflag, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM lineitem) GROUP BY l_returnflag
"""


# ---- retrieval


def _bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _bench(spark, sf_dir)
    best = retrieval.bm25_top(queries, retrieval.inverted.bm25_index(corpus), 15)
    return best.select("query_id", "entry_id", "bm25", F.col("rank").cast("long").alias("rank"))


_BM25_CTE = f"""
tok AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)),
len_ AS (SELECT avg(len({TOKENS.format("text")})) AS mean_length, count(*) AS docs FROM documents),
p AS (SELECT term, doc_id, n, count(*) AS tf FROM tok GROUP BY ALL),
raw_ AS (SELECT term, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY term), len_),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_) ELSE raw END AS idf FROM raw_),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id AS entry_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean_length))), 6) AS bm25
      FROM q JOIN p USING (term) JOIN idf USING (term), len_ GROUP BY ALL),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, entry_id) AS BIGINT) AS rank FROM s)
"""
BM25_SQL = f"WITH {_BM25_CTE} SELECT query_id, entry_id, bm25, rank FROM b WHERE rank <= 15"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    scores = retrieval.dense_candidates(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("entry_id"), "vec"), 15)
    best = retrieval.ranked(scores, "dense", 15, 6)
    return best.select("query_id", "entry_id", "dense", F.col("rank").cast("long").alias("rank"))


_DENSE_CTE = f"""
d AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round({COSINE.format("a.embedding", "b.embedding")}, 6) AS dense
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{{0}}),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, entry_id) AS BIGINT) AS rank FROM d)
"""
DENSE_SQL = f"WITH {_DENSE_CTE.format(' WHERE a.vec_id % 20 = 0')} SELECT query_id, entry_id, dense, rank FROM v WHERE rank <= 15"


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items' BM25 list fused with the dense list of the vector of the same number; every vector asks."""
    queries, corpus = _bench(spark, sf_dir)
    by_terms = retrieval.bm25_top(queries, retrieval.inverted.bm25_index(corpus), 60)
    v = _vectors(spark, sf_dir)
    scores = retrieval.dense_candidates(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("entry_id"), "vec"), 60)
    by_vectors = retrieval.ranked(scores, "dense", 60, 6)
    best = retrieval.ranked(retrieval.fuse(by_terms, by_vectors), "fused", 15, 9)
    return best.select("query_id", "entry_id", "fused", F.col("rank").cast("long").alias("rank"))


RRF_SQL = f"""
WITH {_BM25_CTE}, {_DENSE_CTE.format("")}, u AS (
  SELECT query_id, entry_id, 1.0::DOUBLE / (60 + rank) AS part FROM b WHERE rank <= 60 UNION ALL SELECT query_id, entry_id, 1.0::DOUBLE / (60 + rank) FROM v WHERE rank <= 60
), f AS (SELECT query_id, entry_id, round(sum(part), 9) AS fused FROM u GROUP BY ALL)
SELECT query_id, entry_id, fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, entry_id) AS BIGINT) AS rank FROM f
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, entry_id) <= 15
"""


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-gram vectors of part names: length and heaviest gram."""
    p = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("entry_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    v = retrieval.tfidf_arrays(p, "entry_id", settled(retrieval.tfidf_fit(p), "tfidf-model"))
    return v.select("entry_id", F.size("vector").cast("long").alias("n_grams"), F.round(F.array_max(F.col("vector")["weight"]), 6).alias("top_weight"))


TFIDF_SQL = """
WITH p AS (SELECT p_partkey AS entry_id, lower(p_name || ' ' || p_type) AS text FROM part),
wd AS (SELECT entry_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS x FROM p),
g AS (SELECT entry_id, unnest(list_concat(
        list_transform(range(1, greatest(2, len(x) + 1)), lambda i: substr(' ' || x || ' ', i, 3)),
        list_transform(range(1, greatest(1, len(x))), lambda i: substr(' ' || x || ' ', i, 4)),
        list_transform(range(1, greatest(1, len(x) - 1)), lambda i: substr(' ' || x || ' ', i, 5)))) AS gram FROM wd),
tf AS (SELECT entry_id, gram, count(*) AS tf FROM g GROUP BY ALL),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM p)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram),
r AS (SELECT entry_id, gram, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (gram))
SELECT entry_id, CAST(count(*) AS BIGINT) AS n_grams, round(max(raw) / sqrt(sum(raw * raw)), 6) AS top_weight FROM r GROUP BY entry_id
"""


def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalog: of a usable type, and not about appliances."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, [*w.USABLE_TYPES, "viewURL"]))
    catalog = p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("app://"), F.col("p_partkey")).alias("deeplink"), F.col("p_type").alias("description"),
        F.concat(F.when(F.col("p_size") % 7 == 0, "TV Settings ").otherwise("Open "), F.col("p_name")).alias("message"),
        F.get(kinds, (F.col("p_size") % 5).cast("int")).alias("originalType"), F.lit(None).cast("string").alias("qna_description"),
        F.when(F.col("p_size") % 2 == 0, F.struct(F.concat(F.lit("check://"), F.col("p_brand")).alias("deeplink"), F.concat(F.col("p_name"), F.lit(" (x)")).alias("key"))).alias("validation"),
    )
    return retrieval.usable_entries(catalog).select("entry_id", "original_type", F.array_join("names", "|").alias("names"), "text")


CATALOG_SQL = """
SELECT p_partkey AS entry_id, ['onURL', 'offURL', 'onClickURL', 'updateURL', 'viewURL'][p_size % 5 + 1] AS original_type,
  CASE WHEN p_size % 2 = 0 THEN p_name || ' (x)|' || p_name ELSE p_name END AS names,
  CASE WHEN p_size % 2 = 0 THEN p_name || ' (x)' ELSE '' END || '. Open ' || p_name || '. ' || p_type || '. ' AS text
FROM part WHERE p_size % 5 <> 4 AND p_size % 7 <> 0
"""


# ---- cache


def _complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text", F.lit(None).cast("string").alias("article"))


def exact_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints against a cache of the first turns of every third conversation."""
    asked = _complaints(spark, sf_dir)
    held = asked.where("query_id % 300 = 0").select(t.plan_id(F.col("text")).alias("plan_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("article"), F.col("query_id").alias("seq"))
    doors = held.select("plan_id", t.normalize_query(F.col("query")).alias("norm"), "seq")
    hits = cache.exact_hits(asked, held.select("plan_id", "article").distinct(), doors)
    return asked.join(hits, "query_id", "left").select("query_id", "plan_id", F.col("plan_id").isNotNull().alias("hit"))


EXACT_SQL = f"""
WITH c AS (SELECT conv_id * 100 + turn AS query_id, {NORM.format("text")} AS norm FROM conversations WHERE role = 'user'),
d AS (SELECT DISTINCT norm FROM c WHERE query_id % 300 = 0)
SELECT query_id, CASE WHEN d.norm IS NOT NULL THEN substr(sha1(c.norm), 1, 16) END AS plan_id, d.norm IS NOT NULL AS hit FROM c LEFT JOIN d ON c.norm = d.norm
"""


def _asked_and_held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, plans and doors: every twentieth vector against the others, whose labels are plans."""
    v = _vectors(spark, sf_dir)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec", F.lit(None).cast("string").alias("article"), F.col("label").alias("expected"))
    doors = v.where("vec_id % 20 <> 0").select(F.col("label").cast("string").alias("plan_id"), "vec", F.col("vec_id").alias("seq"))
    plans = doors.select("plan_id").distinct().withColumn("article", F.lit(None).cast("string"))
    return asked, plans, doors


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, plans, doors = _asked_and_held(spark, sf_dir)
    return cache.top_two(cache.best_by_plan(asked, plans, doors)).join(asked.select("query_id", "expected"), "query_id")


def cache_semantic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "plan_id", "similarity", "margin", "seq", cache.is_hit(0.3, 0.02).alias("hit"))


_NEAR_CTE = f"""
s AS (SELECT a.vec_id AS query_id, a.label AS expected, CAST(b.label AS VARCHAR) AS plan_id, b.vec_id AS seq, {COSINE.format("a.embedding", "b.embedding")} AS sim
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0),
m AS (SELECT query_id, expected, plan_id, max(sim) AS sim, arg_max(seq, (sim, -seq)) AS seq FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS k, lead(sim, 1, 0.0) OVER o AS second FROM m WINDOW o AS (PARTITION BY query_id ORDER BY sim DESC, plan_id)),
n AS (SELECT query_id, expected, plan_id, round(sim, 4) AS similarity, round(sim - second, 4) AS margin, seq FROM r WHERE k = 1)
"""
SEMANTIC_SQL = f"WITH {_NEAR_CTE} SELECT query_id, plan_id, similarity, margin, seq, similarity >= 0.3 AND margin >= 0.02 AS hit FROM n"


def door_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup through an index of doors by centre, written before it is searched."""
    asked, plans, doors = _asked_and_held(spark, sf_dir)
    centres = door_index.fit(doors)
    if centres is not None:
        doors = settled(door_index.homed(doors, centres).repartitionByRange("home", "reach").sortWithinPartitions("home", "reach"), "doors")
    near = cache.top_two(cache.best_by_plan(asked, plans, doors, centres))
    return near.select("query_id", "plan_id", "similarity", "margin", "seq", cache.is_hit(0.3, 0.02).alias("hit"))


#: The cache's own range in steps of 0.025, and lower ones that the driver's vectors reach.
THRESHOLDS = [0.2, 0.3, 0.4, 0.5, *(round(0.7 + 0.025 * k, 3) for k in range(11))]


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _nearest(spark, sf_dir)
    rows = near.select(
        F.col("plan_id").alias("got"), F.col("expected").cast("string").alias("expected"), "similarity", "margin", (F.col("expected") < 8).alias("in_cache"),
        (F.col("expected") % 4).alias("expected_article"), (F.col("plan_id").cast("int") % 4).alias("got_article"),
    )
    return evaluation.threshold_sweep(rows, THRESHOLDS, 0.01)


SWEEP_SQL = f"""
WITH {_NEAR_CTE}, x AS (SELECT *, expected < 8 AS in_cache, CAST(expected AS VARCHAR) = plan_id AS same, expected % 4 = CAST(plan_id AS INT) % 4 AS sib,
  similarity >= threshold AND margin >= 0.01 AS hit FROM n, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in THRESHOLDS)}]) AS threshold))
SELECT threshold, CAST(count(*) FILTER (in_cache) AS BIGINT) AS cached, CAST(count(*) FILTER (hit AND in_cache AND same) AS BIGINT) AS right_hits,
  CAST(count(*) FILTER (hit AND in_cache AND NOT same AND sib) AS BIGINT) AS same_article, CAST(count(*) FILTER (hit AND in_cache AND NOT same AND NOT sib) AS BIGINT) AS wrong_plan,
  CAST(count(*) FILTER (hit AND NOT in_cache) AS BIGINT) AS false_hits, CAST(count(*) FILTER (NOT in_cache) AS BIGINT) AS uncached,
  round(count(*) FILTER (hit AND in_cache AND same) / greatest(count(*) FILTER (in_cache), 1), 3) AS hit_rate FROM x GROUP BY threshold
"""


def cache_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doors of customers as plans: their name, a normalised form, and variations of it."""
    c = table(spark, sf_dir, "customer")
    plans = c.select(F.col("c_custkey").cast("string").alias("plan_id"), F.col("c_name").alias("query"), F.lower("c_name").alias("normalized_query"), F.array(F.col("c_mktsegment"), F.upper("c_name"), F.lit("!!")).alias("variations"))
    return cache.doors_of(plans).groupBy("plan_id").agg(F.count("*").alias("n_doors"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", "norm"))), "|").alias("doors"))


DOORS_SQL = r"""
SELECT CAST(c_custkey AS VARCHAR) AS plan_id, CAST(2 AS BIGINT) AS n_doors,
  'query=' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || '|variation=' || lower(c_mktsegment) AS doors FROM customer
"""


# ---- evaluation


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency_percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], digits=4)


PERCENTILE_SQL = """
SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type
"""


def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.stage_counters(d, "lang", {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 1000})


COUNTERS_SQL = """
SELECT lang, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS toxic,
  CAST(count(*) FILTER (n_chars > 1000) AS BIGINT) AS long FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
"""


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.determinism(table(spark, sf_dir, "documents"), "text", "lang")


DETERMINISM_SQL = """
SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(count(*) FILTER (n <= 1) AS BIGINT) AS n_stable FROM (SELECT count(DISTINCT lang) AS n FROM documents GROUP BY text)
"""


def worst_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nearest(spark, sf_dir).withColumn("in_cache", F.lit(True))
    return evaluation.worst_misses(rows, 0.5, 0.02).select("query_id", "plan_id", "similarity")


MISSES_SQL = f"WITH {_NEAR_CTE} SELECT query_id, plan_id, similarity FROM n WHERE NOT (similarity >= 0.5 AND margin >= 0.02) ORDER BY similarity, query_id LIMIT 8"


# ---- plans


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as actions: brand, type and a phrase by size make them settings, checks or disruptive steps."""
    names = ["Adjust Display Settings", "Restart Your Device", "Inspect the Charging Port", "Perform a Factory Data Reset", "Contact Customer Support", "Enable Dark Mode", "Read the Note"]
    steps = ["Open Settings and tap on Display.", "Press and hold the Power button.", "Tap on the menu.", "Update the software.", "Turn on Dark mode."]
    p = table(spark, sf_dir, "part")
    name = F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int"))
    step = F.get(F.array(*map(F.lit, steps)), (F.col("p_size") % len(steps)).cast("int"))
    return p.select((F.col("p_partkey") / 10).cast("long").alias("plan_id"), "p_partkey", name.alias("name"), F.array(step).alias("steps"))


_ACTIONS_SQL = """
a AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS plan_id, p_partkey,
  ['Adjust Display Settings', 'Restart Your Device', 'Inspect the Charging Port', 'Perform a Factory Data Reset', 'Contact Customer Support', 'Enable Dark Mode', 'Read the Note'][p_partkey % 7 + 1] AS name,
  ['Open Settings and tap on Display.', 'Press and hold the Power button.', 'Tap on the menu.', 'Update the software.', 'Turn on Dark mode.'][p_size % 5 + 1] AS body FROM part),
h AS (SELECT *, len(regexp_extract_all(body, '(?i)SETTINGS_')) + len(regexp_extract_all(name, '(?i)SETTINGS_')) AS sh, len(regexp_extract_all(body, '(?i)MANUAL_')) AS mh FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)CRITICAL_') THEN 'critical' WHEN regexp_matches(name, '(?i)MANUAL_') THEN 'manual'
  WHEN regexp_matches(body, '(?i)CRITICAL_') AND NOT regexp_matches(name, '(?i)SETTINGS_') THEN 'critical'
  WHEN sh > 0 THEN CASE WHEN mh > sh THEN 'manual' ELSE 'auto' END ELSE 'manual' END AS category FROM h)
""".replace("SETTINGS_", w.SETTINGS).replace("MANUAL_", w.MANUAL).replace("CRITICAL_", w.CRITICAL)


def categorize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("p_partkey", ordering.categorize(F.col("name"), F.col("steps")).alias("category"))


CATEGORIZE_SQL = f"WITH {_ACTIONS_SQL} SELECT p_partkey, category FROM c"


def order_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _actions(spark, sf_dir).withColumn("category", ordering.categorize(F.col("name"), F.col("steps")))
    plans = rows.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "name", "category", "steps"))).alias("actions"))
    ordered = F.transform(ordering.order_actions(F.col("actions")), lambda a: a["p_partkey"].cast("string"))
    return plans.select("plan_id", F.array_join(ordered, ",").alias("ordered"))


_SEVERE = " ".join(f"WHEN regexp_matches({{0}}, '(?i){p}') THEN {4 - k}" for k, p in enumerate(reversed(w.SEVERITY)))
ORDER_SQL = f"""
WITH {_ACTIONS_SQL}, o AS (SELECT *, CASE category WHEN 'auto' THEN 0 WHEN 'manual' THEN 1 ELSE 2 END AS g,
  CASE category WHEN 'manual' THEN CASE WHEN regexp_matches(name, '(?i){w.MANUAL_LAST}') THEN 1 ELSE 0 END
    WHEN 'critical' THEN CASE {_SEVERE.format("name")} {_SEVERE.format("body")} ELSE 2 END ELSE 0 END AS s FROM c)
SELECT plan_id, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY g, s, p_partkey) AS ordered FROM o GROUP BY plan_id
"""


LINK = "struct<deeplink:string,description:string,message:string>"
GROUPS = f"array<struct<steps:array<string>,link:{LINK},check:struct<deeplink:string>>>"


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans, each of which breaks the rules that its number says."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"))
    k = lambda n: F.col("plan_id") % n == 0
    link = F.struct(F.when(k(11), "app://unknown").otherwise("app://known").alias("deeplink"), F.lit("Open it").alias("description"), F.when(k(13), "See www.a.com").otherwise("Go to it").alias("message"))
    group = F.struct(
        F.when(k(17), F.array().cast("array<string>")).otherwise(F.array(F.lit("Tap on it."))).alias("steps"), F.when(~k(5), link).alias("link"), F.lit(None).cast("struct<deeplink:string>").alias("check")
    )
    action = F.struct(
        F.when(k(3), "open The menu").otherwise("Open the Menu").alias("name"), F.when(k(7), "Opens it").otherwise("It will open the menu").alias("description"),
        F.when(k(19), "critical").when(k(23), "manual").otherwise("auto").alias("category"), F.array(group).alias("groups"),
    )
    second = F.struct(F.lit("Wait").alias("name"), F.lit("It will help you wait").alias("description"), F.lit("manual").alias("category"), F.when(k(29), F.array()).otherwise(F.array(F.struct(F.array(F.lit("Wait.")).alias("steps"), F.lit(None).cast(LINK).alias("link"), F.lit(None).cast("struct<deeplink:string>").alias("check")))).cast(GROUPS).alias("groups"))
    return o.select(
        "plan_id", F.when(k(31), "Do it").otherwise("Follow these steps to perform this Menu Configuration").alias("goal"), F.when(k(37), "Menu").when(k(41), "menu Fix").otherwise("Menu fix").alias("title"),
        F.when(k(43), 1.5).otherwise(0.9).alias("score"), F.when(k(47), F.array().cast(f"array<struct<name:string,description:string,category:string,groups:{GROUPS}>>")).otherwise(F.array(action, second)).alias("actions"),
    )


def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.range(1).select(F.lit("app://known").alias("uri"))
    return evaluation.issue_counts(rules.audit(_plans(spark, sf_dir), catalog))


AUDIT_SQL = """
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 47 = 0 AS bare FROM orders), i AS (
  SELECT 'GOAL_FORMAT' AS code, k % 31 = 0 AS bad FROM p UNION ALL SELECT 'TITLE_WORDS', k % 37 = 0 FROM p
  UNION ALL SELECT 'TITLE_CASE', k % 41 = 0 AND k % 37 <> 0 FROM p UNION ALL SELECT 'SCORE_RANGE', k % 43 = 0 FROM p
  UNION ALL SELECT 'NO_ACTIONS', bare FROM p UNION ALL SELECT 'ACTION_NAME_CASE', NOT bare AND k % 3 = 0 FROM p
  UNION ALL SELECT 'DESC_PREFIX', NOT bare AND k % 7 = 0 FROM p UNION ALL SELECT 'DESC_WORDS', NOT bare AND k % 7 = 0 FROM p
  UNION ALL SELECT 'ORDER_CRITICAL_NOT_LAST', NOT bare AND k % 19 = 0 FROM p UNION ALL SELECT 'NO_STEPGROUPS', NOT bare AND k % 29 = 0 FROM p
  UNION ALL SELECT 'EMPTY_STEPS', NOT bare AND k % 17 = 0 FROM p
  UNION ALL SELECT 'MANUAL_HAS_DEEPLINK', NOT bare AND k % 23 = 0 AND k % 19 <> 0 AND k % 5 <> 0 FROM p
  UNION ALL SELECT 'AUTO_NO_DEEPLINK', NOT bare AND k % 23 <> 0 AND k % 19 <> 0 AND k % 5 = 0 FROM p
  UNION ALL SELECT 'DEEPLINK_NOT_IN_CATALOG', NOT bare AND k % 11 = 0 AND k % 5 <> 0 FROM p
  UNION ALL SELECT 'URL_LEAK', NOT bare AND k % 13 = 0 AND k % 5 <> 0 FROM p)
SELECT code, CASE WHEN code = 'AUTO_NO_DEEPLINK' THEN 'warning' ELSE 'error' END AS severity, CAST(count(*) AS BIGINT) AS n FROM i WHERE bad GROUP BY code
"""


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _plans(spark, sf_dir)
    return evaluation.compliance(plans, rules.audit(plans))


COMPLIANCE_SQL = """
SELECT CAST(count(*) AS BIGINT) AS plans, CAST(count(*) FILTER (clean) AS BIGINT) AS clean, round(count(*) FILTER (clean) / greatest(count(*), 1), 3) AS compliance FROM (
  SELECT NOT (k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 OR k % 3 = 0 OR k % 7 = 0 OR k % 19 = 0 OR k % 29 = 0 OR k % 17 = 0
    OR (k % 23 = 0 AND k % 5 <> 0) OR (k % 13 = 0 AND k % 5 <> 0)) AS clean FROM (SELECT o_orderkey AS k FROM orders))
"""


def rule_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a complaint, with an article made of all of its conversation's assistant turns in their order."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    said = F.concat(F.lit("## Try This\n1. Tap on Display. Then turn on Dark mode. "), F.array_join(F.transform(turns, lambda x: x["text"]), "\n"))
    article = c.where("role = 'assistant' AND text IS NOT NULL").groupBy("conv_id").agg(said.alias("content"))
    rows = user.join(article, "conv_id", "left").select(F.col("conv_id").alias("query_id"), "turn", "query", F.lit("Dark mode problem on your phone").alias("title"), "content")
    return extraction.extract(rows).select("query_id", "turn", "fallback", "goal", "plan_title", "relevance", F.size("actions").alias("n_actions"), F.size("dropped_steps").alias("n_dropped"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct part names against each other: some tens of names at any size."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = n.select(F.col("p_name").alias("target")).join(n.select(F.col("p_name").alias("name")), F.col("target") <= F.col("name"))
    a, b = F.col("target"), F.col("name")
    return pairs.select("target", "name", similarity.names(a, b).alias("name_match"), similarity.indel(a, b).alias("indel"), similarity.token_sort(a, b).alias("token_sort"), similarity.partial(a, b).alias("partial"), similarity.sequences(a, b).alias("difflib"))


def action_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _actions(spark, sf_dir)
    return a.select("p_partkey", F.array_join(mapping.targets(F.col("steps"), strict=False), "|").alias("targets"), F.coalesce(mapping.direction(F.array_join("steps", " ")), F.lit("-")).alias("direction"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sixty settings named after the distinct part names, each with an on, an off and a view entry."""
    n = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("key")).distinct()
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(verb).alias("verb")) for kind, verb in (("onURL", "Enable"), ("offURL", "Disable"), ("onClickURL", "View")))))
    n = n.select("key", kinds.alias("k"))
    address = lambda scheme: F.concat(F.lit(scheme), F.translate(F.lower("key"), " ", "_"), F.lit("/"), F.col("k.kind"))
    return n.select(
        F.concat_ws(":", "key", "k.kind").alias("id"), address("app://").alias("deeplink"), F.concat_ws(" ", "k.verb", "key", F.lit("in device settings")).alias("description"),
        F.concat_ws(" ", "k.verb", "key").alias("message"), F.col("k.kind").alias("originalType"), F.lit(None).cast("string").alias("qna_description"),
        F.struct(address("check://").alias("deeplink"), F.col("key").alias("key")).alias("validation"),
    )


def _supplier_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' numbers pick a setting and a direction. Every supplier has one."""
    names = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("key")).where("key IS NOT NULL").distinct()
    numbered = names.withColumn("k", F.row_number().over(Window.orderBy("key")).cast("long") - 1)  # some tens of names at any size
    s = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(names.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))))  # one row
    s = s.select("s_suppkey", F.pmod(F.col("s_suppkey").cast("long"), F.col("n")).alias("k"))
    on = F.when(F.col("s_suppkey") % 2 == 0, "on").otherwise("off")
    return s.join(numbered, "k").select(
        F.concat_ws(":", F.col("s_suppkey").cast("string"), "key").alias("action_id"), F.concat_ws(" ", F.lit("Adjust"), "key").alias("name"), F.lit("auto").alias("category"),
        F.array(F.lit("Open Settings."), F.concat(F.lit("Turn "), on, F.lit(" "), F.col("key"), F.lit("."))).alias("steps"),
    )


def map_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping has to find the setting that each supplier's action was made from."""
    actions = _supplier_actions(spark, sf_dir)
    return mapping.map_actions(actions, retrieval.usable_entries(_catalog(spark, sf_dir))).select("action_id", "kind", "category", "chosen_id", "name_score", F.col("link.deeplink").alias("uri"), F.col("check.value").alias("value"))


def map_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's action on either side of the gate: settings found by their whole and longer names, refused ones (words in
    another order), placeholders, actions by hand, critical ones. Where no direction is stated, the setting counts only."""
    key, m = F.initcap("p_name"), F.col("p_partkey") % 8
    turned = F.concat_ws(" ", F.reverse(F.split(key, " ")))
    step = lambda *said: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in said))
    second = (
        F.when(m == 0, step("Turn on ", key, ".")).when(m == 1, step("Turn off ", key, ".")).when(m == 2, step("Tap on ", key, ".")).when(m == 4, step("Tap the ", turned, " icon."))
        .when(m == 5, step("Ask about ", key, ".")).when(m == 7, step("Turn on ", key, " Level.")).otherwise(step("Turn on ", turned, "."))
    )
    first = F.when(m == 3, "Wake the phone.").when(m == 4, "Open the Quick settings panel.").when(m == 5, "Call the service line.").otherwise("Open Settings.")
    name = F.when(m == 5, step("Contact Support for ", key)).when(m == 6, step("Factory Reset ", turned)).when(m.isin(3, 4), step("Adjust ", turned)).otherwise(step("Adjust ", key))
    category = F.when(m == 5, "manual").when(m == 6, "critical").otherwise("auto")
    actions = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("action_id"), name.alias("name"), category.alias("category"), F.array(first, second).alias("steps"), (m == 2).alias("open_direction"))
    done = mapping.map_actions(actions, retrieval.usable_entries(_catalog(spark, sf_dir)))
    stated = lambda c: F.when(~F.col("open_direction"), c)
    chosen = F.when(F.col("open_direction"), F.split_part("chosen_id", F.lit(":"), F.lit(1))).otherwise(F.col("chosen_id"))
    return done.select("action_id", "kind", "category", chosen.alias("chosen"), "name_score", stated(F.col("link.deeplink")).alias("uri"), stated(F.col("check.value")).alias("value"))


# A longer name scores twice the common letters over the letters of both, " level" being six of them.
MAP_BRANCHES_SQL = """
WITH a AS (
  SELECT p_partkey, p_partkey % 8 AS m, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS key FROM part
), b AS (
  SELECT *, CASE WHEN m IN (0, 7) THEN 'onURL' WHEN m = 1 THEN 'offURL' END AS type, m IN (0, 1, 2, 7) AS found, m IN (4, 6) AS dummy FROM a
)
SELECT CAST(p_partkey AS VARCHAR) AS action_id, CASE WHEN found THEN 'catalog' WHEN dummy THEN 'dummy' ELSE 'none' END AS kind,
  CASE WHEN m = 6 THEN 'critical' WHEN m IN (3, 5) THEN 'manual' ELSE 'auto' END AS category,
  CASE WHEN m = 2 THEN key WHEN found THEN key || ':' || type END AS chosen,
  CASE WHEN m = 7 THEN round(2.0 * length(key) / (2 * length(key) + 6), 3) WHEN found THEN 1.0 ELSE 0.0 END::DOUBLE AS name_score,
  CASE WHEN type IS NOT NULL THEN 'app://' || lower(replace(key, ' ', '_')) || '/' || type WHEN dummy THEN 'voiceassist://dummy_positive' END AS uri,
  CASE type WHEN 'onURL' THEN 'True' WHEN 'offURL' THEN 'False' END AS value
FROM b
"""


def mapping_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's first entry without the name gate, against the entry that each supplier's action was made from."""
    actions = _supplier_actions(spark, sf_dir)
    queries = actions.select(F.col("action_id").alias("query_id"), F.concat_ws(" ", "name", F.array_join("steps", " ")).alias("text"))
    candidates = retrieval.hybrid(queries, retrieval.usable_entries(_catalog(spark, sf_dir))).withColumnRenamed("query_id", "action_id")
    decisions = map_actions(spark, sf_dir).select("action_id", "chosen_id")
    return evaluation.ablation(candidates, decisions)


def catalog_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.catalog_uris(_catalog(spark, sf_dir))


URIS_SQL = """
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS p FROM part), k AS (SELECT unnest(['onURL', 'offURL', 'onClickURL']) AS kind)
SELECT 'app://' || p || '/' || kind AS uri FROM n, k UNION SELECT 'check://' || p || '/' || kind FROM n, k
"""


def link_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    actions = l.select(
        F.when(F.col("l_returnflag") == "N", "auto").otherwise("manual").alias("category"),
        F.when(F.col("l_linenumber") % 3 > 0, F.struct(F.concat(F.lit("s:"), F.col("l_suppkey")).alias("deeplink"))).alias("link"),
    )
    catalog = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.concat(F.lit("s:"), F.col("s_suppkey")).alias("uri"))
    return evaluation.link_coverage(actions, catalog)


COVERAGE_SQL = """
WITH a AS (SELECT l_returnflag = 'N' AS auto, l_linenumber % 3 > 0 AS linked, l_linenumber % 3 > 0 AND s_nationkey < 20 AS known
           FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT CAST(count(*) FILTER (auto) AS BIGINT) AS auto, CAST(count(*) FILTER (auto AND linked) AS BIGINT) AS auto_linked,
  CAST(count(*) FILTER (linked) AS BIGINT) AS links, CAST(count(*) FILTER (known) AS BIGINT) AS valid FROM a)
SELECT *, round(auto_linked / greatest(auto, 1), 3) AS auto_coverage, round(valid / greatest(links, 1), 3) AS validity FROM c
"""


def placeholder_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    link = mapping.placeholder_link(F.concat(F.initcap("p_name"), F.lit(" and the screen")))
    return p.select("p_partkey", link["description"].alias("description"), link["message"].alias("message"))


PLACEHOLDER_SQL = """
SELECT p_partkey, 'Open ' || t || ' screen in Settings' AS description, 'Go to ' || t || ' in Settings' AS message FROM (
  SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS t FROM part)
"""


def cold_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls: their cost and tokens by kind."""
    e = table(spark, sf_dir, "events").withColumns({"i": F.col("event_id") % 3000, "o": F.col("event_id") % 700})
    return e.groupBy("event_type").agg(F.round(F.avg(evaluation.cost(F.col("i"), F.col("o"))), 9).alias("mean_cost"), F.round(F.avg(F.col("i") + F.col("o")), 6).alias("mean_tokens"))


COSTS_SQL = """
SELECT event_type, round(avg(((event_id % 3000) * 0.15::DOUBLE + (event_id % 700) * 0.6::DOUBLE) / 1000000), 9) AS mean_cost,
  round(avg(event_id % 3000 + event_id % 700), 6) AS mean_tokens FROM events GROUP BY event_type
"""

QUERIES = {
    "map_actions": (map_actions, None),
    "map_branches": (map_branches, MAP_BRANCHES_SQL),
    "mapping_ablation": (mapping_ablation, None),
    "catalog_uris": (catalog_uris, URIS_SQL),
    "link_coverage": (link_coverage, COVERAGE_SQL),
    "placeholder_links": (placeholder_links, PLACEHOLDER_SQL),
    "cold_costs": (cold_costs, COSTS_SQL),
    "equi_pair": (equi_pair, EQUI_PAIR_SQL),
    "semi_cached": (semi_cached, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "anti_uncached": (anti_uncached, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "dedupe_first": (dedupe_first, DEDUPE_SQL),
    "last_write_wins": (last_write_wins, "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL"),
    "upsert": (upsert_orders, UPSERT_SQL),
    "merge_actions": (merge_actions, MERGE_SQL),
    "running_critical": (running_critical, RUNNING_SQL),
    "bm25_topk": (bm25_topk, BM25_SQL),
    "dense_topk": (dense_topk, DENSE_SQL),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "tfidf_vectors": (tfidf_vectors, TFIDF_SQL),
    "catalog_filter": (catalog_filter, CATALOG_SQL),
    "exact_cache_lookup": (exact_cache_lookup, EXACT_SQL),
    "cache_semantic_lookup": (cache_semantic_lookup, SEMANTIC_SQL),
    "door_index_lookup": (door_index_lookup, SEMANTIC_SQL),
    "cache_doors": (cache_doors, DOORS_SQL),
    "threshold_sweep": (threshold_sweep, SWEEP_SQL),
    "latency_percentiles": (latency_percentiles, PERCENTILE_SQL),
    "stage_counters": (stage_counters, COUNTERS_SQL),
    "determinism": (determinism, DETERMINISM_SQL),
    "worst_misses": (worst_misses, MISSES_SQL),
    "categorize_rules": (categorize_rules, CATEGORIZE_SQL),
    "order_plan": (order_plan, ORDER_SQL),
    "audit_issues": (audit_issues, AUDIT_SQL),
    "compliance": (compliance, COMPLIANCE_SQL),
    "rule_extract": (rule_extract, None),
    "name_pairs": (name_pairs, None),
    "action_targets": (action_targets, None),
}
