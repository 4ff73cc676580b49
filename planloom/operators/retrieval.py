"""Hybrid retrieval: BM25 over postings, vectors, and reciprocal rank fusion.

A corpus is a DataFrame (entry_id, text); queries are (query_id, text). Ties go to the smaller entry_id at every sort.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import wordlists as w
from ..functions.vectors import nearest
from ..session import settled, spread
from ..sources.artefacts import Artefacts, digest_of
from . import inverted


def usable_entries(catalog: DataFrame) -> DataFrame:
    """Entries of a type that a plan can open, and that aren't about other appliances than phones.

    catalog: id, deeplink, description, message, originalType, qna_description, validation(deeplink, key).
    """
    said = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("message", F.lit("")))
    entries = catalog.where(F.col("originalType").isin(*w.USABLE_TYPES) & ~said.rlike(f"(?iU){w.NOT_PHONE}")).select(
        F.col("id").alias("entry_id"),
        "deeplink",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.col("originalType").alias("original_type"),
        F.coalesce("qna_description", F.lit("")).alias("qna"),
        F.coalesce("validation.key", F.lit("")).alias("key"),
        F.col("validation.deeplink").alias("validation_link"),
    )
    return entries.withColumn("names", entry_names(F.col("key"), F.col("message"))).withColumn(
        "text", entry_text(F.col("key"), F.col("message"), F.col("description"), F.col("qna"))
    )


def entry_names(key: Column, message: Column) -> Column:
    raw = F.when(key != "", key).otherwise(t.strip(F.regexp_replace(message, f"(?iU){w.VERB_PREFIX}", "")))
    bare = t.strip(F.regexp_replace(raw, r"(?U)\s*\([^)]*\)", ""))
    return t.first_of_each(F.filter(F.array(raw, bare), lambda x: x != ""))


def entry_text(key: Column, message: Column, description: Column, qna: Column) -> Column:
    return F.concat(key, F.lit(". "), message, F.lit(". "), F.regexp_replace(description, f"(?iU){w.BOILERPLATE}", ""), F.lit(". "), qna)


def postings(corpus: DataFrame) -> DataFrame:
    """term, entry_id, tf, length: the inverted index."""
    tokens = corpus.select("entry_id", t.tokenize(F.col("text")).alias("tokens"))
    return (
        tokens.select("entry_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        .groupBy("term", "entry_id", "length")
        .agg(F.count("*").alias("tf"))
    )


def bm25_weights(corpus: DataFrame) -> DataFrame:
    """term, entry_id, weight: what one occurrence of a term in a query adds to an entry's score."""
    index = postings(corpus)
    stats = corpus.select(F.size(t.tokenize(F.col("text"))).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean_length"))
    terms = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row of totals
    terms = terms.withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = terms.agg((F.lit(w.BM25_EPSILON) * F.avg("raw")).alias("floor"))
    terms = terms.crossJoin(F.broadcast(floor)).withColumn("idf", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")))
    norm = w.BM25_K1 * (1 - w.BM25_B + w.BM25_B * F.col("length") / F.col("mean_length"))
    return index.join(terms, "term").select("term", "entry_id", (F.col("idf") * F.col("tf") * (w.BM25_K1 + 1) / (F.col("tf") + norm)).alias("weight"))


def bm25_top(queries: DataFrame, index: inverted.Index, k: int, digits: int = 6) -> DataFrame:
    """query_id, entry_id, bm25, rank (from 1) of the k best entries that share a term with the query, by rounded scores."""
    lists = inverted.top_k(inverted.asked_terms(queries, index.terms), index.blocks, k, digits, "bm25")
    return ranked(lists, "bm25", k, digits)


def bm25_scores(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, entry_id, bm25 for entries that share a term with the query; repeated query terms count again."""
    terms = queries.select("query_id", F.explode(t.tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return terms.join(weights, "term").groupBy("query_id", "entry_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("bm25"))


def ranked(scores: DataFrame, score: str, k: int, digits: int | None = None) -> DataFrame:
    """The k best entries of each query with their rank from 1. digits: rounds first, where sums may differ in the last bits."""
    if digits is not None:
        scores = scores.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "entry_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_candidates(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, entry_id, dense: the k nearest entries of each query by vec, and more; `ranked` takes the k."""
    return nearest(queries, corpus, k, digits)


def grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within words padded with a space on both sides; a shorter word is one gram."""
    padded = F.transform(F.split(t.strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")), " "), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def of_size(word: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))
        whole = F.lit(n == least) | (F.length(word) == n)
        return F.when(F.length(word) > n, every).otherwise(F.when(whole, F.array(word)).otherwise(F.array().cast("array<string>")))

    def of_word(word: Column) -> Column:
        return F.flatten(F.array(*(of_size(word, n) for n in range(least, most + 1))))

    return F.flatten(F.transform(F.filter(padded, lambda x: x != "  "), of_word))


def tfidf_fit(corpus: DataFrame) -> DataFrame:
    """gram, idf = ln((1 + N) / (1 + df)) + 1. Equal texts are cut up once."""
    texts = corpus.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("rows"))
    n = corpus.agg(F.count("*").alias("n"))
    df = texts.select("rows", F.explode(F.array_distinct(grams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.sum("rows").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


#: Grams of a model that are broadcast; a larger model is joined by a shuffle.
MODEL_GRAMS = 300_000


def tfidf_vectors(texts: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key, gram, weight: sparse vectors of length 1; grams that the model lacks are left out."""
    counts = texts.select(key, F.explode(grams(F.col("text"))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    # A frequent gram's rows are not brought together for its idf unless there are too many grams to send to all tasks.
    held = F.broadcast(model) if model.count() <= MODEL_GRAMS else model
    raw = counts.join(held, "gram").select(key, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "gram", (F.col("raw") / length).alias("weight"))


def tfidf_arrays(texts: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key, vector (array of gram and weight): the rows of `tfidf_vectors` by text, where equal texts are weighed once."""
    asked = texts.select(key, F.coalesce("text", F.lit("")).alias("text"))
    different = spread(settled(asked.select("text").distinct().withColumn("text_id", F.monotonically_increasing_id()), "tfidf-texts"))
    vectors = tfidf_vectors(different, "text_id", model).groupBy("text_id").agg(F.collect_list(F.struct("gram", "weight")).alias("vector"))
    vectors = settled(different.join(vectors, "text_id").select("text", "vector"), "tfidf-arrays")
    return asked.join(vectors, "text").select(key, "vector")


def sparse_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, entry_id, dense: cosines of sparse vectors that share a gram."""
    a, b = queries.withColumnRenamed("weight", "a"), corpus.withColumnRenamed("weight", "b")
    return a.join(b, "gram").groupBy("query_id", "entry_id").agg(F.sum(F.col("a") * F.col("b")).alias("dense"))


def fuse(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id, entry_id, fused of two ranked lists (ranks from 1)."""
    part = lambda df: df.select("query_id", "entry_id", (1.0 / (w.RRF_K + F.col("rank"))).alias("part"))
    return part(first).unionByName(part(second)).groupBy("query_id", "entry_id").agg(F.sum("part").alias("fused"))


def numbered(ids: DataFrame) -> DataFrame:
    """entry_id, place (from 1, by entry_id): sorted by ranges, and each range counted on from the rows before it."""
    rows = settled(ids.select("entry_id").orderBy("entry_id").withColumn("at", F.monotonically_increasing_id()), "sorted-ids")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    return rows.withColumn("part", part).join(starts, "part").select("entry_id", (F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1).alias("place"))


def ranked_with_zeros(asked: DataFrame, blocks: DataFrame, name: str, queries: DataFrame, entries: DataFrame, k: int, digits: int) -> DataFrame:
    """As `ranked` over all pairs of queries and entries, where those without a common term have 0; few of these are made.

    Queries with k scores above 0 among their lists need no others. Of the rest all scores are worked out, as some may be
    below 0; k entries without a score are among the first k + (its scores) by entry_id.
    """
    asked = settled(asked, "asked")
    lists = inverted.top_k(asked, blocks, k, digits, name)
    rounded = F.round(name, digits)
    enough = settled(lists.groupBy("query_id").agg(F.count_if(rounded > 0).alias("above")).where(F.col("above") >= k).select("query_id"), "enough")
    full = lists.join(enough, "query_id", "left_semi").select("query_id", "entry_id", rounded.alias(name))
    rest = queries.select("query_id").join(enough, "query_id", "left_anti")
    few = inverted.scores(asked.join(rest, "query_id", "left_semi"), blocks, name).select("query_id", "entry_id", rounded.alias(name))
    few = settled(few, "few-scores")
    short = rest.join(few.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").na.fill(0, ["n"])
    zeros = short.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + k)).alias("place")).join(numbered(entries), "place")
    every = few.unionByName(zeros.select("query_id", "entry_id", F.lit(0.0).alias(name))).groupBy("query_id", "entry_id").agg(F.sum(name).alias(name))
    return ranked(full.unionByName(every), name, k)


class HybridIndex(NamedTuple):
    """What `hybrid` needs of the entries: the lexical index, the model of grams, and the vectors' index."""

    lexical: inverted.Index
    model: DataFrame
    vectors: DataFrame


def hybrid_index(entries: DataFrame, artefacts: Artefacts | None = None) -> HybridIndex:
    """Of entries (entry_id, text). With artefacts it is built once for the same texts, and read from then on."""

    def build() -> dict[str, DataFrame]:
        lexical, model = inverted.bm25_index(entries), settled(tfidf_fit(entries), "tfidf-model")
        vectors = inverted.vector_index(tfidf_vectors(entries, "entry_id", model))
        return {"blocks": lexical.blocks, "terms": lexical.terms, "model": model, "vectors": vectors}

    if artefacts is None:
        found = {name: settled(df, f"hybrid-{name}", name in ("blocks", "vectors")) for name, df in build().items()}
    else:
        found = artefacts.get("hybrid", digest_of(entries, "entry_id", "text", made_by="bm25+tfidf:3-5"), build)
    return HybridIndex(inverted.Index(found["blocks"], found["terms"]), found["model"], found["vectors"])


def hybrid(queries: DataFrame, entries: DataFrame, k: int = w.RETRIEVAL_TOP_K, artefacts: Artefacts | None = None) -> DataFrame:
    """query_id, entry_id, fused, dense, bm25, rank (from 0) of the k best entries by both lists.

    Lists are cut at 4k; an entry without a common term has bm25 0 and still takes a rank, as the lists are full. Only
    pairs that share a term or a gram can be scored, and of these only what may reach a list. Equal texts are searched once.
    """
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = settled(asked.select("text").distinct().withColumn("text_id", F.monotonically_increasing_id()), "hybrid-texts")
    found = settled(_hybrid(texts.withColumnRenamed("text_id", "query_id"), entries, k, artefacts).withColumnRenamed("query_id", "text_id"), "hybrid-found")
    return asked.join(texts, "text").join(found, "text_id").drop("text", "text_id")


def _hybrid(queries: DataFrame, entries: DataFrame, k: int, artefacts: Artefacts | None) -> DataFrame:
    """`hybrid` of queries with numbers of their own, each text once."""
    index = hybrid_index(entries, artefacts)
    terms = settled(inverted.asked_terms(queries, index.lexical.terms), "asked-terms")
    grams_ = settled(tfidf_vectors(queries, "query_id", index.model).select("query_id", F.col("gram").alias("term"), "weight"), "asked-grams")
    by_terms = ranked_with_zeros(terms, index.lexical.blocks, "bm25", queries, entries, 4 * k, 9)
    by_vectors = ranked_with_zeros(grams_, index.vectors, "dense", queries, entries, 4 * k, 9)
    best = settled(ranked(fuse(by_terms, by_vectors), "fused", k, 12), "hybrid-best")
    lexical = inverted.scores(terms, index.lexical.blocks, "bm25", best)
    dense = inverted.scores(grams_, index.vectors, "dense", best)
    both = best.join(lexical, ["query_id", "entry_id"], "left").join(dense, ["query_id", "entry_id"], "left").na.fill(0.0, ["bm25", "dense"])
    return both.withColumn("rank", F.col("rank") - 1)
