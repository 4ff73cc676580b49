"""Inverted indexes in blocks of posting lists, pruned against each query's running k-th score.

A corpus (entry_id, text) becomes blocks of up to BLOCK_ENTRIES entries or BLOCK_TOKENS tokens, partition by partition,
without a shuffle. A block holds its terms' posting lists, ordered by impact, and the greatest impact of each term: of
BM25 what a term's count and the entry's length give (`bm25_index`), of sparse vectors the weight (`vector_index`). A task
that scores queries against its blocks keeps the k best entries of each query:

* a block whose terms' greatest impacts add up to less than a query's k-th score is passed over for that query;
* terms are met by falling greatest impact, and an entry that no earlier term has is only taken up if its impact in the
  term at hand, and all later terms' greatest ones, reach the k-th score: a beginning of the list, as lists are ordered.

So only k rows a query and task are shuffled, whatever the number of postings. Queries come in passes of TERMS_A_PASS
terms, each of which reads the blocks once. Ties go to the smaller entry_id, after scores are rounded. entry_id names one
entry. An index is a few tables and can be kept by the digest of its texts: sources/artefacts.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import wordlists as w
from ..session import settled, spread

BLOCK_ENTRIES, BLOCK_TOKENS = 2048, 1_000_000
#: Terms of queries that the driver holds and sends to tasks at once.
TERMS_A_PASS = 200_000
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class Index(NamedTuple):
    """blocks: BLOCK. terms: term, idf of the corpus's terms."""

    blocks: DataFrame
    terms: DataFrame


#: of: places in entries, and impacts, by term and falling; sizes: how many a term has; most: the first of them.
BLOCK = "entries array<{}>, terms array<string>, sizes array<int>, most array<double>, of array<int>, impacts array<double>"
NAMES = ["entries", "terms", "sizes", "most", "of", "impacts"]


def _ordered(entries: pa.Array, terms: pa.Array, sizes: np.ndarray, of: np.ndarray, impact: np.ndarray) -> pa.RecordBatch:
    """A row of BLOCK from lists by term in any order."""
    order = np.lexsort((of, -impact, np.repeat(np.arange(len(sizes)), sizes)))
    impact = impact[order]
    most = impact[np.cumsum(sizes) - sizes] if len(impact) else impact
    return pa.RecordBatch.from_arrays(list(map(_one, [entries, terms, sizes.astype(np.int32), most, of[order].astype(np.int32), impact])), NAMES)


def _one(values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of the rows of one block after another. Column 0: entry_id, column 1: lists of what counts as tokens."""
    held, entries, n_tokens = [], 0, 0
    for batch in batches:
        ends = np.append(0, np.cumsum(np.diff(batch.column(1).offsets.to_numpy())))
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS - n_tokens, side="right")) - 1 - at
            n = max(0 if held else 1, min(fit, BLOCK_ENTRIES - entries, batch.num_rows - at))
            if n:
                held.append(batch.slice(at, n))
                entries, n_tokens, at = entries + n, n_tokens + int(ends[at + n] - ends[at]), at + n
            if not n or entries == BLOCK_ENTRIES:
                yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(batch.num_columns)]
                held, entries, n_tokens = [], 0, 0
    if held:
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns)]


def counted(corpus: DataFrame) -> DataFrame:
    """A row for each block: entries, lengths, terms, sizes (entries with the term), of and tf (by term: entry's place, count)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens in _in_blocks(batches):
            lengths = np.diff(tokens.offsets.to_numpy())
            words = tokens.flatten().dictionary_encode()
            which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys, tf = np.unique(which * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
            sizes = np.bincount(keys // len(ids), minlength=len(words.dictionary))
            columns = [ids, lengths.astype(np.int32), words.dictionary, sizes.astype(np.int32), (keys % len(ids)).astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(_one, columns)), ["entries", "lengths", "terms", "sizes", "of", "tf"])

    tokens = spread(corpus.select("entry_id", "text")).select("entry_id", t.tokenize(F.col("text")).alias("tokens"))
    kind = dict(corpus.dtypes)["entry_id"]
    return tokens.mapInArrow(build, f"entries array<{kind}>, lengths array<int>, terms array<string>, sizes array<int>, of array<int>, tf array<int>")


def impacts(blocks: DataFrame, mean_length: float) -> DataFrame:
    """BLOCK of BM25, from `counted` blocks."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                entries, lengths, terms, sizes, of, tf = (batch.column(k)[row].values for k in range(6))
                of, tf = of.to_numpy(), tf.to_numpy().astype(float)
                norm = w.BM25_K1 * (1 - w.BM25_B + w.BM25_B * lengths.to_numpy()[of] / mean_length)
                yield _ordered(entries, terms, sizes.to_numpy(), of, tf * (w.BM25_K1 + 1) / (tf + norm))

    return blocks.mapInArrow(weigh, BLOCK.format(dict(blocks.dtypes)["entries"][6:-1]))


def bm25_index(corpus: DataFrame) -> Index:
    """The index of a corpus. It is tokenised once; the blocks' counts lie in the shared folder."""
    blocks = settled(counted(corpus), "bm25-counts", large_rows=True)
    sums = blocks.agg(F.sum(F.size("entries")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens")).first()
    docs, mean_length = sums.docs or 0, (sums.tokens or 0) / (sums.docs or 1) or 1.0
    counts = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("e")).groupBy(F.col("e.terms").alias("term")).agg(F.sum("e.sizes").alias("df"))
    raw = settled(counts.select("term", (F.log(F.lit(docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "bm25-raw")
    floor = raw.agg(F.coalesce(F.lit(w.BM25_EPSILON) * F.avg("raw"), F.lit(0.0)).alias("floor")).first().floor
    terms = raw.select("term", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))
    return Index(impacts(blocks, mean_length), terms)


def vector_index(vectors: DataFrame) -> DataFrame:
    """BLOCK of sparse vectors (entry_id, gram, weight)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, grams, weights in _in_blocks(batches):
            words = grams.flatten().dictionary_encode()
            which, of = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), np.diff(grams.offsets.to_numpy()))
            order = np.argsort(which, kind="stable")
            sizes = np.bincount(which, minlength=len(words.dictionary))
            yield _ordered(ids, words.dictionary, sizes, of[order], weights.flatten().to_numpy(zero_copy_only=False)[order])

    both = F.collect_list(F.struct("gram", "weight"))
    rows = vectors.groupBy("entry_id").agg(both.alias("v")).select("entry_id", F.col("v.gram").alias("grams"), F.col("v.weight").alias("weights"))
    return rows.mapInArrow(build, BLOCK.format(dict(vectors.dtypes)["entry_id"]))


def asked_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term, weight: the idf of a query's terms that the corpus has, times how often the query has them."""
    own = queries.select("query_id", F.explode(t.tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    return own.join(terms, "term").select("query_id", "term", (F.col("n") * F.col("idf")).alias("weight"))


class Block:
    """A block's lists, by term."""

    def __init__(self, entries: pa.Array, terms: pa.Array, sizes: np.ndarray, most: np.ndarray, of: np.ndarray, impact: np.ndarray):
        self.entries, self.most, self.of, self.impact = entries, most, of, impact
        self.ends = np.append(0, np.cumsum(sizes))
        self.row = {term: k for k, term in enumerate(terms.to_pylist())}

    def best(self, asked: list[tuple[str, float]], held: list[tuple], k: int, digits: int) -> list[tuple] | None:
        """held (rounded score negated, entry, score; up to k of them, in order) with the block's entries; None: passed over.

        asked: a query's terms with their weights.
        """
        lists = sorted(((max(weight * self.most[r], 0.0), weight, r) for term, weight in asked if (r := self.row.get(term)) is not None), reverse=True)
        least = -held[-1][0] - 2 * 10.0**-digits if len(held) == k else -np.inf
        room = sum(x for x, _, _ in lists)
        if not lists or room < least:
            return None
        score, taken = np.zeros(len(self.entries)), np.zeros(len(self.entries), bool)
        for most, weight, r in lists:
            of, gain = self.of[self.ends[r] : self.ends[r + 1]], weight * self.impact[self.ends[r] : self.ends[r + 1]]
            room -= most
            upto = len(of) if room >= least else int(np.searchsorted(-gain, room - least, side="right")) if weight > 0 else 0
            score[of] += gain
            taken[of[:upto]] = True
        found = np.flatnonzero(taken)
        rounded = np.floor(score[found] * 10.0**digits + 0.5) / 10.0**digits
        if len(found) > k:  # all that may be among the k best: ties with the k-th are told apart by their ids
            reach = np.partition(rounded, len(found) - k)[len(found) - k]
            found, rounded = found[rounded >= reach], rounded[rounded >= reach]
        ids = self.entries.take(pa.array(found)).to_pylist()
        return sorted(held + list(zip((-rounded).tolist(), ids, score[found].tolist(), strict=True)))[:k]


def top_k(asked: DataFrame, blocks: DataFrame, k: int, digits: int, name: str) -> DataFrame:
    """query_id, entry_id and the score (called name) of the k best entries of each query and task, the k best of all among
    them. asked: query_id, term, weight. Only entries that share a term with the query have a score."""
    asked = settled(asked, "asked-terms")
    passes = max(1, -(-asked.count() // TERMS_A_PASS))
    kinds = dict(asked.dtypes)["query_id"], dict(blocks.dtypes)["entries"][6:-1]

    def one(number: int) -> DataFrame:
        by_query: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).collect():
            by_query.setdefault(r.query_id, []).append((r.term, r.weight))
        shared = asked.sparkSession.sparkContext.broadcast(by_query)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict = {query_id: [] for query_id in shared.value}
            for batch in batches:
                for row in range(batch.num_rows):
                    entries, terms, *rest = (batch.column(c)[row].values for c in range(6))
                    block = Block(entries, terms, *(x.to_numpy() for x in rest))
                    for query_id, own in shared.value.items():
                        if (now := block.best(own, best[query_id], k, digits)) is not None:
                            best[query_id] = now
            rows = [(query_id, entry_id, score) for query_id, own in best.items() for _, entry_id, score in own]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (*(ARROW[x] for x in kinds), pa.float64()), strict=True)], ["query_id", "entry_id", name])

        return blocks.mapInArrow(run, f"query_id {kinds[0]}, entry_id {kinds[1]}, {name} double")

    return settled(reduce(DataFrame.unionByName, map(one, range(passes))), "best-by-task")


def postings(blocks: DataFrame) -> DataFrame:
    """term, entry_id, impact: the lists' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                entries, terms, sizes, _, of, impact = (batch.column(k)[row].values for k in range(6))
                rows = pa.array(np.repeat(np.arange(len(terms)), sizes.to_numpy()))
                yield pa.RecordBatch.from_arrays([terms.take(rows), entries.take(of), impact], ["term", "entry_id", "impact"])

    return blocks.mapInArrow(run, f"term string, entry_id {dict(blocks.dtypes)['entries'][6:-1]}, impact double")


def scores(asked: DataFrame, blocks: DataFrame, name: str, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, entry_id, score: of the pairs (query_id, entry_id) that share a term, or of all that do."""
    wanted = asked if pairs is None else asked.join(pairs.select("query_id", "entry_id"), "query_id")
    met = postings(blocks).join(wanted, "term" if pairs is None else ["term", "entry_id"])
    return met.groupBy("query_id", "entry_id").agg(F.sum(F.col("weight") * F.col("impact")).alias(name))
