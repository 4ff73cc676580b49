"""Which article belongs to which complaint: equal texts first, else the most similar text of a ratio of 0.9 or more.

A pair of this ratio differs in so few characters that of some more pieces of one text, which don't overlap, one is whole
in the other, moved no further than the rest allows. Only texts that share such a piece meet, by a join on the rarest
pieces, to which the other texts bring only pieces that a Bloom filter of the asked ones has, and only those with enough characters in common, counted in a few bits, are compared one by one. High ratios are
tried first: they leave few differences, so few and long pieces. None that qualifies is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as t
from ..session import settled, spread

LEAST_RATIO = 0.9


def bare(text: Column) -> Column:
    """Lower case, without a number in front, single spaces."""
    unnumbered = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s*\d+\.\s*", "")
    return t.strip(F.regexp_replace(unnumbered, r"(?U)\s+", " "))


#: A text's characters fall into BAGS classes, and of each up to DEEP are counted, a bit for each, in longs of eight classes.
BAGS, DEEP = 32, 8


def bag(text: Column) -> Column:
    """struct(counts array<long>, more): a text's characters by class in unary numbers, and how many went beyond DEEP.

    The bits that two texts' counts have in common, and the lesser of their `more`, are no fewer than their common characters.
    """
    classes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(BAGS)))
    sizes = lambda codes: F.transform(F.sequence(F.lit(0), F.lit(BAGS - 1)), lambda k: F.size(F.filter(codes, lambda x: x == k)))
    unary = lambda n: F.element_at(F.array(*(F.lit((1 << k) - 1).cast("long") for k in range(DEEP + 1))), F.least(n, F.lit(DEEP)) + 1)

    def packed(n: Column) -> Column:
        words = [F.lit(0).cast("long")] * (BAGS // DEEP)
        for k in range(BAGS):
            at = k // DEEP
            # The highest place of a long is its sign, which shifting reaches without overflow.
            words[at] = words[at].bitwiseOR(F.shiftleft(unary(F.element_at(n, k + 1)), DEEP * (k % DEEP)))
        more = F.aggregate(n, F.lit(0), lambda s, x: s + F.greatest(x - DEEP, F.lit(0)))
        return F.struct(F.array(*words).alias("counts"), more.alias("more"))

    # The cast names the fields: names within lambdas are lost when the column is written.
    return t.let(classes, lambda codes: t.let(sizes(codes), packed)).cast("struct<counts:array<bigint>,more:int>")


def _common_at_most(a: Column) -> Column:
    """Of the bag a and the one in the columns of `_in_columns`."""
    bits = [F.bit_count(a["counts"][k].bitwiseAND(F.col(f"counts{k}"))) for k in range(BAGS // DEEP)]
    return sum(bits, F.least(a["more"], F.col("more")))


def _in_columns(a: Column) -> list[Column]:
    return [*(a["counts"][k].alias(f"counts{k}") for k in range(BAGS // DEEP)), a["more"].alias("more")]


def _apart(length_a: Column, length_b: Column, least: float) -> Column:
    """Of two texts of these lengths and the least ratio, at most so many characters have no partner."""
    return F.floor((1 - least) * (length_a + length_b) + 1e-9)


#: Lengths of grams that a text may be cut into, and how many of the commonest trigrams serve to tell rare grams.
GRAMS, COMMONEST = (1, 2, 3, 4, 5, 6, 8), 50_000
#: Rows of grams that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 500_000


def cuts(text: str, least: float, letters: frozenset[str], often: dict[str, int], after: dict[str, int]) -> list[tuple[int, int, int, int]]:
    """(place, length, strange before, strange after) of grams, one of which at least is whole in any text of the least ratio.

    Strange characters are in no held text, so they have no partner. If n characters have h strange ones, ratio R leaves
    (2(1-R)n - (2-R)h) / R others, of both texts, without one at most. Each spoils one of the grams, which don't overlap
    and have no strange character: so one more is taken, of the length that makes the rarest. None: nothing reaches R.
    `often` (trigrams) and `after` (pairs that begin them) only say which grams are rare: any choice finds all pairs.
    """
    strange = [0]
    for c in text:
        strange.append(strange[-1] + (c not in letters))
    n, h = len(text), strange[-1]
    need = math.floor((2 * (1 - least) * n - (2 - least) * h) / least + 1e-9) + 1
    if need < 1:
        return []

    first = [often.get(text[k : k + 3], 1) for k in range(n - 2)]
    more = [times / after.get(text[k : k + 2], 1) for k, times in enumerate(first)]

    def met(at: int, q: int) -> float:
        if q < 3:
            return 1e12 / 30**q
        times = float(first[at])
        for k in range(at + 1, at + q - 2):
            times *= more[k]
        return times

    best = None
    for q in GRAMS:
        places, at = [], 0
        while at + q <= n:
            whole = strange[at + q] == strange[at]
            if whole:
                places.append(at)
            at += q if whole else 1
        if len(places) >= need:
            rarest = sorted((met(at, q), at) for at in places)[:need]
            best = min(best or (math.inf,), (sum(r[0] for r in rarest), q, [r[1] for r in rarest]))
    return [(at, best[1], strange[at], h - strange[at]) for at in best[2]] if best else []


def _grams(q: int) -> Column:
    """All grams of that length of the column held, in order."""
    return F.transform(F.sequence(F.lit(1), F.length("held") - (q - 1)), lambda i: F.substring(F.col("held"), i, F.lit(q)))


def _cutter(held: DataFrame) -> Callable[[float], Column]:
    """A function of the least ratio: the cuts of the column asked."""
    letters = frozenset(r[0] for r in held.select(F.explode(F.array_distinct(F.split("held", "")))).distinct().collect())
    often = held.where(F.length("held") > 2).select(F.explode(_grams(3)).alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(COMMONEST).collect()
    after: dict[str, int] = {}
    for g, times in (often := {r[0]: r[1] for r in often}).items():
        after[g[:2]] = after.get(g[:2], 0) + times

    def cutter(at_least: float) -> Column:
        @F.pandas_udf("array<struct<at int, q int, before int, behind int, key long>>")
        def cut(texts: pd.Series) -> pd.Series:
            made = lambda t: [(at, q, *strange, int(gram_keys(codes_of([t[at : at + q]]), q)[0])) for at, q, *strange in cuts(t, at_least, letters, often, after)]
            return pd.Series([made(t) for t in texts], dtype=object)

        # Named nondeterministic, so that it is evaluated once, and not for the filter on it again.
        return cut.asNondeterministic()(F.col("asked"))

    return cutter


def codes_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_keys(codes: np.ndarray, q: int) -> np.ndarray:
    """A number of 64 bits for each q characters in a row. Equal grams have equal numbers; others seldom do, and only meet in vain."""
    n = max(0, len(codes) - q + 1)
    key = np.full(n, q, np.uint64)
    for k in range(q):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


#: Bits of `asked_bits`: a power of 2, SLOTS_A_KEY for a key, at most MOST_SLOTS (32 MB).
SLOTS_A_KEY, LEAST_SLOTS, MOST_SLOTS = 32, 1 << 12, 1 << 28


def asked_bits(few: DataFrame, keys: int) -> np.ndarray:
    """A Bloom filter of the column key, two bits for each: where one of them is missing, no text asks for a gram of that key."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_A_KEY * keys).bit_length()))
    places = F.array(F.col("key").bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(slots - 1)))
    word = F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")
    found = few.select(F.explode(places).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(word).toArrow()
    bits = np.zeros(slots // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1


def asked_places(held: DataFrame, few: DataFrame, keys: int) -> DataFrame:
    """key, held_at, held_id, of_held and the bag's columns: the places of held texts whose gram some text may ask for.

    Only these are joined and perhaps shuffled, without their text: a few bytes, and none for a gram that nobody asks for.
    """
    lengths = sorted(r.q for r in few.select("q").distinct().collect())
    shared = held.sparkSession.sparkContext.broadcast(asked_bits(few, keys))
    names = ["held_id", "of_held", *(f"counts{k}" for k in range(BAGS // DEEP)), "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            size = batch.column("of_held").to_numpy()
            codes, own = codes_of(batch.column("held").to_pylist()), np.repeat(np.arange(len(size)), size)
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            left = size[own] - place
            for q in lengths:
                key = gram_keys(codes, q)
                met = np.flatnonzero((left[: len(key)] >= q) & _has(bits, key.view(np.uint64)))
                met = met[_has(bits, key[met].view(np.uint64) >> np.uint64(32))]
                rows = pa.array(own[met])
                columns = [pa.array(key[met]), pa.array(place[met].astype(np.int32)), *(batch.column(name).take(rows) for name in names)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "held_at", *names])

    given = held.select("held", F.xxhash64("held").alias("held_id"), F.length("held").alias("of_held"), *_in_columns(F.col("bag")))
    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(["key long", "held_at int", *(f"{name} {kinds[name]}" for name in names)]))


def candidates(rest: DataFrame, held: DataFrame, least: float = LEAST_RATIO, cutter: Callable[[float], Column] | None = None) -> DataFrame:
    """asked, held: pairs of texts that share a gram of `cuts`, at near enough places, and enough characters.

    A gram that is kept moves by the characters without a partner before it: to the right by those of one text, to the
    left by the other's. rest (asked) and held (held) have each text once. No pair of the least ratio is missing.
    """
    rest, held = (df if "bag" in df.columns else settled(df.withColumn("bag", bag(F.col(df.columns[0]))), "bags") for df in (rest, held))
    each = spread(rest).withColumn("cuts", (cutter or _cutter(held))(least)).where(F.size("cuts") > 0)
    each = each.select(F.xxhash64("asked").alias("id"), F.length("asked").alias("of_asked"), "bag", F.explode("cuts").alias("c")).select("*", "c.*")
    few = settled(each.drop("c"), "asked-grams")
    n = few.count()
    if not n:
        return rest.crossJoin(held.select("held")).select("asked", "held").where(F.lit(False))
    keys = F.broadcast(few) if n <= BROADCAST_GRAMS else few
    apart, longer = _apart(F.col("of_asked"), F.col("of_held"), least), F.col("of_asked") - F.col("of_held")
    right = F.col("at") - F.col("held_at")
    left_lost = F.greatest(F.abs(right), 2 * F.col("before") - right)
    right_lost = F.greatest(F.abs(longer - right), 2 * F.col("behind") - (longer - right))
    # Of all characters at most `apart` have no partner, so the others are pairs.
    enough = 2 * _common_at_most(F.col("bag")) >= F.col("of_asked") + F.col("of_held") - apart
    near = asked_places(held, few, n).join(keys, "key").where((left_lost + right_lost <= apart) & enough)
    found = settled(near.select("id", "held_id").distinct(), "near-ids")
    texts = found.join(held.select(F.xxhash64("held").alias("held_id"), "held"), "held_id")
    return texts.join(rest.select(F.xxhash64("asked").alias("id"), "asked"), "id").select("asked", "held")


#: Least ratios that are tried in turn: a text that has found a partner of one needs no wider search.
TURNS = (0.98, 0.96, 0.94, 0.92, LEAST_RATIO)


def paired(complaints: DataFrame, articles: DataFrame) -> DataFrame:
    """complaints (complaint_id, query) with title and content of their article, or null: what extraction takes.

    articles: original_query, title, content. Of equal texts and equal ratios the least title, then content, wins.
    """
    first = F.min(F.struct("title", "content")).alias("article")
    held = settled(articles.select(bare(F.col("original_query")).alias("held"), "title", "content").groupBy("held").agg(first), "held-articles")
    asked = complaints.withColumn("asked", bare(F.col("query")))
    texts = asked.select("asked").distinct()
    exact = texts.join(held, F.col("asked") == F.col("held")).select("asked", "article")
    rest = settled(texts.join(exact, "asked", "left_anti"), "unpaired")
    cutter, turns = _cutter(held), []
    rest, bags = settled(rest.withColumn("bag", bag(F.col("asked"))), "asked-bags"), settled(held.select("held", bag(F.col("held")).alias("bag")), "held-bags")
    for least in TURNS:
        pairs = settled(candidates(rest, bags, least, cutter), "pair-candidates")
        alike = pairs.withColumn("ratio", similarity.sequences(F.col("asked"), F.col("held"))).where(F.col("ratio") >= least)
        turns.append(settled(alike, "alike-texts"))
        rest = rest.join(turns[-1].select("asked").distinct(), "asked", "left_anti")
    scored = reduce(DataFrame.unionByName, turns)
    best = scored.join(held, "held").groupBy("asked").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "article")).alias("b")).select("asked", F.col("b.article").alias("article"))
    found = exact.unionByName(best)
    return asked.join(found, "asked", "left").select(*complaints.columns, F.col("article.title").alias("title"), F.col("article.content").alias("content"))
