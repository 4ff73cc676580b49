"""Periodic run detection (13) by Crochemore's partition refinement, over the words of each document.

Positions of a text that begin equal factors of one length form a class. Refining the classes from one length to the
next needs only the classes that the last step cut off: a position leaves its class if the position after it is in one
of them. Of the parts of a cut class the largest is never used so (the smaller-half strategy), which bounds all moves by
n log n. Members of a class are chained in order of their places. While a position and its next neighbour stand `gap`
apart in the classes of that very length, a square of that period begins there; squares of one period that begin at
consecutive words are one run. A gap is looked at when it changes, so no length is searched for squares.

A block of texts is refined at once, each step in NumPy arrays over all of its texts; words of different texts never
share a class, and a separator of its own ends each text. A text is refined up to its longest possible period only, a
LEAST_EXPONENT-th of its words. Nothing is shuffled, and a task holds one block (or one longer text, whatever its length).

Words are runs of characters other than white space. A run is a stretch with smallest period q (words q apart are
identical) of at least max(LEAST_WORDS, LEAST_EXPONENT * q) words which no neighbouring word extends keeping q. Runs of
several periods may overlap; a word is dropped if any run contains it after that run's first q words. Null and empty texts
have no words and no runs. Repeated rows are searched each. Ties between runs don't matter here, as all are returned, by
start, then period. An empty table gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_parts, table

ORACLE_SQL = None  # every period against every place: too slow in SQL on whole tables; the tests have a brute-force version

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Bytes of text that are refined together.
BLOCK_BYTES = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Classes:
    """The classes of equal factors of one length (`level`), of all texts of a block.

    classes lie side by side in `perm`: class c has the positions perm[start[c] : start[c] + size[c]], in no order;
    `near` and `back` chain them by place (-1 at the ends), gap is the distance to near (0 at the end), since the level
    from which on it has been so. most: the longest period that the text of a position can have.
    """

    def __init__(self, symbols: np.ndarray, most: np.ndarray):
        n = len(symbols)
        self.level, self.most = 1, most
        self.perm = np.argsort(symbols, kind="stable")
        ordered = symbols[self.perm]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        self.count = int(new.sum())
        heads = np.flatnonzero(new)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: self.count], self.size[: self.count] = heads, np.diff(np.append(heads, n))
        self.of, self.at = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.perm], self.at[self.perm] = np.cumsum(new) - 1, np.arange(n)
        self.near, self.back = np.full(n, -1), np.full(n, -1)
        a, b = self.perm[:-1][~new[1:]], self.perm[1:][~new[1:]]
        self.near[a], self.back[b] = b, a
        self.gap, self.since = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.gap[a] = b - a
        self.moved = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def part(self, places: np.ndarray, gaps: np.ndarray) -> None:
        """The gaps of these places become others at the next level; squares that the former gaps meant are noted."""
        old = self.gap[places]
        changed = old != gaps
        places, gaps, old = places[changed], gaps[changed], old[changed]
        square = (old > 0) & (self.since[places] <= old) & (old <= self.level) & (old <= self.most[places])
        if square.any():
            self.squares.append((places[square], old[square]))
        self.gap[places], self.since[places] = gaps, self.level + 1

    def refine(self, small: np.ndarray) -> np.ndarray:
        """From one level to the next. small: the positions in the classes that the last step cut off, but for the
        largest part of each; the same of this step is returned."""
        m = small - 1
        m = m[m >= 0]
        m = np.sort(m[(self.size[self.of[m]] > 1) & (self.most[m] > self.level)])
        none = m[:0]
        if not len(m):
            self.level += 1
            return none
        # Groups: positions of one class whose successors are in one class.
        key = self.of[m] * len(self.of) + self.of[m + 1]
        m = m[np.argsort(key, kind="stable")]
        owner = self.of[m]
        after = self.of[m + 1]
        other = owner[1:] != owner[:-1]
        group_at = np.concatenate([[0], np.flatnonzero(other | (after[1:] != after[:-1])) + 1])
        group_size = np.diff(np.append(group_at, len(m)))
        group_owner = owner[group_at]
        class_at = np.concatenate([[0], np.flatnonzero(group_owner[1:] != group_owner[:-1]) + 1])  # first group of each class
        groups = np.diff(np.append(class_at, len(group_owner)))
        total = np.add.reduceat(group_size, class_at)
        split = (total < self.size[group_owner[class_at]]) | (groups > 1)
        if not split.all():
            of_group = np.repeat(split, groups)
            m = m[np.repeat(of_group, group_size)]
            group_size, group_owner = group_size[of_group], group_owner[of_group]
            groups, total = groups[split], total[split]
            if not len(m):
                self.level += 1
                return none
            class_at = np.cumsum(groups) - groups
        classes = group_owner[class_at]
        rest = self.size[classes] - total
        # The largest part of each class: the rest, or its first group of most members.
        number = np.arange(len(group_size))
        largest = np.maximum.reduceat(group_size * len(self.of) - number, class_at)
        largest = -largest % len(self.of)
        rest_is_largest = rest >= group_size[largest]
        # Chains: what stays is chained past what leaves, and each group anew.
        by_place = np.sort(m) if len(classes) == 1 else m[np.lexsort((m, np.repeat(group_owner, group_size)))]
        follows = np.concatenate([[False], self.near[by_place[:-1]] == by_place[1:]])
        before, beyond = self.back[by_place[~follows]], self.near[by_place[~np.append(follows[1:], False)]]
        inner = (before >= 0) & (beyond >= 0)
        self.near[before[before >= 0]] = beyond[before >= 0]
        self.back[beyond[beyond >= 0]] = before[beyond >= 0]
        stays = before >= 0
        self.part(before[stays], np.where(inner, beyond - before, 0)[stays])
        last = np.zeros(len(m), bool)
        last[np.cumsum(group_size) - 1] = True
        near = np.where(last, -1, np.append(m[1:], -1))
        self.part(m, np.where(last, 0, near - m))
        self.near[m] = near
        self.back[m] = np.where(np.append(True, last[:-1]), -1, np.append(-1, m[:-1]))
        # Places in perm: the rest first, then the groups.
        tail_at = self.start[classes] + rest
        tail = spread(tail_at, total)
        self.moved[m] = True
        there = self.perm[tail]
        stay = there[~self.moved[there]]
        places = self.at[m]
        vacated = places[places < np.repeat(tail_at, total)]
        self.perm[vacated], self.at[stay] = stay, vacated
        self.perm[tail], self.at[m] = m, tail
        self.moved[m] = False
        # Names: the rest keeps its class's, or the largest group if there is none.
        keeps = np.zeros(len(group_size), bool)
        keeps[largest[rest == 0]] = True
        fresh = self.count + np.arange(int((~keeps).sum()))
        self.count += len(fresh)
        names = group_owner.copy()
        names[~keeps] = fresh
        self.size[classes] = rest
        self.start[names], self.size[names] = tail[np.cumsum(group_size) - group_size], group_size
        self.of[m] = np.repeat(names, group_size)
        cut = np.ones(len(group_size), bool)
        cut[largest[~rest_is_largest]] = False
        found = m[np.repeat(cut, group_size)]
        low = ~rest_is_largest & (rest > 0)
        if low.any():
            found = np.concatenate([found, self.perm[spread(self.start[classes[low]], rest[low])]])
        self.level += 1
        return found

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, periods) of all squares that begin with their smallest period, up to the texts' longest ones."""
        small = np.arange(len(self.of))
        longest = int(self.most.max(initial=0))
        while len(small) and self.level < longest:
            small = self.refine(small)
        left = np.flatnonzero((self.gap > 0) & (self.since <= self.gap) & (self.gap <= self.most))
        self.squares.append((left, self.gap[left]))
        return tuple(np.concatenate(x) for x in zip(*self.squares, strict=True))


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs, by text, start and period. words: a number for each word of all texts."""
    texts = len(sizes)
    text_of = np.repeat(np.arange(texts), sizes)
    here = np.arange(len(words)) + text_of  # one separator after each text
    total = len(words) + texts
    kinds = int(words.max(initial=0)) + 1
    symbols = np.arange(total) + kinds * texts
    symbols[here] = text_of * kinds + words
    most = np.zeros(total, np.int64)
    most[here] = np.where(sizes >= LEAST_WORDS, sizes // LEAST_EXPONENT, 0)[text_of]
    place, period = Classes(symbols, most).all_squares()
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    if not len(place):
        return (place,) * 4
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])]))
    length = np.diff(np.append(first, len(place))) - 1 + 2 * period[first]
    start, period = place[first], period[first]
    long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.searchsorted(begin, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - begin[text])[order], length[order], period[order]


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapsed(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, its runs, and its text without what they repeat, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1, BLOCK_BYTES):
            words = [(t or b"").split() for t in batch.column(1).to_pylist()]  # bytes split at these six kinds of white space
            sizes = np.array([len(w) for w in words], np.int64)
            every = pa.chunked_array([pa.array([x for w in words for x in w], pa.binary())]).combine_chunks().dictionary_encode()
            text, start, length, period = runs_of(every.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            ends = np.searchsorted(text, np.arange(len(words) + 1))
            left = []
            for k, own in enumerate(words):
                if ends[k] < ends[k + 1]:
                    edges = np.zeros(len(own) + 1, np.int64)
                    mine = slice(ends[k], ends[k + 1])
                    np.add.at(edges, start[mine] + period[mine], 1)
                    np.add.at(edges, start[mine] + length[mine], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                left.append(b" ".join(own).decode())
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), runs, pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: the query's documents, of which a tenth by a hash of the id repeat a part of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    period = (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int")
    turned = (
        rows.where((F.col("h") % 10 == 0) & F.col("text").rlike(WORD))
        .select("doc_id", "g", words.alias("words"))
        .withColumn("a", a)
        .withColumn("p", period)
        .select("doc_id", F.concat_ws(" ", F.slice("words", 1, F.col("a")), F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))).alias("text"))
    )
    rest = rows.where(F.col("h").isNull() | (F.col("h") % 10 != 0) | F.col("text").isNull() | ~F.col("text").rlike(WORD))
    return rest.select("doc_id", "text").unionByName(turned)


def _listed(run: Column) -> Column:
    return F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed(with_tails(table(spark, sf_dir, "documents")))
    # Of two runs the one of greater exact exponent; the runs come by start, then period, so the first of equal ones stays.
    above = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(above(r, best), r).otherwise(best))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", _listed)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
