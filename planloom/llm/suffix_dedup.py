"""Suffix-array dedup (10): removes every byte covered by a LENGTH-byte string that starts anywhere else as well.

Texts are UTF-8 bytes; matches never cross texts. Suffixes that cannot matter are set aside first, without loss: each
window of LENGTH bytes has an anchor, the GRAM-byte string of least hash in it (the leftmost of equal ones), and equal
windows have equal anchors at equal places. So a window can only be repeated if its anchor is. Windows with one anchor
next to each other form a slice of text:

* slices of one anchor that agree in a 128-bit digest (BLAKE2) of their bytes are copies, so all of their windows are
  repeated; one of each kind goes on;
* an anchor with one kind that occurs once has no repeated window, and one without a kind that occurs once is settled;
* the kinds of the other anchors are dealt to tasks by anchor, and their bytes decide.

A task deals its slices to shards and builds each shard's transform: the order of the shard's suffixes, the STEP bytes
before each of them, and which suffixes share LENGTH bytes within the shard. The shards' orders are then interleaved by
the transforms alone: a pass moves every suffix of the interleave, in its order, to the place that the bytes before it
give, which is right for STEP more bytes; no suffixes are compared or sorted again. Neighbours that a pass parts have
fewer common bytes than the passes have covered, the others at least as many, so the intervals left after LENGTH bytes
are the strings that occur more than once. Intervals of a single suffix, or of one shard, drop out on the way, as the
shards' own prefixes have settled them; once nothing is left the interleave is at its fixed point.

A stretch that repeats itself with a period shorter than a window has an anchor in each period. Its windows of one period
go on as one slice, and all later ones are a copy of that slice's kind (the bytes are compared to be sure), so a stretch
makes two rows, however long it is.

An anchor with more than TASK_WINDOWS windows is dealt out further, whatever its slices: its windows are cut by the place
of the anchor in them, WIDTHS[0] places at a time, then WIDTHS[1] and so on, and dealt by the bytes that all windows of
such a cut have in common. At one place these are the window itself, so no key makes a task large, and cuts that are
copies count as above.

Null texts count as empty. Rows with equal doc_id and text are occurrences of their own and get equal results, worked
out once. Texts shorter than LENGTH have nothing removed; very long texts are sliced BLOCK_BYTES at a time. An empty
table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import digest, in_parts, joined_by, table, written
from .shingles import BLOCK_BYTES, mix, powers

LENGTH, GRAM, STEP = 200, 32, 8
#: Windows in a task's group, and bytes of a shard.
TASK_WINDOWS, SHARD_BYTES = 60_000, 32_768
#: Places of the anchor in a cut of a large anchor's windows, from cut to cut.
WIDTHS = (32, 8, 1)
#: Repeated anchors are broadcast up to this many (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_ANCHORS = 1_000_000


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each position on."""
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data] * up[: len(data)], dtype=np.uint64)])
    starts = np.arange(max(0, len(data) - n + 1))
    return mix((sums[starts + n] - sums[starts]) * down[starts])


def slices(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, place of the anchor, first, last): for each anchor the range of starts of the windows that have it.

    text: its number; the places count from the text's start.
    """
    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    if not (sizes >= LENGTH).any():
        return none, none, none, none, none
    grams = rolling(data, GRAM)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)  # equal hashes: the leftmost
    width, step = LENGTH - GRAM + 1, 1
    while step < width:  # the least of `step` grams from each position on, doubling
        by = min(step, width - step)
        least = np.minimum(least[: len(least) - by], least[by:])
        step += by
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    text_of = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(text_of)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[text_of]
    anchor = anchor[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text_of[1:] != text_of[:-1])])
    first, at = start[new], np.flatnonzero(new)
    last = start[np.concatenate([at[1:], [len(start)]]) - 1]
    owner, anchor = text_of[new], anchor[new]
    return owner, grams[anchor].view(np.int64), anchor - begin[owner], first - begin[owner], last - begin[owner]


def folded(texts: list[bytes], owner: np.ndarray, anchor: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The slices, and for each the last window of its kind, where the windows of a periodic stretch are two slices only.

    The first has the windows of one period; the second has all later ones, each of which equals the one a period before
    it, so its kind is that of its own first period, which is the first slice's. It always comes behind the first one.
    """
    alike = (owner[1:] == owner[:-1]) & (anchor[1:] == anchor[:-1])
    step = np.where(alike, place[1:] - place[:-1], 0)
    begin = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(step) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(step))[: len(begin)]
    several = (step[begin] > 0) & (stop - begin > 1)
    first, keep, more = first.copy(), np.ones(len(owner), bool), []
    for a, b in zip(begin[several].tolist(), stop[several].tolist(), strict=True):  # slices a .. b have one anchor, a period apart
        period, low, high = int(step[a]), int(place[a]) + 1, int(last[b]) + LENGTH
        bytes_ = np.frombuffer(texts[owner[a]], np.uint8)[low:high]
        differ = np.flatnonzero(bytes_[:-period] != bytes_[period:]) + low
        edges = np.concatenate([[low - 1], differ, [high - period]])
        for k in np.flatnonzero(np.diff(edges) > LENGTH + period).tolist():
            begins, ends = int(edges[k]) + 1, int(edges[k + 1]) + period - LENGTH  # windows within the stretch
            j = a + 1 + int(np.searchsorted(first[a + 1 : b + 1], begins))
            while j < b and last[j] - first[j] + 1 != period:
                j += 1
            start = int(first[j]) + period if j < b else ends
            if ends - start + 1 < period:
                continue
            inside = slice(j + 1, b + 1)
            keep[inside] &= last[inside] > ends
            first[inside] = np.where(first[inside] <= ends, ends + 1, first[inside])
            more.append((owner[j], anchor[j], place[j] + period, start, ends, start + period - 1))
    columns = [x[keep] for x in (owner, anchor, place, first, last, last)]
    return tuple(np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip(columns, zip(*more, strict=True), strict=True)) if more else tuple(columns)


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """A row of two numbers for each part: a 128-bit digest."""
    return np.frombuffer(b"".join(blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def in_blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (number of the text, place in it, bytes): the windows of all texts, of long ones BLOCK_BYTES at a time."""
    block, held = [], 0
    for number, text in enumerate(texts):
        for place in range(0, max(1, len(text) - LENGTH + 1), BLOCK_BYTES):
            part = text[place : place + BLOCK_BYTES + LENGTH - 1]
            if block and held + len(part) > 2 * BLOCK_BYTES:
                yield block
                block, held = [], 0
            block.append((number, place, part))
            held += len(part)
    if block:
        yield block


def text_key() -> list[Column]:
    """doc_id and a hash of the text tell texts apart; rows that agree in both have the same bytes removed."""
    return [F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]


SLICE = "anchor long, kind_a long, kind_b long, doc_id long, digest long, place int, first int, last int"


def anchors(docs: DataFrame) -> DataFrame:
    """A row of SLICE for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, 2, BLOCK_BYTES):
            for block in in_blocks(part.column(2).to_pylist()):
                texts = [text for _, _, text in block]
                owner, anchor, place, first, last, of_kind = folded(texts, *slices(texts))
                kinds = digests(texts[t][a : b + LENGTH] for t, a, b in zip(owner.tolist(), first.tolist(), of_kind.tolist(), strict=True))
                rows, at = np.array([n for n, _, _ in block], np.int64)[owner], np.array([p for _, p, _ in block], np.int64)[owner]
                numbers = [pa.array((x + at).astype(np.int32)) for x in (place, first, last)]
                columns = [pa.array(anchor), pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), *numbers]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "kind_a", "kind_b", "doc_id", "digest", "place", "first", "last"])

    return docs.select(*text_key()).mapInArrow(run, SLICE)


def shard_order(at: np.ndarray, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of a shard's suffixes, those at `at` in all the text: their order by the first LENGTH bytes, and
    which of them share LENGTH bytes with another one of the shard.

    codes: ranks of the STEP bytes from each position on; room: bytes to the end of its slice.
    """
    place = np.full(int(at[-1]) + LENGTH + 1 - int(at[0]) if len(at) else 0, -1, np.int64)  # by position: its interval's first place
    base = int(at[0]) if len(at) else 0
    order = at[np.argsort(codes[at], kind="stable")]
    keys = codes[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(order) else np.zeros(0, bool)
    spots = np.arange(len(order))
    place[order - base] = np.maximum.accumulate(np.where(new, spots, 0))
    common, depth = np.zeros(0, np.int64), STEP
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        tied = ~(new & np.concatenate([new[1:], [True]])) if len(new) else new
        spots = spots[tied]
        some = order[spots]
        if not len(some):
            break
        mine = place[some - base]
        after = np.where(room[some] >= depth + step, place[np.minimum(some + step - base, len(place) - 1)], -1 - some)  # ends are like nothing else
        by = np.lexsort((after, mine))
        some, mine, after = some[by], mine[by], after[by]
        order[spots] = some
        new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])])
        place[some - base] = spots[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        depth += step
    else:
        tied = ~(new & np.concatenate([new[1:], [True]])) if len(new) else new
        common = order[spots[tied]]
        common = common[room[common] >= LENGTH]
    return order, common


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """For each part, whether the LENGTH bytes from each position on occur more than once in all parts."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    part_of = np.repeat(np.arange(len(parts)), sizes)
    room = ends[part_of] - np.arange(len(data))  # bytes from each position to the end of its part
    inside = sizes[part_of] - room
    padded = np.concatenate([data, np.zeros(STEP, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for k in range(STEP):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    distinct, codes = np.unique(words, return_inverse=True)
    codes = codes.astype(np.uint16 if len(distinct) <= 2**16 else np.int64)  # 16 bits: a pass is a distribution
    shards = max(1, -(-len(data) // SHARD_BYTES))
    shard_of = (part_of % shards).astype(np.int32)  # parts of one anchor are neighbours, and go to different shards
    repeated = np.zeros(len(data), bool)
    orders = []
    for shard in range(shards):
        order, common = shard_order(np.flatnonzero((shard_of == shard) & (room >= STEP)), codes, room)
        repeated[common] = True
        orders.append(order)
    # The interleave holds, at `covered` bytes, the suffixes from which a window's start is LENGTH - covered bytes away.
    z = np.concatenate(orders) if orders else np.zeros(0, np.int64)
    z = z[inside[z] >= LENGTH - STEP]
    block, covered = np.zeros(len(z), np.int64), 0
    while covered < LENGTH and len(z):
        before = codes[z if not covered else z - STEP]
        moved = np.argsort(before, kind="stable")
        z = (z if not covered else z - STEP)[moved]
        before, block = before[moved], block[moved]
        covered += STEP
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (block[1:] != block[:-1])])
        owner = shard_of[z]
        parted = np.concatenate([[False], owner[1:] != owner[:-1]]) & ~new  # two shards meet in one interval
        heads = np.flatnonzero(new)
        mixed = np.logical_or.reduceat(parted, heads)
        block = np.cumsum(new) - 1
        keep = mixed[block]
        z, block = z[keep], block[keep]
    repeated[z] = True
    return np.split(repeated, ends[:-1]) if len(parts) else []


def ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers, as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


FOUND = "doc_id long, digest long, first int, last int"
#: A slice with its bytes. place: of the anchor, from the slice's start; single: whether the slice's kind occurs once.
PIECE = "anchor long, doc_id long, digest long, place int, first int, single boolean, piece binary"


def settled(pieces: DataFrame, groups: int) -> DataFrame:
    """Repeated ranges of window starts in the single ones of pieces that share an anchor."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("anchor")
        found = repeated_starts(group.column("piece").to_pylist())
        rows, low, high = [], [], []
        for row, (first, single, starts) in enumerate(zip(group.column("first").to_pylist(), group.column("single").to_pylist(), found, strict=True)):
            for a, b in ranges(np.flatnonzero(starts)) if single else ():
                rows.append(row)
                low.append(first + a)
                high.append(first + b)
        taken = group.select(["doc_id", "digest"]).take(pa.array(rows, pa.int64()))
        return taken.append_column("first", pa.array(low, pa.int32())).append_column("last", pa.array(high, pa.int32()))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, FOUND)


def cut_finer(pieces: DataFrame, width: int) -> DataFrame:
    """The pieces' windows by `width` places of the anchor in them: PIECE, and kind_a, kind_b of the bytes.

    anchor is now a hash of the anchor, of the places, and of the bytes that all windows with these places share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, place, piece, first = (batch.column(n).to_pylist() for n in ("anchor", "place", "piece", "first"))
            rows, out = [], [[] for _ in range(4)]
            for k, (key, at, text, start) in enumerate(zip(anchor, place, piece, first, strict=True)):
                for cut in range(max(0, at - (len(text) - LENGTH)) // width, at // width + 1):
                    low, high = max(0, at - cut * width - width + 1), min(len(text) - LENGTH, at - cut * width)
                    shared = text[at - cut * width : at - cut * width + LENGTH - width + 1]
                    name = blake2b(b"%d:%d:%d:" % (key, width, cut) + shared, digest_size=8).digest()
                    rows.append(k)
                    for column, value in zip(out, (int.from_bytes(name, "little", signed=True), at - low, start + low, text[low : high + LENGTH]), strict=True):
                        column.append(value)
            kinds = digests(out[3])
            taken = [batch.column(n).take(pa.array(rows, pa.int64())) for n in ("doc_id", "digest", "single")]
            columns = [pa.array(out[0], pa.int64()), taken[0], taken[1], pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), taken[2], pa.array(out[3], pa.binary()), pa.array(kinds[:, 0]), pa.array(kinds[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "digest", "place", "first", "single", "piece", "kind_a", "kind_b"])

    return pieces.select("anchor", "doc_id", "digest", "place", "first", "single", "piece").mapInArrow(run, PIECE + ", kind_a long, kind_b long")


def in_large_anchors(pieces: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(repeated ranges of copies among the finer cuts; the kinds that are left to settle): see cut_finer."""
    key = ["anchor", "kind_a", "kind_b"]
    cut = written(cut_finer(pieces, width), "suffix-finer")
    last = F.col("first") + F.length("piece") - LENGTH
    kinds = cut.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "first")).alias("one"))
    kinds = written(kinds, "suffix-finer-kinds")
    copies = joined_by(cut.where("single").select(*key, "doc_id", "digest", "first", last.alias("last")), kinds.where("n > 1").select(*key, "n"), key, "n")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1")
    one = kinds.join(several.select("anchor"), "anchor", "left_semi").select(*(F.col(c).alias(f"_{c}") for c in key), "n", F.col("one.doc_id").alias("_id"), F.col("one.digest").alias("_digest"), F.col("one.first").alias("_first"))
    same = [F.col(c) == F.col(f"_{c}") for c in (*key, "digest", "first")] + [F.col("doc_id").eqNullSafe(F.col("_id"))]
    rest = cut.join(one, reduce(lambda a, b: a & b, same)).dropDuplicates(key).withColumn("single", F.col("single") & (F.col("n") == 1))
    return copies.select("doc_id", "digest", "first", "last"), rest.select("anchor", "doc_id", "digest", "place", "first", "single", "piece")


def cut_slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (anchor, single, doc_id, digest, place, first, last) with each slice's bytes: PIECE."""
    by_text = wanted.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(F.collect_set(F.struct("anchor", "single", "place", "first", "last")).alias("wanted"))
    # Rows that are equal have one text.
    texts = docs.select(*text_key()).where(F.length("text") >= LENGTH)
    joined = texts.join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
    each = joined.select("doc_id", "digest", "text", F.explode("wanted").alias("w"))
    piece = F.substring(F.col("text"), F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + LENGTH)
    return each.select("w.anchor", "doc_id", "digest", (F.col("w.place") - F.col("w.first")).alias("place"), "w.first", "w.single", piece.alias("piece"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, digest, first, last: ranges of starts of windows that occur more than once; ranges can repeat."""
    key = ["anchor", "kind_a", "kind_b"]
    every = written(anchors(docs), "suffix-anchors")
    twice = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-repeated")
    if twice.count() <= BROADCAST_ANCHORS:
        twice = F.broadcast(twice)
    hits = written(every.join(twice, "anchor", "left_semi"), "suffix-hits")
    kinds = hits.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "place", "first", "last")).alias("one"))
    kinds = written(kinds, "suffix-kinds")
    copied = joined_by(hits, kinds.where("n > 1").select(*key, "n"), key, "n").select("doc_id", "digest", "first", "last")
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).where("kinds > 1 AND singles > 0")
    wanted = kinds.join(open_.select("anchor"), "anchor", "left_semi").select("anchor", (F.col("n") == 1).alias("single"), "one.*")
    pieces, found = written(cut_slices(docs, wanted), "suffix-slices"), [copied]
    for width in (*WIDTHS, None):
        sizes = pieces.groupBy("anchor").agg(F.sum(F.length("piece") - LENGTH + 1).alias("windows"), F.count_if("single").alias("singles"))
        sizes = written(sizes.where("singles > 0").drop("singles"), "suffix-sizes")
        total, large = sizes.agg(F.sum("windows"), F.count_if(F.col("windows") > TASK_WINDOWS)).first()
        if not total:
            break
        # Large anchors are at most one in TASK_WINDOWS windows.
        hot = F.broadcast(sizes.where(F.col("windows") > TASK_WINDOWS).select("anchor"))
        small = pieces.join(hot, "anchor", "left_anti") if large else pieces
        found.append(settled(small, max(64, -(-total // TASK_WINDOWS))))
        if not large or width is None:
            break
        copies, pieces = in_large_anchors(pieces.join(hot, "anchor", "left_semi"), width)
        found.append(copies)
        pieces = written(pieces, "suffix-finer-slices")
    return reduce(DataFrame.unionByName, found)


def without(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text, and how many runs of bytes went."""
    edges = np.zeros(len(text) + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + LENGTH, -1)
    gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text (what is left, as bytes), n_bytes, n_removed, n_spans."""
    found = repeated_ranges(docs)
    by_text = found.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(F.collect_set(F.struct("first", "last")).alias("r"))
    by_text = written(by_text.select("d", "g", F.col("r.first").alias("first"), F.col("r.last").alias("last")), "suffix-ranges")
    joined = docs.select(*text_key()).join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1, BLOCK_BYTES):
            texts, left, runs = batch.column(1).to_pylist(), [], []
            for text, first, last in zip(texts, batch.column(2), batch.column(3), strict=True):
                rest, n = (text, 0) if not first.is_valid else without(text, first.values.to_numpy(), last.values.to_numpy())
                left.append(rest)
                runs.append(n)
            size = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(left, pa.binary()), pa.array(size, pa.int64()), pa.array([n - len(t) for n, t in zip(size, left, strict=True)], pa.int64()), pa.array(runs, pa.int64())],
                ["doc_id", "text", "n_bytes", "n_removed", "n_spans"],
            )

    return joined.select("doc_id", "text", "first", "last").mapInArrow(run, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT id, base, substr(h, 2 * base + 1, 1398) AS h, least(500, length(h) // 2 - 199 - base) AS n
  FROM (SELECT id, h, unnest(range(0, length(h) // 2 - 199, 500)) AS base FROM d WHERE length(h) >= 400)
), w AS (
  SELECT id, base + q AS p, md5(substr(h, 2 * q + 1, 400)) AS m FROM (SELECT id, base, h, unnest(range(0, n)) AS q FROM b)
), t AS (
  SELECT m FROM w GROUP BY m HAVING count(*) > 1
), s AS (
  SELECT id, p, p - coalesce(lag(p) OVER (PARTITION BY id ORDER BY p), -1000000) > 200 AS new FROM w WHERE m IN (FROM t)
), g AS (
  SELECT id, p, sum(CAST(new AS INT)) OVER (PARTITION BY id ORDER BY p) AS run FROM s
), r AS (
  SELECT id, run, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY id, run
), k AS (
  SELECT id, a, b, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS before FROM r
), c AS (
  SELECT d.id, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM d JOIN k ON d.id = k.id GROUP BY d.id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN c ON d.id = c.id
"""
