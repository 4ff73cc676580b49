"""Token-id output (7): best-fit-decreasing packing into rows of equal length.

Each document becomes its byte-level BPE ids and an end mark. Documents longer than a row are split without loss: full
rows, and a rest. A task gathers its documents into shards of SHARD_TOKENS and packs each shard: pieces in order of
decreasing length go to the open row with the least room that is enough, which a segment tree over the rooms finds.
A shard's packed rows carry the matrix's ids (little-endian, padded), cumulative segment lengths, the offsets at which
positions start again from 0, and which piece of which document each segment is. Nothing is shuffled; a task holds
one shard (and one document) at a time.

Null texts count as empty: a document without text is its end mark. Equal lengths go by order of arrival. Rows with
the same doc_id are told apart by `document`, their number within the shard. An empty table gives no rows. Columns other
than doc_id and text are not read. Which documents share a shard follows the input's partitions: a rerun on the same
files packs the same rows, one on another layout packs the same documents in other company.

Runs of LONG_RUN white-space characters and more are cut out before the tokenizer, whose pattern would overflow its
stack on a million of them. The pattern takes such a run as one word up to its last character, which goes with what
follows (at the text's end the whole run is the word), so the ids are the same. Texts without white space are words
of any length; they take memory in proportion.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

ORACLE_SQL = None

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern takes for white space (Unicode's property).
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 1024
_LONG_RUNS = re.compile(f"{WHITE}{{{LONG_RUN},}}")
LENGTH, SHARD_TOKENS = 2048, 4_000_000
#: The first id that the vocabulary leaves free ends documents, and fills rows.
END_ID = PAD_ID = 50_256
SCHEMA = """shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>,
segments array<struct<doc_id:long,document:int,piece:int,start:int,length:int>>"""
_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("row", pa.int32()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), *((n, pa.int32()) for n in ("document", "piece", "start", "length"))]))),
    ]
)


@cache
def encoding(ranks_file: str) -> tiktoken.Encoding:
    """One a worker process."""
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, model: tiktoken.Encoding) -> list[int]:
    ids, at = [], 0
    for run in _LONG_RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += model.encode_ordinary(text[at : run.start()])
        ids += model._encode_single_piece(text[run.start() : end])
        at = end
    return ids + model.encode_ordinary(text[at:])


class Rooms:
    """Open rows by their room, in a segment tree over the sizes 0 to length that holds how many rows have that room."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = self.width + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and gives a row of the least room from `need` on, with that room."""
        node = self.width + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.width
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of pieces (by their number), none above length; pieces of decreasing length, each where least room is left."""
    rooms, rows = Rooms(length), []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        row, room = rooms.take(lengths[piece]) or (len(rows), length)
        if row == len(rows):
            rows.append([])
        rows[row].append(piece)
        rooms.put(row, room - lengths[piece])
    return rows


def pack_shard(shard: int, documents: list[tuple[int, np.ndarray]], length: int, pad_id: int) -> pa.RecordBatch:
    pieces = [
        (doc_id, number, k, at, ids[at : at + length])
        for number, (doc_id, ids) in enumerate(documents)
        for k, at in enumerate(range(0, len(ids), length))
    ]
    columns: list[list] = [[] for _ in _ARROW]
    kind = np.dtype("<u2") if max(pad_id, *(int(p[4].max()) for p in pieces)) < 2**16 else np.dtype("<u4")
    for row, members in enumerate(best_fit([len(p[4]) for p in pieces], length)):
        ids = np.full(length, pad_id, dtype=kind)
        ends = np.cumsum([0] + [len(pieces[m][4]) for m in members])
        ids[: ends[-1]] = np.concatenate([pieces[m][4] for m in members])
        segments = [{"doc_id": d, "document": n, "piece": k, "start": at, "length": len(x)} for d, n, k, at, x in (pieces[m] for m in members)]
        for column, value in zip(columns, (shard, row, int(ends[-1]), ids.tobytes(), ends, ends[:-1], segments), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, length: int = LENGTH, ranks_file: str = RANKS_FILE, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """Packed rows of all documents; ids are 16-bit where the shard's ids allow, else 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(ranks_file)
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((key, np.array([*token_ids(text.as_py() or "", model), end_id], dtype=np.int32)))
                size += len(held[-1][1])
                if size >= SHARD_TOKENS:
                    yield pack_shard(shard, held, length, pad_id)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield pack_shard(shard, held, length, pad_id)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
