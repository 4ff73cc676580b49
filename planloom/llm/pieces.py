"""SentencePiece encoding and decoding (5) by a shared-prefix Viterbi search over the distinct words of each block.

A text gets the dummy prefix, spaces become the mark U+2581, and it is cut into marked words: a run of marks with what
follows up to the next mark, and line feeds alone. No piece of the model crosses such a cut (checked on loading). The
distinct words of a block of texts are sorted, which lays a trie's branches side by side, and traversed depth-first:
each position keeps one forward state, and a word recomputes only the states beyond the prefix that it shares with
the word before it.

The state of a unigram model is the best score and the piece that reaches it. A BPE model's ids aren't those of the
highest score, so summed scores can't give right results there; its state is the one piece that can end the prefix's
encoding, namely the piece that the merges leave beside the piece before it. Ids equal the sentencepiece library's.
`scores_query` runs the score form over the same pieces: the segmentation of highest summed score of each text.

Nothing is shuffled: a block is part of one task's rows. A worker holds one block of BLOCK_BYTES (or one
longer text, whatever its length), words of CACHED_CHARS characters (WORD_COST more for each) with their ids, and
BESIDE_PAIRS verdicts on neighbours; what exceeds these bounds is forgotten and worked out again. Null texts count as
empty, which have no ids; an empty table gives no rows; a text of one long word is one path of the trie. Repeated rows
are encoded each. Decoding gives the text again, except that a mark in a text comes back as a space. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_parts, table

ORACLE_SQL = None

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text that are encoded together.
BLOCK_BYTES = 1_000_000
#: Words whose ids a worker remembers from block to block, by their characters and WORD_COST for each word; longer words
#: than LONGEST_CACHED are not remembered.
CACHED_CHARS, WORD_COST, LONGEST_CACHED = 12_000_000, 30, 200
#: Pairs of pieces whose standing side by side a worker remembers.
BESIDE_PAIRS = 400_000


class Encoder:
    """A model's pieces, and the search for the pieces of sorted words. kind: "bpe" or "unigram", as the model was trained."""

    def __init__(self, model_file: str = MODEL_FILE, kind: str = "bpe", model_bytes: bytes | None = None):
        sp = sentencepiece.SentencePieceProcessor(**({"model_proto": model_bytes} if model_bytes else {"model_file": model_file}))
        if "".join(sp.encode("a  B① ", out_type=str)).replace("<0xE2><0x91><0xA0>", "①") != "▁a▁▁B①▁":
            raise ValueError("only models that leave texts as they are, but for the dummy prefix, are supported")
        self.kind, n = kind, sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(text)]
        self.byte_id = {b[0]: i for i, b in enumerate(self.bytes_of) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.ids = {p: i for i, p in enumerate(text) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.text, self.score = text, [sp.get_score(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a piece crosses the end of a marked word")
        self.words = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+").findall
        # Lengths of the longer pieces by their last three characters: few pieces can end at a position.
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {tail: tuple(sorted(found, reverse=True)) for tail, found in tails.items()}
        self.twos = {p: i for p, i in self.ids.items() if len(p) == 2}
        self.least = min(self.score[i] for i in self.ids.values()) - 10.0 if self.ids else 0.0
        self.beside: list[dict[int, bool]] = [{} for _ in range(n)]
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.total_of: dict[str, float] = {}
        self.pairs, self.cached = 0, 0

    def merged(self, text: str) -> list[str]:
        """A short string's pieces by the model's merges: the best-scored neighbours first, the left of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(-self.score[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not pairs:
                break
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stand(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces side by side (left -1: whether it makes the right one at all)."""
        if (known := self.beside[right].get(left)) is None:
            if self.pairs >= BESIDE_PAIRS:
                for of_piece in self.beside:
                    of_piece.clear()
                self.pairs = 0
            parts = ([self.text[left]] if left >= 0 else []) + [self.text[right]]
            known = self.beside[right][left] = self.merged("".join(parts)) == parts
            self.pairs += 1
        return known

    def bpe_states(self, word: str, at: int, last: list[int], size: list[int]) -> None:
        """Appends the states of the positions after `at`. last: the piece that ends there, -1 for a character without
        one; size: its number of characters."""
        ids, lengths, twos, beside, stand = self.ids, self.lengths, self.twos, self.beside, self.stand
        for end in range(at + 1, len(word) + 1):
            for n in lengths.get(word[end - 3 : end], ()) if end > 2 else ():
                begin = end - n
                if begin >= 0 and (i := ids.get(word[begin:end])) is not None:
                    left = last[begin]
                    if (known := beside[i].get(left)) or (known is None and stand(left, i)):
                        last.append(i)
                        size.append(n)
                        break
            else:
                if end > 1 and (i := twos.get(word[end - 2 : end])) is not None:
                    left = last[end - 2]
                    if (known := beside[i].get(left)) or (known is None and stand(left, i)):
                        last.append(i)
                        size.append(2)
                        continue
                last.append(ids.get(word[end - 1], -1))
                size.append(1)

    def best_states(self, word: str, at: int, last: list[int], size: list[int], total: list[float]) -> None:
        """The same for the highest sum of scores; of equal sums the longest last piece."""
        ids, lengths, score = self.ids, self.lengths, self.score
        for end in range(at + 1, len(word) + 1):
            i = ids.get(word[end - 1], -1)
            best = (total[end - 1] + (score[i] if i >= 0 else self.least), 1, i)
            for n in (*(lengths.get(word[end - 3 : end], ()) if end > 2 else ()), 2):
                if n <= end and (i := ids.get(word[end - n : end])) is not None:
                    best = max(best, (total[end - n] + score[i], n, i))
            total.append(best[0])
            size.append(best[1])
            last.append(best[2])

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct words, by depth-first traversal of their trie."""
        out, before = {}, ""
        last, size, total = [-1], [0], [0.0]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], total[shared + 1 :]
            if self.kind == "bpe":
                self.bpe_states(word, shared, last, size)
            else:
                self.best_states(word, shared, last, size, total)
            ids, end = [], len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids += [self.byte_id.get(b, self.unknown) for b in reversed(word[end - size[end] : end].encode())]
                end -= size[end]
            ids.reverse()
            out[word] = ids
            if self.kind != "bpe":
                self.total_of[word] = total[-1]
            before = word
        return out

    def encode_texts(self, texts: list[str]) -> tuple[list[list[int]], list[float]]:
        """Ids and, of a unigram model, summed scores of texts. Words are remembered up to the bound, the longest unused go first."""
        cut = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known, before = self.known, self.before
        fresh = set(chain.from_iterable(cut)).difference(known)
        again = fresh.intersection(before)
        new = self.encode_words(fresh - again)
        known.update(new)
        known.update((word, before.pop(word)) for word in again)
        ids = [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]
        totals = [sum(map(self.total_of.__getitem__, words)) for words in cut] if self.kind == "unigram" else [0.0] * len(cut)
        for word in [word for word in new if len(word) > LONGEST_CACHED]:
            del known[word]
            self.total_of.pop(word, None)
            fresh.remove(word)
        self.cached += sum(map(len, fresh)) + WORD_COST * len(fresh)
        if self.cached > CACHED_CHARS // 2:  # the words that this half lacks were not used since the other half was full
            for word in before:
                self.total_of.pop(word, None)
            self.before, self.known, self.cached = known, {}, 0
        return ids, totals

    def forget(self) -> None:
        """Frees the words: a worker goes on to other tasks."""
        self.known, self.before, self.cached = {}, {}, 0
        self.total_of.clear()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


@cache
def encoder(model_file: str, kind: str) -> Encoder:
    """One a worker process."""
    return Encoder(model_file, kind)


def encode(docs: DataFrame, model_file: str = MODEL_FILE, kind: str = "bpe") -> DataFrame:
    """doc_id, ids, round_trip, score: the ids of each whole text, whether they decode to it, and for the kind "unigram"
    the sum of the pieces' scores (0 otherwise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_file, kind)
        for part in in_parts(batches, 1, BLOCK_BYTES):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, totals = model.encode_texts(texts)
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            same = [model.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values), pa.array(same), pa.array(totals, pa.float64())], ["doc_id", "ids", "round_trip", "score"])
        model.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean, score double")


def decode(encoded: DataFrame, model_file: str = MODEL_FILE, kind: str = "bpe") -> DataFrame:
    """doc_id, text from doc_id, ids (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_file, kind)
        for batch in batches:
            texts = [model.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces by the highest summed score of each text instead of by merges."""
    ids = encode(table(spark, sf_dir, "documents"), kind="unigram")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", F.round("score", 6).alias("score"))
