"""Quality classifier (2) by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is trained on texts labelled good, one on texts labelled bad. All that a score knows of a text is the
normalised difference (b - g) / (b + g) of its compressed sizes with the two, over the whole text, at the least over its
segments and on their average. A logistic regression with squares of these differences, fitted on other labelled rows
than the dictionaries, calibrates them to a probability of label 1. Neither length nor compressibility takes part.

Only the fit is bounded: DICTIONARY_ROWS and CALIBRATION_ROWS labelled rows a class, the least by a hash of doc_id, of
documents of at most LONGEST bytes, so the driver holds no more than 2 * DICTIONARY_ROWS * LONGEST bytes of texts;
calibration rows are measured in tasks. Every row's whole text is scored, whatever its length.

Null texts count as empty; empty texts get the score of their (equal) sizes. Rows with a null or other label than 0 and 1
are not learned from, nor are doc_ids with both labels or without a document. Of repeated doc_ids each different
text is learned from. If a class has no rows to learn from, every score is the share of label 1 (0.5 without labels). An empty table
gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

ORACLE_SQL = None

ACCEPTED_FROM = 0.7
HELD_OUT_FOLD, FOLDS = 2, 4
DICTIONARY_ROWS, CALIBRATION_ROWS = 2000, 3000
LONGEST = 20_000
DICTIONARY_BYTES, SAMPLE_BYTES, SEGMENT_BYTES, LEVEL = 65_536, 2048, 512, 3
RIDGE = 1.0


@dataclass(frozen=True)
class Model:
    """What the driver sends to the tasks: two dictionaries of DICTIONARY_BYTES and some thirty numbers."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    #: The score if there was nothing to learn a difference from.
    constant: float | None = None


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def dictionary(texts: list[bytes]) -> bytes:
    samples = [text[i : i + SAMPLE_BYTES] for text in texts for i in range(0, len(text), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve as the dictionary's content
        return b"".join(samples)[:DICTIONARY_BYTES] or b" " * 8


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def segments(text: bytes) -> list[bytes]:
    """Parts of SEGMENT_BYTES; what is left at the end is one of them if it is at least half as long, or alone."""
    every = [text[at : at + SEGMENT_BYTES] for at in range(0, max(1, len(text)), SEGMENT_BYTES)]
    return every[:-1] if len(every) > 1 and len(every[-1]) < SEGMENT_BYTES // 2 else every


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    def difference(part: bytes) -> float:
        a, b = len(good.compress(part)), len(bad.compress(part))
        return (b - a) / (b + a)

    parts = segments(text)
    each = [difference(part) for part in parts]
    whole = each[0] if len(parts) == 1 and len(parts[0]) == len(text) else difference(text)
    return [whole, min(each), sum(each) / len(each)]


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = (x - mean) / scale
    return np.stack([np.ones(len(z)), *z.T, *(z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1]))], axis=1)


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    a = design(x, np.array(model.mean), np.array(model.scale)) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


def calibrated(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of the least penalised loss: Newton steps, halved until the loss falls. It is convex, so they end there.

    Whole steps can overshoot where texts lie far out, and then swing for ever between scores of 0 and of 1 for all texts.
    """

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + RIDGE / 2 * w @ w)

    w = np.zeros(a.shape[1])
    now = loss(w)
    while True:
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (y - p) - RIDGE * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w)), slope)
        falls, part = slope @ step, 1.0
        if falls <= 1e-10 * (1 + now):
            return w
        while (then := loss(w + part * step)) > now - 0.1 * part * falls:
            part /= 2
            if part < 1e-9:  # no more than rounding is left to gain
                return w
        w, now = w + part * step, then


def _measured(text: Column, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packers = compressor(good), compressor(bad)
        for texts in batches:
            yield pd.Series([features(text.encode(), *packers) for text in texts], dtype=object)

    return measured(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most 2 * (DICTIONARY_ROWS + CALIBRATION_ROWS) rows outside the held-out fold."""
    sure = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    sure = sure.where((F.col("quality") == F.col("other")) & (fold(F.col("doc_id")) != HELD_OUT_FOLD)).select("doc_id", "quality")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    known = written(texts.select("doc_id", F.xxhash64("text").alias("digest")).join(sure, "doc_id"), "quality-known")
    order = F.xxhash64("doc_id", "digest")
    rows = [known.where(F.col("quality") == label).orderBy(order, "doc_id").limit(DICTIONARY_ROWS + CALIBRATION_ROWS).collect() for label in (0, 1)]
    if not all(rows):
        return Model(b"", b"", (), (), (), len(rows[1]) / max(1, len(rows[0]) + len(rows[1])) if any(rows) else 0.5)
    # Small label sets are shared out in the same proportion as large ones; a class of one row serves for both.
    cut = [min(DICTIONARY_ROWS, -(-len(of) * 2 // 5)) for of in rows]
    parts = {"dictionary": [of[:n] for of, n in zip(rows, cut, strict=True)], "calibration": [of[n:] or of for of, n in zip(rows, cut, strict=True)]}

    def chosen(part: str) -> DataFrame:
        ids = [(r.doc_id, r.digest, label) for label, of in enumerate(parts[part]) for r in of]
        ids = docs.sparkSession.createDataFrame(ids, "doc_id long, digest long, label int")
        return texts.withColumn("digest", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "digest"])

    got = sorted((r.doc_id, r.label, r.text.encode()) for r in chosen("dictionary").select("doc_id", "label", "text").distinct().collect())
    good, bad = (dictionary([text for _, label, text in got if label == wanted]) for wanted in (1, 0))
    learn = chosen("calibration").select("doc_id", "digest", F.col("label"), _measured(F.col("text"), good, bad).alias("x")).distinct().collect()
    learn = sorted((r.doc_id, r.digest, r.label, r.x) for r in learn)
    x, y = np.array([r[3] for r in learn]), np.array([r[2] for r in learn], dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, tuple(mean), tuple(scale), tuple(calibrated(design(x, mean, scale), y)))


def score(text: Column, model: Model) -> Column:
    """The calibrated probability that a text is good."""
    if model.constant is not None:
        return F.lit(float(model.constant))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packers = compressor(model.good), compressor(model.bad)
        for texts in batches:
            x = np.array([features(text.encode(), *packers) for text in texts]).reshape(len(texts), -1)
            yield pd.Series(probability(x, model) if len(texts) else np.zeros(0))

    return scored(F.coalesce(text, F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPTED_FROM).cast("int"))
