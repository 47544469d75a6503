"""Quality of texts by votes of labelled neighbours in a latent space.

Every text becomes counts of trigrams over byte classes (letters by kind, digits, spaces, each punctuation mark), with
marks for its length and for how often it repeats itself. The driver fits a truncated singular value decomposition on
the weighted counts of a bounded sample of labelled texts and broadcasts the projection and the labelled vectors. Each
task then computes the cosines of its texts with all labelled vectors, block by block, and the nearest ones vote with
weights that grow with their similarity.

The fit sees at most ``sample_rows`` labelled texts (default ``SAMPLE_ROWS``), drawn by a hash of doc_id; everything
else covers all texts, each of them whole. Labels, languages, sources and ids are never inputs of a score.

Defined results: null and empty texts are texts without trigrams and get the votes of the shortest ones; without any
label every score is 0.5; of repeated doc_id one text is used in the fit, and a repeated label counts by its mean,
rounded half up; null labels and null ids are not learned from; repeated rows get the same score each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import bounded_batches, bounded_sample, free_name

SAMPLE_ROWS = 4096
#: Hashed trigrams, marks of length and of repetition, latent dimensions, voters, power of the similarity.
TRIGRAMS, LENGTHS, REPEATS = 4096, 24, 24
LATENT, VOTERS, SHARPNESS = 128, 5, 16
#: Share of the marks beside the trigrams, whose squares add up to one.
MARK = 0.1
ACCEPT = 0.3
#: Texts whose features or cosines are in memory at once, and bytes of text.
BLOCK, BLOCK_BYTES = 256, 8 << 20


def _byte_classes() -> np.ndarray:
    classes = np.zeros(256, np.int64)
    classes[128:] = 31
    classes[list(range(97, 123))], classes[list(b"aeiou")], classes[list(range(65, 91))] = 1, 2, 3
    classes[list(range(48, 58))], classes[32], classes[10], classes[[9, 13]] = 4, 5, 6, 7
    marks = [b for b in range(33, 127) if not classes[b]]
    classes[marks] = np.minimum(8 + np.arange(len(marks)), 30)
    return classes


CLASSES = _byte_classes()


def features(texts: list[str | None]) -> np.ndarray:
    """Root relative trigram counts and marks, one row for each text."""
    out = np.zeros((len(texts), TRIGRAMS + LENGTHS + REPEATS), np.float32)
    for row, text in zip(out, texts):
        kinds = CLASSES[np.frombuffer((text or "").encode(), np.uint8)]
        n = len(kinds)
        row[TRIGRAMS + min(LENGTHS - 1, n.bit_length())] = MARK
        if n < 3:
            continue
        codes = kinds[:-2] * 1024 + kinds[1:-1] * 32 + kinds[2:]
        counts = np.bincount((codes * 2654435761 >> 7) % TRIGRAMS, minlength=TRIGRAMS)
        row[:TRIGRAMS] = np.sqrt(counts / (n - 2))
        repeats = int(2 * np.log2((n - 2) / np.count_nonzero(counts)))
        row[TRIGRAMS + LENGTHS + min(REPEATS - 1, repeats)] = MARK
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """Weights of the features, projection, unit vectors and labels of the labelled sample."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        return _unit(_unit(rows * self.weights) @ self.projection)

    def vote(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosines = self.project(features(texts)) @ self.vectors.T
        k = min(VOTERS, cosines.shape[1])
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        power = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** SHARPNESS
        total = power.sum(axis=1)
        votes = (power * self.labels[nearest]).sum(axis=1)
        return np.clip(np.where(total > 0, votes / np.maximum(total, 1e-300), self.labels.mean()), 0, 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of any number of texts, in blocks of bounded size."""
        done, block, held = [], [], 0
        for text in texts:
            block.append(text)
            held += len(text or "")
            if len(block) == BLOCK or held > BLOCK_BYTES:
                done.append(self.vote(block))
                block, held = [], 0
        return np.concatenate([*done, self.vote(block)]) if block or not done else np.concatenate(done)


def _principal(rows: np.ndarray, wanted: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    wanted = min(wanted, *rows.shape)
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], min(wanted + 16, rows.shape[1]))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :wanted]


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of a bounded sample of the labelled texts that are not held out."""
    labels = (labels.select("doc_id", "quality")
              .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("label")))
    chosen = bounded_sample(labels, sample_rows, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(sample: DataFrame) -> Model:
    """``sample``: doc_id, text, label. Features are counted by the tasks; the driver gets their non-zero entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                row = features([text])[0]
                at = np.flatnonzero(row).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([doc_id], pa.int64()), "label": pa.array([label], pa.int32()),
                    "at": pa.array([at.tobytes()]), "value": pa.array([row[at].tobytes()])})

    found = (sample.select("doc_id", "text", "label").mapInArrow(count, "doc_id long, label int, at binary, value binary")
             .toPandas().sort_values("doc_id"))
    rows = np.zeros((len(found), TRIGRAMS + LENGTHS + REPEATS), np.float32)
    for row, at, value in zip(rows, found["at"], found["value"]):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    if not len(rows):
        return Model(weights, np.zeros((rows.shape[1], 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0))
    weighted = _unit(rows * weights)
    projection = _principal(weighted, LATENT)
    return Model(weights, projection, _unit(weighted @ projection), found["label"].to_numpy(np.float64))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from text to score."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in texts:
            yield pd.Series(shared.value.score([None if pd.isna(x) else x for x in block]))

    return score


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    score = scorer(docs.sparkSession, fit(labelled(docs, labels, sample_rows)))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, least: float = ACCEPT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns."""
    score = scorer(docs.sparkSession, fit(labelled(docs, labels, sample_rows)))
    mark = free_name(docs, "score")
    return docs.withColumn(mark, score(F.col("text"))).where(F.col(mark) >= least).drop(mark)
