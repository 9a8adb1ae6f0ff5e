"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

*Terms* of a text are its byte trigrams, hashed to ``BUCKETS`` terms, and how
often a word repeats the word 1 to ``LAGS`` places before it.  Their weights
are the square root of the term's share times its inverse document frequency,
which is counted over all documents of the table.

*Latent space*: the right singular vectors of the labelled documents' term
matrix.  Labelled documents are bounded by ``MAX_LABELLED`` (beyond it the
hash of the id decides); counts and scores cover all rows.

*Vote*: the labelled vectors are broadcast (at most MAX_LABELLED x DIMENSIONS
numbers).  Every document's cosine with every labelled vector is computed
exactly, block by block, as a matrix product; the ``NEIGHBOURS`` nearest vote
with the ``SHARPNESS`` power of their cosine.

A text without terms (null, empty) has no neighbour and gets the share of
good labels.  Without any label the score is 0.5.  Null labels and labels of
unknown documents are not used; of several labels of one document the lowest
counts.  Repeated rows get equal scores.  Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqyield.llm.common import free_names, hash_sample, id_text, whole

BUCKETS, LAGS = 2048, 4
TERMS = BUCKETS + LAGS
DIMENSIONS = 64
MAX_LABELLED = 4096
NEIGHBOURS, SHARPNESS = 15, 8
#: Share of its words from which a document counts as one that repeats words.
REPEATS = 0.1


def terms(text: bytes) -> np.ndarray:
    """Shares of the terms of one UTF-8 text."""
    out = np.zeros(TERMS, np.float32)
    words = text.split()
    if not words:
        return out
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, len(data) - 2, 1 << 20):
        part = data[at:at + (1 << 20) + 2].astype(np.uint32)
        codes = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
        out[:BUCKETS] += np.bincount(codes >> np.uint32(32 - 11), minlength=BUCKETS)
    out[:BUCKETS] /= len(data) - 2
    for lag in range(1, LAGS + 1):
        out[BUCKETS + lag - 1] = sum(map(bytes.__eq__, words, words[lag:])) / len(words)
    return out


@dataclass
class Model:
    """What the tasks need; its size is bounded by the constants above."""
    weight: np.ndarray      # of each term
    basis: np.ndarray       # TERMS x dimensions
    vectors: np.ndarray     # labelled documents x dimensions, unit length
    labels: np.ndarray
    neighbours: int = NEIGHBOURS
    sharpness: float = SHARPNESS

    def latent(self, shares: np.ndarray) -> np.ndarray:
        """Unit vectors of term shares; zero where there are no terms."""
        found = (np.sqrt(shares) * self.weight) @ self.basis
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, shares: np.ndarray) -> np.ndarray:
        prior = self.labels.mean() if len(self.labels) else 0.5
        out = np.full(len(shares), prior)
        if not len(self.labels) or not len(shares):
            return out
        cosine = self.latent(shares) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** self.sharpness
        total = vote.sum(axis=1)
        some = total > 1e-12
        out[some] = (vote * self.labels[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Over all rows: their number, and in how many each term occurs."""
    def count(batches):
        total, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py())
                total += np.concatenate([found[:BUCKETS] > 0, found[BUCKETS:] >= REPEATS])
                rows += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(-1, TERMS)),
                                          "n": pa.array(np.concatenate([[rows], total]))})

    summed = (docs.select(whole(text_col).cast("binary").alias("text")).mapInArrow(count, "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(TERMS + 1, np.int64)
    out[summed["term"].to_numpy(np.int64) + 1] = summed["n"].to_numpy(np.int64)
    return out


def singular_basis(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    width = min(dimensions + 16, *matrix.shape)
    found = np.random.default_rng(7).standard_normal((matrix.shape[1], width)).astype(np.float32)
    for _ in range(4):
        found = np.linalg.qr(matrix.T @ (matrix @ found))[0]
    _, _, turn = np.linalg.svd(matrix @ found, full_matrices=False)
    return (found @ turn.T)[:, :dimensions]


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED,
        dimensions: int = DIMENSIONS) -> Model:
    """Fit on the labelled rows of ``docs`` for which ``train`` (over docs) holds."""
    frequency = document_frequencies(docs, text_col)
    weight = (1 + np.log((1 + frequency[0]) / (1 + frequency[1:]))).astype(np.float32)
    given = (labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
             .groupBy(F.col(label_id).alias("label_id")).agg(F.min(label_col).alias("label")))
    # The hash alone picks the rows, so the texts are read for the chosen ones only.
    teaching = docs.where(train).select(F.col(id_col).alias("label_id")).distinct().join(given, "label_id")
    chosen = hash_sample(teaching, F.col("label_id").cast("string"), teaching.count(), max_labelled)
    picked = docs.select(F.col(id_col).alias("label_id"), whole(text_col).cast("binary").alias("text")).join(
        F.broadcast(chosen), "label_id").dropDuplicates(["label_id", "text"])

    def shares(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "label": batch.column(2).cast(pa.float64()),
                "shares": pa.array([terms(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())})

    kind = picked.schema["label_id"].dataType.simpleString()
    rows = picked.select("label_id", "text", "label").mapInArrow(
        shares, f"id {kind}, label double, shares binary").toPandas()
    rows = rows.assign(key=rows["id"].astype(str)).sort_values(["key", "shares"], kind="stable")
    matrix = np.frombuffer(b"".join(rows["shares"]), np.float32).reshape(-1, TERMS)
    some = matrix.any(axis=1)
    matrix, marks = matrix[some], rows["label"].to_numpy(float)[some]
    if not len(matrix):
        return Model(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), marks)
    model = Model(weight, singular_basis(np.sqrt(matrix) * weight, dimensions), matrix[:0, :1], marks)
    model.vectors = model.latent(matrix)
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score",
                block: int = 512) -> DataFrame:
    """``docs`` with the score of every text."""
    raw, = free_names(docs, ["__raw"])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                shares = np.stack([terms(t.as_py()) for t in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.scores(shares))],
                                                 names=schema.names)

    return docs.withColumn(raw, whole(text_col).cast("binary")).mapInArrow(score, schema)


def training_rows(id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> Column:
    """Rows that may teach: CRC-32 of the id as text modulo ``folds`` is not ``held_out``."""
    return F.crc32(id_text(id_col).cast("binary")) % folds != held_out


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``."""
    score, = free_names(docs, ["__score"])
    model = fit(docs, labels, training_rows(id_col), id_col, text_col)
    return with_scores(docs, model, text_col, score).where(F.col(score) >= threshold).select(
        *[F.col(f"`{c}`") for c in docs.columns])
