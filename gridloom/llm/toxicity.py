"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import bounded_batches, table

BITS = 22
#: Labelled rows that the model is fitted on at most: those whose hashed ids come first.
SAMPLE = 16_384
PASSES = 3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Distinct words that a worker remembers the hashes of before it starts anew.
REMEMBERED = 150_000


class Features:
    """Text to the sorted distinct hashes of its words, pairs of neighbours, and pairs with one word between."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, int] = {}
        self.words = re.compile(r"\w+").findall

    def __call__(self, text: str) -> np.ndarray:
        words, known = self.words(text.lower()), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        turn = np.uint64(0x9E3779B97F4A7C15)
        near = (h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) * turn
        skip = (h[:-2] * np.uint64(0xA0761D6478BD642F) + h[2:]) * turn
        return np.unique(np.concatenate((h * turn, near, skip)) >> self.shift).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """The weights that are not 0: few enough to send to every worker (2^bits floats at most)."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


class Ftrl:
    """FTRL-proximal with a rate for each coordinate and L1 sparsity; one example at a time."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, 1 << self.bits)  # the last coordinate is the bias
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        index = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return Model(self.bits, float(self.weights(np.array([1 << self.bits]))[0]), index, self.weights(index).astype(np.float32))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled_labels(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id and label (1 if any row of the id says so) of at most ``size`` ids outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(size)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, bits: int = BITS, passes: int = PASSES) -> Model:
    """Fit on the texts of ``sampled_labels``, ``passes`` times over in a fixed order, in one task.

    The sample (at most ``size`` ids and labels) is broadcast; features are hashed where the texts are and come to the task once for
    each pass, so it holds 2^bits coordinates and a batch of rows, however long the texts are. An id counts once however many rows repeat it, with
    the least of its texts; ids without a document are left out. Without any label, the model has no weight and scores 0.5.
    """
    bounded_batches(docs.sparkSession)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sampled_labels(labels, size)), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # repeats collapse before the shuffle

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for b in batches:
            rows = [features(x).astype("<i4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(hashed, "doc_id long, label int, features binary")
    rows = rows.select(F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"), F.xxhash64("doc_id", F.lit(2)).alias("turn"), "doc_id", "label", "features")
    rows = rows.repartition(1).sortWithinPartitions("pass", "turn", "doc_id").select("label", "features")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ftrl = Ftrl(bits)
        for b in batches:
            for label, features in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ftrl.learn(np.frombuffer(features, "<i4"), label)
        m = ftrl.model()
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.index.astype("<i4").tobytes()]), pa.array([m.weight.astype("<f4").tobytes()])], ["bias", "at", "weight"])

    found = rows.mapInArrow(fit, "bias double, at binary, weight binary").collect()
    bias, at, weight = found[0] if found else (0.0, b"", b"")  # no row to learn from: no task runs
    return Model(bits, bias, np.frombuffer(at, "<i4"), np.frombuffer(weight, "<f4"))


def scored(rows: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``rows`` and the score of the whole text as ``name``; null text counts as empty and scores by the bias alone.

    No shuffle: the weights are broadcast and each document is scored where it is read. A column that is
    called ``name`` already is replaced.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.drop(name)
    sent, place = spark.sparkContext.broadcast(model), rows.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, features, bias = sent.value.dense(), Features(sent.value.bits), sent.value.bias
        for b in batches:
            sums = np.array([weight[features(x or "")].sum(dtype=np.float64) for x in b.column(place).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))))], [*b.schema.names, name])

    return rows.mapInArrow(judge, StructType([*rows.schema, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, model).select("doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE_SQL = None
