"""Quality classifier on document statistics: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a few statistics (shares of byte classes, lengths of words and lines, repeated words and lines). Standardised by the training rows' means and deviations, they go through random Fourier features, cosines at random frequencies whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal equations; the sums, of a size that does not depend on the rows, are added up by an aggregation and solved on the driver. Scores of the training rows, each by weights from the half of the rows that it is not in, counted in fixed bins, give the isotonic fit (pool adjacent violators) that turns a ridge score into the share of label 1 at it.

Learning reads the table of labels and the statistics only; identifier, language and source never enter. All labelled rows that are not held out are used.

Cases: a null or empty text has statistics of its own and is scored like any other; a very long text is one slice of its own; repeated rows are scored alike and each is learnt from; an identifier that is labelled twice counts with its larger label, a null label not at all; without any training row, as in an empty table, every score is 0.5; other columns of the input stay as they are, but those that the result adds replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shared import keep, table
from .textbytes import distinct, hashes, slices, spans

FEATURES, SEED, RIDGE, BINS, CUT = 256, 8, 0.001, 2000, 0.7
_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "bang", "bar", "mark", "other", "high")


def _classes() -> np.ndarray:
    found = np.full(256, 9, np.uint8)
    found[97:123], found[65:91], found[48:58], found[128:] = 0, 1, 2, 10
    for k, chars in ((3, " \t\v\f"), (4, "\n\r"), (5, ".,;:'\"?-()"), (6, "!"), (7, "|"), (8, "#$%&*+=<>@^_~{}[]\\/`")):
        found[[ord(c) for c in chars]] = k
    return found


CLASS = _classes()
NAMES = [f"share_{c}" for c in _CLASSES] + ["log_bytes", "word_bytes", "word_bytes_sd", "distinct_words", "repeated_words", "top_run", "line_words", "distinct_lines", "bang_words", "mark_words"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    share = np.bincount(owner * len(_CLASSES) + CLASS[data], minlength=rows * len(_CLASSES)).reshape(rows, -1) / np.maximum(1, size)[:, None]
    start, end, row = spans(data, offsets)
    words = np.bincount(row, minlength=rows)
    per = np.maximum(1, words)
    long = (end - start).astype(float)
    mean = np.bincount(row, long, rows) / per
    sd = np.sqrt(np.maximum(0, np.bincount(row, long * long, rows) / per - mean * mean))
    value = hashes(data, start, end)
    kinds = np.bincount(distinct(value, row)[1], minlength=rows) / per
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    repeated = np.bincount(row, same, rows) / per
    # The longest run of one word, as a share of the words' logarithm.
    run = np.zeros(rows)
    if len(value):
        heads = np.flatnonzero(~same)
        np.maximum.at(run, row[heads], np.diff(np.append(heads, len(value))))
    breaks = np.zeros(256, bool)
    breaks[[10, 13]] = True
    ls, le, lrow = spans(data, offsets, breaks)
    lines = np.maximum(1, np.bincount(lrow, minlength=rows))
    line_kinds = np.bincount(distinct(hashes(data, ls, le), lrow)[1], minlength=rows) / lines
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    bang = np.bincount(row, CLASS[last] == 6, rows) / per
    mark = np.bincount(row, CLASS[last] == 8, rows) / per
    return np.column_stack([share, np.log1p(size), mean, sd, kinds, repeated, np.log1p(run), np.log1p(words / lines), line_kinds, bang, mark])


def frequencies(seed: int = SEED, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / np.sqrt(2 * len(NAMES) / 4), (len(NAMES), features)), rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, seed: int = SEED, features: int = FEATURES) -> np.ndarray:
    """Standardised statistics, cut at 6 deviations, to cosines, with a column of ones."""
    w, b = frequencies(seed, features)
    z = np.clip((x - mean) / sd, -6, 6)
    return np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / features), np.ones(len(x))])


def isotonic(count: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising sequence nearest to hits / count, weighted by count; empty bins take the value before them."""
    blocks: list[list[float]] = []
    for n, h in zip(count.tolist(), hits.tolist(), strict=True):
        blocks.append([n, h, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, h2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + h2, blocks[-1][2] + k2]
    values = [h / n if n else 0.5 for n, h, _ in blocks]
    return np.repeat(values, [int(k) for _, _, k in blocks])


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    curve: np.ndarray  # the calibrated score in each of the bins between low and high

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.sd) @ self.weights

    def bin(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * len(self.curve), 0, len(self.curve) - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.curve[self.bin(self.raw(x))]


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, x: one row for each row of docs. carry: a numeric column of docs that goes along as row_id."""
    more = ["row_id"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel())), *(part.column(c) for c in more)], ["doc_id", "x", *more])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text"), *([F.col(carry).cast("bigint").alias("row_id")] if carry else []))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>" + ", row_id bigint" * len(more))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return np.array(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def fit(stats: DataFrame, labels: DataFrame, label: str, learn: Column) -> Model | None:
    """learn: which rows of stats (by doc_id) may be learnt from. None without training rows."""
    truth = labels.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).where("y is not null")
    train = keep(stats.where(learn).join(truth, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")), "quality-train")
    n = len(NAMES)
    row = train.agg(F.count("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    if not row[0]:
        return None
    mean, sd = np.array(row[1 : n + 1], float), np.maximum(1e-6, np.array(row[n + 1 :], float))
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, right = np.zeros((2, size, size)), np.zeros((2, size))
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                phi, y, fold = fourier(matrix(part), mean, sd), np.array(part.column("y")), np.array(part.column("fold"))
                for k in range(2):
                    total[k] += phi[fold == k].T @ phi[fold == k]
                    right[k] += phi[fold == k].T @ y[fold == k]
        values = np.concatenate([np.concatenate([total[k][upper], right[k]]) for k in range(2)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "v"])

    found = train.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow().column("v").to_numpy().reshape(2, -1)

    def solved(sums: np.ndarray) -> np.ndarray:
        gram = np.zeros((size, size))
        gram[upper] = sums[: len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        return np.linalg.solve(gram + RIDGE * max(1, gram[-1, -1]) * np.eye(size) / size, sums[len(upper[0]) :])

    def of(weights: np.ndarray) -> Model:
        return Model(mean, sd, weights, -0.5, 1.5, np.zeros(BINS))

    model, halves = of(solved(found.sum(axis=0))), [of(solved(found[1])), of(solved(found[0]))]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            x, y, fold = matrix(batch), np.array(batch.column("y")), np.array(batch.column("fold"))
            for k in range(2):  # each half by the weights that the other half gave
                at = halves[k].bin(halves[k].raw(x[fold == k]))
                n += np.bincount(at, minlength=BINS)
                hits += np.bincount(at, y[fold == k], BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(hits)], ["at", "n", "hits"])

    bins = train.mapInArrow(counts, "at bigint, n double, hits double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).orderBy("at").toArrow()
    model.curve = np.clip(isotonic(bins.column("n").to_numpy(), bins.column("hits").to_numpy()), 0, 1)
    return model


def scored(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text_col):
                score = model.score(statistics(data, offsets)) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def scored_statistics(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted (and row_id, if there) from statistics_of."""
    more = [c for c in ("row_id",) if c in stats.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch)) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= CUT).astype(np.int32)), *(batch.column(c) for c in more)], ["doc_id", "score", "predicted", *more])

    return stats.mapInArrow(run, "doc_id bigint, score double, predicted int" + ", row_id bigint" * len(more))


def remainder(n: int) -> Column:
    """crc32 of the identifier as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op8_fourier_quality(spark, sf_dir: str) -> DataFrame:
    stats = keep(statistics_of(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(stats, table(spark, sf_dir, "labels"), "quality", remainder(4) != 2)
    return scored_statistics(stats, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")
