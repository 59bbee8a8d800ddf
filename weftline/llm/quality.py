"""Document quality by ordinal cumulative-link regression on graded ratings.

A text has one latent score: the sum of the weights of its hashed features (its distinct words and their stems, and coarse measures of its
shape: how often marks, capitals, digits, line ends, repeated and distinct words occur). Ordered thresholds cut the
score's line into grades, P(grade <= j) = 1 / (1 + exp(score - threshold j)), so the same weights give the expected grade
and the probability of each tail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import lean, unused
from weftline.llm._text import ALNUM, LOWER, NOT_SPACE, column_bytes, mix64, row_ranges, span_hashes, stream64, word_spans

#: Longer words also count by their first bytes.
STEMS = (6, 7)
#: Weights are shared by features of one hash modulo 2 ** BITS.
BITS = 18
#: The model is fitted on about so many rated documents, chosen by a hash of their id; with fewer, on all of them.
SAMPLE_ROWS = 12_000
#: Features of fewer rated documents get no weight.
LEAST_DOCUMENTS = 3
#: So do features whose share of low grades lies less than so many standard errors from that of all.
TELLING = 4.0
ROUNDS, RATE, SHRINK = 150, 0.1, 0.1


def _bucket(part: np.ndarray, whole: np.ndarray, steps: int = 12) -> np.ndarray:
    """A ratio on a coarse logarithmic scale; 0 for none."""
    ratio = part / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(np.floor(np.log2(ratio * 1024 + 1)) + 1, 1, steps), 0).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, features): the distinct hashed features of each row."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, ALNUM)
    words = span_hashes(low, starts, ends)
    stems, stem_rows = [], []
    for salt, k in zip(stream64(223, len(STEMS)), STEMS, strict=True):
        long = np.flatnonzero(ends - starts > k)
        stems.append(mix64(span_hashes(low, starts[long], starts[long] + k) ^ salt))
        stem_rows.append(rows[long])
    begin, end, of = word_spans(low, offsets, NOT_SPACE)
    runs = span_hashes(low, begin, end)
    n_runs = np.bincount(of, minlength=n)
    lengths = np.diff(offsets)
    shapes: list[np.ndarray] = []
    row = np.repeat(np.arange(n), lengths)
    plain = data < 128
    count = np.bincount(row[plain] * 128 + data[plain], minlength=n * 128).reshape(n, 128)
    salts = iter(stream64(211, 256))

    def add(value: np.ndarray) -> None:
        shapes.append(mix64(value.astype(np.uint64) + next(salts)))

    for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]:
        add(_bucket(count[:, c], n_runs))
    upper, lower = count[:, 65:91].sum(axis=1), count[:, 97:123].sum(axis=1)
    add(_bucket(upper, upper + lower))
    add(_bucket(count[:, 48:58].sum(axis=1), lengths))
    add(_bucket(count[:, 10], n_runs))
    again = np.zeros(len(of), bool)
    again[1:] = (runs[1:] == runs[:-1]) & (of[1:] == of[:-1])
    add(_bucket(np.bincount(of[again], minlength=n), n_runs))
    if len(of):
        order = np.lexsort((runs, of))
        first = np.r_[True, (runs[order][1:] != runs[order][:-1]) | (of[order][1:] != of[order][:-1])]
        distinct = np.bincount(of[order][first], minlength=n)
        times = np.diff(np.r_[np.flatnonzero(first), len(of)])
        most = np.zeros(n, np.int64)
        np.maximum.at(most, of[order][first], times)
    else:
        distinct = most = np.zeros(n, np.int64)
    size = np.minimum(np.floor(np.log2(n_runs + 1)), 14)
    add(np.floor(10 * distinct / np.maximum(n_runs, 1)) * 16 + size)
    add(np.floor(10 * most / np.maximum(n_runs, 1)) * 16 + np.minimum(size, 5))
    keys = np.concatenate([words, *stems, *shapes]) >> np.uint64(64 - BITS)
    owner = np.concatenate([rows, *stem_rows, *[np.arange(n)] * len(shapes)])
    both = np.unique(owner.astype(np.int64) << BITS | keys.astype(np.int64))
    return np.searchsorted(both >> BITS, np.arange(n + 1)), (both & (1 << BITS) - 1).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights and ascending thresholds; grades run from 0 to len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def score(self, offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(self.weights[found])]
        return total[offsets[1:]] - total[offsets[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., a column each."""
        return _sigmoid(score[:, None] - self.thresholds)

    @classmethod
    def fit(cls, offsets: np.ndarray, found: np.ndarray, grades: np.ndarray, n_grades: int) -> OrdinalModel:
        """Most likely weights under a Gaussian prior, by Adam over all rows; the same rows in the same order give the same model."""
        size = 1 << BITS
        told = np.zeros(size, bool)
        own = np.repeat(np.arange(len(grades)), np.diff(offsets))
        count = np.bincount(found, minlength=size).astype(float)
        for j in range(n_grades - 1):
            low = (grades <= j).mean()
            seen = np.bincount(found, weights=grades[own] <= j, minlength=size)
            told |= np.abs(seen - count * low) >= TELLING * np.sqrt(np.maximum(count * low * (1 - low), 1e-9))
        kept = (told & (count >= LEAST_DOCUMENTS))[found]
        lengths = np.bincount(own[kept], minlength=len(grades))
        found = found[kept]
        edge = np.r_[0, np.cumsum(lengths)]
        columns, place = np.unique(found, return_inverse=True)
        n, steps = len(grades), n_grades - 1
        share = np.array([(grades <= j).sum() + 1 for j in range(steps)]) / (n + 2)
        start = np.log(share / (1 - share))
        # first threshold, then the logarithms of the gaps
        cuts = np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
        w = np.zeros(len(columns))
        moments = [[np.zeros(len(columns)), np.zeros(steps)] for _ in range(2)]
        rows = np.arange(n)
        for t in range(1, ROUNDS + 1):
            gaps = np.exp(cuts[1:])
            thresholds = cuts[0] + np.r_[0.0, np.cumsum(gaps)]
            total = np.r_[0.0, np.cumsum(w[place])]
            score = total[edge[1:]] - total[edge[:-1]]
            below = np.concatenate([np.zeros((n, 1)), _sigmoid(thresholds - score[:, None]), np.ones((n, 1))], axis=1)
            high, low = below[rows, grades + 1], below[rows, grades]
            p = np.maximum(high - low, 1e-12)
            by_score = -(high + low - 1)
            by_cut = np.zeros(steps)
            np.add.at(by_cut, np.minimum(grades, steps - 1), np.where(grades < steps, -high * (1 - high) / p, 0))
            np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, low * (1 - low) / p, 0))
            tail = np.cumsum(by_cut[::-1])[::-1]
            slope = [np.bincount(place, weights=np.repeat(by_score, lengths), minlength=len(columns)) / n + SHRINK / n * w, np.r_[tail[:1], tail[1:] * gaps] / n]
            for k, x in enumerate((w, cuts)):
                moments[0][k] = 0.9 * moments[0][k] + 0.1 * slope[k]
                moments[1][k] = 0.999 * moments[1][k] + 0.001 * slope[k] ** 2
                x -= RATE * (moments[0][k] / (1 - 0.9**t)) / (np.sqrt(moments[1][k] / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(size)
        weights[columns] = w
        return cls(weights, cuts[0] + np.r_[0.0, np.cumsum(np.exp(cuts[1:]))])


def train(df: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text: str = "text", grade: str = "grade", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """Fits the model on documents with ratings (id_col, grade from 0 to n_grades - 1); None without any.

    Rows with a null id or grade are left out; each of several ratings of a document counts. The driver gets the features
    of about sample_rows documents at most, whatever the input's size.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade).between(0, n_grades - 1)).select(F.col(id_col).alias("i"), F.col(grade).cast("int").alias("g"))
    total = rated.count()
    if total > sample_rows:
        rated = rated.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    rows = df.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(rated), "i")  # of a bounded size by the sample

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for low, high in row_ranges(offsets, 2 << 20):
                at, found = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))], ["i", "g", "f"])

    kind = T.StructType([T.StructField("i", rated.schema["i"].dataType), T.StructField("g", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])
    got = rows.select("i", "g", "t").mapInArrow(run, kind).toArrow().combine_chunks()
    if not got.num_rows:
        return None
    got = got.take(pc.sort_indices(got, [("i", "ascending"), ("g", "ascending")]))
    lists = got["f"].combine_chunks()
    return OrdinalModel.fit(np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten()), got["g"].to_numpy(), n_grades)


def grade(df: DataFrame, model: OrdinalModel | None, text: str = "text", n_grades: int = 3, tails: str = "tails") -> DataFrame:
    """df with expected_grade and, in the column named by tails, an array (the probability of grade >= 1, >= 2, ...).

    Null and empty texts are graded by the shape of an empty text. Without a model both columns are null. Repeated rows are
    graded alike; other columns pass through, and those with the names of the output are replaced. An empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in ("expected_grade", tails)]
    df = df.select(*kept)
    if model is None:
        return df.withColumn("expected_grade", F.lit(None).cast("double")).withColumn(tails, F.lit(None).cast("array<double>"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema, T.StructField("expected_grade", T.DoubleType()), T.StructField(tails, T.ArrayType(T.DoubleType()))])
    at = kept.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            for low, high in row_ranges(offsets, 2 << 20):
                edge, found = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                p = sent.value.tails(sent.value.score(edge, found))
                n, k = p.shape
                yield pa.RecordBatch.from_arrays([*batch.slice(low, n).columns, pa.array(p.sum(axis=1)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(p.ravel()))], schema.names)

    return df.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from binary labels: 0 for toxic, else 1 for low quality and 2 for good. A row without any of them has none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def select(df: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """df with expected_grade, p_harmless (P(grade >= 1)), p_good (P(grade >= 2)) and kept: p_good is at least `least`.
    Columns of these names are replaced; others pass through. Without any rated document all is kept and the other columns are null."""
    model = train(df, ratings_of(labels), 3)
    outputs = ("expected_grade", "p_harmless", "p_good", "kept")
    kept = [c for c in df.columns if c not in outputs]
    tails = unused(df.columns, "tails")
    rows = grade(df.select(*kept), model, tails=tails)
    p = [F.get(F.col(tails), F.lit(j)) for j in (0, 1)]
    return rows.select(*kept, "expected_grade", p[0].alias("p_harmless"), p[1].alias("p_good"), F.coalesce(p[1] >= least, F.lit(True)).alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of df, with all their columns whatever their names, that `select` keeps; a null or empty text is judged like any other."""
    whole = df.select(F.col("doc_id"), F.col("text"), F.struct(*df.columns).alias("row"))
    return select(whole, labels, least).where("kept").select("row.*")
