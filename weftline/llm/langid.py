"""Language identification: known words first, character n-grams of falling length for the others.

The model holds log frequencies by language of words and of character n-grams (with marks at the word's ends): all
that a bounded sample of labelled texts has. A known word adds its log frequency in each language to the text's score; an unseen word adds the mean of those of
its longest n-grams of which any is known: of length 5 if it has one, else 4, and so on to single characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import lean, written
from weftline.llm._text import column_bytes, mix64, row_ranges, span_hashes, stream64
from weftline.llm.bpe import _LETTER, _char_classes

LONGEST = 5
#: The model is learnt from about so many labelled rows, chosen by a hash of their text; with fewer, from all of them.
SAMPLE_ROWS = 20_000
#: A tenth of these is shared out evenly first: a rare language has its part of it, or all its rows if they are fewer.
EVEN = 10
UNKNOWN = "und"
_POINT = stream64(13, 0x110000 + 2)
_BEGIN, _END = 0x110000, 0x110001


class _Words:
    """The words (runs of letters, in lower case) of some texts: code points, starts, ends, rows and hashes."""

    def __init__(self, texts: list[str]) -> None:
        lower = [t.lower() for t in texts]
        text = "".join(lower)
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *map(len, lower)])
        n = len(self.points)
        letter = _char_classes()[self.points] == _LETTER
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begin, end = letter.copy(), letter.copy()
        begin[1:] &= ~letter[:-1] | cut[1:n]
        end[:-1] &= ~letter[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hashes = span_hashes(self.points, self.starts, self.ends, table=_POINT)

    def grams(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hashes, place in `words`) of the n-grams of some words, the longest first."""
        length = self.ends[words] - self.starts[words]
        edge = np.r_[0, np.cumsum(length + 2)]
        place = np.repeat(np.arange(len(words)), length + 2)
        at = np.arange(edge[-1]) - np.repeat(edge[:-1], length + 2)
        source = np.clip(np.repeat(self.starts[words], length + 2) + at - 1, 0, max(len(self.points) - 1, 0))
        padded = self.points[source].astype(np.int64)
        padded[at == 0] = _BEGIN
        padded[at == np.repeat(length + 1, length + 2)] = _END
        values = _POINT[padded]
        left = np.repeat(length + 2, length + 2) - at
        factor = stream64(17, LONGEST) | np.uint64(1)
        for n in range(LONGEST, 0, -1):
            m = max(len(values) - n + 1, 0)
            h = np.zeros(m, np.uint64)
            for j in range(n):
                h += values[j : j + m] * factor[j]
            whole = left[: len(h)] >= n
            if n == 1:
                whole &= (at[: len(h)] > 0) & (left[: len(h)] > 1)
            yield n, mix64(h[whole] + np.uint64(n)), place[: len(h)][whole]


def _count(texts: list[str], labels: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, 0 for words or the length of n-grams, hashes, counts)."""
    words = _Words(texts)
    names = sorted(set(labels))
    of = np.array([names.index(x) for x in labels], np.int64)[words.rows]
    for k, name in enumerate(names):
        own = np.flatnonzero(of == k)
        hashes, first, count = np.unique(words.hashes[own], return_index=True, return_counts=True)
        yield name, 0, hashes, count
        for n, grams, place in words.grams(own[first]):
            distinct, inverse = np.unique(grams, return_inverse=True)
            yield name, n, distinct, np.bincount(inverse, weights=count[place], minlength=len(distinct)).astype(np.int64)


def _texts(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets = column_bytes(column)
    for low, high in row_ranges(offsets, most):
        raw = data[offsets[low] : offsets[high]].tobytes()
        at = (offsets[low : high + 1] - offsets[low]).tolist()
        yield low, high, [raw[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]


class Model:
    """Log frequencies by language; at[n] are the sorted hashes of the words (n = 0) or n-grams, log[n] a row for each."""

    def __init__(self, languages: list[str], at: dict[int, np.ndarray], log: dict[int, np.ndarray], most_frequent: int) -> None:
        self.languages, self.at, self.log, self.most_frequent = languages, at, log, most_frequent

    def _find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.at[n]
        if not len(table):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return place, table[place] == hashes

    def scores(self, words: _Words, rows: int) -> np.ndarray:
        """The sum of the words' scores by row and language."""
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        own = np.zeros((len(distinct), len(self.languages)))
        place, known = self._find(0, distinct)
        own[known] = self.log[0][place[known]]
        left = np.flatnonzero(~known)
        if len(left):
            done = np.zeros(len(left), bool)
            for n, grams, of in words.grams(first[left]):
                todo = ~done[of]
                grams, of = grams[todo], of[todo]
                place, known = self._find(n, grams)
                count = np.bincount(of[known], minlength=len(left))
                got = count > 0
                for k in range(len(self.languages)):
                    total = np.bincount(of[known], weights=self.log[n][place[known], k], minlength=len(left))
                    own[left[got], k] = total[got] / count[got]
                done |= got
                if done.all():
                    break
        return np.stack([np.bincount(words.rows, weights=own[inverse, k], minlength=rows) for k in range(len(self.languages))], axis=1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the posterior of the language under equal priors, or 0 for a text without letters."""
        words = _Words(texts)
        has = np.bincount(words.rows, minlength=len(texts)) > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = self.scores(words, len(texts))
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        score = 1 / np.exp(total - top[:, None]).sum(axis=1)
        best = np.where(np.ptp(total, axis=1) == 0, self.most_frequent, best)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def sample_rates(by_label: dict[str, int], sample_rows: int) -> dict[str, float]:
    """The share of each label's rows in a sample of so many: in proportion, but no label has less than its part of the even tenth."""
    floor = max(1, sample_rows // (EVEN * len(by_label)))
    total = sum(by_label.values())
    rare = {x for x, n in by_label.items() if n * sample_rows < floor * total}
    left = sample_rows - sum(min(by_label[x], floor) for x in rare)
    common = left / max(1, sum(n for x, n in by_label.items() if x not in rare))
    return {x: min(1.0, floor / n if x in rare else common) for x, n in by_label.items()}


def train(df: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the rows with text and label. Counting is distributed; the driver gets the counts of the sample's
    words and n-grams, so sample_rows bounds the model. Repeated rows count each; rows with a null text or label are left out;
    without any row the model has no language."""
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"))
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sum(by_label.values()) > sample_rows:
        limit = F.create_map(*[F.lit(x) for name, rate in sample_rates(by_label, sample_rows).items() for x in (name, int(1_000_000 * rate))])
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < limit[F.col("label")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for low, high, texts in _texts(batch.column(0)):
                for name, n, hashes, counts in _count(texts, labels[low:high]):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(hashes), pa.string()), pa.array(np.full(len(hashes), n), pa.int32()), pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["label", "n", "key", "c"])

    counts = rows.mapInArrow(run, "label string, n int, key long, c long").groupBy("label", "n", "key").agg(F.sum("c").alias("c"))
    counts = written(counts, "language-counts")
    totals = counts.groupBy("label", "n").agg(F.sum("c").alias("total")).toArrow().to_pydict()
    total_of = {(a, b): t for a, b, t in zip(totals["label"], totals["n"], totals["total"], strict=True)}
    names = sorted({a for a, _ in total_of})
    model = counts.toArrow()
    kinds, keys, label, c = (model[x].to_numpy() for x in ("n", "key", "label", "c"))
    number = {x: i for i, x in enumerate(names)}
    of = np.array([number[x] for x in label], np.int64)
    at, log = {}, {}
    for n in range(LONGEST + 1):
        own = kinds == n
        at[n], row = np.unique(keys[own].view(np.uint64), return_inverse=True)
        table = np.full((len(at[n]), len(names)), 0.5)
        np.add.at(table, (row, of[own]), c[own].astype(float))
        size = np.array([total_of.get((x, n), 0) for x in names], float) + 0.5 * max(len(at[n]), 1)
        log[n] = np.log(table / size).astype(np.float64)
    words = [total_of.get((x, 0), 0) for x in names]
    return Model(names, at, log, int(np.argmax(words)) if names else 0)


def identify(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and a score from 0 to 1.

    A null text and one without a letter get `und` and 0; so do all texts if the model has no language. A text with letters
    of which neither a word nor an n-gram is known gets the language with most words in the sample. Repeated rows are judged
    alike; other columns pass through, and those with the names of the output are replaced. An empty table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (lang, score)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    at = kept.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in _texts(batch.column(at)):
                languages, scores = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(languages, pa.string()), pa.array(scores)], schema.names)

    return df.select(*kept).mapInArrow(run, schema)
