"""Benchmark decontamination over a distributed positional inverted index.

`build_index` cuts the documents into blocks and stores, block by block, the postings of their words: for each
term the ascending word positions in the block, gap-coded, with the positions at which documents start. A stored
block is a table row, so the index is dealt over the cluster as the documents are, holds no list longer than a
block, and is reread, not recomputed, when an executor is lost.

`search` takes a set of phrases to every block. There it orders a phrase's terms by the length of their lists,
takes the positions of the rarest, less its offset in the phrase, as candidate starts, and intersects them with the
offset-adjusted lists of the other terms, the rarer first. With `slop` 0 a start that survives all terms is an exact
phrase match; with `slop` s each term may lie up to s words from its place (a proximity match).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import FILTER_BITS, filter_of, lean, matching, written
from weftline.llm._text import ALNUM, LOWER, column_bytes, list_array, row_ranges, span_hashes, word_spans

#: Words in a window of a test item.
WINDOW = 13
#: Test items are taken in parts of about so many bytes of text, one after another; the driver and the executors hold the windows of one part.
PART_BYTES = 4 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the rows with A-Z lower-cased."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), rows


class Phrases:
    """Distinct phrases (rows of term numbers, by length) and the items that hold each; terms are sorted hashes.

    names: an id for each item; words[at[i]:at[i + 1]] are the hashes of item i's words.
    """

    def __init__(self, names: list[str], words: np.ndarray, at: np.ndarray, window: int = WINDOW) -> None:
        self.names = pa.array(names, pa.string())
        self.terms, number = np.unique(words, return_inverse=True)
        number, length = number.astype(np.int32), np.diff(at)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = np.minimum(length, window)
        for k in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == k)
            windows = length[own] - k + 1
            item = np.repeat(own, windows)
            start = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + at[item]
            phrases, which = np.unique(np.lib.stride_tricks.sliding_window_view(number, k)[start], axis=0, return_inverse=True)
            both = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
            self.groups.append((phrases, np.searchsorted(both[:, 0], np.arange(len(phrases) + 1)), both[:, 1]))


def _near(lists: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
    """Whether a sorted list has a value within slop of each of at."""
    k = np.searchsorted(lists, at - slop)
    return (k < len(lists)) & (lists[np.minimum(k, len(lists) - 1)] <= at + slop)


def _block_matches(terms: np.ndarray, list_at: np.ndarray, positions: np.ndarray, phrases: Phrases, slop: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(starts, length, items) of each phrase with matches in a block; starts may still cross documents."""
    number = np.searchsorted(phrases.terms, terms)
    number = np.minimum(number, max(len(phrases.terms) - 1, 0))
    known = phrases.terms[number] == terms if len(phrases.terms) else np.zeros(len(terms), bool)
    place = np.full(len(phrases.terms), -1)
    place[number[known]] = np.flatnonzero(known)
    count = np.zeros(len(phrases.terms), np.int64)
    count[number[known]] = (list_at[1:] - list_at[:-1])[known]
    for numbers, item_at, items in phrases.groups:
        counts = count[numbers]
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        order = np.argsort(counts[alive], axis=1, kind="stable")
        for row, by_rarity in zip(alive.tolist(), order.tolist(), strict=True):
            lists = place[numbers[row]].tolist()
            first = by_rarity[0]
            starts = positions[list_at[lists[first]] : list_at[lists[first] + 1]] - first
            for j in by_rarity[1:]:
                starts = starts[_near(positions[list_at[lists[j]] : list_at[lists[j] + 1]], starts + j, slop)]
                if not len(starts):
                    break
            if len(starts):
                yield starts, len(by_rarity), items[item_at[row] : item_at[row + 1]]


def _listed(bits: np.ndarray | None, words: np.ndarray) -> np.ndarray:
    """Whether the bit of each word is set; all words without a filter."""
    if bits is None:
        return np.ones(len(words), bool)
    place = words & np.uint64(FILTER_BITS - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def build_index(df: DataFrame, id_col: str = "doc_id", text: str = "text", wanted: DataFrame | None = None, block: int = 4 << 20, name: str = "postings") -> DataFrame:
    """Stores the positional index of the texts and returns it as a table, a row for each block of documents.

    wanted: word hashes (column `word`); only the words of these, and those that share a bit with one in a filter of a fixed
    size, are indexed; None for all. Null and empty texts are rows without words. Repeated rows and ids are kept as rows of
    their own. Texts may be of any length: a block has one document at least. An empty table gives an empty index.
    """
    bits = None if wanted is None else filter_of(wanted, "word")
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(t)) for c, t in (("row_at", T.IntegerType()), ("term", T.LongType()), ("list_at", T.IntegerType()), ("gap", T.IntegerType())))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for low, high in row_ranges(offsets, block):
                words, rows = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                row_at = np.searchsorted(rows, np.arange(high - low + 1))
                at = np.arange(len(words))
                at = at[_listed(bits, words)]
                order = at[np.argsort(words[at], kind="stable")]
                term, first = np.unique(words[order], return_index=True)
                list_at = np.r_[first, len(order)]
                gap = np.diff(order, prepend=0)
                gap[first] = order[first]
                one = [pa.array([f"{part}-{n}"]), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (batch.column(0).slice(low, high - low), *(pa.array(x, t) for x, t in ((row_at, pa.int32()), (term.view(np.int64), pa.int64()), (list_at, pa.int32()), (gap, pa.int32())))))]
                n += 1
                yield pa.RecordBatch.from_arrays(one, schema.names)

    return written(df.select(id_col, text).mapInArrow(run, schema), name)


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """For each row of the indexed table that has a match: block, row (its number there), id, starts and lengths of the words that
    matches cover, as ascending disjoint spans, and items (names of the items that have a match there)."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("id", kind), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "lengths")), T.StructField("items", T.ArrayType(T.StringType()))])
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = {c: batch.column(c)[i].values for c in ("ids", "row_at", "term", "list_at", "gap")}
                row_at, term, list_at, gap = (part[c].to_numpy() for c in ("row_at", "term", "list_at", "gap"))
                total = np.cumsum(gap, dtype=np.int64)
                shift = np.r_[0, total][list_at[:-1]]
                positions = total - np.repeat(shift, np.diff(list_at))
                n_words = int(row_at[-1])
                edge = np.zeros(n_words + 1, np.int64)
                has_rows, has_items = [], []
                for starts, k, items in _block_matches(term.view(np.uint64), list_at, positions, sent.value, slop):
                    low = np.searchsorted(row_at, np.clip(starts, 0, n_words - 1), side="right") - 1
                    first, last = starts, starts + k
                    if slop:  # what lies beyond the document is cut off
                        first, last = np.maximum(first, row_at[low]), np.minimum(last, row_at[low + 1])
                    inside = (first >= row_at[low]) & (last <= row_at[low + 1])
                    first, last, low = first[inside], last[inside], low[inside]
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last, -1)
                    low = np.unique(low)
                    has_rows.append(np.repeat(low, len(items)))
                    has_items.append(np.tile(items, len(low)))
                if not has_rows or not sum(map(len, has_rows)):
                    continue
                hit = np.cumsum(edge[:-1]) > 0
                starts, ends, rows = word_spans(hit.view(np.uint8), row_at.astype(np.int64), np.arange(256) > 0)
                both = np.unique(np.stack([np.concatenate(has_rows), np.concatenate(has_items)], axis=1), axis=0)
                own, item_at = np.unique(both[:, 0], return_index=True)
                span_at = np.r_[np.searchsorted(rows, own), len(rows)]
                names = pa.ListArray.from_arrays(pa.array(np.r_[item_at, len(both)], pa.int32()), sent.value.names.take(pa.array(both[:, 1])))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()] * len(own), pa.string()), pa.array(own, pa.int32()), part["ids"].take(pa.array(own)), list_array(starts - row_at[rows], span_at, pa.int64()), list_array(ends - starts, span_at, pa.int64()), names], schema.names)

    return index.mapInArrow(run, schema)


def _windows(items: DataFrame, window: int) -> Iterator[Phrases]:
    """The phrases of items (i, t), part by part of a bounded size."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0)).alias("n")).head()["n"]
    parts = max(1, -(-size // PART_BYTES))
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).toArrow()
        words, rows = words_of(*column_bytes(got.column("t")))
        yield Phrases([str(i) for i in got.column("i").to_pylist()], words, np.searchsorted(rows, np.arange(len(got) + 1)), window)


def _words_in(texts: DataFrame) -> DataFrame:
    """(word): the hashes of the words of column t."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = words_of(*column_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words).view(np.int64))], ["word"])

    return texts.select("t").mapInArrow(run, "word long")


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """For each document: id_col, n_words, n_hit (words inside an occurrence of a window of an item), items (sorted distinct
    ids, as strings, of the items with occurring windows), contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Items with
    null id or text are left out; two items of one id count as one. Documents without words are never contaminated.
    Repeated rows give a row each; other columns are not read. Without items every document is clean.
    """
    items = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    index = build_index(df, id_col, text, _words_in(items))
    found = [written(search(index, phrases, slop), "matches") for phrases in _windows(items, window)]
    # spans of several parts may overlap: their union is counted word by word
    rows = reduce(DataFrame.unionByName, found).select("block", "row", F.arrays_zip("starts", "lengths").alias("spans"), "items")
    rows = rows.groupBy("block", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'at', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.starts + s.lengths - greatest(a.at, s.starts)), 'at', greatest(a.at, s.starts + s.lengths)), a -> a.n)")
    rows = rows.select("block", "row", step.alias("n_hit"), "items")
    texts = index.select("block", F.posexplode(F.arrays_zip("ids", F.slice("row_at", F.lit(1), F.size("ids")).alias("low"), F.slice("row_at", F.lit(2), F.size("ids")).alias("high"))).alias("row", "text"))
    texts = texts.select("block", "row", F.col("text.ids").alias("id"), (F.col("text.high") - F.col("text.low")).cast("long").alias("n_words"))
    out = texts.join(rows.hint("merge"), ["block", "row"], "left")
    n_hit, no_item = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", no_item).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df, with all their columns, whose text is not contaminated (see `contamination`). Rows with a null id are kept
    unless their text is contaminated under that id, which equals no other: they are judged by their own text."""
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text)).alias("h"))
    flagged = contamination(df.select(key.alias("key"), F.col(text).alias("text")), items, "key", "text", **options).where("contaminated")
    flagged = written(flagged.select("key.i", "key.h").distinct(), "contaminated")
    return matching(df, (F.col(id_col), F.xxhash64(text)), flagged, "left_anti")
