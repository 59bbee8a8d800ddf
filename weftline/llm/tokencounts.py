"""Token counts of the sections of a document, from one encoding of the whole document.

Each document is encoded once. Its tokens tile its text, so the running sum of token lengths gives the span of each; an
interval join of these spans with the sections' spans says which sections a token touches. A token that lies in one
section counts there. A token across a boundary is allocated by a rule:
- start: to the section that holds its first byte;
- end: to the section that holds its last byte;
- majority: to the section that holds most of its bytes, the earlier one of equals;
- split: to all it touches, by the share of its bytes.
The counts of a document's sections always add up to the count of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import lean, unused
from weftline.llm._text import list_array
from weftline.llm.bpe import Encoded, _replay_cache, _token_bytes, encode_batches

RULES = ("start", "end", "majority", "split")


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(counts by section, flag by token: it crosses a boundary). Both tile the same range from 0: token_ends ascend strictly, as
    tokens have a byte at least; section_ends ascend, and empty sections (equal ends) get no token."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    starts = np.r_[0, token_ends[:-1]] if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crosses = first != last
    counts = np.zeros(len(section_ends), np.float64 if rule == "split" else np.int64)
    inner = first if rule in ("start", "majority", "split") else last
    np.add.at(counts, inner[~crosses] if rule in ("majority", "split") else inner, 1)
    if rule in ("majority", "split"):
        for t in np.flatnonzero(crosses).tolist():
            a, b = int(first[t]), int(last[t])
            edge = np.clip(np.r_[0 if a == 0 else section_ends[a - 1], section_ends[a : b + 1]], starts[t], token_ends[t])
            size = np.diff(edge)
            if rule == "split":
                counts[a : b + 1] += size / size.sum()
            else:
                counts[a + int(size.argmax())] += 1
    return counts, crosses


def _allocated(rows: Encoded, section_ends: np.ndarray, section_at: np.ndarray, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all sections of some rows, and crossing tokens by row. section_ends are positions in the rows' joined bytes."""
    token_ends = np.cumsum(lengths[rows.ids])
    # an empty row's sections are empty; no token starts in them, as both lists tile the same bytes
    counts, crosses = allocate(token_ends, section_ends, rule)
    total = np.r_[0, np.cumsum(crosses)]
    return counts, total[rows.offsets[1:]] - total[rows.offsets[:-1]]


def line_sections(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, offsets by row): each line with its line feed is a section; a row without bytes has none."""
    ends = np.flatnonzero(data == 10) + 1
    closing = at[1:][at[1:] > at[:-1]]
    ends = np.union1d(ends, closing)
    return ends, np.searchsorted(ends, at, side="right")


def count_lines(df: DataFrame, ranks_path: str, text: str = "text", rule: str = "majority") -> DataFrame:
    """df with n_tokens, section_tokens (array: the tokens of each line, as long or, by the rule split, double) and n_crossing
    (tokens across a line's end). A null or empty text has no lines and no tokens. Texts of any length are encoded whole;
    repeated rows are counted alike; other columns pass through, and those with the names of the output are replaced. An empty table gives no rows."""
    names = ["n_tokens", "section_tokens", "n_crossing"]
    kept = [c for c in df.columns if c not in names]
    split = rule == "split"
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType() if split else T.LongType())), T.StructField(names[2], T.LongType())])
    at = kept.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(_token_bytes(ranks_path)[0])

        def output(rows: Encoded) -> list[pa.Array]:
            ends, edge = line_sections(rows.data, rows.at)
            counts, crossing = _allocated(rows, ends, edge, lengths, rule)
            return [pa.array(np.diff(rows.offsets), pa.int64()), list_array(counts, edge, pa.float64() if split else pa.int64()), pa.array(crossing, pa.int64())]

        yield from encode_batches(batches, at, _replay_cache(ranks_path), [*kept, *names], output)

    return df.select(*kept).mapInArrow(run, schema)


def count_fields(df: DataFrame, ranks_path: str, fields: list[str], separator: str = "\n", rule: str = "majority") -> DataFrame:
    """df with n_tokens, field_tokens (array in the order of fields) and n_crossing, from one encoding of the fields joined by
    `separator`, which counts as the end of the field before it. A null field is an empty one; so is a null array of texts,
    whose elements are joined alike. Repeated rows are counted alike; other columns pass through, and those with the names of the output
    are replaced. An empty table gives no rows."""
    names = ["n_tokens", "field_tokens", "n_crossing"]
    kept = [c for c in df.columns if c not in names]

    def written_out(field: str):
        array = isinstance(df.schema[field].dataType, T.ArrayType)
        return F.coalesce(F.array_join(field, separator) if array else F.col(field).cast("string"), F.lit(""))

    parts = [F.concat(written_out(f), F.lit(separator)) if i + 1 < len(fields) else written_out(f) for i, f in enumerate(fields)]
    extra = [unused([*kept, *names], c) for c in ("whole", "sizes")]
    work = df.select(*kept, F.concat(*parts).alias(extra[0]), F.array(*[F.octet_length(p).cast("long") for p in parts]).alias(extra[1]))
    split = rule == "split"
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType() if split else T.LongType())), T.StructField(names[2], T.LongType())])
    all_names = [*kept, *extra]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(_token_bytes(ranks_path)[0])
        sizes: list[np.ndarray] = []

        def tap() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes.extend(np.asarray(x.values) for x in batch.column(len(kept) + 1))
                yield batch

        def output(rows: Encoded) -> list[pa.Array]:
            own = [sizes.pop(0) for _ in range(len(rows.at) - 1)]
            ends = np.cumsum(np.concatenate(own)) if own else np.zeros(0, np.int64)
            edge = np.arange(len(own) + 1) * len(fields)
            counts, crossing = _allocated(rows, ends, edge, lengths, rule)
            return [pa.array(np.diff(rows.offsets), pa.int64()), list_array(counts, edge, pa.float64() if split else pa.int64()), pa.array(crossing, pa.int64())]

        for batch in encode_batches(tap(), len(kept), _replay_cache(ranks_path), [*all_names, *names], output):
            yield batch.select([*kept, *names])

    return work.mapInArrow(run, schema)
