"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a block (several MB of documents) are cut into pretokens; the block's distinct pretokens that have
no encoding yet form one byte sequence. An inverted index from token pair to positions in that sequence is kept
by merge rank, and the merges are applied in rank order to all words of the block at once; a merge touches only
the positions beside it, whose new pairs enter the index. Words are then looked up for all their occurrences.

The work is one pass over the documents without a shuffle: blocks are independent, as BPE never looks beyond a
pretoken, and what a task holds is bounded by the block size and the size of the word cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import lean
from weftline.llm._text import column_bytes, gather, list_array, row_ranges, span_hashes

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_NEVER = np.int32(2**31 - 1)
#: Bytes of new words, about, whose merges are replayed together; it bounds the memory of the index.
REPLAY_BYTES = 1 << 19


@cache
def _char_classes() -> np.ndarray:
    """Class of each code point under the pattern's \\p{L}, \\p{N}, \\s and the rest."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    for low in range(0, 0x110000, 0x800):  # a few code points at a time; surrogates fill one whole piece
        if low == 0xD800:
            continue
        text = np.arange(low, low + 0x800, dtype=np.uint32).tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                out[low + m.start() : low + m.end()] = kind
    return out


def valid_utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """The same rows with each invalid sequence replaced by U+FFFD, and their text."""
    try:
        return data, offsets, data.tobytes().decode()
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        raw = [x.encode() for x in rows]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), "".join(rows)


def pretoken_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each row as the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ does: (data, offsets, starts, ends, rows) in bytes.

    The matches of that pattern cover a text without gaps, so the starts say all.
    """
    data, offsets, text = valid_utf8(data, offsets)
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(point)
    if not n:
        none = np.zeros(0, np.int64)
        return data, offsets, none, none, none
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _char_classes()[point]
    row_at = np.searchsorted(lead, offsets)
    cut = np.zeros(n + 1, bool)
    cut[row_at] = True
    new = cut[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    end = np.r_[run[1:], n]
    of = kind[run]
    last = cut[end]  # the run ends its row
    # the run before is white space of the same row and ends in a blank
    space_before = np.zeros(len(run), bool)
    space_before[1:] = (of[:-1] == _SPACE) & ~last[:-1] & (point[run[1:] - 1] == 32)
    mark = np.zeros(n + 1, bool)
    word = of != _SPACE
    mark[run[word] - space_before[word]] = True
    length = end - run
    blank = point[end - 1] == 32
    mark[run[~word & (last | (length > 1) | ~blank)]] = True
    mark[end[~word & ~last & (length > 1) & ~blank] - 1] = True
    # contractions: a lone apostrophe without a blank before it, then certain letters
    lone = np.flatnonzero((of == _OTHER) & (length == 1) & (point[run] == 39) & ~space_before & ~last)
    lone = lone[of[lone + 1] == _LETTER]
    if len(lone):
        at = run[lone + 1]
        first, more = point[at], length[lone + 1]
        second = point[np.minimum(at + 1, n - 1)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = (more > 1) & (((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l"))))
        hit = one | two
        at, more, took = at[hit], more[hit], np.where(one, 1, 2)[hit]
        mark[at] = False
        rest = took < more
        mark[(at + took)[rest]] = True
    mark[n] = False
    starts = np.flatnonzero(mark)
    begin = lead[starts]
    ends = np.r_[begin[1:], len(data)]
    return data, offsets, begin, ends, np.searchsorted(offsets, begin, side="right") - 1


class MergeReplay:
    """Encodes distinct words by applying merges in rank order through an index from token pair to positions.

    ranks: bytes of each token to its rank, which is its id. The result is that of repeated merging of the adjacent
    pair whose joined bytes have the lowest rank, the leftmost first.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * (self.size + 1) + b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.int64(2**62)]
        self.rank = np.r_[np.fromiter(pairs.values(), np.int32, len(pairs))[order], _NEVER]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of each word one after another."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        token = np.r_[self.byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(self.size)]  # the last stands for none
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        bounds = np.cumsum(lengths)
        filled = lengths > 0
        after[bounds[filled] - 1] = n
        before[(bounds - lengths)[filled]] = -1
        rank = np.full(n + 1, _NEVER, np.int32)
        rank[:n] = self._pair_rank(token[:n], token[after[:n]])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            of = rank[at]
            keep = of != _NEVER
            at, of = at[keep], of[keep]
            if not len(at):
                return
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for r, lo, hi in zip(of[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
                got = index.get(r)
                if got is None:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)
                else:
                    got.append(at[lo:hi])

        enter(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if len(at) > 1:
                at = np.unique(at)
                close = after[at[:-1]] == at[1:]
                if close.any():  # aaa: every second one, from the left
                    k = np.arange(len(at))
                    chain = np.maximum.accumulate(np.where(np.r_[True, ~close], k, 0))
                    at = at[(k - chain) % 2 == 0]
                at = self._safe(r, at, token, after, before, word, index, heap)
            if not len(at):
                continue
            b = after[at]
            c = after[b]
            token[at] = r
            alive[b] = False
            rank[b] = _NEVER
            after[at] = c
            inner = c < n
            before[c[inner]] = at[inner]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            rank[touched] = self._pair_rank(token[touched], token[after[touched]])
            enter(touched)
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word[alive], minlength=len(words)), out=offsets[1:])
        return offsets, token[:n][alive]

    def _safe(self, r, at, token, after, before, word, index, heap) -> np.ndarray:
        """Where merging one place of a word makes a pair of lower rank, its other places wait in the index."""
        of = word[at]
        twice = np.zeros(len(at), bool)
        same = of[1:] == of[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        if not twice.any():
            return at
        m = np.full(len(at), r)
        left = before[at]
        joined = np.zeros(len(at), bool)
        joined[1:] = left[1:] == after[at[:-1]]
        low = np.minimum(self._pair_rank(m, token[after[after[at]]]), self._pair_rank(np.where(joined, r, token[left]), m) if len(at) else _NEVER)
        low = np.where((left < 0) & (self._pair_rank(m, token[after[after[at]]]) == _NEVER), _NEVER, low)
        risky = np.unique(of[twice & (low < r)])
        if not len(risky):
            return at
        wait = np.isin(of, risky) & np.r_[False, same]
        if r not in index:
            heapq.heappush(heap, r)
        index.setdefault(r, []).append(at[wait])
        return at[~wait]


class WordCache:
    """Ids of words by their hash; it is emptied before a block when it holds more than `most` words."""

    def __init__(self, encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000) -> None:
        self.encode_words, self.most = encode_words, most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] != hashes

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if not words:
            return
        size = np.cumsum([len(w) for w in words]) // REPLAY_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(words)]
        parts = [self.encode_words(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate([p[1] for p in parts])
        offsets = np.r_[0, np.cumsum(np.concatenate([np.diff(p[0]) for p in parts]))]
        place = len(self.offsets) - 1 + np.arange(len(words))
        self.offsets = np.r_[self.offsets, self.offsets[-1] + offsets[1:]]
        self.ids = np.r_[self.ids, ids.astype(np.int32)]
        hashes, place = np.r_[self.hashes, hashes], np.r_[self.place, place]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place = hashes[order], place[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.hashes, hashes)]


class Encoded:
    """Some consecutive rows: ids[offsets[i]:offsets[i + 1]] are those of row i; data and at hold the texts' bytes."""

    __slots__ = ("low", "high", "offsets", "ids", "data", "at")

    def __init__(self, low, high, offsets, ids, data, at) -> None:
        self.low, self.high, self.offsets, self.ids, self.data, self.at = low, high, offsets, ids, data, at


def encode_blocks(columns: Iterator[pa.Array], words: WordCache, block: int = 4 << 20, chunk: int = 1 << 20) -> Iterator[tuple[int, Encoded]]:
    """Encodes string columns; gives (number of the column, rows) in order. A block may span several columns."""
    waiting: list = []
    fresh_hashes: list[np.ndarray] = []
    fresh_words: list[bytes] = []
    held = 0

    def flush() -> Iterator[tuple[int, Encoded]]:
        nonlocal held
        words.add(np.concatenate(fresh_hashes) if fresh_hashes else np.zeros(0, np.uint64), fresh_words)
        for k, low, high, distinct, inverse, by_row, data, at in waiting:
            ids, edge = gather(words.offsets, words.ids, words.find(distinct)[inverse])
            yield k, Encoded(low, high, edge[by_row], ids, data, at)
        waiting.clear()
        fresh_hashes.clear()
        fresh_words.clear()
        held = 0
        if len(words.hashes) > words.most:
            words.clear()

    for k, column in enumerate(columns):
        data, offsets = column_bytes(column)
        for low, high in row_ranges(offsets, chunk):
            part = data[offsets[low] : offsets[high]]
            part, at, starts, ends, rows = pretoken_spans(part, offsets[low : high + 1] - offsets[low])
            hashes = span_hashes(part, starts, ends)
            distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            new = words.unknown(distinct)
            if fresh_hashes and new.any():
                for seen in fresh_hashes:
                    there = np.minimum(np.searchsorted(seen, distinct), len(seen) - 1)
                    new &= seen[there] != distinct
            if new.any():
                raw = part.tobytes()
                fresh_hashes.append(distinct[new])
                fresh_words.extend(raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True))
            waiting.append((k, low, high, distinct, inverse.astype(np.int32), np.searchsorted(rows, np.arange(high - low + 1)), part, at))
            held += len(part)
            if held >= block:
                yield from flush()
    yield from flush()


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _replay_cache(path: str) -> WordCache:
    """One for each Python worker, which keeps it from task to task."""
    return WordCache(MergeReplay(read_ranks(path)).encode_words)


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the tokens by id."""
    by_id = {rank: token for token, rank in read_ranks(path).items()}
    raw = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def decode_ids(ids: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the rows whose ids are ids[offsets[i]:offsets[i + 1]]."""
    token_at, raw = _token_bytes(path)
    data, edge = gather(token_at, raw, ids)
    return data, edge[offsets]


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, decoded_sha256: str | None = None) -> DataFrame:
    """df with its texts' ids as array<int> in column `ids` and, if `decoded` is given, the bytes that decoding these ids gives;
    if `decoded_sha256` is given, the lower-case hexadecimal SHA-256 of these bytes.

    ranks_path: a rank file (`base64 rank` lines) that every executor can read. Special tokens are never produced.
    Null and empty texts give an empty array and no bytes. A text may be of any length; repeated rows are kept; other
    columns pass through, and one that has the name of an output column is replaced. An empty table gives no rows.
    """
    outputs = [ids, *(c for c in (decoded, decoded_sha256) if c)]
    kept = [c for c in df.columns if c not in outputs]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else []) + ([T.StructField(decoded_sha256, T.StringType())] if decoded_sha256 else []))
    at = kept.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode_batches(batches, at, _replay_cache(ranks_path), [*kept, *outputs], lambda x: _output(x, ranks_path, bool(decoded), bool(decoded_sha256)))

    return df.select(*kept).mapInArrow(run, schema)


def _output(rows: Encoded, ranks_path: str, with_bytes: bool, with_digest: bool) -> list[pa.Array]:
    out = [list_array(rows.ids, rows.offsets, pa.int32())]
    if with_bytes or with_digest:
        data, at = decode_ids(rows.ids, rows.offsets, ranks_path)
    if with_bytes:
        out.append(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)]).cast(pa.binary()))
    if with_digest:
        raw = memoryview(np.ascontiguousarray(data))
        out.append(pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()))
    return out


def encode_batches(batches: Iterator[pa.RecordBatch], at: int, words: WordCache, names: list[str], output: Callable[[Encoded], list[pa.Array]]) -> Iterator[pa.RecordBatch]:
    """Record batches with the arrays that `output` makes of the encoded texts in column `at` added."""
    held: dict[int, pa.RecordBatch] = {}

    def columns() -> Iterator[pa.Array]:
        for k, batch in enumerate(batches):
            held[k] = batch
            yield batch.column(at)

    for k, rows in encode_blocks(columns(), words):
        for old in [x for x in held if x < k]:
            del held[old]
        part = held[k].slice(rows.low, rows.high - rows.low)
        yield pa.RecordBatch.from_arrays([*part.columns, *output(rows)], names)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of its ids in column `decoded`. A null or empty array gives no bytes; a null id counts as no token; an unknown id fails the job."""
    kept = [c for c in df.columns if c != decoded]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(decoded, T.BinaryType())])
    at = kept.index(ids)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            values = [[x for x in v or [] if x is not None] for v in lists.to_pylist()]
            offsets = np.cumsum([0, *map(len, values)])
            data, edge = decode_ids(np.array([x for v in values for x in v], np.int64), offsets, ranks_path)
            raw = data.tobytes()
            out = pa.array([raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*kept, decoded])

    return df.select(*kept).mapInArrow(run, schema)


def ids_digest(ids: str = "ids"):
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
