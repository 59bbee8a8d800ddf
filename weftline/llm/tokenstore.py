"""Token ids in seekable files: independent zstandard frames, a document index and a trailing seek table.

A file holds, in this order:
- frames: the ids of all its documents one after another as little-endian unsigned 32-bit integers, cut into frames of at
  most FRAME bytes, each a zstandard frame of its own with a content checksum;
- the index, a skippable frame: a zstandard-compressed Arrow stream with the id, first position and length of each document;
- the seek table of the zstandard seekable format, a skippable frame: the compressed and decompressed size of each
  frame before it and the low 32 bits of the XXH64 of its content, then the number of frames, a flag byte and a magic number.
Any zstandard decoder reads the whole file as one stream of ids; `TokenFile` reads only the frames that a document lies in.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import IO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm._shared import fresh_dir, lean, open_new, open_old, written
from weftline.llm.bpe import WordCache, encode_blocks

FRAME = 256 << 10
FILE = 256 << 20
LEVEL = 3
# fixed values of the format
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class TokenFileWriter:
    """Writes one file; ids go in by `add`."""

    def __init__(self, out: IO[bytes], frame: int = FRAME, level: int = LEVEL) -> None:
        self.out, self.frame = out, frame
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.bytes = 0
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, ids: pa.Array, tokens: np.ndarray, lengths: np.ndarray) -> None:
        """Some documents: their ids, all their tokens and how many each has."""
        self.index.append((ids, np.asarray(lengths, np.int64)))
        self.tokens += len(tokens)
        tokens = np.ascontiguousarray(tokens, "<u4")
        self.waiting.append(tokens)
        self.held += tokens.nbytes
        if self.held >= self.frame:
            self._cut(False)

    def _cut(self, all_of_it: bool) -> None:
        data = memoryview(np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")).cast("B")
        at = 0
        while len(data) - at >= self.frame or (all_of_it and at < len(data)):
            part = data[at : at + self.frame]
            at += len(part)
            self._put(self.compressor.compress(part), len(part), xxhash.xxh64(part).intdigest() & 0xFFFFFFFF)
        rest = np.frombuffer(bytes(data[at:]), "<u4")
        self.waiting, self.held = [rest], rest.nbytes

    def _put(self, raw: bytes, size: int, checksum: int) -> None:
        self.out.write(raw)
        self.bytes += len(raw)
        self.entries.append((len(raw), size, checksum))

    def close(self) -> None:
        self._cut(True)
        lengths = np.concatenate([n for _, n in self.index]) if self.index else np.zeros(0, np.int64)
        table = pa.table({"id": pa.chunked_array([i for i, _ in self.index]) if self.index else pa.array([], pa.int64()), "first": np.cumsum(lengths) - lengths, "n": lengths})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        raw = self.compressor.compress(sink.getvalue())
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(raw)) + raw, 0, xxhash.xxh64(b"").intdigest() & 0xFFFFFFFF)
        body = b"".join(struct.pack("<III", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)
        self.bytes += 8 + len(body)


class TokenFile:
    """Reads a file; `read` decompresses only the frames that hold what is asked for and checks their checksums."""

    def __init__(self, f: IO[bytes]) -> None:
        self.f = f
        f.seek(0, 2)
        size = f.tell()
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a seekable token file")
        f.seek(size - 9 - 12 * n)
        entries = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
        self.packed = np.r_[0, np.cumsum(entries[:, 0], dtype=np.int64)]
        self.plain = np.r_[0, np.cumsum(entries[:-1, 1], dtype=np.int64)]
        self.checksums = entries[:, 2]
        self.decompressor = zstandard.ZstdDecompressor()
        self.frames_read = 0
        f.seek(int(self.packed[n - 1]))
        kind, length = struct.unpack("<II", f.read(8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("the file has no index")
        with pa.ipc.open_stream(self.decompressor.decompress(f.read(length))) as stream:
            self.index = stream.read_all()
        self.first, self.n = self.index["first"].to_numpy(), self.index["n"].to_numpy()

    def frame(self, k: int) -> bytes:
        self.f.seek(int(self.packed[k]))
        raw = self.decompressor.decompress(self.f.read(int(self.packed[k + 1] - self.packed[k])))
        if len(raw) != self.plain[k + 1] - self.plain[k] or xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return raw

    def read(self, document: int) -> np.ndarray:
        """The ids of the document with this number in the file."""
        low, high = 4 * int(self.first[document]), 4 * int(self.first[document] + self.n[document])
        if low == high:
            return np.zeros(0, np.uint32)
        a, b = (int(np.searchsorted(self.plain, x, side="right")) - 1 for x in (low, high - 1))
        raw = b"".join(self.frame(k) for k in range(a, b + 1))
        return np.frombuffer(raw, "<u4")[(low - int(self.plain[a])) // 4 : (high - int(self.plain[a])) // 4]

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(number, bytes) of all documents in order, each in one or more pieces; one frame is held at a time."""
        ends = 4 * (self.first + self.n)
        document = 0
        for k in range(len(self.plain) - 1):
            raw, at, start = self.frame(k), 0, int(self.plain[k])
            while at < len(raw):
                while ends[document] <= start + at:
                    document += 1
                stop = min(len(raw), int(ends[document]) - start)
                yield document, raw[at:stop]
                at = stop


@cache
def byte_chars() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if it is printable, else the next one from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@cache
def library_cache(path: str) -> tuple[WordCache, Callable[[str], list[int]], re.Pattern | None]:
    """Encodes words with the tokenizers library; one for each Python worker. Also the library's encoding of a whole text, and a
    pattern of the added tokens, which the library cuts out before it looks for words: a text with one of them goes whole."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cut = said.get("pre_tokenizer") or {}
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or said.get("normalizer"):
        raise ValueError("only byte-level tokenizers without a prefix space and a normalizer are read")
    tokenize, chars = tokenizer.model.tokenize, "".join(byte_chars())
    to_chars = {i: c for i, c in enumerate(chars)}

    def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [[t.id for t in tokenize(w.decode("latin-1").translate(to_chars))] for w in words]
        return np.cumsum([0, *map(len, found)]), np.array([i for x in found for i in x], np.int32)

    added = [t["content"] for t in said.get("added_tokens") or [] if t["content"]]
    if any(t.get("normalized") and said.get("normalizer") for t in said.get("added_tokens") or []):
        raise ValueError("added tokens that are normalized are not read")
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return WordCache(encode_words), whole, re.compile("|".join(map(re.escape, added))) if added else None


def write_tokens(df: DataFrame, tokenizer_path: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id", text: str = "text", file_bytes: int = FILE, added_tokens: bool = False) -> DataFrame:
    """Encodes the texts and writes their ids in ascending order of id_col; returns the written files' table.

    Its rows are path, n_docs, n_tokens, n_bytes, start (ids in all files before it); the paths ascend as the ids do.
    tokenizer_path: a tokenizer.json of a byte-level BPE that every executor can read; strings of its added
    tokens in a text are ordinary text, or with added_tokens get these tokens' ids, as by the library's own encode. end_id, if given, ends each document. folder: a new folder in a shared store. Null and
    empty texts have no ids but the end id. Rows with a null id come first; rows of one id are ordered by text, null first.
    A task that is run again writes the same files. Other columns are not read. An empty table writes nothing.
    """
    spark = df.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    schema = "path string, n_docs long, n_tokens long, n_bytes long"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, pa.Array] = {}

        cache_of, whole, added = library_cache(tokenizer_path)
        marked: dict[int, dict[int, str]] = {}

        def columns() -> Iterator[pa.Array]:
            for k, batch in enumerate(batches):
                held[k] = batch.column(0)
                texts = batch.column(1)
                if added_tokens and added is not None:
                    has = pc.fill_null(pc.match_substring_regex(texts, added.pattern), False)
                    marked[k] = {i: texts[i].as_py() for i in np.flatnonzero(has.to_numpy(zero_copy_only=False)).tolist()}
                    if marked[k]:
                        texts = pc.if_else(has, pa.scalar("", texts.type), texts)
                yield texts

        rows = encode_blocks(columns(), cache_of)
        one = next(rows, None)
        while one is not None:
            path = f"{folder}/{part:06d}-{number:04d}.tok.zst"
            n = 0
            with open_new(path) as out:
                writer = TokenFileWriter(out)
                while one is not None and writer.bytes < file_bytes:
                    k, got = one
                    for old in [x for x in held if x < k]:
                        del held[old]
                        marked.pop(old, None)
                    lengths, tokens, offsets = np.diff(got.offsets), got.ids, got.offsets
                    own = {i - got.low: whole(text) for i, text in marked.get(k, {}).items() if got.low <= i < got.high}
                    if own:
                        # these rows have no ids yet
                        tokens = np.insert(tokens, np.repeat(offsets[list(own)], [len(x) for x in own.values()]), [i for x in own.values() for i in x])
                        lengths[list(own)] = [len(x) for x in own.values()]
                        offsets = np.r_[0, np.cumsum(lengths)]
                    if end_id is not None:
                        tokens, lengths = np.insert(tokens, offsets[1:], end_id), lengths + 1
                    writer.add(held[k].slice(got.low, got.high - got.low), tokens, lengths)
                    n += len(lengths)
                    one = next(rows, None)
                writer.close()
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([x], pa.int64()) for x in (n, writer.tokens, writer.bytes))], ["path", "n_docs", "n_tokens", "n_bytes"])

    ordered = df.select(id_col, text).repartitionByRange(id_col).sortWithinPartitions(id_col, text)
    files = written(ordered.mapInArrow(run, schema), "token-files")
    before = F.sum("n_tokens").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return written(files.withColumn("start", F.coalesce(before, F.lit(0))), "token-files")


def read_tokens(files: DataFrame, id_col: str = "doc_id", id_type: str = "long", ids: bool = False) -> DataFrame:
    """Reads the files of `write_tokens` back: id_col, start (ids of all documents before it), n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers) and, if asked for, ids as array<long>. A damaged frame fails the job."""
    schema = f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with open_old(path) as f:
                    file = TokenFile(f)
                    crc = np.zeros(len(file.n), np.int64)
                    parts: list[list[bytes]] = [[] for _ in file.n] if ids else []
                    for k, raw in file.pieces():
                        crc[k] = zlib.crc32(raw, int(crc[k]))
                        if ids:
                            parts[k].append(raw)
                    columns = [file.index["id"].combine_chunks(), pa.array(start + file.first), pa.array(file.n), pa.array(crc)]
                    if ids:
                        columns.append(pa.array([np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in parts], pa.list_(pa.int64())))
                    for x in pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000):
                        yield x

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(run, schema)


def read_documents(spark: SparkSession, wanted: DataFrame, files: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """The ids of some documents only: wanted has columns path and document (the document's number in that file). Reads the
    frames that hold them and no others: id_col, document, path, ids, frames_read (of that file, so far)."""
    schema = f"path string, document long, {id_col} {id_type}, ids array<long>, frames_read long"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in dict.fromkeys(batch.column("path").to_pylist()):
                own = [d for p, d in zip(batch.column("path").to_pylist(), batch.column("document").to_pylist(), strict=True) if p == path and d is not None]
                with open_old(path) as f:
                    file = TokenFile(f)
                    rows = [(path, d, file.index["id"][d].as_py(), file.read(d).astype(np.int64), file.frames_read) for d in own if d < len(file.n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int64(), file.index.schema.field("id").type, pa.list_(pa.int64()), pa.int64()))], ["path", "document", id_col, "ids", "frames_read"])

    known = wanted.select("path", F.col("document").cast("long")).join(files.select("path"), "path", "left_semi")
    return known.repartition("path").mapInArrow(run, schema)
