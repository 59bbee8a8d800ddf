"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched by the largest exponents of exponentially spaced, truncated minima:
register i holds floor(1 - log_b(min h_i)) over the set, cut to [0, q + 1], where h_i is exponentially distributed.
Sketches of unions are the register-wise maxima, and equal registers are locality-sensitive. Bands of registers give
buckets; a pair that shares a bucket is judged from its registers by the joint likelihood of the similarity, and
pairs that are not excluded so are verified on their full sets.

Documents of one set form a class, and only classes are compared. In each bucket every class meets the bucket's
smallest (linear in the bucket). After the links found so have been joined to components, only buckets with several
components are undecided. Of their classes those meet that share one of their rarest shingles and lie in different
components: two sets with a similarity of t have one in common among the |A| - ceil(t |A|) + 1 rarest of each, so this loses no
link, and a family of copies that differ by changes of their own does not meet itself. A pair within a component needs no
comparison, as it can't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import lean, matching, perhaps_listed, release, unused, whole_runs, written
from weftline.llm._text import LOWER, NOT_SPACE, column_bytes, mix64, row_ranges, shingle_hashes, span_hashes, stream64, word_spans
from weftline.llm.graph import components

#: Words in a shingle; links need SIMILAR[0] / SIMILAR[1] of the union in common.
SHINGLE, SIMILAR = 5, (75, 100)
#: Bands and registers in each: a pair at the threshold shares no band with a probability of (1 - 0.75 ** 5) ** 51 = 1e-6.
BANDS, BAND = 51, 5
#: Classes that share a rare shingle meet in blocks of about so many where there are more of them.
BLOCK = 256
#: Bits that say how many shingles two sets at least don't share.
PARITY = 2048
#: Base, rate and largest exponent of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: A pair is excluded unverified if its likelihood at the threshold is below that at its estimate by so much (6.3 standard errors).
DOUBT = 40.0


class SetSketch:
    """Sketches of sets of 64-bit hashes with `size` registers."""

    def __init__(self, size: int = BANDS * BAND, base: float = BASE, rate: float = RATE, limit: int = LIMIT, seed: int = 31) -> None:
        self.size, self.base, self.rate, self.limit = size, base, rate, limit
        self.factors = stream64(seed, size) | np.uint64(1)

    def minima(self, hashes: np.ndarray, sets: np.ndarray, n: int, block: int = 512) -> np.ndarray:
        """Smallest hash of each set under each register's function; sets: ascending set numbers below n. All ones for an empty set."""
        out = np.full((n, self.size), np.uint64(2**64 - 1))
        buffer = np.empty((block, self.size), np.uint64)
        for at in range(0, len(hashes), block):
            part = hashes[at : at + block]
            of = sets[at : at + block]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            np.multiply(part[:, None], self.factors, out=buffer[: len(part)])
            least = np.minimum.reduceat(buffer[: len(part)], first, axis=0)
            owner = of[first]
            out[owner] = np.minimum(out[owner], least)
        return out

    def registers(self, minima: np.ndarray) -> np.ndarray:
        h = -np.log1p(-np.minimum((minima.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / self.rate
        return np.clip(np.floor(1 - np.log(h) / np.log(self.base)), 0, self.limit + 1).astype(np.uint16)

    def sketch(self, hashes: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
        return self.registers(self.minima(hashes, sets, n))

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sketch of the union."""
        return np.maximum(a, b)

    def log_likelihood(self, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        """Of a Jaccard similarity, given how many registers of a are larger and smaller than those of b and the sizes of both sets."""
        share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)

        def p(x):
            return -np.log1p(-np.maximum(x, 0) * (self.base - 1) / self.base) / np.log(self.base)

        up, down = p(share_a - share_b * similarity), p(share_b - share_a * similarity)
        tiny = 1e-300
        return more * np.log(up + tiny) + less * np.log(down + tiny) + (self.size - more - less) * np.log(np.maximum(1 - up - down, tiny))

    def similarity(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """For rows of registers: the likeliest similarity on a grid, and twice the log-likelihood that the threshold lies below it."""
        more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
        most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
        grid = np.linspace(0, 1, 129)[:, None] * most
        fit = self.log_likelihood(more, less, n_a, n_b, grid)
        best = fit.argmax(axis=0)
        at = self.log_likelihood(more, less, n_a, n_b, np.minimum(threshold, most))
        return grid[best, np.arange(len(best))], 2 * (fit.max(axis=0) - at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, hashes, sets): the distinct shingles of rows low to high, ascending in each row; sets are numbers from 0."""
    for low, high in row_ranges(offsets, 1 << 20, 1024):
        part, at = LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, ends, rows = word_spans(part, at, NOT_SPACE)
        hashes, owner = shingle_hashes(span_hashes(part, starts, ends), rows, k)
        edge = np.searchsorted(owner, np.arange(high - low + 1))
        own = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield low, high, np.concatenate(own), np.repeat(np.arange(high - low), [len(x) for x in own])


def _fingerprints(hashes: np.ndarray, sets: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each set that depend on its hashes only."""
    out = np.zeros((n, 2), np.uint64)
    if len(hashes):
        first = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]])
        for j, salt in enumerate(stream64(53, 2)):
            out[sets[first], j] = np.add.reduceat(mix64(hashes ^ salt), first)
    return [x.tobytes() for x in out]


def sketches(df: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """df with n_shingles, set_print (binary; equal for equal sets, null for an empty one) and registers (binary, 16 bits each)."""
    kept = df.columns
    schema = T.StructType([*df.schema, T.StructField("n_shingles", T.LongType()), T.StructField("set_print", T.BinaryType()), T.StructField("registers", T.BinaryType())])
    at = kept.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch()
        for batch in batches:
            for low, high, hashes, sets in shingle_sets(*column_bytes(batch.column(at)), k):
                n = high - low
                size = np.bincount(sets, minlength=n)
                registers, prints = sketch.sketch(hashes, sets, n), _fingerprints(hashes, sets, n)
                more = [pa.array(size, pa.int64()), pa.array([p if s else None for p, s in zip(prints, size, strict=True)], pa.binary()), pa.array([r.tobytes() if s else None for r, s in zip(registers, size, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, n).columns, *more], schema.names)

    return df.mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data, _ = column_bytes(column)
    return data.view(np.uint16).reshape(-1, width)


def band_keys(classes: DataFrame, bands: int = BANDS, band: int = BAND) -> DataFrame:
    """(bucket, node): a row for each band of each class; equal registers of a band give equal buckets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = stream64(71, bands * band).reshape(bands, band) | np.uint64(1)
        salt = stream64(73, bands)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                registers = mix64(_matrix(part.column(1), bands * band).astype(np.uint64) + np.uint64(1))
                keys = mix64((registers.reshape(-1, bands, band) * factors).sum(axis=2) + salt)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), bands), pa.int64())], ["bucket", "node"])

    return classes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _not_excluded(pairs: DataFrame, classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose registers don't exclude the similarity."""
    own = classes.select("node", "n_shingles", "registers")
    rows = pairs
    for c in "ab":
        rows = rows.join(own.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")).hint("merge"), c)
        if c == "b":
            rows = rows.where(F.least("n_a", "n_b") * similar[1] >= F.greatest("n_a", "n_b") * similar[0])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, least = SetSketch(), similar[0] / similar[1]
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
                likely, doubt = sketch.similarity(*(_matrix(part.column(c), sketch.size) for c in ("r_a", "r_b")), n_a, n_b, least)
                yield part.select(["a", "b"]).filter(pa.array((likely >= least) | (doubt <= DOUBT)))

    return rows.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _texts_of(nodes: DataFrame, df: DataFrame, classes: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, text) for each distinct node: a text whose set is that of the class."""
    # all tables here grow with the input: merge joins keep the plan the same at every size
    wanted = written(nodes.distinct().join(classes.select("node", "rep").hint("merge"), "node"), "wanted")
    texts = df.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text).alias("h")).alias("rep"), F.col(text).alias("text"))
    texts = perhaps_listed(texts, F.col("rep.h"), wanted.select(F.col("rep.h").alias("h")), "h")
    texts = texts.join(wanted.hint("merge"), (texts["rep.i"].eqNullSafe(wanted["rep.i"])) & (texts["rep.h"] == wanted["rep.h"])).select("node", "text")
    return written(texts.groupBy("node").agg(F.first("text").alias("text")), "wanted-texts")


def _verified(pairs: DataFrame, df: DataFrame, classes: DataFrame, id_col: str, text: str, k: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), df, classes, id_col, text)
    rows = pairs
    for c in "ab":
        rows = rows.join(texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}")).hint("merge"), c)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = []
                for c in ("t_a", "t_b"):
                    own: list[np.ndarray] = []
                    for low, high, hashes, of in shingle_sets(*column_bytes(part.column(c)), k):
                        edge = np.searchsorted(of, np.arange(high - low + 1))
                        own += [hashes[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
                    sets.append(own)
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(similar[1] * both >= similar[0] * (len(x) + len(y) - both) and both > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(rows.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long"), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """For each row: id_col, n_shingles, component_id (the smallest id that its text reaches by links), kept (id_col equals component_id).

    Two documents are linked if similar[1] * |A and B| >= similar[0] * |A or B| for their sets of k-word shingles (all words
    as one shingle where there are fewer). Rows without words have an empty set, are linked with nothing and kept.
    Rows of equal sets are linked; a repeated row of the smallest id is kept as often as it is there. A null id is no
    candidate for component_id unless all ids of a component are null: then component_id is null and the rows are kept.
    Other columns are not read. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    drawn = written(sketches(rows).drop("text"), "sketches")
    classes = drawn.where("n_shingles > 0").groupBy("set_print").agg(F.min("id").alias("least"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("rep"), F.min("h").alias("h"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = written(classes.withColumn("rep", F.struct(F.col("rep.id").alias("i"), F.coalesce("rep.h", "h").alias("h"))).drop("h").withColumn("node", F.monotonically_increasing_id()), "classes")
    pivots = written(band_keys(classes).groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("bucket", "pivot"), "pivots")
    shared = written(band_keys(classes).join(pivots.hint("merge"), "bucket"), "buckets")
    stars = written(_not_excluded(shared.where("pivot < node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), classes, similar), "pairs")
    links = _verified(stars, df, classes, id_col, text, k, similar)
    release(pivots)
    reached = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    undecided = written(_undecided(shared.select("bucket", "node"), reached), "undecided")
    release(shared)
    texts = _texts_of(undecided.select("node"), df, classes, id_col, text)
    postings = written(_rarest(undecided, texts, classes, k, similar), "rarest")
    apart = _sharing(postings, _parities(texts, k), similar)
    rest = written(_not_excluded(apart.join(stars.hint("merge"), ["a", "b"], "left_anti"), classes, similar), "pairs")
    more = _verified(rest, df, classes, id_col, text, k, similar)
    release(texts, postings, rest, stars)
    reached = components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("set_print", "node", "least").join(reached.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least.hint("merge"), "root").select("set_print", "component_id"), "named")
    out = drawn.select("id", "n_shingles", "set_print").join(named.hint("merge"), "set_print", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _undecided(shared: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, root): the members of buckets that hold several components, once each."""
    rows = shared.join(reached.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return rows.join(written(mixed, "mixed").hint("merge"), "bucket").select("node", "root").distinct()


def _rarest(undecided: DataFrame, texts: DataFrame, classes: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """(shingle, node, root, n_shingles, after, n): the rarest shingles of each node, as many as two similar sets need to have one in common,
    but for those that only one component has. Rare is what few undecided nodes have; after: the node's shingles that are less rare;
    n: nodes that have the shingle among their rarest."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, sets in shingle_sets(*column_bytes(batch.column(3)), k):
                part = pa.array(sets + low)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *(batch.column(j).take(part) for j in range(3))], ["shingle", "node", "root", "n_shingles"])

    named = texts.join(undecided.hint("merge"), "node").join(classes.select("node", "n_shingles").hint("merge"), "node")
    sets = written(named.select("node", "root", "n_shingles", "text").mapInArrow(run, "shingle long, node long, root long, n_shingles long"), "sets")
    held = sets.groupBy("shingle").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    ranked = sets.join(held.where("held > 1").hint("merge"), "shingle", "left")
    order = Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(1)), "shingle")
    enough = F.expr(f"n_shingles - ({similar[0]} * n_shingles + {similar[1] - 1}) div {similar[1]} + 1")
    rarest = written(ranked.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= enough) & (F.col("low") < F.col("high"))).select("shingle", "node", "root", "n_shingles", (F.col("n_shingles") - F.col("rank")).alias("after")), "rarest")
    release(sets)
    lists = rarest.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle", "n")
    return rarest.join(lists.hint("merge"), "shingle")


def _parities(texts: DataFrame, k: int) -> DataFrame:
    """(node, parity): PARITY bits of each set, each the parity of the shingles that fall on it. The bits in which two sets
    differ are no more than the shingles that only one of them has."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, sets in shingle_sets(*column_bytes(batch.column(1)), k):
                edge = np.searchsorted(sets, np.arange(high - low + 1))
                bits = [np.packbits(np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) % 2 == 1).tobytes() for x in map(hashes.__getitem__, map(slice, edge[:-1], edge[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(bits, pa.binary())], ["node", "parity"])

    return texts.select("node", "text").mapInArrow(run, "node long, parity binary")


def _sharing(postings: DataFrame, parities: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share one of their rarest shingles and may be similar: so many shingles come
    after it (the rarest one that a pair shares says so of all that are), and so few bits differ. The nodes that share a shingle are
    dealt to blocks, and each two blocks meet within a task, which gives only these pairs."""
    dealt = postings.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(parities.hint("merge"), "node").select("shingle", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") <= F.col("other")).alias("first"), "node", "root", "n_shingles", "after", "parity")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["shingle", "one", "two"]):
            node, root, size, after, first, one, two = (rows[c].to_numpy() for c in ("node", "root", "n_shingles", "after", "first", "one", "two"))
            parity = column_bytes(rows["parity"])[0].view(np.uint64).reshape(len(node), -1)
            key = np.stack([rows["shingle"].to_numpy(), one, two])
            begin = np.maximum.accumulate(np.where(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)], np.arange(len(node)), 0))
            before = np.r_[0, np.cumsum(np.arange(len(node)) - begin)]
            for low in range(0, int(before[-1]), 1 << 16):
                # pair number p is of row i, the last with before[i] <= p, and one of the rows of its run before it
                p = np.arange(low, min(low + (1 << 16), int(before[-1])))
                i = np.searchsorted(before, p, side="right") - 1
                j = begin[i] + p - before[i]
                may = (root[i] != root[j]) & ((one[i] == two[i]) | (first[i] != first[j])) & ((np.minimum(after[i], after[j]) + 1) * sum(similar) >= (size[i] + size[j]) * similar[0])
                i, j = i[may], j[may]
                apart = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
                may = (size[i] + size[j] - apart) // 2 * sum(similar) >= (size[i] + size[j]) * similar[0]
                a, b = node[i[may]], node[j[may]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.repartition("shingle", "one", "two").sortWithinPartitions("shingle", "one", "two").mapInArrow(run, "a long, b long").distinct()


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df, with all their columns, that `near_duplicates` keeps, each repeated (id, text) once."""
    # rows without id come last
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h"))
    found = near_duplicates(df.select(key.alias("key"), F.col(text).alias("text")), "key", "text", **options)
    keys = written(found.where("kept").groupBy("key.i", "key.h").agg(F.count("*").alias("n")), "kept")
    own = (F.col(id_col), F.xxhash64(text))
    again = matching(df, own, keys.where("n > 1"))
    i, h = unused(df.columns, "i"), unused(df.columns, "h")
    again = again.withColumn(i, own[0]).withColumn(h, own[1]).dropDuplicates([i, h]).select(*df.columns)
    return matching(df, own, keys.where("n = 1")).unionByName(again)
