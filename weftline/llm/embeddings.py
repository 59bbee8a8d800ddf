"""Near-duplicate vectors by cross-polytope hashing.

Each table rotates the vectors by three rounds of random signs and a fast Hadamard transform and takes the nearest
vertices of the cross-polytope (the largest coordinates with their signs) as hash values; `width` of them name a bucket.
Every vector goes to the bucket of its own vertices and to those of the next likely ones (multiprobe). Within a bucket all
pairs are verified by their cosine in double precision. Buckets of many vectors are cut into blocks, and each pair
of blocks is a group of its own, so no task holds more than two blocks. A group gives a row for each linked vector, with its
number of links and a vector that it reaches; pairs are never written. A pair counts in the first bucket that it shares only.
Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import lean, written
from weftline.llm._text import mix64
from weftline.llm.graph import components

PROBES = 4
#: Candidates for each hash value from which the likeliest combinations are taken.
NEXT = 4
#: Vectors in a block; and about how many a bucket holds where vectors are spread evenly.
BLOCK, FILL = 768, 64


def tables_for(n: int, dims: int) -> tuple[int, int]:
    """(hash values in a bucket's name, tables): more values as there are more vectors, and tables that make up for it."""
    width = max(1, math.ceil(math.log(max(n / FILL, 1.0)) / math.log(2 * dims)))
    return width, 2 + 2**width


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix; their length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        pairs = x.reshape(rows, -1, 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(rows, n)
        h *= 2
    return x / math.sqrt(n)


def buckets(x: np.ndarray, width: int, tables: int, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """(rows, tables, probes) bucket names of unit vectors; within a table they are distinct."""
    rows, dims = x.shape
    size = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :dims] = x
    random = np.random.default_rng([seed, dims])
    choices = np.array(list(itertools.product(range(NEXT), repeat=width)))
    out = np.zeros((rows, tables, min(probes, len(choices))), np.uint64)
    for t in range(tables):
        vertices, costs = [], []
        for _ in range(width):
            y = padded
            for signs in random.choice([-1.0, 1.0], size=(3, size)):
                y = hadamard(y * signs)
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, NEXT - 1, axis=1)[:, :NEXT]
            value = np.take_along_axis(both, top, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            vertices.append(top)
            costs.append((value[:, :1] - value) ** 2)
        total = sum(c[:, choices[:, j]] for j, c in enumerate(costs))
        best = np.argsort(total, axis=1, kind="stable")[:, : out.shape[2]]
        key = np.full(best.shape, (t + 1) * 0x9E3779B97F4A7C15 + dims & 2**64 - 1, np.uint64)
        for j, top in enumerate(vertices):
            key = mix64(key * np.uint64(2 * size + 1) + np.take_along_axis(top, choices[best][:, :, j], 1).astype(np.uint64))
        out[:, t] = key
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_shared(a: np.ndarray, b: np.ndarray, bucket: np.uint64) -> np.ndarray:
    """For rows of (tables, probes) names that share `bucket`: whether it is the first they share."""
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    shared = np.where(same, a, np.uint64(2**64 - 1))
    table = same.any(axis=2).argmax(axis=1)
    return shared[np.arange(len(a)), table].min(axis=1) == bucket


def _links(x: np.ndarray, side: np.ndarray, cross: bool, names_of: Callable, weight: np.ndarray, node: np.ndarray, bucket: np.uint64, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a link, their links' weight, the smallest node of each one's component within the group). names_of gives
    (rows, tables, probes) names of given vectors: only those with a link are asked for, so names needn't be sent with the vectors."""
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    if cross:
        near &= side[:, None] != side
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return some, weight[:0], node[:0]
    near = near[np.ix_(some, some)]
    i, j = np.nonzero(np.triu(near))
    names = names_of(x[some])
    count = np.zeros(len(some), np.int64)
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        first = _first_shared(names[a], names[b], bucket)
        np.add.at(count, a[first], weight[some[b[first]]])
        np.add.at(count, b[first], weight[some[a[first]]])
    label = node[some]
    while True:
        new = np.minimum(label, np.where(near, label, np.int64(2**63 - 1)).min(axis=1))
        if (new == label).all():
            return some, count, label
        label = new


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.95, probes: int = PROBES) -> DataFrame:
    """For each row: id_col, n_links (other rows with a cosine of `least` or more), component_id (the smallest id that the row
    reaches by links, itself included), kept (id_col equals component_id).

    vector: array<float> or array<double>; cosines are computed in double precision. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing; vectors of different lengths don't link. Repeated rows are linked
    rows of their own. A null id is named as component_id only where all ids of a component are null; its rows are then kept.
    Pairs are found with a probability that falls with their angle: 0.999999 at cosine 0.95 in 64 dimensions; none below
    `least` is ever linked. Other columns are not read; an empty table gives no rows.
    """
    one = F.col("v")
    fine = one.isNotNull() & (F.size(one) > 0) & F.forall(one, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(one, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    clean = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(df.schema[vector].dataType.elementType)).otherwise(x))  # -0.0 is 0.0
    rows = rows.withColumn("v", F.when(F.col("fine"), clean)).withColumn("h", F.when(F.col("fine"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    classes = written(rows.where("fine").groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    dims = [(r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    shape = {d: tables_for(n, d) for d, n in dims}
    kind = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("v", T.ArrayType(df.schema[vector].dataType.elementType))])

    @lean
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.diff(np.asarray(batch.column("v").offsets))
            for d in np.unique(length).tolist():
                of_d = batch.take(pa.array(np.flatnonzero(length == d)))
                for at in range(0, len(of_d), 2048):
                    part = of_d.slice(at, 2048)
                    n = len(part)
                    x = unit(np.asarray(part.column("v").flatten()).reshape(n, d))
                    names = buckets(x, *shape[d], probes).reshape(n, -1).view(np.int64)
                    m = names.shape[1]
                    again = pa.array(np.repeat(np.arange(n), m))
                    yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), part.column("node").take(again), part.column("weight").take(again), part.column("v").take(again)], kind.names)

    def names_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashed(batches):
            yield part.select(["bucket"])

    own = classes.select("node", "weight", "v")
    large = written(own.mapInArrow(names_only, "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    placed = own.mapInArrow(hashed, kind).join(large, "bucket").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "weight", "v")
    groups = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")

    @lean
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(part: pa.Table | pa.RecordBatch) -> pa.RecordBatch | None:
            n = len(part)
            if n < 2:
                return None
            bucket, lo, hi = (part.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
            x = unit(np.asarray(part.column("v").flatten()).reshape(n, -1))
            names = lambda some: buckets(some, *shape[x.shape[1]], probes)
            node = np.asarray(part.column("node"))
            some, count, label = _links(x, np.asarray(part.column("side")), lo != hi, names, np.asarray(part.column("weight")), node, np.int64(bucket).view(np.uint64), least)
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count, pa.int64()), pa.array(label)], ["node", "n", "root"]) if len(some) else None

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a])
                if held and key != last:
                    got = solve(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                    if got is not None:
                        yield got
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            got = solve(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if got is not None:
                yield got

    found = written(groups.mapInArrow(linked, "node long, n long, root long"), "vector-links")
    reached = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("h", "node", "least", "weight").join(counts, "node", "left").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(smallest, "root").select("h", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-classes")
    out = rows.select("id", "fine", "h").join(named, "h", "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
