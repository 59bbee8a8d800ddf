"""Examples that are the same for all questions: positives of the training pairs, made-up negatives, in turn, with an audit.

Draws are by a seeded hash, so they don't depend on the order or the partitions of rows; only the rows that are drawn leave a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.operators.alignment import PAIR

# fixed values
TRIES, LEAST_TRIES = 50, 50


def _draw(seed: int, salt: str, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *columns)


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(R.pair_key(F.col("source"), F.col("target")).alias("_key")).distinct()


def positives(train: DataFrame, asked: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(place, source, target): the first `most` training pairs in drawn order that aren't asked either way round."""
    rows = train.select(*PAIR).distinct().join(_keys(asked), R.pair_key(F.col("source"), F.col("target")) == F.col("_key"), "left_anti")
    drawn = rows.orderBy(_draw(seed, "positive", *PAIR), *PAIR).limit(most)
    return drawn.select(F.row_number().over(Window.orderBy(_draw(seed, "positive", *PAIR), *PAIR)).alias("place"), *PAIR)  # `most` rows


def random_negatives(train: DataFrame, known: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(place, source, target): sources and targets of the training pairs drawn apart, max(50, 50 * most) tries; no known pair and none
    twice, whichever way round. There are fewer than `most` where the tries don't suffice."""
    tries = max(LEAST_TRIES, TRIES * most)

    def side(column: str) -> DataFrame:
        ends = train.select(column).distinct()
        n = ends.count()
        if not n:
            return ends.withColumn("_try", F.lit(0).cast("bigint"))
        # each try takes an end by a hash of its own; ends beyond the number of tries are drawn out first
        few = ends.orderBy(_draw(seed, column, column), column).limit(tries)
        few = few.withColumn("_n", F.row_number().over(Window.orderBy(_draw(seed, column, column), column)) - 1)
        turn = few.sparkSession.range(tries).select(F.col("id").alias("_try"), F.pmod(_draw(seed + 1, column, "id"), F.lit(min(n, tries))).alias("_n"))
        return turn.join(few, "_n").select("_try", column)

    rows = side("source").join(side("target"), "_try").where("source <> target").withColumn("_k", R.pair_key(F.col("source"), F.col("target")))
    rows = rows.join(_keys(known), F.col("_k") == F.col("_key"), "left_anti").groupBy("_k").agg(F.min(F.struct("_try", *PAIR)).alias("f"))
    return rows.select(F.row_number().over(Window.orderBy("f._try")).alias("place"), "f.source", "f.target").where(F.col("place") <= most)


def hard_negatives(train: DataFrame, siblings: DataFrame, asked: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(place, source, target, how): for training pairs in drawn order the source with the first sibling (node, rank, sibling) of its target
    that isn't asked with it: succeeded. Where there are fewer than `most`, random negatives follow: exhausted."""
    near = siblings.select(F.col("node").alias("target"), "rank", "sibling")
    met = train.select(*PAIR).distinct().join(near, "target").where("sibling <> target AND sibling <> source").withColumn("_k", R.pair_key(F.col("source"), F.col("sibling")))
    met = met.join(_keys(asked.select(*PAIR).unionByName(train.select(*PAIR))), F.col("_k") == F.col("_key"), "left_anti")
    best = met.groupBy("source", "target").agg(F.min_by("sibling", F.struct("rank", "sibling")).alias("sibling"))
    order = [_draw(seed, "hard", "source", "target"), "source", "sibling"]
    hard = best.orderBy(*order).limit(most).select(F.row_number().over(Window.orderBy(*order)).alias("place"), "source", F.col("sibling").alias("target"), F.lit("succeeded").alias("how"))
    found = hard.count()
    if found == most:
        return hard
    rest = random_negatives(train, asked.select(*PAIR).unionByName(train.select(*PAIR)).unionByName(hard.select(*PAIR)), most - found, seed)
    return hard.unionByName(rest.select((F.col("place") + found).alias("place"), *PAIR, F.lit("exhausted").alias("how")))


def build(train: DataFrame, asked: DataFrame, k: int, seed: int = 0, siblings: DataFrame | None = None, contrastive: bool = True, bidirectional: bool = False) -> DataFrame:
    """(place, source, target, label, direction, how): k examples, positive and negative in turn (positives only unless contrastive), each
    both ways if bidirectional. Negatives are hard ones if siblings are given. What can't be made is left out."""
    pairs = math.ceil(k / 2) if bidirectional else k
    n_positive = math.ceil(pairs / 2) if contrastive else pairs
    good = positives(train, asked, n_positive, seed).select((2 * F.col("place") - 1 if contrastive else F.col("place")).alias("place"), *PAIR, F.lit(True).alias("label"), F.lit(None).cast("string").alias("how"))
    rows = good
    if contrastive and pairs > n_positive:
        known = asked.select(*PAIR).unionByName(train.select(*PAIR))
        bad = random_negatives(train, known, pairs - n_positive, seed).withColumn("how", F.lit("random")) if siblings is None else hard_negatives(train, siblings, asked, pairs - n_positive, seed)
        rows = good.unionByName(bad.select((2 * F.col("place")).alias("place"), *PAIR, F.lit(False).alias("label"), "how"))
    ways = ["forward", "reverse"] if bidirectional else ["forward"]
    rows = rows.withColumn("direction", F.explode(F.array(*map(F.lit, ways))))
    order = Window.orderBy("place", "direction")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("place", *PAIR, "label", "direction", "how")


def audit(examples: DataFrame) -> DataFrame:
    """(total, eligible, succeeded, exhausted, unsupported, success_rate) of the made-up negatives' `how`; no rate without an eligible one."""
    n = lambda x: F.count_if(F.col("how") == x)
    rows = examples.agg(n("succeeded").alias("succeeded"), n("exhausted").alias("exhausted"), n("unsupported").alias("unsupported"))
    eligible = F.col("succeeded") + F.col("exhausted")
    return rows.select((eligible + F.col("unsupported")).alias("total"), eligible.alias("eligible"), "succeeded", "exhausted", "unsupported", F.when(eligible > 0, F.col("succeeded") / eligible).alias("success_rate"))
