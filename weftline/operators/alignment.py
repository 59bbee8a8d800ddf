"""Operators on alignment rows (source, target, relation, confidence, type) and on pair sets (source, target).

`_pos` is the row's place in its file; where order has a meaning, operators order by it and then by the whole row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.functions import verdicts as V

PAIR = ["source", "target"]


def with_position(df: DataFrame) -> DataFrame:
    """df with `_pos`: the order in which rows are read. It has gaps and is stable for the same files."""
    return df if "_pos" in df.columns else df.withColumn("_pos", F.monotonically_increasing_id())


def in_order(df: DataFrame) -> list[Column]:
    """A total order: by place, then by all columns."""
    return [F.col(c) for c in (["_pos"] if "_pos" in df.columns else []) + [c for c in df.columns if c != "_pos" and not df.schema[c].dataType.typeName().startswith("map")]]


def first_of_pair(df: DataFrame) -> DataFrame:
    """The first row of each oriented pair; the reversed pair is another one. One row for each pair reaches the shuffle
    from a task, as the smallest struct is found by partial aggregation."""
    rest = [c for c in df.columns if c not in PAIR]
    order = [c for c in ["_pos", *rest] if c in df.columns]
    order = list(dict.fromkeys(order))
    first = df.groupBy(*PAIR).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in PAIR else F.col(f"_first.{c}").alias(c) for c in df.columns])


def pairs(cells: DataFrame, drop_flagged: bool = False) -> DataFrame:
    kept = cells.where(F.col("relation") != R.FLAGGED) if drop_flagged else cells
    return kept.select(*PAIR).distinct()


def flagged_pairs(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("relation") == R.FLAGGED).select(*PAIR).distinct()


def without_iris(rows: DataFrame, iris: DataFrame) -> DataFrame:
    """Rows of which neither end is listed; two anti joins on equality, so neither needs a nested loop."""
    listed = iris.select(F.col("iri").alias("_iri"))
    return rows.join(listed, F.col("source") == F.col("_iri"), "left_anti").join(listed, F.col("target") == F.col("_iri"), "left_anti")


def supported(df: DataFrame, least: int) -> DataFrame:
    """Rows with n of at least `least`; with 1 or less, all that have n."""
    return df.where(F.col("n").isNotNull() if least <= 1 else F.col("n") >= least)


def candidates_from_counts(df: DataFrame) -> DataFrame:
    """Composed candidates (source, target, n, gold) as alignment rows: = CLS, confidence n over the largest n; a null n is 1."""
    top = df.agg(F.max("n").alias("_top"))
    share = F.coalesce(F.least(F.col("n") / F.col("_top"), F.lit(1.0)), F.lit(1.0))
    return df.crossJoin(F.broadcast(top)).select("source", "target", F.lit("=").alias("relation"), share.alias("confidence"), F.lit("CLS").alias("type"))  # one row


def unordered_keys(df: DataFrame) -> DataFrame:
    return df.select(R.pair_key(F.col("source"), F.col("target")).alias("key")).distinct()


def oriented_both_ways(df: DataFrame) -> DataFrame:
    return df.select(*PAIR).union(df.select("target", "source")).distinct()


def types_by_uri(df: DataFrame) -> DataFrame:
    """(uri, type): each end of a row has the row's type; the last row decides."""
    rows = with_position(df)
    ends = rows.select(F.explode(F.array("source", "target")).alias("uri"), "type", "_pos")
    return ends.groupBy("uri").agg(F.max_by("type", F.struct("_pos", "type")).alias("type"))


def types_by_pair(df: DataFrame) -> DataFrame:
    rows = with_position(df)
    return rows.groupBy(*PAIR).agg(F.max_by(F.coalesce("type", F.lit("CLS")), F.struct("_pos", "type")).alias("type"))


def lanes_by_pair(df: DataFrame, properties: str = "property") -> DataFrame:
    """(source, target, lane): unknown where the rows of a pair have several lanes."""
    lane = R.lane_of_type(F.col("type"), properties)
    return df.groupBy(*PAIR).agg(F.when(F.min(lane) == F.max(lane), F.min(lane)).otherwise("unknown").alias("lane"))


def refined(initial: DataFrame, asked: DataFrame, accepted: DataFrame, keep_confidence: bool = False) -> DataFrame:
    """Initial rows whose pair wasn't asked, then the accepted rows, as a bag in this order; accepted rows get confidence 1
    where theirs isn't finite, or if it is not to be kept."""
    columns = ["source", "target", "relation", "confidence", "type"]
    retained = with_position(initial).join(asked.select(*PAIR).distinct(), PAIR, "left_anti").select(*columns, F.lit(0).alias("_part"), "_pos")
    value = V.finite_or_one(F.col("confidence")) if keep_confidence else F.lit(1.0)
    added = with_position(accepted).withColumn("confidence", value).select(*columns, F.lit(1).alias("_part"), "_pos")
    return retained.unionByName(added)


def annotated(asked: DataFrame, predictions: DataFrame) -> DataFrame:
    """Asked rows with the first prediction of their trimmed pair: annotation (True, False, SKIPPED, n/a, ERROR) and the text of its confidence."""
    first = first_of_pair(with_position(predictions).select(F.trim("source").alias("source"), F.trim("target").alias("target"), "state", "oracle_confidence", "_pos"))
    first = first.select(F.col("source").alias("_s"), F.col("target").alias("_t"), "state", "oracle_confidence")
    rows = asked.join(first, (F.trim("source") == F.col("_s")) & (F.trim("target") == F.col("_t")), "left")
    return rows.select(*asked.columns, V.render_verdict(F.coalesce("state", F.lit("skipped"))).alias("annotation"), V.render_number(F.col("oracle_confidence")).alias("annotation_confidence"))


def require(df: DataFrame, **violations: Column) -> None:
    """Raises ValueError with the number of rows that violate each named condition; one aggregation for all."""
    counts = df.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in violations.items()]).head().asDict()
    if any(counts.values()):
        raise ValueError(", ".join(f"{k}: {n} rows" for k, n in counts.items() if n))


def prompt_coverage(prompts: DataFrame, asked: DataFrame, reverse: bool = False) -> DataFrame:
    """Violations of coverage: (source, target, problem). prompts has source, target, direction (forward, reverse). Forward
    prompts and asked pairs must be the same; with reverse, class pairs need both directions and other pairs none."""
    forward = prompts.where("direction = 'forward'").select(*PAIR).distinct()
    wanted = types_by_pair(asked)
    out = wanted.join(forward, PAIR, "left_anti").select(*PAIR, F.lit("no prompt").alias("problem")).unionByName(forward.join(wanted, PAIR, "left_anti").select(*PAIR, F.lit("not asked").alias("problem")))
    if reverse:
        back = prompts.where("direction = 'reverse'").select(*PAIR).distinct()
        both = wanted.where(~F.col("type").isin("OPROP", "DPROP", "INST"))
        out = out.unionByName(both.join(back, PAIR, "left_anti").select(*PAIR, F.lit("no reverse prompt").alias("problem")))
        out = out.unionByName(back.join(forward, PAIR, "left_anti").select(*PAIR, F.lit("reverse without forward").alias("problem")))
    return out


def sidecar_partition(reference: DataFrame, sidecars: dict[str, DataFrame]) -> DataFrame:
    """(source, target, lane) of the reference by the sidecar that holds each pair, else unknown. A sidecar pair outside the
    reference and a pair of two sidecars are errors."""
    base = reference.select(*PAIR).distinct()
    listed = None
    for lane, df in sidecars.items():
        one = df.select(*PAIR).distinct().withColumn("lane", F.lit(lane))
        listed = one if listed is None else listed.unionByName(one)
    if listed is None:
        return base.withColumn("lane", F.lit("unknown"))
    grouped = listed.groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("lane").alias("lane"))
    checked = grouped.join(base.withColumn("_in", F.lit(True)), PAIR, "left")
    require(checked, outside_reference=F.col("_in").isNull(), in_two_sidecars=F.col("n") > 1)
    return base.join(grouped.select(*PAIR, "lane"), PAIR, "left").withColumn("lane", F.coalesce("lane", F.lit("unknown")))


def filled_rows(fields: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, type, _pos) of rows of text fields `f` in order of `_pos`: the first five, stripped; what is
    missing is =, 1.0 and CLS; rows of one field are left out; the first of each pair stays."""
    at = lambda i, default=None: F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit(default)))
    rows = fields.where(F.size("f") >= 2).select(at(0).alias("source"), at(1).alias("target"), at(2, "=").alias("relation"), at(3, "1.0").alias("confidence"), at(4, "CLS").alias("type"), "_pos")
    return first_of_pair(rows)


def sealed_predictions(asked: DataFrame, predictions: DataFrame, lane) -> DataFrame:
    """(source, target, lane, verdict, n_asked, n_predicted, problem) of each pair of both tables; problem is null if it is asked once and
    predicted once, in the same lane, else what is wrong. lane: a function from a type column to its lane."""
    a = asked.groupBy(*PAIR).agg(F.count("*").alias("n_asked"), F.min(lane(F.col("type"))).alias("lane"))
    p = predictions.groupBy(*PAIR).agg(F.count("*").alias("n_predicted"), F.min(lane(F.col("type"))).alias("_lane"), F.min("verdict").alias("verdict"))
    rows = a.join(p, PAIR, "full_outer")
    blank = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == "")
    problem = F.when(blank, "blank").when(F.col("n_asked").isNull(), "not asked").when(F.col("n_predicted").isNull(), "no prediction").when(F.col("n_asked") > 1, "asked twice").when(F.col("n_predicted") > 1, "predicted twice").when(F.col("lane") != F.col("_lane"), "other lane")
    return rows.select(*PAIR, "lane", "verdict", F.coalesce("n_asked", F.lit(0)).alias("n_asked"), F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), problem.alias("problem"))


def only_sealed(checked: DataFrame) -> DataFrame:
    """(source, target, lane, verdict) of `sealed_predictions` if nothing is wrong; else an error that counts the problems."""
    wrong = {r["problem"]: r["n"] for r in checked.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n")).collect()}
    if wrong:
        raise ValueError(f"predictions don't fit the asked pairs: {wrong}")
    return checked.select(*PAIR, "lane", "verdict")


def has_reverse(prompts: DataFrame, key: str = "key") -> bool:
    """Whether any prompt key has a third part, which names a direction."""
    return bool(prompts.agg(F.coalesce(F.bool_or(F.size(F.split(key, r"\|")) >= 3), F.lit(False)).alias("b")).head()["b"])


def content_digest(initial: DataFrame, asked: DataFrame) -> str:
    """A digest of both tables' rows that neither their order nor partitions change: that of the sums of the rows' digests' parts."""
    out = []
    for name, df in (("initial", initial), ("asked", asked)):
        row = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in df.columns if not c.startswith("_")])), 256)
        parts = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"p{i}") for i in range(5)]
        out.append(":".join([name, *map(str, df.agg(F.count("*").alias("n"), *parts).head())]))
    return hashlib.sha256("|".join(out).encode()).hexdigest()
