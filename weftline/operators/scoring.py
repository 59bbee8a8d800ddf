"""Scores of a system alignment against a reference, under several conventions. Each gives one row; counts come from one
full outer join on the pair with presence flags, so every input is shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import measures as M
from weftline.functions import relations as R
from weftline.operators import alignment as A
from weftline.operators.alignment import PAIR


def compared(system: DataFrame, reference: DataFrame) -> DataFrame:
    """(source, target, in_system, in_reference) of all distinct pairs of either side."""
    s = system.select(*PAIR).distinct().withColumn("in_system", F.lit(True))
    r = reference.select(*PAIR).distinct().withColumn("in_reference", F.lit(True))
    both = s.join(r, PAIR, "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_system", "in_reference")})


def _counts() -> list[Column]:
    s, r = F.col("in_system"), F.col("in_reference")
    return [F.count_if(s & r).alias("tp"), F.count_if(s & ~r).alias("fp"), F.count_if(~s & r).alias("fn")]


def with_measures(counts: DataFrame, protocol: str) -> DataFrame:
    """Counts tp, fp, fn and any others with sizes, ratios, their notes and the protocol's name."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    extra = [c for c in counts.columns if c not in ("tp", "fp", "fn")]
    sizes = {"system_size": tp + fp, "reference_size": tp + fn}
    return counts.select("tp", "fp", "fn", *[v.alias(k) for k, v in M.prf(tp, fp, fn).items()], *[v.alias(k) for k, v in sizes.items() if k not in extra], *extra, F.lit(protocol).alias("protocol"))


def plain(system: DataFrame, reference: DataFrame) -> DataFrame:
    return with_measures(compared(system, reference).agg(*_counts()), "plain")


def partial(system: DataFrame, reference: DataFrame) -> DataFrame:
    """Partial gold standard: system pairs count only if the reference has their source as a source or their target as a target;
    the others are ignored. The disjunction is two joins on equality."""
    s = system.select(*PAIR).distinct()
    r = reference.select(*PAIR).distinct()
    flags = s.join(r.withColumn("_pair", F.lit(True)), PAIR, "left").join(r.select("source").distinct().withColumn("_s", F.lit(True)), "source", "left").join(r.select("target").distinct().withColumn("_t", F.lit(True)), "target", "left")
    scope = F.coalesce("_s", "_t", F.lit(False))
    hit = F.coalesce("_pair", F.lit(False))
    own = flags.agg(F.count_if(hit).alias("tp"), F.count_if(scope & ~hit).alias("fp"), F.count_if(~scope).alias("ignored"), F.count("*").alias("system_size"))
    both = own.crossJoin(r.agg(F.count("*").alias("reference_size")))  # one row each
    both = both.withColumn("fn", F.col("reference_size") - F.col("tp")).withColumn("evaluated_size", F.col("system_size") - F.col("ignored"))
    return with_measures(both, "partial")


def canonical(cells: DataFrame) -> DataFrame:
    """Distinct cells (a, b, r), the same for a cell and its reversal."""
    return cells.select(R.canonical_cell(F.col("source"), F.col("target"), F.col("relation")).alias("c")).select("c.*").distinct()


def relation_aware(system: DataFrame, reference: DataFrame, printed: bool = False) -> DataFrame:
    """Cells match with their relation in either orientation. All reference cells of a pair that has a ? cell are left out, and
    each such pair that the system has takes one from the false positives. printed: the ratios as three-place numbers."""
    s = canonical(system).withColumn("in_s", F.lit(1))
    r = canonical(reference).withColumn("in_r", F.lit(1))
    cells = s.join(r, ["a", "b", "r"], "full_outer")
    by_pair = cells.groupBy("a", "b").agg(
        F.count("in_s").alias("s"), F.count("in_r").alias("r"), F.count_if(F.col("in_s").isNotNull() & F.col("in_r").isNotNull()).alias("both"),
        F.coalesce(F.bool_or(F.col("in_r").isNotNull() & (F.col("r") == R.FLAGGED)), F.lit(False)).alias("flagged"),
    )
    free = ~F.col("flagged")
    counts = by_pair.agg(
        F.coalesce(F.sum(F.when(free, F.col("both"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(free, F.col("r") - F.col("both"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("system_cells"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("reference_cells"),
        F.count_if(F.col("flagged") & (F.col("s") > 0)).alias("discounted"),
        F.coalesce(F.sum(F.when(free & (F.col("r") > 0), F.col("s") - F.col("both"))), F.lit(0)).alias("wrong_relation"),
    )
    counts = counts.withColumn("fp", F.col("system_cells") - F.col("discounted") - F.col("tp"))
    out = with_measures(counts, "relation_aware")
    said = M.printed(F.col("tp"), F.col("fp"), F.col("fn"))
    out = out.withColumns({f"printed_{k}": v for k, v in said.items()})
    return out.withColumns({k: F.col(f"printed_{k}") for k in said}) if printed else out


def _less(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    return pairs.join(gone.select(*PAIR), PAIR, "left_anti")


def _removed(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    return before.select(*PAIR).distinct().agg(F.count("*").alias("_n")).crossJoin(after.select(*PAIR).distinct().agg(F.count("*").alias("_m"))).select((F.col("_n") - F.col("_m")).alias(name))


def without_flagged(system: DataFrame, reference: DataFrame, flagged: DataFrame, protocol: str = "coherence_aware") -> DataFrame:
    """Flagged pairs are neither right nor wrong: both sides lose them."""
    out = plain(_less(system, flagged), _less(reference, flagged)).withColumn("protocol", F.lit(protocol))
    hit = system.select(*PAIR).distinct().join(flagged.select(*PAIR).distinct(), PAIR, "left_semi").agg(F.count("*").alias("predicted_flagged"))
    return out.crossJoin(hit)


def coherence_aware(system: DataFrame, reference: DataFrame) -> DataFrame:
    """Of cells: system ? cells are no predictions, reference ? pairs are left out on both sides."""
    return without_flagged(A.pairs(system, True), A.pairs(reference), A.flagged_pairs(reference))


def all_cells(system: DataFrame, reference: DataFrame) -> DataFrame:
    """Every reference cell is a positive, whatever its relation."""
    return plain(A.pairs(system, True), A.pairs(reference)).withColumn("protocol", F.lit("all_cells"))


def null_reference(system: DataFrame, reference: DataFrame, null_pairs: DataFrame) -> DataFrame:
    """Both sides lose the null pairs (training pairs, say)."""
    s, r = _less(system, null_pairs), _less(reference, null_pairs)
    return plain(s, r).withColumn("protocol", F.lit("null_reference")).crossJoin(_removed(system, s, "system_removed")).crossJoin(_removed(reference, r, "reference_removed"))


def masked_split(system: DataFrame, reference: DataFrame, test: DataFrame, masked: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """The reference's test pairs; the system loses the masked pairs of the other splits; flagged pairs count as above."""
    r = reference.select(*PAIR).distinct().join(test.select(*PAIR).distinct(), PAIR, "left_semi")
    s = _less(system.select(*PAIR).distinct(), masked)
    out = plain(s, r) if flagged is None else without_flagged(s, r, flagged)
    return out.withColumn("protocol", F.lit("masked_split")).crossJoin(_removed(system, s, "masked_removed"))


def edition_views(system: DataFrame, reference: DataFrame, edition: int, train: DataFrame | None = None, ignored: DataFrame | None = None, repaired: DataFrame | None = None, split: DataFrame | None = None) -> DataFrame:
    """The views of a yearly biomedical track, a row each: unsupervised and semi_supervised until 2025 (from 2023 on without
    ignored classes); standard, repaired and, with a split, codabench_standard and codabench_repaired from 2026 on."""
    if edition >= 2023 and ignored is not None:
        system = A.without_iris(system, ignored)
    views: dict[str, DataFrame] = {}
    if edition < 2026:
        s, r = A.pairs(system), A.pairs(reference)
        views["unsupervised"] = plain(s, r)
        if train is not None:
            views["semi_supervised"] = plain(_less(s, train), _less(r, train))
    else:
        s = A.pairs(system, True)
        flagged = A.flagged_pairs(repaired) if repaired is not None else None
        views["standard"] = plain(s, A.pairs(reference))
        if flagged is not None:
            views["repaired"] = without_flagged(s, A.pairs(repaired), flagged)
        if split is not None:
            test, masked = split.where("split = 'test'"), split.where("split <> 'test'")
            views["codabench_standard"] = masked_split(s, A.pairs(reference), test, masked)
            if flagged is not None:
                views["codabench_repaired"] = masked_split(s, A.pairs(repaired), test, masked, flagged)
    columns = ["tp", "fp", "fn", "precision", "recall", "f1"]
    out = None
    for name, df in views.items():
        one = df.select(F.lit(name).alias("view"), *columns)
        out = one if out is None else out.unionByName(one)
    return out


def judged(predictions: DataFrame, reference: DataFrame, partial_reference: bool = False) -> DataFrame:
    """Predictions (source, target, verdict) with outcome: error, out_of_scope, tp, fp, fn or tn; errors are told first."""
    r = reference.select(*PAIR).distinct()
    rows = predictions.join(r.withColumn("_in", F.lit(True)), PAIR, "left")
    scope: Column = F.lit(True)
    if partial_reference:
        rows = rows.join(r.select("source").distinct().withColumn("_s", F.lit(True)), "source", "left").join(r.select("target").distinct().withColumn("_t", F.lit(True)), "target", "left")
        scope = F.coalesce("_s", "_t", F.lit(False))
    hit, said = F.coalesce("_in", F.lit(False)), F.col("verdict")
    outcome = F.when(said.isNull(), "error").when(~scope, "out_of_scope").when(said & hit, "tp").when(said, "fp").when(hit, "fn").otherwise("tn")
    return rows.withColumn("outcome", outcome).drop("_in", "_s", "_t")


def oracle_counts(rows: DataFrame, *by: str) -> DataFrame:
    names = {"tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn", "error": "errors", "out_of_scope": "partial_scope_excluded"}
    return rows.groupBy(*by).agg(*[F.count_if(F.col("outcome") == k).alias(v) for k, v in names.items()], F.count("*").alias("total_candidates"))


def oracle(predictions: DataFrame, reference: DataFrame, partial_reference: bool = False, undefined_is_zero: bool = True) -> DataFrame:
    counts = oracle_counts(judged(predictions, reference, partial_reference))
    measured = M.oracle(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), undefined_is_zero=undefined_is_zero)
    return counts.withColumn("oracle_excluded", F.col("errors") + F.col("partial_scope_excluded")).withColumns(measured)


def false_mappings(predictions: DataFrame, reference: DataFrame, partial_reference: bool = False) -> DataFrame:
    """The wrong predictions, with error_type FP or FN."""
    rows = judged(predictions, reference, partial_reference).where(F.col("outcome").isin("fp", "fn"))
    return rows.select(*PAIR, F.col("verdict").alias("oracle_prediction"), "oracle_confidence", (F.col("outcome") == "fn").alias("in_reference"), F.upper("outcome").alias("error_type"))


def strata(system: DataFrame, reference: DataFrame, lanes: list[str], partial_reference: bool = False) -> DataFrame:
    """Counts by lane, of pairs with a lane on each side: a true positive and a miss count in the reference's lane, a false
    positive in the system's. The scope of a partial reference is the whole reference. Lanes without pairs have zeros."""
    s = system.select(*PAIR, F.col("lane").alias("s_lane"))
    r = reference.select(*PAIR, F.col("lane").alias("r_lane"))
    both = s.join(r, PAIR, "full_outer")
    in_s, in_r = F.col("s_lane").isNotNull(), F.col("r_lane").isNotNull()
    scope: Column = F.lit(True)
    if partial_reference:
        both = both.join(r.select("source").distinct().withColumn("_s", F.lit(True)), "source", "left").join(r.select("target").distinct().withColumn("_t", F.lit(True)), "target", "left")
        scope = F.coalesce("_s", "_t", F.lit(False))
    rows = both.withColumn("lane", F.when(in_r, F.col("r_lane")).otherwise(F.col("s_lane"))).withColumn("_scope", scope)
    counts = rows.groupBy("lane").agg(F.count_if(in_s & in_r).alias("tp"), F.count_if(in_s & ~in_r & F.col("_scope")).alias("fp"), F.count_if(in_r & ~in_s).alias("fn"), F.count_if(in_s & ~in_r & ~F.col("_scope")).alias("ignored"))
    every = system.sparkSession.createDataFrame([(x,) for x in lanes], "lane string")
    out = every.join(counts, "lane", "left").fillna(0, ["tp", "fp", "fn", "ignored"])
    measured = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("lane", "tp", "fp", "fn", "ignored", *[v.alias(k) for k, v in measured.items() if k != "metric_notes"])


def strata_by_type(system: DataFrame, reference: DataFrame, partial_reference: bool = False) -> DataFrame:
    """Scores by the type that URIs show; the scope of a partial reference is that of each stratum."""
    kinds = ("class", "property", "instance")
    if not partial_reference:  # one join for all strata
        s, r = (df.select(*PAIR).distinct() for df in (system, reference))
        both = s.withColumn("in_system", F.lit(True)).join(r.withColumn("in_reference", F.lit(True)), PAIR, "full_outer").fillna(False, ["in_system", "in_reference"])
        counts = both.withColumn("stratum", R.mapping_type(F.col("source"), F.col("target"))).where(F.col("stratum").isin(*kinds)).groupBy("stratum").agg(*_counts())
        measured = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
        return counts.select("stratum", "tp", "fp", "fn", *[v.alias(k) for k, v in measured.items() if k in ("precision", "recall", "f1")])
    out = None
    for kind in kinds:
        s, r = (df.where(R.mapping_type(F.col("source"), F.col("target")) == kind) for df in (system, reference))
        one = partial(s, r).select(F.lit(kind).alias("stratum"), "tp", "fp", "fn", "precision", "recall", "f1")
        out = one if out is None else out.unionByName(one)
    return out.where("tp + fp + fn > 0")


def typed_strata(system: DataFrame, reference: DataFrame, types: DataFrame) -> DataFrame:
    """Class and property scores of pairs of which both ends have such a type."""

    def typed(df: DataFrame) -> DataFrame:
        rows = df.select(*PAIR).distinct()
        for side in PAIR:
            rows = rows.join(types.select(F.col("uri").alias(side), F.col("type").alias(f"_{side}")), side, "left")
        return rows.withColumn("kind", R.typed_pair(F.col("_source"), F.col("_target")))

    both = typed(system).withColumn("in_system", F.lit(True)).select(*PAIR, "kind", "in_system").join(typed(reference).withColumn("in_reference", F.lit(True)).select(*PAIR, "kind", "in_reference"), [*PAIR, "kind"], "full_outer")
    both = both.fillna(False, ["in_system", "in_reference"]).where(F.col("kind").isin("class", "property"))
    counts = both.groupBy("kind").agg(*_counts())
    measured = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("kind", "tp", "fp", "fn", *[v.alias(k) for k, v in measured.items() if k != "metric_notes"])


def oracle_strata(predictions: DataFrame, reference: DataFrame, lanes: DataFrame, partial_reference: bool = False) -> DataFrame:
    """Oracle counts and ratios by the lane that the asked pair has; undefined ratios are null."""
    rows = judged(predictions, reference, partial_reference).join(lanes.select(*PAIR, "lane"), PAIR, "left").withColumn("lane", F.coalesce("lane", F.lit("unknown")))
    counts = oracle_counts(rows, "lane")
    measured = M.oracle(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), undefined_is_zero=False)
    return counts.select(*counts.columns, *[v.alias(k) for k, v in measured.items() if k != "metric_notes"])


def reconcile(strata_rows: DataFrame, whole: DataFrame, fields: list[str]) -> DataFrame:
    """(field, total, expected) of the fields whose sum over the lanes isn't the whole's; no rows mean that all agree."""
    sums = strata_rows.agg(*[F.sum(f).alias(f) for f in fields]).unpivot([], fields, "field", "total")
    wanted = whole.select(*fields).unpivot([], fields, "field", "expected")
    return sums.join(wanted, "field").where("NOT total <=> expected")


def payload_violations(blocks: DataFrame) -> DataFrame:
    """Rows of metric blocks (tp, fp, fn, precision, recall, f1, metric_notes) whose ratios don't follow from the counts or whose
    undefined ratios have no note: the columns and `problem`."""
    right = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    problem = F.lit(None).cast("string")
    for k in ("f1", "recall", "precision"):
        off = F.coalesce(F.abs(F.col(k) - right[k]) > 1e-9, F.col(k).isNull() != right[k].isNull())
        note = F.col(k).isNull() & F.coalesce(~F.map_contains_key("metric_notes", k), F.lit(True))
        problem = F.when(off, f"{k} doesn't follow from the counts").when(note, f"{k} has no note").otherwise(problem)
    negative = (F.col("tp") < 0) | (F.col("fp") < 0) | (F.col("fn") < 0)
    return blocks.withColumn("problem", F.when(negative, "a count is negative").otherwise(problem)).where("problem IS NOT NULL")
