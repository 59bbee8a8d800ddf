"""Experiment matrices: job rows, their order and status, and the summaries of finished jobs."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import keys as K
from weftline.functions import measures as M

AXES = ("task", "model", "condition", "repeat")


def digest(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def merged(base: dict, over: dict) -> dict:
    """base with the values of over; tables merge."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def paths(value: dict, head: str = "") -> dict[str, object]:
    """Dotted paths of the leaves."""
    out: dict[str, object] = {}
    for k, v in value.items():
        name = f"{head}.{k}" if head else str(k)
        out |= paths(v, name) if isinstance(v, dict) and v else {name: v}
    return out


def check_axes(overlays: list[dict]) -> None:
    """No two overlays may set one path to different values, nor one a path below another's."""
    seen: dict[str, object] = {}
    for overlay in overlays:
        for path, value in paths(overlay).items():
            for old, held in seen.items():
                if (old == path and held != value) or old.startswith(path + ".") or path.startswith(old + "."):
                    raise ValueError(f"{path} and {old} are set by two axes")
        seen |= paths(overlay)


def expanded(tasks: DataFrame, models: DataFrame, conditions: DataFrame, repeats: int, excluded: DataFrame | None = None) -> DataFrame:
    """(task, model, condition, repeat, digest, id, _pos): the product of the axes but cells that an exclusion names; a null in an
    exclusion stands for any value. The axes are lists that a person writes, so the product is small."""
    jobs = tasks.select("task").distinct().crossJoin(models.select("model").distinct()).crossJoin(conditions.select("condition").distinct()).crossJoin(tasks.sparkSession.range(1, repeats + 1).select(F.col("id").cast("int").alias("repeat")))
    if excluded is not None:
        hit = reduce(lambda a, b: a & b, [excluded[c].isNull() | (jobs[c] == excluded[c]) for c in AXES if c in excluded.columns])
        jobs = jobs.join(excluded, hit, "left_anti")
    jobs = jobs.withColumn("digest", K.text_digest(F.concat_ws("\x1f", *AXES)))
    jobs = jobs.withColumn("id", K.job_id(F.col("task"), F.col("model"), F.col("condition"), F.concat(F.lit("r"), F.col("repeat").cast("string")), digest=F.col("digest")))
    return jobs.withColumn("_pos", F.row_number().over(Window.orderBy(*AXES)))


def shared_alignments(jobs: DataFrame) -> DataFrame:
    """(alignment, task, jobs): jobs of one task and condition share an alignment."""
    return jobs.groupBy(K.short_digest(F.col("task"), F.col("condition"), size=16).alias("alignment"), "task").agg(F.array_sort(F.collect_list("id")).alias("jobs"))


def selected(jobs: DataFrame, selectors: dict[str, list[str]], limit: int | None = None) -> DataFrame:
    """Jobs whose columns have one of the given values each, in their order; then the first `limit`."""
    for name, values in selectors.items():
        if name not in jobs.columns:
            raise ValueError(f"jobs have no {name}")
        jobs = jobs.where(F.col(name).cast("string").isin(*values))
    ordered = jobs.orderBy("_pos")
    return ordered if limit is None else ordered.limit(limit)


def fair_order(jobs: DataFrame) -> DataFrame:
    """Jobs with `turn`: the first of each model, then the second, and so on."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy("model").orderBy("_pos")))


def model_limits(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("model").agg(F.min("max_parallel").alias("max_parallel"))


def latest(attempts: DataFrame) -> DataFrame:
    """The last attempt of each job."""
    last = attempts.groupBy("id").agg(F.max_by(F.struct("attempt", "status"), "attempt").alias("a"))
    return last.select("id", "a.attempt", "a.status")


def status(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    return jobs.join(latest(attempts), "id", "left").withColumn("status", F.coalesce("status", F.lit("not_run")))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def grouped(rows: DataFrame, by: list[str], metrics: list[str], allow_partial: bool = False) -> DataFrame:
    """For each group: expected, completed, coverage, success, degraded, failed, not_run, and of each metric the mean over completed
    jobs that have it and how many these are; means are null in groups with unfinished jobs, unless allowed."""
    done = F.col("status").isin("success", "degraded")
    counts = [F.count("*").alias("expected"), F.count_if(done).alias("completed"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "degraded", "failed", "not_run")]]
    means = []
    for m in metrics:
        means += [F.avg(F.when(done, F.col(m))).alias(f"mean_{m}"), F.count(F.when(done, F.col(m))).alias(f"n_{m}")]
    out = rows.groupBy(*by).agg(*counts, *means)
    whole = F.lit(True) if allow_partial else F.col("completed") == F.col("expected")
    out = out.withColumn("coverage", F.col("completed") / F.col("expected"))
    return out.withColumns({f"mean_{m}": F.when(whole, F.col(f"mean_{m}")) for m in metrics})


def _counts_known(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) >= 0) for c in names])


def pooled(rows: DataFrame, by: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Sums of tp, fp and fn over the jobs that have all three, with the ratios of the sums; an optional count is summed only where
    each of these jobs has it."""
    names = ("tp", "fp", "fn")
    used = rows.where(_counts_known(names))
    out = used.groupBy(*by).agg(F.count("*").alias("contributors"), *[F.sum(c).alias(c) for c in names], *[F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in optional])
    measured = M.prf(*(F.col(c) for c in names))
    return out.select(*out.columns, *[v.alias(k) for k, v in measured.items() if k != "metric_notes"])


def pooled_oracle(rows: DataFrame, by: list[str]) -> DataFrame:
    names = ("tp", "fp", "fn", "tn")
    out = rows.where(_counts_known(names)).groupBy(*by).agg(F.count("*").alias("contributors"), *[F.sum(c).alias(c) for c in names])
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    measured = M.oracle(*(F.col(c) for c in names), undefined_is_zero=False)
    return out.select(*out.columns, F.when(total > 0, (F.col("tp") + F.col("tn")) / total).alias("accuracy"), *[v.alias(k) for k, v in measured.items() if k != "metric_notes"])


def blocks(metrics: DataFrame) -> DataFrame:
    """(block, place) of metrics in long form (metric named block.field): the block global first, others by name."""
    name = F.substring_index("metric", ".", 1)
    return metrics.select(name.alias("block")).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("block") == "global", 0).otherwise(1), "block")))


def markdown(summary: list[dict], columns: list[str], title: str) -> str:
    """A table of collected summary rows."""

    def cell(v) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    return "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in summary], ""])


def sealed(payload: dict) -> dict:
    body = {k: v for k, v in payload.items() if k != "seal"}
    return {**body, "seal": digest(body)}


def check_seal(payload: dict) -> None:
    if sealed(payload)["seal"] != payload.get("seal"):
        raise ValueError("the manifest was changed after it was sealed")


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_files, n_bytes) of a folder's files, by relative path and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    one = F.sha2(F.concat_ws("\x1f", F.substring_index("path", path.rstrip("/") + "/", -1), F.sha2("content", 256)), 256)
    rows = files.select(one.alias("d"), "length")
    part = lambda a: F.coalesce(F.sum(F.conv(F.substring("d", a, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13), part(25)), 256).alias("digest"), F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
