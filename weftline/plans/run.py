"""One run: candidates, questions, answers, refinement, scores and a report. The matcher is a file of its results."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.functions import templates as T
from weftline.operators import alignment as A
from weftline.functions.vocabularies import preset
from weftline.operators import consult as C
from weftline.operators import entities as N
from weftline.operators import fewshot as S
from weftline.operators import graph as G
from weftline.operators.retrieval import mode_of
from weftline.plans import evaluate as V
from weftline.plans.config import Config
from weftline.shared import fresh
from weftline.sources import alignments as L
from weftline.sources import artifacts as O

# fixed values
ANSWERS = {"true_false": ("True", "False"), "yes_no": ("Yes", "No")}
LANES = {"CLS": "template", "OPROP": "property_template", "DPROP": "property_template", "INST": "instance_template"}


def questions(asked: DataFrame, sources: dict[str, DataFrame], targets: dict[str, DataFrame], config: Config) -> tuple[DataFrame, DataFrame]:
    """(prompts, skipped). sources and targets: by kind (CLS, OPROP, DPROP, INST) a table (uri, e) of entity structs. A pair is asked
    in the lane of its tag; a bidirectional class template asks both ways. Pairs without an entity on a side are skipped."""
    context = T.Context(config.oracle.answer_format, config.oracle.response_mode, config.task.domain)
    rows = asked.withColumn("lane", F.coalesce(R.known_kind(F.col("type")), F.lit("CLS")))
    prompts = skipped = None
    for lane, setting in LANES.items():
        name = getattr(config.prompts, setting)
        own = rows.where(F.col("lane") == lane)
        if lane not in sources or lane not in targets:
            one = own.select(*A.PAIR, F.lit(f"no entities of kind {lane}").alias("reason"))
        else:
            pairs = own.join(sources[lane].select(F.col("uri").alias("source"), F.col("e").alias("_s")), "source", "left").join(targets[lane].select(F.col("uri").alias("target"), F.col("e").alias("_t")), "target", "left")
            whole = F.col("_s").isNotNull() & F.col("_t").isNotNull()
            ways = [F.struct(F.lit("forward").alias("direction"), T.question(name, F.col("_s"), F.col("_t"), context).alias("prompt"))]
            if T.REGISTRY[name].bidirectional and lane == "CLS":
                ways.append(F.struct(F.lit("reverse").alias("direction"), T.question(name, F.col("_t"), F.col("_s"), context).alias("prompt")))
            asked_both = pairs.where(whole).select(*A.PAIR, F.explode(F.array(*ways)).alias("q")).select(*A.PAIR, "q.direction", "q.prompt").groupBy(*A.PAIR, "direction").agg(F.min("prompt").alias("prompt"))
            prompts = asked_both if prompts is None else prompts.unionByName(asked_both)
            one = pairs.where(~whole).select(*A.PAIR, F.lit("an entity is missing").alias("reason"))
        skipped = one if skipped is None else skipped.unionByName(one)
    if prompts is None:
        prompts = asked.sparkSession.createDataFrame([], "source string, target string, direction string, prompt string")
    return prompts, skipped


def from_ontologies(spark: SparkSession, config: Config) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The entity tables of both ontologies; the triples are written first, as each kind reads them."""
    out = []
    for side in (config.task.source_ontology, config.task.target_ontology):
        place = fresh(spark, "triples")
        L.read_ontology(spark, side).write.parquet(place)
        out.append(N.entities(spark.read.parquet(place), preset(config.task.vocabulary)))
    return out[0], out[1]


def examples(asked: DataFrame, sources: dict[str, DataFrame], targets: dict[str, DataFrame], config: Config) -> DataFrame | None:
    """(place, user, assistant): the run's static examples, class pairs of the training reference in the class template; None without."""
    few = config.few_shot
    if not few.k:
        return None
    train = L.read_pairs(asked.sparkSession, config.task.train_reference)
    name, near = config.prompts.template, None
    if mode_of(few.strategy) == "static_hard":
        targets_by_parent = targets["CLS"].select(F.explode("e.parent_names").alias("p"), "uri", F.get("e.names", F.lit(0)).alias("label"))
        tree = targets_by_parent.select(F.col("uri").alias("child"), F.array_join("p", "|").alias("parent")).distinct()
        near = G.siblings(tree, targets_by_parent.select("uri", "label").distinct(), few.k)
    both = T.REGISTRY[name].bidirectional
    rows = S.build(train, asked, few.k, few.seed, near, bidirectional=both)
    context = T.Context(config.oracle.answer_format, config.oracle.response_mode, config.task.domain)
    met = rows.join(sources["CLS"].select(F.col("uri").alias("source"), F.col("e").alias("_s")), "source").join(targets["CLS"].select(F.col("uri").alias("target"), F.col("e").alias("_t")), "target")
    asks = F.when(F.col("direction") == "forward", T.question(name, F.col("_s"), F.col("_t"), context)).otherwise(T.question(name, F.col("_t"), F.col("_s"), context))
    yes, no = ANSWERS[config.oracle.answer_format]
    if config.oracle.response_mode == "structured":
        yes, no = ('{"answer": %s}' % (x.lower() if x in ("True", "False") else f'"{x}"') for x in (yes, no))
    return met.select("place", asks.alias("user"), F.when(F.col("label"), yes).otherwise(no).alias("assistant"))


def run(spark: SparkSession, config: Config, sources: dict[str, DataFrame] | None = None, targets: dict[str, DataFrame] | None = None, ask=None) -> dict:
    """Runs all stages and returns the report, which is also written; a run with a skipped or failed question is degraded. Without entity
    tables they are made from the configured ontologies. ask: a function of messages, in place of the configured oracle; it gets the
    developer's text and the static examples before each question."""
    if sources is None or targets is None:
        sources, targets = from_ontologies(spark, config)
    began, out = time.time(), config.output.folder
    initial, asked = L.read_alignment(spark, config.task.initial_alignment), L.read_asked(spark, config.task.asked)
    prompts, skipped = questions(asked, sources, targets, config)
    shown = examples(asked, sources, targets, config)
    if shown is not None:
        shown.write.mode("overwrite").parquet(f"{out}/few_shot")
        shown = spark.read.parquet(f"{out}/few_shot")
    if ask is not None:
        answers = C.live(C.messages(prompts, T.system_prompt(config.prompts.developer, config.oracle.answer_format, config.oracle.response_mode), shown), ask, config.oracle.max_workers)
    else:
        answers = C.stub(prompts, config.oracle.modulus) if config.oracle.source == "stub" else C.recorded(prompts, spark.read.parquet(config.oracle.answers))
    answers.write.mode("overwrite").parquet(f"{out}/answers")
    answers = spark.read.parquet(f"{out}/answers")
    both = T.REGISTRY[config.prompts.template].bidirectional
    found = C.both_ways(asked, answers) if both else C.predictions(asked, answers)
    accepted = found.where(F.coalesce("verdict", F.lit(False)))
    if config.output.retain_confidence:
        accepted = accepted.withColumn("confidence", F.col("oracle_confidence"))
    refined = A.refined(initial, asked, accepted, config.output.retain_confidence).withColumn("_pos", F.struct("_part", "_pos"))
    O.write_lines(refined, f"{out}/refined.tsv", "\t", "source", "target", "relation", "confidence", "type")
    counts = {r["state"]: r["n"] for r in C.summary(found).collect()}
    report = {"run_id": config.run_id, "verdicts": counts, "skipped": skipped.count(), "status": "degraded" if counts.get("error") or counts.get("skipped") else "success"}
    if config.task.reference:
        engine = V.engine("partial" if config.task.partial_reference else "plain")
        report["evaluation"] = V.evaluate(spark, f"{out}/refined.tsv", config.task.reference, metrics=config.output.metrics, primary=engine, train=config.task.train_reference or None, output=f"{out}/evaluation.json")
    report["seconds"] = round(time.time() - began, 3)
    O.write_json(f"{out}/run_result.json", report)
    return report
