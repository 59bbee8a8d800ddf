"""Asking an oracle. The endpoint is a source of verdicts: a stub, recorded answers, or a caller's function in `live`."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import keys as K
from weftline.functions import verdicts as V
from weftline.operators.alignment import PAIR

# fixed values
TRANSIENT_STATUS = (429, 500, 502, 503, 504)
RETRIES, CONSECUTIVE = 2, 5
STYLES = ("openrouter", "openai_chat_completions_parse_structured_output", "vllm", "sglang", "local")
MESSAGES = "array<struct<role: string, content: string>>"

ANSWER = "source string, target string, direction string, verdict boolean, state string, oracle_confidence double, input_tokens long, output_tokens long, raw string"


def stub(prompts: DataFrame, modulus: int = 2) -> DataFrame:
    """The deterministic offline oracle: a verdict from the prompt's digest, with confidence 1 and estimated tokens."""
    said = K.stable_accept(F.col("prompt"), modulus)
    return prompts.select(*PAIR, "direction", said.alias("verdict"), F.when(said, "true").otherwise("false").alias("state"), F.lit(1.0).alias("oracle_confidence"), K.token_estimate(F.col("prompt")).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.when(said, "true").otherwise("false").alias("raw"))


def recorded(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (source, target, direction, raw, tokens: array or null) read by the rules for free answers; prompts without an answer are errors."""
    sure = V.logprob_confidence(F.col("tokens"), F.col("_p.verdict")) if "tokens" in answers.columns else F.lit(float("nan"))
    return _read(prompts.join(answers, [*PAIR, "direction"], "left"), sure)


def _read(rows: DataFrame, sure: Column) -> DataFrame:
    rows = rows.withColumn("_p", V.parse_answer(F.col("raw")))
    return rows.select(*PAIR, "direction", F.col("_p.verdict").alias("verdict"), F.when(F.col("_p.verdict").isNull(), "error").when(F.col("_p.verdict"), "true").otherwise("false").alias("state"), sure.alias("oracle_confidence"), K.token_estimate(F.col("prompt")).alias("input_tokens"), K.token_estimate(F.coalesce("raw", F.lit(""))).alias("output_tokens"), "raw")


class Transient(Exception):
    """Raised by a caller's function where a call may be repeated: connection lost, TRANSIENT_STATUS, or no choices."""


def messages(prompts: DataFrame, developer: str | None = None, examples: DataFrame | None = None, style: str = "openrouter") -> DataFrame:
    """prompts with `messages` (array of role and content): the developer's text, the shared or own examples as turns, the prompt.
    examples (place, user, assistant) are shared by all prompts, with key columns of a pair they belong to that pair."""
    role = system_role(style)
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    head = F.array(turn(role, F.lit(developer))) if developer else F.array().cast(MESSAGES)
    turns, rows = F.array().cast(MESSAGES), prompts
    if examples is not None:
        said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "user", "assistant"))), lambda x: F.array(turn("user", x["user"]), turn("assistant", x["assistant"])))).cast(MESSAGES)
        own = [c for c in (*PAIR, "direction") if c in examples.columns]
        if own:
            rows = prompts.join(examples.groupBy(*own).agg(said.alias("_turns")), own, "left")
        else:
            rows = prompts.crossJoin(F.broadcast(examples.agg(said.alias("_turns"))))  # one row
        turns = F.coalesce("_turns", turns)
    return rows.withColumn("messages", F.concat(head, turns, F.array(turn("user", F.col("prompt")))).cast(MESSAGES)).select(*prompts.columns, "messages")


def interaction_style(requested: str, url: str | None) -> str:
    """The named style; `auto` goes by the endpoint's address."""
    if requested.lower() == "auto":
        return "openrouter" if "openrouter.ai" in (url or "") else "vllm"
    if requested not in STYLES:
        raise ValueError(f"unknown interaction style {requested}")
    return requested


def system_role(style: str) -> str:
    return "system" if style in ("vllm", "sglang") else "developer"


def live(prompts: DataFrame, ask: Callable, workers: int = 8, retries: int = RETRIES, seed: int = 0) -> DataFrame:
    """Calls ask once for each row, from `workers` threads in each task: ask(prompt), or ask(list of (role, content)) if prompts have the
    column of `messages`. It repeats after Transient, with growing delays, and records any other failure as an error. Write the
    result before it is used, as a task that is run again asks again. Repeated rows are asked each."""

    def delay(key: str, n: int) -> float:
        import hashlib

        part = int.from_bytes(hashlib.sha256(f"{seed}:{key}:{n}".encode()).digest()[:8], "big") / 2**64
        return 0.5 * 2 ** min(n - 1, 4) * (1 + part / 4)

    def one(row: tuple) -> str | None:
        source, target, prompt = row
        for n in range(retries + 1):
            try:
                return ask(prompt)
            except Transient:
                if n < retries:
                    time.sleep(delay(f"{source}|{target}", n + 1))
            except Exception:
                return None
        return None

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                said = pdf["prompt"] if "messages" not in pdf else [[(m["role"], m["content"]) for m in row] for row in pdf["messages"]]
                yield pdf[["source", "target", "direction", "prompt"]].assign(raw=list(pool.map(one, zip(pdf["source"], pdf["target"], said, strict=True))))

    own = ["messages"] if "messages" in prompts.columns else []
    return _read(prompts.select(*PAIR, "direction", "prompt", *own).mapInPandas(run, "source string, target string, direction string, prompt string, raw string"), F.lit(float("nan")))


def predictions(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Asked rows with the forward answer; rows without one are skipped."""
    rows = asked.join(answers.where("direction = 'forward'").drop("direction"), PAIR, "left")
    return rows.withColumn("state", F.coalesce("state", F.lit("skipped")))


def both_ways(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Asked rows with one verdict from both directions.

    Class pairs are true if both directions are; an error in either is an error; the confidence is the smaller one (the forward
    one if either is NaN) and tokens add up, null only if both are. Typed pairs of other kinds carry the forward answer, with
    n/a for the reverse. Without the answers that it needs a pair is skipped.
    """
    columns = ["verdict", "state", "oracle_confidence", "input_tokens", "output_tokens"]

    def side(direction: str, mark: str) -> DataFrame:
        return answers.where(F.col("direction") == direction).select(*PAIR, *[F.col(c).alias(f"{mark}_{c}") for c in columns])

    rows = asked.join(side("forward", "f"), PAIR, "left").join(side("reverse", "r"), PAIR, "left")
    single = F.col("type").isin("OPROP", "DPROP", "INST") & F.col("f_state").isNotNull()
    whole = F.col("f_state").isNotNull() & F.col("r_state").isNotNull()
    broken = (F.col("f_state") == "error") | (F.col("r_state") == "error")
    both = V.accepted(F.col("f_verdict")) & V.accepted(F.col("r_verdict"))
    state = F.when(single, F.col("f_state")).when(~whole, "skipped").when(broken, "error").when(both, "true").otherwise("false")
    nan = F.lit(float("nan"))
    sure = F.when(single, F.col("f_oracle_confidence")).when(~whole, nan).otherwise(V.first_min(F.col("f_oracle_confidence"), F.col("r_oracle_confidence")))

    def tokens(name: str) -> Column:
        return F.when(single, F.col(f"f_{name}")).when(whole, V.sum_known(F.col(f"f_{name}"), F.col(f"r_{name}")))

    known = single | whole
    return rows.select(
        *asked.columns, V.verdict(state).alias("verdict"), state.alias("state"), sure.alias("oracle_confidence"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
        F.when(known, F.col("f_state")).otherwise("skipped").alias("forward_state"), F.when(single, "n/a").when(whole, F.col("r_state")).otherwise("skipped").alias("reverse_state"),
        F.when(known, F.col("f_oracle_confidence")).otherwise(nan).alias("forward_confidence"), F.when(single | ~whole, nan).otherwise(F.col("r_oracle_confidence")).alias("reverse_confidence"),
    )


def first_abort(log: DataFrame, total: int, floor: int | None = None, consecutive: int = CONSECUTIVE, run: str = "run") -> DataFrame:
    """(run, at, in_a_row, errors): where each run's log (run, at, state), in order of completion, first has `consecutive` errors in
    a row or the tolerated number in all. Each run is one ordered group; errors in a row are counted from the last success."""
    order = Window.partitionBy(run).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("state") == "error"
    rows = log.withColumn("errors", F.sum(bad.cast("long")).over(order)).withColumn("_ok", F.coalesce(F.max(F.when(~bad, F.col("errors") - bad.cast("long"))).over(order), F.lit(0)))
    rows = rows.withColumn("in_a_row", F.when(bad, F.col("errors") - F.col("_ok")).otherwise(0))
    limit = K.failure_tolerance(F.lit(total), F.lit(floor).cast("long") if floor is not None else None)
    return rows.where(bad & ((F.col("in_a_row") >= consecutive) | (F.col("errors") >= limit))).groupBy(run).agg(F.min(F.struct("at", "in_a_row", "errors")).alias("a")).select(run, "a.*")


def summary(rows: DataFrame) -> DataFrame:
    """(state, n)."""
    return rows.groupBy("state").agg(F.count("*").alias("n"))


def fallback_counts(traces: DataFrame) -> DataFrame:
    """(lane, reason, n) of the reasons in `fallback`, which are joined by '; '."""
    return traces.where(F.coalesce(F.col("fallback"), F.lit("")) != "").select("lane", F.explode(F.split("fallback", "; ")).alias("reason")).groupBy("lane", "reason").agg(F.count("*").alias("n"))


def ranking_questions(initial: DataFrame, asked: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(source, target, type, label): up to `most` unasked = rows as positives, chosen by a hash with the seed, and for each a
    negative with the target of the next one of its kind."""
    rows = initial.where("relation = '='").join(asked.select(*PAIR).distinct(), PAIR, "left_anti").select(*PAIR, "type").distinct()
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "source", "target"), "source", "target").limit(most)
    window = Window.partitionBy("type").orderBy("source", "target")
    other = F.coalesce(F.lead("target").over(window), F.first("target").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    wrong = chosen.withColumn("_t", other).where("_t <> target").select("source", F.col("_t").alias("target"), "type").join(initial.select(*PAIR).distinct(), PAIR, "left_anti")
    return chosen.withColumn("label", F.lit(True)).unionByName(wrong.withColumn("label", F.lit(False)))


def candidate_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(model, correct, errors, place) of answers (model, source, target, verdict): most correct first, then fewest errors, then model."""
    rows = questions.select(*PAIR, "label").join(answers, PAIR)
    out = rows.groupBy("model").agg(F.count_if(F.col("verdict") == F.col("label")).alias("correct"), F.count_if(F.col("verdict").isNull()).alias("errors"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("correct"), "errors", "model")))
