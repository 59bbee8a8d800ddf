"""Verdicts of an oracle: a nullable boolean and a state, never one mixed column; and the reading of its answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
POSITIVE, NEGATIVE = ("true", "yes"), ("false", "no")
STRIPPED = " \t\r\n\"'`*_.!,;:()[]{}"
NEGATORS = ("not", "nt", "never", "cannot", "cant", "dont", "doesnt", "didnt", "isnt", "arent", "wasnt", "werent", "no", "none", "nor", "neither", "without", "nope", "false")
CARRIERS = (
    "be", "been", "being", "is", "are", "was", "were", "am",
    "the", "a", "an", "it", "this", "that", "these", "those", "they",
    "really", "necessarily", "actually", "certainly", "definitely", "strictly",
    "exactly", "entirely", "quite", "simply", "just", "always", "then", "so",
    "would", "could", "should", "can", "may", "might", "must", "do", "does", "did",
)
CLAUSE_BORDER = r"[.!?;:\n|–—→]+|,|--+|->|=>|(?<=\s)-(?=\s)"
WORD = r"([a-z]+(?:'[a-z]+)?)"
REACH = 3


def token_verdict(token: Column) -> Column:
    return F.when(token.isin(*POSITIVE), True).when(token.isin(*NEGATIVE), False)


def verdict(text: Column) -> Column:
    """true / yes and false / no in any case, else null."""
    return token_verdict(F.lower(F.trim(text.cast("string"))))


def verdict_state(text: Column) -> Column:
    """true, false, error, skipped, n/a or missing; other texts are errors."""
    clean = F.lower(F.trim(text.cast("string")))
    known = verdict(text)
    return F.when(known, "true").when(~known, "false").when(clean.isNull() | clean.isin("", "nan", "none"), "missing").when(clean.isin("error", "skipped", "n/a"), clean).otherwise("error")


def accepted(value: Column) -> Column:
    """True only for a true verdict."""
    return F.coalesce(value, F.lit(False))


def render_verdict(state: Column) -> Column:
    return F.when(state == "true", "True").when(state == "false", "False").when(state.isin("skipped", "missing"), "SKIPPED").when(state == "n/a", "n/a").otherwise("ERROR")


def confidence(text: Column) -> Column:
    """A number; null, NaN and other texts are 0."""
    return F.coalesce(F.nanvl(text.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def finite_or_one(text: Column) -> Column:
    """A finite number; null, NaN, infinite and other texts are 1."""
    number = text.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 1.0).otherwise(number)


def render_number(value: Column) -> Column:
    """The shortest decimal text: plain from 1e-4 to 1e16, else with an exponent of two digits at least; nan for null and NaN."""
    raw = value.cast("string")
    mantissa, exponent = F.substring_index(raw, "E", 1), F.substring_index(raw, "E", -1).try_cast("int")
    size = F.abs(value)
    digits = F.regexp_replace(F.regexp_replace(mantissa, "-", ""), r"\.", "")
    bare = F.regexp_replace(digits, "0+$", "")
    sign = F.when(value < 0, "-").otherwise("")
    large = F.concat(sign, F.rpad(F.when(bare == "", "0").otherwise(bare), F.greatest(exponent + 1, F.length(bare)), "0"))
    large = F.when(F.length(bare) > exponent + 1, F.concat(sign, F.substring(bare, F.lit(1), exponent + 1), F.lit("."), F.substring(bare, exponent + 2, F.length(bare)))).otherwise(F.concat(large, F.lit(".0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), bare)
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    power = F.when(F.abs(exponent) > 99, F.concat(F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))).otherwise(power)
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), power)
    return F.when(value.isNull() | F.isnan(value), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(~raw.contains("E"), raw).when(size >= 1e16, scientific).when(size >= 1, large).when(size >= 1e-4, small).otherwise(scientific)


def sum_known(first: Column, second: Column) -> Column:
    """The sum with null as 0, but null if both are."""
    return F.when(first.isNull() & second.isNull(), None).otherwise(F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0)))


def first_min(first: Column, second: Column) -> Column:
    """The smaller one; if either is NaN, the first."""
    return F.when(F.isnan(first) | F.isnan(second), first).otherwise(F.least(first, second))


def _stripped(text: Column) -> Column:
    return F.lower(F.trim(text, F.lit(STRIPPED)))


def json_verdict(text: Column) -> Column:
    """A JSON boolean, or an object whose only key is answer, with a boolean or an answer word; of repeated keys the last counts."""
    plain = F.trim(text, F.lit(" \t\r\n"))
    keys = F.json_object_keys(text)
    only = keys.isNotNull() & (F.size(keys) > 0) & F.forall(keys, lambda k: k == "answer")
    said = F.from_json(text, "answer string")["answer"]
    return F.when(plain.isin("true", "false"), plain == "true").when(only, token_verdict(_stripped(said)))


def _negated(words: Column, index: Column) -> Column:
    """A negator among the three words before, with only carriers between."""
    out = F.lit(False)
    for back in range(REACH, 0, -1):
        word = F.get(words, index - back)
        out = F.when(word.isNull(), False).when(word.isin(*NEGATORS), True).when(word.isin(*CARRIERS), out).otherwise(False)
    return out


def clause_verdicts(text: Column) -> Column:
    """An array for each clause with an answer word: the words' verdicts, turned where a negator governs them."""

    def of_clause(clause: Column) -> Column:
        words = F.transform(F.regexp_extract_all(clause, F.lit(WORD)), lambda w: F.replace(w, F.lit("'"), F.lit("")))
        found = F.transform(words, lambda w, i: F.when(_negated(words, i), ~token_verdict(w)).otherwise(token_verdict(w)))
        return F.filter(found, lambda v: v.isNotNull())

    return F.filter(F.transform(F.split(F.lower(text), CLAUSE_BORDER), of_clause), lambda x: F.size(x) > 0)


def parse_answer(text: Column) -> Column:
    """struct(verdict, reason) of a free answer: an answer word by itself, else JSON, else the clauses' verdicts if they agree,
    else those of the last clause if these agree; otherwise verdict is null and reason says empty, unparsed or ambiguous."""
    clean = F.trim(text, F.lit(" \t\r\n\f\v"))
    clauses = clause_verdicts(clean)
    flat = F.flatten(clauses)
    last = F.try_element_at(clauses, F.lit(-1))
    scanned = F.when(F.size(F.array_distinct(flat)) == 1, F.get(flat, F.lit(0))).when(F.size(F.array_distinct(last)) == 1, F.get(last, F.lit(0)))
    value = F.coalesce(token_verdict(_stripped(clean)), json_verdict(clean), scanned)
    reason = F.when(value.isNotNull(), None).when(text.isNull(), "empty").when(F.size(clauses) == 0, "unparsed").otherwise("ambiguous")
    return F.struct(value.alias("verdict"), reason.alias("reason"))


def logprob_confidence(tokens: Column, value: Column) -> Column:
    """Probability of the verdict's words at the first answer word. tokens: array<struct<token, logprob, top_logprobs: array<
    struct<token, logprob>>>>. NaN without such a place or without a word of the verdict there."""

    def clean(x: Column) -> Column:
        return F.lower(F.trim(x, F.lit(" \t\r\n")))

    first = F.get(F.filter(tokens, lambda t: clean(t["token"]).isin(*POSITIVE, *NEGATIVE)), F.lit(0))
    side = F.coalesce(value, clean(first["token"]).isin(*POSITIVE))
    every = F.concat(F.array(F.struct(first["token"].alias("token"), first["logprob"].alias("logprob"))), F.coalesce(F.transform(first["top_logprobs"], lambda e: F.struct(e["token"].alias("token"), e["logprob"].alias("logprob"))), F.array().cast("array<struct<token:string,logprob:double>>")))
    fitting = F.filter(every, lambda e: F.when(side, clean(e["token"]).isin(*POSITIVE)).otherwise(clean(e["token"]).isin(*NEGATIVE)) & e["logprob"].isNotNull())
    best = F.array_max(F.transform(fitting, lambda e: e["logprob"]))
    # least and greatest skip nulls
    return F.when(best.isNull(), F.lit(float("nan"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(best))))
