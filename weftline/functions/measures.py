"""Ratios of confusion counts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest); null if that is 0 / 0."""
    whole = part + rest
    return F.when(whole > 0, part / whole)


def harmonic(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(ratio(tp, fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(tp, fn), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(harmonic(p, r), F.lit(0.0))


sensitivity = recall


def specificity(tn: Column, fp: Column) -> Column:
    return F.coalesce(ratio(tn, fp), F.lit(0.0))


def youden(sens: Column, spec: Column) -> Column:
    return sens + spec - 1


def notes(**undefined: tuple[Column, str]) -> Column:
    """map of the names whose Column is null to the reason."""
    entries = F.array(*[F.when(value.isNull(), F.struct(F.lit(name).alias("key"), F.lit(reason).alias("value"))) for name, (value, reason) in undefined.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1, null where undefined, and metric_notes with the reasons."""
    p, r = ratio(tp, fp), ratio(tp, fn)
    both = harmonic(p, r)
    why = notes(precision=(p, "undefined: no system mappings (tp+fp=0)"), recall=(r, "undefined: no reference mappings (tp+fn=0)"), f1=(both, "undefined: precision and recall are undefined or both 0"))
    return {"precision": p, "recall": r, "f1": both, "metric_notes": why}


def round3(value: Column) -> Column:
    """floor(1000 x + 0.5) / 1000 on doubles."""
    return F.floor(value * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def printed(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision and recall to three places, and the F1 of these; all 0 where a denominator is 0."""
    fine = (tp + fp > 0) & (tp + fn > 0)
    p = F.when(fine, F.least(F.floor(tp * F.lit(1000.0) / (tp + fp) + 0.5) / F.lit(1000.0), F.lit(1.0))).otherwise(0.0)
    r = F.when(fine, F.least(F.floor(tp * F.lit(1000.0) / (tp + fn) + 0.5) / F.lit(1000.0), F.lit(1.0))).otherwise(0.0)
    both = F.when(p + r > 0, F.floor(F.lit(2000.0) * p * r / (p + r) + 0.5) / F.lit(1000.0)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": both}


def oracle(tp: Column, fp: Column, fn: Column, tn: Column, undefined_is_zero: bool) -> dict[str, Column]:
    """Measures of an oracle as a test. Live blocks have 0 for an undefined precision, recall and F1, strata have null."""
    sens, spec = ratio(tp, fn), ratio(tn, fp)
    j = F.when(sens.isNotNull() & spec.isNotNull(), sens + spec - 1)
    p, r = ratio(tp, fp), ratio(tp, fn)
    both = harmonic(p, r)
    why = notes(sensitivity=(sens, "undefined: no positive reference candidates (tp+fn=0)"), specificity=(spec, "undefined: no negative reference candidates (tn+fp=0)"), youdens_j=(j, "undefined: sensitivity or specificity undefined"))
    if undefined_is_zero:
        p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
        both = f1(p, r)
    return {"sensitivity": sens, "specificity": spec, "youdens_j": j, "oracle_precision": p, "oracle_recall": r, "oracle_f1": both, "metric_notes": why}
