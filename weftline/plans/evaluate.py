"""Scoring of alignment files: engines by name, their options, and one document of all metric blocks."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import alignment as A
from weftline.operators import scoring as S
from weftline.sources import alignments as L
from weftline.sources import artifacts as O

Read = Callable[[SparkSession, str], DataFrame]


class Engine(ABC):
    """Scores a system file against a reference file; `globally` gives one row."""

    name = ""
    partial = False

    def __init__(self, **options) -> None:
        self.options = options

    @abstractmethod
    def globally(self, spark: SparkSession, system: str, reference: str, train: str | None) -> DataFrame: ...

    def reference_pairs(self, spark: SparkSession, reference: str) -> DataFrame:
        """The pairs that count as right for the oracle."""
        return L.read_pairs(spark, reference)

    def ranking(self, *_args) -> None:
        """No engine ranks candidates."""


class Plain(Engine):
    name = "plain"

    def globally(self, spark, system, reference, train):
        s, r = L.read_pairs(spark, system), L.read_pairs(spark, reference)
        return S.plain(s, r) if train is None else S.null_reference(s, r, L.read_pairs(spark, train))


class Partial(Engine):
    name, partial = "partial", True

    def globally(self, spark, system, reference, train):
        if train is not None:
            raise ValueError("a partial reference takes no training pairs")
        return S.partial(L.read_pairs(spark, system), L.read_pairs(spark, reference))


class RelationAware(Engine):
    name = "relation_aware"

    def globally(self, spark, system, reference, train):
        return S.relation_aware(L.read_cells(spark, system), L.read_cells(spark, self.options.get("reference", reference)), bool(self.options.get("rounded")))

    def reference_pairs(self, spark, reference):
        return A.oriented_both_ways(L.read_cells(spark, self.options.get("reference", reference)))


class Edition(Engine):
    """A yearly biomedical track; options: edition, ignored, repaired, split (paths)."""

    name = "edition"

    def views(self, spark, system, reference, train):
        read = lambda key, f: f(spark, self.options[key]) if self.options.get(key) else None
        return S.edition_views(L.read_cells(spark, system), L.read_cells(spark, reference), int(self.options.get("edition", 2025)), None if train is None else L.read_pairs(spark, train), read("ignored", L.read_iris), read("repaired", L.read_cells), read("split", L.read_split))

    def globally(self, spark, system, reference, train):
        views = self.views(spark, system, reference, train)
        first = "standard" if int(self.options.get("edition", 2025)) >= 2026 else "semi_supervised" if train is not None else "unsupervised"
        return views.where(views["view"] == first)


ENGINES: dict[str, type[Engine]] = {e.name: e for e in (Plain, Partial, RelationAware, Edition)}


def engine(name: str, **options) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name](**options)


def options_of(texts: list[str]) -> dict[str, dict]:
    """engine.key=value texts; true, false and whole numbers are read as such."""
    out: dict[str, dict] = {}
    for text in texts:
        path, found, value = text.partition("=")
        name, dot, key = path.partition(".")
        if not found or not dot:
            raise ValueError(f"not engine.key=value: {text}")
        out.setdefault(name, {})[key] = {"true": True, "false": False}.get(value.lower(), int(value) if value.lstrip("-").isdigit() else value)
    return out


def find_reference(folder: str, task: str) -> str | None:
    """The first of the usual places of a task's reference that is there."""
    for name in (f"{task}/reference.rdf", f"{task}/reference.tsv", f"{task}/refs_equiv/full.tsv", f"{task}.rdf", f"{task}.tsv"):
        if os.path.exists(path := f"{folder}/{name}"):
            return path
    return None


METRICS = ("global", "stratified", "oracle")


def evaluate(spark: SparkSession, system: str, reference: str, *, metrics: tuple[str, ...] = ("global",), primary: Engine | None = None, extra: tuple[Engine, ...] = (), train: str | None = None, predictions: str | None = None, initial: str | None = None, output: str | None = None) -> dict:
    """The document of all blocks: global by the primary engine, extra engines by name, strata by URI and by type, the oracle. It
    is written with output, and the oracle's wrong answers beside it. Blocks whose ratios don't follow from their counts raise."""
    wrong = set(metrics) - set(METRICS)
    if wrong:
        raise ValueError(f"unknown metrics {', '.join(sorted(wrong))}")
    primary = primary or Plain()
    whole = primary.globally(spark, system, reference, train)
    if "metric_notes" in whole.columns and (bad := S.payload_violations(whole).collect()):
        raise ValueError(bad[0]["problem"])
    out: dict = {"engine": primary.name, "global": O.json_safe(whole.head())}
    for e in extra:
        out.setdefault("engines", {})[e.name] = O.json_safe(e.globally(spark, system, reference, train).head())
    if "stratified" in metrics:
        s, r = L.read_pairs(spark, system), L.read_pairs(spark, reference)
        out["by_uri"] = [O.json_safe(x) for x in S.strata_by_type(s, r, primary.partial).collect()]
        if initial:
            types = A.types_by_uri(L.read_alignment(spark, initial))
            out["by_type"] = [O.json_safe(x) for x in S.typed_strata(s, r, types).collect()]
    if "oracle" in metrics and predictions:
        said, right = L.read_predictions(spark, predictions), primary.reference_pairs(spark, reference)
        out["oracle"] = O.json_safe(S.oracle(said, right, primary.partial).head())
        if output:
            O.write_false_mappings(S.false_mappings(said, right, primary.partial), f"{os.path.dirname(output)}/false_mappings")
    if output:
        O.write_json(output, out)
    return out
