"""From triples to the structs that question templates take: one row (uri, e) for each class, property and instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.functions import text as X
from weftline.functions.vocabularies import Vocabulary, preset
from weftline.operators import graph as G


def _none() -> Column:
    return F.array().cast("array<string>")


def _or_none(column: str) -> Column:
    return F.coalesce(F.col(column), _none())


def _names(triples: DataFrame, uris: DataFrame, preferred: list[str], synonyms: list[str], others: list[str], languages: list[str]) -> DataFrame:
    """(uri, names, synonyms, own_name): the preferred texts, else the labels, else the own name; all annotation texts are synonyms."""
    said = G.annotations(triples, preferred, synonyms, others, languages)
    rows = G.labels(triples, uris).join(said, "uri", "left")
    names = F.when(F.size(_or_none("preferred")) > 0, F.col("preferred")).otherwise(F.col("labels"))
    return rows.select("uri", names.alias("names"), F.array_sort(F.array_distinct(F.concat(_or_none("synonym"), F.col("labels")))).alias("synonyms"), R.local_name(F.col("uri")).alias("own_name"))


def classes(triples: DataFrame, preferred: list[str] | None = None, synonyms: list[str] | None = None, others: list[str] | None = None, vocabulary: Vocabulary | None = None, levels: int = 3, most_siblings: int = 2, most_restrictions: int = 5) -> DataFrame:
    """(uri, e) of the declared classes. levels: how many levels of the hierarchy above a class are told; a class without one has empty lists."""
    v = vocabulary or preset("default")
    uris, tree = G.classes(triples), G.edges(triples)
    named = _names(triples, uris, preferred or [G.LABEL], synonyms or [], others or [], list(v.languages))
    first = named.select("uri", F.get("names", F.lit(0)).alias("first"), "names", F.col("synonyms").alias("said"))
    up = tree.join(first.select(F.col("uri").alias("parent"), "names"), "parent", "left").groupBy(F.col("child").alias("uri")).agg(F.transform(F.array_sort(F.collect_set(F.struct("parent", "names"))), lambda x: x["names"]).alias("parent_names"), F.min("parent").alias("_p"))
    down = tree.join(first.select(F.col("uri").alias("child"), "names"), "child", "left").groupBy(F.col("parent").alias("uri")).agg(F.transform(F.array_sort(F.collect_set(F.struct("child", "names"))), lambda x: x["names"]).alias("child_names"))
    entry = G.levels(tree, uris.select(F.col("uri").alias("node")), levels).groupBy("node", "level").agg(F.min("member").alias("m")).join(first.select(F.col("uri").alias("m"), "first", "said"), "m", "left")
    by_level = entry.groupBy(F.col("node").alias("uri")).agg(F.array_sort(F.collect_list(F.struct("level", "first", "said"))).alias("l"))
    by_level = by_level.select("uri", F.transform("l", lambda x: x["first"]).alias("levels"), F.transform("l", lambda x: F.coalesce(x["said"], _none())).alias("level_synonyms"))
    near = G.siblings(tree, first.select("uri", F.col("first").alias("label")), most_siblings).groupBy(F.col("node").alias("uri")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("siblings"))
    rules = G.first_restrictions(G.restrictions(triples), most_restrictions).groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("restriction_type", "property_name", "filler_name", "cardinality").alias("r")))), lambda x: x["r"]).alias("restrictions"))
    roles = G.relational_signature(triples)
    rows = named
    for other in (up, down, by_level, near, rules, roles):
        rows = rows.join(other, "uri", "left")
    rows = rows.join(first.select(F.col("uri").alias("_p"), F.col("first").alias("parent")), "_p", "left")
    nested = lambda c: F.coalesce(F.col(c), F.array().cast("array<array<string>>"))
    return rows.select("uri", F.struct("names", F.col("synonyms").alias("all_names"), "synonyms", "own_name", "parent", nested("parent_names").alias("parent_names"), nested("child_names").alias("child_names"), _or_none("levels").alias("levels"), nested("level_synonyms").alias("level_synonyms"), _or_none("siblings").alias("siblings"), "restrictions", _or_none("as_domain").alias("as_domain"), _or_none("as_range").alias("as_range")).alias("e"))


def properties(triples: DataFrame, preferred: list[str] | None = None, synonyms: list[str] | None = None, others: list[str] | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(uri, e, is_data) of the declared properties; domain and range are local names, their synonyms those of the classes."""
    v = vocabulary or preset("default")
    view = G.property_view(triples)
    args = (preferred or [G.LABEL], synonyms or [], others or [], list(v.languages))
    said = _names(triples, G.classes(triples), *args).select(F.col("own_name").alias("c"), "synonyms")

    def words(column: str) -> DataFrame:
        return view.select("uri", F.explode(column).alias("c")).join(said, "c").groupBy("uri").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))).alias(f"{column}_synonyms"))

    rows = view.join(_names(triples, view.select("uri"), *args), "uri").join(words("domain"), "uri", "left").join(words("range"), "uri", "left")
    return rows.select("uri", F.struct("names", "own_name", "synonyms", _or_none("domain").alias("domain"), _or_none("range").alias("range"), _or_none("domain_synonyms").alias("domain_synonyms"), _or_none("range_synonyms").alias("range_synonyms"), "is_data", _or_none("characteristics").alias("characteristics"), "inverse").alias("e"), "is_data")


def instances(triples: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(uri, e) of all subjects that are neither classes nor properties."""
    v = vocabulary or preset("default")
    declared = G.classes(triples).unionByName(G.object_properties(triples)).unionByName(G.data_properties(triples)).distinct()
    rows = G.instance_context(triples, list(v.abstract), list(v.categories)).join(declared, "uri", "left_anti")
    named = G.labels(triples, rows.select("uri"))
    return rows.join(named, "uri").select("uri", F.struct(F.col("labels").alias("names"), "uri", _or_none("types").alias("types"), F.col("data").cast(X.PROPERTY).alias("data"), F.col("object").cast(X.PROPERTY).alias("object")).alias("e"))


def entities(triples: DataFrame, vocabulary: Vocabulary | None = None, **annotations) -> dict[str, DataFrame]:
    """The tables by kind that `plans.run` takes."""
    p = properties(triples, vocabulary=vocabulary, **annotations)
    return {"CLS": classes(triples, vocabulary=vocabulary, **annotations), "OPROP": p.where("NOT is_data").drop("is_data"), "DPROP": p.where("is_data").drop("is_data"), "INST": instances(triples, vocabulary)}
