"""Queries over the driver's tables read as an ontology: regions, nations and parts are classes, suppliers properties, customers individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import views as W
from weftline.functions import relations as R
from weftline.operators import entities as N
from weftline.operators import fewshot as H
from weftline.operators import graph as G
from weftline.operators import retrieval as E
from weftline.operators import alignment as A
from weftline.queries import query

# fixed values
ALT, COMMENT, XSD = "http://www.w3.org/2004/02/skos/core#altLabel", "http://www.w3.org/2000/01/rdf-schema#comment", "http://www.w3.org/2001/XMLSchema#string"


def _uri(head: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"http://o#{head}"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def ontology(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o, o_is_literal, lang, datatype). A part is below the part of half its number, so the tree is some log2(n) levels deep."""
    none = F.lit(None).cast("string")

    def rows(name: str, s: Column, p: str, o: Column, literal: bool = False, lang: str | None = None, where: str = "true") -> DataFrame:
        return W.table(spark, d, name).where(where).select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(literal).alias("o_is_literal"), F.lit(lang).cast("string").alias("lang"), (F.lit(XSD) if literal and lang is None else none).alias("datatype"))

    r, n, p, s, c = _uri("r", "r_regionkey"), _uri("n", "n_nationkey"), _uri("p", "p_partkey"), _uri("s", "s_suppkey"), _uri("c", "c_custkey")
    cls, blank = F.lit(f"{G.OWL}Class"), F.concat(F.lit("_:b"), F.col("n_nationkey").cast("string"))
    parts = [
        rows("region", r, G.TYPE, cls), rows("region", r, G.LABEL, F.col("r_name"), True, "en"),
        rows("nation", n, G.TYPE, cls), rows("nation", n, G.LABEL, F.col("n_name"), True), rows("nation", n, ALT, F.left("n_name", F.lit(3)), True, "en"), rows("nation", n, ALT, F.reverse("n_name"), True, "de"), rows("nation", n, G.SUBCLASS, _uri("r", "n_regionkey")),
        rows("nation", n, G.SUBCLASS, blank), rows("nation", blank, G.TYPE, F.lit(G.RESTRICTION)), rows("nation", blank, f"{G.OWL}onProperty", _uri("s", F.col("n_nationkey") + 1)), rows("nation", blank, f"{G.OWL}someValuesFrom", _uri("r", "n_regionkey"), where="n_nationkey % 2 = 0"),
        rows("nation", blank, f"{G.OWL}minQualifiedCardinality", F.col("n_nationkey"), True, where="n_nationkey % 2 = 1"), rows("nation", blank, f"{G.OWL}onClass", _uri("r", "n_regionkey"), where="n_nationkey % 2 = 1"),
        rows("part", p, G.TYPE, cls), rows("part", p, G.LABEL, F.col("p_name"), True), rows("part", p, G.SUBCLASS, _uri("p", F.floor(F.col("p_partkey") / 2)), where="p_partkey > 1"), rows("part", p, G.SUBCLASS, F.lit(G.THING), where="p_partkey = 1"),
        rows("supplier", s, G.TYPE, F.lit(f"{G.OWL}ObjectProperty"), where="s_suppkey % 2 = 1"), rows("supplier", s, G.TYPE, F.lit(f"{G.OWL}DatatypeProperty"), where="s_suppkey % 2 = 0"), rows("supplier", s, G.TYPE, F.lit(f"{G.OWL}FunctionalProperty"), where="s_suppkey % 3 = 0"),
        rows("supplier", s, G.LABEL, F.col("s_name"), True), rows("supplier", s, G.DOMAIN, _uri("n", "s_nationkey")), rows("supplier", s, G.RANGE, _uri("r", F.col("s_nationkey") % 5), where="s_suppkey % 4 <> 0"), rows("supplier", s, G.INVERSE, _uri("s", F.col("s_suppkey") + 1), where="s_suppkey % 5 = 0"),
        rows("customer", c, G.TYPE, F.lit(f"{G.OWL}NamedIndividual")), rows("customer", c, G.TYPE, _uri("n", "c_nationkey")), rows("customer", c, "http://o#segment", F.col("c_mktsegment"), True), rows("customer", c, "http://o#lives", _uri("n", "c_nationkey")),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


W.CTE["onto"] = f"""n_ AS (SELECT *, 'http://o#n' || n_nationkey AS n, '_:b' || n_nationkey AS b FROM nation), p_ AS (SELECT *, 'http://o#p' || p_partkey AS u FROM part), s_ AS (SELECT *, 'http://o#s' || s_suppkey AS u FROM supplier),
c_ AS (SELECT *, 'http://o#c' || c_custkey AS u FROM customer),
class_ AS (SELECT 'http://o#r' || r_regionkey AS uri, r_name AS label FROM region UNION ALL SELECT n, n_name FROM n_ UNION ALL SELECT u, p_name FROM p_),
edge_ AS (SELECT n AS child, 'http://o#r' || n_regionkey AS parent FROM n_ UNION ALL SELECT u, 'http://o#p' || (p_partkey // 2) FROM p_ WHERE p_partkey > 1)"""

_CLOSURE = "WITH RECURSIVE up AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM edge_ UNION ALL SELECT up.node, e.parent, distance + 1 FROM up JOIN edge_ e ON e.child = up.ancestor)"


def _recursive(sql: str) -> str:
    """The views before a recursive one."""
    return f"WITH RECURSIVE {W.CTE['onto']}, {_CLOSURE[15:]} {sql}"


def _text(column: str, separator: str = "|") -> Column:
    return F.array_join(column, separator)


@query("onto_classes", "SELECT uri FROM class_", "onto")
def _(spark, d):
    return G.classes(ontology(spark, d))


@query("onto_properties", "SELECT u AS uri, s_suppkey % 2 = 0 AS is_data FROM s_", "onto")
def _(spark, d):
    t = ontology(spark, d)
    return G.object_properties(t).withColumn("is_data", F.lit(False)).unionByName(G.data_properties(t).withColumn("is_data", F.lit(True)))


@query("onto_individuals", "SELECT u AS uri FROM c_", "onto")
def _(spark, d):
    return G.individuals(ontology(spark, d))


@query("onto_resolved", "SELECT uri, 'CLS' AS lane FROM class_ UNION ALL SELECT u, CASE WHEN s_suppkey % 2 = 0 THEN 'DPROP' ELSE 'OPROP' END FROM s_ UNION ALL SELECT u, 'INST' FROM c_ UNION ALL SELECT 'http://nowhere#' || r_regionkey, NULL FROM region", "onto")
def _(spark, d):
    t = ontology(spark, d)
    return G.resolved(t, t.where("NOT startswith(s, '_:')").select(F.col("s").alias("uri")).unionByName(W.table(spark, d, "region").select(F.concat(F.lit("http://nowhere#"), F.col("r_regionkey").cast("string")).alias("uri"))))


@query("onto_by_name", "SELECT name, uri FROM (SELECT 'N' || n_nationkey AS name, n AS uri FROM n_ UNION ALL SELECT 'S' || s_suppkey, u FROM s_)", "onto")
def _(spark, d):
    names = W.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name")).unionByName(W.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name")))
    return G.by_name(ontology(spark, d), names)


@query("onto_named_containing", "SELECT n AS uri FROM n_", "onto")
def _(spark, d):
    return G.named_containing(ontology(spark, d), "N")


@query("onto_labels", "SELECT uri, label AS labels FROM class_ UNION ALL SELECT u, s_name FROM s_ UNION ALL SELECT u, 'c' || c_custkey FROM c_", "onto")
def _(spark, d):
    t = ontology(spark, d)
    return G.labels(t, t.where("NOT startswith(s, '_:')").select(F.col("s").alias("uri"))).select("uri", _text("labels").alias("labels"))


@query("onto_annotations", "SELECT uri, label AS preferred, '' AS synonym, label AS lexical FROM class_ WHERE uri NOT LIKE '%#n%' UNION ALL SELECT u, s_name, '', s_name FROM s_ UNION ALL SELECT n, n_name, left(n_name, 3), concat_ws('|', least(n_name, left(n_name, 3)), CASE WHEN length(n_name) > 3 THEN greatest(n_name, left(n_name, 3)) END) FROM n_", "onto")
def _(spark, d):
    rows = G.annotations(ontology(spark, d), [G.LABEL], [ALT], [], ["en"])
    return rows.select("uri", *(_text(c).alias(c) for c in ("preferred", "synonym", "lexical")))


@query("onto_ancestors", _recursive("SELECT node, ancestor, CAST(min(distance) AS INT) AS distance FROM up GROUP BY 1, 2"))
def _(spark, d):
    return G.ancestors(G.edges(ontology(spark, d)))


@query("onto_descendants", _recursive("SELECT ancestor AS node, count(*) AS n, CAST(max(distance) AS INT) AS depth FROM up GROUP BY 1"))
def _(spark, d):
    return G.descendants(G.edges(ontology(spark, d))).groupBy("node").agg(F.count("*").alias("n"), F.max("distance").alias("depth"))


@query("onto_levels", _recursive("SELECT node, CAST(0 AS INT) AS level, node AS member FROM (SELECT 'http://o#p' || p_partkey AS node FROM part) UNION ALL SELECT node, distance, ancestor FROM up WHERE distance <= 3 AND node LIKE '%#p%'"))
def _(spark, d):
    return G.levels(G.edges(ontology(spark, d)), W.table(spark, d, "part").select(_uri("p", "p_partkey").alias("node")), 3)


@query("onto_children_by_levels", _recursive("SELECT n AS node, CAST(0 AS INT) AS level, n AS member FROM (SELECT 'http://o#p1' AS n UNION ALL SELECT 'http://o#p3') UNION ALL SELECT ancestor, distance, node FROM up WHERE ancestor IN ('http://o#p1', 'http://o#p3') AND distance <= 2"))
def _(spark, d):
    nodes = W.table(spark, d, "part").where("p_partkey IN (1, 3)").select(_uri("p", "p_partkey").alias("node"))
    return G.children_by_levels(G.edges(ontology(spark, d)), nodes, 2)


@query("onto_is_subclass", _recursive("SELECT 'http://o#p' || p_partkey AS sub, 'http://o#p' || k AS sup, p_partkey = k OR ('http://o#p' || p_partkey, 'http://o#p' || k) IN (SELECT (node, ancestor) FROM up) AS holds FROM part, (SELECT 2 AS k UNION ALL SELECT 5)"))
def _(spark, d):
    pairs = W.table(spark, d, "part").select(_uri("p", "p_partkey").alias("sub"), F.explode(F.array(_uri("p", F.lit(2)), _uri("p", F.lit(5)))).alias("sup"))
    return G.is_subclass(pairs, G.edges(ontology(spark, d)))


@query("onto_ancestor_names", _recursive("SELECT node, string_agg(DISTINCT label, '|' ORDER BY label) AS names FROM up JOIN class_ ON uri = ancestor GROUP BY 1"))
def _(spark, d):
    return G.ancestor_names(ontology(spark, d)).select("node", _text("names").alias("names"))


@query("onto_descendant_names", _recursive("SELECT ancestor AS node, string_agg(DISTINCT label, '|' ORDER BY label) AS names FROM up JOIN class_ ON uri = node WHERE ancestor LIKE '%#r%' GROUP BY 1"))
def _(spark, d):
    return G.descendant_names(ontology(spark, d)).where("node LIKE '%#r%'").select("node", _text("names").alias("names"))


@query("onto_descendant_names_of", _recursive("SELECT 'R' || split_part(ancestor, '#r', 2) AS name, string_agg(DISTINCT label, '|' ORDER BY label) AS names FROM up JOIN class_ ON uri = node WHERE ancestor LIKE '%#r%' GROUP BY 1"))
def _(spark, d):
    names = W.table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("name"))
    return G.descendant_names_of(ontology(spark, d), names).select("name", _text("names").alias("names"))


@query("onto_direct_parents", "SELECT child, string_agg(parent, '|' ORDER BY parent) AS parents FROM edge_ GROUP BY 1", "onto")
def _(spark, d):
    return G.direct_parents(G.edges(ontology(spark, d))).select("child", _text("parents").alias("parents"))


@query("onto_direct_children", "SELECT parent, string_agg(child, '|' ORDER BY child) AS children FROM edge_ GROUP BY 1", "onto")
def _(spark, d):
    return G.direct_children(G.edges(ontology(spark, d))).select("parent", _text("children").alias("children"))


@query("onto_property_view", """SELECT u AS uri, s_suppkey % 2 = 0 AS is_data, 'n' || s_nationkey AS domain, CASE WHEN s_suppkey % 4 <> 0 THEN 'r' || (s_nationkey % 5) ELSE '' END AS range, CASE WHEN s_suppkey % 5 = 0 THEN 's' || (s_suppkey + 1) END AS inverse,
  CASE WHEN s_suppkey % 3 = 0 THEN 'functional' ELSE '' END AS characteristics FROM s_""", "onto")
def _(spark, d):
    return G.property_view(ontology(spark, d)).select("uri", "is_data", _text("domain").alias("domain"), _text("range").alias("range"), "inverse", _text("characteristics").alias("characteristics"))


@query("onto_property_ends", "SELECT u AS uri, 'http://o#n' || s_nationkey AS domain, CASE WHEN s_suppkey % 4 <> 0 THEN 'http://o#r' || (s_nationkey % 5) END AS range FROM s_", "onto")
def _(spark, d):
    t = ontology(spark, d)
    return G.domain_uris(t).select("uri", _text("ends").alias("domain")).join(G.range_uris(t).select("uri", _text("ends").alias("range")), "uri", "left")


@query("onto_property_siblings", """WITH q AS (SELECT u, s_nationkey AS k, s_suppkey % 2 AS kind, CASE WHEN s_suppkey % 2 = 1 THEN 'any' WHEN s_suppkey % 4 = 0 THEN '' ELSE 'r' END AS g, 's' || s_suppkey AS name FROM s_)
SELECT uri, CAST(rank AS INT) AS rank, sibling FROM (SELECT a.u AS uri, b.u AS sibling, row_number() OVER (PARTITION BY a.u ORDER BY b.name, b.u) AS rank FROM q a JOIN q b USING (k, kind, g) WHERE a.u <> b.u) WHERE rank <= 2""", "onto")
def _(spark, d):
    return G.property_siblings(G.property_view(ontology(spark, d)), 2)


@query("onto_signature", """SELECT uri, coalesce(string_agg(s_name, '|' ORDER BY s_name) FILTER (k = 'd'), '') AS as_domain, coalesce(string_agg(s_name, '|' ORDER BY s_name) FILTER (k = 'r'), '') AS as_range
FROM (SELECT 'http://o#n' || s_nationkey AS uri, 'd' AS k, s_name FROM s_ UNION ALL SELECT 'http://o#r' || (s_nationkey % 5), 'r', s_name FROM s_ WHERE s_suppkey % 4 <> 0) GROUP BY 1""", "onto")
def _(spark, d):
    return G.relational_signature(ontology(spark, d)).select("uri", _text("as_domain").alias("as_domain"), _text("as_range").alias("as_range"))


_RULES = "SELECT n AS uri, CASE WHEN n_nationkey % 2 = 0 THEN 'some' ELSE 'min' END AS restriction_type, 's' || (n_nationkey + 1) AS property_name, 'r' || n_regionkey AS filler_name, CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_nationkey AS INT) ELSE -1 END AS cardinality FROM n_"


@query("onto_restrictions", _RULES, "onto")
def _(spark, d):
    return G.restrictions(ontology(spark, d)).fillna(-1, ["cardinality"])


@query("onto_first_restrictions", f"SELECT *, CAST(1 AS INT) AS rank FROM ({_RULES})", "onto")
def _(spark, d):
    return G.first_restrictions(G.restrictions(ontology(spark, d)), 1).fillna(-1, ["cardinality"])


@query("onto_type_siblings", """SELECT uri, CAST(rank AS INT) AS rank, sibling, label FROM (SELECT a.u AS uri, b.u AS sibling, 'c' || b.c_custkey AS label, row_number() OVER (PARTITION BY a.u ORDER BY 'c' || b.c_custkey, b.u) AS rank
  FROM c_ a JOIN c_ b ON a.c_nationkey = b.c_nationkey AND a.u <> b.u) WHERE rank <= 3""", "onto")
def _(spark, d):
    t = ontology(spark, d)
    return G.type_siblings(G.type_index(t.where("startswith(s, 'http://o#c')")), 3)


@query("onto_used_as_type", "SELECT n AS uri, n_nationkey IN (SELECT c_nationkey FROM customer) AS used FROM n_ UNION ALL SELECT 'http://o#r' || r_regionkey, false FROM region", "onto")
def _(spark, d):
    uris = W.table(spark, d, "nation").select(_uri("n", "n_nationkey").alias("uri")).unionByName(W.table(spark, d, "region").select(_uri("r", "r_regionkey").alias("uri")))
    return G.used_as_type(ontology(spark, d), uris)


@query("onto_pattern", "SELECT 'http://o#c' || c_custkey AS who, n AS land, 'http://o#r' || n_regionkey AS region FROM customer JOIN n_ ON c_nationkey = n_nationkey", "onto")
def _(spark, d):
    return G.select(ontology(spark, d).where("NOT startswith(o, '_:')"), ("?who", "http://o#lives", "?land"), ("?land", G.SUBCLASS, "?region")).select("who", "land", "region")


@query("onto_literals", "SELECT 'http://o#segment' AS p, c_mktsegment AS text, count(*) AS n FROM customer GROUP BY 2")
def _(spark, d):
    return G.literals(ontology(spark, d)).where("p = 'http://o#segment'").groupBy("p", "text").agg(F.count("*").alias("n"))


@query("onto_relatives_names", "SELECT parent AS node, string_agg(label, '|' ORDER BY child) AS names FROM edge_ JOIN class_ ON uri = child GROUP BY 1", "onto")
def _(spark, d):
    t = ontology(spark, d)
    rows = G.relatives_names(G.edges(t).select(F.col("parent").alias("node"), F.col("child").alias("relative")), t)
    return rows.select("node", F.array_join(F.flatten("names"), "|").alias("names"))


@query("onto_level_synonyms", "SELECT n AS node, left(n_name, 3) AS own, r_name AS above FROM n_ JOIN region ON r_regionkey = n_regionkey", "onto")
def _(spark, d):
    t = ontology(spark, d)
    said = t.where(f"p = '{ALT}' AND lang = 'en'").select(F.col("s").alias("uri"), F.array("o").alias("synonym")).unionByName(t.where(f"p = '{G.LABEL}' AND s LIKE '%#r%'").select(F.col("s").alias("uri"), F.array("o").alias("synonym")))
    rows = G.level_synonyms(t, said, W.table(spark, d, "nation").select(_uri("n", "n_nationkey").alias("node")), 1)
    return rows.select("node", _text("own").alias("own"), F.array_join(F.flatten("above"), "|").alias("above"))


@query("onto_merged_entropy", """WITH c AS (SELECT 1 AS side, c_mktsegment AS o, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 2, c_mktsegment, count(*) FROM customer WHERE c_nationkey < 10 GROUP BY 2),
e AS (SELECT side, -sum(n / t * log2(n / t)) AS h FROM (SELECT side, n, sum(n) OVER (PARTITION BY side) AS t FROM c) GROUP BY side) SELECT 'http://o#segment' AS predicate, round(max(h), 9) AS entropy FROM e""")
def _(spark, d):
    t = ontology(spark, d)
    some = t.join(W.table(spark, d, "customer").where("c_nationkey < 10").select(_uri("c", "c_custkey").alias("s")), "s", "left_semi")
    return G.merged_entropy(G.predicate_entropy(t, "segment"), G.predicate_entropy(some, "segment")).select("predicate", F.round("entropy", 9).alias("entropy"))


@query("onto_siblings_by_vector", """WITH v AS (SELECT vec_id AS k, label AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT k, g, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
s AS (SELECT a.k AS node, b.k AS sibling, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 9) AS score FROM u a JOIN u b ON a.g = b.g AND a.k <> b.k WHERE a.k % 100 = 0)
SELECT CAST(node AS VARCHAR) AS node, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC) AS rank FROM s) WHERE rank <= 2""")
def _(spark, d):
    v = W.vectors(spark, d).select(F.col("vec_id").cast("string").alias("uri"), E.unit(F.col("vector")).alias("vector"), F.col("label").alias("g"))
    few = v.where(F.col("uri").cast("long") % 100 == 0).select(F.col("uri").alias("node"), "g")  # the stated query set
    candidates = few.join(v.select(F.col("uri").alias("sibling"), "g"), "g").where("node <> sibling").withColumn("label", F.col("sibling"))
    return G.siblings_by_vector(candidates, v, 2).select("node", "rank", F.round("score", 9).alias("score"))


@query("onto_class_entities", """SELECT n AS uri, n_name AS names, concat_ws('|', least(n_name, left(n_name, 3)), CASE WHEN length(n_name) > 3 THEN greatest(n_name, left(n_name, 3)) END) AS synonyms, 'n' || n_nationkey AS own_name, r_name AS parent, n_name || '|' || r_name AS levels,
  CASE WHEN n_nationkey % 2 = 0 THEN 'some' ELSE 'min' END AS rule FROM n_ JOIN region ON r_regionkey = n_regionkey""", "onto")
def _(spark, d):
    rows = N.classes(ontology(spark, d), synonyms=[ALT]).where("uri LIKE '%#n%'").select("uri", "e.*")
    return rows.select("uri", _text("names").alias("names"), F.array_join(F.array_sort(F.array_distinct("synonyms")), "|").alias("synonyms"), "own_name", "parent", _text("levels").alias("levels"), F.col("restrictions")[0]["restriction_type"].alias("rule"))


@query("onto_property_entities", "SELECT u AS uri, s_name AS names, 'n' || s_nationkey AS domain, n_name AS domain_synonyms, s_suppkey % 2 = 0 AS is_data FROM s_ JOIN n_ ON n_nationkey = s_nationkey", "onto")
def _(spark, d):
    rows = N.properties(ontology(spark, d)).select("uri", "e.*")
    return rows.select("uri", _text("names").alias("names"), _text("domain").alias("domain"), _text("domain_synonyms").alias("domain_synonyms"), "is_data")


@query("onto_instance_entities", "SELECT u AS uri, 'c' || c_custkey AS names, 'NamedIndividual|n' || c_nationkey AS types, c_mktsegment AS segment, n_name AS lives FROM c_ JOIN n_ ON n_nationkey = c_nationkey", "onto")
def _(spark, d):
    rows = N.instances(ontology(spark, d)).where("uri LIKE '%#c%'")
    return rows.select("uri", _text("e.names").alias("names"), _text("e.types").alias("types"), F.col("e.data")[0]["value"].alias("segment"), F.col("e.object")[0]["object_label"].alias("lives"))


# ---- static examples and sealed predictions

@query("static_positives", "SELECT least(50, count(*)) AS n, true AS fits FROM (SELECT DISTINCT source, target FROM ref WHERE _pos % 10 = 1 AND (least(source, target), greatest(source, target)) NOT IN (SELECT (least(source, target), greatest(source, target)) FROM ref WHERE _pos % 10 = 2))", "cells")
def _(spark, d):
    ref = W.reference(spark, d)
    train, asked = ref.where("_pos % 10 = 1"), ref.where("_pos % 10 = 2")
    drawn = H.positives(train, asked, 50)
    return drawn.join(train.select(*A.PAIR).distinct().withColumn("known", F.lit(True)), A.PAIR, "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("fits"))


@query("static_examples", "SELECT CAST(i AS INT) AS place, i % 2 = 1 AS label, 0 AS wrong FROM range(1, 9) t(i)")
def _(spark, d):
    ref = W.reference(spark, d)
    train, asked = ref.where("_pos % 10 = 1"), ref.where("_pos % 10 = 2")
    rows = H.build(train, asked, 8, seed=5)
    pairs = train.unionByName(asked).select(R.pair_key(F.col("source"), F.col("target")).alias("k")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(pairs, R.pair_key(F.col("source"), F.col("target")) == F.col("k"), "left")
    return rows.select("place", "label", F.when(F.col("label") == F.coalesce("known", F.lit(False)), 0).otherwise(1).alias("wrong"))


@query("sealed_predictions", """WITH a AS (SELECT source, target, count(*) AS n, min(CASE type WHEN 'CLS' THEN 'class' WHEN 'INST' THEN 'instance' ELSE 'property' END) AS l FROM sys GROUP BY 1, 2), p AS (SELECT source, target, count(*) AS m, min(CASE type WHEN 'CLS' THEN 'class' WHEN 'INST' THEN 'instance' ELSE 'property' END) AS k FROM ref GROUP BY 1, 2)
SELECT CASE WHEN n IS NULL THEN 'not asked' WHEN m IS NULL THEN 'no prediction' WHEN n > 1 THEN 'asked twice' WHEN m > 1 THEN 'predicted twice' WHEN l <> k THEN 'other lane' ELSE 'none' END AS problem, count(*) AS pairs FROM a FULL JOIN p USING (source, target) GROUP BY 1""", "cells")
def _(spark, d):
    said = W.reference(spark, d).withColumn("verdict", F.lit(True))
    lane = lambda t: F.when(t == "CLS", "class").when(t == "INST", "instance").otherwise("property")
    return A.sealed_predictions(W.system(spark, d), said, lane).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("pairs"))


@query("asked_rows_filled", "WITH x AS (SELECT source, target, CASE WHEN l_quantity % 2 = 0 THEN relation ELSE '=' END AS relation, _pos, l_extendedprice FROM sys) SELECT count(*) AS n, count(*) FILTER (confidence = '1.0') AS m FROM (SELECT DISTINCT source, target, '1.0' AS confidence FROM x)", "cells")
def _(spark, d):
    rows = W.system(spark, d).select(F.when(F.col("l_quantity") % 2 == 0, F.array("source", "target", "relation")).otherwise(F.array("source", "target")).alias("f"), "_pos")
    return A.filled_rows(rows).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "1.0").alias("m"))
