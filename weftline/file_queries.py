"""Round trips of the driver's tables through the files that are read and written: what comes back is compared in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import views as W
from weftline.ontology_queries import ontology
from weftline.operators import alignment as A
from weftline.operators import consult as C
from weftline.operators import scoring as S
from weftline.queries import MEASURED, _prf_sql, query
from weftline.shared import fresh
from weftline.sources import alignments as L
from weftline.sources import artifacts as O


def _text(df: DataFrame, name: str, *parts, suffix: str = "", head: str | None = None) -> str:
    """The rows as lines of a folder of text files; a head line is a file before them."""
    path = fresh(df.sparkSession, name) + suffix
    if head is not None:
        df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(path)
    df.select(F.concat(*[F.col(p) if p in df.columns else F.lit(p) for p in parts]).alias("value")).write.mode("append").text(path)
    return path


def _system(spark: SparkSession, d: str) -> DataFrame:
    return W.system(spark, d).select("source", "target", "relation", F.format_string("%.2f", "confidence").alias("confidence"), "type", "_pos")


_CELLS = "SELECT source, target, relation, count(*) AS n FROM sys GROUP BY 1, 2, 3"
_FIRST = "SELECT count(*) AS pairs FROM s"


@query("file_pairs", "SELECT source, target FROM s", "cells")
def _(spark, d):
    return L.read_pairs(spark, _text(_system(spark, d), "pairs", "source", "\t", "target", "\t", "relation"))


@query("file_cells_tabs", _CELLS, "cells")
def _(spark, d):
    path = _text(_system(spark, d), "cells", "source", "\t", "target", "\t", "relation", suffix=".tsv")
    return L.read_cells(spark, path).groupBy("source", "target", "relation").agg(F.count("*").alias("n"))


@query("file_cells_pipes", _CELLS, "cells")
def _(spark, d):
    path = _text(_system(spark, d), "cells", "source", "|", "target", "|", "relation", "|", "confidence", "|", "type", suffix=".txt")
    return L.read_cells(spark, path).groupBy("source", "target", "relation").agg(F.count("*").alias("n"))


@query("file_alignment", "SELECT source, target, relation, type, round(confidence, 2) AS confidence, count(*) AS n FROM sys GROUP BY 1, 2, 3, 4, 5", "cells")
def _(spark, d):
    path = _text(_system(spark, d), "alignment", "source", "|", "target", "|", "relation", "|", "confidence", "|", "type")
    return L.read_alignment(spark, path).groupBy("source", "target", "relation", "type", "confidence").agg(F.count("*").alias("n"))


@query("file_asked", _FIRST, "cells")
def _(spark, d):
    path = _text(_system(spark, d), "asked", "source", "|", "target", "|", "relation", "|", "confidence", "|", "type")
    return L.read_asked(spark, path).agg(F.count("*").alias("pairs"))


@query("file_iris", "SELECT DISTINCT target AS iri FROM cells", "cells")
def _(spark, d):
    return L.read_iris(spark, _text(W.cells(spark, d), "iris", " ", "target", "  ", head="# first"))


@query("file_split", "SELECT DISTINCT source, target, CASE WHEN _pos % 2 = 0 THEN 'test' ELSE 'train' END AS split FROM sys", "cells")
def _(spark, d):
    rows = W.system(spark, d).withColumn("split", F.when(F.col("_pos") % 2 == 0, "test").otherwise("train"))
    lines = rows.select(F.concat_ws("\t", "split", "target", "source").alias("value"), F.lit(1).alias("o")).unionByName(spark.createDataFrame([("split\tTgtEntity\tSrcEntity", 0)], "value string, o int"))
    path = fresh(spark, "split")
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)  # the head line makes it one file
    return L.read_split(spark, path)


@query("file_typed_pairs", "SELECT source, target, type, count(*) AS n FROM sys GROUP BY 1, 2, 3", "cells")
def _(spark, d):
    path = _text(_system(spark, d), "typed", "source", "|", "target", "|", "relation", "|", "confidence", "|", "type")
    return L.read_typed_pairs(spark, path, "|").groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query("file_external", _FIRST, "cells")
def _(spark, d):
    return L.read_external(spark, _text(_system(spark, d), "external", "source", "\t", "target", "\t", "confidence", suffix=".tsv")).agg(F.count("*").alias("pairs"))


@query("file_predictions", "SELECT state, count(*) AS n, count(*) FILTER (oracle_confidence = 0) AS unsure FROM (SELECT state, coalesce(oracle_confidence, 0) AS oracle_confidence FROM answers) GROUP BY 1", "answers")
def _(spark, d):
    path = fresh(spark, "predictions")
    rows = W.answers(spark, d)
    rows.select(F.col("source").alias("source_entity_uri"), F.col("target").alias("target_entity_uri"), F.col("type").alias("entityType"), F.col("state").alias("Oracle_prediction"), F.col("oracle_confidence").alias("Oracle_confidence")).write.option("header", True).csv(path)
    return L.read_predictions(spark, path).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("oracle_confidence") == 0).alias("unsure"))


@query("file_candidates", "SELECT source, target, CAST(l_quantity AS BIGINT) AS n, count(*) AS rows FROM cells GROUP BY 1, 2, 3", "cells")
def _(spark, d):
    path = fresh(spark, "candidates")
    W.cells(spark, d).select("source", "target", F.col("l_quantity").cast("double").alias("n"), (F.col("_pos") % 3 == 0).alias("gold")).write.csv(path)
    return L.read_candidates(spark, path).groupBy("source", "target", "n").agg(F.count("*").alias("rows"))


@query("file_gold", "SELECT DISTINCT source, target FROM cells WHERE _pos % 3 = 0", "cells")
def _(spark, d):
    path = fresh(spark, "candidates")
    W.cells(spark, d).select("source", "target", F.lit(1).alias("n"), F.when(F.col("_pos") % 3 == 0, " Yes").otherwise("0").alias("gold")).write.csv(path)
    return L.gold_of(L.read_candidates(spark, path))


def _rdf(df: DataFrame, name: str) -> str:
    """Alignment RDF, a gzip document for each partition, written cell by cell."""
    path = fresh(df.sparkSession, name)
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = F.concat(F.lit('<map><Cell><entity1 rdf:resource="'), escaped("source"), F.lit('"/><entity2 rdf:resource="'), escaped("target"), F.lit('"/><relation>'), escaped("relation"), F.lit("</relation><measure>"), F.col("confidence"), F.lit("</measure></Cell></map>"))
    head = '<?xml version="1.0"?><rdf:RDF xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Alignment>'

    def document(batches):
        import pyarrow as pa

        lines = lambda x: pa.RecordBatch.from_arrays([x.cast(pa.string())], ["value"])
        yield lines(pa.array([head]))
        for batch in batches:
            yield lines(batch.column(0))
        yield lines(pa.array(["</Alignment></rdf:RDF>"]))

    df.select(cell.alias("value")).mapInArrow(document, "value string").write.option("compression", "gzip").text(path)  # repeats itself: 3.5 GB of documents for 0.65 GB of line items
    return path


@query("file_rdf", "SELECT source, target, relation, count(*) AS n FROM sys GROUP BY 1, 2, 3", "cells")
def _(spark, d):
    return L.read_rdf(spark, _rdf(_system(spark, d), "rdf")).groupBy("source", "target", "relation").agg(F.count("*").alias("n"))


@query("file_wellformed_rdf", "SELECT source, target, relation, count(*) AS n FROM sys GROUP BY 1, 2, 3", "cells")
def _(spark, d):
    return L.read_wellformed_rdf(spark, _rdf(_system(spark, d), "rdf")).groupBy("source", "target", "relation").agg(F.count("*").alias("n"))


@query("file_scored", "SELECT count(*) AS n, round(sum(confidence), 2) AS total FROM sys", "cells")
def _(spark, d):
    path = _text(_system(spark, d), "scored", "source", "\t", "target", "\t", "relation", "\t", "confidence")
    return L.scored(spark, path).agg(F.count("*").alias("n"), F.round(F.sum(F.col("Score").cast("double")), 2).alias("total"))


@query("file_local_verdicts", "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'true' WHEN 'MACHINERY' THEN 'false' ELSE 'other' END AS verdict, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    path = fresh(spark, "verdicts")
    said = F.when(F.col("c_mktsegment") == "BUILDING", " True").when(F.col("c_mktsegment") == "MACHINERY", "false").otherwise("maybe")
    W.table(spark, d, "customer").select(F.col("c_custkey").cast("string"), "c_name", said.alias("said")).write.option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = L.local_verdicts(spark, path)
    return rows.groupBy(F.when(F.col("verdict").isin("true", "false"), F.col("verdict")).otherwise("other").alias("verdict")).agg(F.sum("n").alias("n"))


@query("file_prompts", "SELECT 's' || n_nationkey AS source, 't' || n_regionkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'forward' ELSE 'reverse' END AS direction, 'Is \"' || n_name || '\" it?' AS prompt FROM nation")
def _(spark, d):
    path = fresh(spark, "prompts")
    key = F.concat(F.lit("s"), F.col("n_nationkey").cast("string"), F.lit("|t"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("|REVERSE"))
    rows = W.table(spark, d, "nation").select(F.struct(key.alias("key"), F.concat(F.lit('Is "'), F.col("n_name"), F.lit('" it?')).alias("value")).alias("e"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).coalesce(1).write.text(path)
    return L.read_prompts(spark, path).select("source", "target", "direction", "prompt")


@query("file_examples", "SELECT 'k' || n_nationkey AS key, n_name AS user, 'Yes' AS assistant FROM nation")
def _(spark, d):
    path = fresh(spark, "examples")
    rows = W.table(spark, d, "nation").select(F.struct(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.array(F.array(F.col("n_name"), F.lit("Yes"))).alias("value")).alias("e"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).coalesce(1).write.text(path)
    return L.read_examples(spark, path).select("key", F.explode("examples").alias("x")).select("key", "x.user", "x.assistant")


@query("file_triples", "SELECT p_name AS label, CASE WHEN p_partkey > 1 THEN 'http://o#p' || (p_partkey // 2) END AS parent FROM part")
def _(spark, d):
    path = fresh(spark, "triples")
    t = ontology(spark, d).where("s LIKE '%#p%'")
    term = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tag = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("")
    t.select(F.concat(term("s"), F.lit(" "), term("p"), F.lit(" "), F.when(F.col("o_is_literal"), F.concat(quoted, tag)).otherwise(term("o")), F.lit(" .")).alias("value")).write.text(path)
    rows = L.read_triples(spark, path)
    return rows.where("o_is_literal").select("s", F.col("o").alias("label")).join(rows.where("p LIKE '%subClassOf' AND o LIKE '%#p%'").select("s", F.col("o").alias("parent")), "s", "left").select("label", "parent")


@query("file_annotated", "SELECT relation, type, annotation, count(*) AS n FROM (SELECT DISTINCT ON (source, target) source, target, 'x' AS relation, 'y' AS type, 'z' AS annotation FROM sys) GROUP BY 1, 2, 3", "cells")
def _(spark, d):
    path = fresh(spark, "annotated")
    rows = A.first_of_pair(_system(spark, d)).select("source", "target", F.lit("x").alias("relation"), "confidence", F.lit("y").alias("type"), F.lit("z").alias("annotation"), F.lit("0.5").alias("annotation_confidence"), "_pos")
    O.write_annotated(rows, path)
    found = spark.read.text(f"{path}/annotated.txt").select(F.split("value", r"\|").alias("f")).where(F.size("f") == 6)
    return found.groupBy(F.col("f")[2].alias("relation"), F.col("f")[4].alias("type"), F.col("f")[5].alias("annotation")).agg(F.count("*").alias("n"))


@query("file_written_lines", "SELECT source, target, count(*) AS n FROM sys GROUP BY 1, 2", "cells")
def _(spark, d):
    path = fresh(spark, "lines")
    O.write_lines(_system(spark, d), path, "\t", "source", "target", "relation")
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).groupBy(F.col("f")[0].alias("source"), F.col("f")[1].alias("target")).agg(F.count("*").alias("n"))


@query("file_vectors", "SELECT count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS components FROM embeddings")
def _(spark, d):
    folder = fresh(spark, "vectors")
    rows = W.vectors(spark, d).select(F.col("vec_id").alias("id"), "vector")
    O.write_vectors(rows, folder, "k")
    back = O.read_vectors(spark, folder, "k", rows.select("id"))
    return back.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("components"))


@query("verdicts_recorded", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'true' WHEN event_type IN ('click', 'view') THEN 'false' ELSE 'error' END AS state FROM events) GROUP BY 1")
def _(spark, d):
    raw = F.when(F.col("event_type") == "purchase", '{"answer": true}').when(F.col("event_type") == "signup", "Yes, they are.").when(F.col("event_type") == "click", '{"answer": "n\\u006f"}').when(F.col("event_type") == "view", "false").otherwise("perhaps")
    rows = W.table(spark, d, "events").select(F.col("event_id").cast("string").alias("source"), F.lit("t").alias("target"), F.lit("forward").alias("direction"), raw.alias("raw"))
    return C.summary(C.recorded(rows.select("source", "target", "direction", F.lit("?").alias("prompt")), rows))


_S4 = """ig AS (SELECT 'http://a#/' || ['class', 'property', 'resource'][p_partkey % 3 + 1] || '/' || p_partkey AS iri FROM part WHERE p_size = 1),
s4 AS (SELECT DISTINCT source, target FROM sys WHERE relation <> '?' AND source NOT IN (SELECT iri FROM ig) AND target NOT IN (SELECT iri FROM ig)), rp AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 4 <> 0),
fl AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 4 <> 0 AND relation = '?'), te AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 10 >= 4), ma AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 10 < 4)"""


@query("edition_views_2026", f"""WITH {_S4}, k AS (SELECT 'standard' AS view, * FROM ({_prf_sql('s4', 'r')}) UNION ALL SELECT 'repaired', * FROM ({_prf_sql('(SELECT * FROM s4 EXCEPT SELECT * FROM fl)', '(SELECT * FROM rp EXCEPT SELECT * FROM fl)')})
UNION ALL SELECT 'codabench_standard', * FROM ({_prf_sql('(SELECT * FROM s4 EXCEPT SELECT * FROM ma)', '(SELECT * FROM r INTERSECT SELECT * FROM te)')})
UNION ALL SELECT 'codabench_repaired', * FROM ({_prf_sql('((SELECT * FROM s4 EXCEPT SELECT * FROM ma) EXCEPT SELECT * FROM fl)', '((SELECT * FROM rp INTERSECT SELECT * FROM te) EXCEPT SELECT * FROM fl)')})) SELECT view, {MEASURED[7:]} FROM k""", "cells")
def _(spark, d):
    ref = W.reference(spark, d)
    split = ref.select(*A.PAIR, F.when(F.col("_pos") % 10 >= 4, "test").otherwise("train").alias("split"))
    ignored = W.table(spark, d, "part").where("p_size = 1").select(W._part(F.col("p_partkey")).alias("iri"))
    return S.edition_views(W.system(spark, d), ref, 2026, ignored=ignored, repaired=ref.where("_pos % 4 <> 0"), split=split)
