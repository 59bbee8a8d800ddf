"""Queries over the driver's tables, each with the same query in SQL where SQL can say it. Every query reads whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import views as W
from weftline.functions import keys as K
from weftline.functions import measures as M
from weftline.functions import relations as R
from weftline.functions import templates as T
from weftline.functions import text as X
from weftline.functions import verdicts as V
from weftline.operators import alignment as A
from weftline.operators import consult as C
from weftline.operators import graph as G
from weftline.operators import retrieval as E
from weftline.operators import scoring as S
from weftline.plans import matrix as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query and its SQL, which may build on views of W.CTE."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            head = ", ".join(W.CTE[c] for c in ctes)
            rest = sql.strip()
            SQL[name] = f"WITH {head}, {rest[5:]}" if head and rest.startswith("WITH ") else f"WITH {head} {rest}" if head else rest
        return run

    return add


def _counts(df: DataFrame, *more: str) -> DataFrame:
    return df.select("tp", "fp", "fn", "precision", "recall", "f1", *more)


RATIOS = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1"""
#: Ratios of counts of a table k(tp, fp, fn, ...).
MEASURED = f"SELECT tp, fp, fn, {RATIOS}"


def _prf_sql(s: str, r: str) -> str:
    return f"SELECT count(*) FILTER (i AND j) AS tp, count(*) FILTER (i AND NOT coalesce(j, false)) AS fp, count(*) FILTER (j AND NOT coalesce(i, false)) AS fn FROM (SELECT DISTINCT source, target, true AS i FROM {s}) FULL JOIN (SELECT DISTINCT source, target, true AS j FROM {r}) USING (source, target)"


# ---- scores

@query("prf_plain", f"WITH k AS ({_prf_sql('s', 'r')}) {MEASURED}, tp + fp AS system_size, tp + fn AS reference_size FROM k", "cells")
def _(spark, d):
    return _counts(S.plain(W.system(spark, d), W.reference(spark, d)), "system_size", "reference_size")


@query("prf_partial", f"""WITH g AS (SELECT DISTINCT source, target FROM ref WHERE target LIKE '%3'),
k AS (SELECT count(*) FILTER (hit) AS tp, count(*) FILTER (sc AND NOT hit) AS fp, (SELECT count(*) FROM g) - count(*) FILTER (hit) AS fn, count(*) FILTER (NOT sc) AS ignored
  FROM (SELECT (source, target) IN (SELECT (source, target) FROM g) AS hit, source IN (SELECT source FROM g) OR target IN (SELECT target FROM g) AS sc FROM s))
{MEASURED}, ignored FROM k""", "cells")
def _(spark, d):
    return _counts(S.partial(W.system(spark, d), W.partial_reference(spark, d)), "ignored")


@query("prf_relation_aware", f"""WITH c AS (SELECT DISTINCT side, least(source, target) AS a, greatest(source, target) AS b, CASE WHEN source > target THEN translate(relation, '<>', '><') WHEN source = target THEN replace(relation, '>', '<') ELSE relation END AS r
  FROM (SELECT 's' AS side, source, target, relation FROM sys UNION ALL SELECT 'r', source, target, relation FROM ref)),
f AS (SELECT DISTINCT a, b FROM c WHERE side = 'r' AND r = '?'),
t AS (SELECT count(*) AS tp FROM (SELECT a, b, r FROM c WHERE side = 's' INTERSECT SELECT a, b, r FROM c WHERE side = 'r') x WHERE (a, b) NOT IN (SELECT (a, b) FROM f)),
n AS (SELECT count(*) FILTER (side = 's') AS ns, count(*) FILTER (side = 'r' AND (a, b) NOT IN (SELECT (a, b) FROM f)) AS nr FROM c),
x AS (SELECT count(*) AS discounted FROM f WHERE (a, b) IN (SELECT (a, b) FROM c WHERE side = 's')),
k AS (SELECT tp, ns - discounted - tp AS fp, nr - tp AS fn, discounted, ns AS system_cells FROM t, n, x)
{MEASURED}, discounted, system_cells, least(floor(tp * 1000.0::DOUBLE / (tp + fp) + 0.5) / 1000.0::DOUBLE, 1.0::DOUBLE) AS printed_precision FROM k""", "cells")
def _(spark, d):
    return _counts(S.relation_aware(W.system(spark, d), W.reference(spark, d)), "discounted", "system_cells", "printed_precision")


_FLAG = "fl AS (SELECT DISTINCT source, target FROM ref WHERE relation = '?'), s2 AS (SELECT DISTINCT source, target FROM sys WHERE relation <> '?')"


@query("prf_coherence_aware", f"""WITH {_FLAG}, k AS ({_prf_sql('(SELECT * FROM s2 EXCEPT SELECT * FROM fl)', '(SELECT * FROM r EXCEPT SELECT * FROM fl)')})
{MEASURED}, (SELECT count(*) FROM (SELECT * FROM s2 INTERSECT SELECT * FROM fl)) AS predicted_flagged FROM k""", "cells")
def _(spark, d):
    return _counts(S.coherence_aware(W.system(spark, d), W.reference(spark, d)), "predicted_flagged")


@query("prf_all_cells", f"WITH {_FLAG}, k AS ({_prf_sql('s2', 'r')}) {MEASURED} FROM k", "cells")
def _(spark, d):
    return _counts(S.all_cells(W.system(spark, d), W.reference(spark, d)))


_TRAIN = "tr AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 10 < 2)"


@query("prf_null_reference", f"""WITH {_TRAIN}, k AS ({_prf_sql('(SELECT * FROM s EXCEPT SELECT * FROM tr)', '(SELECT * FROM r EXCEPT SELECT * FROM tr)')})
{MEASURED}, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM tr)) AS system_removed, (SELECT count(*) FROM tr) AS reference_removed FROM k""", "cells")
def _(spark, d):
    ref = W.reference(spark, d)
    return _counts(S.null_reference(W.system(spark, d), ref, ref.where("_pos % 10 < 2").select(*A.PAIR).distinct()), "system_removed", "reference_removed")


@query("prf_masked_split", f"""WITH te AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 10 >= 4), ma AS (SELECT DISTINCT source, target FROM ref WHERE _pos % 10 < 4),
k AS ({_prf_sql('(SELECT * FROM s EXCEPT SELECT * FROM ma)', '(SELECT * FROM r INTERSECT SELECT * FROM te)')})
{MEASURED}, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM ma)) AS masked_removed FROM k""", "cells")
def _(spark, d):
    ref = W.reference(spark, d)
    return _counts(S.masked_split(W.system(spark, d), ref, ref.where("_pos % 10 >= 4"), ref.where("_pos % 10 < 4")), "masked_removed")


@query("edition_views", f"""WITH ig AS (SELECT 'http://a#/' || ['class', 'property', 'resource'][p_partkey % 3 + 1] || '/' || p_partkey AS iri FROM part WHERE p_size = 1),
s3 AS (SELECT * FROM s WHERE source NOT IN (SELECT iri FROM ig) AND target NOT IN (SELECT iri FROM ig)), {_TRAIN},
k AS (SELECT 'unsupervised' AS view, * FROM ({_prf_sql('s3', 'r')}) UNION ALL SELECT 'semi_supervised', * FROM ({_prf_sql('(SELECT * FROM s3 EXCEPT SELECT * FROM tr)', '(SELECT * FROM r EXCEPT SELECT * FROM tr)')}))
SELECT view, {MEASURED[7:]} FROM k""", "cells")
def _(spark, d):
    ref = W.reference(spark, d)
    ignored = W.table(spark, d, "part").where("p_size = 1").select(W._part(F.col("p_partkey")).alias("iri"))
    return S.edition_views(W.system(spark, d), ref, 2025, train=ref.where("_pos % 10 < 2").select(*A.PAIR).distinct(), ignored=ignored)


@query("strata_by_type", f"""WITH y AS (SELECT source, target, i, j, CASE WHEN source LIKE '%/class/%' OR (source NOT LIKE '%/property/%' AND source NOT LIKE '%/resource/%' AND target LIKE '%/class/%') THEN 'class'
  WHEN source LIKE '%/property/%' OR (source NOT LIKE '%/resource/%' AND target LIKE '%/property/%') THEN 'property' WHEN source LIKE '%/resource/%' OR target LIKE '%/resource/%' THEN 'instance' END AS stratum
  FROM (SELECT *, true AS i FROM s) FULL JOIN (SELECT *, true AS j FROM r) USING (source, target)),
k AS (SELECT stratum, count(*) FILTER (i AND j) AS tp, count(*) FILTER (i AND j IS NULL) AS fp, count(*) FILTER (j AND i IS NULL) AS fn FROM y WHERE stratum IS NOT NULL GROUP BY stratum)
SELECT stratum, {MEASURED[7:]} FROM k""", "cells")
def _(spark, d):
    return S.strata_by_type(W.system(spark, d), W.reference(spark, d))


_LANES = """ls AS (SELECT source, target, CASE WHEN min(l) = max(l) THEN min(l) ELSE 'unknown' END AS sl FROM (SELECT *, CASE type WHEN 'CLS' THEN 'class' WHEN 'INST' THEN 'instance' ELSE 'property' END AS l FROM sys) GROUP BY 1, 2),
lr AS (SELECT source, target, CASE WHEN min(l) = max(l) THEN min(l) ELSE 'unknown' END AS rl FROM (SELECT *, CASE type WHEN 'CLS' THEN 'class' WHEN 'INST' THEN 'instance' ELSE 'property' END AS l FROM ref) GROUP BY 1, 2)"""


@query("strata_by_lane", f"""WITH {_LANES}, k AS (SELECT coalesce(rl, sl) AS lane, count(*) FILTER (sl IS NOT NULL AND rl IS NOT NULL) AS tp, count(*) FILTER (rl IS NULL) AS fp, count(*) FILTER (sl IS NULL) AS fn, 0 AS ignored FROM ls FULL JOIN lr USING (source, target) GROUP BY 1)
SELECT lane, tp, fp, fn, CAST(ignored AS BIGINT) AS ignored, {RATIOS} FROM k""", "cells")
def _(spark, d):
    return S.strata(A.lanes_by_pair(W.system(spark, d)), A.lanes_by_pair(W.reference(spark, d)), ["class", "property", "instance", "unknown"])


@query("strata_reconciled", f"""WITH {_LANES}, a AS (SELECT count(*) FILTER (sl IS NOT NULL AND rl IS NOT NULL) AS tp FROM ls FULL JOIN lr USING (source, target)), b AS (SELECT count(*) AS tp FROM (SELECT * FROM s INTERSECT SELECT * FROM r))
SELECT 'tp' AS field, a.tp AS total, b.tp AS expected FROM a, b WHERE a.tp <> b.tp""", "cells")
def _(spark, d):
    lanes = S.strata(A.lanes_by_pair(W.system(spark, d)), A.lanes_by_pair(W.reference(spark, d)), ["class", "property", "instance", "unknown"])
    return S.reconcile(lanes, S.plain(W.system(spark, d), W.reference(spark, d)), ["tp", "fp", "fn"])


_TYPES = "ty AS (SELECT uri, arg_max(type, (_pos, type)) AS type FROM (SELECT source AS uri, type, _pos FROM cells UNION ALL SELECT target, type, _pos FROM cells) GROUP BY uri)"


@query("types_by_uri", f"WITH {_TYPES} SELECT uri, type FROM ty", "cells")
def _(spark, d):
    return A.types_by_uri(W.cells(spark, d))


@query("typed_strata", f"""WITH {_TYPES}, y AS (SELECT i, j, CASE WHEN a.type = 'CLS' AND b.type = 'CLS' THEN 'class' WHEN a.type IN ('OPROP', 'DPROP') AND b.type IN ('OPROP', 'DPROP') THEN 'property' END AS kind
  FROM (SELECT *, true AS i FROM s) FULL JOIN (SELECT *, true AS j FROM r) USING (source, target) LEFT JOIN ty a ON a.uri = source LEFT JOIN ty b ON b.uri = target),
k AS (SELECT kind, count(*) FILTER (i AND j) AS tp, count(*) FILTER (i AND j IS NULL) AS fp, count(*) FILTER (j AND i IS NULL) AS fn FROM y WHERE kind IS NOT NULL GROUP BY kind)
SELECT kind, {MEASURED[7:]} FROM k""", "cells")
def _(spark, d):
    return S.typed_strata(W.system(spark, d), W.reference(spark, d), A.types_by_uri(W.cells(spark, d)))


# ---- rows

@query("first_of_pair", "SELECT source, target, f.relation AS relation, f.confidence AS confidence, f.type AS type FROM (SELECT source, target, min({'a': _pos, 'relation': relation, 'confidence': confidence, 'type': type}) AS f FROM cells GROUP BY 1, 2)", "cells")
def _(spark, d):
    return A.first_of_pair(W.cells(spark, d).drop("l_quantity", "l_extendedprice")).drop("_pos")


@query("refined", """WITH asked AS (SELECT DISTINCT source, target FROM ref WHERE relation = '='), acc AS (SELECT * FROM ref WHERE relation = '=' AND l_quantity > 10)
SELECT source, target, relation, confidence, type, 0 AS part FROM sys WHERE (source, target) NOT IN (SELECT (source, target) FROM asked)
UNION ALL SELECT source, target, relation, 1.0::DOUBLE, type, 1 FROM acc""", "cells")
def _(spark, d):
    ref = W.reference(spark, d).where("relation = '='")
    return A.refined(W.system(spark, d), ref, ref.where("l_quantity > 10")).drop("_pos").withColumnRenamed("_part", "part")


@query("without_iris", """WITH ig AS (SELECT 'http://a#/' || ['class', 'property', 'resource'][p_partkey % 3 + 1] || '/' || p_partkey AS iri FROM part WHERE p_size = 1)
SELECT source, target, relation, _pos AS pos FROM cells WHERE source NOT IN (SELECT iri FROM ig) AND target NOT IN (SELECT iri FROM ig)""", "cells")
def _(spark, d):
    ignored = W.table(spark, d, "part").where("p_size = 1").select(W._part(F.col("p_partkey")).alias("iri"))
    return A.without_iris(W.cells(spark, d), ignored).select("source", "target", "relation", F.col("_pos").alias("pos"))


@query("unordered_keys", "SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM cells", "cells")
def _(spark, d):
    return A.unordered_keys(W.cells(spark, d)).select(F.get("key", F.lit(0)).alias("a"), F.get("key", F.size("key") - 1).alias("b"))


@query("both_orientations", "SELECT source, target FROM r UNION SELECT target, source FROM r", "cells")
def _(spark, d):
    return A.oriented_both_ways(W.reference(spark, d))


@query("candidates_by_support", """WITH c AS (SELECT source, target, count(*) AS n FROM cells GROUP BY 1, 2), t AS (SELECT max(n) AS m FROM c WHERE n >= 2)
SELECT source, target, '=' AS relation, least(n / m, 1.0)::DOUBLE AS confidence, 'CLS' AS type FROM c, t WHERE n >= 2""", "cells")
def _(spark, d):
    counts = W.cells(spark, d).groupBy("source", "target").agg(F.count("*").alias("n"))
    return A.candidates_from_counts(A.supported(counts, 2))


@query("sidecar_lanes", "SELECT source, target, CASE WHEN source LIKE '%/class/%' THEN 'class' WHEN source LIKE '%/property/%' THEN 'property' ELSE 'unknown' END AS lane FROM r", "cells")
def _(spark, d):
    ref = W.reference(spark, d)
    return A.sidecar_partition(ref, {"class": ref.where("source LIKE '%/class/%'"), "property": ref.where("source LIKE '%/property/%'")})


@query("prompt_coverage", """WITH w AS (SELECT source, target, arg_max(coalesce(type, 'CLS'), (event_id, type)) AS type FROM answers GROUP BY 1, 2), f AS (SELECT DISTINCT source, target FROM answers WHERE state <> 'error'), b AS (SELECT DISTINCT source, target FROM answers WHERE state = 'true')
SELECT source, target, 'no prompt' AS problem FROM w WHERE (source, target) NOT IN (SELECT (source, target) FROM f)
UNION ALL SELECT source, target, 'no reverse prompt' FROM w WHERE type = 'CLS' AND (source, target) NOT IN (SELECT (source, target) FROM b)""", "answers")
def _(spark, d):
    rows = W.answers(spark, d).withColumn("_pos", F.col("event_id"))
    prompts = rows.where("state <> 'error'").select(*A.PAIR, F.lit("forward").alias("direction")).unionByName(rows.where("state = 'true'").select(*A.PAIR, F.lit("reverse").alias("direction")))
    return A.prompt_coverage(prompts, rows, reverse=True)


# ---- the oracle

_J = """j AS (SELECT a.*, (a.source, a.target) IN (SELECT (source, target) FROM r) AS hit, a.source IN (SELECT source FROM r) OR a.target IN (SELECT target FROM r) AS sc FROM answers a)"""
_OC = "count(*) FILTER (verdict AND hit) AS tp, count(*) FILTER (verdict AND NOT hit) AS fp, count(*) FILTER (NOT verdict AND hit) AS fn, count(*) FILTER (NOT verdict AND NOT hit) AS tn, count(*) FILTER (verdict IS NULL) AS errors, count(*) AS total_candidates"
_OM = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN tp / (tp + fn) + tn / (tn + fp) - 1 END AS youdens_j"


@query("oracle_metrics", f"WITH {_J}, k AS (SELECT {_OC} FROM j) SELECT tp, fp, fn, tn, errors, total_candidates, {_OM}, coalesce(tp / nullif(tp + fp, 0), 0) AS oracle_precision FROM k", "cells", "answers")
def _(spark, d):
    return S.oracle(W.answers(spark, d), W.reference(spark, d)).select("tp", "fp", "fn", "tn", "errors", "total_candidates", "sensitivity", "specificity", "youdens_j", "oracle_precision")


@query("oracle_partial", f"WITH {_J}, k AS (SELECT {_OC}, count(*) FILTER (verdict IS NOT NULL AND NOT sc) AS partial_scope_excluded, count(*) FILTER (NOT sc AND NOT verdict) AS far FROM j) SELECT tp, fp - (partial_scope_excluded - far) AS fp, fn, tn - far AS tn, errors, partial_scope_excluded FROM k", "cells", "answers")
def _(spark, d):
    return S.oracle(W.answers(spark, d), W.reference(spark, d), True).select("tp", "fp", "fn", "tn", "errors", "partial_scope_excluded")


@query("oracle_strata", f"WITH {_J}, l AS (SELECT source, target, CASE WHEN min(x) = max(x) THEN min(x) ELSE 'unknown' END AS lane FROM (SELECT *, CASE type WHEN 'CLS' THEN 'class' WHEN 'INST' THEN 'instance' ELSE 'property' END AS x FROM answers) GROUP BY 1, 2), k AS (SELECT lane, {_OC} FROM j JOIN l USING (source, target) GROUP BY lane) SELECT lane, tp, fp, fn, tn, errors, total_candidates, {_OM} FROM k", "cells", "answers")
def _(spark, d):
    rows = W.answers(spark, d)
    return S.oracle_strata(rows, W.reference(spark, d), A.lanes_by_pair(rows)).select("lane", "tp", "fp", "fn", "tn", "errors", "total_candidates", "sensitivity", "specificity", "youdens_j")


@query("false_mappings", f"WITH {_J} SELECT source, target, verdict AS oracle_prediction, oracle_confidence, hit AS in_reference, CASE WHEN hit THEN 'FN' ELSE 'FP' END AS error_type FROM j WHERE verdict <> hit", "cells", "answers")
def _(spark, d):
    return S.false_mappings(W.answers(spark, d), W.reference(spark, d))


@query("annotated", """WITH asked AS (SELECT DISTINCT source, target FROM sys), p AS (SELECT source, target, arg_min(state, event_id) AS state FROM answers GROUP BY 1, 2)
SELECT source, target, CASE state WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' WHEN 'error' THEN 'ERROR' ELSE 'SKIPPED' END AS annotation FROM asked LEFT JOIN p USING (source, target)""", "cells", "answers")
def _(spark, d):
    return A.annotated(W.system(spark, d).select(*A.PAIR).distinct(), W.answers(spark, d).withColumn("_pos", F.col("event_id"))).drop("annotation_confidence")


@query("both_ways", """WITH f AS (SELECT source, target, arg_min(state, event_id) AS fs, arg_min(oracle_confidence, event_id) AS fc FROM answers WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT source, target, arg_min(state, event_id) AS bs, arg_min(oracle_confidence, event_id) AS bc FROM answers WHERE event_id % 2 = 1 GROUP BY 1, 2),
q AS (SELECT source, target, arg_max(type, (event_id, type)) AS type FROM answers GROUP BY 1, 2)
SELECT source, target, CASE WHEN type <> 'CLS' AND fs IS NOT NULL THEN fs WHEN fs IS NULL OR bs IS NULL THEN 'skipped' WHEN fs = 'error' OR bs = 'error' THEN 'error' WHEN fs = 'true' AND bs = 'true' THEN 'true' ELSE 'false' END AS state,
  CASE WHEN type <> 'CLS' AND fs IS NOT NULL THEN fc WHEN fs IS NULL OR bs IS NULL THEN -1 ELSE least(fc, bc) END AS confidence,
  CASE WHEN type <> 'CLS' AND fs IS NOT NULL THEN 'n/a' WHEN fs IS NULL OR bs IS NULL THEN 'skipped' ELSE bs END AS reverse_state FROM q LEFT JOIN f USING (source, target) LEFT JOIN b USING (source, target)""", "answers")
def _(spark, d):
    rows = W.answers(spark, d).withColumn("_pos", F.col("event_id"))
    first = lambda df, direction: A.first_of_pair(df.select(*A.PAIR, "_pos", "verdict", "state", "oracle_confidence")).drop("_pos").withColumn("direction", F.lit(direction)).withColumn("input_tokens", F.lit(1).cast("long")).withColumn("output_tokens", F.lit(None).cast("long"))
    both = first(rows.where("event_id % 2 = 0"), "forward").unionByName(first(rows.where("event_id % 2 = 1"), "reverse"))
    out = C.both_ways(A.types_by_pair(rows), both)
    return out.select(*A.PAIR, "state", F.nanvl("oracle_confidence", F.lit(-1.0)).alias("confidence"), "reverse_state")


@query("verdict_counts", "SELECT state, count(*) AS n FROM answers GROUP BY state", "answers")
def _(spark, d):
    return C.summary(W.answers(spark, d))


@query("first_abort", """WITH l AS (SELECT user_id % 50 AS run, event_id AS "at", event_type NOT IN ('purchase', 'signup', 'click', 'view') AS bad FROM events),
e AS (SELECT run, "at", bad, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY "at") AS errors FROM l),
g AS (SELECT *, coalesce(max(CASE WHEN NOT bad THEN errors END) OVER (PARTITION BY run ORDER BY "at"), 0) AS ok FROM e)
SELECT CAST(run AS BIGINT) AS run, min("at") AS "at" FROM g WHERE bad AND (errors - ok >= 3 OR errors >= 12) GROUP BY run""")
def _(spark, d):
    log = W.table(spark, d, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("at"), F.when(F.col("event_type").isin("purchase", "signup", "click", "view"), "ok").otherwise("error").alias("state"))
    return C.first_abort(log, total=240, floor=12, consecutive=3).select("run", "at")


@query("stub_oracle", "WITH p AS (SELECT doc_id, text FROM documents) SELECT doc_id, CAST('0x' || sha256(text)[1:8] AS BIGINT) % 3 = 0 AS verdict, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) END AS input_tokens FROM p")
def _(spark, d):
    docs = W.table(spark, d, "documents")
    prompts = docs.select(F.col("doc_id").cast("string").alias("source"), F.lit("x").alias("target"), F.lit("forward").alias("direction"), F.col("text").alias("prompt"))
    return C.stub(prompts, 3).select(F.col("source").cast("long").alias("doc_id"), "verdict", "input_tokens")


@query("quality_as_test", """WITH j AS (SELECT l.quality = 1 AS truth, length(d.text) > 400 AS said FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM j) SELECT tp, fp, fn, tn, """ + _OM + " FROM k")
def _(spark, d):
    rows = W.table(spark, d, "labels").join(W.table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    said, truth = F.col("n") > 400, F.col("quality") == 1
    counts = rows.agg(*[F.count_if(c).alias(n) for c, n in ((said & truth, "tp"), (said & ~truth, "fp"), (~said & truth, "fn"), (~said & ~truth, "tn"))])
    measured = M.oracle(*(F.col(c) for c in ("tp", "fp", "fn", "tn")), undefined_is_zero=False)
    return counts.select("tp", "fp", "fn", "tn", *[measured[c].alias(c) for c in ("sensitivity", "specificity", "youdens_j")])


@query("parsed_answers", None)
def _(spark, d):
    return W.table(spark, d, "conversations").withColumn("a", V.parse_answer(F.col("text"))).select("conv_id", "turn", "a.verdict", "a.reason")


@query("json_answers", """SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type = 'click' THEN false END AS verdict FROM events""")
def _(spark, d):
    raw = F.when(F.col("event_type") == "purchase", '{"answer": true}').when(F.col("event_type") == "signup", '{"answer": "Yes."}').when(F.col("event_type") == "click", "false").otherwise(F.col("props"))
    return W.table(spark, d, "events").select("event_id", V.json_verdict(raw).alias("verdict"))


# ---- graphs

@query("ancestors", "WITH a AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM hierarchy UNION ALL SELECT x.child, y.parent, 2 FROM hierarchy x JOIN hierarchy y ON x.parent = y.child) SELECT node, ancestor, distance FROM a", "hierarchy")
def _(spark, d):
    return G.ancestors(W.hierarchy(spark, d))


@query("descendant_counts", "WITH a AS (SELECT child AS node, parent AS ancestor FROM hierarchy UNION ALL SELECT x.child, y.parent FROM hierarchy x JOIN hierarchy y ON x.parent = y.child) SELECT ancestor AS node, count(*) AS n FROM a GROUP BY 1", "hierarchy")
def _(spark, d):
    return G.descendants(W.hierarchy(spark, d)).groupBy("node").agg(F.count("*").alias("n"))


@query("levels", "WITH a AS (SELECT child AS node, 1 AS level, parent AS member FROM hierarchy UNION ALL SELECT x.child, 2, y.parent FROM hierarchy x JOIN hierarchy y ON x.parent = y.child UNION ALL SELECT child, 0, child FROM hierarchy) SELECT node, CAST(level AS INT) AS level, member FROM a", "hierarchy")
def _(spark, d):
    h = W.hierarchy(spark, d)
    return G.levels(h, h.select(F.col("child").alias("node")), 2)


@query("direct_parent", "SELECT child, min(parent) AS parent FROM hierarchy GROUP BY child", "hierarchy")
def _(spark, d):
    return G.direct_parent(W.hierarchy(spark, d))


@query("siblings", "SELECT node, rank, sibling FROM (SELECT a.child AS node, b.child AS sibling, CAST(row_number() OVER (PARTITION BY a.child ORDER BY lower(b.child), b.child) AS INT) AS rank FROM hierarchy a JOIN hierarchy b USING (parent) WHERE a.child <> b.child) WHERE rank <= 2", "hierarchy")
def _(spark, d):
    h = W.hierarchy(spark, d)
    return G.siblings(h, h.select(F.col("child").alias("uri"), F.col("child").alias("label")), 2).select("node", "rank", "sibling")


@query("predicate_entropy", "WITH c AS (SELECT p, o, count(*) AS c FROM triples GROUP BY 1, 2), t AS (SELECT p, sum(c) AS t FROM c GROUP BY p) SELECT p AS predicate, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM c JOIN t USING (p) GROUP BY p", "triples")
def _(spark, d):
    return G.predicate_entropy(W.triples(spark, d)).select("predicate", F.round("entropy", 6).alias("entropy"))


@query("instance_context", "SELECT s AS uri, len(list(DISTINCT (p, o))) AS n_data, min(CASE WHEN p = 'http://v#brand' THEN o END) AS brand FROM triples GROUP BY s", "triples")
def _(spark, d):
    rows = G.instance_context(W.triples(spark, d), ["http://v#none"], [])
    brand = F.array_min(F.transform(F.filter("data", lambda x: x["predicate_label"] == "brand"), lambda x: x["value"]))
    return rows.select("uri", F.size("data").cast("long").alias("n_data"), brand.alias("brand"))


@query("type_members", "SELECT uri, rank, sibling FROM (SELECT a.p_partkey AS uri, b.p_partkey AS sibling, CAST(row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_name, 'p' || b.p_partkey) AS INT) AS rank FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE rank <= 3")
def _(spark, d):
    p = W.table(spark, d, "part")
    index = p.select(F.col("p_brand").alias("type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("label"))
    number = lambda c: F.substring(F.col(c), 2, 20).cast("long").alias(c)
    return G.type_siblings(index, 3).select(number("uri"), "rank", number("sibling"))


# ---- retrieval

_COS = "cast(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS DOUBLE)"
_VEC = "v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


@query("ranked_examples", f"WITH {_VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS example, {_COS} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query, rank, example, round(score, 5) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, example) AS INT) AS rank FROM p) WHERE rank <= 5")
def _(spark, d):
    v = W.vectors(spark, d).withColumn("vector", E.unit(F.col("vector")))
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "vector")
    itself = queries.select("query", F.col("query").alias("example"))
    out = E.ranked(queries, v.select(F.col("vec_id").alias("example"), "vector"), 5, excluded=itself)
    return out.select("query", "rank", "example", F.round("score", 5).alias("score"))


@query("ranked_same_kind", f"WITH {_VEC}, p AS (SELECT a.vec_id AS query, b.vec_id AS example, {_COS} AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query, rank, example FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, example) AS INT) AS rank FROM p) WHERE rank <= 3")
def _(spark, d):
    v = W.vectors(spark, d).withColumn("vector", E.unit(F.col("vector")))
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label", "vector")
    out = E.ranked(queries, v.select(F.col("vec_id").alias("example"), "label", "vector"), 3, excluded=queries.select("query", F.col("query").alias("example")), same="label")
    return out.select("query", "rank", "example")


@query("anchors", """WITH k AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM ref)
SELECT type AS kind, source, target, _pos AS pos FROM sys WHERE relation = '=' AND (least(source, target), greatest(source, target)) NOT IN (SELECT (a, b) FROM k)""", "cells")
def _(spark, d):
    return E.anchors(W.system(spark, d), W.reference(spark, d)).select("kind", "source", "target", F.col("_pos").alias("pos"))


@query("corpus", "SELECT type AS kind, f.source AS source, f.target AS target FROM (SELECT type, least(source, target) AS a, greatest(source, target) AS b, min({'p': _pos, 'source': source, 'target': target}) AS f FROM cells WHERE relation = '=' GROUP BY 1, 2, 3)", "cells")
def _(spark, d):
    rows = W.cells(spark, d).where("relation = '='").select(F.col("type").alias("kind"), F.lit(True).alias("label"), "source", "target", "_pos")
    return E.corpus(rows).select("kind", "source", "target")


@query("examples_in_budget", "WITH t AS (SELECT conv_id AS query, turn, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) * CAST(length(text) > 0 AS INT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations), g AS (SELECT query, place, n AS tokens, sum(n) OVER (PARTITION BY query ORDER BY place) AS total FROM t) SELECT query, CAST(place AS INT) AS place, tokens FROM g WHERE total <= 200")
def _(spark, d):
    rows = W.table(spark, d, "conversations").select(F.col("conv_id").alias("query"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("place"), "text")
    return E.within_budget(rows, 200).select("query", "place", "tokens")


# ---- questions

def _property(label: str, value=None, datatype: str | None = None, other=None):
    none = F.lit(None).cast("string")
    return F.struct(F.lit(label).alias("predicate_label"), F.lit(f"#{label}").alias("predicate_uri"), (none if value is None else value).alias("value"), F.lit(datatype).cast("string").alias("datatype"), none.alias("object_uri"), (none if other is None else other).alias("object_label"), none.alias("kind"))


def _entities(spark, d) -> DataFrame:
    """Nations as classes (e), properties (q) and instances (i): the region is the parent, the name's first letters are a synonym."""
    n = W.table(spark, d, "nation").join(W.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    return n.select(
        F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"),
        F.struct(F.array("n_name").alias("names"), F.array(F.col("n_name"), F.left("n_name", F.lit(3))).alias("all_names"), F.array(F.left("n_name", F.lit(3))).alias("synonyms"), F.col("n_name").alias("own_name"), F.col("r_name").alias("parent"), F.array(F.array("r_name")).alias("parent_names"), F.array(none).alias("child_names"), F.array("n_name", "r_name").alias("levels"), F.array(F.array(F.left("n_name", F.lit(3))), none).alias("level_synonyms"), F.array(F.lit("A"), F.lit("B")).alias("siblings"),
                 F.array(F.struct(F.lit("some").alias("restriction_type"), F.lit("part of").alias("property_name"), F.col("r_name").alias("filler_name"), F.lit(None).cast("int").alias("cardinality"))).alias("restrictions"), F.array(F.lit("has part")).alias("as_domain"), none.alias("as_range")).alias("e"),
        F.struct(F.array("n_name").alias("names"), F.col("n_name").alias("own_name"), F.array(F.left("n_name", F.lit(3))).alias("synonyms"), F.array("r_name").alias("domain"), F.array(F.lit("Thing")).alias("range"), F.array(F.lit("place")).alias("domain_synonyms"), none.alias("range_synonyms"), F.lit(False).alias("is_data"), F.array(F.lit("functional")).alias("characteristics"), F.left("n_name", F.lit(3)).alias("inverse")).alias("q"),
        F.struct(F.array("n_name").alias("names"), F.col("n_name").alias("uri"), F.array(F.lit("Nation")).alias("types"), F.array(_property("number", F.col("n_nationkey").cast("string"), "integer"), _property("code", F.left("n_name", F.lit(3)))).cast(X.PROPERTY).alias("data"), F.array(_property("region", None, None, F.col("r_name"))).cast(X.PROPERTY).alias("object")).alias("i"),
    )


def _question_sql(lines: list[str]) -> str:
    """A question as SQL: {a.n} and the like stand for columns of the two nations."""
    parts = re.split(r"\{([ab]\.\w)\}", "\n".join(lines))
    body = " || ".join(x if i % 2 else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(parts))
    return f"WITH n AS (SELECT n_nationkey AS k, n_name AS n, r_name AS p, left(n_name, 3) AS y, n_regionkey AS g FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a.k AS source, b.k AS target, {body} AS prompt FROM n a JOIN n b ON a.g <> b.g"


def _pair(line: str) -> list[str]:
    """The line about the first entity and that about the second; @ stands for either."""
    return [f"The {x} one is " + line.replace("@", e) for x, e in (("first", "a"), ("second", "b"))]


_PRE = "We have two entities from different ontologies."
_END = 'Respond with a JSON object: {"answer": true} or {"answer": false}.'
_ASK = f"\nDo they mean the same thing? {_END}"
_SYN = '"{@.n}", also known as "{@.y}"'
_CAT = ', which falls under the category "{@.p}"'
_SIB = ' Other "{@.p}" concepts include "A" and "B".'
_IS = '\nIf something is a "{a.n}", is it also a "{b.n}"'
_TWO = "\nFor these to be the same concept, BOTH of the following must be true:"
_ARE = f"\nAre both statements true? {_END}"
_GIVEN = "Given two entities from different ontologies with their names{0}, determine if these concepts are the same:\n"


def _block(head: str, fields: list[str], end: str, mark: str = "") -> list[str]:
    out = [head]
    for i, x, e in ((1, "Source", "a"), (2, "Target", "b")):
        out += [f"    {i}. {mark}{x} Entity:{mark}", *["    " + f.replace("@", e).replace("*", mark) for f in fields], ""]
    return [*out, "    " + end]


_ALL, _PREF, _PAR, _KID = "*All Entity names:* ['{@.y}', '{@.n}']", "*All Entity names:* ['{@.n}']", "*Parent Entity Namings:* [['{@.p}']]", "*Child Entity Namings:* [[]]"
_TF = "Response with True or False"
_QUESTIONS = {
    "all_data_dummy": _block("**Task Description:**\n    " + _GIVEN.format(", parent relationships, and child relationships"), [_PREF, _PAR, _KID], 'Write "Yes" if the entities refer to the same concepts, and "No" otherwise.', "**"),
    "only_names": _block(_GIVEN.format(""), [_ALL], _TF),
    "with_hierarchy": _block(_GIVEN.format(", parent relationships, and child relationships"), [_ALL, _PAR, _KID], _TF),
    "only_with_parents": _block(_GIVEN.format(" and parent relationships"), [_ALL, _PAR], _TF),
    "only_with_children": _block(_GIVEN.format(" and child relationships"), [_ALL, _KID], _TF),
    "one_level_of_parents_structured": ["Analyze the following entities, each originating from a distinct ontology.", "Your task is to assess whether they represent the **same ontological concept**, considering both their semantic meaning and hierarchical position.", '\n1. Source entity: "{a.n}"', "\t- Direct ontological parent: {a.p}", '\n2. Target entity: "{b.n}"', "\t- Direct ontological parent: {b.p}", f"\nAre these entities **ontologically equivalent** within their respective ontologies? {_END}"],
    "two_levels_of_parents_structured": ["Analyze the following entities, each originating from a distinct ontology.", "Each is represented by its **ontological lineage**, capturing its hierarchical placement from the most general to the most specific level.", "\n1. Source entity ontological lineage:\n\tLevel 0: {a.n}\n\tLevel 1: {a.p}", "\n2. Target entity ontological lineage:\n\tLevel 0: {b.n}\n\tLevel 1: {b.p}", f"\nBased on their **ontological positioning, hierarchical relationships, and semantic alignment**, do these entities represent the **same ontological concept**? {_END}"],
    "one_level_of_parents": [_PRE, *_pair('"{@.n}", which belongs to the broader category "{@.p}"'), _ASK],
    "two_levels_of_parents": [_PRE, *_pair('"{@.n}", which belongs to the broader category "{@.p}"'), _ASK],
    "one_level_of_parents_and_synonyms": [_PRE, *_pair(_SYN + _CAT + "."), _ASK],
    "eacl_direct_entity_with_synonyms": ["We have two entities from different biomedical ontologies.", *_pair(_SYN + _CAT + "."), '\nDo they mean the same thing? Respond with "True" or "False".'],
    "two_levels_of_parents_and_synonyms": [_PRE, *_pair(_SYN + ', belongs to broader category "{@.p}".'), _ASK],
    "synonyms_only": [_PRE, *_pair(_SYN + "."), _ASK],
    "sub_labels_only": [_PRE, *_pair(_SYN + "."), _IS + "? ", "\n" + _END],
    "sub_parents_synonyms": [_PRE, *_pair(_SYN + _CAT + "."), _IS + "? ", "\n" + _END],
    "sub_syns_conj_parent": [_PRE, *_pair(_SYN + _CAT + "."), _IS + ' and a "{b.p}"? ', "\n" + _END],
    "equiv_test_for_ancestral_disjointness": [_PRE, *_pair(_SYN + "."), '\nCan something be a "{a.n}" and a "{a.p}" at the same time as being a "{b.n}" and a "{b.p}"?', "\n" + _END],
    "equiv_with_ancestral_disjointness": [_PRE, *_pair(_SYN + "."), '\nIf something is a "{a.n}" and a "{a.p}", is it also a "{b.n}" and a "{b.p}"?', "\n" + _END],
    "single_subs": [_PRE, *_pair(_SYN + "."), _TWO, '1. Every "{a.n}" is also a "{b.n}".', '2. Every "{b.n}" is also a "{a.n}".', _ARE],
    "single_subs_with_parents": [_PRE, *_pair(_SYN + _CAT + "."), _TWO, '1. Every "{a.n}" is also a "{b.n}".', '2. Every "{b.n}" is also a "{a.n}".', _ARE],
    "single_subs_with_conj_parent": [_PRE, *_pair(_SYN + _CAT + "."), _TWO, '1. Every "{a.n}" is also a "{b.n}" and a "{b.p}".', '2. Every "{b.n}" is also a "{a.n}" and a "{a.p}".', _ARE],
    "deductive_equiv": [_PRE, "Consider the following facts:", '- "{a.n}" is a kind of "{a.p}" (Ontology 1)', '- "{a.n}" is also known as "{a.y}" (Ontology 1)', '- "{b.n}" is a kind of "{b.p}" (Ontology 2)', '- "{b.n}" is also known as "{b.y}" (Ontology 2)', '\nGiven these facts, can you conclude that "{a.n}" (Ontology 1) and "{b.n}" (Ontology 2) refer to the same real-world concept? ' + _END],
    "falsification_equiv": [_PRE, *_pair(_SYN + _CAT + "." + _SIB), '\nFirst consider: could something classified as a "{a.p}" in one ontology plausibly also be classified as a "{b.p}" in another? If the categories suggest entirely different domains, the concepts are unlikely to match. If the categories are compatible or overlapping, the concepts may well match.', '\nDo "{a.n}" (a "{a.p}") and "{b.n}" (a "{b.p}") refer to the same concept? ' + _END],
    "equiv_parents_siblings": [_PRE, *_pair('"{@.n}"' + _CAT + "." + _SIB), _ASK],
    "equiv_parents_synonyms_siblings": [_PRE, *_pair(_SYN + _CAT + "." + _SIB), _ASK],
    "class_with_restrictions": [_PRE, *_pair(_SYN + '. It relates to some "{@.p}" via "part of".'), _ASK[1:]],
    "class_role_signature": [_PRE, *_pair(_SYN + '. In its ontology, it appears as the domain of "has part".'), _ASK[1:]],
}
_REL = f"Do these properties represent the same relationship? {_END}"
_SAME = f"Do these refer to the same entity? {_END}"


def _kinds(noun: str, line: str, last: str | None = None) -> list[str]:
    return [f"The first {noun}is " + line.replace("@", "a"), f"The second {noun}is " + (last or line).replace("@", "b")]


_DR = ' which connects "{@.p}" to "Thing"'
_QUESTIONS |= {
    "prop_labels_only": [_PRE, *_kinds("property ", '"{@.n}".'), _REL],
    "prop_domain_range": [_PRE, *_kinds("property ", '"{@.n}"' + _DR + "."), _REL],
    "prop_domain_range_synonyms": [_PRE, *_kinds("property ", '"{@.n}" (also known as "{@.y}") which connects "{@.p}" (also known as "place") to "Thing"'), _REL],
    "prop_with_inverse_and_chars": [_PRE, *_kinds("property ", '"{@.n}"' + _DR + '. It is a functional property and the inverse of "{@.y}".'), _REL],
    "inst_labels_only": [_PRE, *_kinds("", '"{@.n}".', '"{@.n}"'), _SAME],
    "inst_labels_with_types": [_PRE, *_kinds("", '"{@.n}", which is a "Nation".'), _SAME],
}
_SOME, _FULL = '"{@.n}", which is a "Nation" and is "code" "{@.y}" and is "number" {@.k} and is "region" "{@.p}".', '"{@.n}", which is a "Nation" and has attributes: is "code" "{@.y}" and is "number" {@.k} and has relationships: is "region" "{@.p}".'
_BY_ENTROPY = '"{@.n}", which is a "Nation" and is "number" {@.k} and is "code" "{@.y}" and is "region" "{@.p}".', '"{@.n}", which is a "Nation" and has attributes: is "number" {@.k} and is "code" "{@.y}" and has relationships: is "region" "{@.p}".'
for _base, _line, _other in (("inst_types_and_attributes", _SOME, _BY_ENTROPY[0]), ("inst_full_context", _FULL, _BY_ENTROPY[1])):
    _QUESTIONS |= {_base: [_PRE, *_kinds("", _line), _SAME], f"{_base}_intersect": [_PRE, *_kinds("", _line), _SAME], f"{_base}_entropy": [_PRE, *_kinds("", _other), _SAME]}


def _question(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _entities(spark, d)
        e = F.col({"CLS": "e", "OPROP": "q", "INST": "i"}[T.REGISTRY[name].kind])
        a, b = rows.select(F.col("key").alias("source"), F.col("region").alias("g"), e.alias("a")), rows.select(F.col("key").alias("target"), F.col("region").alias("h"), e.alias("b"))
        pairs = a.join(b, F.col("g") != F.col("h"))  # 25 nations
        context = T.Context(entropies=F.create_map(F.lit("#number"), F.lit(4.6)))
        return pairs.select("source", "target", T.question(name, F.col("a"), F.col("b"), context).alias("prompt"))

    return run


for _name in T.REGISTRY:
    query(f"question_{_name}", _question_sql(_QUESTIONS[_name]))(_question(_name))


@query("common_properties", None)
def _(spark, d):
    rows = G.instance_context(W.triples(spark, d), ["http://v#none"], []).select("uri", "data", F.get(F.filter("data", lambda x: x["predicate_label"] == "brand"), F.lit(0))["value"].alias("brand"))
    pairs = rows.join(rows.groupBy("brand").agg(F.min(F.struct("uri", "data")).alias("f")), "brand").where("uri <> f.uri")
    return pairs.select("uri", F.col("f.uri").alias("other"), X.attribute_clause(X.common_properties(F.col("data"), F.col("f.data"), 3, True)["source"], 3).alias("clause"))


@query("verbalised", "SELECT p_partkey, 'whose brand is \"' || p_brand || '\"' AS brand, 'whose size is \"' || p_size || '\"' AS size FROM part")
def _(spark, d):
    return W.table(spark, d, "part").select("p_partkey", X.verbalised(F.lit("Brand"), F.col("p_brand")).alias("brand"), X.verbalised(F.lit("size"), F.col("p_size").cast("string")).alias("size"))


# ---- scalars

@query("relation_spellings", """SELECT l_returnflag || l_linestatus AS k, count(*) AS n, min(CASE l_returnflag WHEN 'A' THEN '=' WHEN 'N' THEN '<' ELSE '>' END) AS relation FROM lineitem GROUP BY 1""")
def _(spark, d):
    spelling = F.when(F.col("l_returnflag") == "A", " Equivalence ").when(F.col("l_returnflag") == "N", "&lt;").otherwise(">=")
    return W.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("n"), F.min(R.normalise_relation(spelling)).alias("relation"))


@query("retry_delays", "SELECT event_id, round(0.5 * power(2, least(event_id % 6, 4)) * (1 + 0.25 * (CAST('0x' || h[1:8] AS BIGINT) * 4294967296.0::DOUBLE + CAST('0x' || h[9:16] AS BIGINT)) / 18446744073709551616.0::DOUBLE), 9) AS delay FROM (SELECT event_id, sha256('7:' || event_id || ':' || (event_id % 6 + 1)) AS h FROM events)")
def _(spark, d):
    retry = (F.col("event_id") % 6 + 1).cast("int")
    return W.table(spark, d, "events").select("event_id", F.round(K.retry_delay(F.col("event_id").cast("string"), retry, F.lit(7)), 9).alias("delay"))


@query("local_names", "SELECT DISTINCT source, regexp_extract(source, '[^/]*$') AS name FROM cells", "cells")
def _(spark, d):
    return W.cells(spark, d).select("source", R.local_name(F.col("source")).alias("name")).distinct()


@query("confidences", "SELECT event_id, coalesce(value, 0.0) AS confidence, CASE WHEN event_type = 'error' THEN 1.0 ELSE coalesce(value, 1.0) END AS finite FROM events")
def _(spark, d):
    text = F.when(F.col("event_type") == "error", "nan").otherwise(F.col("value").cast("string"))
    return W.table(spark, d, "events").select("event_id", V.confidence(F.col("value")).alias("confidence"), V.finite_or_one(text).alias("finite"))


# ---- experiments

@query("jobs_grouped", "SELECT task, model, count(*) AS expected, count(*) FILTER (status <> 'not_run') AS completed, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'not_run') AS not_run, count(*) FILTER (status <> 'not_run') / count(*) AS coverage, round(avg(score) FILTER (status <> 'not_run'), 4) AS mean_score FROM jobs GROUP BY 1, 2", "jobs")
def _(spark, d):
    out = P.grouped(W.jobs(spark, d), ["task", "model"], ["score"], allow_partial=True)
    return out.select("task", "model", "expected", "completed", "success", "degraded", "not_run", "coverage", F.round("mean_score", 4).alias("mean_score"))


@query("jobs_pooled", f"WITH k AS (SELECT task, count(*) AS contributors, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM jobs WHERE fn IS NOT NULL GROUP BY 1) SELECT task, contributors, {MEASURED[7:]} FROM k", "jobs")
def _(spark, d):
    return P.pooled(W.jobs(spark, d), ["task"])


@query("jobs_pooled_oracle", f"WITH k AS (SELECT model, count(*) AS contributors, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM jobs WHERE fn IS NOT NULL GROUP BY 1) SELECT model, contributors, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, {_OM} FROM k", "jobs")
def _(spark, d):
    return P.pooled_oracle(W.jobs(spark, d), ["model"]).select("model", "contributors", "tp", "fp", "fn", "tn", "accuracy", "sensitivity", "specificity", "youdens_j")


@query("jobs_fair_order", "SELECT id, model, CAST(row_number() OVER (PARTITION BY model ORDER BY _pos) AS INT) AS turn FROM jobs", "jobs")
def _(spark, d):
    return P.fair_order(W.jobs(spark, d)).select("id", "model", "turn")


@query("jobs_status", "WITH a AS (SELECT o_orderkey AS id, l_linenumber AS attempt, arg_max(l_linestatus || l_returnflag, (l_linenumber, l_linestatus || l_returnflag)) AS st FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT CASE WHEN s IS NULL THEN 'not_run' ELSE s END AS status, count(*) AS n FROM (SELECT id, arg_max(st, attempt) AS s FROM a GROUP BY id) GROUP BY 1")
def _(spark, d):
    attempts = W.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("attempt")).agg(F.max(F.concat("l_linestatus", "l_returnflag")).alias("status"))
    return P.status_counts(P.status(W.jobs(spark, d).drop("status"), attempts))


@query("matrix", "SELECT o_orderpriority AS task, r_name AS model, CAST(c AS VARCHAR) AS condition, CAST(p AS INT) AS repeat, sha256(concat_ws(chr(31), o_orderpriority, r_name, CAST(c AS VARCHAR), CAST(p AS VARCHAR))) AS digest FROM (SELECT DISTINCT o_orderpriority FROM orders), region, (SELECT DISTINCT l_returnflag AS c FROM lineitem), range(1, 4) t(p) WHERE NOT (r_name = 'ASIA' AND c = 'A')")
def _(spark, d):
    tasks = W.table(spark, d, "orders").select(F.col("o_orderpriority").alias("task")).distinct()
    models = W.table(spark, d, "region").select(F.col("r_name").alias("model"))
    conditions = W.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("condition")).distinct()
    excluded = spark.createDataFrame([(None, "ASIA", "A", None)], "task string, model string, condition string, repeat int")
    return P.expanded(tasks, models, conditions, 3, excluded).select("task", "model", "condition", "repeat", "digest")
