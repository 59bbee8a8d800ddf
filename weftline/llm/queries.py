"""One query for each operator of this subpackage, over its whole tables; SQL gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, embeddings, langid, minhash, quality, substring, tokencounts, tokenstore, warc
from weftline.llm._shared import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_sha256="decoded_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"), "decoded_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bl AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bl))),
m AS (SELECT r, i, dw.k, item FROM dw JOIN win USING (k, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
f AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM f UNION ALL SELECT y, x FROM f),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON r.t = e.x),
m AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) >= 0.95),
r AS (SELECT vec_id AS s, vec_id AS t FROM u UNION SELECT r.s, l.y FROM r JOIN l ON r.t = l.x),
m AS (SELECT s, min(t) AS component_id FROM r GROUP BY s),
c AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM u JOIN m ON m.s = vec_id LEFT JOIN c ON c.x = vec_id
"""


def op5_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenstore.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added_tokens=True)
    return tokenstore.read_tokens(files)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.select(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "expected_grade", "p_harmless", "p_good", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.records(warc.write_archives(table(spark, sf_dir, "pages")))
    return rows.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: Base32 comes from the hexadecimal digest, five bits at a time.
OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex),
bits AS (SELECT DISTINCT hex, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS b FROM p),
names AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT)]), '') AS payload_digest FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (hex) JOIN names USING (hex)
"""


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = tokencounts.count_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return rows.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "n_crossing", "section_tokens")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    model = langid.train(docs.where(part != 2))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_decontaminate": op2_decontaminate, "op3_minhash": op3_minhash, "op4_embeddings": op4_embeddings, "op5_tokenstore": op5_tokenstore, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_substring": op8_substring, "op9_tokencounts": op9_tokencounts, "op10_langid": op10_langid}
SQL: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op3_minhash": OP3_SQL, "op4_embeddings": OP4_SQL, "op7_warc": OP7_SQL}
