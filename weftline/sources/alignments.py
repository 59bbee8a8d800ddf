"""Readers of alignment files. Rules on header lines and short rows differ by reader and are part of the formats.

Text is read line by line with Spark; `_pos` is the order of the lines. A file that has data lines but no usable one raises.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import relations as R
from weftline.functions import verdicts as V
from weftline.operators import alignment as A

# fixed values
PLAIN_HEADER = ("SrcEntity",)
CELL_HEADERS = ("srcentity", "source", "src", "entity1")
STRATA_HEADERS = ("source", "sourceentity", "srcentity", "source_entity_uri", "entity1")
XML_SUFFIXES = ("rdf", "xml", "owl")
ALIGNMENT = "source string, target string, relation string, confidence double, type string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, _pos) of a text file without line ends and byte order mark."""
    raw = spark.read.text(path).withColumn("_pos", F.monotonically_increasing_id())
    return raw.select(F.regexp_replace(F.rtrim(F.col("value"), F.lit("\r")), "^﻿", "").alias("line"), "_pos")


def _fields(df: DataFrame, sep: str) -> DataFrame:
    return df.where(F.trim("line") != "").withColumn("f", F.split("line", re.escape(sep), -1))


def _first_is(df: DataFrame, test: Column) -> DataFrame:
    """Drops the first line if it is a header."""
    first = df.orderBy("_pos").limit(1).select("_pos", test.alias("_header")).where("_header").select("_pos")
    return df.join(F.broadcast(first), "_pos", "left_anti")  # one row


def _checked(df: DataFrame, usable: Column, path: str) -> DataFrame:
    seen = df.agg(F.count("*").alias("n"), F.count_if(usable).alias("m")).head()
    if seen["n"] and not seen["m"]:
        raise ValueError(f"{path}: {seen['n']} data lines but no usable one; is the separator right?")
    return df.where(usable)


def at(i: int) -> Column:
    return F.trim(F.get("f", F.lit(i)))


def read_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Distinct (source, target) of any relation; a first field SrcEntity is a header; rows of one field are dropped."""
    rows = _first_is(_fields(lines(spark, path), sep), at(0).isin(*PLAIN_HEADER))
    return _checked(rows, F.size("f") >= 2, path).select(at(0).alias("source"), at(1).alias("target")).distinct()


def read_cells(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(source, target, relation, _pos), duplicates and order kept. The suffix says the form: RDF, pipes (.txt) or tabs. The third
    field is a relation only if it is exactly one."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if sep is None and suffix in XML_SUFFIXES:
        return read_rdf(spark, path).select("source", "target", "relation", "_pos")
    sep = sep or ("|" if suffix == "txt" else "\t")
    rows = _first_is(_fields(lines(spark, path), sep), F.lower(at(0)).isin(*CELL_HEADERS))
    rows = _checked(rows, F.size("f") >= 2, path)
    return rows.select(at(0).alias("source"), at(1).alias("target"), F.coalesce(R.exact_relation(F.get("f", F.lit(2))), F.lit("=")).alias("relation"), "_pos")


class _RdfCells:
    """Target of a parser: the elements that have both entities, whatever their namespaces, without a tree of the document."""

    def __init__(self):
        self.rows, self.open, self.n, self.names, self.text = [], [], 0, {}, None

    def start(self, tag: str, attrib: dict) -> None:
        name = self.names.get(tag)
        if name is None:
            name = self.names[tag] = tag.rpartition("}")[2]
        if self.text is not None:  # an element's text ends at its first child
            self.open[-1][2], self.text = "".join(self.text), None
        if name in ("entity1", "entity2"):
            if self.open:
                self._put(name, next((v for k, v in attrib.items() if k.rpartition("}")[2] == "resource"), None))
        elif name in ("relation", "measure"):
            self.text = []
        self.open.append([self.n, None, None])
        self.n += 1

    def _put(self, name: str, value: str | None) -> None:
        """A child's value; the last child of a name counts."""
        parent = self.open[-1]
        if parent[1] is None:
            parent[1] = {}
        parent[1][name] = value

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, tag: str) -> None:
        place, found, text = self.open.pop()
        name = self.names[tag]
        if name in ("relation", "measure") and self.open:
            if self.text is not None:
                text, self.text = "".join(self.text), None
            self._put(name, text or None)
        if found and found.get("entity1") is not None and found.get("entity2") is not None:
            self.rows.append((place, found["entity1"], found["entity2"], found.get("relation"), found.get("measure")))

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


class RdfParser:
    """(place of the element, entity1, entity2, relation, measure) of a document that is fed piece by piece; a piece ends at the document's
    end or before or after the word entity2. A bare < as relation, which is no XML, is read too. A document that is no XML raises."""

    def __init__(self):
        self.cells = _RdfCells()
        self.parser = ET.XMLParser(target=self.cells)

    def feed(self, piece: bytes) -> list[tuple]:
        self.parser.feed(piece.decode("utf-8", "replace").replace("<relation><</relation>", "<relation>&lt;</relation>").encode())
        return self.cells.taken()

    def close(self) -> list[tuple]:
        self.parser.close()
        return self.cells.taken()


def rdf_rows(text: str) -> list[tuple[str, str, str | None, str | None]]:
    """(entity1, entity2, relation, measure) of the elements of a document that have both entities, in its order."""
    parser = RdfParser()
    return [r[1:] for r in sorted(parser.feed(text.encode()) + parser.close(), key=lambda r: r[0])]


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, relation, confidence, type, _pos) of alignment RDF/XML files. They are read in pieces, each up to the word entity2,
    so files of any size take little memory; the pieces of a file meet in one task, which parses them in order. `_pos` has gaps."""
    mark = b"entity2"
    names = ["i", "source", "target", "relation", "measure"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("i", pa.int64()), *[(c, pa.string()) for c in names[1:]]])
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(kinds)], schema=kinds)
        file = parser = None
        for batch in batches:
            files, at = batch.column(0).to_numpy(), 0
            for end in [*(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)] if len(files) else []:
                piece = mark.join(batch.column(1).slice(at, end - at).to_pylist())
                if parser is None or files[at] != file:
                    if parser is not None:
                        yield table(parser.close())
                    file, parser = files[at], RdfParser()
                else:
                    piece = mark + piece
                yield table(parser.feed(piece))
                at = end
        if parser is not None:
            yield table(parser.close())

    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    pieces = spark.read.option("lineSep", mark.decode()).text(path).select(*place, F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("text"))
    ordered = pieces.repartition("file").sortWithinPartitions("file", "start", "n").select("file", "text")
    rows = ordered.mapInArrow(run, "i long, source string, target string, relation string, measure string")
    return rows.select("source", "target", R.normalise_relation(F.col("relation")).alias("relation"), F.coalesce(F.col("measure").try_cast("double"), F.lit(1.0)).alias("confidence"), F.lit("CLS").alias("type"), F.col("i").alias("_pos"))


def read_wellformed_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed alignment RDF by Spark's own XML reader, for large files that can be split."""
    one = "struct<`_rdf:resource`:string,_resource:string>"
    rows = spark.read.format("xml").option("rowTag", "Cell").schema(f"entity1 {one}, entity2 {one}, relation string, measure string").load(path)
    name = lambda c: F.coalesce(F.col(f"{c}.`_rdf:resource`"), F.col(f"{c}._resource"))
    return rows.select(name("entity1").alias("source"), name("entity2").alias("target"), R.normalise_relation(F.col("relation")).alias("relation"), F.col("measure").try_cast("double").alias("confidence")).where("source IS NOT NULL AND target IS NOT NULL")


def read_iris(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines but blank ones and # comments."""
    return lines(spark, path).select(F.trim("line").alias("iri")).where("iri <> '' AND NOT startswith(iri, '#')").distinct()


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, split) of a file with columns SrcEntity, TgtEntity and split, in any order; short rows are dropped."""
    rows = lines(spark, path)
    head = rows.orderBy("_pos").limit(1).collect()
    names = head[0]["line"].split("\t") if head else []
    try:
        places = [names.index(c) for c in ("SrcEntity", "TgtEntity", "split")]
    except ValueError:
        raise ValueError(f"{path}: columns SrcEntity, TgtEntity and split are needed") from None
    rows = _fields(rows.where(F.col("_pos") != head[0]["_pos"]), "\t").where(F.size("f") > max(places))
    return rows.select(*[at(i).alias(c) for i, c in zip(places, ("source", "target", "split"), strict=True)]).distinct()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, verdict, state, oracle_confidence) of a predictions file; a confidence that is no number is 0."""
    rows = spark.read.option("header", True).csv(path)
    text = F.col("Oracle_prediction")
    number = F.col("Oracle_confidence") if "Oracle_confidence" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("source_entity_uri").alias("source"), F.col("target_entity_uri").alias("target"), V.verdict(text).alias("verdict"), V.verdict_state(text).alias("state"), V.confidence(number).alias("oracle_confidence"))


def read_asked(spark: SparkSession, path: str) -> DataFrame:
    """The five columns of a headerless pipe file, the first row of each pair, with `_pos`."""
    return A.first_of_pair(read_alignment(spark, path, "|"))


def read_alignment(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Five columns and `_pos`; rows of less than five fields fail; missing trailing fields are not filled in."""
    rows = _checked(_fields(lines(spark, path), sep), F.size("f") >= 5, path)
    return rows.select(at(0).alias("source"), at(1).alias("target"), at(2).alias("relation"), at(3).try_cast("double").alias("confidence"), at(4).alias("type"), "_pos")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of source, target, n, gold."""
    return spark.read.schema("source string, target string, n string, gold string").csv(path).withColumn("n", F.col("n").try_cast("double").cast("long"))


def gold_of(candidates: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The reference if there is one, else the candidates whose gold is true, 1 or yes."""
    rows = reference if reference is not None else candidates.where(F.lower(F.trim("gold")).isin("true", "1", "yes"))
    return rows.select("source", "target").distinct()


def external_rows(df: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, type, _pos) of rows of fields `f`: after the pair, a relation if the next field is one,
    then a confidence if the next is a number, then a type if the next is one; defaults are =, 1.0 and CLS."""
    rest = F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0)))
    a, b, c = (F.trim(F.get(rest, F.lit(i))) for i in range(3))
    is_relation = F.coalesce(a.isin(*R.RELATIONS), F.lit(False))
    second = F.when(is_relation, b).otherwise(a)
    is_number = F.coalesce(second.try_cast("double").isNotNull(), F.lit(False))
    third = F.when(is_relation & is_number, c).when(is_relation | is_number, b).otherwise(a)
    short = F.when(F.size("f") < 2, F.raise_error(F.concat(F.lit("too few fields: "), F.col("line"))).cast("string")).otherwise(at(0))
    return df.select(short.alias("source"), at(1).alias("target"), F.when(is_relation, a).otherwise("=").alias("relation"), F.when(is_number, second.try_cast("double")).otherwise(1.0).alias("confidence"), F.when(third.isin(*R.TYPES), third).otherwise("CLS").alias("type"), "_pos")


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External mappings in RDF, pipe or tab form as alignment rows, the first of each pair."""
    if path.rsplit(".", 1)[-1].lower() in XML_SUFFIXES:
        return A.first_of_pair(read_rdf(spark, path))
    rows = _fields(lines(spark, path), "|" if path.endswith(".txt") else "\t")
    return A.first_of_pair(external_rows(_first_is(rows, F.lower(at(0)).isin(*CELL_HEADERS))))


def read_typed_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(source, target, type) for strata; a blank end fails with the line."""
    rows = _first_is(_fields(lines(spark, path), sep), F.lower(at(0)).isin(*STRATA_HEADERS))
    blank = (F.coalesce(at(0), F.lit("")) == "") | (F.coalesce(at(1), F.lit("")) == "")
    source = F.when(blank, F.raise_error(F.concat(F.lit("a blank end in: "), F.col("line"))).cast("string")).otherwise(at(0))
    return rows.select(source.alias("source"), at(1).alias("target"), at(4).alias("type"), "_pos")


def decoded(df: DataFrame) -> DataFrame:
    """Rows with integer codes of relation and type as text; unknown codes fail."""
    return df.withColumn("relation", R.relation_of_code(F.col("relation"))).withColumn("type", R.type_of_code(F.col("type")))


def file_form(spark: SparkSession, path: str) -> str:
    """scored (header SrcEntity) or plain."""
    first = lines(spark, path).where(F.trim("line") != "").orderBy("_pos").limit(1).collect()
    return "scored" if first and first[0]["line"].split("\t")[0].strip() in PLAIN_HEADER else "plain"


def scored(spark: SparkSession, path: str) -> DataFrame:
    """(SrcEntity, TgtEntity, Score) of a file in either form; the score is the fourth field of the plain form if it is a number, else 1.0."""
    if file_form(spark, path) == "scored":
        return spark.read.option("header", True).option("sep", "\t").csv(path).select("SrcEntity", "TgtEntity", "Score")
    rows = _fields(lines(spark, path), "\t").where(F.size("f") >= 2)
    score = F.when(at(3).try_cast("double").isNotNull(), at(3)).otherwise("1.0")
    return rows.select(at(0).alias("SrcEntity"), at(1).alias("TgtEntity"), score.alias("Score"))


def local_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(verdict, n): true, false and other third fields of the *.csv files of a folder; # lines and lines without a comma don't count."""
    rows = spark.read.option("pathGlobFilter", "*.csv").text(folder).where("value LIKE '%,%' AND NOT startswith(ltrim(value), '#')")
    said = F.lower(F.trim(F.get(F.split("value", ","), F.lit(2))))
    return rows.groupBy(F.when(said.isin("true", "false"), said).otherwise("other").alias("verdict")).agg(F.count("*").alias("n"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, direction, prompt) of a JSON object with keys source|target or source|target|REVERSE."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select(F.explode("m").alias("key", "prompt")).withColumn("k", F.split("key", r"\|"))
    return rows.select(F.get("k", F.lit(0)).alias("source"), F.get("k", F.lit(1)).alias("target"), F.when(F.get("k", F.lit(2)) == "REVERSE", "reverse").otherwise("forward").alias("direction"), "prompt")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(key, examples: array<struct<user, assistant>>) of a JSON object of lists of two texts."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<array<string>>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "raw")).select("key", F.transform("raw", lambda e: F.struct(F.get(e, F.lit(0)).alias("user"), F.get(e, F.lit(1)).alias("assistant"))).alias("examples"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_is_literal, lang, datatype) of N-Triples text; comments and blank lines are skipped."""
    rows = lines(spark, path).where("trim(line) <> '' AND NOT startswith(ltrim(line), '#')")
    term = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
    part = lambda i: F.regexp_extract("line", term, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = part(3) == ""
    return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(literal, F.regexp_replace(part(4), r'\\(["\\])', "$1")).otherwise(bare(part(3))).alias("o"), literal.alias("o_is_literal"), F.nullif(part(5), F.lit("")).alias("lang"), F.nullif(part(6), F.lit("")).alias("datatype"))


def rdfxml_triples(text: str) -> list[tuple[str, str, str, bool, str | None, str | None]]:
    """The triples of an RDF/XML document: node elements with rdf:about, rdf:ID or rdf:nodeID, nested nodes, attributes as literals,
    rdf:resource, rdf:datatype, xml:lang, parseType Resource and Collection. Entity declarations are expanded by the parser."""
    rdf, xml = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
    iri = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    out: list[tuple] = []
    count = 0

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def absolute(value: str, base: str) -> str:
        return value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else base.split("#")[0] + value if value.startswith("#") or not value else f"{base.split('#')[0].rsplit('/', 1)[0]}/{value}"

    def node(e, base: str, lang: str | None) -> str:
        base, lang = e.get(f"{xml}base", base), e.get(f"{xml}lang", lang)
        about, own, shared = e.get(f"{rdf}about"), e.get(f"{rdf}ID"), e.get(f"{rdf}nodeID")
        s = absolute(about, base) if about is not None else absolute(f"#{own}", base) if own is not None else f"_:{shared}" if shared is not None else blank()
        if e.tag != f"{rdf}Description":
            out.append((s, iri(f"{rdf}type"), iri(e.tag), False, None, None))
        for name, value in e.attrib.items():
            if not name.startswith((rdf, xml)) and name.startswith("{"):
                out.append((s, iri(name), value, True, lang, None))
        for p in e:
            edge(s, p, base, lang)
        return s

    def edge(s: str, p, base: str, lang: str | None) -> None:
        lang = p.get(f"{xml}lang", lang)
        name, form, inner = iri(p.tag), p.get(f"{rdf}parseType"), list(p)
        if p.get(f"{rdf}resource") is not None:
            out.append((s, name, absolute(p.get(f"{rdf}resource"), base), False, None, None))
        elif p.get(f"{rdf}nodeID") is not None:
            out.append((s, name, f"_:{p.get(f'{rdf}nodeID')}", False, None, None))
        elif form == "Resource":
            o = blank()
            out.append((s, name, o, False, None, None))
            for q in inner:
                edge(o, q, base, lang)
        elif form == "Collection":
            items = [node(x, base, lang) for x in inner]
            cells = [blank() for _ in items] + [iri(f"{rdf}nil")]
            out.append((s, name, cells[0], False, None, None))
            for i, item in enumerate(items):
                out.extend([(cells[i], iri(f"{rdf}first"), item, False, None, None), (cells[i], iri(f"{rdf}rest"), cells[i + 1], False, None, None)])
        elif inner:
            out.append((s, name, node(inner[0], base, lang), False, None, None))
        else:
            kind = p.get(f"{rdf}datatype")
            out.append((s, name, p.text or "", True, None if kind else lang, kind))

    root = ET.fromstring(text)
    for e in root if root.tag == f"{rdf}RDF" else [root]:
        node(e, root.get(f"{xml}base", ""), root.get(f"{xml}lang"))
    return out


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_is_literal, lang, datatype) of RDF/XML files; each is parsed by one task, so large ontologies come as several files or
    as N-Triples. Blank nodes are named by file. A file that is no XML fails the job."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for place, content in zip(pdf["path"], pdf["content"], strict=True):
                mark = format(zlib.crc32(place.encode()), "08x")
                own = lambda x: f"_:{mark}{x[2:]}" if x.startswith("_:") else x
                yield pd.DataFrame([(own(s), p, o if lit else own(o), lit, lang, kind) for s, p, o, lit, lang, kind in rdfxml_triples(bytes(content).decode("utf-8-sig"))], columns=["s", "p", "o", "o_is_literal", "lang", "datatype"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "s string, p string, o string, o_is_literal boolean, lang string, datatype string")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a file, N-Triples by the suffix .nt, else RDF/XML."""
    return read_triples(spark, path) if path.rsplit(".", 1)[-1].lower() == "nt" else read_rdfxml(spark, path)


def read_ontologies(spark: SparkSession, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    return read_ontology(spark, source), read_ontology(spark, target)
