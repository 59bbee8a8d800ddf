import math

import pytest
from pyspark.sql import functions as F

from weftline import file_queries as Q
from weftline.operators import alignment as A
from weftline.operators import consult as C
from weftline.operators import graph as G
from weftline.operators import retrieval as E
from weftline.plans import matrix as P
from weftline.sources import alignments as L
from weftline.sources import artifacts as O
from weftline.streaming.failures import failure_counts


def test_first_of_pair_keeps_order_and_reversed_pairs(spark):
    df = spark.createDataFrame([("a", "b", "x", 2), ("a", "b", "y", 1), ("b", "a", "z", 3)], "source string, target string, type string, _pos long")
    assert sorted((r["source"], r["type"]) for r in A.first_of_pair(df).collect()) == [("a", "y"), ("b", "z")]


def test_readers(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("SrcEntity\tTgtEntity\tScore\na\tb\t1.0\nc\td\t=\nlonely\n")
    assert L.read_pairs(spark, str(p)).count() == 2
    assert [(r["source"], r["relation"]) for r in L.read_cells(spark, str(p)).orderBy("_pos").collect()] == [("a", "="), ("c", "=")]
    assert L.file_form(spark, str(p)) == "scored"
    q = tmp_path / "x.txt"
    q.write_text("a|b|<|0.5|CLS\na|b|=|0.9|INST\n\n")
    assert [r["relation"] for r in L.read_cells(spark, str(q)).orderBy("_pos").collect()] == ["<", "="]
    assert [r["confidence"] for r in L.read_asked(spark, str(q)).collect()] == [0.5]
    bad = tmp_path / "bad.tsv"
    bad.write_text("a,b\nc,d\n")
    with pytest.raises(ValueError, match="no usable"):
        L.read_pairs(spark, str(bad))
    (tmp_path / "none.tsv").write_text("")
    assert L.read_pairs(spark, str(tmp_path / "none.tsv")).count() == 0
    (tmp_path / "i.txt").write_text("# c\n\niri1\niri1\n")
    assert L.read_iris(spark, str(tmp_path / "i.txt")).count() == 1
    (tmp_path / "s.tsv").write_text("split\tTgtEntity\tSrcEntity\ntest\tb\ta\nshort\n")
    assert [tuple(r) for r in L.read_split(spark, str(tmp_path / "s.tsv")).collect()] == [("a", "b", "test")]


def test_rdf_with_bare_relations(spark, tmp_path):
    cell = '<Cell xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><entity1 rdf:resource="a{0}"/><entity2 rdf:resource="b{0}"/><relation>{1}</relation><measure>0.5</measure></Cell>'
    p = tmp_path / "x.rdf"
    p.write_text("<r>" + cell.format(1, "<") + cell.format(2, ">") + cell.format(3, "=") + "</r>")
    assert [(r["source"], r["target"], r["relation"]) for r in L.read_cells(spark, str(p)).orderBy("_pos").collect()] == [("a1", "b1", "<"), ("a2", "b2", ">"), ("a3", "b3", "=")]


RDF = 'xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment" xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
CELL = '<map><Cell><entity1 r:resource="é{0}"/><entity2 r:resource="&e;{0}"/><relation>{1}</relation><measure>0.{0}</measure></Cell></map>'


def _rdf_text(n: int) -> str:
    cells = [CELL.format(i, "<>=?"[i % 4]) + f'<!-- <Cell><entity1 r:resource="no"/><entity2 r:resource="{"no" * (i % 5)}"/></Cell> -->' for i in range(n)]
    return f'<?xml version="1.0"?><!DOCTYPE r:RDF [<!ENTITY e "entity2-ü">]><r:RDF {RDF}><Alignment>{"".join(cells)}</Alignment></r:RDF>'


def test_rdf_files_are_read_in_pieces(spark, tmp_path):
    """No task holds a file as one value, and files cut into splits give the same rows in the same order."""
    for k in range(3):
        (tmp_path / f"{k}.rdf").write_text(_rdf_text(40 + k), encoding="utf-8")
    want = [(f"é{i}", f"entity2-ü{i}", "<>=?"[i % 4], float(f"0.{i}")) for i in range(40)]
    held = {c: spark.conf.get(c) for c in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
        for size in (10**8, 1000, 131, 13):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = L.read_rdf(spark, str(tmp_path / "0.rdf")).orderBy("_pos").collect()
            assert [(r["source"], r["target"], r["relation"], r["confidence"]) for r in rows] == want
        assert L.read_rdf(spark, str(tmp_path / "*.rdf")).count() == 40 + 41 + 42
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_rdf_pieces_give_the_rows_of_a_tree():
    text = f'<A {RDF}><Cell><entity1 r:resource="a"/><entity2 r:resource="x"/><Cell><entity1 r:resource="c"/><entity2 r:resource="d"/></Cell><relation> &lt; <b>no</b>no</relation><entity2 r:resource="b"/><measure/></Cell><Cell><entity1/><entity2 r:resource="e"/></Cell></A>'
    want = [("a", "b", " < ", None), ("c", "d", None, None)]
    assert L.rdf_rows(text) == want
    for cut in range(len(text)):
        parser = L.RdfParser()
        rows = parser.feed(text[:cut].encode()) + parser.feed(text[cut:].encode()) + parser.close()
        assert [r[1:] for r in sorted(rows)] == want


@pytest.mark.parametrize("text", ["<r>", "<r/>x", "<r>&none;</r>", "<r><p:Cell/></r>"])
def test_rdf_that_is_no_xml_fails(spark, tmp_path, text):
    (tmp_path / "x.rdf").write_text(text)
    with pytest.raises(Exception, match="ParseError"):
        L.read_rdf(spark, str(tmp_path / "x.rdf")).count()


def test_rdf_documents_follow_the_partitions(spark):
    """A document of the written RDF is one partition's cells, not a share of all cells in one value."""
    rows = spark.range(700).select(F.concat(F.lit("a<&"), "id").alias("source"), F.lit("b").alias("target"), F.lit("<").alias("relation"), F.lit("0.5").alias("confidence")).repartition(7)
    path = Q._rdf(rows, "documents")
    found = spark.read.text(path).select(F.length("value").alias("n"))
    files = spark.read.text(path).inputFiles()
    assert len(files) == 7 and all(f.endswith(".gz") for f in files) and found.agg(F.max("n")).head()[0] < 300
    for read in (L.read_rdf, L.read_wellformed_rdf):
        got = read(spark, path).select("source", "target", "relation", "confidence").collect()
        assert sorted(map(tuple, got)) == sorted((f"a<&{i}", "b", "<", 0.5) for i in range(700))


def test_external_rows(spark, tmp_path):
    p = tmp_path / "e.tsv"
    p.write_text("a\tb\nc\td\t<\t0.3\tINST\ne\tf\t0.7\ng\th\tOPROP\n")
    got = [(r["relation"], r["confidence"], r["type"]) for r in L.read_external(spark, str(p)).orderBy("_pos").collect()]
    assert got == [("=", 1.0, "CLS"), ("<", 0.3, "INST"), ("=", 0.7, "CLS"), ("=", 1.0, "OPROP")]


def test_triples_and_graph(spark, tmp_path):
    p = tmp_path / "o.nt"
    sub, lab, typ = G.SUBCLASS, G.LABEL, G.TYPE
    p.write_text("".join(f"<{s}> <{q}> {o} .\n" for s, q, o in [("u#c", sub, "<u#b>"), ("u#b", sub, "<u#a>"), ("u#d", sub, "<u#b>"), ("u#a", sub, f"<{G.THING}>"), ("u#c", lab, '"see \\"C\\""@en'), ("u#c", typ, f"<{G.OWL}Class>"), ("u#i", typ, "<u#c>"), ("u#i", "u#p", '"5"^^<http://x#int>')]))
    t = L.read_triples(spark, str(p))
    assert t.where("s = 'u#c' AND o_is_literal").head()["o"] == 'see "C"'
    assert {(r["node"], r["ancestor"], r["distance"]) for r in G.ancestors(G.edges(t)).collect()} == {("u#c", "u#b", 1), ("u#c", "u#a", 2), ("u#b", "u#a", 1), ("u#d", "u#b", 1), ("u#d", "u#a", 2)}
    names = G.labels(t, t.select(F.col("s").alias("uri")))
    assert {r["uri"]: r["labels"] for r in names.collect()}["u#d"] == ["d"]
    sib = G.siblings(G.edges(t), names.select("uri", F.array_min("labels").alias("label")), 2)
    assert {(r["node"], r["sibling"]) for r in sib.collect()} == {("u#c", "u#d"), ("u#d", "u#c")}
    ctx = G.instance_context(t, [], []).where("uri = 'u#i'").head()
    assert ctx["types"] == ["c"] and ctx["data"][0]["value"] == "5"


def test_levels_drop_what_lies_further(spark):
    h = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    rows = G.levels(h, spark.createDataFrame([("c",)], "node string"), 2).collect()
    assert {(r["level"], r["member"]) for r in rows} == {(0, "c"), (1, "b"), (2, "a")}


def test_entropy(spark):
    t = spark.createDataFrame([("s", "p", x) for x in "aabc"] + [("s", "q", "a")], "s string, p string, o string")
    got = {r["predicate"]: r["entropy"] for r in G.predicate_entropy(t).collect()}
    assert got["q"] == 0.0 and got["p"] == pytest.approx(1.5)


def test_negatives_and_examples(spark):
    ex = spark.createDataFrame([("e1", "s1", "t1"), ("e2", "s2", "t2"), ("e3", "s3", "t3")], "id string, source string, target string")
    ranks = spark.createDataFrame([("q", 1, "e1"), ("q", 2, "e2"), ("q", 3, "e3")], "query string, rank int, example string")
    neg = E.cross_negatives(ranks, ex, spark.createDataFrame([("s1", "t2")], "source string, target string"), 2).orderBy("rank")
    assert [(r["source"], r["target"]) for r in neg.collect()] == [("s1", "t3"), ("s2", "t1")]
    sib = spark.createDataFrame([("t1", 1, "x1")], "uri string, rank int, sibling string")
    got = E.paired_negatives(ranks, ex, sib, spark.createDataFrame([("s2", "t3")], "source string, target string"), 3).orderBy("rank").collect()
    assert [(r["source"], r["target"], r["how"]) for r in got] == [("s1", "x1", "sibling"), ("s2", "t1", "donor, wrapped"), ("s3", "t1", "donor, wrapped")]
    pos = ranks.join(ex.withColumnRenamed("id", "example"), "example").select("query", "rank", "source", "target")
    four = E.examples_of(pos, neg, 4).orderBy("place").collect()
    assert [r["label"] for r in four] == [True, False, True, False]
    assert E.bundle_violations(E.examples_of(pos, neg, 4), spark.createDataFrame([("q",), ("z",)], "query string")).collect()[0]["problem"] == "no examples"


def test_ranking_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, float(i // 2)]) for i in range(6)], "example long, vector array<double>").withColumn("vector", E.unit(F.col("vector")))
    q = v.where("example = 0").select(F.col("example").alias("query"), "vector")
    assert [r["example"] for r in E.ranked(q, v, 3).orderBy("rank").collect()] == [0, 1, 2]
    h = spark.createDataFrame([("abc",), ("",)], "t string").select(E.hashed_ngrams(F.col("t"), 16).alias("v")).collect()
    assert math.isclose(sum(x * x for x in h[0]["v"]), 1.0)


def test_both_ways(spark):
    asked = spark.createDataFrame([("a", "b", "CLS"), ("c", "d", "INST"), ("e", "f", "CLS"), ("g", "h", "CLS")], "source string, target string, type string")
    said = [("a", "b", "forward", True, "true", 0.5, 1, None), ("a", "b", "reverse", False, "false", float("nan"), None, None), ("c", "d", "forward", True, "true", 0.9, 1, 1), ("e", "f", "forward", True, "true", 0.9, 1, 1), ("g", "h", "forward", True, "true", 0.2, 1, 1), ("g", "h", "reverse", None, "error", 0.1, 1, 1)]
    answers = spark.createDataFrame(said, "source string, target string, direction string, verdict boolean, state string, oracle_confidence double, input_tokens long, output_tokens long")
    got = {r["source"]: r for r in C.both_ways(asked, answers).collect()}
    assert [got[k]["state"] for k in "aceg"] == ["false", "true", "skipped", "error"]
    assert got["a"]["oracle_confidence"] == 0.5 and got["a"]["input_tokens"] == 1 and got["a"]["output_tokens"] is None
    assert got["c"]["reverse_state"] == "n/a"


def test_live_retries_only_transient_failures(spark):
    prompts = spark.createDataFrame([("a", "b", "forward", "yes?"), ("c", "d", "forward", "broken"), ("e", "f", "forward", "busy")], "source string, target string, direction string, prompt string")

    def ask(prompt):
        if prompt == "broken":
            raise RuntimeError
        if prompt == "busy":
            from weftline.operators.consult import Transient

            raise Transient
        return "Yes"

    got = {r["source"]: r["state"] for r in C.live(prompts, ask, retries=0).collect()}
    assert got == {"a": "true", "c": "error", "e": "error"}


def test_matrix(spark):
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    jobs = P.expanded(one("task", "t1", "t2"), one("model", "m"), one("condition", "c1", "c2"), 2, spark.createDataFrame([("t1", None, "c1", None)], "task string, model string, condition string, repeat int"))
    assert jobs.count() == 6 and all(len(r["id"]) <= 96 for r in jobs.collect())
    assert P.selected(jobs, {"task": ["t2"]}, 3).count() == 3
    with pytest.raises(ValueError, match="two axes"):
        P.check_axes([{"a": {"b": 1}}, {"a": {"b": 2}}])
    seal = P.sealed({"x": 1})
    P.check_seal(seal)
    with pytest.raises(ValueError, match="changed"):
        P.check_seal(seal | {"x": 2})


def test_writers(tmp_path):
    path = str(tmp_path / "a" / "x.json")
    O.write_json(path, {"b": 1, "a": None})
    assert open(path).read().startswith('{\n  "a"')
    with pytest.raises(ValueError, match="JSON compliant|not JSON"):
        O.write_json(path, {"x": float("nan")})
    assert O.write_json(path, {"x": float("nan")}, strict=False) is False
    with pytest.raises(FileExistsError):
        O.write_documents({"x": {"b": 2}}, str(tmp_path / "a"))


def test_failure_stream(spark, tmp_path):
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(["ok", "error", "error", "ok", "error"])], "run string, at long, state string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = failure_counts(stream, tolerance=3).writeStream.outputMode("update").format("memory").queryName("failures").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("failures").collect()] == [("r", 3, 1, True)]


def test_negatives_beyond_the_first_ranks(spark):
    from weftline.operators import retrieval as E

    # the first ten examples have one source, all of whose pairs are known
    n = 30
    ex = spark.createDataFrame([(f"e{i}", "hot" if i <= 10 else f"s{i}", f"t{i}") for i in range(1, n + 1)], "id string, source string, target string")
    ranks = spark.createDataFrame([("q", i, f"e{i}", 1.0 / i) for i in range(1, n + 1)], "query string, rank int, example string, score double")
    known = spark.createDataFrame([("hot", f"t{i}") for i in range(1, n)], "source string, target string")
    got = [(r["rank"], r["source"], r["target"]) for r in E.cross_negatives(ranks, ex, known, 2).orderBy("rank").collect()]
    assert got == [(1, "hot", f"t{n}"), (2, "s11", "t1")]
    none = spark.createDataFrame([], "uri string, rank int, sibling string")
    got = [(r["rank"], r["source"], r["target"], r["how"]) for r in E.paired_negatives(ranks, ex, none, known, 2).orderBy("rank").collect()]
    assert got == [(1, "hot", f"t{n}", "donor")]
    # the best anchors come from a task each, the only two of one task come last
    anchors = spark.createDataFrame([(f"a{i:02}", f"task{min(i, 40)}", "CLS", f"s{i}", f"t{i}", [1.0 - i / 100]) for i in range(1, 42)], "id string, task string, kind string, source string, target string, vector array<double>")
    queries = spark.createDataFrame([("q", "own", "CLS", [1.0])], "query string, task string, kind string, vector array<double>")
    got = [(r["source"], r["target"], r["label"]) for r in E.bundle(queries, anchors).orderBy("place").collect()]
    assert got == [("s1", "t1", True), ("s40", "t41", False), ("s2", "t2", True), ("s41", "t40", False)]


def test_siblings_count_once(spark):
    h = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("c", "p")], "child string, parent string")
    names = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("a", "a3"), ("b", "b"), ("c", "c")], "uri string, label string")
    got = {(r["node"], r["rank"], r["sibling"], r["label"]) for r in G.siblings(h, names, 2).collect()}
    assert got == {("a", 1, "b", "b"), ("a", 2, "c", "c"), ("b", 1, "a", "a1"), ("b", 2, "c", "c"), ("c", 1, "a", "a1"), ("c", 2, "b", "b")}


def test_live_asks_once_and_passes_messages(spark, tmp_path):
    rows = [("a", f"b{i % 4}", "forward", f"q{i}") for i in range(20)]  # keys repeat
    prompts = spark.createDataFrame(rows, "source string, target string, direction string, prompt string")
    shared = spark.createDataFrame([(2, "u2", "a2"), (1, "u1", "a1")], "place int, user string, assistant string")

    def ask(turns):
        import json
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text(json.dumps(turns))
        return "No"

    out = C.live(C.messages(prompts, "be brief", shared, "vllm"), ask).collect()
    assert len(out) == 20 == len(list(tmp_path.iterdir())) and all(r["verdict"] is False for r in out)
    import json

    turns = json.loads(next(tmp_path.iterdir()).read_text())
    assert [tuple(t) for t in turns[:-1]] == [("system", "be brief"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")]
    assert C.interaction_style("auto", "https://openrouter.ai/x") == "openrouter" and C.system_role(C.interaction_style("auto", None)) == "system"
    with pytest.raises(ValueError, match="unknown interaction"):
        C.interaction_style("x", None)


def test_json_answers_with_escapes_and_repeated_keys(spark):
    from weftline.functions import verdicts as V

    texts = {r'{"answer": "\u0079es"}': True, '{"answer": true, "answer": false}': False, '{"answer": "No"}': False, ' true ': True, '{"answer": 1}': None, '{"other": true}': None, '{"answer": true, "b": 1}': None, "yes": None, '{"answer": null}': None, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.json_verdict(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts


def test_static_examples(spark):
    from weftline.operators import fewshot as S

    pair = "source string, target string"
    train = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(20)], pair)
    asked = spark.createDataFrame([("s0", "t0"), ("t1", "s1"), ("s2", "t9")], pair)
    rows = S.build(train, asked, 6, seed=3).orderBy("place").collect()
    assert [r["label"] for r in rows] == [True, False] * 3 and [r["how"] for r in rows] == [None, "random"] * 3
    assert all(r["source"][1:] == r["target"][1:] for r in rows if r["label"]) and all(r["source"][1:] != r["target"][1:] for r in rows if not r["label"])
    assert rows == S.build(train.repartition(5), asked, 6, seed=3).orderBy("place").collect()
    near = spark.createDataFrame([(f"t{i}", 1, f"t{i}") for i in range(20)] + [(f"t{i}", 2, "t9") for i in range(3)], "node string, rank int, sibling string")
    hard = S.hard_negatives(train, near, asked, 4, 1).orderBy("place").collect()
    assert {(r["source"], r["target"]) for r in hard if r["how"] == "succeeded"} == {("s0", "t9"), ("s1", "t9")} and len(hard) == 4
    assert S.audit(S.hard_negatives(train, near, asked, 4, 1)).head().asDict() == {"total": 4, "eligible": 4, "succeeded": 2, "exhausted": 2, "unsupported": 0, "success_rate": 0.5}
    both = S.build(train, asked, 5, bidirectional=True).orderBy("place").collect()
    assert [r["direction"] for r in both] == ["forward", "reverse"] * 2 + ["forward"] and [r["label"] for r in both] == [True, True, False, False, True]
    assert S.build(train.limit(0), asked, 3).count() == 0


def test_vocabularies():
    from weftline.functions import vocabularies as Y

    assert Y.preset("multilingual_skos").takes_language("fr") and not Y.preset("default").takes_language("fr") and Y.preset("default").takes_language(None)
    Y.register(Y.Vocabulary("own"))
    assert Y.preset("own").name == "own" and Y.sibling_strategy("alphanumeric", "x") == "alphanumeric" and Y.sibling_strategy(None, None) == "sbert"
    with pytest.raises(ValueError, match="lexical_extra"):
        Y.annotation_groups('{"preferred_label": [], "synonym": ["a"]}')
    assert Y.endpoint_kind("http://LOCALHOST:8000/v1") == "Local (vLLM/SGLang)" and Y.endpoint_kind("https://x.org:99/v1") == "Custom (x.org:99)"
