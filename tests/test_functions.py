import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import keys as K
from weftline.functions import measures as M
from weftline.functions import relations as R
from weftline.functions import templates as T
from weftline.functions import text as X
from weftline.functions import verdicts as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("text", "wanted"), [
    ("True", True), ('"No."', False), ("**yes**", True), ('{"answer": false}', False), ('{"answer": "Yes"}', True), ('{"answer": true, "why": 1}', True), ("true", True), ("false", False),
    ("They are not the same, so false", False), ("It is not true", False), ("This cannot be false", True), ("not identical - False", False), ("no, not true", False), ("true/false", None), ("", None), (None, None), ("perhaps", None), ("Yes. But really no", False), ("isn't true", False),
])
def test_parse_answer(spark, text, wanted):
    got = one(spark, V.parse_answer(F.lit(text).cast("string")))
    assert got["verdict"] is wanted
    assert (got["reason"] is None) == (wanted is not None)


def test_json_needs_one_key(spark):
    assert one(spark, V.json_verdict(F.lit('{"answer": true, "why": 1}'))) is None
    assert one(spark, V.json_verdict(F.lit("[true]"))) is None


@pytest.mark.parametrize("value", [0.1, 1.0, 12345678.9, 1e-5, 1e7, 1.5e20, 0.00012, 123456789012345680.0, -2.5e-7, 1e16, 9999999.0, 1e-4, 0.0])
def test_numbers_as_python_writes_them(spark, value):
    assert one(spark, V.render_number(F.lit(value))) == repr(value)


def test_first_min_of_nan(spark):
    nan = float("nan")
    assert one(spark, V.first_min(F.lit(0.5), F.lit(nan))) == 0.5
    assert one(spark, F.isnan(V.first_min(F.lit(nan), F.lit(0.5)))) is True
    assert one(spark, V.sum_known(F.lit(None).cast("int"), F.lit(2))) == 2


def test_logprobs(spark):
    schema = "array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>"
    df = spark.createDataFrame([([("{", 0.0, []), (" True", -0.1, [("true", -0.05), ("false", -3.0)])],)], f"t {schema}")
    row = df.select(V.logprob_confidence(F.col("t"), F.lit(True)).alias("a"), V.logprob_confidence(F.col("t"), F.lit(False)).alias("b"), V.logprob_confidence(F.slice("t", 1, 1), F.lit(True)).alias("c")).head()
    assert row["a"] == pytest.approx(math.exp(-0.05)) and row["b"] == pytest.approx(math.exp(-3)) and row["c"] != row["c"]


def test_printed(spark):
    tp, fp, fn = F.lit(1276), F.lit(49), F.lit(240)
    got = {k: one(spark, v) for k, v in M.printed(tp, fp, fn).items()}
    assert got == {"precision": 0.963, "recall": 0.842, "f1": 0.898}
    assert one(spark, M.prf(tp, fp, fn)["f1"]) == pytest.approx(0.898275, abs=1e-6)


def test_canonical_cell(spark):
    assert tuple(one(spark, R.canonical_cell(F.lit("b"), F.lit("a"), F.lit("<")))) == ("a", "b", ">")
    assert tuple(one(spark, R.canonical_cell(F.lit("a"), F.lit("a"), F.lit(">")))) == ("a", "a", "<")
    assert one(spark, R.normalise_relation(F.lit(None).cast("string"))) == "="
    with pytest.raises(Exception, match="unknown relation code 9"):
        one(spark, R.relation_of_code(F.lit(9)))


def test_lanes(spark):
    assert one(spark, R.pair_lane(F.lit(" oprop "), F.lit("CLS"), F.lit("CLS"))) == "OPROP"
    assert one(spark, R.pair_lane(F.lit(None).cast("string"), F.lit("CLS"), F.lit("INST"))) == "INST"


def test_retry_and_duration(spark):
    import hashlib

    part = int.from_bytes(hashlib.sha256(b"3:k:2").digest()[:8], "big") / 2**64
    assert one(spark, K.retry_delay(F.lit("k"), F.lit(2), F.lit(3))) == pytest.approx(1.0 * (1 + part / 4))
    assert one(spark, K.duration(F.lit(3723.0))) == "1h 2m 3s"
    assert one(spark, K.token_estimate(F.lit("abcde"))) == 2


def test_verbalised(spark):
    said = lambda a, b: one(spark, X.verbalised(F.lit(a), F.lit(b)))
    assert said("birthDate", "1990-01-02") == "who was born on 1990-01-02"
    assert said("hasPart", "x") == 'which has part "x"'
    assert said("home_world", "Tatooine") == 'whose home world is "Tatooine"'
    assert said("year", "long ago") == 'whose year is "long ago"'


PROPERTY = "struct<names:array<string>,own_name:string,synonyms:array<string>,domain:array<string>,range:array<string>,domain_synonyms:array<string>,range_synonyms:array<string>,is_data:boolean,characteristics:array<string>,inverse:string>"
INSTANCE = f"struct<names:array<string>,uri:string,types:array<string>,data:{X.PROPERTY},object:{X.PROPERTY}>"


def rendered(spark, name, kind, source, target, context=None):
    df = spark.createDataFrame([(source, target)], f"s {kind}, t {kind}")
    return df.select(T.question(name, F.col("s"), F.col("t"), context).alias("q")).head()["q"].split("\n")


def test_property_templates(spark):
    s = (["writes"], "w", ["authors"], ["Person"], ["Paper"], ["Human"], [], False, ["functional"], "written by")
    t = ([], "birthDate", [], ["Person"], ["date"], [], [], True, [], None)
    got = rendered(spark, "prop_domain_range", PROPERTY, s, t)
    assert got[1:3] == ['The first property is "writes" which connects "Person" to "Paper".', 'The second property is "birthDate" on "Person" which has data values of type "date".']
    assert rendered(spark, "prop_domain_range_synonyms", PROPERTY, s, t)[1] == 'The first property is "writes" (also known as "authors") which connects "Person" (also known as "Human") to "Paper"'
    assert rendered(spark, "prop_with_inverse_and_chars", PROPERTY, s, t)[1] == 'The first property is "writes" which connects "Person" to "Paper". It is a functional property and the inverse of "written by".'
    assert rendered(spark, "prop_labels_only", PROPERTY, s, t)[2] == 'The second property is "birthDate".'


def prop(label, value=None, datatype=None, other=None):
    return (label, f"u#{label}", value, datatype, None, other, None)


def test_instance_templates(spark):
    s = (["Luke"], "u1", ["Person"], [prop("height", "172", "integer"), prop("eye", "blue"), prop("eye", "red")], [prop("home", other="Tatooine")])
    t = (["Luke S."], "u2", ["Person", "Pilot"], [prop("eye", "red"), prop("mass", "77", "int")], [prop("Home", other="Tatooine")])
    assert rendered(spark, "inst_labels_only", INSTANCE, s, t)[1:3] == ['The first is "Luke".', 'The second is "Luke S."']
    got = rendered(spark, "inst_types_and_attributes", INSTANCE, s, t)
    assert got[1] == 'The first is "Luke", which is a "Person" and is "eye" "red" and is "home" "Tatooine" and is "height" 172.'
    assert got[2] == 'The second is "Luke S.", which is a "Person" and a "Pilot" and is "eye" "red" and is "Home" "Tatooine" and is "mass" 77.'
    got = rendered(spark, "inst_full_context_intersect", INSTANCE, s, t)
    assert got[1] == 'The first is "Luke", which is a "Person" and has attributes: is "eye" "red" and has relationships: is "home" "Tatooine".'
    entropies = F.create_map(F.lit("u#home"), F.lit(5.0))
    got = rendered(spark, "inst_types_and_attributes_entropy", INSTANCE, s, t, T.Context(entropies=entropies, domain="film", response_mode="plain"))
    assert got[0] == "We have two entities from different film ontologies."
    assert got[1] == 'The first is "Luke", which is a "Person" and is "home" "Tatooine" and is "eye" "red".'
    assert got[3] == 'Do these refer to the same entity? Respond with "True" or "False".'


def test_all_templates_are_there():
    kinds = [s.kind for s in T.REGISTRY.values()]
    assert len(kinds) == 39 and kinds.count("OPROP") == 4 and kinds.count("INST") == 8
    assert sum(s.bidirectional for s in T.REGISTRY.values()) == 5 and sum(s.siblings for s in T.REGISTRY.values()) == 3
    with pytest.raises(KeyError):
        T.question("no such", None, None)
    with pytest.raises(ValueError, match="unknown answer format"):
        T.Context(answer_format="maybe")
    assert T.system_prompt("generic").endswith('{"answer": false}.') and T.system_prompt("eacl_intuitive_nl_judgement").endswith("Be precise")
