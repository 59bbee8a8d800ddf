"""Published counts of the small convention and biomedical fixtures."""

import pytest

from weftline.operators import alignment as A
from weftline.operators import scoring as S

A_, B_ = "http://example.org/a#", "http://example.org/b#"


def cell(s, t, r="="):
    full = lambda x: (A_ if x[0] == "a" else B_) + x[1:]
    return full(s), full(t), r


SYSTEM = [cell("a1", "b1"), cell("a2", "b2", "<"), cell("a3", "b3"), cell("b4", "a4", "<"), cell("a5", "b5"), cell("a7", "b7"), cell("a8", "b8"), cell("a10", "b10"), cell("a11", "b11"), cell("a12", "b12", ">"), cell("a1", "b1"), cell("a13", "b13", "?")]
FULL = [cell("a1", "b1"), cell("a2", "b2"), cell("a3", "b3", "<"), cell("a4", "b4", ">"), cell("a5", "b5", "?"), cell("a6", "b6", "?"), cell("b7", "a7"), cell("a8", "b8"), cell("a9", "b9"), cell("a10", "b10")]
PLAIN = [cell("a1", "b1"), cell("a2", "b2"), cell("b7", "a7"), cell("a8", "b8"), cell("a9", "b9"), cell("a10", "b10")]
SPLIT = [("a1", "b1", "test"), ("a9", "b9", "test"), ("a10", "b10", "test"), ("b7", "a7", "test"), ("a5", "b5", "test"), ("a2", "b2", "train"), ("a8", "b8", "valid")]
CELL = "source string, target string, relation string"


@pytest.fixture(scope="module")
def frames(spark):
    f = {k: spark.createDataFrame(v, CELL) for k, v in (("system", SYSTEM), ("full", FULL), ("plain", PLAIN))}
    f["split"] = spark.createDataFrame([(*cell(s, t)[:2], x) for s, t, x in SPLIT], "source string, target string, split string")
    f["train"] = spark.createDataFrame([cell("a8", "b8")], CELL)
    return f


def counts(df):
    r = df.head()
    return r["tp"], r["fp"], r["fn"]


def test_relation_aware(frames):
    r = S.relation_aware(frames["system"], frames["full"]).head()
    assert (r["tp"], r["fp"], r["fn"], r["system_cells"], r["reference_cells"], r["discounted"], r["wrong_relation"]) == (5, 5, 3, 11, 10, 1, 2)
    assert (r["printed_precision"], r["printed_recall"], r["printed_f1"]) == (0.5, 0.625, 0.556)


def test_plain_and_conventions(frames):
    assert counts(S.plain(frames["system"], frames["plain"])) == (4, 7, 2) or counts(S.plain(A.pairs(frames["system"], True), frames["plain"])) == (4, 7, 2)
    r = S.coherence_aware(frames["system"], frames["full"]).head()
    assert (r["tp"], r["fp"], r["fn"], r["predicted_flagged"]) == (5, 4, 3, 1)
    assert counts(S.all_cells(frames["system"], frames["full"])) == (6, 4, 4)


def test_null_reference(frames):
    assert counts(S.null_reference(frames["system"], frames["plain"], frames["train"])) == (3, 7, 2)


def test_ignored(spark, frames):
    kept = A.without_iris(frames["system"], spark.createDataFrame([(B_ + "10",)], "iri string"))
    assert kept.count() == 11
    assert counts(S.plain(kept, frames["plain"])) == (3, 7, 3)


def test_masked_split(frames):
    test, masked = frames["split"].where("split = 'test'"), frames["split"].where("split <> 'test'")
    r = S.masked_split(frames["system"], A.pairs(frames["full"].where("relation = '='")), test, masked).head()
    assert (r["tp"], r["fp"], r["fn"], r["masked_removed"]) == (2, 7, 2, 2)
    r = S.masked_split(A.pairs(frames["system"], True), A.pairs(frames["full"]), test, masked, A.flagged_pairs(frames["full"])).head()
    assert (r["tp"], r["fn"]) == (2, 2)


def bio(n, m, x="="):
    return f"http://example.org/src#S{n}", f"http://example.org/tgt#T{m}", x


@pytest.fixture(scope="module")
def biomedical(spark):
    make = lambda rows: spark.createDataFrame(rows, CELL)
    return {
        "system": make([bio(1, 1), bio(2, 2), bio(3, 3), bio(5, 5), bio(6, 6), bio(4, 1), bio(3, 4)]),
        "full": make([bio(i, i) for i in range(1, 5)]),
        "repaired": make([bio(1, 1), bio(2, 2), bio(3, 3, "?"), bio(4, 4)]),
        "train": make([bio(1, 1)]),
        "ignored": spark.createDataFrame([("http://example.org/src#S5",), ("http://example.org/tgt#T6",)], "iri string"),
        "deprecated": spark.createDataFrame([("http://example.org/tgt#T5",)], "iri string"),
        "split": spark.createDataFrame([(*bio(1, 1)[:2], "train"), (*bio(2, 2)[:2], "valid"), (*bio(3, 3)[:2], "test"), (*bio(4, 4)[:2], "test")], "source string, target string, split string"),
    }


@pytest.mark.parametrize(("edition", "wanted"), [(2022, {"unsupervised": (3, 4, 1), "semi_supervised": (2, 4, 1)}), (2025, {"unsupervised": (3, 2, 1), "semi_supervised": (2, 2, 1)}), (2026, {"standard": (3, 3, 1), "repaired": (2, 3, 1), "codabench_standard": (1, 3, 1), "codabench_repaired": (0, 3, 1)})])
def test_editions(biomedical, edition, wanted):
    b = biomedical
    ignored = b["deprecated"] if edition >= 2026 else b["ignored"] if edition >= 2023 else None
    rows = S.edition_views(b["system"], b["full"], edition, b["train"], ignored, b["repaired"], b["split"]).collect()
    assert {r["view"]: (r["tp"], r["fp"], r["fn"]) for r in rows} == wanted
    if edition == 2026:
        assert next(r for r in rows if r["view"] == "codabench_repaired")["f1"] is None


def test_undefined_ratios_are_null_with_a_reason(spark, frames):
    empty = spark.createDataFrame([], CELL)
    r = S.plain(empty, frames["plain"]).head()
    assert r["precision"] is None and r["recall"] == 0.0 and "precision" in r["metric_notes"]
    r = S.partial(frames["system"], empty).head()
    assert (r["tp"], r["fp"], r["fn"], r["ignored"]) == (0, 0, 0, 11)


def test_oracle_errors_before_scope(spark):
    ref = spark.createDataFrame([("a", "b", "=")], CELL)
    said = spark.createDataFrame([("a", "b", True), ("a", "x", False), ("p", "q", True), ("p", "r", None), ("a", "y", True)], "source string, target string, verdict boolean")
    r = S.oracle(said, ref, True).head()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["errors"], r["partial_scope_excluded"], r["oracle_excluded"]) == (1, 1, 0, 1, 1, 1, 2)
    r = S.oracle(said.where("verdict IS NULL"), ref).head()
    assert r["oracle_precision"] == 0.0 and r["sensitivity"] is None


def test_strata_conserve_counts(frames):
    lane = lambda df: df.select("source", "target").distinct().selectExpr("source", "target", "CASE WHEN source LIKE '%1%' THEN 'class' ELSE 'property' END AS lane")
    rows = S.strata(lane(frames["system"]), lane(frames["plain"]), ["class", "property", "instance"])
    assert S.reconcile(rows, S.plain(frames["system"], frames["plain"]), ["tp", "fp", "fn"]).count() == 0
    assert {r["lane"] for r in rows.collect()} == {"class", "property", "instance"}


def test_payload_rules(frames):
    block = S.plain(frames["system"], frames["plain"])
    assert S.payload_violations(block).count() == 0
    assert S.payload_violations(block.selectExpr("tp", "fp", "fn", "precision + 0.1 AS precision", "recall", "f1", "metric_notes")).count() == 1
