import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import variants as V
from claimloom.operators import constraints as C, contract as K
from claimloom.sources import lines as L

GOOD = {
    "compound": {"label": 7, "role": "product"},
    "issue": {"code": "R1", "severity": "error", "target_id": "x", "message": "m", "suggested_value": None},
    "reaction_candidate": {"candidate_id": "c", "source": "table", "reactants": [{"label": "a"}], "temperature_c": "25.5", "yield_pct": 100},
    "structure_candidate": {"candidate_id": "c", "smiles": "C", "confidence": 0},
    "record": {"reaction_id": "r", "confidence": 1, "review_status": "accepted", "issues": [{"code": "R1", "severity": "info", "target_id": "x", "message": "m"}]},
    "participant": {"participant_id": "p", "role": "ligand", "structure_state": "resolved"},
    "condition": {"condition_id": "c", "kind": "ee", "stage_index": 2, "numeric_value": None},
    "context": {"reaction_id": "r", "record_hash": "h", "participants": [{"participant_id": "p", "role": "solvent"}], "stage_count": 0},
    "decision": {"decision_id": "d", "reaction_id": "r", "target_kind": "stereo", "target_id": "t", "conclusion": "confirmed", "reviewer": "me", "record_hash": "h", "created_at": "now"},
    "operation": {"reaction_id": "r", "target_kind": "reaction", "target_id": "t", "op": "set_value", "new_value": [1]},
    "package": {"submission_id": "s", "reviewer": "me", "created_at": "now", "operations": [{"reaction_id": "r", "target_kind": "reaction", "target_id": "t", "op": "confirm"}]},
}
BAD = [
    ("compound", {"role": None}, ["role not allowed"]),
    ("issue", {"severity": "fatal", "code": 5}, ["code must be a string", "severity not allowed"]),
    ("reaction_candidate", {"source": "page", "temperature_c": "25 °C", "reactants": ["a", {"role": "x"}], "reagents": ["Pd", 3]},
     ["reactants[0] must be an object", "reactants[1].role not allowed", "reagents[1] must be a string", "source not allowed", "temperature_c must be a number"]),
    ("structure_candidate", {"smiles": "  ", "confidence": 1.5}, ["confidence outside 0..1", "smiles must be non-empty"]),
    ("record", {"time": 5, "yield_pct": -1, "issues": [{"code": "R1", "severity": "bad", "target_id": "x", "message": "m", "n": 1}], "schema_version": "2", "reagents": None},
     ["issues[0] has unknown fields n", "issues[0].severity not allowed", "reagents must be an array", "schema_version must be 1.0", "time must be a string", "yield_pct outside 0..100"]),
    ("participant", {"role": "enzyme", "candidate_ids": "x"}, ["candidate_ids must be an array", "role not allowed"]),
    ("condition", {"stage_index": 1.5, "numeric_value": "hot"}, ["numeric_value must be a number", "stage_index must be a whole number"]),
    ("context", {"stage_count": -1, "conditions": [{}]}, ["conditions[0].condition_id must be a string", "conditions[0].kind not allowed", "stage_count below 0"]),
    ("decision", {"conclusion": "pending", "reviewer": " ", "note": 1}, ["reason is required", "reviewer must be non-empty", "unknown fields note"]),
    ("operation", {"op": "erase", "target_kind": None}, ["op not allowed", "target_kind not allowed"]),
    ("package", {"operations": [{"op": "confirm"}], "created_at": None},
     ["created_at must be a string", "operations[0].reaction_id must be a string", "operations[0].target_id must be a string", "operations[0].target_kind not allowed"]),
]


def errors(spark, layout, row):
    table = spark.createDataFrame([(json.dumps(row),)], "t string").select(V.parse_strict("t").alias("v"))
    return sorted(table.select(F.flatten(F.transform(F.array("v"), lambda v: C.line_errors(v, layout))).alias("e")).first().e)


@pytest.mark.parametrize("layout", sorted(C.LAYOUTS))
def test_good_rows_pass(spark, layout):
    assert errors(spark, layout, GOOD[layout]) == []


@pytest.mark.parametrize("layout, changes, want", BAD, ids=[b[0] for b in BAD])
def test_each_fault_is_named(spark, layout, changes, want):
    assert errors(spark, layout, GOOD[layout] | changes) == want


def test_missing_values_and_other_values(spark):
    assert errors(spark, "record", {}) == ["confidence outside 0..1", "reaction_id must be a string", "review_status not allowed"]
    assert errors(spark, "record", [1]) == ["expected JSON object"]
    assert {b[0] for b in BAD} == set(C.LAYOUTS)


def test_typed_rows(spark):
    rows = spark.createDataFrame(
        [("d", "r1", 120.0, 0.5, "accepted", [("R", "error", "t", "m"), ("R", "bad", None, "m")]), ("d", "r2", None, None, "x", None), ("d", "r3", 5.0, 1.0, "rejected", [])],
        "document_id string, reaction_id string, yield_pct double, confidence double, review_status string, issues array<struct<code:string,severity:string,target_id:string,message:string>>",
    )
    got = sorted((r.reaction_id, r.error) for r in K.record_domain_checks(rows).collect())
    assert got == [("r1", "issues[1].severity not allowed"), ("r1", "issues[1].target_id must be a string"), ("r1", "yield_pct outside 0..100"),
                   ("r2", "confidence outside 0..1"), ("r2", "issues must be an array"), ("r2", "review_status not allowed")]


def test_benchmark_lines_with_wrong_values_are_refused(spark):
    line = lambda **more: json.dumps(GOOD["record"] | more)
    rows = [(1, line()), (2, line(temperature_c="25 °C")), (3, line(reactants=["a"])), (4, line(temperature_c="25")), (5, line(time=3)), (6, line(issues=[{}]))]
    good, bad = L.gold_rows(spark.createDataFrame([("f", *r) for r in rows], "file string, line long, value string"))
    assert {r.line: r.temperature_c for r in good.collect()} == {1: None, 4: 25.0}
    assert {r.line for r in bad.collect()} == {2, 3, 5, 6}
