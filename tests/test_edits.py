from pyspark.sql import functions as F

from claimloom.operators import corrections as E, review as W
from claimloom.operators.review import with_record_hash
from claimloom.plans.standins import PARSER
from claimloom.schemas import DECISION, RECORD

EDIT = "package_id string, document_id string, ord bigint, reaction_id string, path string, value string, confirmed_by string"
OP = "package_id string, document_id string, ord bigint, reaction_id string, target_kind string, target_id string, op string, path string, value string, reason string"
SUB = "package_id string, reviewer string, confirmed_by string"


def record(rid, status="accepted", smiles="CC", issues=()):
    return ("d", "1.0", rid, [("A", None, smiles, "reactant")], [("B", None, "CCO", "product")], ["x"], ["y"], 25.0, "2 h", 80.0, ["e1"], 0.9, status, list(issues))


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def test_last_value_wins_null_is_a_value_and_errors_refuse_the_package(spark):
    r = records(spark, record("r1"), record("r2"), record("r3", "rejected"))
    edits = spark.createDataFrame([
        ("p1", "d", 1, "r1", "yield_pct", "70", "ann"), ("p1", "d", 2, "r1", "yield_pct", "null", "ann"),
        ("p1", "d", 3, "r1", "reagents.0", '"z"', "ann"), ("p1", "d", 4, "r1", "reactants.0.smiles", '"bad(q"', "ann"),
        ("p1", "d", 5, "r3", "time", '"3 h"', "ann"),
        ("p2", "d", 6, "r2", "time", '"9 h"', "ann"), ("p2", "d", 7, "r2", "reactants.5.smiles", '"C"', "ann"),
        ("p3", "d", 8, "r2", "reaction_id", '"C"', "ann"), ("p4", "d", 9, "nope", "time", '"C"', "ann"), ("p5", "d", 10, "r2", "time", '"C"', " "),
        ("p6", "d", 11, "r2", "reactants.-1.smiles", '"C"', "ann"),
    ], EDIT)
    changed, audit, errors = E.apply_corrections(r, edits, PARSER)
    rows = {x.reaction_id: x for x in changed.collect()}
    assert set(rows) == {"r1", "r3"}
    assert rows["r1"].yield_pct is None and rows["r1"].reagents == ["z"] and rows["r1"].review_status == "needs_review"
    assert [i.code for i in rows["r1"].issues] == ["R001_INVALID_SMILES"]
    assert rows["r3"].review_status == "rejected" and rows["r3"].time == "3 h"
    assert {x.package_id: x.error for x in errors.collect()} == {
        "p2": "index out of range", "p3": "path is not editable", "p4": "unknown reaction",
        "p5": "confirmed_by must be a non-empty string", "p6": "index out of range",
    }
    a = {x.reaction_id: x for x in audit.collect()}
    assert a["r1"].paths == ["yield_pct", "reagents.0", "reactants.0.smiles"] and a["r1"].operations_count == 4 and a["r1"].issues_added == 1
    assert E.effective_records(r, changed).count() == 3


def test_whole_list_then_element(spark):
    edits = spark.createDataFrame([
        ("p", "d", 1, "r1", "reactants.0.label", '"lost"', "ann"), ("p", "d", 2, "r1", "reactants", '[{"label":"N1"},{"label":"N2"}]', "ann"),
        ("p", "d", 3, "r1", "reactants.1.smiles", '"cc"', "ann"),
    ], EDIT)
    changed, _, errors = E.apply_corrections(records(spark, record("r1")), edits, PARSER)
    row = changed.first()
    assert errors.count() == 0
    assert [(c.label, c.smiles) for c in row.reactants] == [("N1", None), ("N2", "CC")]


def op(n, rid, name, kind="reaction", target=None, path=None, value=None, reason=None, package="p"):
    return (package, "d", n, rid, kind, target or rid, name, path, value, reason)


def test_operations_replay_in_order(spark):
    r = records(spark, record("r1", "needs_review"), record("r2", "needs_review"), record("r3", "rejected"))
    ops = spark.createDataFrame([
        op(1, "r1", "add_participant", value='{"label":"C","role":"reactant"}'), op(2, "r1", "set_value", path="reactants.1.smiles", value='"n"'),
        op(3, "r1", "remove_participant", target="A"), op(4, "r1", "confirm"),
        op(5, "r2", "mark_pending", reason="why"), op(6, "r3", "confirm"),
        op(7, "r2", "remove_participant", target="A", package="q"), op(8, "r2", "set_value", path="reactants.0.smiles", value='"n"', package="q"),
        op(9, "r2", "confirm", package="u"),
    ], OP)
    subs = spark.createDataFrame([("p", "ann", "ann"), ("q", "ann", "ann"), ("u", "ann", "bob")], SUB)
    changed, audit, errors = E.apply_operations(r, ops.filter("package_id <> 'q'"), subs, PARSER)
    rows = {x.reaction_id: x for x in changed.collect()}
    assert [(c.label, c.smiles) for c in rows["r1"].reactants] == [("C", "N")]
    assert rows["r1"].review_status == "accepted" and rows["r2"].review_status == "needs_review" and rows["r3"].review_status == "rejected"
    assert {x.package_id for x in errors.collect()} == {"u"}
    _, _, replay = E.apply_operations(r, ops.filter("package_id = 'q'"), subs.filter("package_id = 'q'"), PARSER)
    assert [x.error for x in replay.collect()] == ["index out of range"]


def test_audit_tells_time_and_voided_decisions(spark):
    r = records(spark, record("r1", "needs_review"), record("r2", "needs_review"))
    same = with_record_hash(r).filter("reaction_id = 'r2'").first().record_hash
    made = [decision(1, "condition", "confirmed"), decision(2, "reaction", "rejected"), decision(3, "completeness", "confirmed")]
    made = spark.createDataFrame(made + [("d", 4, "d4", "r2", "condition", "r2", "confirmed", "r", "ann", same, "t")], DECISION)
    ops = spark.createDataFrame([op(1, "r1", "set_value", path="time", value='"9 h"'), op(2, "r2", "confirm")], OP)
    subs = spark.createDataFrame([("p", "ann", "ann")], SUB)
    _, audit, _ = E.apply_operations(r, ops, subs, PARSER, decisions=made, at="2024-01-01T00:00:00Z")
    assert {(a.reaction_id, a.invalidated_decisions, a.confirmed_at) for a in audit.collect()} == {("r1", 2, "2024-01-01T00:00:00Z"), ("r2", 1, "2024-01-01T00:00:00Z")}
    _, audit, _ = E.apply_operations(r, ops, subs, PARSER)
    assert all(a.invalidated_decisions == 0 and a.confirmed_at.endswith("Z") for a in audit.collect())


def test_package_errors_inside_a_batch(spark):
    r = records(spark, record("r1", "needs_review"), record("r2", "needs_review"))
    ops = spark.createDataFrame([
        op(1, "r1", "confirm"), op(2, "r1", "confirm", package="q"), op(3, "r9", "confirm", package="u"), op(4, "r2", "confirm", package="v"),
    ], OP)
    subs = spark.createDataFrame([(p, "ann", "ann") for p in "pquvv"], SUB)
    hashes = with_record_hash(r).select(F.lit("p").alias("package_id"), "document_id", "reaction_id", "record_hash")
    changed, _, errors = E.apply_operations(r, ops, subs, PARSER, base_hashes=hashes)
    assert [x.reaction_id for x in changed.collect()] == ["r1"]
    assert {(x.package_id, x.error) for x in errors.collect()} == {
        ("q", "version conflict"), ("u", "unknown reaction"), ("v", "duplicate submission"),
    }


def decision(n, kind, conclusion, target="r1", record_hash="h"):
    return ("d", n, f"d{n}", "r1", kind, target, conclusion, "r", "ann", record_hash, "t")


def status(spark, *rows, gold=None):
    found = W.human_status(spark.createDataFrame(list(rows), DECISION), gold).first()
    return found.human_status


def test_human_status_ladder(spark):
    done = [decision(1, "reaction", "confirmed"), decision(2, "completeness", "not_applicable")]
    assert status(spark, *done) == "confirmed"
    assert status(spark, done[0]) == "in_review"
    assert status(spark, *done, decision(3, "condition", "pending", "c1")) == "pending"
    assert status(spark, *done, decision(3, "condition", "pending", "c1"), decision(4, "condition", "revised", "c1")) == "confirmed"
    assert status(spark, *done, decision(3, "stereo", "rejected", "x"), decision(4, "stereo", "confirmed", "x")) == "rejected"
    gold = spark.createDataFrame([("d", "r1")], "document_id string, reaction_id string")
    assert status(spark, *done, gold=gold) == "in_review"
    assert status(spark, *done, decision(3, "gold_alignment", "confirmed"), gold=gold) == "confirmed"
    assert status(spark, *done, decision(3, "gold_alignment", "pending")) == "confirmed"


def test_rejection_is_never_stale(spark):
    rows = [decision(1, "stereo", "rejected", record_hash="old"), decision(2, "reaction", "confirmed", record_hash="old")]
    dec = spark.createDataFrame(rows, DECISION)
    ops = spark.createDataFrame([], "document_id string, reaction_id string, op string, target_kind string")
    now = spark.createDataFrame([("d", "r1", "new")], "document_id string, reaction_id string, record_hash string")
    assert [x.decision_id for x in E.stale_decisions(dec, ops, now).collect()] == ["d2"]
