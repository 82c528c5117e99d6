import json
import os

import pytest

from claimloom.operators import resume as R
from claimloom.plans.standins import PARSER


def line(doc, task, reactant, product="b", yield_pct=None, **more):
    row = {"reactants": [{"label": reactant, "smiles": "R"}], "products": [{"label": product, "smiles": "P"}], "yield": yield_pct, "confidence": 0.9}
    return json.dumps({"document_id": doc, "task_id": task, "producer": {"kind": "human"}, "outputs": [row]} | more)


def wave(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))
    return str(folder)


TASKS = [(f"d{i}", f"t{k}", "text", [f"e{k}"]) for i in range(8) for k in range(2)] + [("d0", "s", "structure", ["img"])]


@pytest.fixture
def store(spark, tmp_path):
    tasks = spark.createDataFrame(TASKS, "document_id string, task_id string, kind string, evidence_ids array<string>")
    return R.start(spark, str(tmp_path / "store"), tasks, buckets=4)


def records(store):
    rows = R.open_store(store.spark, store.path).read("records")
    return sorted((r.document_id, r.sig_reactants[0], r.n_candidates, r.n_evidence, r.review_status) for r in rows.collect())


def modified(store, name):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, files in os.walk(f"{store.path}/{name}") for f in files if f.endswith(".parquet")}


def test_resume_touches_only_its_documents(spark, store, tmp_path):
    first = wave(tmp_path / "in", "a.jsonl", *[line(f"d{i}", f"t{k}", f"r{i % 3}") for i in range(1, 8) for k in range(2)], line("d0", "t0", "r9"))
    out = R.resume_documents(store, first, PARSER)
    assert out.parsed == 2 and [(r.status, r.applied, r.errors) for r in out.files.collect()] == [("applied", 15, 0)]
    assert records(store) == [(f"d{i}", f"r{i % 3}", 2, 2, "accepted") for i in range(1, 8)]  # d0 still waits
    state = {r.document_id: r for r in R.document_status(store).collect()}
    assert (state["d0"].awaiting, state["d0"].status, state["d1"].status) == (2, "awaiting_input", "success")

    before = {n: modified(store, n) for n in ("records", "candidates", "state", "evidence", "issues")}
    structure = json.dumps({"document_id": "d0", "task_id": "s", "producer": {"kind": "human"}, "outputs": [{"label": "r9", "smiles": "R"}]})
    wave(tmp_path / "in", "b.jsonl", line("d0", "t1", "r9"), structure)
    out = R.resume_documents(store, first, PARSER)
    assert out.parsed == 0 and len(out.buckets) == 1
    assert {r.file[-7:]: (r.status, r.applied) for r in out.files.collect()} == {"a.jsonl": ("duplicate", 0), "b.jsonl": ("applied", 2)}
    assert [(r.document_id, r.status) for r in out.documents.collect() if r.document_id == "d0"] == [("d0", "ready")]
    assert ("d0", "r9", 2, 2, "accepted") in records(store) and len(records(store)) == 8
    for name, files in before.items():
        left = {f for f, t in files.items() if f"bucket={out.buckets[0]}/" not in f and modified(store, name).get(f) == t}
        assert left == {f for f in files if f"bucket={out.buckets[0]}/" not in f}


def test_waves_equal_one_run(spark, store, tmp_path):
    lines = [line(d, t, f"r{n % 2}", yield_pct=n) for n, (d, t, kind, _) in enumerate(TASKS) if kind == "text"]
    tasks = store.read("tasks")
    once = R.start(spark, str(tmp_path / "once"), tasks, buckets=3)
    R.resume_documents(once, wave(tmp_path / "all", "x.jsonl", *lines), PARSER, wait=False)
    for k in range(3):
        R.resume_documents(store, wave(tmp_path / f"w{k}", "x.jsonl", *lines[k::3]), PARSER, wait=False)
    for name in ("records", "evidence", "issues", "candidates"):
        rows = [sorted(map(repr, s.read(name).drop("ord", "place", "first_candidate", "base_candidate").collect())) for s in (store, once)]
        assert rows[0] == rows[1] and rows[0] or name == "issues"


def test_conflicts_force_and_refused_files(spark, store, tmp_path):
    R.resume_documents(store, wave(tmp_path / "1", "a.jsonl", line("d1", "t0", "x"), line("d1", "t1", "x")), PARSER)
    folder = tmp_path / "2"
    wave(folder, "a.jsonl", line("d1", "t0", "y"), line("d1", "t1", "x"), line("d1", "zz", "x"))
    wave(folder, "broken.jsonl", line("d2", "t0", "x"), "{oops")
    wave(folder, "empty.jsonl", "  ")
    out = R.resume_documents(store, str(folder), PARSER)
    assert {r.file.rsplit("/", 1)[1]: (r.status, r.applied, r.repeated, r.conflicts, r.errors) for r in out.files.collect()} == {
        "a.jsonl": ("applied", 0, 1, 1, 1), "broken.jsonl": ("refused", 0, 0, 0, 0), "empty.jsonl": ("refused", 0, 0, 0, 0)}
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.error) for r in out.errors.collect())[0] == ("broken.jsonl", 2, "invalid JSON")
    assert {(r.task_id, r.line, r.result) for r in out.statuses.collect()} == {("t0", 1, "conflict"), ("t1", 2, "no-op"), ("zz", 3, "error: unknown task")}
    assert out.buckets == [] and records(store) == [("d1", "x", 2, 2, "accepted")]
    out = R.resume_documents(store, wave(tmp_path / "3", "a.jsonl", line("d1", "t0", "z")), PARSER, force=True)
    assert [r.result for r in out.statuses.collect()] == ["superseded"]
    assert records(store) == [("d1", "x", 1, 1, "accepted"), ("d1", "z", 1, 1, "accepted")]
    assert R.resume_documents(store, str(folder / "a.jsonl"), PARSER).files.first().status == "duplicate"


def test_a_resume_that_died_is_run_again(spark, store, tmp_path, monkeypatch):
    folder = wave(tmp_path / "1", "a.jsonl", line("d1", "t0", "x"), line("d1", "t1", "x"))
    write = R.Store.write

    def dies(self, name, *args, **more):
        if name == "state":
            raise OSError("lost")
        write(self, name, *args, **more)

    monkeypatch.setattr(R.Store, "write", dies)
    with pytest.raises(OSError):
        R.resume_documents(store, folder, PARSER)
    monkeypatch.undo()
    out = R.resume_documents(store, folder, PARSER)
    assert [r.applied for r in out.files.collect()] == [2] and out.parsed == 0
    assert records(store) == [("d1", "x", 2, 2, "accepted")] and store.read("candidates").count() == 2


def test_only_named_buckets_are_read(store):
    plan = store.read("tasks", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert {r.status for r in R.document_status(store).collect()} == {"awaiting_input"}
