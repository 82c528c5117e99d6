import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from claimloom.operators import run as X
from claimloom.operators.fulfil import fulfil_tasks
from claimloom.plans.standins import PARSER

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(task):
    if task["kind"] == "structure":
        return '{"structures":[{"label":"7","smiles":"cc"},{"label":"8","smiles":"cco"}]}'
    if "page 2" in task["instructions"]:
        return "no idea"
    if "broken" in task["instructions"]:
        raise ValueError("broken")
    return '```json\n{"reactions":[{"substrates":"7","product":"8","yield":"80%","confidence":0.9}]}\n```'


def test_documents_to_records(spark):
    documents = spark.createDataFrame(
        [("d1", "## Page 1\n7 gives 8\n## Page 2\nnothing"), ("d2", "broken"), ("d3", "  "), ("d4", None)], "document_id string, markdown string"
    )
    images = spark.createDataFrame([("d1", "img/1.png")], "document_id string, path string")
    run = X.run_documents(documents, lambda tasks: fulfil_tasks(tasks, answer), PARSER, images=images)
    assert {(r.document_id, r.kind) for r in run.tasks.collect()} == {("d1", "text"), ("d1", "structure"), ("d2", "text")}
    assert run.answers.filter(F.col("error").isNotNull()).count() == 1
    record = run.assembly.records.collect()
    assert [(r.document_id, r.yield_pct, r.n_resolved, r.n_evidence) for r in record] == [("d1", 80.0, 2, 1)]
    assert {(r.document_id, r.records_count, r.status) for r in run.status.collect()} == {
        ("d1", 1, "success" if record[0].review_status == "accepted" else "partial"),
        ("d2", 0, "completed_empty"), ("d3", 0, "completed_empty"), ("d4", 0, "completed_empty"),
    }
    assert [r.reaction_id for r in X.contexts(run).collect()] == [record[0].reaction_id]
    assert run.issues.filter("severity = 'error'").count() == 0
