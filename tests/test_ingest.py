import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from claimloom.functions import text as X, variants as V
from claimloom.functions.text import plain_number
from claimloom.operators import answers as N, fulfil as U, pages as D, tasks as J
from claimloom.sources import files as S, lines as L, sinks as O
from claimloom.schemas import EVIDENCE

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_text_normalisers(spark):
    assert one(spark, " A b C\x1d", X.normalize_label("t")) == "abc"
    assert one(spark, "  \x1f", X.blank_to_null("t")) is None
    assert one(spark, " Pd(OAc)2; PPh3 ,, x", X.split_list("t")) == ["Pd(OAc)2", "PPh3", "x"]
    assert one(spark, "about -1,200.5 g", X.number_in_text("t")) == -1200.5
    assert one(spark, "CC.CNC.OOO", X.skeleton("t")) == "CNC"


@pytest.mark.parametrize("text,good", [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}] x', False), ("", False), ("[1", False), ('"x"', True)])
def test_strict_parsing(spark, text, good):
    assert (one(spark, text, V.parse_strict("t")) is not None) == good


def test_payload_becomes_candidate(spark):
    text = '{"reactions":[{"substrates":["7"],"products":[{"label":"8"}],"reagents":"Pd(OAc)2; PPh3","solvent":"THF","temperature":"25 °C","yield":"83%","confidence":0.9},{"reactants":null,"confidence":2},5]}'
    df = spark.createDataFrame([(text,)], "answer string")
    df = N.parse_model_answers(df).select("payload", F.lit("text").alias("source"), F.array(F.lit("b"), F.lit("a"), F.lit("a")).alias("evidence_ids"))
    rows = N.reaction_candidates(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.yield_pct == 83 and r.temperature_c == 25 and r.reagents == ["Pd(OAc)2", "PPh3"] and r.solvents == ["THF"]
    assert r.evidence_ids == ["a", "b"] and r.reactants[0].label == "7" and r.time is None


@pytest.mark.parametrize("text,want", [
    ('```json\n{"a": 1}\n```', '{"a":1}'), ('<think>{"no":1}</think> {"a": 1}', '{"a":1}'), ('Result: {"a": "}"} done', '{"a":"}"}'),
    ("say [1, 2] now", "[1,2]"), ('{"a": 1', None), ("nothing", None), ("12", "12"),
])
def test_answers(spark, text, want):
    df = N.parse_model_answers(spark.createDataFrame([(text,)], "answer string"))
    row = df.select(F.to_json("payload").alias("p"), "error").first()
    assert row.p == want and (row.error is None) == (want is not None)


def test_tables_and_pages(spark):
    md = "before\n| A | B |\n|---|---|\n| 1 | 2 |\nafter\n| a | b |\n| c | d |\n"
    df = spark.createDataFrame([("d", md), ("p", "lost\n## Page 1\nx\n##  Page 2\n y \n"), ("e", " \n")], "document_id string, markdown string")
    assert [r.text for r in D.markdown_tables(df).collect()] == ["| A | B |\n|---|---|\n| 1 | 2 |"]
    pages = [(r.document_id, r.evidence_id, r.text) for r in D.split_pages(df).collect()]
    assert pages == [("d", "text-document", md), ("p", "text-p1", "## Page 1\nx"), ("p", "text-p2", "##  Page 2\n y")]


def test_prompts(spark):
    with pytest.raises(ValueError):
        J.render_prompt("nope", {})
    with pytest.raises(ValueError):
        J.render_prompt("text", {"<<CONTENT>>": F.lit("x")})
    rows = spark.createDataFrame([("d", "e", "text", 1, "m", None, "keep <<CONTENT>> here", None)], EVIDENCE)
    got = J.text_tasks(rows, templates={"text": "<<PAGE_CONTEXT>>: <<CONTENT>>"}).first()
    assert got.instructions == "page 1: keep <<CONTENT>> here"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "\n".join("" if i % 7 == 0 else ('{"k":%d}' % i if i % 5 else "{oops") for i in range(1, 2001))
    (tmp_path / "a.jsonl").write_text(text + "\n")
    (tmp_path / "b.jsonl").write_text('{"k":1}\n[1]\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        good, errors = L.read_jsonl_strict(spark, str(tmp_path))
        got = good.select("file", "line", F.try_variant_get("value", F.lit("$.k"), "int").alias("k")).collect()
        bad = errors.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert all(r.line == r.k for r in got) and len(got) == sum(1 for i in range(1, 2001) if i % 7 and i % 5) + 1
    assert {(r.file[-7:], r.line, r.error) for r in bad if r.file.endswith("b.jsonl")} == {("b.jsonl", 2, "expected JSON object")}
    with pytest.raises(Exception, match="line 5"):
        L.required(good, errors.filter("line = 5")).collect()


def test_optional_table(spark, tmp_path):
    assert O.read_table_or_empty(spark, str(tmp_path / "none"), EVIDENCE).count() == 0


def picky(task):
    if task["task_id"] == "c":
        raise KeyError("x")
    return "ok"


def test_failed_tasks_come_back(spark):
    df = spark.createDataFrame([("d", i, "text", "go") for i in "abc"], "document_id string, task_id string, kind string, instructions string")
    rows = {r.task_id: r for r in U.fulfil_tasks(df, picky).collect()}
    assert rows["a"].answer == "ok" and rows["b"].error is None and rows["c"].answer is None and "KeyError" in rows["c"].error


def test_repeated_json_key_keeps_the_last_value(spark):
    good, errors = L.parse_json_lines(spark.createDataFrame([(1, '{"a":1,"a":2}')], "line long, value string"))
    assert good.select(F.try_variant_get("value", F.lit("$.a"), "int")).first()[0] == 2 and errors.count() == 0


@pytest.mark.parametrize("value, shown", [(25.0, "25"), (2.5, "2.5"), (1e30, "1.0E30"), (1e-9, "1.0E-9"), (0.0, "0"), (None, None)])
def test_plain_numbers(spark, value, shown):
    assert spark.createDataFrame([(value,)], "x double").select(plain_number("x")).first()[0] == shown


def test_assets_outside_the_layout_folder(spark):
    layout = spark.createDataFrame([("d", "e", "/d/auto/l.json", "../img/./a.png")], "document_id string, evidence_id string, source_path string, img_path string")
    files = spark.createDataFrame([("/d/img/a.png",)], "path string")
    assert S.resolve_assets(layout, files).first().asset_path == "/d/img/a.png"


def test_fields_of_an_answer_row_are_read_once(spark):
    rows = spark.createDataFrame([('{"reactants":"a","product":[{"id":0,"label":" b "},{"name":"","compound_name":"n"},""],"confidence":"0.5"}',),
                                  ('{"reactants":["a"],"confidence":2}',), ('[1,"x",null]',)], "answer string")
    given = rows.select(F.try_parse_json("answer").alias("payload"), F.lit("text").alias("source"), F.array(F.lit("e")).alias("evidence_ids"))
    found = N.reaction_candidates(given)
    assert [(r.reactants[0].label, [(p.label, p.name) for p in r.products], r.confidence) for r in found.collect()] == [("a", [("b", None), (None, "n")], 0.5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter " in line and "variant_get" in line]
