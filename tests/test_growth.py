"""Work that must not be repeated: each test states what a larger table would pay for twice."""

from claimloom.llm import near_copies, simhash_neardup
from claimloom.operators import assemble as A
from claimloom.plans.queries_assembly import assembled
from claimloom.sources import lines as L


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_lines_are_parsed_once(spark):
    rows = [(1, '{"a":1}'), (2, "{"), (3, "[1]"), (4, " "), (5, None), (6, '{"a":1} x')]
    lines = spark.createDataFrame(spark.sparkContext.parallelize(rows), "line long, value string")
    good, broken = L.parse_json_lines(lines)
    assert optimized(good).count("parseJson(") == 1 and optimized(broken).count("parseJson(") == 1
    assert [r.line for r in good.collect()] == [1]
    assert sorted((r.line, r.error) for r in broken.collect()) == [(2, "invalid JSON"), (3, "expected JSON object"), (6, "invalid JSON")]


def test_lines_are_numbered_without_moving_them(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"a{i:04d}\n" for i in range(1, 2001)))
    (tmp_path / "b.jsonl").write_text("".join(f"b{i:04d}\n" for i in range(1, 301)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = L.read_lines(spark, str(tmp_path))
        got = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2300 and all(int(r.value[1:]) == r.line and r.file.endswith(f"{r.value[0]}.jsonl") for r in got)
    moved = [node for node in optimized(lines).splitlines() if "Window" in node and "value" in node]
    assert not moved


def test_stored_assembly_signs_candidates_once_and_nests_finished_lists(spark):
    made = assembled(spark, "/root/testdata/sf0.001", store=True)
    want = {}
    for r in A.attach_issues(made).collect():
        want.setdefault(r.group_id, []).append((tuple((x is not None, x) for x in r.place), r.code, r.severity, r.target_id, r.message))
    got = {r.group_id: [(i.code, i.severity, i.target_id, i.message) for i in r.issues] for r in A.gathered_issues(made).collect()}
    assert got == {g: [x[1:] for x in sorted(rows)] for g, rows in want.items()} and max(map(len, got.values())) > 2
    nested = optimized(A.nested_records(made))
    assert "lineitem" not in nested and "p_partkey" not in nested  # nothing goes back to the tables the candidates came from


def test_near_copies_come_from_linked_fingerprints(spark, monkeypatch):
    """The stage asks the BK-trees for links, and what they propose is compared exactly."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59] + ["x"])), (3, " ".join(words)), (4, "a b c"), (5, None), (5, "d e f"), (None, "g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, proposed = [], []
    links, pairs = simhash_neardup.links, near_copies.marked_pairs
    monkeypatch.setattr(simhash_neardup, "links", lambda fps, *more: asked.append(fps.count()) or links(fps, *more))
    monkeypatch.setattr(near_copies, "marked_pairs", lambda *given: proposed.append(pairs(*given)) or proposed[0])
    out = simhash_neardup.keep_one(docs)
    assert asked == [len({r.fp for r in simhash_neardup.fingerprints(docs).collect()})]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect())[:2] == [(0, "g h"), (1, rows[0][1])]
    assert {r.doc_id for r in out.collect()} == {None, 1, 4, 5}
    marked = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13), (4, 14)], "doc_id long, key long")
    marks = spark.createDataFrame([(1, 7), (2, 7), (3, 6), (4, 5)], "doc_id long, fp long")
    got = pairs(marked, marks, spark.createDataFrame([(6, 7), (5, 7)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(10, 11), (10, 12)]


def test_sets_that_share_many_shingles_meet_once(spark, monkeypatch):
    """A passage that several unlike texts hold is one shingle to the round of pairs, and no shingle between texts whose
    sizes rule a pair out."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    passage = words("p", 60)
    texts = [f"{passage} {words(f'own{i}x', 25)}" for i in range(6)] + [f"{words('q', 40)} {words('long', 400)}", f"{words('q', 40)} short"]
    tables, staged = {}, near_copies.staged
    monkeypatch.setattr(near_copies, "staged", lambda df, name: tables.setdefault(name, staged(df, name)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_copies.near_copies(docs).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == len(texts)
    rows = tables["open_shingles"]
    holders = {}
    for r in rows.collect():
        holders.setdefault(r.token, []).append(r.key)
    assert holders and len({tuple(sorted(k)) for k in holders.values()}) == len(holders)
    assert {r.n for r in rows.collect()} == {81}
