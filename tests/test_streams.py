import json
import os
import random

from pyspark.sql import functions as F

from claimloom.sources import lines as L
from claimloom.streaming import submissions as Z


def answer(doc, task, value):
    return json.dumps({"document_id": doc, "task_id": task, "producer": {"kind": "human"}, "outputs": [{"v": value}]})


def put(folder, name, lines, at=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))
    if at is not None:
        os.utime(folder / name, (at, at))


def test_stream_errors_have_the_lines_of_a_batch_read(spark, tmp_path):
    rows = ["" if i % 7 == 0 else ("{oops" if i % 5 == 0 else "[1]" if i % 11 == 0 else answer("d", f"t{i}", i)) for i in range(1, 3001)]
    put(tmp_path / "in", "long.jsonl", rows)
    put(tmp_path / "in", "short.jsonl", ["{", answer("d", "t1", 1)])
    put(tmp_path / "in", "empty.jsonl", ["", " "])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
        Z.take_submissions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files_per_trigger=2).awaitTermination()
        _, errors = L.read_submissions(spark, str(tmp_path / "in"))
        want = sorted(map(repr, ((r.file, r.line, r.error) for r in errors.collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = spark.read.parquet(str(tmp_path / "out/errors")).collect()
    assert sorted(map(repr, ((r.file, r.line, r.error) for r in got))) == want and len(want) > 600
    taken = spark.read.parquet(str(tmp_path / "out/answers")).filter("file LIKE '%long%'").select("task_id", "line").collect()
    assert all(r.task_id == f"t{r.line}" for r in taken) and len(taken) == sum(1 for x in rows if x.startswith('{"'))


def test_each_answer_once_over_files_and_restarts(spark, tmp_path):
    def run():
        stream = Z.good_rows(Z.submission_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
        Z.dedup_submissions(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.document_id, r.task_id, r.file[-1]) for r in rows)

    put(tmp_path / "in", "a", [answer("d1", "t", 1), answer("d2", "t", 1), answer("d1", "t", 1), answer("d1", "t", 2)], 2_000_000_000)
    first = run()
    assert first == [("d1", "t", "a"), ("d1", "t", "a"), ("d2", "t", "a")]
    assert run() == first
    put(tmp_path / "in", "b", [answer("d2", "t", 1), answer("d1", "t", 2), answer("d3", "t", 1)], 1_000_000_000)  # older than what was seen
    put(tmp_path / "in", "c", [answer("d3", "t", 1), answer("d2", "t", 7)], 1_500_000_000)
    assert [r[:2] for r in run()] == [("d1", "t"), ("d1", "t"), ("d2", "t"), ("d2", "t"), ("d3", "t")]


def test_state_is_bounded_by_its_time(spark, tmp_path):
    for k in range(5):
        put(tmp_path / "in", f"f{k}", [answer("d", f"t{k}-{i}", i) for i in range(20)])
    left = {}
    for keep in (None, "0 seconds"):
        stream = Z.good_rows(Z.submission_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
        query = Z.dedup_submissions(stream, str(tmp_path / f"out{keep}"), str(tmp_path / f"state{keep}"), keep)
        query.awaitTermination()
        left[keep] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert spark.read.parquet(str(tmp_path / f"out{keep}")).count() == 100
    assert left[None] == 100 and left["0 seconds"] <= 40


def test_board_counts_changes_and_stays_small(spark, tmp_path):
    pick = random.Random(3)
    tasks = [(f"d{i % 3}", f"t{i}", "text" if i % 2 else "table") for i in range(60)]
    spark.createDataFrame(tasks[:40], "document_id string, task_id string, kind string").coalesce(1).write.parquet(str(tmp_path / "tasks"))
    answered = set()

    def more(names):
        for name in names:
            chosen = [pick.choice(tasks)[:2] for _ in range(4)] + [("d0", "unknown")]
            answered.update(chosen)
            put(tmp_path / "in", name, [answer(*c, pick.random()) for c in chosen + chosen[:1]])

    def run():
        arriving = spark.readStream.schema("document_id string, task_id string, kind string").parquet(str(tmp_path / "tasks"))
        stream = Z.good_rows(Z.submission_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
        Z.live_task_board(stream, arriving, str(tmp_path / "board"), str(tmp_path / "state"), compact_every=3).awaitTermination()
        return {(r.document_id, r.kind): (r.awaiting, r.fulfilled) for r in Z.latest_board(spark, str(tmp_path / "board")).collect()}

    def want(known):
        out = {}
        for d, t, kind in known:
            a, f = out.get((d, kind), (0, 0))
            out[d, kind] = (a, f + 1) if (d, t) in answered else (a + 1, f)
        return out

    more([f"a{k}" for k in range(7)])
    assert run() == want(tasks[:40])
    more([f"b{k}" for k in range(7)])
    spark.createDataFrame(tasks[30:], "document_id string, task_id string, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "tasks"))
    assert run() == want(tasks)
    folders = os.listdir(tmp_path / "board")
    assert len([f for f in folders if f.startswith("upto=")]) <= 2 and len([f for f in folders if f.startswith("n=")]) <= 6
    rows = spark.read.parquet(*[str(tmp_path / "board" / f) for f in folders])
    assert rows.agg(F.count("*")).first()[0] <= 60


def test_state_on_disk(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    Z.large_state(spark)
    try:
        put(tmp_path / "in", "a", [answer("d", "t", 1), answer("d", "t", 1)])
        stream = Z.good_rows(Z.submission_stream(spark, str(tmp_path / "in")))
        Z.dedup_submissions(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
