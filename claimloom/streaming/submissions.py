"""Submissions as a stream of JSON-lines files.

What a stream must remember is kept in Spark's state store (one entry per answer, task or count), so a batch costs its
own rows however much came before. Call ``large_state`` once per session to hold that state on disk instead of in
the heap.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import variants as V
from ..functions.text import blank_to_null
from ..operators.ranking import number_rows
from ..operators.submissions import submission_hash
from ..sources.lines import empty_files, parse_json_lines, submissions
from ..staging import staged

KEY = ["document_id", "task_id", "submission_hash"]
TASK = ["document_id", "task_id"]


def large_state(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, written as changelogs: its size is bounded by disk, not by memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _lines(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    # Without a bound on their age, files whose time lies before that of files already seen are taken too.
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", "36500d")
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived_at"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def submission_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files in a folder -> document_id, task_id, producer, outputs, error, file, submission_hash, arrived_at."""
    lines = _lines(spark, path, files_per_trigger)
    parsed = lines.filter(blank_to_null("value").isNotNull()).withColumn("_v", V.parse_strict("value"))
    error = F.when(F.col("_v").isNull(), "invalid JSON").when(~V.is_object("_v"), "expected JSON object")
    rows = parsed.select("file", "arrived_at", error.alias("error"), F.col("_v").alias("value"))
    return submission_hash(submissions(rows))


def good_rows(stream: DataFrame) -> DataFrame:
    return stream.filter(F.col("error").isNull())


# --- lines with their numbers ---------------------------------------------------

def take_submissions(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """New files -> ``target``/answers (typed rows with file and line) and ``target``/errors (file, line, error).

    A file belongs to one batch, so its lines are numbered there: per split of the file, with the offsets from the table
    of split sizes, as in a batch read. A file without lines is an error without a line number. A batch that
    runs again replaces its own folder.
    """
    def step(batch: DataFrame, number: int) -> None:
        rows = staged(batch.withColumn("_id", F.monotonically_increasing_id()), "lines")
        numbered = number_rows(rows, ["file"], "_id", F.col("start"), "line").select("file", "arrived_at", F.col("line").cast("bigint"), "value")
        good, broken = parse_json_lines(numbered)
        empty = empty_files(rows).select("file", F.lit(None).cast("bigint").alias("line"), "error")
        submission_hash(submissions(good)).write.mode("overwrite").parquet(f"{target}/answers/batch={number}")
        broken.select("file", "line", "error").unionByName(empty).write.mode("overwrite").parquet(f"{target}/errors/batch={number}")

    lines = _lines(spark, path, files_per_trigger)
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- each answer once -----------------------------------------------------------

def distinct_submissions(stream: DataFrame, keep: str | None = None) -> DataFrame:
    """The first arrival of each answer (document, task, content).

    The state store holds one key per answer: for good, or with ``keep`` (such as "90 days") for that long after it was
    taken; a copy that comes later than that passes and is a no-op where answers are applied. The clock is that of
    the batch, not of the file, so no file is too late.
    """
    if keep is None:
        return stream.dropDuplicates(KEY)
    taken = stream.withColumn("taken_at", F.current_timestamp()).withWatermark("taken_at", keep)
    return taken.dropDuplicatesWithinWatermark(KEY)


def dedup_submissions(stream: DataFrame, path: str, checkpoint: str, keep: str | None = None) -> StreamingQuery:
    """Write the first arrival of each answer to ``path``, each exactly once."""
    rows = distinct_submissions(stream, keep).select(*KEY, "producer", "file", "arrived_at")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- the board ------------------------------------------------------------------

BOARD = "document_id string, kind string, tasks bigint, fulfilled bigint"
COMPACT_EVERY = 20


def _folders(spark: SparkSession, pattern: str) -> list[int]:
    """Numbers N of finished folders ``name=N``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Sums of the newest compacted counts and of the changes after it (up to a batch)."""
    base = [n for n in _folders(spark, f"{path}/upto=*") if upto is None or n < upto]
    last = base[-1] if base else -1
    changes = [n for n in _folders(spark, f"{path}/n=*") if n > last and (upto is None or n <= upto)]
    paths = [f"{path}/upto={n}" for n in base[-1:]] + [f"{path}/n={n}" for n in changes]
    rows = spark.read.schema(BOARD).parquet(*paths) if paths else spark.createDataFrame([], BOARD)
    return rows.groupBy("document_id", "kind").agg(F.sum("tasks").alias("tasks"), F.sum("fulfilled").alias("fulfilled"))


def _compact(spark: SparkSession, path: str, number: int) -> None:
    """Merge what there is up to batch ``number`` into one folder; what the one before it replaced is deleted, so that
    readers which began before this merge still find their files."""
    _counts(spark, path, number).write.mode("overwrite").parquet(f"{path}/upto={number}")
    bases = _folders(spark, f"{path}/upto=*")
    for old in bases[:-2]:
        _delete(spark, f"{path}/upto={old}")
    for old in _folders(spark, f"{path}/n=*"):
        if len(bases) > 1 and old <= bases[-2]:
            _delete(spark, f"{path}/n={old}")


def live_task_board(
    stream: DataFrame, tasks: DataFrame, board_path: str, checkpoint: str, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Keep counts of tasks and answered tasks per document and channel up to date.

    ``tasks`` (document_id, task_id, kind) is a stream too, so that new ones may come. The state store holds one key per
    task and per answered task; a pair of them is met once and adds one to its count. A batch writes the
    changes of its own rows; every ``compact_every`` batches the changes are merged, so files stay few.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = batch.groupBy("document_id", "kind").agg(F.sum("tasks").alias("tasks"), F.sum("fulfilled").alias("fulfilled"))
        changes.write.mode("overwrite").parquet(f"{board_path}/n={number}")
        if number % compact_every == compact_every - 1:
            _compact(spark, board_path, number)

    # Two kinds of change: a task that is new, and a task met by its first answer.
    known = tasks.select(*TASK, "kind").dropDuplicates(TASK)
    answered = stream.select(*TASK).dropDuplicates(TASK)
    met = known.join(answered, TASK).select("document_id", "kind", F.lit(0).cast("bigint").alias("tasks"), F.lit(1).cast("bigint").alias("fulfilled"))
    new = known.select("document_id", "kind", F.lit(1).cast("bigint").alias("tasks"), F.lit(0).cast("bigint").alias("fulfilled"))
    return (
        met.unionByName(new).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_board(spark: SparkSession, board_path: str) -> DataFrame:
    """document_id, kind, awaiting, fulfilled as of the last finished batch."""
    rows = _counts(spark, board_path)
    return rows.select("document_id", "kind", (F.col("tasks") - F.col("fulfilled")).alias("awaiting"), "fulfilled")
