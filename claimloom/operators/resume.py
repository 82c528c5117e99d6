"""Runs that go on: a folder of tables by bucket of documents, and answers that arrive later.

A resume reads the new files, and of every table only the buckets of the documents these files answer. Documents whose
answers changed are assembled again; the other rows of their buckets are copied. Each table is written by dynamic
partition overwrite, the task state and the list of files last, so a resume that dies is simply run again with the
same files. One resume runs at a time. Pick ``buckets`` so that one bucket is some hundred megabytes of the largest table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from ..schemas import STRUCTURE_DICTIONARY
from ..sources.files import file_digests, read_files
from ..sources.lines import PRODUCER_DDL, read_submissions
from ..sources.sinks import read_table_or_empty
from ..staging import staged
from .assemble import assemble, attach_issues, record_evidence_ids
from .ranking import keep_last
from .review import task_board
from .structures import Parser, canonicalise, structure_dictionary
from .submissions import apply_candidate_submissions, submission_report

TASK = ["document_id", "task_id"]
FILES = "file string, sha256 string"
STATE = f"document_id string, task_id string, kind string, status string, submission_hash string, producer struct<{PRODUCER_DDL}>"
LINE_BITS = 40


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    buckets: int

    def bucket(self, key: str = "document_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, name: str, buckets: list[int] | None = None, like: StructType | None = None) -> DataFrame:
        """A table without its bucket column; with ``buckets`` only their files. A table that no resume has written
        yet is empty, with the columns of ``like``."""
        if like is None:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        else:
            rows = read_table_or_empty(self.spark, f"{self.path}/{name}", StructType([f for f in like.fields if f.name != "bucket"]).add("bucket", IntegerType()))
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def write(self, name: str, rows: DataFrame, buckets: list[int], key: str = "document_id") -> None:
        """Replace these buckets of a table. A rebalance splits a document that holds much of a bucket over several files."""
        seen = Observation()
        rows = rows.withColumn("bucket", self.bucket(key)).hint("rebalance", "bucket")
        rows.observe(seen, F.collect_set("bucket").alias("met")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket"
        ).parquet(f"{self.path}/{name}")
        for bucket in set(buckets) - set(seen.get["met"]):
            rows.drop("bucket").filter(F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/{name}/bucket={bucket}")


def _accepted(applied) -> tuple[DataFrame, DataFrame]:
    """Reaction and structure candidates of accepted answers, in the order of task and row."""
    def ordered(rows):
        return rows.withColumn("ord", F.struct("task_id", F.col("output_number").alias("row"))).drop("output_number")

    return ordered(applied.reactions), ordered(applied.structures)


def start(spark: SparkSession, path: str, tasks: DataFrame, buckets: int = 64) -> Store:
    """A new store of ``tasks`` (document_id, task_id, kind, evidence_ids), all of them waiting for an answer."""
    store = Store(spark, path, buckets)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/settings")
    store.write("tasks", tasks.select(*TASK, "kind", "evidence_ids"), [0])
    return store


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, spark.read.parquet(f"{path}/settings").first().buckets)


@dataclass(frozen=True)
class Resumed:
    """What a resume did. ``statuses``: one row per answer; ``files``: one per file; ``errors``: lines of refused files;
    ``documents``: open tasks of the documents met; ``buckets``: those rewritten; ``parsed``: new structure texts."""

    statuses: DataFrame
    files: DataFrame
    errors: DataFrame
    documents: DataFrame
    buckets: list[int]
    parsed: int


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def _same_form(path) -> Column:
    """Both readers' spelling of a local path as one."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _new_texts(store: Store, candidates: DataFrame, structures: DataFrame, parser: Parser) -> tuple[DataFrame, int]:
    """The dictionary of all structure texts of these rows; only texts no earlier run met are parsed."""
    texts = structures.select("smiles").unionByName(candidates.select(F.explode(F.concat("reactants.smiles", "products.smiles")).alias("smiles")))
    texts = staged(texts.filter("smiles IS NOT NULL").distinct().withColumn("bucket", store.bucket("smiles")), "texts")
    met = [r.bucket for r in texts.select("bucket").distinct().collect()]  # at most the number of buckets
    known = store.read("dictionary", met, like=STRUCTURE_DICTIONARY)
    fresh = staged(structure_dictionary(texts.join(known, texts.smiles == known.raw, "left_anti"), parser), "parsed")
    count = fresh.count()
    if count:
        fresh.select(*known.columns, store.bucket("raw")).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{store.path}/dictionary")
    return store.read("dictionary", met, like=STRUCTURE_DICTIONARY), count


def resume_documents(store: Store, path: str, parser: Parser, force: bool = False, wait: bool = True) -> Resumed:
    """Take the submission files under ``path`` and assemble again the documents whose answers changed.

    A file whose content was taken before is a duplicate; one with a line that does not parse, or without lines, is
    refused whole. Answers are applied in the order of file names and lines; another answer to an answered task is a
    conflict, or replaces it with ``force``. With ``wait`` a document has records only once none of its tasks waits.
    """
    spark = store.spark
    ledger = read_table_or_empty(spark, f"{store.path}/files", _schema(spark, FILES))
    digests = staged(file_digests(read_files(spark, path), ledger).withColumn("file", _same_form("path")), "digests")
    fresh = [r.path for r in digests.filter("status = 'applied'").select("path").orderBy("path").collect()]  # names, as Spark's own list of files holds
    if not fresh:
        none = spark.createDataFrame([], "document_id string, task_id string, file string, line bigint, submission_hash string, result string")
        board = spark.createDataFrame([], "document_id string, awaiting bigint, fulfilled bigint, status string")
        counts = [F.lit(0).cast("bigint").alias(n) for n in ("applied", "repeated", "conflicts", "errors")]
        return Resumed(none, digests.select("file", "sha256", "status", *counts), spark.createDataFrame([], "file string, line bigint, error string"), board, [], 0)

    numbers = spark.createDataFrame([(i, p) for i, p in enumerate(fresh)], "number bigint, path string").select("number", _same_form("path").alias("file"))
    typed, broken = read_submissions(spark, fresh)
    errors = staged(broken.withColumn("file", _same_form("file")).select("file", "line", "error"), "file-errors")
    refused = errors.select("file").distinct()
    taken = typed.withColumn("file", _same_form("file")).join(refused, "file", "left_anti").join(numbers, "file")
    place = F.shiftleft("number", LINE_BITS) + F.col("line")
    answers = staged(taken.select(*TASK, "producer", "outputs", place.alias("ord"), store.bucket()), "answers")
    met = [r.bucket for r in answers.select("bucket").distinct().collect()]

    tasks, state = store.read("tasks", met), store.read("state", met, like=_schema(spark, STATE))
    applied = apply_candidate_submissions(tasks, state, answers.drop("bucket"), force)
    statuses = staged(applied.statuses, "statuses")
    done = statuses.filter(F.col("result").isin("applied", "superseded"))
    answered = staged(done.select(*TASK).distinct(), "answered")
    changed = staged(answered.select("document_id", store.bucket()).distinct(), "changed")
    buckets = [r.bucket for r in changed.select("bucket").distinct().collect()]
    changed = changed.drop("bucket")
    new_state = staged(applied.state, "state")
    board = submission_report(tasks, new_state)
    parsed = 0
    if buckets:
        kept = []
        for name, rows in zip(("candidates", "structures"), _accepted(applied)):
            earlier = store.read(name, buckets, like=rows.schema).join(answered, TASK, "left_anti")
            kept.append(staged(earlier.unionByName(rows), name))
        ready = changed
        if wait:
            waiting = task_board(tasks.join(changed, "document_id", "left_semi"), new_state).filter("status = 'awaiting'").select("document_id").distinct()
            ready = changed.join(waiting, "document_id", "left_anti")
        candidates, structures = (staged(keep_last(rows.join(ready, "document_id", "left_semi"), ["document_id", "candidate_id"]), "ready") for rows in kept)
        dictionary, parsed = _new_texts(store, candidates, structures, parser)
        assembly = assemble(candidates, canonicalise(structures, dictionary), dictionary, store=True)
        made = {"records": assembly.records, "evidence": record_evidence_ids(assembly), "issues": attach_issues(assembly)}
        for name, rows in made.items():
            others = store.read(name, buckets, like=rows.schema).join(changed, "document_id", "left_anti")
            store.write(name, others.unionByName(rows), buckets)
        for name, rows in zip(("candidates", "structures"), kept):
            store.write(name, rows, buckets)
        in_buckets = new_state.filter(store.bucket().isin(buckets))
        store.write("state", in_buckets, buckets)

    number, line = F.shiftright("ord", LINE_BITS).alias("number"), F.col("ord").bitwiseAND((1 << LINE_BITS) - 1).alias("line")
    statuses = statuses.select(*TASK, number, line, "submission_hash", "result").join(numbers, "number").drop("number")
    count = lambda test, name: F.count_if(test).alias(name)
    result = F.col("result")
    per_file = statuses.groupBy("file").agg(
        count(result.isin("applied", "superseded"), "applied"), count(result == "no-op", "repeated"), count(result == "conflict", "conflicts"),
        count(result.startswith("error"), "errors"),
    )
    files = digests.join(refused.withColumn("_refused", F.lit(True)), "file", "left").join(per_file, "file", "left").select(
        "file", "sha256", F.when(F.col("_refused"), "refused").otherwise(F.col("status")).alias("status"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("applied", "repeated", "conflicts", "errors")],
    )
    files = staged(files, "file-report")
    files.filter("status = 'applied'").select("file", "sha256").write.mode("append").parquet(f"{store.path}/files")
    return Resumed(statuses, files, errors, staged(board, "board"), sorted(buckets), parsed)


def task_state(store: Store) -> DataFrame:
    return store.read("state", like=_schema(store.spark, STATE))


def document_status(store: Store) -> DataFrame:
    """Per document: tasks waiting and answered, records, records to review, and the status of the run."""
    board = submission_report(store.read("tasks"), task_state(store))
    counts = store.read("records", like=_schema(store.spark, "document_id string, review_status string")).groupBy("document_id").agg(
        F.count("*").alias("records_count"), F.count_if(F.col("review_status") == "needs_review").alias("review_count")
    )
    n = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    rows = board.join(counts, "document_id", "left").select("document_id", "awaiting", "fulfilled", n("records_count"), n("review_count"))
    status = (
        F.when(F.col("awaiting") > 0, "awaiting_input").when(F.col("records_count") == 0, "completed_empty")
        .when(F.col("review_count") > 0, "partial").otherwise("success")
    )
    return rows.withColumn("status", status)
