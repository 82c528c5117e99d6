"""Sinks, optional sidecars and the submission ledger."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table_or_empty(spark: SparkSession, path: str, schema: StructType, format: str = "parquet") -> DataFrame:
    """Rows of an optional table, or an empty table of the same schema."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], schema)
    return spark.read.format(format).schema(schema).load(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_sidecar(df: DataFrame, path: str) -> None:
    """Add files; what is there stays untouched."""
    df.write.mode("append").parquet(path)


def write_outputs(records: DataFrame, path: str, corrected: DataFrame | None = None) -> None:
    """Records, the part that needs review, and corrected records beside the originals.

    Records are written once as a table; the other outputs read that table.
    """
    records.write.mode("overwrite").parquet(f"{path}/records")
    stored = records.sparkSession.read.schema(records.schema).parquet(f"{path}/records")
    write_jsonl(stored, f"{path}/records_jsonl")
    write_jsonl(stored.filter("review_status = 'needs_review'"), f"{path}/review_jsonl")
    if corrected is not None:
        write_jsonl(corrected, f"{path}/records_corrected_jsonl")


def submission_ledger(incoming: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, status per submission).

    Same id and content as the ledger, or as the first of the batch: no-op.  Same id,
    other content: error.  ``incoming``: submission_id, ord, content_hash.
    """
    known = ledger.select("submission_id", F.col("content_hash").alias("_known"))
    first = incoming.groupBy("submission_id").agg(F.min("ord").alias("_first"), F.min_by("content_hash", "ord").alias("_first_hash"))
    rows = incoming.join(first, "submission_id").join(known, "submission_id", "left")
    before = F.coalesce("_known", F.when(F.col("ord") > F.col("_first"), F.col("_first_hash")))
    status = F.when(before.isNull(), "new").when(before == F.col("content_hash"), "duplicate").otherwise("conflict")
    rows = rows.withColumn("status", status)
    return rows.filter("status = 'new'").select(*incoming.columns), rows.select(*incoming.columns, "status")
