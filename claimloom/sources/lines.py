"""JSON-lines sources with line numbers and error rows."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import variants as V
from ..functions.text import blank_to_null
from ..operators.answers import structure_candidates
from ..operators.contract import record_line_errors
from ..operators.ranking import union_all
from ..schemas import RECORD_BODY
from ..staging import staged


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Text files -> file, line (1-based), value.

    Rows of a split (at most one file block) come in order, so their running ids number them from the first one; the
    offsets come from the table of split sizes, one row per split as in Spark's own list of files. Lines are not
    shuffled: a file of any size is read, and its lines used further, by as many tasks as it has splits.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    offsets = splits.select("file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_offset"))
    return rows.join(F.broadcast(offsets), ["file", "_start"]).select("file", (F.col("_id") + F.col("_offset")).alias("line"), "value")


def _typed_lines(lines: DataFrame) -> DataFrame:
    """``value`` as VARIANT, and ``error``; each text is parsed once."""
    kept = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*kept, V.once(V.parse_strict("value"), "value"))
    return parsed.withColumn("error", F.when(F.col("value").isNull(), "invalid JSON").when(~V.is_object("value"), "expected JSON object"))


def _good_and_broken(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = [c for c in rows.columns if c not in ("value", "error")]
    return rows.filter(F.col("error").isNull()).select(*kept, "value"), rows.filter(F.col("error").isNotNull()).select(*kept, "error")


def parse_json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an object in VARIANT ``value``, error rows); blank lines are skipped."""
    return _good_and_broken(_typed_lines(lines.filter(blank_to_null("value").isNotNull())))


def read_jsonl_strict(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    return parse_json_lines(read_lines(spark, path))


def required(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows, but reading them fails on the first error row (strict mode)."""
    failing = errors.select(
        F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("error"))).cast("string").alias("e")
    )
    checked = failing.filter(F.col("e").isNotNull())
    empty = checked.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(empty)


def gold_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed records with file and line, all errors of all lines)."""
    good, broken = parse_json_lines(lines)
    checked = good.withColumn("_errors", record_line_errors(F.col("value")))
    kept = [c for c in good.columns if c != "value"]
    errors = checked.select(*kept, F.explode("_errors").alias("error"))
    typed = checked.filter(F.size("_errors") == 0).withColumn("r", F.try_variant_get("value", F.lit("$"), RECORD_BODY.simpleString()))
    return typed.select(*kept, "r.*"), broken.unionByName(errors)


def read_gold(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    return gold_rows(read_lines(spark, path))


def gold_source(files: DataFrame, records: DataFrame) -> DataFrame:
    """One provenance row per file: path, name, sha256, entry count, schema version.

    ``files`` has path and content; ``records`` the typed rows of ``gold_rows``.
    """
    counts = records.groupBy("file").agg(
        F.count("*").alias("entry_count"), F.max_by("schema_version", F.when(F.col("schema_version").isNotNull(), F.col("line"))).alias("gold_schema_version")
    )
    return files.join(counts, F.col("path") == F.col("file"), "left").select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_hash"),
        F.coalesce("entry_count", F.lit(0)).alias("entry_count"),
        F.coalesce("gold_schema_version", F.lit("unknown")).alias("gold_schema_version"), F.lit("none").alias("normalization_policy"),
    )


PRODUCER_DDL = "kind string, client_name string, client_version string, model string, policy string, attempt int"


def _typed_producer(v) -> Column:
    return F.from_json(F.to_json(V.get(v, "producer")), PRODUCER_DDL)


def submissions(rows: DataFrame) -> DataFrame:
    """Parsed objects -> document_id, task_id, producer, outputs (VARIANT). A document_id column of the rows stays."""
    kept = [c for c in rows.columns if c != "value"]
    document = [] if "document_id" in kept else [V.text_of(V.get("value", "document_id")).alias("document_id")]
    return rows.select(*kept, *document, V.text_of(V.get("value", "task_id")).alias("task_id"), _typed_producer("value").alias("producer"), V.get("value", "outputs").alias("outputs"))


def adjudications(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c != "value"]
    names = ("task_id", "reaction_id", "decision", "rationale")
    return rows.select(*kept, *[V.text_of(V.get("value", n)).alias(n) for n in names], _typed_producer("value").alias("producer"))


def empty_files(lines: DataFrame, full: Column | None = None) -> DataFrame:
    """Files without a single non-blank line; reading submissions treats them as an error. ``full``: what a non-blank line is."""
    counts = lines.groupBy("file").agg(F.count_if(blank_to_null("value").isNotNull() if full is None else full).alias("n"))
    return counts.filter("n = 0").select("file", F.lit("submission file is empty").alias("error"))


def read_submissions(spark: SparkSession, path, kind: str = "candidates") -> tuple[DataFrame, DataFrame]:
    """(typed rows, error rows). The lines are parsed once and written; both tables read what was written."""
    lines = read_lines(spark, path).withColumn("full", blank_to_null("value").isNotNull())
    lines = staged(_typed_lines(lines), "parsed-lines")
    good, broken = _good_and_broken(lines.filter("full").drop("full"))
    typed = submissions(good) if kind == "candidates" else adjudications(good)
    empty = empty_files(lines, F.col("full")).withColumn("line", F.lit(None).cast("bigint"))
    return typed, broken.unionByName(empty.select(*broken.columns))


def external_structures(rows: DataFrame) -> DataFrame:
    """Structure lines in full form (with candidate_id) or short form (label, smiles).

    Short rows get the evidence id ``manual-line-N``.
    """
    full = V.get("value", "candidate_id").isNotNull()
    typed = "candidate_id string, compound_label string, smiles string, evidence_ids array<string>, confidence double"
    kept = [c for c in rows.columns if c not in ("value",)]
    parsed = F.from_json(F.to_json("value"), typed)
    whole = rows.filter(full).withColumn("s", parsed).select(
        *kept, "s.candidate_id", "s.compound_label", blank_to_null("s.smiles").alias("smiles"),
        F.coalesce("s.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.coalesce("s.confidence", F.lit(0.5)).alias("confidence"),
    ).filter(F.col("smiles").isNotNull() & F.col("confidence").between(0, 1))
    short = rows.filter(~full).select(
        *kept, F.col("value").alias("payload"), F.array(F.concat(F.lit("manual-line-"), F.col("line").cast("string"))).alias("evidence_ids"),
    )
    return union_all(whole, structure_candidates(short).drop("row_number").select(*whole.columns))


def read_external_structures(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    good, errors = read_jsonl_strict(spark, path)
    return external_structures(good), errors
