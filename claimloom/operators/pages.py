"""Splitting documents into evidence: pages and markdown tables, row by row, no shuffle."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import LINE_BREAK, strip

PAGE_MARK = r"(?mdU)(?=^##\s+Page\s+\d+)"
PAGE_NUMBER = r"(?dU)^##\s+Page\s+(\d+)"


def split_pages(documents: DataFrame) -> DataFrame:
    """Markdown -> one text evidence row per page section, else one for the document.

    Text before the first page mark is dropped; a blank document gives nothing.
    """
    parts = documents.select("document_id", "markdown", F.split("markdown", PAGE_MARK).alias("parts"))
    pages = F.filter("parts", lambda p: p.rlike(PAGE_NUMBER))
    parts = parts.withColumn("pages", pages)
    whole = F.when(strip("markdown") != "", F.array("markdown"))
    rows = parts.select(
        "document_id", (F.size("pages") > 0).alias("paged"),
        F.posexplode(F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.coalesce(whole, F.array().cast("array<string>")))).alias("ord", "part"),
    )
    page = F.when(F.col("paged"), F.regexp_extract("part", PAGE_NUMBER, 1).try_cast("int"))
    return rows.select(
        "document_id", F.when(F.col("paged"), F.concat(F.lit("text-p"), page.cast("string"))).otherwise("text-document").alias("evidence_id"),
        F.lit("text").alias("kind"), page.alias("page"),
        F.when(F.col("paged"), strip("part")).otherwise(F.col("part")).alias("text"), "ord",
    )


def markdown_tables(documents: DataFrame) -> DataFrame:
    """Maximal runs of two or more lines with two or more '|', a '---' in the first three.

    Other lines are blanked, so runs end up between empty lines and one split finds
    them: linear in the text, inside the row.
    """
    lines = F.split("markdown", LINE_BREAK)
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    blanked = F.array_join(F.transform(lines, lambda x: F.when(pipes(x) >= 2, x).otherwise("")), "\n")
    runs = F.transform(F.split(blanked, "\n{2,}"), lambda r: F.regexp_replace(r, r"^\n+|\n+$", ""))

    def is_table(run):
        rows = F.split(run, "\n")
        return (F.size(rows) >= 2) & F.exists(F.slice(rows, 1, 3), lambda x: F.contains(x, F.lit("---")))

    tables = documents.select("document_id", F.posexplode(F.filter(runs, is_table)).alias("i", "text"))
    return tables.select("document_id", (F.col("i") + 1).alias("table_number"), "text")
