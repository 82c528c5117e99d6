"""Whole-file sources: digests, images, layout files.  Inputs are (path, content) rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import variants as V
from ..functions.ids import document_id
from ..operators.ranking import number_ordered

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")


def read_files(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def list_files(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """Names only: leaving ``content`` out keeps the files unread."""
    return read_files(spark, path, pattern).select("path", "length")


def file_digests(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files with their sha256, marked duplicate when the digest is in ``seen`` or came earlier."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("path").alias("_first"))
    known = seen.select("sha256").distinct().withColumn("_seen", F.lit(True))
    rows = hashed.join(first, "sha256").join(known, "sha256", "left")
    again = F.coalesce("_seen", F.lit(False)) | (F.col("path") != F.col("_first"))
    return rows.select("path", "sha256", F.when(again, "duplicate").otherwise("applied").alias("status"))


def document_ids(files: DataFrame) -> DataFrame:
    return files.select("path", document_id("content").alias("document_id"))


def file_name(path="path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def image_evidence(files: DataFrame) -> DataFrame:
    """Image files (document_id, path) sorted by path -> image evidence rows with page from the name."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    images = files.filter(suffix.isin(*IMAGE_SUFFIXES)).select("document_id", "path")
    numbered = number_ordered(images, ["document_id"], "path")
    stem = F.regexp_replace(file_name(), r"\.[^.]+$", "")
    number = F.col("rn").cast("string")
    return numbered.select(
        "document_id", F.concat(F.lit("image-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("evidence_id"),
        F.lit("image").alias("kind"), F.regexp_extract(stem, r"(?i)(?:page|p)[_-]?(\d+)", 1).try_cast("int").alias("page"),
        F.col("path").alias("source_path"),
    )


def pick_layout_file(files: DataFrame) -> DataFrame:
    """One layout file per document (document_id, stem, path), or an error.

    The only file, else the only ``_content_list_v2.json``, else the only one whose
    name holds the document's stem.
    """
    name = file_name()
    v2 = name.endswith("_content_list_v2.json")
    stem = F.contains(name, F.col("stem"))
    counts = files.groupBy("document_id").agg(
        F.count("*").alias("n"), F.min("path").alias("only"),
        F.count_if(v2).alias("n_v2"), F.min(F.when(v2, F.col("path"))).alias("v2"),
        F.count_if(stem).alias("n_stem"), F.min(F.when(stem, F.col("path"))).alias("stem_path"),
    )
    path = (
        F.when(F.col("n") == 1, F.col("only")).when(F.col("n_v2") == 1, F.col("v2")).when(F.col("n_stem") == 1, F.col("stem_path"))
    )
    error = F.when(path.isNull(), F.when(F.col("n_stem") > 1, "several layout files match the name").otherwise("several layout files found"))
    return counts.select("document_id", path.alias("path"), error.alias("error"))


def layout_rows(files: DataFrame) -> DataFrame:
    """Layout JSON (document_id, path, content as text) -> table and image evidence rows.

    The file is an array, or an object with ``content_list``; a file that does not
    parse gives nothing.
    """
    v = V.parse_strict("content")
    parsed = files.withColumn("_v", v)
    rows = F.coalesce(V.as_array("_v"), V.as_array(V.get("_v", "content_list")))
    found = parsed.select("document_id", "path", F.posexplode(rows).alias("i", "r"))
    kind = V.text_of(V.get("r", "type"))
    long = lambda k: F.try_variant_get(V.get("r", k), F.lit("$"), "int")
    box = F.transform(V.as_array(V.get("r", "bbox")), lambda x: F.try_variant_get(x, F.lit("$"), "double"))
    number = F.col("i").cast("string")
    return found.filter(V.is_object("r") & kind.isin("table", "image")).select(
        "document_id", F.concat(F.lit("layout-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("evidence_id"),
        kind.alias("kind"), F.coalesce(long("page_idx") + 1, long("page")).alias("page"), F.col("path").alias("source_path"),
        V.text_of(V.get("r", "img_path")).alias("img_path"), V.first_truthy("r", "text", "table_body").alias("text"),
        F.when(F.size(box) == 4, box).alias("bbox"),
    )


def plain_path(path) -> Column:
    """The path without ``.`` and ``..`` steps."""
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda kept, step: F.when(step == ".", kept)
        .when((step == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(step))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(steps, "/")).otherwise(path)


def resolve_assets(layout: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``asset_path``: the image next to the layout file, else in its parent's folder. ``files`` lists plain
    paths; links in the file system are not followed."""
    folder = F.regexp_replace("source_path", r"/[^/]*$", "")
    parent = F.regexp_replace(folder, r"/[^/]*$", "")
    image = F.nullif(F.trim("img_path"), F.lit(""))
    tries = F.when(F.startswith(image, F.lit("/")), F.array(image)).otherwise(
        F.array(F.concat(folder, F.lit("/"), image), F.concat(parent, F.lit("/"), image))
    )
    wanted = layout.filter(image.isNotNull()).select("document_id", "evidence_id", F.posexplode(F.transform(tries, plain_path)).alias("priority", "path"))
    hits = wanted.join(files.select("path").distinct(), "path").groupBy("document_id", "evidence_id").agg(
        F.min_by("path", "priority").alias("asset_path")
    )
    return layout.join(hits, ["document_id", "evidence_id"], "left")
