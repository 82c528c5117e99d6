"""Evidence -> task tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import task_id
from ..functions.text import col, page_context, strip
from .pages import markdown_tables
from .ranking import union_all
from .review import IDS, record_evidence

# Versions and output schemas of the four task kinds, and the tokens
# a template may hold.
VERSIONS = {"text": "1.0.0", "table": "1.1.0", "structure": "1.0.0", "adjudicate": "1.0.0"}
OUTPUT_SCHEMAS = {
    "text": "ReactionCandidate@1", "table": "ReactionCandidate@1", "structure": "StructureCandidate@1",
    "adjudication": "AdjudicationDecision@1",
}
TOKENS = ("<<CONTENT>>", "<<PAGE_CONTEXT>>", "<<IMAGE_CONTEXT>>", "<<RECORD>>", "<<EVIDENCE>>")
TEMPLATES = {
    "text": "Extract the reactions reported in this text as JSON.\nContext: <<PAGE_CONTEXT>>\nContent:\n<<CONTENT>>\n",
    "table": "Extract the reaction rows of this table as JSON.\nContext: <<PAGE_CONTEXT>>\nContent:\n<<CONTENT>>\n",
    "structure": "Identify the labelled structures in this image as JSON.\nImage context: <<IMAGE_CONTEXT>>\n",
    "adjudicate": "Review this record using only the evidence.\nRecord:\n<<RECORD>>\nEvidence:\n<<EVIDENCE>>\n",
}
MAX_TEXT_CHARS = 50000  # of one task; longer texts become several
_IMAGES = "array<struct<path:string,evidence_id:string,context:string>>"


def render_prompt(name: str, values: dict[str, Column], templates: dict[str, str] = TEMPLATES) -> Column:
    """Template with its tokens replaced; a token of the template without a value is an error.

    Checked on the template when the plan is built, so a text that happens to
    contain a token does not fail.
    """
    if name not in templates:
        raise ValueError(f"unknown template: {name}")
    template = templates[name]
    if not template:
        raise ValueError(f"template {name} is empty")
    left = [t for t in TOKENS if t in template and t not in values]
    if left:
        raise ValueError(f"template {name} has unresolved tokens: {left}")
    pieces: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.index(t), t) for t in values if t in rest), default=None)
        if at is None:
            pieces.append(F.lit(rest))
            break
        place, token = at
        pieces += [F.lit(rest[:place]), F.coalesce(col(values[token]), F.lit(""))]
        rest = rest[place + len(token):]
    return F.concat(*pieces)


def _task(df: DataFrame, kind: str, key, prompt: Column, text, images=None, evidence_ids=None, artifacts=("document.json",)) -> DataFrame:
    name = "adjudicate" if kind == "adjudication" else kind
    no_images, no_ids = F.array().cast(_IMAGES), F.array().cast("array<string>")
    text = F.lit(None).cast("string") if text is None else col(text)
    extra = [c for c in ("reaction_id",) if c in df.columns]
    return df.select(
        "document_id", task_id(F.lit(kind), key).alias("task_id"), F.lit(kind).alias("kind"),
        F.lit(VERSIONS[name]).alias("instruction_version"), prompt.alias("instructions"),
        F.lit(OUTPUT_SCHEMAS[kind]).alias("output_schema_version"),
        (no_ids if evidence_ids is None else evidence_ids).alias("evidence_ids"),
        F.array(*[F.lit(a) for a in artifacts]).alias("input_artifacts"),
        F.struct(text.alias("text"), (no_images if images is None else images.cast(_IMAGES)).alias("images")).alias("assets"),
        F.lit("awaiting").alias("status"), *extra,
    )


def text_parts(df: DataFrame, column: str, max_chars: int, key: str) -> DataFrame:
    """Long texts in numbered parts of at most ``max_chars``: ``_content``, and ``_key``, which names parts after
    the first ``key#2``, ``key#3`` and so on."""
    last = F.greatest(F.ceil(F.length(column) / max_chars).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(column), i * max_chars + 1, F.lit(max_chars)))
    rows = df.select("*", F.posexplode(parts).alias("_part", "_content"))
    suffix = F.when(F.col("_part") == 0, "").otherwise(F.concat(F.lit("#"), (F.col("_part") + 1).cast("string")))
    return rows.withColumn("_key", F.concat(key, suffix)).drop("_part")


def text_tasks(evidence: DataFrame, max_chars: int = MAX_TEXT_CHARS, templates=TEMPLATES) -> DataFrame:
    """One task per part of a text; the parts in order are the text."""
    rows = text_parts(evidence.filter((F.col("kind") == "text") & (F.col("text") != "")), "text", max_chars, "evidence_id")
    prompt = render_prompt("text", {"<<PAGE_CONTEXT>>": page_context("page"), "<<CONTENT>>": F.col("_content")}, templates)
    return _task(rows, "text", "_key", prompt, "_content", evidence_ids=F.array("evidence_id"))


def table_tasks(evidence: DataFrame, templates=TEMPLATES) -> DataFrame:
    has_text, has_image = F.coalesce("text", F.lit("")) != "", F.coalesce("asset_path", F.lit("")) != ""
    rows = evidence.filter((F.col("kind") == "table") & (has_text | has_image))
    image = F.struct(F.col("asset_path").alias("path"), "evidence_id", page_context("page").alias("context"))
    images = F.when(has_image, F.array(image)).otherwise(F.array().cast(_IMAGES))
    prompt = render_prompt("table", {"<<PAGE_CONTEXT>>": page_context("page"), "<<CONTENT>>": F.col("text")}, templates)
    return _task(rows, "table", "evidence_id", prompt, "text", images=images, evidence_ids=F.array("evidence_id"))


def image_to_evidence(images: DataFrame, evidence: DataFrame) -> DataFrame:
    """Images that are not table assets, with their image evidence when there is one."""
    by_path = evidence.filter("kind = 'image'").groupBy("document_id", F.col("source_path").alias("path")).agg(
        F.max_by(F.struct("evidence_id", "page"), "evidence_id").alias("e")
    )
    table_assets = evidence.filter("kind = 'table' AND asset_path IS NOT NULL").select("document_id", F.col("asset_path").alias("path"))
    left = images.join(table_assets, ["document_id", "path"], "left_anti")
    return left.join(by_path, ["document_id", "path"], "left").select("document_id", "path", "e.evidence_id", "e.page")


def structure_tasks(images: DataFrame, evidence: DataFrame, templates=TEMPLATES) -> DataFrame:
    rows = image_to_evidence(images, evidence)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.withColumn("_context", F.concat(name, F.coalesce(F.concat(F.lit("; page "), F.col("page").cast("string")), F.lit(""))))
    image = F.array(F.struct("path", "evidence_id", F.col("_context").alias("context")))
    prompt = render_prompt("structure", {"<<IMAGE_CONTEXT>>": F.col("_context")}, templates)
    return _task(rows, "structure", "path", prompt, None, images=image, evidence_ids=F.array_compact(F.array("evidence_id")))


def fallback_tasks(documents: DataFrame, text: DataFrame, tables: DataFrame, max_chars: int = MAX_TEXT_CHARS, templates=TEMPLATES) -> DataFrame:
    """Documents without text tasks get one for each part of the whole text, without table tasks one per markdown table."""
    bare = documents.join(text.select("document_id").distinct(), "document_id", "left_anti").filter(strip("markdown") != "")
    bare = text_parts(bare, "markdown", max_chars, "document_id")
    whole = _task(
        bare, "text", "_key",
        render_prompt("text", {"<<PAGE_CONTEXT>>": F.lit("document"), "<<CONTENT>>": F.col("_content")}, templates), "_content",
    )
    found = markdown_tables(documents.join(tables.select("document_id").distinct(), "document_id", "left_anti"))
    key = F.concat(F.lit("markdown:"), F.col("table_number").cast("string"))
    prompt = render_prompt("table", {"<<PAGE_CONTEXT>>": F.lit("markdown table"), "<<CONTENT>>": F.col("text")}, templates)
    return whole.unionByName(_task(found, "table", key, prompt, "text"))


def adjudication_tasks(records: DataFrame, evidence: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Records that need review and have no error issue, with the record and its evidence as JSON."""
    open_records = records.filter(
        (F.col("review_status") == "needs_review") & ~F.exists("issues", lambda i: i["severity"] == "error")
    )
    found = record_evidence(open_records, evidence)
    body = F.struct(*[c for c in records.columns if c != "document_id"])
    rows = open_records.join(found, IDS, "left").select(
        *IDS, "evidence_ids", F.to_json(body).alias("_record"), F.coalesce(F.to_json("evidence"), F.lit("[]")).alias("_evidence")
    )
    text = F.concat(F.lit('{"evidence":'), "_evidence", F.lit(',"record":'), "_record", F.lit("}"))
    prompt = render_prompt("adjudicate", {"<<RECORD>>": F.col("_record"), "<<EVIDENCE>>": F.col("_evidence")}, templates)
    return _task(
        rows, "adjudication", "reaction_id", prompt, text, evidence_ids=F.col("evidence_ids"),
        artifacts=("assembly/records.jsonl", "document.json"),
    )


def extraction_tasks(documents: DataFrame, evidence: DataFrame, images: DataFrame, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    text, tables = text_tasks(evidence, max_chars), table_tasks(evidence)
    return union_all(text, tables, structure_tasks(images, evidence), fallback_tasks(documents, text, tables, max_chars))
