"""Validation rules.  Each turns a table into issue rows.

Issue rows: document_id, code, severity, target_id, message, stage, ord.  ``stage``
and ``ord`` give the order issues are listed in.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import empty_to_null, normalize_label
from .ranking import smallest_values, union_all

ISSUE_COLUMNS = ("document_id", "code", "severity", "target_id", "message", "stage", "ord")


def issue(code: str, severity: str, message) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def missing_parts(reactants, products, evidence_ids) -> Column:
    """Issues of one candidate row as an array (null entries removed)."""
    checks = F.array(
        F.when(F.size(reactants) == 0, issue("R001_REACTANT_MISSING", "error", "Reaction has no reactant")),
        F.when(F.size(products) == 0, issue("R002_PRODUCT_MISSING", "error", "Reaction has no product")),
        F.when(
            F.size(evidence_ids) == 0,
            issue("R003_EVIDENCE_MISSING", "warning", "Reaction has no traceable evidence reference"),
        ),
    )
    return F.array_compact(checks)


def completeness_rules(candidates: DataFrame) -> DataFrame:
    found = candidates.select(
        "document_id", F.col("candidate_id").alias("target_id"), "ord",
        F.posexplode(missing_parts("reactants", "products", "evidence_ids")).alias("stage", "i"),
    )
    return found.select("document_id", "i.code", "i.severity", "target_id", "i.message", "stage", "ord")


def _structure_issue(rows: DataFrame, stage: int, code: str, severity: str, message) -> DataFrame:
    found = issue(code, severity, message)
    return rows.select(
        "document_id", found["code"].alias("code"), found["severity"].alias("severity"),
        F.col("candidate_id").alias("target_id"), found["message"].alias("message"),
        F.lit(stage).alias("stage"), "ord",
    )


def parse_failed_rule(structures: DataFrame) -> DataFrame:
    bad = structures.filter(F.col("canonical").isNull())
    return _structure_issue(
        bad, 3, "V001_SMILES_PARSE_FAILED", "error", F.concat(F.lit("Invalid SMILES: "), F.col("smiles"))
    )


def unspecified_stereo_rule(structures: DataFrame) -> DataFrame:
    open_centres = structures.filter(F.col("canonical").isNotNull() & (F.col("n_unspecified") > 0))
    return _structure_issue(
        open_centres, 4, "V003_STEREO_UNSPECIFIED", "warning", "Potential stereocenter is not fully specified"
    )


def label_index(structures: DataFrame) -> DataFrame:
    """(document, label) -> structure if there is exactly one, candidate counts.

    Only parsed structures with a label.  Distinctness is min against max, so the
    group never gathers its values and combines on the map side.
    """
    parsed = structures.filter(F.col("canonical").isNotNull()).withColumn(
        "label_key", normalize_label("compound_label")
    )
    return (
        parsed.filter(F.col("label_key") != "")
        .groupBy("document_id", "label_key")
        .agg(
            F.min("canonical").alias("_low"), F.max("canonical").alias("_high"),
            F.count("*").alias("n_candidates"), F.min("candidate_id").alias("only_candidate"),
            F.count_if(F.col("n_unspecified") > 0).alias("n_open_stereo"),
        )
        .select(
            "document_id", "label_key", "n_candidates", "n_open_stereo",
            F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("label_structure"),
            (F.col("_low") != F.col("_high")).alias("conflict"),
            F.when(F.col("n_candidates") == 1, F.col("only_candidate")).alias("only_candidate"),
        )
    )


def label_conflict_rule(structures: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One issue on each candidate whose label stands for several structures."""
    index = index if index is not None else label_index(structures)
    bad_labels = index.filter("conflict").select("document_id", "label_key")
    parsed = structures.filter(F.col("canonical").isNotNull()).withColumn(
        "label_key", normalize_label("compound_label")
    )
    message = F.concat(F.lit("Label "), F.col("label_key"), F.lit(" maps to multiple structures"))
    return _structure_issue(
        parsed.join(bad_labels, ["document_id", "label_key"]), 5, "V005_LABEL_STRUCTURE_CONFLICT", "error", message
    )


def quoted_list(texts: Column) -> Column:
    """['a', 'b'] as shown in issue messages."""
    return F.concat(F.lit("['"), F.array_join(texts, "', '"), F.lit("']"))


def listed_text(values, n) -> Column:
    """The list as shown in messages, with a count of what it leaves out."""
    left = F.col(n) - F.size(values)
    return F.concat(quoted_list(F.col(values)), F.when(left > 0, F.concat(F.lit(" and "), left.cast("string"), F.lit(" more"))).otherwise(""))


def collapse_rule(structures: DataFrame) -> DataFrame:
    """One issue per structure that stands behind several labels, on its first candidate; its message names the first
    LISTED labels and counts the others."""
    parsed = structures.filter(F.col("canonical").isNotNull())
    labels = (
        parsed.select("document_id", "canonical", normalize_label("compound_label").alias("label_key"))
        .filter(F.col("label_key") != "").distinct()
    )
    listed = smallest_values(labels, ["document_id", "canonical"], "label_key").filter("n > 1")
    first = parsed.groupBy("document_id", "canonical").agg(
        F.min_by("candidate_id", "ord").alias("candidate_id"), F.min("ord").alias("ord")
    )
    message = F.concat(F.lit("One structure maps to labels "), listed_text("values", "n"))
    return _structure_issue(
        first.join(listed, ["document_id", "canonical"]), 6, "V007_STRUCTURE_COLLAPSE", "warning", message
    )


def structure_rules(structures: DataFrame, parsed_only: bool = False) -> DataFrame:
    rules = [unspecified_stereo_rule(structures), label_conflict_rule(structures), collapse_rule(structures)]
    return union_all(*rules) if parsed_only else union_all(parse_failed_rule(structures), *rules)


def unique_issues(issues: DataFrame, owner=("document_id",)) -> DataFrame:
    """Distinct on (code, target_id, message) per owner: first place, last value."""
    keys = [*owner, "code", "target_id", "message"]
    rest = [c for c in issues.columns if c not in keys and c not in ("stage", "ord")]
    place = F.struct("stage", "ord")
    rows = issues.groupBy(*keys).agg(
        F.min(place).alias("_place"), *[F.max_by(c, place).alias(c) for c in rest]
    )
    return rows.select(*keys, *rest, "_place.stage", "_place.ord").select(*issues.columns)


def validate(candidates: DataFrame, structures: DataFrame) -> DataFrame:
    """All rules over both tables (``structures`` already canonicalised)."""
    return unique_issues(union_all(completeness_rules(candidates), structure_rules(structures)))


def blank_label_to_unlabelled(label) -> Column:
    return F.coalesce(empty_to_null(label), F.lit("unlabelled"))
