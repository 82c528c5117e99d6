"""Raw answers -> JSON payloads -> candidate rows."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions.ids import stable_id
from ..functions.text import bounded_percent, strip


def parse_model_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Add ``payload`` (VARIANT) and ``error``.

    Thinking spans and code fences go first.  A text that starts with a bracket, or
    else what follows the first bracket, is read up to the end of its first value.
    """
    clean = strip(F.regexp_replace(column, r"(?s)<(?:thinking|think)>.*?</(?:thinking|think)>", ""))
    fenced = F.regexp_replace(F.regexp_replace(clean, r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    rows = answers.withColumn("_text", F.when(clean.startswith("```"), fenced).otherwise(clean))
    brackets = F.array_min(F.filter(F.array(F.instr("_text", "{"), F.instr("_text", "[")), lambda p: p > 0))
    rows = rows.withColumn("_start", brackets)
    found = F.try_parse_json(F.substring(F.col("_text"), F.col("_start"), F.length("_text")))
    whole = F.when(F.coalesce("_start", F.lit(2)) != 1, V.parse_strict("_text"))
    rows = rows.withColumn("payload", F.coalesce(whole, found))
    error = F.when(
        F.col("payload").isNull(),
        F.when(F.col("_start").isNull(), "answer did not contain JSON").otherwise("answer contained incomplete or malformed JSON"),
    )
    return rows.withColumn("error", error).drop("_text", "_start")


def _rows(payloads: DataFrame, wrappers, row_column="row") -> DataFrame:
    rows = V.payload_rows("payload", *wrappers) if wrappers else V.as_array("payload")
    kept = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*kept, F.posexplode(rows).alias("row_number", row_column))


def _confidence(value) -> Column:
    return F.coalesce(V.number_value(value), F.lit(0.5))


def row_confidence(row) -> Column:
    return V.let(V.get(row, "confidence"), _confidence)


def structure_smiles(row) -> Column:
    return strip(V.first_truthy(row, "smiles", "canonical_smiles"))


def valid_row(row, structure: Column) -> Column:
    """Whether ``reaction_candidates``, or ``structure_candidates`` where ``structure`` holds, keep this value as a row."""
    kept = row_confidence(row).between(0, 1) & (~structure | F.coalesce(structure_smiles(row) != "", F.lit(False)))
    return F.when(V.is_object(row), F.coalesce(kept, F.lit(False))).otherwise(F.lit(False))


def reaction_candidates(payloads: DataFrame, unwrap: bool = True) -> DataFrame:
    """Payload rows (payload, source, evidence_ids) -> normalised reaction candidates.

    Keys may vary; the first that exists is taken.  Rows with a confidence outside
    0..1 are dropped, yields outside 0..100 become null.
    """
    rows = _rows(payloads, ("reactions", "data") if unwrap else ())
    spelled = {
        "reactants": ("reactants", "substrates", "starting_materials"), "products": ("products", "product"),
        "reagents": ("reagents", "catalysts"), "solvents": ("solvents", "solvent"),
        "temperature_c": ("temperature_c", "temperature"), "time": ("time", "reaction_time"),
        "yield_pct": ("yield_pct", "yield"), "confidence": ("confidence",),
    }
    found = V.once(V.fields("row", *[key for keys in spelled.values() for key in keys]), "_found")
    rows = rows.select(*[c for c in rows.columns if c != "row"], found).filter(F.col("_found").isNotNull())
    values = [V.first(F.col("_found"), *keys).alias(f"_{name}") for name, keys in spelled.items()]
    rows = rows.select(*[c for c in rows.columns if c != "_found"], *values)
    rows = rows.select("*", V.once(_confidence("_confidence"), "confidence")).filter(F.col("confidence").between(0, 1))
    evidence = F.array_sort(F.array_distinct("evidence_ids"))
    raw = [V.text_of(f"_{n}") for n in spelled if n != "confidence"]
    kept = [c for c in payloads.columns if c not in ("payload", "source", "evidence_ids")]
    return rows.select(
        *kept, "row_number",
        stable_id(F.col("source"), *raw, F.array_join(evidence, "\u001d")).alias("candidate_id"), "source",
        V.compound_refs("_reactants", "reactant").alias("reactants"), V.compound_refs("_products", "product").alias("products"),
        V.string_list("_reagents").alias("reagents"), V.string_list("_solvents").alias("solvents"),
        V.number_value("_temperature_c").alias("temperature_c"), strip(V.truthy_text("_time")).alias("time"),
        bounded_percent(V.number_value("_yield_pct")).alias("yield_pct"), evidence.alias("evidence_ids"), "confidence",
    )


def structure_candidates(payloads: DataFrame, unwrap: bool = True) -> DataFrame:
    """Payload rows (payload, evidence_ids) -> normalised structure candidates."""
    rows = _rows(payloads, ("structures", "candidates") if unwrap else ()).filter(V.is_object("row"))
    smiles = structure_smiles("row")
    label = F.coalesce(
        V.first_truthy("row", "compound_label", "label"), V.text_of(V.get("row", "compound_id")),
    )
    evidence = F.array_sort(F.array_distinct("evidence_ids"))
    kept = [c for c in payloads.columns if c not in ("payload", "source", "evidence_ids")]
    out = rows.select(
        *kept, "row_number", stable_id("structure", label, smiles, F.array_join(evidence, "\u001d")).alias("candidate_id"),
        strip(label).alias("compound_label"), smiles.alias("smiles"), evidence.alias("evidence_ids"),
        row_confidence("row").alias("confidence"),
    )
    return out.filter((F.col("smiles") != "") & F.col("confidence").between(0, 1))
