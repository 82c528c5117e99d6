"""Row constraints as data: types, bounds, allowed sets, required values.

One table of fields per row type. ``line_errors`` compiles it to one expression over a parsed JSON value, before typing,
nested rows included; ``row_errors`` to one over typed columns. A field gives at most one error.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions.text import blank_to_null
from ..schemas import (
    COMPOUND_ROLES, CONCLUSIONS, CONDITION_KINDS, EXTRACTION_STATES, OPERATIONS, PARTICIPANT_ROLES, REASON_REQUIRED, REVIEW_STATUSES, SEVERITIES,
    SOURCES, STRUCTURE_STATES, TARGET_KINDS,
)


class Field(NamedTuple):
    name: str
    kind: str = "text"  # text, number, whole, texts, any, or rows of another layout
    required: bool = False  # present and not null
    nullable: bool = True  # a JSON null may stand for a missing value
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] | None = None
    filled: bool = False  # more than blanks
    rows: str | None = None


class When(NamedTuple):
    """``name`` must be given where ``column`` has one of ``values``."""

    name: str
    column: str
    values: tuple[str, ...]


def _texts(*names: str) -> list[Field]:
    return [Field(n, "texts", nullable=False) for n in names]


def _share(name: str, high: float, **more) -> Field:
    return Field(name, "number", low=0, high=high, **more)


_VERSION = Field("schema_version", nullable=False, allowed=("1.0",))
_SIDES = [Field(n, "rows", nullable=False, rows="compound") for n in ("reactants", "products")]
_CONDITIONS = [Field("temperature_c", "number"), Field("time"), _share("yield_pct", 100)]

# The fields of each row type.
LAYOUTS: dict[str, list[Field]] = {
    "compound": [Field("label", "any"), Field("name", "any"), Field("smiles", "any"), Field("role", nullable=False, allowed=COMPOUND_ROLES)],
    "issue": [
        Field("code", required=True), Field("severity", required=True, allowed=SEVERITIES), Field("target_id", required=True),
        Field("message", required=True), Field("suggested_value"),
    ],
    "reaction_candidate": [
        Field("candidate_id", required=True), Field("source", required=True, allowed=SOURCES), *_SIDES, *_texts("reagents", "solvents"),
        *_CONDITIONS, *_texts("evidence_ids"), _share("confidence", 1, nullable=False),
    ],
    "structure_candidate": [
        Field("candidate_id", required=True), Field("compound_label"), Field("smiles", required=True, filled=True), *_texts("evidence_ids"),
        _share("confidence", 1, nullable=False),
    ],
    "record": [
        _VERSION, Field("reaction_id", required=True), *_SIDES, *_texts("reagents", "solvents"), *_CONDITIONS, *_texts("evidence_ids"),
        _share("confidence", 1, required=True), Field("review_status", required=True, allowed=REVIEW_STATUSES),
        Field("issues", "rows", nullable=False, rows="issue"),
    ],
    "participant": [
        _VERSION, Field("participant_id", required=True), Field("role", required=True, allowed=PARTICIPANT_ROLES), Field("label"), Field("name"),
        Field("smiles"), Field("structure_state", nullable=False, allowed=STRUCTURE_STATES), *_texts("candidate_ids", "evidence_ids", "field_evidence_ids"),
    ],
    "condition": [
        _VERSION, Field("condition_id", required=True), Field("kind", required=True, allowed=CONDITION_KINDS), Field("value"),
        Field("numeric_value", "number"), Field("unit"), Field("stage_index", "whole"),
        Field("extraction_state", nullable=False, allowed=EXTRACTION_STATES), *_texts("evidence_ids", "field_evidence_ids"),
    ],
    "context": [
        _VERSION, Field("reaction_id", required=True), Field("record_hash", required=True), Field("participants", "rows", nullable=False, rows="participant"),
        Field("conditions", "rows", nullable=False, rows="condition"), Field("stage_count", "whole", nullable=False, low=0),
        *_texts("reaction_evidence_ids"), Field("context_schema_note"),
    ],
    "decision": [
        _VERSION, Field("decision_id", required=True), Field("reaction_id", required=True), Field("target_kind", required=True, allowed=TARGET_KINDS),
        Field("target_id", required=True), Field("conclusion", required=True, allowed=CONCLUSIONS), Field("reason"),
        Field("reviewer", required=True, filled=True), Field("record_hash", required=True), Field("created_at", required=True),
    ],
    "operation": [
        Field("reaction_id", required=True), Field("target_kind", required=True, allowed=TARGET_KINDS), Field("target_id", required=True),
        Field("op", required=True, allowed=OPERATIONS), Field("path"), Field("old_value", "any"), Field("new_value", "any"), Field("reason"),
        *_texts("evidence_ids"),
    ],
    "package": [
        _VERSION, Field("submission_id", required=True), Field("base_record_hashes", "any"), Field("operations", "rows", nullable=False, rows="operation"),
        Field("reviewer", required=True, filled=True), Field("created_at", required=True),
    ],
}
REQUIRED_WHEN = {"decision": [When("reason", "conclusion", REASON_REQUIRED)]}


def _span(field: Field) -> str:
    return f" outside {field.low:g}..{field.high:g}" if field.high is not None else f" below {field.low:g}"


def _claim(field: Field) -> str:
    """What an error of the field says after its path."""
    if field.allowed:
        return f" must be {field.allowed[0]}" if len(field.allowed) == 1 else " not allowed"
    if field.low is not None:
        return _span(field)
    if field.filled:
        return " must be non-empty"
    kinds = {"text": "a string", "number": "a number", "whole": "a whole number", "texts": "an array", "rows": "an array", "any": "given"}
    return f" must be {kinds[field.kind]}"


def _no(test) -> Column:
    return ~F.coalesce(test, F.lit(False))


def _fits(field: Field, x: Column) -> Column:
    """Whether a JSON value that is not null has the field's type, bounds and set. Numbers may be written as text."""
    number = F.try_variant_get(x, F.lit("$"), "double")
    if field.allowed:
        return V.is_text(x) & V.text_of(x).isin(*field.allowed)
    if field.filled:
        return V.is_text(x) & blank_to_null(V.text_of(x)).isNotNull()
    if field.kind in ("number", "whole"):
        fits = (V.is_number(x) | V.is_text(x)) & number.isNotNull()
        if field.kind == "whole":
            fits = fits & (number == F.floor(number))
        if field.low is not None:
            fits = fits & (number >= field.low)
        return fits & (number <= field.high) if field.high is not None else fits
    if field.kind in ("texts", "rows"):
        return V.as_array(x).isNotNull()
    return V.is_text(x) if field.kind == "text" else F.lit(True)


def _text_error(here: Column):
    return lambda e, j: F.when(~V.is_text(e), F.concat(here, j.cast("string"), F.lit("] must be a string")))


def _inner_errors(layout: str, here: Column):
    return lambda e, j: line_errors(e, layout, F.concat(here, j.cast("string"), F.lit("]")))


def line_errors(v, layout: str, path: Column | None = None) -> Column:
    """All errors of one JSON value as an array of texts, each starting with the path of its field."""
    v = F.col(v) if isinstance(v, str) else v
    say = (lambda text: F.lit(text)) if path is None else (lambda text: F.concat(path, F.lit(f".{text}")))
    fields = LAYOUTS[layout]
    row = V.as_map(v)
    extra = F.array_sort(F.array_except(F.map_keys(row), F.array(*[F.lit(f.name) for f in fields])))
    no_object = F.array(F.lit("expected JSON object") if path is None else F.concat(path, F.lit(" must be an object")))
    unknown = F.lit("unknown fields ") if path is None else F.concat(path, F.lit(" has unknown fields "))
    checks = [F.when(F.size(extra) > 0, F.concat(unknown, F.array_join(extra, ", ")))]
    nested = []
    for f in fields:
        x = V.get(v, f.name)
        missing, null = x.isNull(), x.isNotNull() & F.is_variant_null(x)
        bad = x.isNotNull() & ~F.is_variant_null(x) & _no(_fits(f, x))
        if f.required:
            bad = bad | missing | null
        elif not f.nullable:
            bad = bad | null
        checks.append(F.when(F.coalesce(bad, F.lit(False)), say(f.name + _claim(f))))
        here = say(f.name + "[")
        if f.kind == "texts":
            nested.append(F.array_compact(F.transform(V.as_array(x), _text_error(here))))
        elif f.kind == "rows":
            nested.append(F.flatten(F.transform(V.as_array(x), _inner_errors(f.rows, here))))
    for w in REQUIRED_WHEN.get(layout, []):
        x = V.get(v, w.name)
        bad = V.text_of(V.get(v, w.column)).isin(*w.values) & (V.is_null(x) | (V.text_of(x) == ""))
        checks.append(F.when(F.coalesce(bad, F.lit(False)), say(f"{w.name} is required")))
    none = F.array().cast("array<string>")
    return F.when(row.isNull(), no_object).otherwise(F.concat(F.array_compact(F.array(*checks)), *[F.coalesce(n, none) for n in nested]))


def _row_checks(get, layout: str, columns, path: Column) -> list[Column]:
    """Errors of typed values; fields that the table does not carry are not checked."""
    say = lambda *parts: F.concat(path, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    checks = []
    for f in LAYOUTS[layout]:
        if f.name not in columns:
            continue
        x, bad = get(f.name), F.lit(False)
        if f.allowed:
            bad = x.isNotNull() & ~x.isin(*f.allowed)
        elif f.filled:
            bad = x.isNotNull() & blank_to_null(x).isNull()
        elif f.low is not None:
            bad = (x < f.low) | (x > f.high) if f.high is not None else x < f.low
        elif f.kind == "texts":
            bad = F.exists(x, lambda e: e.isNull())
        if f.required or not f.nullable:
            bad = bad | x.isNull()
        checks.append(F.when(F.coalesce(bad, F.lit(False)), say(f.name + (" holds a null" if f.kind == "texts" else _claim(f)))))
    for w in REQUIRED_WHEN.get(layout, []):
        if w.name in columns and w.column in columns:
            bad = get(w.column).isin(*w.values) & (F.coalesce(get(w.name), F.lit("")) == "")
            checks.append(F.when(F.coalesce(bad, F.lit(False)), say(f"{w.name} is required")))
    return checks


def _inner_row_errors(f: Field, columns):
    def errors(e, j):
        at = F.concat(F.lit(f"{f.name}["), j.cast("string"), F.lit("]."))
        return F.array_compact(F.array(*_row_checks(lambda n: e[n], f.rows, columns, at)))

    return errors


def row_errors(rows: DataFrame, layout: str, key) -> DataFrame:
    """(key columns, error) of typed rows, one row per error; rows inside rows are checked too."""
    found = [F.array_compact(F.array(*_row_checks(F.col, layout, rows.columns, F.lit(""))))]
    for f in LAYOUTS[layout]:
        if f.kind == "rows" and f.name in rows.columns:
            errors = _inner_row_errors(f, rows.schema[f.name].dataType.elementType.names)
            found.append(F.coalesce(F.flatten(F.transform(f.name, errors)), F.array().cast("array<string>")))
    return rows.select(*key, F.explode(F.concat(*found)).alias("error"))
