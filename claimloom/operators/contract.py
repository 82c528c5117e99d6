"""Checks on submitted JSON and on typed rows; one output row per error."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions.text import blank_to_null
from .constraints import line_errors, row_errors

# The fields of a producer block and the keys a structure label may have.
PRODUCER_TEXT_FIELDS = ("client_name", "client_version", "model", "policy")
PRODUCER_FIELDS = ("kind", *PRODUCER_TEXT_FIELDS, "attempt")
PRODUCER_KINDS = ("human", "host_agent")
LABEL_KEYS = ("compound_label", "label", "compound_id")


def _has(v, key) -> Column:
    return V.get(v, key).isNotNull()


def _when(test, message) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(test, F.lit(False)), message)


def has_key_anywhere(v, key: str) -> Column:
    """The key occurs at any depth; a quoted mention inside a text value does not count."""
    return F.coalesce(F.to_json(v).rlike(rf'(?<!\\)"{key}":'), F.lit(False))


def has_key_on_top(v, key: str) -> Column:
    return _has(v, key)


def _text_key(v, key) -> list[Column]:
    return [
        _when(~_has(v, key), f"missing '{key}'"),
        _when(_has(v, key) & ~V.is_text(V.get(v, key)), f"'{key}' must be a string"),
    ]


def _producer(v) -> list[Column]:
    p = V.get(v, "producer")
    is_block = V.is_object(p)
    kind = V.text_of(V.get(p, "kind"))
    unknown = F.array_except(F.map_keys(V.as_map(p)), F.array(*[F.lit(f) for f in PRODUCER_FIELDS]))
    attempt = V.get(p, "attempt")
    whole = F.coalesce(F.schema_of_variant(attempt) == "BIGINT", F.lit(False))
    return [
        _when(~is_block, "missing or invalid 'producer' block"),
        _when(is_block & ~F.coalesce(kind.isin(*PRODUCER_KINDS), F.lit(False)), "'producer.kind' must be 'human' or 'host_agent'"),
        _when(is_block & (F.size(unknown) > 0), F.concat(F.lit("unknown producer fields "), F.array_join(F.array_sort(unknown), ", "))),
        *[
            _when(is_block & ~V.is_null(V.get(p, f)) & ~V.is_text(V.get(p, f)), f"'producer.{f}' must be a string")
            for f in PRODUCER_TEXT_FIELDS
        ],
        _when(
            is_block & ~V.is_null(attempt) & ~(whole & F.coalesce(F.try_variant_get(attempt, F.lit("$"), "long") >= 1, F.lit(False))),
            "'producer.attempt' must be an integer >= 1",
        ),
    ]


def _out_of_range(v, low, high) -> Column:
    return V.is_number(v) & ~F.try_variant_get(v, F.lit("$"), "double").between(low, high)


def _output_errors(out: Column, at: Column) -> Column:
    """Errors of one element of ``outputs`` as an array of texts."""
    path = F.concat(F.lit("outputs["), at.cast("string"), F.lit("]"))
    say = lambda *parts: F.concat(path, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    is_row = V.is_object(out)
    reaction = is_row & (_has(out, "reactants") | _has(out, "products"))
    checks = [_when(~is_row, say(" must be an object"))]
    nested = []

    def compound_errors(name):
        def errors(c, j):
            here = lambda text: say(f".{name}[", j.cast("string"), text)
            missing = [_when(V.is_object(c) & ~_has(c, f), here(f"] missing '{f}'")) for f in ("label", "smiles", "role")]
            return F.array_compact(F.array(_when(~V.is_object(c), here("] must be an object")), *missing))
        return F.flatten(F.transform(V.as_array(V.get(out, name)), errors))

    def text_errors(name):
        def error(x, j):
            return _when(~V.is_text(x), say(f".{name}[", j.cast("string"), "] must be a string"))
        return F.when(reaction, F.array_compact(F.transform(V.as_array(V.get(out, name)), error)))

    for name in ("reactants", "products", "reagents", "solvents"):
        value = V.get(out, name)
        checks.append(_when(reaction & ~V.is_null(value) & ~V.is_array(value), say(f".{name} must be an array")))
        nested.append(compound_errors(name) if name in ("reactants", "products") else text_errors(name))
    checks.append(_when(reaction & _out_of_range(V.get(out, "yield_pct", "yield"), 0, 100), say(".yield_pct is outside 0..100")))
    structure = is_row & ~reaction
    labelled = _has(out, LABEL_KEYS[0]) | _has(out, LABEL_KEYS[1]) | _has(out, LABEL_KEYS[2])
    smiles = V.get(out, "smiles", "canonical_smiles")
    good_smiles = V.is_text(smiles) & blank_to_null(V.text_of(smiles)).isNotNull()
    checks.append(_when(structure & ~labelled, say(" missing a label key")))
    checks.append(_when(structure & ~good_smiles, say(".smiles must be a non-empty string")))
    checks.append(_when(is_row & _out_of_range(V.get(out, "confidence"), 0, 1), say(".confidence is outside 0..1")))
    none = F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*checks)), *[F.coalesce(n, none) for n in nested])


def submission_contract(rows: DataFrame, kind: str = "candidates", column: str = "value") -> DataFrame:
    """Parsed lines (VARIANT ``value``) -> one row per error, with the line's other columns."""
    v = F.col(column)
    if kind == "candidates":
        outputs = V.get(v, "outputs")
        per_output = F.flatten(F.transform(V.as_array(outputs), _output_errors))
        checks = [*_text_key(v, "task_id"), *_producer(v), _when(F.coalesce(F.size(V.as_array(outputs)), F.lit(0)) <= 0, "'outputs' must be a non-empty array")]
    else:
        per_output = None
        decision, rationale = V.text_of(V.get(v, "decision")), V.get(v, "rationale")
        checks = [
            *_text_key(v, "task_id"), *_text_key(v, "reaction_id"),
            _when(~F.coalesce(decision.isin("accept", "keep_review"), F.lit(False)), "'decision' must be 'accept' or 'keep_review'"),
            _when(~V.is_null(rationale) & ~V.is_text(rationale), "'rationale' must be a string"), *_producer(v),
        ]
    checks.append(_when(has_key_anywhere(v, "candidate_id"), "forbidden key 'candidate_id'"))
    found = F.array_compact(F.array(*checks))
    if per_output is not None:
        found = F.concat(found, F.coalesce(per_output, F.array().cast("array<string>")))
    kept = [c for c in rows.columns if c != column]
    return rows.select(*kept, F.explode(found).alias("error"))


def forbid_key(rows: DataFrame, key: str = "candidate_id", column: str = "value", anywhere: bool = True) -> DataFrame:
    test = has_key_anywhere(F.col(column), key) if anywhere else has_key_on_top(F.col(column), key)
    return rows.filter(test)


def unknown_keys(v, allowed) -> Column:
    return F.array_sort(F.array_except(F.map_keys(V.as_map(v)), F.array(*[F.lit(a) for a in allowed])))


# --- checks by row type ---------------------------------------------------------

def record_domain_checks(records: DataFrame) -> DataFrame:
    """Bounds and allowed values of records."""
    return row_errors(records, "record", ["document_id", "reaction_id"])


def decision_domain_checks(decisions: DataFrame) -> DataFrame:
    """Allowed values, reviewer present, reason present where the conclusion asks for one."""
    return row_errors(decisions, "decision", ["document_id", "decision_id"])


def record_line_errors(v) -> Column:
    """All errors of one record given as JSON, nested rows included, as an array of texts."""
    # Inside a lambda the many small checks are walked one by one; as one generated method they would be too long to compile.
    return F.flatten(F.transform(F.array(v), lambda row: line_errors(row, "record")))
