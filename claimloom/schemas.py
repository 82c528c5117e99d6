"""Column layouts of the tables this package reads and writes.

Schemas are always given, never inferred.  Every table carries ``document_id``;
ids are unique only inside one document.
"""

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
_STRINGS = T.ArrayType(_S)


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


COMPOUND = _struct(label=_S, name=_S, smiles=_S, role=_S)
ISSUE = _struct(code=_S, severity=_S, target_id=_S, message=_S, suggested_value=_S)
COMPOUNDS = T.ArrayType(COMPOUND)
ISSUES = T.ArrayType(ISSUE)

EVIDENCE = _struct(
    document_id=_S, evidence_id=_S, kind=_S, page=_I, source_path=_S,
    asset_path=_S, text=_S, bbox=T.ArrayType(_D),
)
REACTION_CANDIDATE = _struct(
    document_id=_S, candidate_id=_S, ord=_L, source=_S, reactants=COMPOUNDS,
    products=COMPOUNDS, reagents=_STRINGS, solvents=_STRINGS, temperature_c=_D,
    time=_S, yield_pct=_D, evidence_ids=_STRINGS, confidence=_D,
)
STRUCTURE_CANDIDATE = _struct(
    document_id=_S, candidate_id=_S, ord=_L, compound_label=_S, smiles=_S,
    evidence_ids=_STRINGS, confidence=_D,
)
RECORD_BODY = _struct(
    schema_version=_S, reaction_id=_S, reactants=COMPOUNDS, products=COMPOUNDS,
    reagents=_STRINGS, solvents=_STRINGS, temperature_c=_D, time=_S,
    yield_pct=_D, evidence_ids=_STRINGS, confidence=_D, review_status=_S,
    issues=ISSUES,
)
RECORD = T.StructType([T.StructField("document_id", _S)] + RECORD_BODY.fields)
DECISION = _struct(
    document_id=_S, ord=_L, decision_id=_S, reaction_id=_S, target_kind=_S,
    target_id=_S, conclusion=_S, reason=_S, reviewer=_S, record_hash=_S,
    created_at=_S,
)
OPERATION = _struct(
    document_id=_S, submission_id=_S, ord=_L, reaction_id=_S, target_kind=_S,
    target_id=_S, op=_S, path=_S, old_value=_S, new_value=_S, reason=_S,
    evidence_ids=_STRINGS,
)
PRODUCER = _struct(
    kind=_S, client_name=_S, client_version=_S, model=_S, policy=_S, attempt=_I,
)
TASK_STATE = _struct(
    document_id=_S, task_id=_S, kind=_S, status=_S, submission_hash=_S,
    producer=PRODUCER,
)
PLAN = _struct(
    channel=_S, kind=_S, model=_S, provider=_S, policy=_S, fallbacks=_STRINGS,
)
STRUCTURE_DICTIONARY = _struct(raw=_S, iso=_S, noniso=_S, n_unspecified=_I, ok=T.BooleanType())

# The allowed sets of the enumerated columns.
REVIEW_STATUSES = ("accepted", "needs_review", "rejected")
HUMAN_STATUSES = ("unreviewed", "in_review", "confirmed", "pending", "rejected")
RUN_STATUSES = (
    "running", "awaiting_input", "ready", "success", "completed_empty",
    "partial", "failed", "cancelled",
)
CHANNELS = ("text", "table", "structure", "adjudication")
SOURCES = ("text", "table", "scheme")
SEVERITIES = ("info", "warning", "error")
COMPOUND_ROLES = ("reactant", "product", "reagent", "unknown")
PARTICIPANT_ROLES = ("reactant", "product", "reagent", "catalyst", "ligand", "solvent", "additive", "unknown")
STRUCTURE_STATES = ("resolved", "unresolved", "not_attempted")
CONDITION_KINDS = (
    "temperature", "time", "yield", "reagent", "solvent", "amount", "equivalents", "concentration", "catalyst_loading", "atmosphere",
    "pressure", "addition_order", "stage", "light", "electrochemistry", "workup", "ee", "er", "dr", "other",
)
EXTRACTION_STATES = ("extracted", "not_reported_in_output", "not_covered_by_pipeline")
TARGET_KINDS = (
    "reaction", "condition", "participant_identity", "participant_structure",
    "stereo", "gold_alignment", "completeness",
)
CONCLUSIONS = (
    "confirmed", "revised", "pending", "not_applicable", "rejected",
    "insufficient_evidence",
)
REASON_REQUIRED = ("pending", "not_applicable", "insufficient_evidence")
OPERATIONS = (
    "set_value", "confirm", "mark_pending", "mark_not_applicable", "reject",
    "add_participant", "remove_participant", "change_role",
)
EDITABLE_ROOTS = (
    "reactants", "products", "reagents", "solvents", "temperature_c", "time",
    "yield_pct", "review_status",
)
