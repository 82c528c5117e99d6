"""Review tables: contexts, decisions, statuses, evidence lookups and the queue."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import record_hash
from ..functions.text import (
    condition_field_path, condition_summary, display_names, empty_to_null, normalize_label,
    participant_field_path,
)
from ..schemas import RECORD_BODY
from .ranking import keep_first, keep_last, spread_key, union_all

IDS = ["document_id", "reaction_id"]
NO_FIELD_EVIDENCE = "field-level evidence unavailable; reaction-level reference only"
LEGACY_NOTE = "legacy run: reaction-level reference only"


def with_record_hash(records: DataFrame) -> DataFrame:
    fields = [F.col(f.name) for f in RECORD_BODY.fields if f.name in records.columns]
    return records.withColumn("record_hash", record_hash(fields))


# --- evidence and structure lookups ---------------------------------------------

def used_evidence(records: DataFrame) -> DataFrame:
    return records.select("document_id", F.explode("evidence_ids").alias("evidence_id")).distinct()


def resolve_evidence(records: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence rows that records refer to, ids they refer to that do not exist)."""
    used = used_evidence(records)
    keys = ["document_id", "evidence_id"]
    return evidence.join(used, keys, "left_semi"), used.join(evidence, keys, "left_anti")


def record_evidence_rows(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per record and existing evidence id, with the id's place in the record."""
    ids = records.select(*IDS, F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    return ids.join(evidence, ["document_id", "evidence_id"])


def record_evidence(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Record -> array of its evidence rows in id order (as long as the record's own list)."""
    rows = record_evidence_rows(records, evidence)
    body = [c for c in evidence.columns if c != "document_id"]
    got = rows.groupBy(*IDS).agg(F.array_sort(F.collect_list(F.struct("pos", *body))).alias("e"))
    return got.select(*IDS, F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in body])).alias("evidence"))


def link_candidates(participants: DataFrame, index: DataFrame) -> DataFrame:
    """Add the structure candidate of a label when exactly one carries it.

    ``index`` counts all structure candidates per label, parsed or not.
    """
    lookup = index.filter(F.col("n_candidates") == 1).select("document_id", "label_key", "only_candidate")
    keyed = participants.withColumn("label_key", spread_key(normalize_label("label"), *participants.columns))
    linked = keyed.join(lookup, ["document_id", "label_key"], "left")
    return linked.select(*participants.columns, F.array_compact(F.array("only_candidate")).alias("candidate_ids"))


def candidate_counts(structures: DataFrame) -> DataFrame:
    """(document, label) -> number of structure candidates and the only one's id."""
    keyed = structures.select("document_id", normalize_label("compound_label").alias("label_key"), "candidate_id")
    return keyed.filter(F.col("label_key") != "").groupBy("document_id", "label_key").agg(
        F.count("*").alias("n_candidates"), F.min("candidate_id").alias("only_candidate")
    )


# --- contexts -------------------------------------------------------------------

_PARTICIPANT = (
    "struct<participant_id:string,role:string,label:string,name:string,smiles:string,structure_state:string,"
    "evidence_ids:array<string>>"
)
_CONDITION = "struct<condition_id:string,kind:string,value:string,numeric_value:double,unit:string,extraction_state:string>"


def _participants(with_evidence: bool) -> Column:
    none = F.lit(None).cast("string")
    no_ids = F.array().cast("array<string>")

    def compounds(column, role):
        return F.transform(
            F.col(column),
            lambda x, i: F.struct(
                F.concat_ws(":", "reaction_id", F.lit(role), (i + 1).cast("string")).alias("participant_id"),
                F.lit(role).alias("role"), x["label"].alias("label"), x["name"].alias("name"), x["smiles"].alias("smiles"),
                F.when(F.coalesce(x["smiles"], F.lit("")) != "", "resolved").otherwise("unresolved").alias("structure_state"),
                (F.col("evidence_ids") if with_evidence else no_ids).alias("evidence_ids"),
            ).cast(_PARTICIPANT),
        )

    def names(column, role):
        return F.transform(
            F.col(column),
            lambda x, i: F.struct(
                F.concat_ws(":", "reaction_id", F.lit(role), (i + 1).cast("string")).alias("participant_id"),
                F.lit(role).alias("role"), none.alias("label"), x.alias("name"), none.alias("smiles"),
                F.lit("not_attempted").alias("structure_state"), no_ids.alias("evidence_ids"),
            ).cast(_PARTICIPANT),
        )

    return F.concat(
        compounds("reactants", "reactant"), compounds("products", "product"),
        names("reagents", "reagent"), names("solvents", "solvent"),
    )


def _condition(cid, kind, value, number, unit) -> Column:
    none = F.lit(None)
    return F.struct(
        cid.alias("condition_id"), F.lit(kind).alias("kind"), (none if value is None else value).alias("value"),
        (none if number is None else number).alias("numeric_value"), (none if unit is None else F.lit(unit)).alias("unit"),
        F.lit("extracted").alias("extraction_state"),
    ).cast(_CONDITION)


def _conditions(stored: bool) -> Column:
    """Stored contexts number temperature, time and yield on; synthesised ones name them."""
    rid = F.col("reaction_id")
    present = [F.col(c).isNotNull().cast("int") for c in ("temperature_c", "time", "yield_pct")]

    def scalar(column, kind, unit, place):
        number = sum(present[:place], present[place])
        cid = F.concat_ws(":", rid, F.lit(kind), number.cast("string")) if stored else F.concat_ws(":", rid, F.lit("cond"), F.lit(kind))
        numeric = F.col(column) if unit else None
        value = None if stored and unit else F.col(column).cast("string")
        return F.when(F.col(column).isNotNull(), _condition(cid, kind, value, numeric, unit))

    def named(column, kind):
        first = 1 if stored else 0
        tag = kind if stored else f"cond:{kind}"
        return F.transform(
            F.col(column),
            lambda x, i: _condition(F.concat_ws(":", rid, F.lit(tag), (i + first).cast("string")), kind, x, None, None),
        )

    scalars = F.array(
        scalar("temperature_c", "temperature", "°C", 0), scalar("time", "time", None, 1), scalar("yield_pct", "yield", "%", 2)
    )
    return F.concat(F.array_compact(scalars), named("reagents", "reagent"), named("solvents", "solvent"))


def review_contexts(records: DataFrame) -> DataFrame:
    """Record -> participants, conditions, record hash and note.  Array work only, no shuffle."""
    return with_record_hash(records).select(
        *IDS, "record_hash", _participants(False).alias("participants"), _conditions(True).alias("conditions"),
        F.lit(1).alias("stage_count"), F.col("evidence_ids").alias("reaction_evidence_ids"),
        F.lit(NO_FIELD_EVIDENCE).alias("context_schema_note"),
    )


def synthesised_contexts(records: DataFrame) -> DataFrame:
    """The same for records without a stored context."""
    return with_record_hash(records).select(
        *IDS, "record_hash", _participants(True).alias("participants"), _conditions(False).alias("conditions"),
        F.lit(1).alias("stage_count"), F.col("evidence_ids").alias("reaction_evidence_ids"),
        F.lit(LEGACY_NOTE).alias("context_schema_note"),
    )


def context_participants(contexts: DataFrame, index: DataFrame) -> DataFrame:
    """One row per participant, linked to its only structure candidate."""
    rows = contexts.select(*IDS, F.posexplode("participants").alias("pos", "p")).select(*IDS, "pos", "p.*")
    return link_candidates(rows, index)


# --- human status ---------------------------------------------------------------

SETTLED = ("confirmed", "not_applicable", "revised")
OPEN = ("pending", "insufficient_evidence")
TARGET_KINDS_SEEN = ("condition", "participant_identity", "participant_structure", "stereo")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last conclusion per target; a fixed-size aggregate, combined on the map side."""
    return decisions.groupBy(*IDS, "target_kind", "target_id").agg(
        F.max_by("conclusion", "ord").alias("conclusion"), F.max("ord").alias("ord"),
        F.max((F.col("conclusion") == "rejected").cast("int")).alias("ever_rejected"),
    )


def required_targets(decisions: DataFrame, gold_ids: DataFrame | None = None) -> DataFrame:
    """Distinct targets that must be settled for each reaction with decisions."""
    seen = decisions.filter(F.col("target_kind").isin(*TARGET_KINDS_SEEN)).select(*IDS, "target_kind", "target_id")
    touched = decisions.select(*IDS).distinct()
    whole = [touched.select(*IDS, F.lit(k).alias("target_kind"), F.col("reaction_id").alias("target_id")) for k in ("reaction", "completeness")]
    parts = [seen, *whole]
    if gold_ids is not None:
        compared = touched.join(gold_ids.select(*IDS).distinct(), IDS, "left_semi")
        parts.append(compared.select(*IDS, F.lit("gold_alignment").alias("target_kind"), F.col("reaction_id").alias("target_id")))
    return union_all(*parts).distinct()


def human_status(decisions: DataFrame, gold_ids: DataFrame | None = None) -> DataFrame:
    """Status of every reaction that has decisions (all others are ``unreviewed``).

    The seen targets are required by definition, the fixed ones are counted, so one
    pass over the latest decisions is enough.
    """
    latest = latest_decisions(decisions)
    own = F.col("target_id") == F.col("reaction_id")
    seen = F.col("target_kind").isin(*TARGET_KINDS_SEEN)
    fixed = F.col("target_kind").isin("reaction", "completeness") & own
    gold_target = (F.col("target_kind") == "gold_alignment") & own
    settled, is_open = F.col("conclusion").isin(*SETTLED), F.col("conclusion").isin(*OPEN)
    per_reaction = latest.groupBy(*IDS).agg(
        F.max("ever_rejected").alias("rejected"),
        F.count_if((seen | fixed) & is_open).alias("n_open"), F.count_if((seen | fixed) & settled).alias("n_settled"),
        F.count_if(seen).alias("n_seen"),
        F.count_if(gold_target & is_open).alias("g_open"), F.count_if(gold_target & settled).alias("g_settled"),
    )
    gold = F.lit(0)
    if gold_ids is not None:
        flags = gold_ids.select(*IDS).distinct().withColumn("has_gold", F.lit(1))
        per_reaction = per_reaction.join(flags, IDS, "left")
        gold = F.coalesce("has_gold", F.lit(0))
    open_count = F.col("n_open") + gold * F.col("g_open")
    settled_count = F.col("n_settled") + gold * F.col("g_settled")
    status = (
        F.when(F.col("rejected") == 1, "rejected").when(open_count > 0, "pending")
        .when(settled_count >= F.col("n_seen") + 2 + gold, "confirmed").otherwise("in_review")
    )
    return per_reaction.select(*IDS, status.alias("human_status"))


def records_with_human_status(records: DataFrame, decisions: DataFrame, gold_ids: DataFrame | None = None) -> DataFrame:
    joined = records.join(human_status(decisions, gold_ids), IDS, "left")
    return joined.withColumn("human_status", F.coalesce("human_status", F.lit("unreviewed")))


def human_status_counts(records, decisions, gold_ids=None, by=()) -> DataFrame:
    return records_with_human_status(records, decisions, gold_ids).groupBy(*by, "human_status").agg(F.count("*").alias("n"))


def review_progress(with_status: DataFrame, by=()) -> DataFrame:
    return with_status.groupBy(*by).agg(
        F.count_if(F.col("human_status").isin("confirmed", "rejected")).alias("reviewed"), F.count("*").alias("total")
    )


def machine_status(issues="issues") -> Column:
    return F.when(F.exists(issues, lambda i: i["severity"] == "error"), "needs_review").otherwise("clean")


def run_status(records: DataFrame, by=()) -> DataFrame:
    """Counts and status; with ``by`` one row per group of records."""
    counts = records.groupBy(*by).agg(
        F.count("*").alias("records_count"), F.count_if(F.col("review_status") == "needs_review").alias("review_count")
    )
    status = (
        F.when(F.col("records_count") == 0, "completed_empty").when(F.col("review_count") > 0, "partial").otherwise("success")
    )
    return counts.withColumn("status", status)


# --- tasks ----------------------------------------------------------------------

def task_board(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """Tasks with their stored status; tasks nobody answered are awaiting."""
    known = state.select("document_id", "task_id", F.col("status").alias("_status"))
    joined = tasks.drop("status").join(known, ["document_id", "task_id"], "left")
    return joined.withColumn("status", F.coalesce("_status", F.lit("awaiting"))).drop("_status")


def awaiting_tasks(board: DataFrame) -> DataFrame:
    return board.filter("status = 'awaiting'").select("document_id", "task_id")


def channel_counts(board: DataFrame) -> DataFrame:
    """Awaiting and fulfilled tasks per channel; ``awaiting_tasks`` lists the waiting ones, all of them."""
    return board.groupBy("document_id", "kind").agg(
        F.count_if(F.col("status") != "fulfilled").alias("awaiting"), F.count_if(F.col("status") == "fulfilled").alias("fulfilled")
    )


def unknown_refs(references: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct ids that are referred to but not defined."""
    keys = ["document_id", column]
    return references.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


# --- the queue ------------------------------------------------------------------

QUEUE_FILTERS = ("all", "unreviewed", "missing_structure", "stereo_pending", "gold_diff")


def review_queue_filter(view: DataFrame, name: str) -> DataFrame:
    tests = {
        "all": F.lit(True),
        "unreviewed": F.col("human_status") == "unreviewed",
        "missing_structure": F.exists("participants", lambda p: p["structure_state"].isin("unresolved", "not_attempted")),
        "stereo_pending": F.col("human_status") == "pending",
        "gold_diff": F.col("has_gold"),
    }
    return view.filter(tests[name])


def queue_search(view: DataFrame, text: str, column: str = "search_text") -> DataFrame:
    wanted = F.lit(text.lower())
    return view.filter(F.contains(F.lower(column), wanted) | F.contains(F.lower("reaction_id"), wanted))


def next_unreviewed(queue: DataFrame, current: DataFrame) -> DataFrame:
    """Per document the first unreviewed position after the current one, else the first of all."""
    waiting = queue.filter("human_status = 'unreviewed'").select("document_id", "position")
    after = waiting.join(current.select("document_id", F.col("position").alias("here")), "document_id")
    return after.groupBy("document_id").agg(
        F.coalesce(F.min(F.when(F.col("position") > F.col("here"), F.col("position"))), F.min("position")).alias("next_position")
    )


# --- the view -------------------------------------------------------------------

def issues_by_participant(records: DataFrame) -> DataFrame:
    """One row per participant with the record's issues that target its label or name."""
    rows = records.select(*IDS, "issues", F.posexplode(_participants(False)).alias("pos", "p"))
    name = F.coalesce(empty_to_null("p.label"), empty_to_null("p.name"), F.lit(""))
    return rows.select(
        *IDS, "pos", "p.participant_id", F.filter("issues", lambda i: i["target_id"] == name).alias("machine_issues")
    )


def gold_pairs(comparisons: DataFrame, participants: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Participant comparisons with both structures looked up by label or name (first wins)."""
    rows = comparisons.select(*IDS, "gold_reaction_id", F.posexplode("participant_results").alias("pair", "r")).select(
        *IDS, "gold_reaction_id", "pair", "r.*"
    )
    ref = F.coalesce(empty_to_null("label"), empty_to_null("name"), F.lit("<unlabelled>"))
    by_name = participants.select(*IDS, ref.alias("ref"), (F.col("pos") * 2).alias("ord"), F.col("smiles").alias("extracted_smiles"))
    by_id = participants.select(*IDS, F.col("participant_id").alias("ref"), (F.col("pos") * 2 + 1).alias("ord"), F.col("smiles").alias("extracted_smiles"))
    lookup = keep_first(by_name.unionByName(by_id), [*IDS, "ref"]).select(*IDS, F.col("ref").alias("participant_id"), "extracted_smiles", F.lit(True).alias("has_extracted"))
    out = rows.join(lookup, [*IDS, "participant_id"], "left")
    shown = F.col("comparison") != "missing_extracted"
    out = out.withColumn("extracted_smiles", F.when(shown, F.col("extracted_smiles"))).withColumn(
        "has_extracted", shown & F.coalesce("has_extracted", F.lit(False))
    )
    if gold is None:
        return out.withColumn("gold_smiles", F.lit(None).cast("string")).withColumn("has_gold_side", F.lit(False))
    last = keep_last(gold.select(*IDS, "ord", F.concat("reactants", "products").alias("cs")), IDS)
    compounds = last.select(*IDS, F.posexplode("cs").alias("ord", "c")).select(*IDS, "ord", "c.label", "c.name", "c.smiles")
    gold_ref = keep_first(compounds.select(*IDS, ref.alias("ref"), "ord", "smiles"), [*IDS, "ref"]).select(
        "document_id", F.col("reaction_id").alias("gold_reaction_id"), F.col("ref").alias("gold_participant_id"),
        F.col("smiles").alias("gold_smiles"), F.lit(True).alias("has_gold_side"),
    )
    out = out.join(gold_ref, ["document_id", "gold_reaction_id", "gold_participant_id"], "left")
    return out.withColumn(
        "has_gold_side", F.coalesce("has_gold_side", F.lit(False)) & (F.col("comparison") != "missing_gold")
    )


def review_view(
    records: DataFrame, decisions: DataFrame, contexts: DataFrame | None = None, comparisons: DataFrame | None = None
) -> DataFrame:
    """One nested row per record: participants, conditions, statuses, stale flag, gold, summary.

    Everything nested is built inside the row; the joins are on the record id with
    tables that hold one row per record.
    """
    rows = with_record_hash(records).select(
        "*", _participants(True).alias("participants"), _conditions(False).alias("conditions"),
        F.col("evidence_ids").alias("reaction_evidence_ids"), F.lit(LEGACY_NOTE).alias("context_schema_note"),
    )
    if contexts is None:
        rows = rows.withColumn("has_context", F.lit(False)).withColumn("stale", F.lit(False))
    else:
        stored = contexts.select(*IDS, *[F.col(c).alias(f"_{c}") for c in contexts.columns if c not in IDS])
        rows = rows.join(stored, IDS, "left").withColumn("has_context", F.col("_record_hash").isNotNull())
        for name in ("participants", "conditions", "reaction_evidence_ids", "context_schema_note"):
            rows = rows.withColumn(name, F.when(F.col("has_context"), F.col(f"_{name}")).otherwise(F.col(name)))
        rows = rows.withColumn("stale", F.col("has_context") & (F.col("_record_hash") != F.col("record_hash")))
    gold_ids = None
    if comparisons is not None:
        last = comparisons.filter(F.col("reaction_id").isNotNull()).groupBy(*IDS).agg(
            F.max_by(F.struct("gold_reaction_id", "alignment", "alignment_basis", "participant_results"), F.coalesce("g_ord", F.lit(-1))).alias("gold")
        )
        gold_ids = last.select(*IDS)
        rows = rows.join(last, IDS, "left").withColumn("has_gold", F.col("gold").isNotNull())
    else:
        rows = rows.withColumn("has_gold", F.lit(False))
    rows = records_with_human_status(rows, decisions, gold_ids)
    lists = {c: F.col(c) for c in ("reactants", "products", "reagents", "solvents")}
    participants = F.transform(
        "participants",
        lambda p: p.withField("field_path", participant_field_path(p["participant_id"], p["role"], lists)).withField(
            "machine_issues",
            F.filter(
                F.col("issues"),
                lambda i: i["target_id"] == F.coalesce(empty_to_null(p["label"]), empty_to_null(p["name"]), F.lit("")),
            ),
        ),
    )
    first = F.when(F.col("has_context"), 1).otherwise(0)
    conditions = F.transform(
        "conditions", lambda c: c.withField("field_path", condition_field_path(c["condition_id"], c["kind"], first))
    )
    # With a stored context the summary takes the reagent-like condition values from it.
    reagent_values = F.transform(
        F.filter("conditions", lambda c: c["kind"].isin("catalyst", "ligand", "reagent") & (c["value"] != "")), lambda c: c["value"]
    )
    summary_reagents = F.when(F.col("has_context"), reagent_values).otherwise(F.col("reagents"))
    gold = ["gold"] if comparisons is not None else []
    return rows.select(
        *IDS, "record_hash", "review_status", "confidence", machine_status().alias("machine_status"), "human_status",
        participants.alias("participants"), conditions.alias("conditions"), "stale", "has_context", "has_gold", *gold,
        display_names("reactants").alias("reactants_text"), display_names("products").alias("products_text"),
        "reagents", "solvents", "temperature_c", F.coalesce("time", F.lit("")).alias("time"), "yield_pct",
        F.col("reaction_evidence_ids").alias("evidence_ids"), "issues", F.col("context_schema_note").alias("context_note"),
        condition_summary(summary_reagents, "solvents", "temperature_c", "time", "yield_pct").alias("condition_summary"),
    )


def review_view_totals(view: DataFrame) -> DataFrame:
    return view.groupBy("document_id").agg(
        F.count("*").alias("record_count"), F.bool_or("has_gold").alias("has_gold"), F.bool_or("has_context").alias("has_contexts")
    )

