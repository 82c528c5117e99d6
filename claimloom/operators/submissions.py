"""Answers that arrive from outside: candidate submissions, adjudications, binding, reports."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import variants as V
from ..functions.ids import content_hash, stable_id
from ..staging import staged
from .answers import reaction_candidates, structure_candidates, valid_row
from .ranking import long_block, previous_value
from .review import IDS, awaiting_tasks, task_board

TASK = ["document_id", "task_id"]


def submission_hash(submissions: DataFrame) -> DataFrame:
    """Add ``submission_hash`` over task, producer and outputs (VARIANT)."""
    return submissions.withColumn(
        "submission_hash", content_hash("task_id", F.to_json("producer"), V.text_of("outputs"))
    )


@dataclass(frozen=True)
class Applied:
    """Outcome of a batch: one status per submission, accepted candidates, new task state, superseded tasks."""

    statuses: DataFrame
    reactions: DataFrame
    structures: DataFrame
    state: DataFrame
    superseded: DataFrame


def _parsed_outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reaction rows, structure rows)."""
    exploded = rows.select(*TASK, "ord", "kind", "evidence_ids", F.posexplode(V.as_array("outputs")).alias("output_number", "output"))
    new_id = stable_id(F.concat("kind", F.lit("-submission")), "task_id", V.text_of("output"))
    given = exploded.withColumn("_id", new_id).withColumn("_evidence", F.col("evidence_ids")).withColumn("payload", F.array("output").cast("variant"))
    kept = [*TASK, "ord", "output_number"]

    def owned(df):
        return df.withColumn("candidate_id", F.col("_id")).withColumn("evidence_ids", F.col("_evidence")).drop("_id", "_evidence", "row_number")

    base = given.select(*kept, "_id", "_evidence", "payload", "evidence_ids", F.col("kind").alias("source"))
    reactions = owned(reaction_candidates(base.filter("source <> 'structure'"), unwrap=False))
    structures = owned(structure_candidates(base.filter("source = 'structure'"), unwrap=False))
    return reactions, structures


def apply_candidate_submissions(tasks: DataFrame, state: DataFrame, submissions: DataFrame, force: bool = False) -> Applied:
    """Set form of applying submissions in order.

    Per task, the first submission fulfils it; the same content again is a no-op; other
    content is a conflict, or replaces the answer when ``force`` is set.  A submission
    with one bad row is refused whole.  ``ord`` is a unique integer.

    The submissions with their hash and problem are written once, and the decisions on them; all tables of the
    outcome read these, and only accepted outputs are typed.
    """
    known = tasks.select(*TASK, "kind", "evidence_ids")
    stored = state.filter("status = 'fulfilled'").select(*TASK, F.col("submission_hash").alias("_stored"))
    rows = submission_hash(submissions).join(known, TASK, "left").join(stored, TASK, "left")
    known_kind = F.col("kind").isin("text", "table", "structure")
    bad = F.exists("_items", lambda x: ~valid_row(x, F.col("kind") == "structure"))
    problem = (
        F.when(F.col("kind").isNull(), "unknown task").when(F.col("kind") == "adjudication", "not an extraction task")
        .when(F.coalesce(F.size("_items"), F.lit(0)) <= 0, "no outputs").when(~known_kind | bad, "invalid output rows")
    )
    rows = rows.select("*", V.once(V.as_array("outputs"), "_items")).select(
        *TASK, "ord", "kind", "evidence_ids", "producer", "outputs", "submission_hash", "_stored", problem.alias("problem")
    )
    rows = staged(rows, "submissions")
    good = rows.filter(F.col("problem").isNull())
    if force:
        before = previous_value(good, TASK, "ord", long_block("ord"), "submission_hash", "_batch")
    else:
        first = good.groupBy(*TASK).agg(F.min("ord").alias("_first"), F.min_by("submission_hash", "ord").alias("_first_hash"))
        before = good.join(first, TASK).withColumn("_batch", F.when(F.col("ord") > F.col("_first"), F.col("_first_hash"))).drop("_first", "_first_hash")
        before = before.withColumn("_batch", F.when(F.col("_stored").isNull(), F.col("_batch")))
    previous = F.coalesce("_batch", "_stored")
    status = (
        F.when(previous.isNull(), "applied").when(previous == F.col("submission_hash"), "no-op")
        .otherwise("superseded" if force else "conflict")
    )
    decided = staged(before.select(*TASK, "ord", "kind", "submission_hash", "producer", status.alias("result")), "decided")
    statuses = decided.select(*TASK, "ord", "submission_hash", "result").unionByName(
        rows.filter(F.col("problem").isNotNull()).select(*TASK, "ord", "submission_hash", F.concat(F.lit("error: "), "problem").alias("result"))
    )
    final = decided.filter(F.col("result").isin("applied", "superseded")).groupBy(*TASK).agg(
        F.max_by(F.struct("ord", "kind", "submission_hash", "producer"), "ord").alias("s"), F.bool_or(F.col("result") == "superseded").alias("replaced")
    )
    chosen = final.select(*TASK, F.col("s.ord").alias("ord"))
    fresh = final.select(*TASK, "s.kind", F.lit("fulfilled").alias("status"), "s.submission_hash", "s.producer")
    kept_state = state.join(final.select(*TASK), TASK, "left_anti").select(*TASK, "kind", "status", "submission_hash", "producer")
    reactions, structures = _parsed_outputs(rows.join(chosen, [*TASK, "ord"], "left_semi"))
    return Applied(statuses, reactions, structures, kept_state.unionByName(fresh), final.filter("replaced").select(*TASK))


def supersede_audit(superseded: DataFrame, at) -> DataFrame:
    """One audit row per superseded task; a run's list is the sorted distinct ids."""
    return superseded.select(F.lit("supersedes").alias("type"), *TASK, F.lit(at).cast("string").alias("at")).distinct()


def reset_tasks(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Task state with the answered tasks of ``decisions`` set back to awaiting."""
    hit = decisions.select(*TASK).distinct().withColumn("_hit", F.lit(True))
    joined = state.join(hit, TASK, "left")
    reset = F.coalesce("_hit", F.lit(False))
    return joined.select(
        *TASK, "kind", F.when(reset, "awaiting").otherwise(F.col("status")).alias("status"),
        F.when(~reset, F.col("submission_hash")).alias("submission_hash"), F.when(~reset, F.col("producer")).alias("producer"),
    )


def decision_target_check(decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adjudications with a ``problem``: unknown task, wrong kind, or another reaction's task; null if fine."""
    known = tasks.select(*TASK, "kind", F.col("reaction_id").alias("_expected"))
    problem = (
        F.when(F.col("kind").isNull(), "unknown task").when(F.col("kind") != "adjudication", "not an adjudication task")
        .when(~F.col("reaction_id").eqNullSafe(F.col("_expected")), "wrong reaction")
    )
    return decisions.join(known, TASK, "left").withColumn("problem", problem).drop("kind", "_expected")


def apply_adjudications(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accepted warning-only review records become accepted; nothing else changes."""
    accepted = decisions.filter("decision = 'accept'").select(*IDS).distinct().withColumn("_accept", F.lit(True))
    clean = ~F.exists("issues", lambda i: i["severity"] == "error")
    lifted = F.coalesce("_accept", F.lit(False)) & (F.col("review_status") == "needs_review") & clean
    joined = records.join(accepted, IDS, "left")
    return joined.withColumn("review_status", F.when(lifted, "accepted").otherwise(F.col("review_status"))).drop("_accept")


def bind_by_overlap(structures: DataFrame, tasks: DataFrame) -> DataFrame:
    """Bind external structures to the one task that shares evidence with them.

    Adds ``task_id`` and ``problem``.  Per evidence id only the lowest and highest
    task are kept, so no pairs are formed: a structure has exactly one task when the
    lowest and the highest over its evidence agree.  A document's only task takes all.
    """
    per_document = tasks.groupBy("document_id").agg(F.min("task_id").alias("_low"), F.max("task_id").alias("_high"))
    only = per_document.select("document_id", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_only"))
    by_evidence = tasks.select("document_id", "task_id", F.explode("evidence_ids").alias("evidence_id")).groupBy("document_id", "evidence_id").agg(
        F.min("task_id").alias("_low"), F.max("task_id").alias("_high")
    )
    spans = (
        structures.select("document_id", "candidate_id", F.explode("evidence_ids").alias("evidence_id"))
        .join(by_evidence, ["document_id", "evidence_id"]).groupBy("document_id", "candidate_id")
        .agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    )
    joined = structures.join(only, "document_id", "left").join(spans, ["document_id", "candidate_id"], "left")
    single = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    bound = joined.withColumn("task_id", F.coalesce("_only", single))
    return bound.withColumn("problem", F.when(F.col("task_id").isNull(), "ambiguous external structure")).drop("_only", "_low", "_high")


def submission_report(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """Per document: tasks awaiting, fulfilled, and ready or awaiting_input."""
    board = task_board(tasks, state)
    counts = board.groupBy("document_id").agg(
        F.count_if(F.col("status") == "awaiting").alias("awaiting"), F.count_if(F.col("status") == "fulfilled").alias("fulfilled")
    )
    return counts.withColumn("status", F.when(F.col("awaiting") > 0, "awaiting_input").otherwise("ready"))


__all__ = [
    "Applied", "apply_adjudications", "apply_candidate_submissions", "awaiting_tasks", "bind_by_overlap",
    "decision_target_check", "reset_tasks", "submission_hash", "submission_report", "supersede_audit",
]
