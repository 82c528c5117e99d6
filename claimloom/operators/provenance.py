"""Who produced each candidate: the producer plan and provenance rows."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CHANNELS, PLAN
from .submissions import TASK
from .tasks import VERSIONS

# Channels a run mode hands to the outside.
EXTERNAL_CHANNELS = {"auto": (), "semi": ("structure",), "agent": CHANNELS}


def producer_plan(spark: SparkSession, mode: str, models: dict, host_routes: dict | None = None) -> DataFrame:
    """Four channel rows.  ``models``: channel -> (model, provider); routes: channel -> (model, policy, fallbacks)."""
    rows = []
    for channel in CHANNELS:
        if channel in EXTERNAL_CHANNELS[mode]:
            model, policy, fallbacks = (host_routes or {}).get(channel, (None, None, None))
            rows.append((channel, "host_agent", model, None, policy, fallbacks or None))
        else:
            model, provider = models[channel]
            rows.append((channel, "cli_model", model, provider, None, None))
    return spark.createDataFrame(rows, PLAN)


def _versions(kind: str = "kind"):
    pairs = {("adjudication" if k == "adjudicate" else k): v for k, v in VERSIONS.items()}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[F.col(kind)]


def extraction_provenance(candidates: DataFrame, tasks: DataFrame, state: DataFrame, plan: DataFrame, created_at, input_hash=None) -> DataFrame:
    """One row per (candidate, task): the submission's producer, else the plan's.

    The plan has four rows by construction, so it is broadcast.
    """
    answered = state.select(*TASK, "submission_hash", F.col("producer").alias("p"))
    four = plan.select(
        F.col("channel").alias("kind"), F.col("kind").alias("plan_kind"), F.col("model").alias("plan_model"),
        F.col("provider").alias("plan_provider"), F.col("policy").alias("plan_policy"),
    )
    rows = candidates.select("document_id", "candidate_id", "task_id").join(
        tasks.select(*TASK, "kind", "instruction_version"), TASK
    ).join(answered, TASK, "left").join(F.broadcast(four), "kind")
    submitted = F.col("p").isNotNull()
    kind = F.when(submitted, F.col("p.kind")).otherwise(F.col("plan_kind"))
    own = lambda f: F.when(F.coalesce(F.col(f"p.{f}"), F.lit("")) != "", F.col(f"p.{f}"))
    return rows.select(
        "document_id", "candidate_id", "task_id", F.col("kind").alias("channel"), kind.alias("producer_kind"),
        F.when(kind == "cli_model", F.col("plan_provider")).alias("provider"),
        F.when(kind == "cli_model", F.col("plan_model")).otherwise(F.coalesce(own("model"), "plan_model")).alias("model"),
        F.coalesce(own("policy"), "plan_policy").alias("policy"), F.col("p.attempt").alias("attempt"),
        _versions().alias("prompt_version"), "instruction_version", F.lit(input_hash).cast("string").alias("input_hash"),
        F.when(submitted, F.col("submission_hash")).alias("submission_hash"),
        F.col("p.client_name").alias("client_name"), F.col("p.client_version").alias("client_version"),
        F.lit(created_at).cast("string").alias("created_at"),
    )


def adjudication_provenance(tasks: DataFrame, state: DataFrame, plan: DataFrame, created_at, input_hash=None) -> DataFrame:
    """One row per adjudication task: the plan's model, or the external producer that answered."""
    ad = tasks.filter("kind = 'adjudication'").select("document_id", F.col("reaction_id").alias("candidate_id"), "task_id", "kind")
    four = plan.filter("kind = 'cli_model'").select(F.col("channel").alias("kind"), F.lit(True).alias("_model"))
    internal = F.broadcast(four)
    by_model = extraction_provenance(
        ad.join(internal, "kind", "left_semi").select("document_id", "candidate_id", "task_id"), tasks,
        state.filter(F.lit(False)), plan, created_at, input_hash,
    )
    answered = state.filter("status = 'fulfilled'").select(*TASK)
    external = ad.join(internal, "kind", "left_anti").join(answered, TASK, "left_semi")
    by_host = extraction_provenance(external.select("document_id", "candidate_id", "task_id"), tasks, state, plan, created_at, input_hash)
    return by_model.unionByName(by_host)
