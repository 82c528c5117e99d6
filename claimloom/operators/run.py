"""From documents to records in one call."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..staging import staged
from .answers import parse_model_answers, reaction_candidates, structure_candidates
from .assemble import Assembly, assemble, nested_records
from .pages import split_pages
from .review import run_status, synthesised_contexts
from .rules import validate
from .structures import Parser, canonicalise, structure_dictionary
from .tasks import MAX_TEXT_CHARS, extraction_tasks

TASK = ["document_id", "task_id"]


class Run(NamedTuple):
    tasks: DataFrame  # everything that was asked
    answers: DataFrame  # document_id, task_id, answer, payload, error of every answer
    candidates: DataFrame
    structures: DataFrame
    issues: DataFrame  # of candidates and structures
    assembly: Assembly
    status: DataFrame  # one row per document


def run_documents(
    documents: DataFrame, answer: Callable[[DataFrame], DataFrame], parser: Parser,
    evidence: DataFrame | None = None, images: DataFrame | None = None, max_chars: int = MAX_TEXT_CHARS,
) -> Run:
    """Pages -> tasks -> answers -> candidates -> rules -> records -> status.

    ``documents``: document_id, markdown.  ``answer`` turns the task table into (document_id, task_id, answer), for
    example through ``fulfil_tasks`` or a join with given answers; a task may stay without one.  ``evidence``
    defaults to the pages of the documents, ``images`` (document_id, path) to none.  Answers and candidates are
    written once, so nothing is asked twice.
    """
    spark = documents.sparkSession
    evidence = split_pages(documents) if evidence is None else evidence
    for name in ("asset_path", "source_path"):
        if name not in evidence.columns:
            evidence = evidence.withColumn(name, F.lit(None).cast("string"))
    images = spark.createDataFrame([], "document_id string, path string") if images is None else images
    tasks = extraction_tasks(documents, evidence, images, max_chars)
    answers = staged(answer(tasks).filter("answer IS NOT NULL").select(*TASK, "answer"), "answers")
    parsed = staged(parse_model_answers(answers.join(tasks.select(*TASK, F.col("kind").alias("source"), "evidence_ids"), TASK)), "payloads")
    good = parsed.filter("error IS NULL").drop("answer", "error")
    place = F.struct("task_id", "row_number").alias("ord")
    candidates = staged(reaction_candidates(good.filter("source <> 'structure'")).select("*", place), "candidates")
    structures = staged(structure_candidates(good.filter("source = 'structure'")).select("*", place), "structures")
    texts = structures.select("smiles").unionByName(
        candidates.select(F.explode(F.concat("reactants.smiles", "products.smiles")).alias("smiles"))
    )
    dictionary = staged(structure_dictionary(texts, parser), "dictionary")
    known = canonicalise(structures, dictionary)
    assembly = assemble(candidates, known, dictionary, store=True)
    counted = run_status(assembly.records, by=["document_id"])
    status = documents.select("document_id").join(counted, "document_id", "left").select(
        "document_id", F.coalesce("records_count", F.lit(0)).alias("records_count"), F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("status", F.lit("completed_empty")).alias("status"),
    )
    return Run(tasks, parsed, candidates, structures, validate(candidates, known), assembly, status)


def contexts(run: Run) -> DataFrame:
    """Review contexts of the run's records."""
    return synthesised_contexts(nested_records(run.assembly))
