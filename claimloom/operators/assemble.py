"""Candidates that agree -> one record with a confidence and a review status.

The result is kept as flat tables (one row per record, compound, evidence id or
issue), so a signature or label that holds a large part of the input never has to
be gathered.  ``nested_records`` builds the array form for the JSON contract.
"""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import content_hash, member_hash, stable_id
from ..functions.text import empty_to_null, normalize_label, round4, signature_keys
from ..staging import staged
from .ranking import smallest_values, spread_key, union_all
from .rules import (
    blank_label_to_unlabelled, label_index, listed_text, missing_parts, structure_rules,
)
from .structures import with_parsed

CONFLICT_FIELDS = ("temperature_c", "time", "yield_pct")


def with_signature(candidates: DataFrame) -> DataFrame:
    """Add the sorted reactant and product keys; a candidate with neither stands alone."""
    keyed = candidates.withColumn("sig_reactants", signature_keys("reactants")).withColumn(
        "sig_products", signature_keys("products")
    )
    alone = (F.size("sig_reactants") == 0) & (F.size("sig_products") == 0)
    keyed = keyed.withColumn(
        "sig_reactants", F.when(alone, F.array("candidate_id")).otherwise(F.col("sig_reactants"))
    )
    group = content_hash(
        "document_id", F.array_join("sig_reactants", "\u001d"), F.array_join("sig_products", "\u001d"),
        alone,
    )
    return keyed.withColumn("group_id", F.substring(group, 1, 32))


def mean_exact(values) -> Column:
    """Mean through a decimal sum: the same on any partitioning."""
    total = F.sum(F.col(values).cast("decimal(38,12)")).cast("double")
    return total / F.count(values)


def group_headers(candidates: DataFrame) -> DataFrame:
    """One row per group: base candidate, mean confidence, source count, conflicts, own errors.

    Every aggregate here has a buffer of fixed size and combines on the map side.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("ord").alias("o"))
    base = F.struct("candidate_id", "reactants", "products", "temperature_c", "time", "yield_pct")
    own = missing_parts("reactants", "products", "evidence_ids")
    own_errors = F.size(F.filter(own, lambda i: i["severity"] == "error"))
    grouped = candidates.groupBy("group_id").agg(
        F.first("document_id").alias("document_id"),
        F.first("sig_reactants").alias("sig_reactants"),
        F.first("sig_products").alias("sig_products"),
        F.min_by(base, rank).alias("base"),
        F.min_by("candidate_id", "ord").alias("first_candidate"),
        F.min("ord").alias("first_ord"),
        F.count("*").alias("n_candidates"),
        mean_exact("confidence").alias("mean_confidence"),
        (F.min("source") != F.max("source")).alias("many_sources"),
        F.sum(own_errors).alias("own_errors"),
        *[(F.min(f) != F.max(f)).alias(f"conflict_{f}") for f in CONFLICT_FIELDS],
    )
    flags = [F.coalesce(F.col(f"conflict_{f}"), F.lit(False)).alias(f"conflict_{f}") for f in CONFLICT_FIELDS]
    kept = [c for c in grouped.columns if not c.startswith("conflict_")]
    return grouped.select(*kept, *flags)


def first_seen(candidates: DataFrame, column: str, carried=()) -> DataFrame:
    """Distinct non-empty list items per group with the place they were first seen.

    ``carried`` columns, equal in all rows of a group, come along, so that they need not be joined back.
    """
    items = candidates.select("group_id", "ord", *carried, F.posexplode(column).alias("i", "item"))
    return (
        items.filter(F.col("item") != "")
        .groupBy("group_id", "item").agg(F.min(F.struct("ord", "i")).alias("place"), *[F.first(c).alias(c) for c in carried])
    )


def evidence_digests(evidence: DataFrame) -> DataFrame:
    """Order-free digest of a group's evidence, built without gathering it."""
    return evidence.groupBy("group_id").agg(
        F.count("*").alias("n_evidence"), F.bit_xor(member_hash("item")).alias("evidence_digest")
    )


def base_compounds(headers: DataFrame, carried=()) -> DataFrame:
    """The base candidate's compounds, one row each (one row with null ``side`` if none).

    ``carried`` header columns ride along, so the header is not computed a second time
    to be joined back.
    """
    def side(name, number):
        return F.transform(f"base.{name}", lambda c, i: F.struct(F.lit(number).alias("side"), i.alias("pos"), c.alias("c")))

    rows = headers.select(
        "group_id", "document_id", *carried, F.explode_outer(F.concat(side("reactants", 0), side("products", 1))).alias("x")
    )
    return rows.select(
        "group_id", "document_id", *carried, "x.side", "x.pos", "x.c.label", "x.c.name", "x.c.smiles", "x.c.role"
    ).withColumn("label_key", normalize_label("label"))


def resolve_structures(compounds: DataFrame, index: DataFrame, dictionary: DataFrame | Mapping) -> DataFrame:
    """Own structure if it parses, else the only structure of the label.

    Adds ``resolved_smiles``, ``state`` (own, label, ambiguous, missing) and the errors
    the label's structure candidates bring along.  Blank labels and structures never
    join; their rows are spread instead of meeting in one task.
    """
    by_label = index.select(
        F.col("document_id").alias("_doc"), F.col("label_key").alias("_key"), "n_candidates", "label_structure", "conflict",
    )
    keyed = with_parsed(compounds, dictionary, "smiles", {"iso": "_own"}, "group_id", "pos").withColumn(
        "_label", spread_key("label_key", "group_id", "pos")
    )
    found = keyed.join(
        by_label, (F.col("document_id") == F.col("_doc")) & (F.col("_label") == F.col("_key")), "left"
    )
    state = (
        F.when(F.col("side").isNull(), None).when(F.col("_own").isNotNull(), "own").when(F.col("label_structure").isNotNull(), "label")
        .when(F.col("conflict"), "ambiguous").otherwise("missing")
    )
    return found.select(
        *compounds.columns,
        F.coalesce("_own", "label_structure").alias("resolved_smiles"), state.alias("state"),
        F.when(F.col("conflict"), F.col("n_candidates")).otherwise(F.lit(0)).alias("label_errors"),
    )


def compound_issues(resolved: DataFrame) -> DataFrame:
    """A001 / A002 rows of compounds that did not resolve."""
    label = F.coalesce(F.col("label"), F.lit("None"))
    ambiguous = F.col("state") == "ambiguous"
    what = F.coalesce(empty_to_null("label"), empty_to_null("name"), F.lit("compound"))
    return resolved.filter(F.col("state").isin("ambiguous", "missing")).select(
        "group_id", "document_id",
        F.when(ambiguous, "A001_STRUCTURE_AMBIGUOUS").otherwise("A002_STRUCTURE_MISSING").alias("code"),
        F.when(ambiguous, "error").otherwise("warning").alias("severity"),
        blank_label_to_unlabelled("label").alias("target_id"),
        F.when(ambiguous, F.concat(F.lit("Multiple structures are available for "), label))
        .otherwise(F.concat(F.lit("No structure was resolved for "), what)).alias("message"),
        (F.col("side") * 10 + 20).alias("stage"), F.col("pos").alias("ord"),
    )


def conflict_values(candidates: DataFrame) -> DataFrame:
    """Every distinct value of every field of a group, one row each: the flat form of conflicts, however many."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in CONFLICT_FIELDS])
    rows = candidates.select("group_id", F.explode(values).alias("x")).select("group_id", "x.field", "x.v")
    return rows.filter(F.col("v").isNotNull()).distinct()


def field_conflicts(candidates: DataFrame) -> DataFrame:
    """One A003 row per group and field with several values; its message names the first LISTED and counts the others."""
    firsts = candidates.groupBy("group_id").agg(
        F.first("document_id").alias("document_id"), F.min_by("candidate_id", "ord").alias("target_id")
    )
    listed = smallest_values(conflict_values(candidates), ["group_id", "field"], "v").filter("n > 1")
    return listed.join(firsts, "group_id").select(
        "group_id", "document_id", F.lit("A003_FIELD_CONFLICT").alias("code"), F.lit("warning").alias("severity"),
        "target_id",
        F.concat(F.lit("Conflicting "), F.col("field"), F.lit(" values: "), listed_text("values", "n")).alias("message"),
        F.lit(40).alias("stage"),
        F.array_position(F.array(*[F.lit(f) for f in CONFLICT_FIELDS]), F.col("field")).alias("ord"),
    )


def confidence_score(mean_confidence, resolved, compounds, many_sources, errors) -> Column:
    """Weighted sum of agreement, resolution, source variety and absence of errors."""
    total = F.col(compounds).cast("double")
    ratio = F.when(total > 0, F.col(resolved) / total).otherwise(F.lit(0.0))
    quality = F.greatest(F.lit(0.0), F.lit(1.0) - F.col(errors) / F.greatest(F.lit(1.0), total + F.lit(1.0)))
    score = (
        F.lit(0.35) * F.col(mean_confidence)
        + F.lit(0.25) * ratio
        + F.lit(0.2) * F.when(F.col(many_sources), F.lit(1.0)).otherwise(F.lit(0.5))
        + F.lit(0.2) * quality
    )
    return F.least(F.lit(1.0), score)


def review_status(errors, score, resolved, compounds) -> Column:
    """Tested on the unrounded score."""
    incomplete = (F.col(compounds) == 0) | (F.col(resolved) < F.col(compounds))
    review = (F.col(errors) > 0) | (F.col(score) < 0.75) | incomplete
    return F.when(review, "needs_review").otherwise("accepted")


@dataclass(frozen=True)
class Assembly:
    """Flat tables of one assembly; all share ``group_id``, records add ``reaction_id``."""

    candidates: DataFrame
    headers: DataFrame
    compounds: DataFrame
    evidence: DataFrame
    structures: DataFrame
    records: DataFrame


def assemble(candidates: DataFrame, structures: DataFrame, dictionary: DataFrame | Mapping, store: bool = False) -> Assembly:
    """Candidates and canonicalised structures -> flat record tables.

    Two shuffles carry data volume: candidates by group, base compounds by label.
    ``store`` writes the signed candidates, group headers, structures, resolved compounds and records once, for callers
    that go on to issues, evidence and nested records; each would otherwise sign and group the candidates and resolve again.
    """
    signed = with_signature(candidates)
    if store:
        signed = staged(signed, "signed")
    headers = group_headers(signed)
    if store:
        headers, structures = staged(headers, "group-headers"), staged(structures, "structures")
    evidence = first_seen(signed, "evidence_ids")
    index = label_index(structures)
    scalars = headers.select(
        "group_id", "document_id", "base",
        F.struct(
            *[c for c in headers.columns if c not in ("group_id", "document_id", "base")],
            F.col("base.candidate_id").alias("base_candidate"), "base.temperature_c", "base.time", "base.yield_pct",
        ).alias("h"),
    )
    counts = [
        F.count("side").alias("n_compounds"),
        F.count_if(F.col("state").isin("own", "label")).alias("n_resolved"),
        (F.count_if(F.col("state") == "ambiguous") + F.sum("label_errors")).alias("compound_errors"),
    ]
    if store:
        resolved = staged(resolve_structures(base_compounds(headers), index, dictionary), "compounds")
        outcome = scalars.drop("base").join(resolved.groupBy("group_id").agg(*counts), "group_id")
    else:  # the header rides along, so that it need not be computed again to be joined back
        resolved = resolve_structures(base_compounds(headers), index, dictionary)
        outcome = resolve_structures(base_compounds(scalars, ["h"]), index, dictionary).groupBy("group_id").agg(
            F.first("document_id").alias("document_id"), F.first("h").alias("h"), *counts
        )
    joined = outcome.select("*", "h.*").drop("h").join(evidence_digests(evidence), "group_id", "left")
    joined = joined.fillna(0, ["n_evidence", "evidence_digest"]).withColumn(
        "error_count", F.col("own_errors") + F.col("compound_errors")
    )
    scored = joined.withColumn(
        "score", confidence_score("mean_confidence", "n_resolved", "n_compounds", "many_sources", "error_count")
    ).withColumn("review_status", review_status("error_count", "score", "n_resolved", "n_compounds"))
    records = scored.select(
        "document_id",
        stable_id("reaction", "group_id", "n_evidence", "evidence_digest").alias("reaction_id"),
        "group_id", "sig_reactants", "sig_products", "first_candidate",
        "base_candidate", "temperature_c", "time", "yield_pct", "n_candidates", "many_sources", "n_compounds", "n_resolved", "n_evidence", "error_count",
        *[f"conflict_{f}" for f in CONFLICT_FIELDS],
        round4("score").alias("confidence"), "review_status",
    )
    if store:
        records = staged(records, "records")
    return Assembly(signed, headers, resolved.filter(F.col("side").isNotNull()), evidence, structures, records)


def record_keys(assembly: Assembly) -> DataFrame:
    return assembly.records.select("group_id", "reaction_id")


def record_evidence_ids(assembly: Assembly) -> DataFrame:
    """(document, reaction, evidence id, first place) rows of every record."""
    keys = assembly.records.select("group_id", "document_id", "reaction_id")
    rows = assembly.evidence.join(keys, "group_id")
    return rows.select("document_id", "reaction_id", F.col("item").alias("evidence_id"), "place.ord", "place.i")


def _place(assembly: Assembly, stage, candidate=None, pos=None, structure=None, n=None) -> Column:
    """Where an issue stands in its record's list."""
    none = F.lit(None)
    return F.struct(
        stage.cast("int").alias("stage"),
        (none if candidate is None else candidate).cast(assembly.candidates.schema["ord"].dataType).alias("candidate"),
        (none if pos is None else pos).cast("int").alias("pos"),
        (none if structure is None else structure).cast(assembly.structures.schema["ord"].dataType).alias("structure"),
        (none if n is None else n).cast("int").alias("n"),
    ).alias("place")


ISSUE = ("code", "target_id", "message")


@dataclass(frozen=True)
class IssueLists:
    """Issues without repetition: rows grow with records and structures, not with their product.

    ``own``: issues of a record alone (group_id, document_id, code, severity, target_id, message, place). ``lists``:
    issues that every record with a label shares, once per label (document_id, label_key, code, severity, target_id,
    message, structure, n). ``uses``: which record has which label, and where first (group_id, document_id, label_key,
    stage, pos). Codes of the two kinds differ and a structure has one label, so the parts never overlap.
    """

    own: DataFrame
    lists: DataFrame
    uses: DataFrame


def issue_lists(assembly: Assembly) -> IssueLists:
    parts = missing_parts("reactants", "products", "evidence_ids")
    own = assembly.candidates.filter(F.size(parts) > 0).select(
        "group_id", "document_id", F.col("candidate_id").alias("target_id"), "ord", F.posexplode(parts).alias("n", "i"),
    ).select(
        "group_id", "document_id", "i.code", "i.severity", "target_id", "i.message",
        _place(assembly, F.lit(10), candidate=F.col("ord"), n=F.col("n")),
    )

    def placed(rows):
        return rows.select("group_id", "document_id", "code", "severity", "target_id", "message", _place(assembly, F.col("stage"), pos=F.col("ord")))

    own = union_all(own, placed(compound_issues(assembly.compounds)), placed(field_conflicts(assembly.candidates)))
    own = own.groupBy("group_id", "document_id", *ISSUE).agg(F.min("place").alias("place"), F.max_by("severity", "place").alias("severity"))
    labelled = assembly.structures.filter(F.col("canonical").isNotNull()).select(
        "document_id", F.col("candidate_id").alias("target_id"), normalize_label("compound_label").alias("label_key"),
    ).filter(F.col("label_key") != "")
    by_label = structure_rules(assembly.structures, parsed_only=True).join(labelled, ["document_id", "target_id"])
    lists = by_label.groupBy("document_id", "label_key", *ISSUE).agg(
        F.min(F.struct("ord", "stage")).alias("_p"), F.max_by("severity", F.struct("ord", "stage")).alias("severity")
    ).select("document_id", "label_key", *ISSUE, "severity", F.col("_p.ord").alias("structure"), F.col("_p.stage").alias("n"))
    first = F.min(F.struct((F.lit(21) + F.col("side") * 10).alias("stage"), "pos"))
    uses = assembly.compounds.filter(F.col("label_key") != "").groupBy("group_id", "document_id", "label_key").agg(first.alias("_f"))
    return IssueLists(own, lists, uses.select("group_id", "document_id", "label_key", "_f.stage", "_f.pos"))


def attach_issues(assembly: Assembly) -> DataFrame:
    """All issues of all records, one row each, distinct on (code, target, message).

    Own issues of every candidate, then per compound its A-issue and the issues of
    all parsed structures sharing the label, then field conflicts. This is the expanded view of ``issue_lists``: it
    repeats a label's list in each of its records, by one join that nothing has to sort or make distinct afterwards.
    """
    parts, keys = issue_lists(assembly), record_keys(assembly)
    own = parts.own.join(keys, "group_id")
    shared = parts.uses.join(keys, "group_id").join(parts.lists, ["document_id", "label_key"]).withColumn(
        "place", _place(assembly, F.col("stage"), pos=F.col("pos"), structure=F.col("structure"), n=F.col("n"))
    )
    columns = ["document_id", "reaction_id", "group_id", "code", "severity", "target_id", "message", "place"]
    return own.select(*columns).unionByName(shared.select(*columns))


def issue_counts(assembly: Assembly) -> DataFrame:
    """Errors and warnings of every record, from the lists as they are: no list is expanded."""
    parts = issue_lists(assembly)
    count = lambda rows, *by: rows.groupBy(*by).agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    shared = parts.uses.join(count(parts.lists, "document_id", "label_key"), ["document_id", "label_key"]).select("group_id", "errors", "warnings")
    every = count(parts.own, "group_id").unionByName(shared).groupBy("group_id").agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return assembly.records.select("document_id", "reaction_id", "group_id").join(every, "group_id", "left").select(
        "document_id", "reaction_id", zero("errors"), zero("warnings")
    )


def gathered_issues(assembly: Assembly) -> DataFrame:
    """(group_id, issues): the rows of ``attach_issues`` of every record as one array, in the order of their places.

    A place begins with (stage, pos), and stages of own issues differ from those of shared ones. So a record's array is
    its pieces in that order: its own issues by stage, and of each label it uses the whole list, sorted beforehand.
    """
    parts = issue_lists(assembly)
    value = F.struct("code", "severity", "target_id", "message", F.lit(None).cast("string").alias("suggested_value")).alias("v")

    def listed(rows, by, place):
        got = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*place, value))).alias("a"))
        return got.withColumn("a", F.transform("a", lambda x: x["v"]))

    own = listed(parts.own.withColumn("stage", F.col("place.stage")), ["group_id", "stage"], ["place"]).withColumn("pos", F.lit(-1))
    lists = listed(parts.lists, ["document_id", "label_key"], ["structure", "n"])
    shared = parts.uses.join(lists, ["document_id", "label_key"])
    columns = ["group_id", "stage", "pos", "a"]
    pieces = own.select(*columns).unionByName(shared.select(*columns))
    whole = pieces.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("stage", "pos", "a"))).alias("p"))
    return whole.select("group_id", F.flatten(F.transform("p", lambda x: x["a"])).alias("issues"))


def nested_records(assembly: Assembly) -> DataFrame:
    """Records in the array form of the public contract.

    Arrays are gathered from tables that are already distinct per record, so their
    size is that of the record itself.  Use the flat tables for further work. A label's issues are gathered and sorted
    once per label; records take the finished lists, so no issue is shuffled or sorted once more for each record.
    """
    def gathered(rows, value, place, name):
        got = rows.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), value.alias("v")))).alias("a"))
        return got.select("group_id", F.transform("a", lambda x: x["v"]).alias(name))

    compound = F.struct("label", "name", F.col("resolved_smiles").alias("smiles"), "role")
    place = F.col("pos")
    parts = [
        gathered(assembly.compounds.filter("side = 0"), compound, place, "reactants"),
        gathered(assembly.compounds.filter("side = 1"), compound, place, "products"),
        gathered(first_seen(assembly.candidates, "reagents"), F.col("item"), F.col("place"), "reagents"),
        gathered(first_seen(assembly.candidates, "solvents"), F.col("item"), F.col("place"), "solvents"),
        gathered(assembly.evidence, F.col("item"), F.col("place"), "evidence_ids"),
        gathered_issues(assembly),
    ]
    out = assembly.records
    for part in parts:
        out = out.join(part, "group_id", "left")
    compounds = "array<struct<label:string,name:string,smiles:string,role:string>>"
    issues = "array<struct<code:string,severity:string,target_id:string,message:string,suggested_value:string>>"
    empty = lambda name, kind: F.coalesce(F.col(name).cast(kind), F.array().cast(kind)).alias(name)
    return out.select(
        "document_id", F.lit("1.0").alias("schema_version"), "reaction_id",
        empty("reactants", compounds), empty("products", compounds),
        empty("reagents", "array<string>"), empty("solvents", "array<string>"),
        "temperature_c", "time", "yield_pct", empty("evidence_ids", "array<string>"),
        "confidence", "review_status", empty("issues", issues),
    )


def sort_records(records: DataFrame) -> DataFrame:
    """Total order for the sink: a range sort, not a single task."""
    return records.orderBy("document_id", "reaction_id")
