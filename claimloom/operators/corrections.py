"""Human corrections: edits, revalidation, decisions, stale decisions and audit rows."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import variants as V
from ..functions.text import blank_to_null
from ..schemas import COMPOUND, COMPOUND_ROLES, EDITABLE_ROOTS, REASON_REQUIRED, REVIEW_STATUSES
from ..staging import staged
from .ranking import union_all
from .review import IDS, with_record_hash
from .structures import Parser, structure_dictionary

COMPOUND_ROOTS = ("reactants", "products")
TEXT_ROOTS = ("reagents", "solvents")
SCALAR_ROOTS = ("temperature_c", "time", "yield_pct", "review_status")
LISTS = COMPOUND_ROOTS + TEXT_ROOTS
COMPOUND_FIELDS = ("label", "name", "smiles", "role")
_COMPOUNDS = "array<struct<label:string,name:string,smiles:string,role:string>>"
_ISSUES = "array<struct<code:string,severity:string,target_id:string,message:string,suggested_value:string>>"


def _compound_of(v: Column) -> Column:
    def read(found):
        return F.struct(
            *[blank_to_null(V.text_of(found[f])).alias(f) for f in ("label", "name", "smiles")],
            F.coalesce(V.text_of(found["role"]), F.lit("unknown")).alias("role"),
        )

    return V.let(V.fields(v, *COMPOUND_FIELDS), read).cast(COMPOUND)


def parsed_edits(edits: DataFrame) -> DataFrame:
    """Split paths and type the JSON values of edit rows (path, value as JSON text).

    A value is read only in the forms that its operation and path can use; a number asked of any other text, or the
    fields of one, would cost more than the rest of the row.
    """
    parts = F.split("path", r"\.")
    rows = edits.withColumn("_v", V.parse_strict("value")).withColumn("_parts", parts).select(
        *edits.columns, "_v", F.get("_parts", F.lit(0)).alias("root"), F.size("_parts").alias("depth"),
        F.get("_parts", F.lit(1)).try_cast("int").alias("idx"), F.get("_parts", F.lit(2)).alias("field"),
    )
    added, sets = F.col("op") == "add_participant", F.col("op") == "set_value"
    whole, of_compounds = sets & (F.col("depth") == 1) & F.col("root").isin(*LISTS), F.col("root").isin(*COMPOUND_ROOTS)
    element, worded = sets & (F.col("depth") == 2), sets & F.col("root").isin("time", *TEXT_ROOTS)
    numeric = sets & F.col("root").isin("temperature_c", "yield_pct")
    return rows.select(
        *edits.columns, "root", "depth", "idx", "field",
        V.is_null(F.col("_v")).alias("is_null"), F.when(worded, V.is_text("_v")).alias("is_text"),
        F.when(element & of_compounds, V.is_object("_v")).alias("is_object"), F.when(whole, V.is_array("_v")).alias("is_list"),
        F.when(~whole, V.text_of("_v")).alias("text"),
        F.when(numeric, F.try_variant_get("_v", F.lit("$"), "double")).alias("number"),
        F.when(added | (element & of_compounds), _compound_of(F.col("_v"))).alias("compound"),
        F.when(added, F.coalesce(V.text_of(V.get("_v", "role")), F.lit("reactant"))).alias("add_side"),
        F.when(whole & of_compounds, F.transform(V.as_array("_v"), _compound_of)).alias("compounds"),
        F.when(whole, F.transform(V.as_array("_v"), lambda x: V.text_of(x))).alias("texts"),
    )


def checked_edits(edits: DataFrame, records: DataFrame) -> DataFrame:
    """Parsed edits with what their checks ask of their record: ``known``, ``sizes`` of its lists, ``mixed`` (an edit of the
    record adds or removes participants) and ``new_size`` of a list that the same package sets whole.

    One join; the windows keep its partitioning, so edits are moved once whatever is asked.
    """
    sizes = records.groupBy(*IDS).agg(*[F.min(F.size(c)).alias(f"_n_{c}") for c in LISTS])
    sizes = sizes.select(*IDS, F.struct(*[F.col(f"_n_{c}").alias(c) for c in LISTS]).alias("sizes"), F.lit(True).alias("known"))
    rows = parsed_edits(edits.join(sizes, IDS, "left"))
    moving = F.col("op").isin("add_participant", "remove_participant")
    resizing = (F.col("op") == "set_value") & (F.col("depth") == 1) & F.col("root").isin(*LISTS) & F.col("package_id").isNotNull()
    return rows.withColumn("mixed", F.coalesce(F.max(moving).over(Window.partitionBy(*IDS)), F.lit(False))).withColumn(
        "new_size", F.max(F.when(resizing, F.size("texts"))).over(Window.partitionBy(*IDS, "root", "package_id"))
    )


def edit_errors(edits: DataFrame) -> DataFrame:
    """One row per set_value that cannot be applied: package_id, document_id, reaction_id, path, error.

    ``edits`` comes from ``checked_edits`` and carries ``package_id``.
    """
    size = F.coalesce(
        *[F.when(F.col("root") == c, F.greatest(F.col(f"sizes.{c}"), F.coalesce("new_size", F.lit(0)))) for c in LISTS]
    )
    growing = edits.filter("op = 'set_value'").withColumn("_size", size)
    is_compound, is_texts = F.col("root").isin(*COMPOUND_ROOTS), F.col("root").isin(*TEXT_ROOTS)
    is_scalar = F.col("root").isin(*SCALAR_ROOTS)
    whole, element, inner = F.col("depth") == 1, F.col("depth") == 2, F.col("depth") == 3
    shape = (
        (is_scalar & whole) | (is_texts & (whole | element))
        | (is_compound & (whole | element | (inner & F.col("field").isin(*COMPOUND_FIELDS))))
    )
    indexed = ~whole & (is_texts | is_compound)
    value = (
        F.when(F.col("root").isin("temperature_c", "yield_pct"), F.col("is_null") | F.col("number").isNotNull())
        .when(F.col("root") == "time", F.col("is_null") | F.col("is_text"))
        .when(F.col("root") == "review_status", F.coalesce(F.col("text").isin(*REVIEW_STATUSES), F.lit(False)))
        .when(whole, F.col("is_list")).when(is_texts & element, F.col("is_text"))
        .when(is_compound & element, F.col("is_object"))
        .when(inner & (F.col("field") == "role"), F.coalesce(F.col("text").isin(*COMPOUND_ROLES), F.lit(False)))
        .otherwise(F.lit(True))
    )
    percent = (F.col("root") != "yield_pct") | F.col("number").isNull() | F.col("number").between(0, 100)
    error = (
        F.when(F.col("known").isNull(), "unknown reaction")
        .when(F.col("path").isNull(), "set_value requires a path")
        .when(~F.coalesce(F.col("root").isin(*EDITABLE_ROOTS), F.lit(False)), "path is not editable")
        .when(~F.coalesce(shape, F.lit(False)), "invalid path")
        .when(indexed & ~F.coalesce((F.col("idx") >= 0) & (F.col("idx") < F.col("_size")), F.lit(False)), "index out of range")
        .when(~F.coalesce(value & percent, F.lit(False)), "invalid value")
    )
    return growing.select("package_id", *IDS, "path", error.alias("error")).filter(F.col("error").isNotNull())


_STEP_FIELDS = ("ord", "op", "root", "depth", "idx", "field", "target_id", "text", "compound", "add_side", "compounds", "texts")


def record_steps(edits: DataFrame, every: bool = False) -> DataFrame:
    """One row per edited record: ordered list steps and the last value of each scalar.

    Where nothing is added or removed (``mixed``) only the last value of a path counts, so those records gather at most
    one step per path.  Only records that mix the two keep their whole (human-written) sequence. Edits are moved once, by
    record. With ``every`` records that a package names without changing their data have a row too.
    """
    moving, sets = F.col("op").isin("add_participant", "remove_participant"), F.col("op") == "set_value"
    on_lists, on_scalars = moving | (sets & F.col("root").isin(*LISTS)), sets & F.col("root").isin(*SCALAR_ROOTS)
    rows = edits if every else edits.filter(on_lists | on_scalars)
    order = Window.partitionBy(*IDS, "path").orderBy(F.col("ord").desc())
    rows = rows.repartition(*IDS).withColumn("_last", F.row_number().over(order) == 1)
    pick = lambda root: sets & (F.col("root") == root)
    return rows.groupBy(*IDS).agg(
        F.array_sort(F.collect_list(F.when(on_lists & (F.col("mixed") | F.col("_last")), F.struct(*_STEP_FIELDS)))).alias("steps"),
        *[F.max_by(F.when(pick(r), F.struct("text", "number")), F.when(pick(r), F.col("ord"))).alias(f"set_{r}") for r in SCALAR_ROOTS],
        F.coalesce(F.bool_or(F.col("op") == "confirm"), F.lit(False)).alias("_confirmed"),
    )


def _apply_list_step(state: Column, o: Column) -> Column:
    sets = o["op"] == "set_value"

    def compounds(name, role):
        now = state[name]
        placed = F.transform(
            now,
            lambda c, i: F.when(i != o["idx"], c).when(o["depth"] == 2, o["compound"]).otherwise(
                F.struct(
                    *[
                        F.when(o["field"] == f, o["text"] if f == "role" else blank_to_null(o["text"])).otherwise(c[f]).alias(f)
                        for f in COMPOUND_FIELDS
                    ]
                )
            ),
        )
        return (
            F.when((o["op"] == "add_participant") & (o["add_side"] == role), F.concat(now, F.array(o["compound"])))
            .when(
                (o["op"] == "remove_participant") & (o["target_id"] != ""),
                F.filter(now, lambda c: ~c["label"].eqNullSafe(o["target_id"])),
            )
            .when(sets & (o["root"] == name) & (o["depth"] == 1), o["compounds"])
            .when(sets & (o["root"] == name), placed).otherwise(now).cast(_COMPOUNDS)
        )

    def texts(name):
        now = state[name]
        placed = F.transform(now, lambda x, i: F.when(i == o["idx"], o["text"]).otherwise(x))
        return (
            F.when(sets & (o["root"] == name) & (o["depth"] == 1), o["texts"]).when(sets & (o["root"] == name), placed)
            .otherwise(now).cast("array<string>")
        )

    beyond = F.lit(False)
    for name in LISTS:
        beyond = beyond | (sets & (o["root"] == name) & (o["depth"] > 1) & (o["idx"] >= F.size(state[name])))
    return F.struct(
        compounds("reactants", "reactant").alias("reactants"), compounds("products", "product").alias("products"),
        texts("reagents").alias("reagents"), texts("solvents").alias("solvents"),
        (state["bad"] | F.coalesce(beyond, F.lit(False))).alias("bad"),
    )


def edited_records(records: DataFrame, edits: DataFrame, every: bool = False) -> DataFrame:
    """Only the touched records, with their edits applied in order; ``bad`` marks an index miss, ``_confirmed`` a confirm."""
    joined = records.join(record_steps(edits, every), IDS)
    start = F.struct(
        *[F.col(c).cast(_COMPOUNDS).alias(c) for c in COMPOUND_ROOTS],
        *[F.col(c).cast("array<string>").alias(c) for c in TEXT_ROOTS], F.lit(False).alias("bad"),
    )
    result = joined.withColumn(
        "_state", F.when(F.size("steps") == 0, start).otherwise(F.aggregate("steps", start, _apply_list_step))
    )
    scalar = {
        "temperature_c": "number", "yield_pct": "number", "time": "text", "review_status": "text",
    }
    columns = []
    for name in records.columns:
        if name in LISTS:
            columns.append(F.col(f"_state.{name}").alias(name))
        elif name in scalar:
            picked = F.col(f"set_{name}")
            columns.append(F.when(picked.isNotNull(), picked[scalar[name]]).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return result.select(*columns, F.col("review_status").alias("pre_status"), F.col("_state.bad").alias("bad"), "_confirmed")


def revalidate(records: DataFrame, parser: Parser) -> DataFrame:
    """Canonical structures, fresh invalid-structure issues, status; a rejected record stays rejected.

    Adds ``issues_added``.  Structures are parsed once per distinct text; a parser of Column functions is applied where
    the records lie, and nothing is joined.
    """
    if isinstance(parser, Mapping):
        rows = records
        canonical = lambda c: F.when(blank_to_null(c["smiles"]).isNotNull(), parser["iso"](c["smiles"]))
    else:
        texts = records.select(*IDS, F.explode(F.array_distinct(F.concat("reactants.smiles", "products.smiles"))).alias("smiles"))
        texts = texts.filter(F.coalesce("smiles", F.lit("")) != "")
        dictionary = structure_dictionary(texts, parser)
        parsed = texts.join(dictionary.select(F.col("raw").alias("smiles"), "iso"), "smiles").filter(F.col("iso").isNotNull())
        maps = parsed.groupBy(*IDS).agg(F.map_from_entries(F.collect_list(F.struct("smiles", "iso"))).alias("_canon"))
        rows = records.join(maps, IDS, "left")
        canonical = lambda c: F.try_element_at("_canon", F.coalesce(c["smiles"], F.lit("")))
    for name in COMPOUND_ROOTS:
        rows = rows.withColumn(f"_{name}", F.transform(name, lambda c: F.struct(c.alias("c"), canonical(c).alias("iso"))))
    has_text = lambda c: F.coalesce(c["smiles"], F.lit("")) != ""
    fixed = lambda name: F.transform(
        f"_{name}", lambda x: x["c"].withField("smiles", F.coalesce(x["iso"], x["c"]["smiles"]))
    ).alias(name)
    found = F.transform(
        F.filter(F.concat("_reactants", "_products"), lambda x: has_text(x["c"]) & x["iso"].isNull()),
        lambda x: F.struct(
            F.lit("R001_INVALID_SMILES").alias("code"), F.lit("error").alias("severity"),
            F.coalesce(F.nullif(x["c"]["label"], F.lit("")), F.col("reaction_id")).alias("target_id"),
            F.concat(F.lit("Invalid SMILES: "), x["c"]["smiles"]).alias("message"), F.lit(None).cast("string").alias("suggested_value"),
        ),
    )
    rows = rows.withColumn("_new", F.array_distinct(found).cast(_ISSUES)).withColumn(
        "_kept", F.filter("issues", lambda i: i["code"] != "R001_INVALID_SMILES").cast(_ISSUES)
    )
    rows = rows.withColumn("_all", F.concat("_kept", "_new"))
    errors = F.exists("_all", lambda i: i["severity"] == "error")
    status = (
        F.when(F.col("review_status") == "rejected", "rejected").when(errors, "needs_review").otherwise("accepted")
    )
    replaced = {"issues": F.col("_all").alias("issues"), "review_status": status.alias("review_status")}
    replaced.update({c: fixed(c) for c in COMPOUND_ROOTS})
    return rows.select(*[replaced.get(c, F.col(c)) for c in records.columns], F.size("_new").alias("issues_added"))


def audit_rows(changed: DataFrame, edits: DataFrame, at=None, voided: DataFrame | None = None) -> DataFrame:
    """Per changed record: confirmer, time, distinct edited paths, status before and after, counts.

    ``at`` is the time of confirmation (text), by default now in UTC; ``voided`` the decisions that the edits made void. The
    full sequence of edits stays in the edit table, keyed by the same ids.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    confirmed_at = (now if at is None else F.lit(at).cast("string")).alias("confirmed_at")
    paths = edits.filter(F.col("path").isNotNull()).groupBy(*IDS, "path").agg(F.min("ord").alias("o"))
    listed = paths.groupBy(*IDS).agg(F.array_sort(F.collect_list(F.struct("o", "path"))).alias("ps"))
    counted = edits.groupBy(*IDS).agg(
        F.count("*").alias("operations_count"), F.max_by("confirmed_by", "ord").alias("confirmed_by"),
        F.max_by("package_id", "ord").alias("submission_id"),
    )
    rows = changed.select(*IDS, "pre_status", F.col("review_status").alias("post_status"), "issues_added").join(
        counted, IDS
    ).join(listed, IDS, "left")
    void = F.lit(0).cast("bigint")
    if voided is not None:
        rows = rows.join(voided.groupBy(*IDS).agg(F.count("*").alias("_void")), IDS, "left")
        void = F.coalesce("_void", void)
    return rows.select(
        *IDS, "submission_id", "confirmed_by", F.transform("ps", lambda x: x["path"]).alias("paths"), "operations_count",
        "pre_status", "post_status", "issues_added", confirmed_at, void.alias("invalidated_decisions"),
    )


def package_errors(edits: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits of packages without any error, the same packages' ids)."""
    bad = staged(errors.select("package_id").distinct(), "refused")  # few rows, of a size the joins know
    good = edits.join(bad, "package_id", "left_anti")
    return good, good.select("package_id").distinct()


def apply_corrections(records: DataFrame, corrections: DataFrame, parser: Parser) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corrected touched records, audit rows, errors).

    ``corrections``: package_id, document_id, ord, reaction_id, path, value (JSON
    text), confirmed_by.  A package with one bad correction is left out whole.
    """
    edits, errors = checked_corrections(records, corrections)
    good, _ = package_errors(edits, errors)
    edited = edited_records(records, good).drop("_confirmed")
    changed = staged(revalidate(edited if isinstance(parser, Mapping) else staged(edited, "edited"), parser), "corrected")
    return changed.drop("bad", "pre_status", "issues_added"), audit_rows(changed, good), errors


def checked_corrections(records: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checked edits, errors) of corrections, without applying any; ``apply_corrections`` begins with these."""
    edits = checked_edits(corrections.withColumn("op", F.lit("set_value")).withColumn("target_id", F.lit("")), records)
    edits = staged(edits, "edits")
    blank = edits.filter(F.coalesce(F.trim("confirmed_by"), F.lit("")) == "").select(
        "package_id", *IDS, "path", F.lit("confirmed_by must be a non-empty string").alias("error")
    )
    return edits, staged(edit_errors(edits).unionByName(blank), "correction-errors")


def version_conflicts(base_hashes: DataFrame, records: DataFrame) -> DataFrame:
    """Reactions whose current hash is not the one the package saw (or that are unknown)."""
    now = with_record_hash(records).select(*IDS, F.col("record_hash").alias("_now"))
    joined = base_hashes.join(now, IDS, "left")
    return joined.filter(F.col("_now").isNull() | (F.col("_now") != F.col("record_hash"))).select(*base_hashes.columns)


CONCLUSION_OF = {"confirm": "confirmed", "mark_pending": "pending", "mark_not_applicable": "not_applicable", "reject": "rejected"}


def ops_to_decisions(operations: DataFrame, record_hashes: DataFrame, created_at) -> tuple[DataFrame, DataFrame]:
    """(decision rows, operations whose conclusion needs a reason but has none).

    ``operations`` carries ``reviewer``; data-only operations give no decision.
    """
    table = F.create_map(*[F.lit(x) for pair in CONCLUSION_OF.items() for x in pair])
    rows = operations.withColumn("conclusion", table[F.col("op")]).filter(F.col("conclusion").isNotNull())
    unreasoned = F.col("conclusion").isin(*REASON_REQUIRED) & (F.coalesce("reason", F.lit("")) == "")
    hashed = rows.filter(~unreasoned).join(record_hashes.select(*IDS, "record_hash"), IDS)
    decisions = hashed.select(
        "document_id", "ord", F.concat_ws(":", "reaction_id", "target_kind", "target_id", "op").alias("decision_id"),
        "reaction_id", "target_kind", "target_id", "conclusion", "reason", "reviewer", "record_hash",
        F.lit(created_at).cast("string").alias("created_at"),
    )
    return decisions, rows.filter(unreasoned)


def affected_kinds(operations: DataFrame) -> DataFrame:
    """Distinct (reaction, target kind) whose earlier decisions an operation makes void."""
    structure = F.array(F.lit("participant_structure"), F.lit("stereo"))
    kinds = (
        F.when((F.col("op") == "set_value") & (F.col("target_kind") == "participant_structure"), structure)
        .when(F.col("op").isin("add_participant", "remove_participant", "change_role"), F.array(F.lit("completeness")))
        .when(F.col("op") == "set_value", F.array("target_kind"))
    )
    return operations.select(*IDS, F.explode(kinds).alias("target_kind")).distinct()


def stale_decisions(decisions: DataFrame, operations: DataFrame, record_hashes: DataFrame) -> DataFrame:
    """Decisions made void by operations or by a changed record; a rejection never is."""
    kinds = affected_kinds(operations).withColumn("_kind_hit", F.lit(True))
    now = record_hashes.select(*IDS, F.col("record_hash").alias("_now")).filter(F.col("_now") != "")
    changed = decisions.select(*IDS, "record_hash").join(now, IDS).groupBy(*IDS).agg(
        F.bool_or(F.col("record_hash") != F.col("_now")).alias("_changed")
    )
    joined = decisions.join(kinds, [*IDS, "target_kind"], "left").join(changed, IDS, "left")
    void = F.coalesce("_kind_hit", F.lit(False)) | F.coalesce("_changed", F.lit(False))
    return joined.filter((F.col("conclusion") != "rejected") & void).select(*decisions.columns)


def apply_operations(
    records: DataFrame, operations: DataFrame, submissions: DataFrame, parser: Parser,
    base_hashes: DataFrame | None = None, ledger: DataFrame | None = None, decisions: DataFrame | None = None, at=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(touched records after the packages, audit rows, errors).

    ``submissions``: package_id, reviewer, confirmed_by.  ``operations``: package_id,
    document_id, ord, reaction_id, target_kind, target_id, op, path, value (JSON
    text), reason.  ``base_hashes``: package_id, document_id, reaction_id,
    record_hash.  A package with any error is left out whole.  With ``base_hashes``, of several packages of
    one batch that name a record the first (smallest ord) may pass; the others did not see its outcome and conflict.
    With ``decisions``, the audit counts those that the packages made void; ``at`` is its time.
    """
    submissions = staged(submissions, "packages")
    repeated = submissions.groupBy("package_id").count().filter("count > 1").select("package_id")
    marked = staged(checked_edits(operations.join(submissions.dropDuplicates(["package_id"]), "package_id"), records), "edits")
    known, unknown = marked.filter("known"), marked.filter("known IS NULL")

    def whole(rows, message):
        empty = F.lit(None).cast("string")
        return rows.select("package_id", empty.alias("document_id"), empty.alias("reaction_id"), empty.alias("path"), F.lit(message).alias("error"))

    confirmer = F.coalesce(F.trim("confirmed_by"), F.lit(""))
    errors = [
        edit_errors(known.filter("NOT mixed")),
        _replay_errors(records, known.filter("mixed")),
        unknown.select("package_id", *IDS, "path", F.lit("unknown reaction").alias("error")).distinct(),
        whole(repeated, "duplicate submission"),
        whole(submissions.filter(confirmer == ""), "confirmed_by must be a non-empty string"),
        whole(submissions.filter(confirmer != F.col("reviewer")), "reviewer does not match confirmed_by"),
    ]
    if ledger is not None:
        errors.append(whole(submissions.join(ledger.select("package_id").distinct(), "package_id", "left_semi"), "duplicate submission"))
    if base_hashes is not None:
        conflicts = version_conflicts(base_hashes, records)
        errors.append(conflicts.select("package_id", *IDS, F.lit(None).cast("string").alias("path"), F.lit("version conflict").alias("error")))
        errors.append(_later_packages(known))
    errors = staged(union_all(*errors), "package-errors")
    good, _ = package_errors(known, errors)
    changed = staged(_changed_records(records, good, parser), "corrected")
    voided = None if decisions is None else stale_decisions(decisions, good, with_record_hash(changed.drop("pre_status", "issues_added")))
    return changed.drop("pre_status", "issues_added"), audit_rows(changed, good, at, voided), errors


def _later_packages(edits: DataFrame) -> DataFrame:
    named = edits.groupBy(*IDS, "package_id").agg(F.min("ord").alias("ord"))
    first = named.groupBy(*IDS).agg(F.min_by("package_id", "ord").alias("_first"))
    late = named.join(first, IDS).filter("package_id <> _first")
    return late.select("package_id", *IDS, F.lit(None).cast("string").alias("path"), F.lit("version conflict").alias("error"))


def _replay_errors(records: DataFrame, own: DataFrame) -> DataFrame:
    """Path and value errors of records whose lists change size (``own``: all their edits), found by replaying them."""
    checked = edit_errors(own).filter("error <> 'index out of range'")
    replayed = edited_records(records, own).filter("bad").select(*IDS)
    missed = own.join(replayed, IDS, "left_semi").select("package_id", *IDS).distinct()
    return checked.unionByName(
        missed.select("package_id", *IDS, F.lit(None).cast("string").alias("path"), F.lit("index out of range").alias("error"))
    )


def _changed_records(records: DataFrame, edits: DataFrame, parser: Parser) -> DataFrame:
    """Edits applied and revalidated, then the status rule of review packages:
    errors -> needs_review, a confirm -> accepted, otherwise the status stays."""
    edited = edited_records(records, edits, every=True).drop("bad").withColumn("_status", F.col("review_status"))
    checked = revalidate(edited if isinstance(parser, Mapping) else staged(edited, "edited"), parser)
    errors = F.exists("issues", lambda i: i["severity"] == "error")
    status = (
        F.when(F.col("_status") == "rejected", "rejected").when(errors, "needs_review")
        .when(F.col("_confirmed"), "accepted").otherwise(F.col("_status"))
    )
    return checked.withColumn("review_status", status).drop("_status", "_confirmed")


def effective_records(records: DataFrame, corrected: DataFrame) -> DataFrame:
    """The corrected revision where there is one, else the original; originals stay in place."""
    body = [c for c in records.columns if c not in IDS]
    new = corrected.select(*IDS, F.struct(*body).alias("_new"))
    joined = records.join(new, IDS, "left")
    return joined.select(*IDS, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in body])
