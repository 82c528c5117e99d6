"""Participant comparison between aligned records, and the metrics built on it."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import blank_to_null, participant_key, participant_ref, round4
from ..staging import staged
from .align import align_gold, match_keyed, reaction_key
from .ranking import keep_first, keep_last, union_all
from .structures import comparison_level, with_parsed

def pair_participants(pairs: DataFrame) -> DataFrame:
    """Explode each record pair into participant pairs.

    ``pairs`` holds predicted_compounds and gold_compounds.  Within a role the k-th
    participant of a label (or name) pairs with the k-th of the same label on the other
    side, then the rest the same way by structure text: a participant is paired when its
    number is at most the smaller of the two sides' counts.

    All windows and the final grouping start with the columns of ``pairs``, whose
    groups are single records, so one partitioning serves them all.
    """
    keys = [c for c in pairs.columns if c not in ("predicted_compounds", "gold_compounds")]
    size = F.size("predicted_compounds")
    rows = pairs.select(
        *keys, size.alias("_n"), F.posexplode(F.concat("predicted_compounds", "gold_compounds")).alias("_pos", "c")
    )
    is_gold = F.col("_pos") >= F.col("_n")
    rows = rows.select(
        *keys, is_gold.cast("int").alias("side"), F.when(is_gold, F.col("_pos") - F.col("_n")).otherwise(F.col("_pos")).alias("i"),
        F.col("c.role").alias("role"), participant_key(F.col("c")).alias("key"),
        F.coalesce(blank_to_null("c.smiles"), F.lit("")).alias("smiles"), participant_ref(F.col("c")).alias("ref"),
    )

    def numbered(df, value, name, usable):
        group = Window.partitionBy(*keys, "role", value)
        count = lambda n: F.count(F.when(usable & (F.col("side") == n), 1)).over(group)
        nth = F.row_number().over(Window.partitionBy(*keys, "role", value, "side").orderBy("i"))
        return df.withColumn(f"{name}_nth", nth).withColumn(
            name, usable & (F.col(f"{name}_nth") <= F.least(count(0), count(1)))
        )

    rows = numbered(rows, "key", "by_key", F.col("key") != "")
    rows = rows.withColumn("rest", F.when(~F.col("by_key"), F.col("smiles")).otherwise(""))
    rows = numbered(rows, "rest", "by_smiles", F.col("rest") != "")
    phase = F.when(F.col("by_key"), 0).when(F.col("by_smiles"), 1).otherwise(F.col("side") + 2)
    value = F.when(F.col("by_key"), F.col("key")).when(F.col("by_smiles"), F.col("rest")).otherwise("")
    nth = F.when(F.col("by_key"), F.col("by_key_nth")).when(F.col("by_smiles"), F.col("by_smiles_nth")).otherwise(F.col("i"))
    predicted, gold = F.col("side") == 0, F.col("side") == 1
    return rows.groupBy(*keys, "role", phase.alias("phase"), value.alias("_value"), nth.alias("_nth")).agg(
        F.coalesce(F.min(F.when(predicted, F.col("i"))), F.min("i")).alias("i"),
        F.max(F.when(predicted, F.col("ref"))).alias("p_ref"), F.max(F.when(gold, F.col("ref"))).alias("g_ref"),
        F.max(F.when(predicted, F.col("smiles"))).alias("p_smiles"), F.max(F.when(gold, F.col("smiles"))).alias("g_smiles"),
    ).drop("_value", "_nth")


def compare_participants(pairs: DataFrame, dictionary: DataFrame | Mapping, stereo_class: str | None = None) -> DataFrame:
    """Participant pairs -> participant_id, gold_participant_id, comparison, incomparable_reason."""
    rows = pair_participants(pairs)
    keys = [c for c in rows.columns if c not in ("p_ref", "g_ref", "p_smiles", "g_smiles")]

    both = with_parsed(rows, dictionary, "p_smiles", {"iso": "_iso_p", "noniso": "_non_p"}, *keys)
    both = with_parsed(both, dictionary, "g_smiles", {"iso": "_iso_g", "noniso": "_non_g"}, *keys)
    level, detail = comparison_level(
        "p_smiles", "g_smiles", "_iso_p", "_iso_g", "_non_p", "_non_g", stereo_class=stereo_class
    )
    paired = F.col("phase") < 2
    bare_gold, bare_pred = paired & (F.col("g_smiles") == ""), paired & (F.col("p_smiles") == "")
    out = both.withColumn("_level", level).select(
        *keys,
        F.when(F.col("phase") == 3, F.concat(F.lit("<gold:"), F.col("g_ref"), F.lit(">"))).otherwise(F.col("p_ref")).alias("participant_id"),
        F.when(F.col("phase") != 2, F.col("g_ref")).alias("gold_participant_id"),
        F.when(F.col("phase") == 3, "missing_extracted").when(F.col("phase") == 2, "missing_gold")
        .when(bare_gold | bare_pred, "uncomparable").otherwise(F.col("_level")).alias("comparison"),
        F.when(bare_gold, "gold structure not annotated").when(bare_pred, "extracted structure not annotated")
        .when(paired & (F.col("_level") == "uncomparable"), detail).alias("incomparable_reason"),
    )
    return out


def _compounds(alias: str) -> Column:
    return F.concat("reactants", "products").alias(alias)


def record_pairs(rows: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Attach both compound lists to rows that name a predicted and a benchmark id."""
    p = keep_last(predicted.select("document_id", "reaction_id", "ord", _compounds("predicted_compounds")), ["document_id", "reaction_id"])
    g = keep_last(gold.select("document_id", "reaction_id", "ord", _compounds("gold_compounds")), ["document_id", "reaction_id"])
    return rows.join(p.drop("ord"), ["document_id", "reaction_id"]).join(
        g.drop("ord").withColumnRenamed("reaction_id", "gold_reaction_id"), ["document_id", "gold_reaction_id"]
    )


def gold_comparisons(predicted: DataFrame, gold: DataFrame, dictionary: DataFrame | Mapping, source: DataFrame | None = None) -> DataFrame:
    """Alignment rows with their participant comparisons.

    ``source``: provenance rows with the ``path`` of their file; each benchmark row gets that of its ``file``.
    """
    aligned = align_gold(predicted, gold)
    sure = aligned.filter(F.col("alignment").isin("explicit_id", "mapped")).select(
        "document_id", "reaction_id", "gold_reaction_id", "g_ord"
    )
    compared = compare_participants(record_pairs(sure, predicted, gold), dictionary)
    result = F.struct("participant_id", "gold_participant_id", "comparison", "incomparable_reason")
    gathered = compared.groupBy("document_id", "g_ord").agg(
        F.array_sort(F.collect_list(F.struct("role", "phase", "i", result.alias("r")))).alias("_rs")
    ).select("document_id", "g_ord", F.transform("_rs", lambda x: x["r"]).alias("participant_results"))
    kind = gathered.schema["participant_results"].dataType
    out = aligned.join(gathered, ["document_id", "g_ord"], "left").withColumn(
        "participant_results", F.coalesce("participant_results", F.array().cast(kind))
    )
    if source is None:
        return out
    told = source.select(F.col("path").alias("file"), F.struct(*source.columns).alias("gold_source"))
    of_row = gold.select("document_id", F.col("ord").alias("g_ord"), "file").join(told, "file", "left").drop("file")
    return out.join(of_row, ["document_id", "g_ord"], "left")


METRIC_COLUMNS = (
    "n_predicted", "n_gold", "n_matched", "yield_ok", "yield_comparable", "structures_present", "structures_total",
    "structure_identical", "structure_comparable", "structure_uncomparable", "stereo_comparable",
)


def _metric_rows(df: DataFrame, by, **values) -> DataFrame:
    cols = [(values.get(m, F.lit(0))).cast("bigint").alias(m) for m in METRIC_COLUMNS]
    return df.select(*by, *cols)


def structure_pairs(predicted: DataFrame, gold: DataFrame, matches: DataFrame, by=(), pairs: str = "id") -> DataFrame:
    """Record pairs whose participants count: by predicted id, or every matched pair (``pairs='all'``)."""
    if pairs == "all":
        p = predicted.select("document_id", F.col("ord").alias("p_ord"), _compounds("predicted_compounds"), *by)
        g = gold.select("document_id", F.col("ord").alias("g_ord"), _compounds("gold_compounds"))
        return matches.join(p, ["document_id", "p_ord"]).join(g, ["document_id", "g_ord"])
    ids = ["document_id", "reaction_id"]
    p = keep_first(predicted.select(*ids, "ord", _compounds("predicted_compounds"), *by), ids).drop("ord")
    g = keep_last(gold.select(*ids, "ord", _compounds("gold_compounds")), ids).drop("ord")
    return matches.select(*ids, "p_ord", "g_ord").join(p, ids).join(g, ids)


def evaluate(predicted: DataFrame, gold: DataFrame, dictionary: DataFrame | Mapping, by=(), pairs: str = "id", totals: bool = False, contention: str = "id") -> DataFrame:
    """Counts, precision, recall, yield accuracy, structure and stereo agreement.

    Both inputs are scanned once, into tables of the columns that count, with their reaction keys. Every contribution
    becomes a row of counters and one aggregate sums them, so the final step sees one partial row per task. ``by`` splits
    the report by columns both tables carry; with ``totals`` the same aggregate also gives the rows of every shorter
    prefix of ``by`` and of everything, the missing columns null. ``contention`` is that of ``align.match_records``.
    """
    by = list(by)
    columns = ["document_id", "ord", "reaction_id", "reaction_key", "yield_pct", "reactants", "products", *by]
    predicted, gold = (staged(reaction_key(rows).select(*columns), name) for rows, name in ((predicted, "predicted"), (gold, "gold")))
    matches = staged(match_keyed(predicted, gold, contention=contention), "matches")
    p = predicted.select(
        "document_id", F.col("ord").alias("p_ord"), F.col("yield_pct").alias("p_yield"), *by, _compounds("cs")
    )
    g = gold.select("document_id", F.col("ord").alias("g_ord"), F.col("yield_pct").alias("g_yield"))
    matched = matches.join(p, ["document_id", "p_ord"]).join(g, ["document_id", "g_ord"])
    comparable = F.col("p_yield").isNotNull() & F.col("g_yield").isNotNull()
    close = comparable & (F.abs(F.col("p_yield") - F.col("g_yield")) <= 1.0)
    has_structure = F.filter(F.col("cs"), lambda c: F.coalesce(c["smiles"], F.lit("")) != "")
    compared = compare_participants(structure_pairs(predicted, gold, matches, by, pairs), dictionary)
    level = F.col("comparison")
    sided = level.isin("missing_gold", "missing_extracted")
    one = F.lit(1)
    counters = union_all(
        _metric_rows(predicted, by, n_predicted=one),
        _metric_rows(gold, by, n_gold=one),
        _metric_rows(
            matched, by, n_matched=one, yield_ok=close, yield_comparable=comparable,
            structures_present=F.size(has_structure), structures_total=F.size("cs"),
        ),
        _metric_rows(
            compared, by, structure_identical=level == "identical",
            structure_comparable=~sided & (level != "uncomparable"), structure_uncomparable=level == "uncomparable",
            stereo_comparable=level.isin("identical", "stereo_only", "stereo_specificity_differs"),
        ),
    )
    sums = (counters.rollup(*by) if totals and by else counters.groupBy(*by)).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in METRIC_COLUMNS])
    zero = F.lit(0.0)
    ratio = lambda a, b: round4(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    return sums.select(
        *by,
        F.col("n_predicted").alias("predicted_count"), F.col("n_gold").alias("gold_count"),
        F.col("n_matched").alias("matched_count"),
        F.coalesce(ratio("n_matched", "n_predicted"), zero).alias("reaction_precision"),
        F.coalesce(ratio("n_matched", "n_gold"), zero).alias("reaction_recall"),
        ratio("yield_ok", "yield_comparable").alias("yield_accuracy"),
        F.coalesce(ratio("structures_present", "structures_total"), zero).alias("structure_coverage"),
        "structure_comparable", ratio("structure_identical", "structure_comparable").alias("structure_agreement"),
        "structure_identical", "structure_uncomparable",
        "stereo_comparable", ratio("structure_identical", "stereo_comparable").alias("stereo_agreement"),
        F.col("structure_identical").alias("stereo_identical"),
        F.col("structure_uncomparable").alias("stereo_uncomparable"),
    )


def uncomparable_by_reason(compared: DataFrame, by=()) -> DataFrame:
    bad = compared.filter("comparison = 'uncomparable'")
    return bad.groupBy(*by, F.coalesce("incomparable_reason", F.lit("unknown")).alias("reason")).agg(
        F.count("*").alias("n")
    )
