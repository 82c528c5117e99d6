"""Matching predicted records with benchmark records.

Input rows need document_id, ord (unique in the document), reaction_id, reactants
and products.  ``ord`` is the row order of the source.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import content_hash
from ..functions.text import compound_keys
from ..staging import staged
from .contention import GOLD, PREDICTED, contended_rows, walk_alignment, walk_matches, without
from .ranking import long_block, number_rows, union_all


def reaction_key(df: DataFrame) -> DataFrame:
    """Add the sorted compound keys of both sides and one hash of them."""
    keyed = df.withColumn("key_reactants", compound_keys("reactants")).withColumn(
        "key_products", compound_keys("products")
    )
    digest = content_hash(F.array_join("key_reactants", "\u001d"), F.array_join("key_products", "\u001d"))
    return keyed.withColumn("reaction_key", F.substring(digest, 1, 32))


def _slim(df: DataFrame) -> DataFrame:
    return reaction_key(df).select("document_id", "ord", "reaction_id", "reaction_key")


def match_records(predicted: DataFrame, gold: DataFrame, block_bits: int = 20, contention: str = "id") -> DataFrame:
    """Pairs (document_id, p_ord, g_ord, reaction_id, gold_reaction_id, basis).

    Ids first (last predicted row, first benchmark row of an id), then the k-th
    unused predicted row of a key with the k-th benchmark row whose id is unknown.
    Each row is used once.

    ``contention`` says what becomes of a predicted row that one benchmark row names by id and an earlier one
    could take by key: ``id`` keeps it for the id, ``walk`` goes through the benchmark rows of its component in
    order, so that the earlier one may take it.
    """
    return match_keyed(staged(_slim(predicted), "predicted_keys"), staged(_slim(gold), "gold_keys"), block_bits, contention)


def match_keyed(p: DataFrame, g: DataFrame, block_bits: int = 20, contention: str = "id") -> DataFrame:
    """``match_records`` of tables that have their reaction_key; both are read several times."""
    p, g = (rows.select("document_id", "ord", "reaction_id", "reaction_key") for rows in (p, g))
    if _walks(contention):
        walked = contended_rows(p, g, _contended_keys(p, g))
        rest = match_keyed(without(p, walked, PREDICTED), without(g, walked, GOLD), block_bits)
        return rest.unionByName(walk_matches(walked))
    known = F.coalesce(F.col("reaction_id"), F.lit("")) != ""
    p_last = p.filter(known).groupBy("document_id", "reaction_id").agg(F.max("ord").alias("p_ord"))
    g_first = g.groupBy("document_id", "reaction_id").agg(F.min("ord").alias("g_ord"))
    by_id = g_first.join(p_last, ["document_id", "reaction_id"])
    g_left = g.join(p_last, ["document_id", "reaction_id"], "left_anti")
    p_left = p.withColumnRenamed("ord", "p_ord").join(
        by_id.select("document_id", "p_ord"), ["document_id", "p_ord"], "left_anti"
    )
    keys = ["document_id", "reaction_key"]
    p_ranked = number_rows(p_left, keys, "p_ord", long_block("p_ord", block_bits))
    g_ranked = number_rows(
        g_left.select("document_id", "reaction_key", F.col("ord").alias("g_ord"), F.col("reaction_id").alias("gold_reaction_id")),
        keys, "g_ord", long_block("g_ord", block_bits),
    )
    by_key = p_ranked.join(g_ranked, [*keys, "rn"]).select(
        "document_id", "p_ord", "g_ord", "reaction_id", "gold_reaction_id", F.lit("key").alias("basis")
    )
    return by_id.select(
        "document_id", "p_ord", "g_ord", "reaction_id", F.col("reaction_id").alias("gold_reaction_id"),
        F.lit("id").alias("basis"),
    ).unionByName(by_key)


def align_gold(predicted: DataFrame, gold: DataFrame, contention: str = "id") -> DataFrame:
    """One row per benchmark row and per unused predicted row, with how they were aligned.

    Only counts and first rows per id and key are needed, so every step is an
    aggregate with a fixed-size buffer or an equi join; no group is ever gathered.
    ``contention`` is that of ``match_records``: with ``walk``, contended components alone are gathered and walked.
    """
    p, g = staged(_slim(predicted), "predicted_keys"), staged(_slim(gold), "gold_keys")
    if not _walks(contention):
        return _align_keyed(p, g)
    walked = contended_rows(p, g, _contended_keys(p, g))
    rest = _align_keyed(staged(without(p, walked, PREDICTED), "predicted_keys"), staged(without(g, walked, GOLD), "gold_keys"))
    return rest.unionByName(walk_alignment(walked))


def _walks(contention: str) -> bool:
    if contention not in ("id", "walk"):
        raise ValueError(f"contention is 'id' or 'walk', not {contention!r}")
    return contention == "walk"


def _align_keyed(p: DataFrame, g: DataFrame) -> DataFrame:
    id_cols, key_cols = ["document_id", "reaction_id"], ["document_id", "reaction_key"]
    p_first = p.groupBy(*id_cols).agg(F.min("ord").alias("p_ord"))
    g_ids = g.groupBy(*id_cols).agg(F.count("*").alias("n_same_id"), F.min("ord").alias("first_ord"))
    seen = g.join(g_ids, id_cols).join(p_first, id_cols, "left")

    used_by_id = p_first.join(g_ids, id_cols, "left_semi").select("document_id", F.col("p_ord").alias("ord"))
    unused = p.join(used_by_id, ["document_id", "ord"], "left_anti")
    options = unused.groupBy(*key_cols).agg(
        F.count("*").alias("n_options"), F.min("ord").alias("option_ord"),
        F.min_by("reaction_id", "ord").alias("option_id"),
    )
    open_gold = seen.filter((F.col("n_same_id") == 1) & F.col("p_ord").isNull())
    key_first = open_gold.groupBy(*key_cols).agg(F.min("ord").alias("key_first_ord"))

    repeated = F.concat(
        F.lit("duplicate gold reaction_id '"), F.col("reaction_id"), F.lit("' ("), F.col("n_same_id").cast("string"),
        F.lit(" occurrences)"),
    )
    missing_id = F.concat(F.lit("<gold:"), F.col("reaction_id"), F.lit(">"))
    taken = F.col("p_ord").isNotNull() & (F.col("ord") == F.col("first_ord"))

    def rows(df, reaction_id, alignment, basis, p_ord):
        return df.select(
            "document_id", reaction_id.alias("reaction_id"), F.col("reaction_id").alias("gold_reaction_id"),
            alignment.alias("alignment"), basis.alias("alignment_basis"), p_ord.alias("p_ord"), F.col("ord").alias("g_ord"),
        )

    nothing = F.lit(None).cast(p.schema["ord"].dataType)
    twice = rows(
        seen.filter("n_same_id > 1"), F.when(taken, F.col("reaction_id")).otherwise(missing_id),
        F.when(taken, "ambiguous").otherwise("unmatched_gold"), repeated, F.when(taken, F.col("p_ord")),
    )
    exact = rows(
        seen.filter((F.col("n_same_id") == 1) & F.col("p_ord").isNotNull()), F.col("reaction_id"),
        F.lit("explicit_id"), F.lit("reaction_id equality"), F.col("p_ord"),
    )
    offered = open_gold.drop("p_ord").join(options, key_cols, "left").join(key_first, key_cols, "left")
    mapped = (F.col("n_options") == 1) & (F.col("ord") == F.col("key_first_ord"))
    several = F.col("n_options") > 1
    by_key = rows(
        offered, F.when(mapped, F.col("option_id")).otherwise(missing_id),
        F.when(mapped, "mapped").when(several, "ambiguous").otherwise("unmatched_gold"),
        F.when(mapped, "reaction_key match").when(
            several, F.concat(F.lit("multiple candidates ("), F.col("n_options").cast("string"), F.lit(") for reaction_key"))
        ).otherwise("no candidate found"),
        F.when(mapped, F.col("option_ord")),
    )
    consumed = by_key.filter("alignment = 'mapped'").select("document_id", F.col("p_ord").alias("ord"))
    leftover = unused.join(consumed, ["document_id", "ord"], "left_anti").select(
        "document_id", "reaction_id", F.lit(None).cast("string").alias("gold_reaction_id"),
        F.lit("unmatched_extracted").alias("alignment"), F.lit("no gold match").alias("alignment_basis"),
        F.col("ord").alias("p_ord"), nothing.alias("g_ord"),
    )
    return union_all(twice, exact, by_key, leftover)


def id_key_contention(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted rows claimed by id that share a key with an earlier benchmark row of unknown id.

    A row-by-row walk over the benchmark may give such a row away by key; ``contention``
    chooses between it and the id match.  The count tells how many rows that choice concerns.
    """
    return _contended_keys(_slim(predicted), _slim(gold))


def _contended_keys(p: DataFrame, g: DataFrame) -> DataFrame:
    known = p.select("document_id", "reaction_id").distinct()
    open_first = g.join(known, ["document_id", "reaction_id"], "left_anti").groupBy("document_id", "reaction_key").agg(
        F.min("ord").alias("open_ord")
    )
    claims = g.groupBy("document_id", "reaction_id").agg(F.min("ord").alias("claim_ord"))
    claimed = p.join(claims, ["document_id", "reaction_id"]).join(open_first, ["document_id", "reaction_key"])
    return claimed.filter(F.col("open_ord") < F.col("claim_ord")).select("document_id", "reaction_id", "reaction_key")
