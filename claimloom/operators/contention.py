"""Rows for which the order of claims matters, and the row-by-row walk over just these.

A benchmark row of unknown id may take, by key, a predicted row that a later benchmark row
names by id.  What happens next depends on the order of the benchmark, so such rows are
walked one by one.  Rows of a document that share an id or a key, directly or through
others, are one component; a component without such a claim has the same outcome in any
order and is left to the joins of ``align``.

A component lies within one document and travels as four short columns per row.  Its walk is one task, since each
step needs the one before it: rows of one component must fit that task, about 100 bytes each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..staging import staged

PREDICTED, GOLD = 0, 1


def contended_rows(predicted: DataFrame, gold: DataFrame, seeds: DataFrame) -> DataFrame:
    """(document_id, side, ord, reaction_id, reaction_key, component) of every component that holds a seed.

    ``seeds`` are (document_id, reaction_key).  Only documents with a seed are looked at.  Labels go from keys
    to ids and back, and each label is replaced by its own label, until no label changes: a number of
    rounds that grows with the logarithm of the longest chain, each ending in a written table.
    """
    seeds = staged(seeds.select("document_id", "reaction_key").distinct(), "contended_keys")
    documents = seeds.select("document_id").distinct()
    columns = ["document_id", "ord", "reaction_id", "reaction_key"]
    rows = predicted.select(*columns, F.lit(PREDICTED).alias("side")).unionByName(gold.select(*columns, F.lit(GOLD).alias("side")))
    known = F.coalesce("reaction_id", F.lit("")) != ""
    key_node = F.xxhash64("document_id", F.lit("key"), "reaction_key")
    rows = staged(
        rows.join(documents, "document_id", "left_semi").withColumn("key_node", key_node)
        .withColumn("id_node", F.when(known, F.xxhash64("document_id", F.lit("id"), "reaction_id"))), "contended_documents",
    )
    links = rows.filter("id_node IS NOT NULL").select("key_node", "id_node").distinct()
    labels = staged(rows.select("key_node", F.col("key_node").alias("label")).distinct(), "component_labels")
    while True:
        by_id = links.join(labels, "key_node").groupBy("id_node").agg(F.min("label").alias("offer"))
        offers = links.join(by_id, "id_node").groupBy("key_node").agg(F.min("offer").alias("offer"))
        lower = staged(
            labels.join(offers, "key_node", "left").select("key_node", "label", F.least("label", F.coalesce("offer", "label")).alias("lower")),
            "component_offers",
        )
        if lower.filter("lower <> label").isEmpty():
            break
        further = lower.select(F.col("key_node").alias("lower"), F.col("lower").alias("lowest"))
        labels = staged(lower.join(further, "lower").select("key_node", F.least("lower", "lowest").alias("label")), "component_labels")
    hit = labels.join(seeds.select(key_node.alias("key_node")), "key_node", "left_semi").select("label").distinct()
    held = labels.join(hit, "label", "left_semi").withColumnRenamed("label", "component")
    return staged(rows.join(held, "key_node").drop("key_node", "id_node"), "contended_rows")


def _sides(rows: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    rows = rows.sort_values("ord", kind="stable")
    sides = [rows[rows["side"] == side] for side in (PREDICTED, GOLD)]
    return tuple(list(zip(s["ord"].tolist(), s["reaction_id"].tolist(), s["reaction_key"].tolist())) for s in sides)


def walk_matches(rows: DataFrame) -> DataFrame:
    """Pairs as ``align.match_records`` gives them, benchmark rows in order: the last predicted row of the id, else the
    first unused one of the key; a benchmark row whose choice is used has no pair."""
    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        predicted, gold = _sides(group)
        by_id = {name: (at, name) for at, name, _ in predicted if name}
        by_key: dict = {}
        for at, name, form in reversed(predicted):
            by_key.setdefault(form, []).append((at, name))
        used, out = set(), []
        for at, name, form in gold:
            chosen, basis = by_id.get(name), "id"
            if chosen is None:
                options, basis = by_key.get(form, []), "key"
                while options and options[-1][0] in used:
                    options.pop()
                chosen = options[-1] if options else None
            if chosen is not None and chosen[0] not in used:
                used.add(chosen[0])
                out.append((key[0], chosen[0], at, chosen[1], name, basis))
        return pd.DataFrame(out, columns=["document_id", "p_ord", "g_ord", "reaction_id", "gold_reaction_id", "basis"])

    kind = rows.schema["ord"].dataType.simpleString()
    schema = f"document_id string, p_ord {kind}, g_ord {kind}, reaction_id string, gold_reaction_id string, basis string"
    return rows.groupBy("document_id", "component").applyInPandas(walk, schema)


def walk_alignment(rows: DataFrame) -> DataFrame:
    """Rows as ``align.align_gold`` gives them, benchmark rows in order: the first predicted row of the id while it is
    unused, else the only unused row of the key; an id given twice in the benchmark never looks at keys."""
    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        predicted, gold = _sides(group)
        by_id, unused, copies = {}, {}, {}
        for at, name, form in predicted:
            by_id.setdefault(name, (at, name, form))
            unused.setdefault(form, {})[at] = name
        for _, name, _ in gold:
            copies[name] = copies.get(name, 0) + 1
        out = []
        for at, name, form in gold:
            claim, options = by_id.get(name), unused.get(form, {})
            if claim is not None and claim[0] not in unused[claim[2]]:
                claim = None
            place, kind = None, "unmatched_gold"
            if copies[name] > 1:
                basis = f"duplicate gold reaction_id '{name}' ({copies[name]} occurrences)"
                if claim is not None:
                    place, kind = claim, "ambiguous"
            elif claim is not None:
                place, kind, basis = claim, "explicit_id", "reaction_id equality"
            elif len(options) == 1:
                (only, its_name), = options.items()
                place, kind, basis = (only, its_name, form), "mapped", "reaction_key match"
            elif options:
                kind, basis = "ambiguous", f"multiple candidates ({len(options)}) for reaction_key"
            else:
                basis = "no candidate found"
            if place is not None:
                del unused[place[2]][place[0]]
            out.append((key[0], f"<gold:{name}>" if place is None else place[1], name, kind, basis, None if place is None else place[0], at))
        for left in unused.values():
            out += [(key[0], name, None, "unmatched_extracted", "no gold match", at, None) for at, name in left.items()]
        named = pd.DataFrame(out, columns=["document_id", "reaction_id", "gold_reaction_id", "alignment", "alignment_basis", "p_ord", "g_ord"])
        return named.astype({"p_ord": "Int64", "g_ord": "Int64"})

    kind = rows.schema["ord"].dataType.simpleString()
    schema = (
        f"document_id string, reaction_id string, gold_reaction_id string, alignment string, alignment_basis string, p_ord {kind}, g_ord {kind}"
    )
    return rows.groupBy("document_id", "component").applyInPandas(walk, schema)


def without(rows: DataFrame, contended: DataFrame, side: int) -> DataFrame:
    """Rows of one side that no contended component holds."""
    return rows.join(contended.filter(F.col("side") == side).select("document_id", "ord"), ["document_id", "ord"], "left_anti")
