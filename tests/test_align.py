"""Alignment against a plain row-by-row statement of the rules, and its invariants."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from claimloom.operators import align, compare as C, contention, ranking as R, structures as S
from claimloom.plans.standins import PARSER

COMPOUND = "array<struct<label:string,name:string,smiles:string,role:string>>"
SCHEMA = f"document_id string, ord bigint, reaction_id string, reactants {COMPOUND}, products {COMPOUND}, yield_pct double"


def rec(doc, n, rid, key, smiles="CC", y=80.0):
    return (doc, n, rid, [(key, None, smiles, "reactant")], [("p", None, "CCO", "product")], y)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed, documents=40, contended=False):
    rng = random.Random(seed)
    predicted, gold = [], []
    for d in range(documents):
        doc = f"d{d}"
        for n in range(rng.randint(0, 6)):
            predicted.append(rec(doc, n, f"r{rng.randint(0, 4)}", f"k{rng.randint(0, 2)}"))
        ids = {p[2] for p in predicted if p[0] == doc}
        rows = [rec(doc, 0, f"r{rng.randint(0, 6)}", f"k{rng.randint(0, 2)}") for _ in range(rng.randint(0, 6))]
        if not contended:
            rows.sort(key=lambda g: g[2] not in ids)  # id matches first: no contention
        gold += [(g[0], n, *g[2:]) for n, g in enumerate(rows)]
    return predicted, gold


def key(row):
    return row[3][0][0]


def walk_matches(predicted, gold):
    pairs, used = [], set()
    for g in gold:
        same = [p for p in predicted if p[0] == g[0]]
        by_id = [p for p in same if p[2] == g[2]]
        chosen = by_id[-1] if by_id else next((p for p in same if key(p) == key(g) and (p[0], p[1]) not in used), None)
        if chosen is not None and (chosen[0], chosen[1]) not in used:
            used.add((chosen[0], chosen[1]))
            pairs.append((g[0], chosen[1], g[1]))
    return pairs


def walk_alignment(predicted, gold):
    out, used = [], set()
    for g in gold:
        same = [p for p in predicted if p[0] == g[0]]
        by_id = next((p for p in same if p[2] == g[2]), None)
        free = by_id is not None and (by_id[0], by_id[1]) not in used
        copies = sum(o[0] == g[0] and o[2] == g[2] for o in gold)
        options = [p for p in same if key(p) == key(g) and (p[0], p[1]) not in used]
        taken = None
        if copies > 1:
            kind, taken = ("ambiguous", by_id) if free else ("unmatched_gold", None)
        elif free:
            kind, taken = "explicit_id", by_id
        elif len(options) == 1:
            kind, taken = "mapped", options[0]
        else:
            kind = "ambiguous" if options else "unmatched_gold"
        if taken is not None:
            used.add((taken[0], taken[1]))
        out.append((g[0], g[1], None if taken is None else taken[1], kind))
    out += [(p[0], None, p[1], "unmatched_extracted") for p in predicted if (p[0], p[1]) not in used]
    return out


def test_matches_equal_the_walk(spark):
    predicted, gold = random_rows(1)
    got = align.match_records(table(spark, predicted), table(spark, gold), block_bits=1).select("document_id", "p_ord", "g_ord").collect()
    assert Counter(map(tuple, got)) == Counter(walk_matches(predicted, gold))


def test_alignment_equals_the_walk_and_loses_nothing(spark):
    predicted, gold = random_rows(2)
    got = align.align_gold(table(spark, predicted), table(spark, gold)).select("document_id", "g_ord", "p_ord", "alignment").collect()
    want = walk_alignment(predicted, gold)
    assert Counter(map(tuple, got)) == Counter(want)
    assert Counter((r[0], r[1]) for r in got if r[1] is not None) == Counter((g[0], g[1]) for g in gold)


@pytest.mark.parametrize("seed", [3, 4])
def test_contended_rows_walk_in_order(spark, seed):
    predicted, gold = random_rows(seed, contended=True)
    p, g = table(spark, predicted), table(spark, gold)
    pairs = align.match_records(p, g, contention="walk").select("document_id", "p_ord", "g_ord").collect()
    assert Counter(map(tuple, pairs)) == Counter(walk_matches(predicted, gold))
    assert Counter(map(tuple, align.match_records(p, g).select("document_id", "p_ord", "g_ord").collect())) != Counter(map(tuple, pairs))
    rows = align.align_gold(p, g, contention="walk").select("document_id", "g_ord", "p_ord", "alignment").collect()
    assert Counter(map(tuple, rows)) == Counter(walk_alignment(predicted, gold))
    assert C.evaluate(p, g, S.structure_dictionary(spark.createDataFrame([("CC",), ("CCO",)], "smiles string"), PARSER), contention="walk").first().matched_count == len(pairs)


def test_only_contended_components_are_walked(spark):
    n = 40  # a chain: row i shares its key with i - 1 of the benchmark, whose ids follow one later
    predicted = [rec("chain", i, f"r{i}", f"k{i}") for i in range(n)] + [rec("chain", n, "far", "away"), rec("calm", 0, "r0", "k0")]
    gold = [rec("chain", 0, "g", "k0")] + [rec("chain", i + 1, f"r{i}", f"k{i + 1}") for i in range(n - 1)] + [rec("chain", n, "far", "away"), rec("calm", 0, "r0", "k0")]
    p, g = align._slim(table(spark, predicted)), align._slim(table(spark, gold))
    rows = contention.contended_rows(p, g, align._contended_keys(p, g))
    assert rows.select("component").distinct().count() == 1
    assert Counter(r.side for r in rows.collect()) == {contention.PREDICTED: n, contention.GOLD: n}
    got = align.match_records(table(spark, predicted), table(spark, gold), contention="walk").select("document_id", "p_ord", "g_ord").collect()
    assert Counter(map(tuple, got)) == Counter(walk_matches(predicted, gold))
    with pytest.raises(ValueError):
        align.align_gold(table(spark, predicted), table(spark, gold), contention="key")


def test_walk_of_empty_tables(spark):
    empty, rows = table(spark, []), table(spark, [rec("d", 0, "r1", "a")])
    assert align.match_records(empty, empty, contention="walk").count() == 0
    assert align.match_records(rows, empty, contention="walk").count() == 0
    assert [r.alignment for r in align.align_gold(empty, rows, contention="walk").collect()] == ["unmatched_gold"]


def test_duplicate_gold_ids_are_ambiguous(spark):
    rows = align.align_gold(table(spark, [rec("d", 0, "r1", "a")]), table(spark, [rec("d", 0, "r1", "a"), rec("d", 1, "r1", "a")])).orderBy("g_ord").collect()
    assert [r.alignment for r in rows] == ["ambiguous", "unmatched_gold"]
    assert all("duplicate" in r.alignment_basis for r in rows)


def test_id_claim_is_kept_and_counted(spark):
    predicted = table(spark, [rec("d", 0, "r1", "a")])
    gold = table(spark, [rec("d", 0, "g9", "a"), rec("d", 1, "r1", "a")])
    rows = {r.g_ord: r.alignment for r in align.align_gold(predicted, gold).collect()}
    assert rows == {0: "unmatched_gold", 1: "explicit_id"}
    assert align.id_key_contention(predicted, gold).count() == 1


def test_hot_key_numbering_equals_plain_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id"))
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id"))).collect()
    split = R.number_rows(df, ["k"], "id", R.long_block("id", 6)).select("k", "id", "rn").collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, plain))
    largest = df.withColumn("b", R.long_block("id", 6)).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert largest <= 64
    before = R.previous_value(df, ["k"], "id", R.long_block("id", 6), "id", "before").select("k", "id", "before").collect()
    lag = df.withColumn("before", F.lag("id").over(Window.partitionBy("k").orderBy("id"))).collect()
    assert sorted(map(tuple, before), key=str) == sorted(map(tuple, lag), key=str)


def test_metrics(spark):
    predicted = table(spark, [rec("d", 0, "r1", "a"), rec("d", 1, "p1", "b", smiles=None), rec("d", 2, "x", "zz")])
    gold = table(spark, [rec("d", 0, "r1", "a", y=81.0), rec("d", 1, "g1", "b", y=10.0)])
    texts = spark.createDataFrame([("CC",), ("CCO",)], "smiles string")
    d = S.structure_dictionary(texts, PARSER)
    row = C.evaluate(predicted, gold, d).first()
    assert (row.predicted_count, row.gold_count, row.matched_count) == (3, 2, 2)
    assert (row.reaction_precision, row.reaction_recall, row.yield_accuracy) == (0.6667, 1.0, 0.5)
    assert row.structure_coverage == 0.75 and row.structure_comparable == 2 and row.structure_agreement == 1.0
    every = C.evaluate(predicted, gold, d, pairs="all").first()
    assert every.structure_comparable == 3 and every.structure_uncomparable == 1
    empty = C.evaluate(predicted.limit(0), gold, d).first()
    assert empty.reaction_precision == 0.0 and empty.yield_accuracy is None


def test_participants_pair_by_occurrence(spark):
    row = (1, [("A", None, "S1", "reactant"), ("a", None, "S2", "reactant"), (None, None, "S9", "reactant")],
           [("a ", None, "S1", "reactant"), (None, None, "S9", "reactant"), ("b", None, None, "product")])
    df = spark.createDataFrame([row], f"pair_id int, predicted_compounds {COMPOUND}, gold_compounds {COMPOUND}")
    texts = spark.createDataFrame([("S1",), ("S2",), ("S9",)], "smiles string")
    got = C.compare_participants(df, S.structure_dictionary(texts, PARSER)).collect()
    assert sorted((r.participant_id, r.gold_participant_id, r.comparison) for r in got if r.gold_participant_id) == [
        ("<gold:b>", "b", "missing_extracted"), ("<unlabelled>", "<unlabelled>", "identical"), ("A", "a ", "identical"),
    ]
    assert [r.participant_id for r in got if r.comparison == "missing_gold"] == ["a"]
