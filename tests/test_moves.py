"""How often rows are moved or written: each test states work that a larger table would pay for again."""

from pyspark.sql import functions as F

from claimloom.operators import compare as C, corrections as E, structures as S
from claimloom.plans import standins
from claimloom.plans.queries_assembly import QUERIES
from claimloom.plans.queries_edits import corrections, operated
from claimloom.plans.standins import PARSER, participant_pairs, records

SMALL = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_errors_of_corrections_apply_none_and_records_are_joined_once(spark, monkeypatch):
    written, staged = [], E.staged
    monkeypatch.setattr(E, "staged", lambda df, name: written.append((name, optimized(df).count("Join "))) or staged(df, name))
    edits, errors = E.checked_corrections(records(spark, SMALL), corrections(spark, SMALL))
    assert written == [("edits", 1), ("correction-errors", 0)] and errors.count() > 0 and edits.count() == 6000


def test_packages_are_read_once_and_revalidated_in_place(spark, monkeypatch):
    written, staged = [], E.staged
    monkeypatch.setattr(E, "staged", lambda df, name: written.append((name, optimized(df).count("Join "))) or staged(df, name))
    changed, _, _ = operated(spark, SMALL)
    assert changed.count() > 0
    assert [name for name, _ in written] == ["packages", "edits", "package-errors", "refused", "corrected"]
    assert dict(written)["corrected"] == 2  # edits without refused packages, and their records
    assert "Join" not in optimized(E.revalidate(records(spark, SMALL), PARSER))


def test_parser_of_columns_gives_what_its_dictionary_gives_without_a_join(spark):
    pairs = participant_pairs(spark, SMALL).limit(40).persist()
    texts = pairs.select(F.explode(F.concat("predicted_compounds", "gold_compounds")).alias("c")).select("c.smiles")
    joined = C.compare_participants(pairs, S.structure_dictionary(texts, PARSER))
    placed = C.compare_participants(pairs, PARSER)
    assert optimized(joined).count("Join ") == 2 and "Join" not in optimized(placed)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, placed.collect()))
    s = spark.createDataFrame([("a3",), ("bad(x",), (" ",), ("",), (None,), ("b@",)], "smiles string")
    want = S.canonicalise(s, S.structure_dictionary(s, PARSER))
    assert sorted(map(repr, S.canonicalise(s, PARSER).collect())) == sorted(map(repr, want.collect()))


def test_ordered_union_reads_its_candidates_once(spark):
    part = optimized(QUERIES["ordered_union"](spark, SMALL))
    assert part.count("p_partkey") and part.count("Join ") == 1  # lineitem with part, nothing joined back


def test_tasks_take_a_bounded_number_of_rows(spark, monkeypatch):
    assert standins.load(spark, SMALL, "lineitem").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(standins, "PART", 300)
    assert standins.load(spark, SMALL, "lineitem").rdd.getNumPartitions() == 20
