from pyspark.sql import functions as F

from claimloom.operators import assemble as A, rules as V, structures as S
from claimloom.plans.standins import PARSER, pandas_parser
from claimloom.schemas import REACTION_CANDIDATE, STRUCTURE_CANDIDATE


def compound(label, name=None, smiles=None, role="reactant"):
    return (label, name, smiles, role)


def candidate(cid, n, source="text", left="7", right="8", confidence=0.9, yield_pct=80.0, evidence=("text-p1",), doc="d", time=None):
    return (
        doc, cid, n, source, [compound(left)] if left else [], [compound(right, role="product")] if right else [], ["Pd", ""], [],
        25.0, time, yield_pct, list(evidence), confidence,
    )


def structure(cid, label, smiles, n, doc="d"):
    return (doc, cid, n, label, smiles, [], 0.5)


def build(spark, reactions, structures):
    c = spark.createDataFrame(reactions, REACTION_CANDIDATE)
    s = spark.createDataFrame(structures, STRUCTURE_CANDIDATE)
    texts = s.select("smiles").unionByName(c.select(F.explode("reactants.smiles").alias("smiles")))
    dictionary = S.structure_dictionary(texts, PARSER)
    return A.assemble(c, S.canonicalise(s, dictionary), dictionary)


BOTH = [structure("s7", "7", "CC", 1), structure("s8", "8", "CCO", 2)]


def test_two_sources_give_one_accepted_record(spark):
    a = build(spark, [candidate("r1", 1), candidate("r2", 2, "table", evidence=("text-p2", "text-p1"))], BOTH)
    row = A.nested_records(a).collect()
    assert len(row) == 1
    assert row[0].review_status == "accepted"
    assert row[0].evidence_ids == ["text-p1", "text-p2"]
    assert row[0].reagents == ["Pd"]
    assert row[0].reactants[0].smiles == "CC" and row[0].products[0].smiles == "CCO"
    assert abs(row[0].confidence - (0.35 * 0.9 + 0.25 + 0.2 + 0.2)) < 1e-9


def test_missing_structure_needs_review(spark):
    row = A.nested_records(build(spark, [candidate("r1", 1)], BOTH[:1])).collect()[0]
    assert row.review_status == "needs_review"
    assert [i.code for i in row.issues] == ["A002_STRUCTURE_MISSING"]


def test_label_with_two_structures(spark):
    s = spark.createDataFrame([structure("a", "8", "CC", 1), structure("b", "8", "CCC", 2)], STRUCTURE_CANDIDATE)
    parsed = S.canonicalise(s, S.structure_dictionary(s, PARSER))
    rows = V.label_conflict_rule(parsed).collect()
    assert sorted(r.target_id for r in rows) == ["a", "b"]
    record = A.nested_records(build(spark, [candidate("r1", 1)], [structure("a", "8", "CC", 1), structure("b", "8", "CCC", 2), structure("s7", "7", "C", 3)])).collect()[0]
    assert [i.code for i in record.issues] == ["A001_STRUCTURE_AMBIGUOUS", "V005_LABEL_STRUCTURE_CONFLICT", "V005_LABEL_STRUCTURE_CONFLICT"]


def test_first_of_equal_confidence_is_base_and_conflicts_are_listed(spark):
    a = build(spark, [candidate("r2", 2, yield_pct=70.0), candidate("r1", 1, yield_pct=80.0), candidate("r3", 3, yield_pct=None)], BOTH)
    row = A.nested_records(a).collect()[0]
    assert row.yield_pct == 80.0
    assert [i.message for i in row.issues] == ["Conflicting yield_pct values: ['70.0', '80.0']"]
    assert row.issues[0].target_id == "r1"


def test_candidates_without_compounds_stay_apart(spark):
    a = build(spark, [candidate("r1", 1, left=None, right=None), candidate("r2", 2, left=None, right=None), candidate("r3", 3)], BOTH)
    rows = A.nested_records(a).collect()
    assert len(rows) == 3
    bare = [r for r in rows if not r.reactants]
    assert len(bare) == 2 and all(r.review_status == "needs_review" for r in bare)
    assert {i.code for r in bare for i in r.issues} == {"R001_REACTANT_MISSING", "R002_PRODUCT_MISSING"}


def test_same_labels_in_other_documents_do_not_mix(spark):
    a = build(spark, [candidate("r1", 1), candidate("r1", 1, doc="e")], BOTH + [structure("s7", "7", "N", 1, "e"), structure("s8", "8", "O", 2, "e")])
    rows = {r.document_id: r for r in A.nested_records(a).collect()}
    assert rows["d"].reactants[0].smiles == "CC" and rows["e"].reactants[0].smiles == "N"


def test_labels_ignore_case_and_unicode_space(spark):
    a = build(spark, [candidate("r1", 1, left="A b"), candidate("r2", 2, left="aB")], [])
    assert a.records.count() == 1


def test_partitioning_changes_nothing(spark):
    rows = [candidate(f"r{i}", i, ("text", "table", "scheme")[i % 3], left=str(i % 7), confidence=(i % 10) / 10, yield_pct=float(i % 5), evidence=(f"e{i % 11}",)) for i in range(300)]
    one = sorted(map(tuple, build(spark, rows, BOTH).records.coalesce(1).collect()))
    c = spark.createDataFrame(rows, REACTION_CANDIDATE).repartition(16)
    s = spark.createDataFrame(BOTH, STRUCTURE_CANDIDATE).repartition(5)
    dictionary = S.structure_dictionary(s, PARSER)
    many = A.assemble(c, S.canonicalise(s, dictionary), dictionary)
    assert sorted(map(tuple, many.records.collect())) == one
    assert many.records.agg(F.sum("n_candidates")).first()[0] == 300


def test_pandas_parser_and_expressions_agree(spark):
    s = spark.createDataFrame([("C@C",), ("bad(x",), ("CC3",), (None,), (" ",)], "smiles string")
    a = S.structure_dictionary(s, PARSER).collect()
    b = S.structure_dictionary(s, pandas_parser).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_structure_ladder(spark):
    pairs = [
        (None, " ", "none", "uncomparable"), ("C", None, "none", "missing_one_side"), ("bad(", "C", "none", "uncomparable"),
        ("cc", "CC", "none", "identical"), ("C@C", "CC", "none", "stereo_only"), ("[NH4+]", "[NH4]", "none", "charge_salt_isotope_differs"),
        ("[NH4+]", "[NH4]", "strip_charge", "identical"), ("[13CC]", "[CC]", "strip_isotopes", "identical"),
        ("CCC.[Cl-]", "CCC", "strip_charge", "charge_salt_isotope_differs"), ("CC", "CN", "none", "connectivity_differs"),
    ]
    for a, b, mode, want in pairs:
        df = spark.createDataFrame([(a, b)], "smiles_a string, smiles_b string")
        texts = df.selectExpr("explode(array(smiles_a, smiles_b)) AS smiles")
        got = S.compare_structures(df, S.structure_dictionary(texts, PARSER), normalization=mode).first()
        assert got.level == want, (a, b, mode)


def test_long_value_lists_are_cut_and_counted(spark):
    rows = [candidate(f"r{i:03}", i, yield_pct=float(i % 97), time=f"{i} h") for i in range(150)]
    a = build(spark, rows, BOTH)
    found = {r.message.split(" ")[1]: r.message for r in A.field_conflicts(a.candidates).collect()}
    assert found["time"].endswith(" and 50 more") and found["time"].count("'") == 200 and "more" not in found["yield_pct"]
    assert A.conflict_values(a.candidates).filter("field = 'time'").count() == 150
    shared = [structure(f"s{i:03}", f"L{i:03}", "CC", i) for i in range(120)]
    issue = [r for r in V.collapse_rule(build(spark, rows[:1], shared).structures).collect()]
    assert len(issue) == 1 and issue[0].message.endswith(" and 20 more")


def test_issue_lists_are_linear_and_count_right(spark):
    """Half of all on one label: the lists hold each issue once, counts equal those of the expanded view."""
    pool = [structure(f"s{i}", "7" if i % 2 else f"x{i}", f"C{i % 5}", i) for i in range(60)]
    rows = [candidate(f"r{i}", i, left="7" if i % 2 else f"x{i}", right=f"p{i}") for i in range(60)]
    a = build(spark, rows, pool)
    parts = A.issue_lists(a)
    sizes = [x.count() for x in (parts.own, parts.lists, parts.uses)]
    assert sum(sizes) < 500 < A.attach_issues(a).count()
    seen = {}
    for r in A.attach_issues(a).collect():
        e, w = seen.get(r.reaction_id, (0, 0))
        seen[r.reaction_id] = (e + (r.severity == "error"), w + (r.severity == "warning"))
    assert {r.reaction_id: (r.errors, r.warnings) for r in A.issue_counts(a).collect()} == {r.reaction_id: seen.get(r.reaction_id, (0, 0)) for r in a.records.collect()}
