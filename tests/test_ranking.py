from pyspark.sql import functions as F

from claimloom.operators import ranking as K
from claimloom.sources import files as S


def test_numbers_over_ranges(spark):
    """Ids that begin alike, one key with nearly all rows: numbers as by sorting, and many tasks share the key."""
    names = [("big", f"common-prefix-of-every-id-{i * 7919 % 100_003:06}") for i in range(20_000)] + [(f"d{i % 50}", f"x{i:04}") for i in range(500)]
    rows = spark.createDataFrame(names, "k string, v string")
    got = {(r.k, r.v): r.rn for r in K.number_ordered(rows, ["k"], "v").collect()}
    want = {}
    for k in {n[0] for n in names}:
        want.update({(k, v): i + 1 for i, v in enumerate(sorted(v for x, v in names if x == k))})
    assert got == want
    assert K.number_ordered(rows.filter("false"), ["k"], "v").count() == 0
    ranges = rows.repartitionByRange(8, "k", "v").filter("k = 'big'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges > 4


def test_very_many_images_of_one_document(spark):
    files = spark.range(100_000).select(F.lit("d").alias("document_id"), F.concat(F.lit("/very/long/common/folder/page_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".png")).alias("path"))
    rows = S.image_evidence(files.unionByName(spark.createDataFrame([("e", "/a/p1.JPG"), ("e", "/a/notes.txt")], files.schema)))
    bad = rows.filter("document_id = 'd' AND (page <> cast(substring(evidence_id, 7) AS int) - 1 OR page IS NULL)").count()
    assert bad == 0 and rows.count() == 100_001
    assert [r.evidence_id for r in rows.filter("document_id = 'e'").collect()] == ["image-0001"]


def test_smallest_values(spark):
    rows = spark.createDataFrame([("a", f"{i:03}") for i in range(250)] + [("b", "x")], "k string, v string")
    got = {r.k: (r.n, r["values"]) for r in K.smallest_values(rows, ["k"], "v", k=3).collect()}
    assert got == {"a": (250, ["000", "001", "002"]), "b": (1, ["x"])}
