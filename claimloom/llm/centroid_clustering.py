"""Centroid clustering of integer vectors, inside the JVM.

Components become integers, so every distance, sum and centroid is exact and the same on any partitioning.
A round is one scan: ``zip_with`` and ``aggregate`` give the squared distance to each row of a literal array of
centroids, ``array_min`` of (distance, number) structs picks the cluster, and one hash aggregate of column sums,
combined before its shuffle, gives the next centroids. Whatever the sizes of the clusters, a task sends one row
of sums per cluster, and the driver gets ``clusters`` such rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from claimloom.staging import staged

from .common import load

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
LIMIT = 1 << 27  # 64 squared differences of two such numbers still fit a long
MOST = (1 << 63) - 1


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) as int; numbers beyond +-LIMIT become +-LIMIT."""
    bound = lambda x: F.least(F.greatest(x, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    return F.transform(vector, lambda c: F.floor(bound(c.cast("double") * F.lit(float(scale)))).cast("int"))


def usable(vector: Column, size: int = SIZE) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def _longs(values) -> str:
    return "array(" + ",".join(f"{v}L" for v in values) + ")"


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; of equally near ones, the first."""
    literal = F.expr("array(" + ",".join(_longs(c) for c in centroids) + ")")
    return F.array_min(F.transform(literal, lambda c, i: F.struct(squared_distance(x, c).alias("distance"), i.alias("cluster"))))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of ``seed:id``; equal hashes (repeated ids) in the order of the vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(clusters)
    return [list(r.x) for r in chosen.collect()]


def moved_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    sums = [F.sum(F.col("x")[d].cast("long")).alias(f"s{d}") for d in range(len(centroids[0]))]
    found = vectors.select(nearest(F.col("x"), centroids)["cluster"].alias("cluster"), "x").groupBy("cluster").agg(F.count("*").alias("n"), *sums)
    moved = list(centroids)
    for row in found.collect():
        moved[row[0]] = [s // row[1] for s in row[2:]]
    return moved


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length than ``size`` or hold null or non-finite components give no row.
    Repeated rows and ids each give a row and weigh as often as they occur. Null ids are clustered but come last as
    first centroids. Fewer vectors than ``clusters`` make fewer clusters; an empty table gives no rows. Numbers
    beyond 2**27 count as 2**27, and an inertia beyond a long as the largest long. Other columns are not read.
    Column sums hold for up to 2**36 rows.
    """
    spark = table.sparkSession
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].alias("v"))
    few = len(table.inputFiles()) < (cores := spark.sparkContext.defaultParallelism)
    kept = rows.filter(usable(F.col("v"), size)).select("vec_id", integers(F.col("v"), scale).alias("x"))
    vectors = staged(kept.repartition(cores) if few else kept, "integer_vectors")
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved_centroids(vectors, centroids)
    best = nearest(F.col("x"), centroids or [[0] * size])
    found = staged(vectors.select("vec_id", best.alias("best")).select("vec_id", "best.*"), "clustered")
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)"))).collect()}
    inertia = _longs(min(sums.get(k, 0), MOST) for k in range(max(1, len(centroids))))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids or [[]]]
    at = lambda values: F.element_at(F.expr(values), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", at(inertia).alias("cluster_inertia"), F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"),
        at("array(" + ",".join(f"'{d}'" for d in digests) + ")").alias("centroid_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def _sql_round(k: int) -> str:
    return f"""
a{k} AS (
  SELECT v.id, any_value(v.vec_id) AS vec_id, min(16 * {_SQL_DISTANCE} + c.k) AS best
  FROM v CROSS JOIN c{k} c GROUP BY v.id
), c{k + 1} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
      SELECT best % 16 AS k, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
      FROM (SELECT a.best, unnest(v.x) AS e, unnest(range(64)) AS i FROM a{k} a JOIN v USING (id)) GROUP BY ALL
    ) GROUP BY k
  ) m USING (k)
),"""


_SQL_DISTANCE = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"

SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(64 * c)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)
),{"".join(_sql_round(k) for k in range(ROUNDS))}
f AS (
  SELECT v.id, any_value(v.vec_id) AS vec_id, min(16 * {_SQL_DISTANCE} + c.k) AS best
  FROM v CROSS JOIN c{ROUNDS} c GROUP BY v.id
)
SELECT vec_id, (best % 16)::INT AS cluster, (best // 16)::BIGINT AS distance,
       (sum(best // 16) OVER (PARTITION BY best % 16))::BIGINT AS cluster_inertia, (sum(best // 16) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c ON c.k = best % 16
"""
