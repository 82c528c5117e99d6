"""Embedding near-duplicates by iterative quantisation.

PCA and a learned rotation turn unit vectors into balanced binary codes. Codes are cut into blocks; each
block is one table of a multi-index, and two vectors are candidates where at least one block is equal. The width of
the blocks is the largest at which pairs made at the threshold from the fitted sample (with noise of all directions,
and with noise like the data's own differences) share a block in ``RECALL`` of the cases: where a common mean holds
much of the vectors' length, codes of a pair differ more and blocks are narrower. Candidates are reranked with the
original vectors: cosine in double precision, within one label.

Equal vectors of a label are one node with a multiplicity. A bucket is a (label, table, block value); one of
more than ``part_size`` nodes is dealt into parts and every pair of parts is a task of its own, so no link of
a large bucket is lost and none gathers in one task. A pair that meets in several tables counts in the first.
Tasks return link counts per node and spanning links, never pairs.

The index holds every vector. Only the rotation is fitted on a sample: at most ``MAX_SAMPLE`` vectors, those
with the smallest hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from claimloom.staging import staged

from .common import components, load, share, unpacked

COSINE = 0.93
BITS = 64
WIDTHS = (8, 7, 6, 5, 4, 3, 2)
RECALL = 0.97
MAX_SAMPLE = 20_000
PART_SIZE = 2048


class Quantiser:
    """Mean, projection and rotation for binary codes of ``bits`` bits, and the width of their blocks."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 7, cosine: float = COSINE):
        self.dim, self.bits = sample.shape[1], bits
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        _, vectors = np.linalg.eigh(x.T @ x)
        width = min(bits, self.dim)
        main = vectors[:, ::-1][:, :width]
        y = x @ main
        random = np.random.default_rng(seed)
        turn = np.linalg.qr(random.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ vt).T
        self.matrix = main @ turn
        if width < bits:  # short vectors: the further bits are random projections
            self.matrix = np.hstack([self.matrix, random.normal(size=(self.dim, bits - width))])
        self.width = self._width(sample[:4000], cosine, random)

    def _width(self, x: np.ndarray, cosine: float, random) -> int:
        own = x[random.permutation(len(x))] - x[random.permutation(len(x))]
        for self.width in WIDTHS:
            worst = 1.0
            for noise in (random.normal(size=x.shape), own + 1e-9 * random.normal(size=x.shape)):
                noise -= x * (noise * x).sum(axis=1, keepdims=True)
                noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
                other = cosine * x + np.sqrt(1 - cosine * cosine) * noise
                worst = min(worst, (self.codes(x) == self.codes(other)).any(axis=1).mean())
            if worst >= RECALL:
                break
        return self.width

    @property
    def blocks(self) -> int:
        return self.bits // self.width

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Block values, one byte per block; the last bits that fill no block are left out."""
        if unit.shape[1] != self.dim:  # codes alone are made of a padded or cut vector
            fit = np.zeros((len(unit), self.dim))
            fit[:, : min(self.dim, unit.shape[1])] = unit[:, : self.dim]
            unit = fit
        bits = (unit - self.mean) @ self.matrix[:, : self.blocks * self.width] >= 0
        return np.packbits(bits.reshape(len(unit), self.blocks, self.width), axis=2)[:, :, 0]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucket_links(codes, unit, weight, table, left, right, cosine):
    """Links of one task: per row the weight of its partners, and (row, representative) spanning links.

    left, right: row numbers; right empty means all pairs within left."""
    same = not len(right)
    other = left if same else right
    n = len(codes)
    total = np.zeros(n)
    label = np.arange(n)
    pairs = []
    for k in range(0, len(left), 512):
        part = left[k : k + 512]
        i, j = np.nonzero(unit[part] @ unit[other].T >= cosine)
        if same:
            keep = i + k < j
            i, j = i[keep], j[keep]
        a, b = part[i], other[j]
        if table:
            keep = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
            a, b = a[keep], b[keep]
        total += np.bincount(a, weights=weight[b], minlength=n) + np.bincount(b, weights=weight[a], minlength=n)
        if len(a):
            # Only as many pairs are kept as span the rows met so far.
            pairs.append((a, b))
            if sum(len(x) for x, _ in pairs) > 4 * n + 10_000:
                label = _spread(label, pairs)
                pairs = []
    label = _spread(label, pairs)
    return total, label


def _spread(label, pairs):
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(nodes: DataFrame, quantiser, cosine: float, part_size: int) -> DataFrame:
    """(node, n, other): rows with n are partner counts, rows with other spanning links."""
    shared = share(nodes.sparkSession, quantiser)

    def encode(batches):
        model = unpacked(shared)
        for batch in batches:
            vectors, codes = batch.column(3), np.zeros((batch.num_rows, model.blocks), dtype=np.uint8)
            sizes = batch.column(2).to_numpy()
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                codes[rows] = model.codes(_unit(vectors.take(pa.array(rows)), int(dim)))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, flat.cast(pa.binary())], names=["node", "label", "dim", "v", "weight", "code"])

    kind = nodes.schema["v"].dataType.simpleString()
    coded = nodes.select("node", "label", "dim", "v", "weight").mapInArrow(encode, f"node long, label string, dim int, v {kind}, weight long, code binary")
    tables = quantiser.blocks
    bucket = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.substring("code", t + 1, 1).alias("k")) for t in range(tables))))
    rows = staged(coded, "codes").withColumn("b", bucket).select("node", "label", "dim", "v", "weight", "code", "b.t", "b.k")
    keys = ["label", "dim", "t", "k"]
    sizes = rows.groupBy(keys).agg(F.count("*").alias("size")).filter("size > 1")
    parts = sizes.select(*keys, F.ceil(F.col("size") / part_size).cast("int").alias("parts"))
    dealt = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *keys, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("stored"),
        "node", "v", "weight", "code",
    )

    def groups(batches):
        """Record batches of one task each; a task may run over several batches."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            ids = [table.column(k).combine_chunks() for k in range(6)]
            new = np.zeros(len(table), dtype=bool)
            if len(table) > 1:
                for c in ids:
                    new[1:] |= pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(new).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield table.slice(a, b - a)
            held = table.slice(cuts[-1]) if len(table) else None
        if held is not None and len(held):
            yield held

    def run(batches):
        out = []
        for group in groups(batches):
            dim, t = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            stored = group.column(6).to_numpy()
            node, weight = group.column(7).to_numpy(), group.column(9).to_numpy()
            codes = np.frombuffer(b"".join(group.column(10).to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            unit = _unit(group.column(8).combine_chunks(), dim)
            total, label = _bucket_links(codes, unit, weight, t, np.flatnonzero(stored), np.flatnonzero(~stored), cosine)
            some = np.flatnonzero(total)
            out.append((node[some], total[some].astype(np.int64), node[label[some]]))
            if sum(len(x[0]) for x in out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out):
        cols = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, dtype=np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "n", "other"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "i", "j"]
    return tasks.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(run, "node long, n long, other long")


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, max_sample: int = MAX_SAMPLE, part_size: int = PART_SIZE,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
    link with nothing. Vectors of different length never link. Repeated rows are copies and link with each
    other. A null id is never a component_id unless its component has no other. An empty table gives no rows.
    Other columns are not read. Nodes are 64-bit hashes of label and vector.
    """
    whole = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(vector_col), lambda x: x.cast(whole))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "v")))
    ids = staged(rows.select("vec_id", "node"), "vector_ids")
    counts = ids.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    counts = staged(counts, "vector_counts")
    distinct = rows.filter("node IS NOT NULL").select("node", "label", F.size("v").alias("dim"), "v").dropDuplicates(["node"])
    nodes = staged(distinct.join(counts, "node").select("node", "label", "dim", "v", "weight"), "vectors")
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(max_sample).select("v").collect()
    if sample:
        dims = [len(r.v) for r in sample]
        dim = max(sorted(set(dims)), key=dims.count)
        x = np.array([r.v for r in sample if len(r.v) == dim], dtype=np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        quantiser = Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), cosine=cosine)
        links = staged(_links(nodes, quantiser, cosine, part_size), "vector_links")
    else:
        links = ids.filter("false").select("node", F.lit(0).cast("long").alias("n"), F.col("node").alias("other"))
    partners = links.groupBy("node").agg(F.sum("n").alias("partners"))
    roots = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    full = (
        counts.join(partners, "node", "left").join(roots, "node", "left")
        .select("node", "weight", "low", F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("root", "node").alias("root"))
    )
    lowest = full.groupBy("root").agg(F.min("low").alias("component_id"))
    # Written, so that a hot vector's rows can be split at run time in the join by node.
    named = staged(full.join(lowest, "root").select("node", (F.col("weight") - 1 + F.col("partners")).alias("n_links"), "component_id"), "vector_names")
    linked = ids.filter("node IS NOT NULL").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = ids.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x), n AS (SELECT x, count(*) AS c FROM link GROUP BY x)
SELECT vec_id, coalesce(n.c, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.m, vec_id))::BIGINT AS component_id,
       vec_id <= coalesce(low.m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
