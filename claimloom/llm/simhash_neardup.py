"""SimHash near-duplicates through BK-trees.

Fingerprints: 64 majority bits over XXH64 hashes of word shingles. Two fingerprints link at ``radius``
or fewer differing bits; documents of one connected group share a component.

Equal fingerprints are one node, so a group of copies of any size is one row. A fingerprint is cut into
``radius + 1`` blocks; linked fingerprints agree in at least one block (pigeonhole), so the rows of one
block value are one shard. Each shard becomes BK-trees: children keyed by their integer Hamming
distance to the parent, and a query at distance d follows only the edges d - radius .. d + radius. A shard
of more than ``tree_size`` fingerprints is dealt out by hash into several trees, and each of its parts is
looked up in every tree of the shard as a task of its own: all links, without all rows in one task. Trees
give spanning links, not pairs; components are made of these by rounds of joins.

The trees are sent to tasks by the shuffle of their shard instead of a broadcast of all trees: all
fingerprints of a corpus have no size bound, and the driver never holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from claimloom.staging import staged

from .common import Forest, Words, components, load, text_slices
from .near_copies import near_copies

SEED = 42
RADIUS = 3
SHINGLE = 3
TREE_SIZE = 2048


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned fingerprint per text of a run of texts; zero where a text has no word."""
    words = Words(data, offsets, lower=True)
    n = np.diff(words.first)
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(words.start):
        return out
    text, begin = words.joined()  # every shingle is one slice of it
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    where = np.concatenate([[0], np.cumsum(count)])
    left = np.repeat(words.first[:-1] - where[:-1], count) + np.arange(where[-1])
    right = np.minimum(left + shingle, np.repeat(words.first[1:], count))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(text[i:j], SEED) for i, j in zip(begin[left].tolist(), (begin[right] - 1).tolist())),
        dtype=np.uint64, count=len(left),
    )
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(count)
    sums = np.add.reduceat(bits, where[:-1][some], axis=0, dtype=np.int32)
    most = (2 * sums > count[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(most, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, one row per input row.

    Null and empty texts have fingerprint zero.
    """
    def run(batches):
        for batch in batches:
            parts = [fingerprint_rows(data, offsets, shingle) for _, data, offsets in text_slices(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; a node is [value, children by distance]."""

    def __init__(self, radius: int):
        self.radius, self.top = radius, None

    def add(self, value: int) -> None:
        node = self.top
        if node is None:
            self.top = (value, {})
            return
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int) -> list[int]:
        found, radius = [], self.radius
        todo = [self.top] if self.top is not None else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def _links_of(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links of one shard task: the fingerprints of ``right`` looked up in the tree of ``left``
    (the same list: every fingerprint is looked up before it is added)."""
    tree, forest, out = BKTree(radius), Forest(), []
    same = not right
    for value in left:
        if same:
            for other in tree.within(value):
                if forest.join(value, other):
                    out.append((value, other))
        tree.add(value)
    for value in right:
        for other in tree.within(value):
            if forest.join(value, other):
                out.append((value, other))
    return out


def links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Spanning links (a, b) over distinct fingerprints (column fp): connected like all links of radius
    ``radius`` together."""
    blocks = radius + 1
    width = 64 // blocks
    mask = (1 << width) - 1
    shard = F.explode(F.array(*(
        F.lit(i << width).bitwiseOR(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))) for i in range(blocks)
    ))).alias("shard")
    rows = fps.select("fp", shard)
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", parts)
    dealt = rows.join(sizes.select("shard", "parts"), "shard").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "shard", "fp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") <= F.col("other")).alias("stored"),
    )

    def run(batches):
        def rows_of():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

        def emit(found):
            a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        now, left, right, found = None, [], [], []
        for shard, fp, i, j, stored in rows_of():
            if (shard, i, j) != now:
                found += _links_of(left, right, radius)
                now, left, right = (shard, i, j), [], []
                if len(found) > 50_000:
                    yield emit(found)
                    found = []
            (left if stored else right).append(fp & 0xFFFFFFFFFFFFFFFF)
        found += _links_of(left, right, radius)
        yield emit(found)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per input row; component_id is the smallest doc_id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and equal texts share
    a fingerprint. A null doc_id is never a component_id; a group of null ids alone has a null one. An empty
    table gives no rows. Other columns are not read.
    """
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct_fingerprints")
    roots = components(links(fps.select("fp"), radius))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # Written, so that the join by fingerprint shuffles both sides and a hot fingerprint can be split at run time.
    names = staged(rooted.join(lowest, "root").select("fp", "component_id"), "named_fingerprints")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near-copies: of each component the row whose id is the component's.

    Fingerprints linked by the BK-trees propose pairs of texts; an exact check follows, so that texts link at a Jaccard
    similarity of 0.8 of their five-word shingles. Pairs at that similarity beyond the radius are found by prefixes.

    Of several rows with that id one stays, chosen by content. Rows with a null id stay only if nothing in
    their component has an id. All columns pass through.
    """
    marks = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = near_copies(docs, id_col, text_col, marks=marks, links=links(marks.select("fp").distinct()))
    kept = groups.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__kept")).distinct()
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.xxhash64(*docs.columns))
    named = docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi").withColumn("__row", F.row_number().over(order)).filter("__row = 1").drop("__row")
    unnamed = docs.filter(F.col(id_col).isNull()).join(kept.filter("__kept IS NULL"), F.lit(True), "left_semi")
    return named.unionByName(unnamed)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
