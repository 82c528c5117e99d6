"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII case folded; shingles are five words (a
shorter item is one shingle). A document window has as many words as an item. Only windows that share a
shingle with the item, at that shingle's place in it, can reach the threshold, so these alone are fingerprinted:
one lookup per word finds them. Their fingerprints go through a multi-index of ``RADIUS + 1`` Hamming blocks over the item
fingerprints, which holds every item within ``RADIUS`` bits (pigeonhole). What it returns is verified by the
exact weighted Jaccard similarity of the shingle multisets; a shingle that k items of the whole benchmark hold weighs
1 / (1 + ln k).

RADIUS is wide on purpose: windows at the threshold of 0.8 differ in about 10 of 64 bits, with a standard
deviation of 3, so 24 bits leave out next to nothing (less than one in a million at the threshold).

Items are taken in blocks of bounded size; each block is one pass over the documents, without a shuffle. Between passes
the documents are written with the matches so far.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimloom.staging import staged

from .common import BREAK, RADIX, SECOND, Powers, Rolling, Words, load, share, text_slices, unpacked

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000  # of one block of items, held by every task
BITMAP = 22


def _fingerprints(hashes: np.ndarray, weights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 weighted majority bits over the shingle hashes start:end of each window."""
    size = end - start
    where = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(where[-1]) - np.repeat(where[:-1] - start, size)
    signs = np.unpackbits(hashes[at].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
    sums = np.add.reduceat(signs * weights[at][:, None], where[:-1], axis=0)
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _grams(text: str | None, letters: Powers, powers: Powers) -> tuple[int, int, list[int]]:
    """Words of an item, words of its shingles, and their hashes in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    words = Words(raw, np.array([0, len(raw)]), lower=True, breaks=BREAK)
    n = len(words.start)
    size = min(SHINGLE, n)
    at = np.arange(n - size + 1 if n else 0)
    return n, size, Rolling(words.hashes(letters), powers)(at, at + size).tolist()


def _item_grams(items: DataFrame) -> DataFrame:
    """(gram) of items (text): a row per item and distinct shingle."""
    def run(batches):
        letters, powers = Powers(RADIX), Powers(SECOND)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                grams = np.array(sorted(set(_grams(text, letters, powers)[2])), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])

    return items.mapInArrow(run, "gram long")


class ItemIndex:
    """Shingles, places and fingerprints of one block of items."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY, held: tuple[np.ndarray, np.ndarray] | None = None):
        """``held``: shingles that several items of the whole benchmark hold, sorted, and how many (None: this block is all)."""
        self.radius, self.similarity = radius, similarity
        letters, powers = Powers(RADIX), Powers(SECOND)
        self.ids, self.lengths, self.sets = [], [], []
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        here: Counter = Counter()
        for item_id, text in items:
            n, size, grams = _grams(text, letters, powers)
            if not n:
                continue
            for offset, g in enumerate(grams):
                places.setdefault(size, {}).setdefault(g, []).append((len(self.ids), offset))
            self.ids.append(item_id)
            self.lengths.append(n)
            self.sets.append(Counter(grams))
            here.update(set(grams))
        self.held = held
        self.weight = {g: 1 / (1 + math.log(k if held is None else self._holders(g))) for g, k in here.items()}
        self.tables = {}
        for size, found in places.items():
            keys = np.array(sorted(found), dtype=np.uint64)
            bitmap = np.zeros(1 << BITMAP, dtype=bool)
            bitmap[keys >> np.uint64(64 - BITMAP)] = True
            self.tables[size] = (bitmap, keys, [found[k] for k in keys.tolist()])
        self.masses = np.array([sum(c * self.weight[g] for g, c in s.items()) for s in self.sets])
        prints = []
        for s in self.sets:
            g = np.fromiter(s.elements(), dtype=np.uint64)
            prints.append(_fingerprints(g, self.weights(g), np.array([0]), np.array([len(g)]))[0])
        self.prints = np.array(prints, dtype=np.uint64)
        # Multi-index: per block of bits, items by block value.
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            mask = np.uint64((1 << int(high - low)) - 1)
            values = (self.prints >> np.uint64(low)) & mask
            self.blocks.append((np.uint64(low), mask, [np.flatnonzero(values == v) for v in range(int(mask) + 1)]))

    def _holders(self, gram: int) -> int:
        grams, counts = self.held
        i = int(np.searchsorted(grams, np.uint64(gram)))
        return int(counts[i]) if i < len(grams) and grams[i] == gram else 1

    def weigh(self, gram: int) -> float:
        """A shingle that only items of other blocks hold weighs by these."""
        weight = self.weight.get(gram)
        return weight if weight is not None else 1.0 if self.held is None else 1 / (1 + math.log(self._holders(gram)))

    def weights(self, grams: np.ndarray) -> np.ndarray:
        return np.array([self.weigh(g) for g in grams.tolist()], dtype=np.float32)

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        """Items within the radius, by way of the blocks."""
        lists = [rows[int((fingerprint >> low) & mask)] for low, mask, rows in self.blocks]
        found = np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.int64)
        return found[np.bitwise_count(self.prints[found] ^ fingerprint) <= self.radius]

    def matches(self, data: np.ndarray, offsets: np.ndarray, letters: Powers, powers: Powers) -> dict[int, list[tuple]]:
        """{text row: [(item, first word, end word, similarity)]} of a run of texts."""
        words = Words(data, offsets, lower=True, breaks=BREAK)
        n = len(words.start)
        out: dict[int, list[tuple]] = {}
        if not n:
            return out
        roll = Rolling(words.hashes(letters), powers)
        for size, (bitmap, keys, places) in self.tables.items():
            if n < size:
                continue
            at = np.arange(n - size + 1)
            grams = roll(at, at + size)
            hit = at[bitmap[grams >> np.uint64(64 - BITMAP)]]
            spot = np.searchsorted(keys, grams[hit])
            real = keys[np.minimum(spot, len(keys) - 1)] == grams[hit]
            hit, spot = hit[real], spot[real]
            row = np.searchsorted(words.first, hit, side="right") - 1
            inside = hit + size <= words.first[row + 1]
            windows = set()
            for p, k, r in zip(hit[inside].tolist(), spot[inside].tolist(), row[inside].tolist()):
                first, last = int(words.first[r]), int(words.first[r + 1])
                for item, offset in places[k]:
                    begin = max(p - offset, first)
                    windows.add((r, begin, min(p - offset + self.lengths[item], last)))
            windows = sorted(w for w in windows if w[2] - w[1] >= size)
            for low in range(0, len(windows), 4096):
                self._verify(windows[low : low + 4096], grams, size, words.first, out)
        return {r: self._apart(found) for r, found in out.items()}

    def _verify(self, windows, grams, size, first, out) -> None:
        start = np.array([w[1] for w in windows])
        end = np.array([w[2] for w in windows]) - size + 1
        low, high = int(start.min()), int(end.max())
        part = grams[low:high]
        used = np.zeros(len(part) + 1, dtype=np.int32)
        np.add.at(used, start - low, 1)
        np.add.at(used, end - low, -1)
        weights = np.ones(len(part), dtype=np.float32)
        covered = np.flatnonzero(np.cumsum(used)[:-1] > 0)
        weights[covered] = self.weights(part[covered])
        prints = _fingerprints(part, weights, start - low, end - low)
        for (r, a, b), fingerprint in zip(windows, prints):
            near = self.near(fingerprint)
            if not len(near):
                continue
            mine = Counter(grams[a : b - size + 1].tolist())
            mass = sum(c * self.weigh(g) for g, c in mine.items())
            for item in near.tolist():
                if min(SHINGLE, self.lengths[item]) != size:
                    continue
                theirs = self.sets[item]
                both = sum(min(c, theirs[g]) * self.weight[g] for g, c in mine.items() if g in theirs)
                similarity = both / (mass + self.masses[item] - both)
                if similarity >= self.similarity - 1e-12:
                    out.setdefault(r, []).append((item, a - int(first[r]), b - int(first[r]), float(similarity)))

    @staticmethod
    def _apart(found: list[tuple]) -> list[tuple]:
        """Per item the best windows that do not overlap."""
        kept: list[tuple] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for m in sorted(found, key=lambda m: (-m[3], m[1], m[0])):
            spans = taken.setdefault(m[0], [])
            if all(m[2] <= a or m[1] >= b for a, b in spans):
                spans.append(m[1:3])
                kept.append(m)
        return sorted(kept, key=lambda m: (m[1], m[0]))


MATCHES = "array<struct<item_id:bigint,start:int,end:int,similarity:double>>"


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS, column: str = "matches",
) -> DataFrame:
    """The input columns (a clashing one is replaced) and ``matches``: windows (word positions, end exclusive) that
    resemble an item, the best ones that do not overlap per item.

    Null, empty and wordless texts and items match nothing; long texts are searched whole; windows at a document's
    ends may be shorter than the item. Repeated items each match; repeated rows get equal results. Empty tables on
    either side give no match. Ids may be null.
    """
    cols = [c for c in docs.columns if c != column]
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(item_text_col)), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64(item_id_col, item_text_col), F.lit(blocks)).alias("block")
    slim = items.select(block, F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    kinds = [docs.schema[c].dataType.simpleString() for c in cols]
    schema = ", ".join([f"m {MATCHES}", "t string", *(f"c{i} {k}" for i, k in enumerate(kinds))])
    out = docs.select(F.lit(None).cast(MATCHES).alias("m"), F.col(text_col).cast("string").alias("t"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))
    held = None
    if blocks > 1:  # a shingle weighs by all items that hold it, whichever block they are in
        table = _item_grams(slim.select("text")).groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").toArrow()
        grams, counts = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        held = grams[order := np.argsort(grams)], counts[order]
    for b in range(blocks):
        rows = slim.filter(F.col("block") == b).select("id", "text").collect()
        index = ItemIndex([(r.id, r.text) for r in sorted(rows, key=lambda r: (r.id is None, r.id or 0, r.text or ""))], radius, similarity, held)
        out = out.mapInArrow(_pass(share(docs.sparkSession, index)), schema)
        if b < blocks - 1:  # written, so that a task holds the index of one block only
            out = staged(out, "block_matches")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)), F.coalesce("m", F.array().cast(MATCHES)).alias(column))


def _pass(shared):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("similarity", pa.float64())]))

    def run(batches):
        index, letters, powers = unpacked(shared), Powers(RADIX), Powers(SECOND)
        for batch in batches:
            found: dict[int, list] = {}
            for row, data, offsets in text_slices(batch.column(1)):
                for r, matches in index.matches(data, offsets, letters, powers).items():
                    found[row + r] = [{"item_id": index.ids[i], "start": a, "end": b, "similarity": s} for i, a, b, s in matches]
            column = batch.column(0)
            if found:
                lists = column.to_pylist()
                for r, matches in found.items():
                    lists[r] = (lists[r] or []) + matches
                column = pa.array(lists, kind)
            yield pa.RecordBatch.from_arrays([column.cast(kind), *batch.columns[1:]], names=batch.schema.names)
    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that match no item, with their columns."""
    found = contamination(docs, items, text_col, column="__matches")
    return found.filter(F.size("__matches") == 0).drop("__matches")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, load(spark, sf_dir, "benchmark")).drop("text")
    best = F.array_max(F.transform("matches", lambda m: F.struct(m.similarity.alias("s"), (-m.item_id).alias("i"))))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").alias("n_windows"),
        (-best.i).alias("best_item"), F.round(best.s, 6).alias("best_similarity"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.item_id))).alias("item_ids"),
    )
