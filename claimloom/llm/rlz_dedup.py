"""Substring dedup by a relative Lempel-Ziv parse.

Every text is parsed into factors, each a copy of words that start earlier, with literal words between them.

* Index. In each window of ``window`` words the smallest hash of ``gram`` words is its anchor, so equal windows have
  equal anchors at equal offsets. The consecutive windows that share one anchor are a reference block, and blocks are
  indexed by anchor.
* Matches. A block equal to an earlier one is a match with it, all its windows at once. A block whose anchor also stands
  in a block of other words lies where matches may begin or end: its windows are looked up one by one among those of all
  such blocks. Every other block begins no match. A match knows its reference: document and word position.
* Extension. Matches that go on in the same reference (same document, same distance between the two positions, words that
  overlap or adjoin) are one match, as long as the words go on.
* Parse. From left to right, the next factor is the match that covers the next word and reaches furthest; where none
  covers it, the parse moves on to the next match. A match that begins inside the factor before is looked at as
  well, so windows across a factor's border are not lost, and the words of all factors are just the words of all
  repeated windows. Factors of ``window`` words come from one match; shorter ones are the part of a match behind
  the factor before.

A window's reference is the earliest one known to the task that met it, so the longest match is found along these references
and not among all places where the words stand: more factors may be needed, never fewer words be covered.

Rows are ordered by (doc_id, start). Within an Arrow batch equal blocks, and equal boundary windows, are
first reduced to their earliest, so a passage found in a third of all documents reaches the shuffle once per
batch and not once per document. No text is compared with another; each step is one shuffle by hash. Block
keys are 128 bits (words of the block, words of the anchor), window keys two 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimloom.staging import staged

from .common import RADIX, SECOND, Powers, Rolling, Words, load, mix, text_slices

WINDOW = 20
GRAM = 6
LAST = (1 << 63) - 1

ROWS = "g long, h long, loc long, tag long, start int, n int, kind int, rloc long, rstart int"
RUNS = "loc long, tag long, start int, n int, rloc long, rstart int"
SPAN, CHECK, BLOCK, MARK = 0, 1, 2, 3


def _frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """loc orders documents (null ids last), tag tells apart texts that share an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("loc"), F.crc32(text.cast("binary")).alias("tag"),
        text.alias("text"),
    )


def _first(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by ``keys`` (the leading two are the group) and, in that order, where groups begin."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[:2]], axis=0) if len(order) else new[1:]
    return order, new


def _ahead(loc, start, order, new):
    """In sorted order: rows strictly behind the first of their group by (loc, start), and that first row's loc and start."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    loc, start = loc[order], start[order]
    return (loc != loc[lead]) | (start != start[lead]), loc[lead], start[lead]


def _merge(loc, tag, start, n, rloc, rstart):
    """Adjoining or overlapping spans of one text that go on in one reference become one."""
    if not len(loc):
        return loc, tag, start, n, rloc, rstart
    shift = start.astype(np.int64) - rstart
    order = np.lexsort((start, shift, rloc, tag, loc))
    loc, tag, rloc, shift, start, end = loc[order], tag[order], rloc[order], shift[order], start[order], (start + n)[order]
    new = np.ones(len(loc), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (loc, tag, rloc, shift)], axis=0)
    far = end + np.cumsum(new) * (1 << 40)  # running end within a text
    far = np.maximum.accumulate(far) - np.cumsum(new) * (1 << 40)
    new[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, at)
    return loc[at], tag[at], start[at], stop - start[at], rloc[at], start[at] - shift[at]


def _batch(columns: dict) -> pa.RecordBatch:
    types = {"start": np.int32, "n": np.int32, "kind": np.int32, "rstart": np.int32}
    arrays = {k: np.ascontiguousarray(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(types.get(k, np.int64))) for k, a in arrays.items()],
        names=list(arrays),
    )


def _blocks(words: Words, hashes: np.ndarray, powers: Powers, window: int, gram: int):
    """Blocks of a run of texts: anchor hash, block hash, text row, first window, number of windows."""
    n = len(hashes)
    per = np.maximum(np.diff(words.first) - window + 1, 0)
    where = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(per)), per)
    at = np.arange(where[-1]) - where[:-1][row] + words.first[:-1][row]
    if not len(at):
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 3
    roll = Rolling(hashes, powers)
    left = np.arange(n - gram + 1)
    grams = roll(left, left + gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    anchor = np.empty(len(at), dtype=np.int64)
    for k in range(0, len(at), 1 << 16):
        anchor[k : k + (1 << 16)] = at[k : k + (1 << 16)] + views[at[k : k + (1 << 16)]].argmin(axis=1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    return grams[anchor[first]], roll(start, start + size + window - 1), row[first], start - words.first[row[first]], size


def _index(window: int, gram: int):
    def run(batches):
        letters, powers = Powers(RADIX), Powers(SECOND)
        for batch in batches:
            locs, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = []
            for row, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                g, h, at, start, n = _blocks(words, words.hashes(letters), powers, window, gram)
                found.append((g, h, at + row, start, n))
            if not found:
                continue
            g, h, at, start, n = (np.concatenate(x) for x in zip(*found))
            loc, tag = locs[at], tags[at]
            order, new = _first(g, h, loc, start)
            behind, rloc, rstart = _ahead(loc, start, order, new)
            g, h, loc, tag, start, n = (x[order] for x in (g, h, loc, tag, start, n))
            spans = _merge(*(x[behind] for x in (loc, tag, start, n, rloc, rstart)))
            # Anchors with blocks of different words in this batch: check these blocks, and leave one mark.
            g1, h1, loc1, tag1, start1, n1 = (x[new] for x in (g, h, loc, tag, start, n))
            lead = np.ones(len(g1), dtype=bool)
            lead[1:] = g1[1:] != g1[:-1]
            group = np.cumsum(lead) - 1
            many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
            # Repeated rows (same id, same text) name the same place; their blocks are checked once.
            kind = np.where(many, CHECK, BLOCK)
            mark = many & lead
            yield _batch({
                "g": np.concatenate([np.where(many, mix(h1), g1), g1[mark], mix(spans[0].view(np.uint64))]),
                "h": np.concatenate([h1, h1[mark], spans[0].view(np.uint64)]),
                "loc": np.concatenate([loc1, loc1[mark], spans[0]]), "tag": np.concatenate([tag1, tag1[mark], spans[1]]),
                "start": np.concatenate([start1, start1[mark], spans[2]]), "n": np.concatenate([n1, n1[mark], spans[3]]),
                "kind": np.concatenate([kind, np.full(mark.sum(), MARK), np.full(len(spans[0]), SPAN)]),
                "rloc": _behind(spans[4], len(g1) + mark.sum()), "rstart": _behind(spans[5], len(g1) + mark.sum()),
            })
    return run


def _behind(values, n):
    """``values`` with n zeros before them."""
    return np.concatenate([np.zeros(n, dtype=np.int64), values])


def _columns(batch):
    out = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
    return out


def _factor(batches):
    """Rows sorted by (g, h, loc, start): spans of repeated blocks, and blocks to check window by window.

    Of a group that runs over several batches only its first block and whether it is mixed are kept.
    """
    held = None  # (g, h, loc, tag, start, n) of the first block of an anchor with one kind of words so far
    last = None  # (g, h, loc, start) of the leading row of the current block key
    mixed = None  # the anchor known to be mixed
    for batch in batches:
        g, h, loc, tag, start, n, kind, rloc, rstart = _columns(batch)
        if not len(g):
            continue
        through = kind <= CHECK
        out = [tuple(x[through] for x in (loc, tag, start, n, kind, rloc, rstart))]
        keep = ~through
        g, h, loc, tag, start, n, kind = (x[keep] for x in (g, h, loc, tag, start, n, kind))
        if len(g):
            newg = np.ones(len(g), dtype=bool)
            newg[1:] = g[1:] != g[:-1]
            newh = newg.copy()
            newh[1:] |= h[1:] != h[:-1]
            old = last is not None and g[0] == last[0]
            same = old and h[0] == last[1]
            newg[0], newh[0] = not old, not same
            lead = np.maximum.accumulate(np.where(newh, np.arange(len(g)), -1))
            llead, slead = (np.where(lead >= 0, x[lead], y) for x, y in ((loc, last[2] if last else 0), (start, last[3] if last else 0)))
            behind = (kind == BLOCK) & ~newh & ((loc != llead) | (start != slead))
            out.append((loc[behind], tag[behind], start[behind], n[behind], np.zeros(behind.sum(), dtype=np.int32), llead[behind], slead[behind]))
            group = np.cumsum(newg)  # 0: goes on from the batch before
            distinct = np.bincount(group, weights=newh, minlength=group[-1] + 1)
            marked = np.bincount(group, weights=kind == MARK, minlength=group[-1] + 1) > 0
            if held is not None:
                distinct[0] += 1
            many = (distinct > 1) | marked
            if old and mixed == last[0]:
                many[0] = True
            first = (kind == BLOCK) & ~behind
            lone = first & ~many[group]
            check = first & many[group]
            none = np.zeros(check.sum(), dtype=np.int64)
            out.append((loc[check], tag[check], start[check], n[check], np.ones(check.sum(), dtype=np.int32), none, none))
            if held is not None and group[0] == 0 and many[0]:
                out.append(tuple(np.array([x]) for x in (*held, 1, 0, 0)))
                held = None
            if group[-1] > 0 or not old:
                held = None
            end = group == group[-1]
            if many[group[-1]]:
                mixed, held = g[-1], None
            elif held is None and (lone & end).any():
                k = np.flatnonzero(lone & end)[0]
                held = (loc[k], tag[k], start[k], n[k])
            last = (g[-1], h[-1], llead[-1], slead[-1])
        loc, tag, start, n, kind, rloc, rstart = (np.concatenate(x) for x in zip(*out))
        yield _batch({"loc": loc, "tag": tag, "start": start, "n": n, "kind": kind, "rloc": rloc, "rstart": rstart})


def _windows(window: int):
    """Window hashes of the blocks to check; repeats within a batch become spans at once."""
    def run(batches):
        letters, one, two = Powers(RADIX), Powers(SECOND), Powers(SECOND ^ 0x5DEECE66D00)
        for batch in batches:
            locs, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            starts, ns = batch.column(3), batch.column(4)
            found = []
            for row, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                hashes = words.hashes(letters)
                rows = len(offsets) - 1
                s, n = (x.slice(row, rows) for x in (starts, ns))
                at = np.repeat(np.arange(rows), np.diff(s.offsets.to_numpy()))
                s, n = s.flatten().to_numpy(), n.flatten().to_numpy()
                base = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who = np.repeat(at, n)
                begin = words.first[who] + base
                found.append((Rolling(hashes, one)(begin, begin + window), Rolling(mix(hashes), two)(begin, begin + window), who + row, base))
            if not found:
                continue
            g, h, at, start = (np.concatenate(x) for x in zip(*found))
            loc, tag = locs[at], tags[at]
            order, new = _first(g, h, loc, start)
            behind, rloc, rstart = _ahead(loc, start, order, new)
            g, h, loc, tag, start = (x[order] for x in (g, h, loc, tag, start))
            keep = ~behind
            one_each = np.ones(behind.sum(), dtype=np.int64)
            spans = _merge(loc[behind], tag[behind], start[behind].astype(np.int64), one_each, rloc[behind], rstart[behind])
            yield _batch({
                "g": np.concatenate([g[keep], mix(spans[0].view(np.uint64))]), "h": np.concatenate([h[keep], spans[0].view(np.uint64)]),
                "loc": np.concatenate([loc[keep], spans[0]]), "tag": np.concatenate([tag[keep], spans[1]]),
                "start": np.concatenate([start[keep], spans[2]]), "n": np.concatenate([np.ones(keep.sum(), dtype=np.int64), spans[3]]),
                "kind": np.concatenate([np.full(keep.sum(), BLOCK), np.full(len(spans[0]), SPAN)]),
                "rloc": _behind(spans[4], keep.sum()), "rstart": _behind(spans[5], keep.sum()),
            })
    return run


def _repeats(batches):
    """Rows sorted by (g, h, loc, start): windows behind the first of their key."""
    last = None
    for batch in batches:
        g, h, loc, tag, start, n, kind, rloc, rstart = _columns(batch)
        if not len(g):
            continue
        span = kind == SPAN
        out = [tuple(x[span] for x in (loc, tag, start, n, rloc, rstart))]
        g, h, loc, tag, start, n = (x[~span] for x in (g, h, loc, tag, start, n))
        if len(g):
            new = np.ones(len(g), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            new[0] = not (last is not None and last[:2] == (g[0], h[0]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            llead, slead = (np.where(lead >= 0, x[lead], y) for x, y in ((loc, last[2] if last else 0), (start, last[3] if last else 0)))
            behind = ~new & ((loc != llead) | (start != slead))
            out.append(tuple(x[behind] for x in (loc, tag, start, n, llead, slead)))
            last = (g[-1], h[-1], llead[-1], slead[-1])
        names = ("loc", "tag", "start", "n", "rloc", "rstart")
        yield _batch(dict(zip(names, _merge(*(np.concatenate(x).astype(np.int64) for x in zip(*out))))))


def duplicate_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(loc, tag, start, n, rloc, rstart): runs of n windows from word ``start`` whose words also start earlier, at word
    ``rstart`` of ``rloc``.

    ``loc`` is the id (the largest long for null ids, which therefore come last and count as one document),
    ``tag`` the crc32 of the text. Runs may adjoin or overlap.
    """
    frame = _frame(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = frame.mapInArrow(_index(window, gram), ROWS)
    matches = staged(
        index.repartition(n, "g").sortWithinPartitions("g", "h", "loc", "start")
        .mapInArrow(_factor, "loc long, tag long, start int, n int, kind int, rloc long, rstart int"), "matches",
    )
    checks = matches.filter(F.col("kind") == CHECK).groupBy("loc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("c"))
    wanted = checks.select("loc", "tag", F.col("c.start").alias("starts"), F.col("c.n").alias("ns"))
    windows = frame.join(wanted, ["loc", "tag"]).select("loc", "tag", "text", "starts", "ns")
    found = (
        windows.mapInArrow(_windows(window), ROWS).repartition(n, "g").sortWithinPartitions("g", "h", "loc", "start")
        .mapInArrow(_repeats, RUNS)
    )
    return matches.filter(F.col("kind") == SPAN).drop("kind").unionByName(found)


def _extended(start, end, rloc, rstart):
    """Matches (words, end exclusive) of one text, joined where they go on in one reference."""
    shift = start - rstart
    order = np.lexsort((start, shift, rloc))
    start, end, rloc, shift = (x[order] for x in (start, end, rloc, shift))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (rloc[1:] != rloc[:-1]) | (shift[1:] != shift[:-1])
    group = np.cumsum(new) * (1 << 40)
    far = np.maximum.accumulate(end + group) - group
    new[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(new)
    return start[at], np.maximum.reduceat(end, at), rloc[at], start[at] - shift[at]


def parse(start, end, rloc, rstart) -> list[tuple[int, int, int, int]]:
    """Factors (first word, end, document and position of the reference) of one text from its matches."""
    if not len(start):
        return []
    start, end, rloc, rstart = _extended(start, end, rloc, rstart)
    order = np.lexsort((rloc, -end, start))
    start, end, rloc, rstart = (x[order] for x in (start, end, rloc, rstart))
    further = np.ones(len(start), dtype=bool)
    further[1:] = end[1:] > np.maximum.accumulate(end)[:-1]  # the others lie inside a match
    start, end, rloc, rstart = (x[further].tolist() for x in (start, end, rloc, rstart))
    out, done, i = [], 0, 0
    while i < len(start):
        begin = max(done, start[i])
        while i + 1 < len(start) and start[i + 1] <= begin:
            i += 1
        out.append((begin, end[i], rloc[i], rstart[i] + begin - start[i]))
        done = end[i]
        i += 1
    return out


FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])


def _clean(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            ids, runs = batch.column(0), batch.column(2)
            total, gone, digest, texts, factors = [], [], [], [], []
            for row, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                rows = len(offsets) - 1
                some = runs.slice(row, rows)
                some = some.fill_null([]) if some.null_count else some
                edges = some.offsets.to_numpy()
                start, n, rloc, rstart = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in some.flatten().flatten())
                edges = edges - edges[0]
                parsed = [parse(start[a:b], (start + n)[a:b] + window - 1, rloc[a:b], rstart[a:b]) for a, b in zip(edges, edges[1:])]
                step = np.zeros(len(words.start) + 1, dtype=np.int64)
                flat = np.array([(words.first[d] + f[0], words.first[d] + f[1]) for d, fs in enumerate(parsed) for f in fs], dtype=np.int64).reshape(-1, 2)
                np.add.at(step, flat[:, 0], 1)
                np.add.at(step, flat[:, 1], -1)
                keep = np.cumsum(step)[:-1] == 0
                text, begin = words.joined(keep)
                left = np.concatenate([[0], np.cumsum(keep)])[words.first]
                for d in range(rows):
                    a, b = left[d], left[d + 1]
                    kept = text[begin[a] : begin[b] - 1] if b > a else b""
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8", "replace"))
                        factors.append([(x, y, None if at == LAST else at, place) for x, y, at, place in parsed[d]])
                total.append(np.diff(words.first))
                gone.append(np.diff(words.first) - np.diff(left))
            cols = [ids, *(pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (total, gone)), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                named = [[dict(zip(("start", "end", "ref_id", "ref_start"), f)) for f in fs] for fs in factors]
                spans = [[] for _ in factors]
                for out, fs in zip(spans, factors):  # factors that adjoin are one span
                    for x, y, *_ in fs:
                        if out and out[-1]["end"] == x:
                            out[-1]["end"] = y
                        else:
                            out.append({"start": x, "end": y})
                cols += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(named, pa.list_(FACTOR))]
                names += ["kept_text", "spans", "factors"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text (kept
    words joined by one space), spans (removed word positions, end exclusive) and factors (those positions as copies: start,
    end, ref_id and ref_start, where the same words start earlier; a null ref_id is that of a null doc_id).

    Null and empty texts have no words. Texts shorter than ``window`` words lose nothing. Repeated rows
    (equal id and text) name the same place and get equal results; rows that share an id but not the text
    count as one document. Null ids count as one document after all others. An empty table gives no rows.
    Other columns are not read.
    """
    runs = duplicate_windows(docs, id_col, text_col, window, gram)
    lists = runs.groupBy("loc", "tag").agg(F.collect_list(F.struct("start", "n", "rloc", "rstart")).alias("runs"))
    frame = _frame(docs, id_col, text_col).join(lists, ["loc", "tag"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", kept_text string, spans array<struct<start:int,end:int>>, factors array<struct<start:int,end:int,ref_id:long,ref_start:int>>"
    doc_id = F.when(F.col("loc") != LAST, F.col("loc")).alias("doc_id")
    return frame.select(doc_id, "text", "runs").mapInArrow(_clean(window, with_text), schema)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, length, ref_id, ref_start): one row per factor of every text; see ``dedup`` for awkward rows."""
    found = dedup(docs, id_col, text_col, window, gram).select("doc_id", F.explode("factors").alias("f"))
    return found.select("doc_id", "f.start", (F.col("f.end") - F.col("f.start")).alias("length"), "f.ref_id", "f.ref_start")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(load(spark, sf_dir, "documents"), with_text=False)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup
), kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) a
  ANTI JOIN gone USING (doc_id, p) GROUP BY a.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
