"""Quality rules with thresholds that follow the corpus.

One pass over the texts counts words, symbols, capitals, lines and repeats. Each measure (a share in thousandths, or
a mean word length in hundredths) is then sketched per language and source: a row per distinct value cut to its top
``BITS`` bits, with a count. Such a sketch has a relative error of 2 ** (1 - BITS), at most a few hundred rows
whatever the number of documents, and merges by adding counts, in any order and with the same result: groups
of less than ``MIN_DOCS`` documents use the merged sketch of their language, and if that is small too, of all
documents. Fences set from a group's quartiles replace fixed cutoffs, and a join puts each document against its own.

The counting is one map over Arrow batches; sketches are combined before their shuffle, so a source that holds a
third of the documents costs a few hundred rows a task. The join is salted, as fences are few and documents many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimloom.staging import staged

from .common import BYTE_CODE, RADIX, SECOND, SPACE, Powers, Rolling, Words, load, mix, text_slices

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"

BITS = 7
MIN_DOCS = 200
SPREAD = 4
SALT = 16

#: Measure: (numerator, denominator, factor, least distance of the fence from the quartile, whether low values fail too)
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1000, 20, False),
    "marks": ("n_marks", "word_chars", 1000, 20, False),
    "capitals": ("n_capitals", "word_chars", 1000, 100, False),
    "lines": ("n_dup_lines", "n_lines", 1000, 250, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False),
    "length": ("word_chars", "n_words", 100, 100, True),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_lines")


def _flags(codes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


IS_SYMBOL, IS_MARK, IS_CAPITAL = _flags(SYMBOLS), _flags(MARKS), _flags(bytes(range(65, 91)))
IS_CHAR = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)  # the first byte of a character of a word


def _within(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flag)])
    return np.diff(total[offsets])


def measure_texts(data: np.ndarray, offsets: np.ndarray, powers: tuple[Powers, Powers], window: int = WINDOW) -> list[np.ndarray]:
    """The COUNTS of consecutive texts in one buffer. Windows and lines are compared by 64-bit hashes within a text."""
    texts = len(offsets) - 1
    words = Words(data, offsets)
    rolling = Rolling(BYTE_CODE[data], powers[0])
    n_words = np.diff(words.first)

    # Repeats: windows of one text with equal hashes; the words they cover are counted once.
    text_of_word = np.repeat(np.arange(texts), n_words)
    start = np.flatnonzero(words.first[text_of_word + 1] - np.arange(len(text_of_word)) >= window)
    key = Rolling(rolling(words.start, words.end), powers[1])(start, start + window)
    _, at, times = np.unique(mix(key ^ mix(text_of_word[start].astype(np.uint64))), return_inverse=True, return_counts=True)
    start = start[times[at] > 1]
    edges = np.zeros(len(text_of_word) + 1, dtype=np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + window, -1)
    n_repeat = _within(np.cumsum(edges)[:-1] > 0, words.first)

    # Lines with a word; all but the first of equal ones count.
    breaks = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    text_of_line = np.repeat(np.arange(texts), _within(data == 10, offsets) + 1)
    filled = np.concatenate([[0], np.cumsum(~SPACE[data])])
    some = filled[end] > filled[begin]
    begin, end, text_of_line = begin[some], end[some], text_of_line[some]
    _, first = np.unique(mix(rolling(begin, end) ^ mix(text_of_line.astype(np.uint64))), return_index=True)
    n_lines = np.bincount(text_of_line, minlength=texts)
    n_dup = n_lines - np.bincount(text_of_line[first], minlength=texts)
    count = lambda flags: _within(flags[data], offsets)
    return [n_words, count(IS_CHAR), count(IS_SYMBOL), n_dup, n_repeat, count(IS_MARK), count(IS_CAPITAL), n_lines]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), window: int = WINDOW) -> DataFrame:
    """doc_id, the group columns (string) and the COUNTS of every document."""
    names = [f"g{i}" for i in range(len(groups))]
    slim = docs.select(
        docs[id_col].cast("long").alias("doc_id"), *(docs[g].cast("string").alias(n) for g, n in zip(groups, names)), docs[text_col].cast("string").alias("text")
    )

    def run(batches):
        powers = Powers(RADIX), Powers(SECOND)
        for batch in batches:
            found = [[] for _ in COUNTS]
            for _, data, offsets in text_slices(batch.column(len(names) + 1)):
                for held, counts in zip(found, measure_texts(data, offsets, powers, window)):
                    held.append(counts)
            counts = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=["doc_id", *names, *COUNTS])

    schema = ", ".join(["doc_id long", *(f"{n} string" for n in names), *(f"{c} long" for c in COUNTS)])
    return slim.mapInArrow(run, schema)


def ratio(measure: str) -> Column:
    """The whole-number value of a measure; null where there is nothing to divide by."""
    above, below, factor, _, _ = MEASURES[measure]
    return F.expr(f"CASE WHEN {below} > 0 THEN {factor} * {above} DIV {below} END")


def cut(value: Column, bits: int = BITS) -> Column:
    """A whole number from 0 with all but its top bits cleared: the value that stands for it in a sketch."""
    spare = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketch(table: DataFrame, groups: list[str], values: dict[str, Column], bits: int = BITS) -> DataFrame:
    """(groups, measure, low, n): how many values of a group stand at each cut value."""
    long = table.select(*groups, F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()))).alias("m"))
    return long.filter("m.value IS NOT NULL").groupBy(*groups, F.col("m.measure").alias("measure"), cut(F.col("m.value"), bits).alias("low")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of finer groups as sketches of these."""
    return sketches.groupBy(*groups, "measure", "low").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, docs, q25, q50, q75), by one walk over each sketch."""
    whole = Window.partitionBy(*groups, "measure")
    steps = sketches.withColumn("docs", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("low")))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("low"))).alias(f"q{q}") for q in (25, 50, 75)]
    return steps.groupBy(*groups, "measure").agg(F.max("docs").alias("docs"), *at)


def fences(sketches: DataFrame, groups: list[str], min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """(groups, and per measure its highest and lowest passing value) of every group in the sketches.

    A group with too few documents takes the quartiles of the widest prefix of its groups that has enough, the
    last resort being all documents.
    """
    levels = [quartiles(merged(sketches, groups[:k]), groups[:k]) for k in range(len(groups), -1, -1)]
    found = sketches.select(*groups, "measure").distinct()
    for i, level in enumerate(levels):
        keys = groups[: len(groups) - i]
        level = level.select(*(F.col(g).alias(f"k_{g}") for g in keys), F.col("measure").alias("k_measure"), F.struct("docs", "q25", "q50", "q75").alias(f"l{i}"))
        on = F.col("measure") == F.col("k_measure")
        for g in keys:
            on = on & F.col(g).eqNullSafe(F.col(f"k_{g}"))
        found = found.join(level, on, "left").drop("k_measure", *(f"k_{g}" for g in keys))
    last = f"l{len(groups)}"
    chosen = F.coalesce(*(F.when(F.col(f"l{i}.docs") >= min_docs, F.col(f"l{i}")) for i in range(len(groups))), F.col(last))
    found = found.select(*groups, "measure", chosen.alias("q"))
    bounds = []
    for m, (_, _, _, least, two_sided) in MEASURES.items():
        pick = lambda c: F.max(F.when(F.col("measure") == m, c))  # noqa: B023, E731
        bounds.append(pick(F.col("q.q75") + spread * (F.col("q.q75") - F.col("q.q50")) + least).alias(f"{m}_high"))
        if two_sided:
            bounds.append(pick(F.col("q.q25") - spread * (F.col("q.q50") - F.col("q.q25")) - least).alias(f"{m}_low"))
    return found.groupBy(*groups).agg(*bounds)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """One row per input row: doc_id, the COUNTS, base_failed, failed (names of measures outside their fences), kept.

    Null and empty texts have no words and fail the base rules. Null groups are groups of their own. A measure
    without a denominator (no word) passes. Repeated rows count as often as they occur and get equal verdicts. An
    empty table gives no rows. Other columns are not read.
    """
    names = [f"g{i}" for i in range(len(groups))]
    counted = staged(measures(docs, id_col, text_col, groups), "quality_measures")
    sketches = staged(sketch(counted, names, {m: ratio(m) for m in MEASURES}), "quality_sketches")
    limits = fences(sketches, names, min_docs, spread).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    limits = limits.select(*(F.col(n).alias(f"k_{n}") for n in names), F.col("salt").alias("k_salt"), *(c for c in limits.columns if c.endswith(("_high", "_low"))))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64(*COUNTS, "doc_id"), F.lit(SALT)).cast("int"))
    on = F.col("salt") == F.col("k_salt")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"k_{n}"))
    broken = []
    for m, (*_, two_sided) in MEASURES.items():
        outside = ratio(m) > F.col(f"{m}_high")
        if two_sided:
            outside = outside | (ratio(m) < F.col(f"{m}_low"))
        broken.append(F.when(outside, F.lit(m)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = salted.join(limits, on, "left").select("doc_id", *COUNTS, base.alias("base_failed"), F.array_compact(F.array(*broken)).alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).drop("failed")


def _sql_level(name: str, keys: str) -> str:
    group = f"{keys}, " if keys else ""
    return f"""
{name} AS (
  SELECT {group}measure, max(docs) AS docs, min(low) FILTER (upto * 100 >= docs * 25) AS q25, min(low) FILTER (upto * 100 >= docs * 50) AS q50,
         min(low) FILTER (upto * 100 >= docs * 75) AS q75
  FROM (
    SELECT {group}measure, low, sum(count(*)) OVER (PARTITION BY {group}measure ORDER BY low) AS upto, sum(count(*)) OVER (PARTITION BY {group}measure) AS docs
    FROM cuts GROUP BY {group}measure, low
  ) GROUP BY {group}measure
)"""


_SQL_VALUES = ", ".join(f"{{'measure': '{m}', 'value': CASE WHEN {b} > 0 THEN {f} * {a} // {b} END}}" for m, (a, b, f, _, _) in MEASURES.items())
_SQL_LEAST = " ".join(f"WHEN '{m}' THEN {least}" for m, (*_, least, _) in MEASURES.items())
_SQL_LOW = ", ".join(f"'{m}'" for m, (*_, both) in MEASURES.items() if both)

SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 7), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
  ) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_marks,
         len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT doc_id, lang, source, m.measure, m.value FROM (SELECT doc_id, lang, source, unnest([{_SQL_VALUES}]) AS m FROM s) WHERE m.value IS NOT NULL
), cuts AS (
  SELECT lang, source, measure, value - value % (1::BIGINT << greatest(length(bin(value)) - {BITS}, 0)::BIGINT) AS low FROM v
),{_sql_level("l0", "lang, source")},{_sql_level("l1", "lang")},{_sql_level("l2", "")}, q AS (
  SELECT l0.lang, l0.source, l0.measure, CASE WHEN l0.docs >= {MIN_DOCS} THEN l0.q25 WHEN l1.docs >= {MIN_DOCS} THEN l1.q25 ELSE l2.q25 END AS q25,
         CASE WHEN l0.docs >= {MIN_DOCS} THEN l0.q50 WHEN l1.docs >= {MIN_DOCS} THEN l1.q50 ELSE l2.q50 END AS q50,
         CASE WHEN l0.docs >= {MIN_DOCS} THEN l0.q75 WHEN l1.docs >= {MIN_DOCS} THEN l1.q75 ELSE l2.q75 END AS q75,
         CASE l0.measure {_SQL_LEAST} END AS least
  FROM l0 JOIN l1 ON l1.lang IS NOT DISTINCT FROM l0.lang AND l1.measure = l0.measure JOIN l2 ON l2.measure = l0.measure
), bad AS (
  SELECT DISTINCT v.doc_id FROM v JOIN q ON q.lang IS NOT DISTINCT FROM v.lang AND q.source IS NOT DISTINCT FROM v.source AND q.measure = v.measure
  WHERE v.value > q75 + {SPREAD} * (q75 - q50) + least OR (v.measure IN ({_SQL_LOW}) AND v.value < q25 - {SPREAD} * (q50 - q25) - least)
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_capitals, n_lines,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND bad.doc_id IS NULL AS kept
FROM s LEFT JOIN bad USING (doc_id)
"""
