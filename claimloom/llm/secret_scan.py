"""Secrets in whole texts: fixed patterns, and a guess-cost measure of credential values.

Three base patterns find assignments, access keys and long hex strings. Beyond these, the value behind any
credential word (a wider set of words and connectives) is priced by dynamic programming: the cheapest way
to cut it into words, dates, repeats, keyboard walks and brute-force spans, in guesses. A value that costs
``MIN_GUESSES`` (powers of ten) or more is a span of kind ``guess``; "password = changeme" is not one.

Words have the rank of a short list of common passwords and, behind these, of the words of the corpus itself by their
counts over all documents (``learned_words``). A value that is nothing but such words and single separators is most
often prose or a placeholder ("auth: documentation"), so it must cost ``PHRASE_GUESSES``: some five rare words.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimloom.staging import staged

from .common import load

MIN_GUESSES = 10.0
PHRASE_GUESSES = 18.0
MIN_VALUE = 6
TOP_WORDS, MIN_COUNT = 20_000, 5  # words learned from the corpus: how many at most, and how often each must stand there
SEPARATORS = "-_."

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# The keyword may be part of an identifier (DB_PASSWORD, secret_key, clientSecretValue); the value is searched apart, so
# that a keyword taken as a value (auth: Bearer ...) opens a context of its own.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"""
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|private[_-]?key|access[_-]?key|client[_-]?secret|bearer)"""
    r"""(?:(?:[_-][A-Za-z0-9_-]{0,40}|[0-9]{1,4}|(?-i:(?<=[a-z])[A-Z][A-Za-z0-9_-]{0,40}))?["']?"""
    r"""(?:\x20{0,4}(?:[:=]>?|->)|\x20{1,4}(?:is|was)(?:\x20{0,4}[:=]|\x20))|["']?\x20)\x20{0,8}["']?(?=[^\s"'<>,;|])""", re.IGNORECASE | re.ASCII,
)
VALUE = re.compile(r"""[^\s"'<>,;|]+""", re.ASCII)
CUES = ("pass", "pwd", "secret", "token", "api_key", "apikey", "api-key", "credential", "auth", "_key", "-key", "ekey", "skey", "bearer")
KINDS = ("assign", "access", "hex", "guess")

# Words and passwords that attackers try first, commonest first.
COMMON = (
    "password", "123456", "qwerty", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "abc123", "iloveyou",
    "football", "baseball", "sunshine", "princess", "shadow", "superman", "michael", "trustno", "hello", "freedom", "whatever",
    "secret", "changeme", "default", "guest", "root", "test", "user", "example", "sample", "demo", "temp", "pass", "token", "key",
    "access", "api", "server", "database", "system", "computer", "internet", "google", "windows", "linux", "office", "company",
    "spring", "summer", "autumn", "winter", "january", "february", "march", "april", "june", "july", "august", "september",
    "october", "november", "december", "monday", "friday", "sunday", "london", "paris", "berlin", "madrid", "orange", "banana",
    "apple", "cookie", "coffee", "flower", "soccer", "hockey", "hunter", "killer", "ninja", "pepper", "ginger", "tiger", "eagle",
    "falcon", "silver", "golden", "purple", "yellow", "green", "black", "white", "blue", "red", "love", "money", "power", "magic",
    "star", "angel", "baby", "family", "friend", "happy", "lucky", "correct", "horse", "battery", "staple", "your", "here", "the",
    "and", "this", "that", "with", "from", "insert", "replace", "none", "null", "true", "false", "string", "value", "my", "new",
    "old", "one", "two", "three", "four", "five", "home", "house", "school", "summer", "world", "people", "time", "year", "day",
)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def _neighbours() -> dict[str, str]:
    out: dict[str, set] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            for dr, di in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                if 0 <= r + dr < len(ROWS) and 0 <= i + di < len(ROWS[r + dr]):
                    out.setdefault(c, set()).add(ROWS[r + dr][i + di])
    return {c: "".join(sorted(x)) for c, x in out.items()}


NEAR = _neighbours()
SWAPS = str.maketrans("@40!13$57", "aaoiiesst")


class GuessCost:
    """Cheapest segmentation of a value, as a power of ten of guesses."""

    SEPARATOR = math.log10(len(SEPARATORS) + 1)
    PIECE = math.log10(2)  # what each further piece costs: the guesser does not know where pieces end

    def __init__(self, words=COMMON):
        self.rank = {}
        for i, w in enumerate(words):
            self.rank.setdefault(w, i + 1)
        self.longest = max(map(len, self.rank), default=0)

    def plain(self, value: str) -> bool:
        """Whether the value is words with at most one separator between them."""
        n = len(value)
        reached = [True] + [False] * n
        for j in range(2, n + 1):
            for i in range(max(0, j - self.longest), j - 1):
                begins = reached[i] or (i > 1 and value[i - 1] in SEPARATORS and reached[i - 1])
                if begins and value[i:j].lower() in self.rank:
                    reached[j] = True
                    break
        return n > 0 and reached[n]

    def _word(self, part: str) -> float | None:
        lower = part.lower()
        rank, swapped = self.rank.get(lower), 0
        if rank is None:
            rank, swapped = self.rank.get(lower.translate(SWAPS)), 1
        if rank is None:
            return None
        upper = sum(c.isupper() for c in part)
        case = 0.0 if not upper else 0.3 if upper in (1, len(part)) and (part[0].isupper()) else 0.3 * min(upper, len(part) - upper) + 0.3
        return math.log10(rank + 1) + case + 0.6 * swapped

    def __call__(self, value: str) -> float:
        n = len(value)
        lower = value.lower()
        size = (
            26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any(c.isdigit() for c in value)
            + 33 * any(not c.isalnum() for c in value) + 100 * any(ord(c) > 127 for c in value)
        )
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            size = 10 if value.isdigit() else 16
        brute = math.log10(max(size, 2))
        # Starting points of runs: repeats of one character, keyboard walks; ends are exclusive.
        alike, walk = list(range(n)), list(range(n))
        for i in range(1, n):
            if value[i] == value[i - 1]:
                alike[i] = alike[i - 1]
            if lower[i] in NEAR.get(lower[i - 1], ""):
                walk[i] = walk[i - 1]
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if value[i].isdigit() and (m := DATE.match(value, i)):
                dates.setdefault(m.end(), []).append(i)
        best = [0.0] + [math.inf] * n
        free = [0.0] + [math.inf] * n  # cheapest with a brute-force span that ends here: longer ones pay no new piece
        for j in range(1, n + 1):
            free[j] = min(free[j - 1], best[j - 1] + self.PIECE) + brute
            low = free[j]
            for i in range(max(0, j - self.longest), j - 1):
                cost = self._word(value[i:j])
                if cost is not None:
                    low = min(low, best[i] + cost + self.PIECE)
            if 1 < j < n and value[j - 1] in SEPARATORS:
                low = min(low, best[j - 1] + self.SEPARATOR)
            for i in dates.get(j, ()):
                low = min(low, best[i] + (4.6 if j - i > 4 else 2.1) + self.PIECE)
            i = alike[j - 1]
            if j - i >= 3:
                low = min(low, best[i] + brute + math.log10(j - i) + self.PIECE)
            i = walk[j - 1]
            if j - i >= 3:
                low = min(low, best[i] + math.log10(47 * (j - i)) + 0.5 + self.PIECE)
            # A repeated block (abcabc) costs the block and its count.
            for size_ in (2, 3, 4):
                if j >= 2 * size_ and value[j - size_ : j] == value[j - 2 * size_ : j - size_]:
                    low = min(low, best[j - size_] + 0.5)
            best[j] = low
        return best[n]


def find(text: str, cost: GuessCost, min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, guesses) by start, then kind."""
    out = []
    lower = text.lower()
    if any(c in lower for c in CUES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                out.append((m.start(), 0, m.end(), cost(m.group(2))))
        start = end = hidden = 0  # the last value as it stands in the text, and where the last span ends
        for m in CONTEXT.finditer(text):
            if m.end() < hidden:
                continue
            if not start < m.end() < end:
                end = VALUE.match(text, m.end()).end()
            start = m.end()
            value = text[start:end].rstrip(".:!?)")
            if len(value) < MIN_VALUE:
                continue
            guesses = cost(value)
            if guesses < min_guesses or (guesses < PHRASE_GUESSES and cost.plain(value)):
                continue
            if not value.isalpha() or "=" in m.group() or ":" in m.group():
                hidden = start + len(value)
                out.append((start, 3, hidden, guesses))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), math.nan) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), math.nan) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: s[:3])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def redact(text: str, spans) -> str:
    """The text with every span (overlapping ones together) replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def learned_words(docs: DataFrame, text_col: str = "text", top: int = TOP_WORDS, min_count: int = MIN_COUNT) -> tuple[str, ...]:
    """The commonest words of 4 to 16 letters of all texts, lower case, commonest first (ties by the word), behind COMMON.

    Counts cover every text. Words of about equal counts (16 classes to each doubling) are taken together, as long as no more than
    ``top`` words are; only these reach the driver. Letters beside a digit or longer runs (keys, hashes) are no
    words. Null and empty texts and empty tables have none.
    """
    found = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![\p{L}\p{N}])\p{L}{4,16}(?![\p{L}\p{N}])"), F.lit(0))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    counts = staged(counts.withColumn("class", F.floor(F.log2("n") * 16)), "word_counts")
    left, lowest = top, None
    for row in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        left -= row["count"]
        if left < 0:
            break
        lowest = row["class"]
    rows = counts.filter(F.col("class") >= lowest).collect() if lowest is not None else []
    return (*COMMON, *(r.word for r in sorted(rows, key=lambda r: (-r.n, r.word))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES, words=COMMON) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, guess_max.

    Base patterns are leftmost and non-overlapping per kind. Null and empty texts have no spans; texts of any
    length are searched whole; ids may be null or repeat. An empty table gives no rows. Other columns are not read.
    """
    def run(batches):
        cost = GuessCost(words)
        for batch in batches:
            rows = []
            for low in range(0, batch.num_rows, 512):
                for text in batch.column(1).slice(low, 512).to_pylist():
                    spans = find(text, cost, min_guesses) if text else []
                    n = [sum(s[1] == k for s in spans) for k in range(4)]
                    base = hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest()
                    rows.append((*n, base, _joined(spans), max((s[3] for s in spans if s[1] == 3), default=None)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "guess_max"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, guess_max double"
    return slim.mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text", min_guesses: float = MIN_GUESSES, words=COMMON) -> DataFrame:
    """All columns and rows; secrets in the text replaced. Null texts stay null."""
    cols = [c for c in docs.columns if c != text_col]

    def run(batches):
        cost = GuessCost(words)
        for batch in batches:
            texts = []
            for low in range(0, batch.num_rows, 512):
                texts += [t and redact(t, find(t, cost, min_guesses)) for t in batch.column(0).slice(low, 512).to_pylist()]
            rest = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *rest], names=[f"c{k}" for k in range(batch.num_columns)])

    kinds = ["string", *(docs.schema[c].dataType.simpleString() for c in cols)]
    slim = docs.select(F.col(text_col).cast("string"), *(F.col(f"`{c}`") for c in cols))
    out = slim.mapInArrow(run, ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds))).toDF(text_col, *cols)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scan(docs, words=learned_words(docs))
