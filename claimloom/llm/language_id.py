"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed greedily against
each automaton: every phrase is the longest match that starts where the last one ended. The language whose
automaton needs the fewest normalised phrases wins: a phrase is a place in the labelled text, so it costs the logarithm
of that text's length, and a language with a short sample is not judged by the phrases it lacks. The letters are the
same for all languages, so nothing is divided by their number.

No letter is dropped. Up to ``LETTERS`` letters of the sample have a symbol each. Where it has more (Chinese, Japanese, many
scripts together), the most frequent ones have a symbol and every other letter, known or not, is spelled in three symbols
by its code point, so automata keep a narrow table whatever the script.

Parsing runs over whole texts, cut into pieces of ``PIECE`` characters so that many pieces advance in step
through numpy tables; a phrase ends at the end of its piece. A piece is the same for every language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import load, share, training_row, unpacked

MAX_CHARS = 32_768  # symbols of labelled text per language in its automaton: the bound of the sample
SNIPPETS, SNIPPET = 256, 512  # the sample: snippets per language, characters of each
MAX_LANGUAGES = 200  # automata held by a task
LETTERS = 94
PIECE = 256
UNKNOWN, GAP = 0, 1
LEADS, TRAILS = 52, 64  # symbols that spell a letter by its code point: the first, and each of the two behind it
TABLE_BYTES = 256 << 20  # of all tables together, at most: with many languages each has a shorter sample


class Automaton:
    """Suffix automaton of code sequences (gaps between texts never match)."""

    def __init__(self, size: int, letters: int):
        self.next = np.zeros((2 * size + 2, letters), dtype=np.int32)
        self.link, self.length, self.count, self.last = [0, 0], [0, 0], 2, 1  # state 1 is the root, 0 none

    def extend(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        p, cur = self.last, self.count
        self.count += 1
        link.append(1)
        length.append(length[p] + 1)
        while p and not nxt[p, c]:
            nxt[p, c] = cur
            p = link[p]
        if p:
            q = int(nxt[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = self.count
                self.count += 1
                nxt[clone] = nxt[q]
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p, c] == q:
                    nxt[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def table(self) -> np.ndarray:
        """Steps of the greedy parse, flat: entry [state * letters + c] is the next state's row, with the sign
        bit set where a phrase ends before c (then the next state is the one c leads to from the root)."""
        n, letters = self.count, self.next.shape[1]
        step = self.next[:n].astype(np.int64) * letters
        fresh = np.where(step[1] > 0, step[1], letters)
        out = np.where(step > 0, step, fresh[None, :] - (1 << 31))
        return out.astype(np.int32).ravel()


class Model:
    """Character codes and one parse table per language."""

    def __init__(self, samples: dict[str, list[str]], max_chars: int = MAX_CHARS):
        lower = [chr(i).lower() if not 0xD800 <= i < 0xE000 else "" for i in range(0x110000)]
        self.names = sorted(samples)
        seen: dict[str, int] = {}
        for texts in samples.values():
            for c in "".join(texts).lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        letters = sorted(sorted(seen), key=lambda c: -seen[c])[:LETTERS]
        code = {c: i + 2 for i, c in enumerate(letters)}
        self.lead = len(letters) + 2 if len(seen) > LETTERS else 0  # the first symbol that spells, or none
        self.width = len(letters) + 2 + (LEADS + TRAILS if self.lead else 0)
        other = self.lead + LEADS + TRAILS if self.lead else UNKNOWN  # stands for a letter to be spelled
        self.codes = np.fromiter(
            (code.get(c[:1], other) if c.isalpha() else GAP for c in lower), dtype=np.uint8, count=len(lower)
        )
        self.lower = np.fromiter((ord(c[0]) if c else i for i, c in enumerate(lower)), dtype=np.uint32, count=len(lower) if self.lead else 0)
        self.tables, self.cost = [], []
        max_chars = max(1, min(max_chars, TABLE_BYTES // (8 * self.width * max(len(samples), 1))))
        for name in self.names:
            automaton = Automaton(max_chars + 1, self.width)
            left = max_chars
            for text in samples[name]:
                if left <= 0:
                    break
                symbols = self.encode(text[:left])[:left]
                left -= len(symbols)
                automaton.last = 1
                for c in symbols.tolist():
                    if c == UNKNOWN:
                        automaton.last = 1
                    else:
                        automaton.extend(c)
            self.tables.append(automaton.table())
            self.cost.append(np.log2(max_chars - left + 2))

    def encode(self, text: str) -> np.ndarray:
        return self.symbols(text)[0]

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the text, where those of each character begin, with the end)."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.codes[points]
        spelled = codes == self.lead + LEADS + TRAILS if self.lead else np.zeros(len(codes), dtype=bool)
        begin = np.concatenate([[0], np.cumsum(np.where(spelled, 3, 1))])
        if not spelled.any():
            return codes, begin
        out = np.repeat(codes, np.diff(begin))
        at, point = begin[:-1][spelled], self.lower[points[spelled]]
        out[at] = self.lead + np.minimum(point >> 12, LEADS - 1)
        out[at + 1] = self.lead + LEADS + (point >> 6 & TRAILS - 1)
        out[at + 2] = self.lead + LEADS + (point & TRAILS - 1)
        return out, begin

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[language, text]: phrases of texts offsets[i]:offsets[i + 1] of a code sequence."""
        size = np.diff(offsets)
        pieces = -(-size // PIECE)
        text = np.repeat(np.arange(len(size)), pieces)
        order = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][text] + order * PIECE
        length = np.minimum(PIECE, offsets[1:][text] - start)
        rank = np.argsort(-length, kind="stable")
        start, length, text = start[rank], length[rank], text[rank]
        active = np.searchsorted(-length, -np.arange(PIECE), side="left")  # pieces longer than step i
        out = np.zeros((len(self.names), len(size)), dtype=np.int64)
        for k, table in enumerate(self.tables):
            state = np.full(len(start), self.width, dtype=np.int32)
            count = np.ones(len(start), dtype=np.int32)
            for i in range(PIECE):
                n = active[i]
                if not n:
                    break
                step = table[state[:n] + codes[start[:n] + i]]
                count[:n] -= step >> 31
                state[:n] = step & 0x7FFFFFFF
            out[k] = np.bincount(text, weights=count, minlength=len(size))
        return out


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """At most ``SNIPPETS`` snippets per language of training rows: in each of as many hash classes of the
    id, that of the row with the smallest hash. Only ids and languages are read to choose them."""
    key = F.xxhash64(id_col)
    rows = docs.filter(training_row(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = (
        rows.select(F.col(lang_col).alias("lang"), key.alias("key"), F.pmod(key, F.lit(SNIPPETS)).alias("class"))
        .groupBy("lang", "class").agg(F.min("key").alias("key")).select("lang", "key")
    )
    if chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    texts = (
        rows.select(F.col(lang_col).alias("lang"), key.alias("key"), F.substring(text_col, 1, SNIPPET).alias("text"))
        .join(F.broadcast(chosen), ["lang", "key"])  # at most MAX_LANGUAGES * SNIPPETS rows of two values
        .groupBy("lang", "key").agg(F.min("text").alias("text"))
    )
    out: dict[str, list[str]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r.lang, r.key)):
        out.setdefault(row.lang, []).append(row.text)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars: int = MAX_CHARS) -> Model:
    """Automata from training rows (crc32 of the id as text, modulo 5, not 0; language and text not null)."""
    return Model(_sample(docs, id_col, text_col, lang_col), max_chars)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """The input columns, less any that clash, with lang_pred (``und`` if the text is null or has no letter, or if nothing
    was learned), score (0 to 1: how far the second-best language is behind, in normalised phrases) and letters.

    Ties go to the name that sorts first, with score 0. Texts are parsed whole, of any length; repeated rows
    get equal results. Null ids are allowed. An empty table gives no rows.
    """
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "letters")]
    keep = [c for c in docs.columns if c not in names]
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = unpacked(shared)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            langs, scores, letters = [], [], []
            for low in range(0, len(column), 512):
                texts = [x or "" for x in column.slice(low, 512).to_pylist()]
                at = 0
                while at < len(texts):  # runs of about a million characters, or one longer text
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                        size += len(texts[end])
                        end += 1
                    part = texts[at:end]
                    at = end
                    codes, begin = model.symbols("".join(part))
                    ends = np.concatenate([[0], np.cumsum([len(t) for t in part])])
                    offsets = begin[ends]
                    n = np.diff(np.concatenate([[0], np.cumsum(codes[begin[:-1]] != GAP)])[ends])
                    letters += n.tolist()
                    if not model.names:
                        langs += ["und"] * len(part)
                        scores += [0.0] * len(part)
                        continue
                    counts = model.phrases(codes, offsets) * np.array(model.cost)[:, None]
                    best = counts.argmin(axis=0)
                    order = np.sort(counts, axis=0)
                    second = order[1] if len(order) > 1 else np.full(len(part), np.inf)
                    score = np.where(n > 0, 1 - order[0] / np.where(second > 0, second, 1), 0.0)
                    langs += [model.names[k] if m else "und" for k, m in zip(best.tolist(), n.tolist())]
                    scores += np.clip(score, 0, 1).tolist()
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            cols += [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"c{i} {kind}" for i, kind in enumerate(kinds)), *(f"c{len(keep) + i} {kind}" for i, kind in enumerate(("string", "double", "long")))])
    slim = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(run, schema).toDF(*keep, *names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")
