"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The pieces of a vocabulary file span a lattice over the text. Segmentations are drawn by forward filtering and
backward sampling: the forward pass sums the weight of all paths to each position, the backward pass draws the
last piece in proportion, then the one before, to the start. Random numbers are hashes of (row key, place of the chunk
in the row, position), so a row always gets the same pieces, on any cluster.

Piece weights are ``alpha`` times the log probability of a Zipf law over the rank in the file, since the file's
own scores are merge ranks; a smaller alpha gives flatter draws. No piece runs over a line end or has a space
inside, so the lattice falls apart into chunks (spaces and the word after them). Each distinct chunk is filtered
once, all new chunks of a run of texts in step through numpy tables, and kept in a store of bounded size.

Lossless: a space is the piece mark, a literal mark and any character outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_CODE, RADIX, SECOND, Powers, Rolling, load, mix, share, text_slices, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.7
MARK = "▁"
RUN = 1 << 19  # bytes of text encoded at once (a longer text is a run of its own)
NO_ROW = 0x1D8E4E27C47D124F  # seed of rows without a key


class Vocabulary:
    """Trie of the pieces as one hash table, weights, and the bytes of every piece."""

    def __init__(self, model_file: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        pieces, self.raw = {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                if "\n" in piece or " " in piece or (MARK in piece[1:] and piece.strip(MARK)):
                    raise ValueError(f"piece {i} runs over a chunk end")
                pieces.setdefault(piece, i)
                self.raw.append(piece.replace(MARK, " ").encode())
        first = min(pieces.values())
        total = np.log(np.log(n) + 0.5772)
        self.weight = -alpha * (np.log(np.maximum(np.arange(n) - first, 0) + 1.0) + total)
        self.fallback = -alpha * (np.log(float(n)) + total)  # of each byte
        letters = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, dtype=np.int32)
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 1
        self.code[ord(" ")], self.code[ord(MARK)] = self.code[ord(MARK)], 0
        self.width = len(letters) + 1
        steps, ends, count = {}, [-1], 1
        for piece, i in pieces.items():
            at = 0
            for c in piece:
                c = int(self.code[ord(" " if c == MARK else c)])
                key = at * self.width + c
                if key not in steps:
                    steps[key] = count
                    ends.append(-1)
                    count += 1
                at = steps[key]
            ends[at] = i
        self.ends = np.array(ends, dtype=np.int32)
        self.longest = max(map(len, pieces))
        bits = max(12, int(np.ceil(np.log2(len(steps)))) + 2)
        self.shift = np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        for key, state in steps.items():
            h = int(self._hash(np.array([key]))[0])
            while self.keys[h] >= 0:
                h = (h + 1) & (len(self.keys) - 1)
            self.keys[h], self.to[h] = key, state

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next trie states; 0 where there is none."""
        keys = states.astype(np.int64) * self.width + codes
        h = self._hash(keys)
        held = self.keys[h]
        out = np.where(held == keys, self.to[h], 0)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            h[todo] = (h[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[h[todo]]
            out[todo] = np.where(held == keys[todo], self.to[h[todo]], 0)
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of piece ids (the leading mark that encoding adds is taken off)."""
        raw = self.raw
        out = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Order by (major, minor), both non-negative: radix passes of 16 bits."""
    order = np.arange(len(major))
    for values in (minor, major):
        for shift in range(0, int(values.max(initial=0)).bit_length(), 16):
            order = order[np.argsort(((values[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Chunks:
    """The lattices of the distinct chunks met so far, the forward pass done, by chunk hash.

    A store of more than ``MOST`` chunks is emptied before the next run of texts; what it holds never
    changes a result. One run may bring any number of chunks: the table of slots grows with them.
    """

    MOST = 50_000
    SLOTS = 1 << 17

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.letters, self.check = Powers(RADIX), Powers(SECOND)
        self._empty()

    def _empty(self) -> None:
        self.count = self.nodes = self.edges = 0
        self._slots(self.SLOTS)
        self.arrays = {
            "base": np.zeros(1 << 12, dtype=np.int32), "size": np.zeros(1 << 12, dtype=np.int32),  # per chunk
            "first": np.zeros(1 << 14, dtype=np.int32), "last": np.zeros(1 << 14, dtype=np.int32),  # per node: its edges
            "piece": np.zeros(1 << 14, dtype=np.int32), "back": np.zeros(1 << 14, dtype=np.int32),  # per edge: id, characters
            "sum": np.zeros(1 << 14, dtype=np.float64), "many": np.zeros(1 << 14, dtype=np.int32),  # running share in its node, ids
        }

    def _slots(self, slots: int) -> None:
        self.slots = slots
        self.slot_key, self.slot_check = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint64)
        self.slot_chunk = np.full(slots, -1, dtype=np.int32)

    def _room(self, more: int) -> None:
        """At least half of the slots stay free."""
        slots = self.slots
        while slots < 2 * (self.count + more):
            slots *= 2
        if slots > self.slots:
            used = np.flatnonzero(self.slot_chunk >= 0)
            held = self.slot_key[used], self.slot_check[used], self.slot_chunk[used]
            self._slots(slots)
            self._insert(*held)

    def _put(self, at: int, **values: np.ndarray) -> None:
        for name, new in values.items():
            old = self.arrays[name]
            if at + len(new) > len(old):
                old = self.arrays[name] = np.concatenate([old, np.zeros(max(len(old), len(new)), dtype=old.dtype)])
            old[at : at + len(new)] = new

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Build the lattices of chunks data[start:end]: every piece that fits, then the forward pass."""
        v = self.vocabulary
        length = end - start
        begin = np.cumsum(length) - length
        raw = data[np.arange(length.sum()) + np.repeat(start - begin, length)]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        size = heads[begin + length] - heads[begin]
        first = np.cumsum(size) - size
        base = first + np.arange(len(size))  # node of the chunk's start; one node more than characters
        chunk = np.repeat(np.arange(len(size)), size)
        left = (first + size)[chunk] - np.arange(len(points))  # characters from here to the chunk's end
        codes = v.code[points]
        place = np.arange(len(points)) + chunk
        local = np.arange(len(points)) - first[chunk]
        at, states = np.arange(len(points)), np.zeros(len(points), dtype=np.int32)
        starts, lengths, ids = [], [], []
        single = np.zeros(len(points), dtype=bool)
        for n in range(1, v.longest + 1):
            states = v.step(states, codes[at + n - 1])
            alive = states > 0
            at, states = at[alive], states[alive]
            found = v.ends[states]
            some = found >= 0
            if n == 1:
                single[at[some]] = True
            starts.append(at[some])
            lengths.append(np.full(some.sum(), n))
            ids.append(found[some])
            more = left[at] > n
            at, states = at[more], states[more]
            if not len(at):
                break
        other = np.flatnonzero(~single)
        starts.append(other)
        lengths.append(np.ones(len(other), dtype=np.int64))
        ids.append(-points[other].astype(np.int64) - 1)
        start, length, piece = map(np.concatenate, (starts, lengths, ids))
        bytes_of = 1 + (points[other] > 0x7F) + (points[other] > 0x7FF) + (points[other] > 0xFFFF)
        weight = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], 0.0)
        many = np.ones(len(weight), dtype=np.int64)
        weight[len(weight) - len(other) :] = v.fallback * bytes_of
        many[len(weight) - len(other) :] = bytes_of
        end_local, end = local[start] + length, place[start] + length
        order = _order(end_local, end)
        piece, length, many, start, end, end_local, weight = (x[order] for x in (piece, length, many, place[start], end, end_local, weight))
        # Forward: log weight of all paths to a node, all chunks one position at a time.
        forward = np.zeros(len(points) + len(size))
        new = np.ones(len(end), dtype=bool)
        new[1:] = end[1:] != end[:-1]
        group = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        share = np.empty(len(end))
        cuts = np.searchsorted(end_local, np.arange(1, (size.max() if len(size) else 0) + 2))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            w = forward[start[a:b]] + weight[a:b]
            g0, g1 = rank[a], rank[b - 1] + 1
            begins = group[g0:g1] - a
            top = np.maximum.reduceat(w, begins)
            w = np.exp(w - top[rank[a:b] - g0])
            total = np.add.reduceat(w, begins)
            forward[end[group[g0:g1]]] = top + np.log(total)
            share[a:b] = w / total[rank[a:b] - g0]
        sums = np.cumsum(share)
        sums -= (sums[group] - share[group])[rank]
        last = np.concatenate([group[1:], [len(end)]]) - 1 if len(group) else group
        sums[last] = 1.0
        first_edge = np.zeros(len(forward), dtype=np.int64)
        last_edge = np.zeros(len(forward), dtype=np.int64)
        first_edge[end[group]], last_edge[end[group]] = group + self.edges, last + self.edges
        self._put(self.count, base=base + self.nodes, size=size)
        self._put(self.nodes, first=first_edge, last=last_edge)
        self._put(self.edges, piece=piece, back=length, sum=sums, many=many)
        self.count += len(size)
        self.nodes += len(forward)
        self.edges += len(end)

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Slots of the keys, or of the free places where they belong."""
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            wrong = (self.slot_chunk[at] >= 0) & ((self.slot_key[at] != keys[todo]) | (self.slot_check[at] != checks[todo]))
            todo = todo[wrong]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return slot

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Chunk numbers of data[start:end]; new chunks get their lattices."""
        values = BYTE_CODE[data]
        keys, checks = Rolling(values, self.letters)(start, end), Rolling(values, self.check)(start, end)
        slot = self._find(keys, checks)
        fresh = np.flatnonzero(self.slot_chunk[slot] < 0)
        if len(fresh):
            _, one = np.unique(keys[fresh], return_index=True)
            self._room(len(one))
            for k in range(0, len(one), 20_000):
                part = fresh[one[k : k + 20_000]]
                number = self.count + np.arange(len(part))
                self.add(data, start[part], end[part])
                self._insert(keys[part], checks[part], number)
            slot = self._find(keys, checks)
        return self.slot_chunk[slot].astype(np.int64)

    def _insert(self, keys, checks, numbers) -> None:
        todo = np.arange(len(keys))
        while len(todo):
            slot = self._find(keys[todo], checks[todo])
            _, one = np.unique(slot, return_index=True)
            at, which = slot[one], todo[one]
            self.slot_key[at], self.slot_check[at], self.slot_chunk[at] = keys[which], checks[which], numbers[which]
            todo = np.delete(todo, one)

    def sample(self, chunk: np.ndarray, seed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Backward draws, last piece first: per step (occurrence, edge). chunk, seed: per occurrence."""
        first, last, back, sums = (self.arrays[k] for k in ("first", "last", "back", "sum"))
        who = np.arange(len(chunk))
        here, floor = self.arrays["size"][chunk], self.arrays["base"][chunk]
        steps = []
        while len(who):
            node = floor + here
            edge = first[node]
            open_ = np.flatnonzero(edge < last[node])
            if len(open_):
                u = (mix(seed[who[open_]] + here[open_].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                while len(open_):
                    beyond = u >= sums[edge[open_]]
                    open_, u = open_[beyond], u[beyond]
                    edge[open_] += 1
            steps.append((who, edge))
            here = here - back[edge]
            more = here > 0
            who, here, floor = who[more], here[more], floor[more]
        return steps

    def encode(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a run of texts in one array, and where each text begins."""
        rows = len(offsets) - 1
        if self.count > self.MOST:
            self._empty()
        some = np.diff(offsets) > 0
        # One space before every text that is not empty, as the vocabulary expects.
        shift = np.cumsum(some)
        full = np.full(len(data) + shift[-1] if rows else 0, 0x20, dtype=np.uint8)
        where = offsets.copy()
        where[1:] += shift
        full[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
        if not len(full):
            return np.zeros(0, dtype=np.int32), np.zeros(rows + 1, dtype=np.int64)
        space, line = full == 0x20, full == 0x0A
        head = np.ones(len(full), dtype=bool)
        head[1:] = line[1:] | (space[1:] & ~space[:-1]) | (~space[1:] & line[:-1])
        head[where[:-1][some]] = True
        start = np.flatnonzero(head)
        end = np.concatenate([start[1:], [len(full)]])
        row = np.searchsorted(where, start, side="right") - 1
        ordinal = np.arange(len(start)) - np.searchsorted(start, where)[row]
        chunk = self.numbers(full, start, end)
        seed = mix(seeds[row] + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        steps = self.sample(chunk, seed)
        piece, many = self.arrays["piece"], self.arrays["many"]
        total = np.zeros(len(chunk), dtype=np.int64)
        for who, edge in steps:
            total[who] += many[edge]
        stop = np.cumsum(total)
        bounds = np.concatenate([[0], stop])[np.searchsorted(start, where)]
        out = np.zeros(stop[-1], dtype=np.int32)
        for who, edge in steps:
            stop[who] -= many[edge]
            ids = piece[edge]
            out[stop[who]] = ids
            for k in np.flatnonzero(ids < 0).tolist():
                raw = np.frombuffer(chr(-int(ids[k]) - 1).encode(), dtype=np.uint8)
                at = stop[who[k]]
                out[at : at + len(raw)] = self.vocabulary.byte_ids[raw]
        return out, bounds


def encode_texts(chunks: Chunks, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``Chunks.encode``, from strings."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return chunks.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, seeds)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, alpha: float = ALPHA, with_ids: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit numbers), lossless
    (decoding gives the text back; checked on every row) and, with ``with_ids``, pieces (array of ids).

    Null and empty texts have no pieces. Texts of any length are encoded whole. The row key is the id: rows with equal
    id and text (repeated rows) get equal pieces, all null ids share one key. An empty table gives no rows. Other
    columns are not read.
    """
    shared = share(docs.sparkSession, Vocabulary(model_file, alpha))

    def run(batches):
        v = unpacked(shared)
        chunks, raw = Chunks(v), v.raw
        for batch in batches:
            keys = batch.column(0)
            numbers = keys.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            seeds = np.where(keys.is_null().to_numpy(zero_copy_only=False), np.uint64(NO_ROW), mix(numbers + np.uint64(1)))
            for row, data, offsets in text_slices(batch.column(1), RUN):
                rows = len(offsets) - 1
                ids, where = chunks.encode(data, offsets, seeds[row : row + rows])
                listed, text, cuts, ends = ids.tolist(), data.tobytes(), offsets.tolist(), where.tolist()
                same, digest = [], []
                for i in range(rows):
                    a, b = ends[i], ends[i + 1]
                    same.append(b"".join([raw[k] for k in listed[a:b]])[1:] == text[cuts[i] : cuts[i + 1]])
                    digest.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                cols = [keys.slice(row, rows), pa.array(np.diff(where)), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_pieces", "pieces_sha256", "lossless"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(ids)))
                    names.append("pieces")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_pieces long, pieces_sha256 string, lossless boolean" + (", pieces array<int>" if with_ids else "")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model_file: str = MODEL) -> DataFrame:
    """(doc_id, text) from piece ids; null and empty lists give empty texts."""
    shared = share(encoded.sparkSession, Vocabulary(model_file))

    def run(batches):
        v = unpacked(shared)
        for batch in batches:
            texts = []
            for low in range(0, batch.num_rows, 256):
                texts += [v.decode(ids or []) for ids in batch.column(1).slice(low, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).alias("p")).mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), with_ids=False)
