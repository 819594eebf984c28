"""SentencePiece encoding and decoding, whole Arrow batches at a time in numpy.

A text is one sequence of characters with "▁" for each space and one before the text. No piece of the
models handled here has "▁" after another character, so nothing crosses the places where "▁" follows
another character, and the stretches between them (a word with the spaces before it) are encoded on
their own: each distinct one once, all that have equal length as the rows of one matrix, advancing
together. Hashes of substrings come from prefix sums and probe the sorted hashes of the pieces.

* Unigram models: Viterbi. Column by column, the scores of all pieces that end there are added to
  the best scores where they begin, and the vectorised maximum stores the backpointer; equal scores
  go to the longer piece. Characters without a piece cost 10 more than the worst piece.
* BPE models: their scores are ranks of merges, and a segmentation of greatest total score isn't the
  one the model stands for. Here the rows advance by merges: of all neighbouring symbols whose union
  is a piece, the vectorised maximum picks the one of best score, leftmost if equal, until none is
  left. Units of over LONG characters use a heap instead of a row of a matrix, with the same merges.

Both give the ids of the sentencepiece library. Characters without a piece become byte pieces, or
the unknown id in models without them. Units are told apart by 64-bit hashes.

Defined results: null text gives null ids, 0 tokens and null for the round trip; empty text gives no ids;
one row for each input row; other columns are ignored, and a column of `keep` with the name of a result gives way to it. Decoding puts U+FFFD for bytes
that aren't UTF-8. A text with the character U+2581 itself decodes with a space there, as in the
library. Models with user-defined pieces or a normaliser other than identity are refused.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RESULTS = ("n_tokens", "ids", "exact")
SPACE, LONG, CACHED = 0x2581, 256, 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = s = 0
    while True:
        v |= (b[i] & 127) << s
        s += 7
        i += 1
        if b[i - 1] < 128:
            return v, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _char_values(codes: np.ndarray) -> np.ndarray:
    return A.mix(codes.astype(np.uint64) + np.uint64(1))


class Model:
    """A vocabulary, read from the bytes of a .model file."""

    def __init__(self, raw: bytes):
        self.pieces, self.types, scores, spec, norm = [], [], [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = spec.get(3, UNIGRAM)
        self.prefix, self.byte_fallback = bool(norm.get(3, 1)), bool(spec.get(35, 0))
        if USER in self.types or UNUSED in self.types or self.kind not in (UNIGRAM, BPE) or norm.get(4, 1) or norm.get(1, b"") != b"identity":
            raise ValueError("a unigram or BPE model with identity normalisation and no user-defined or unused pieces is needed")
        normal = [i for i, t in enumerate(self.types) if t == NORMAL]
        if any("▁" in p.lstrip("▁") for p in (self.pieces[i] for i in normal)):
            raise ValueError("a piece has a space after another character")
        self.longest = max(len(self.pieces[i]) for i in normal)
        text = "".join(self.pieces[i] for i in normal)
        ends = np.cumsum([len(self.pieces[i]) for i in normal])
        keys = A.span_hash(A.prefix_hash(_char_values(_codes(text))), np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        self.scores = np.array(scores, np.float64)
        self.worst = self.scores[normal].min() - 10
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, t in enumerate(self.types):
            if t == BYTE:
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        surface = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace("▁", " ").encode() for p, t in zip(self.pieces, self.types)]
        self.pool = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.array([len(s) for s in surface], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.known = np.zeros(0, np.uint64)  # units met before, sorted, where their ids lie, and the ids
        self.where, self.count, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.ids[i], -1)

    def merges(self, prefix: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """BPE: which of the n places of each unit begin a symbol in the end (a row for each unit)."""
        rows = len(start)
        begins = np.ones((rows, n), bool)
        if n == 1:
            return begins

        def score(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            found = self.probe(A.span_hash(prefix, lo, hi))
            return np.where(found >= 0, self.scores[found], -np.inf)

        s = np.full((rows, n), -np.inf)
        lo = start[:, None] + np.arange(n - 1)
        s[:, :-1] = score(lo.ravel(), lo.ravel() + 2).reshape(lo.shape)
        after = np.tile(np.arange(1, n + 1), (rows, 1))
        before = np.tile(np.arange(-1, n), (rows, 1))
        live = np.arange(rows)
        while len(live):
            i = s[live].argmax(1)
            going = s[live, i] > -np.inf
            live, i = live[going], i[going]
            if not len(live):
                break
            j = after[live, i]
            k = after[live, j]
            begins[live, j] = False
            s[live, j] = -np.inf
            after[live, i] = k
            before[live, k] = i
            base = start[live]
            right = k < n
            s[live, i] = -np.inf
            r, q, m = live[right], i[right], k[right]
            s[r, q] = score(base[right] + q, base[right] + after[r, m])
            left = i > 0
            r, q = live[left], i[left]
            p = before[r, q]
            s[r, p] = score(base[left] + p, base[left] + k[left])
        return begins

    def merge_long(self, prefix: np.ndarray, start: int, n: int) -> np.ndarray:
        """The same for one unit of any length, with a heap."""
        after, before = list(range(1, n + 1)), list(range(-1, n))
        lo = start + np.arange(n - 1)
        found = self.probe(A.span_hash(prefix, lo, lo + 2))
        heap = [(-self.scores[f], i, i + 2) for i, f in enumerate(found.tolist()) if f >= 0]
        heapq.heapify(heap)
        alive = np.ones(n, bool)

        def push(i: int, end: int) -> None:
            if end - i <= self.longest:
                f = int(self.probe(A.span_hash(prefix, np.array([start + i]), np.array([start + end])))[0])
                if f >= 0:
                    heapq.heappush(heap, (-self.scores[f], i, end))

        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = False
            after[i] = end
            if end < n:
                before[end] = i
                push(i, after[end])
            if i > 0:
                push(before[i], end)
        return alive[None, :]

    def viterbi(self, prefix: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """Unigram: which of the n places of each unit begin a piece of the best segmentation."""
        rows = len(start)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, n + 1), np.int64)
        for end in range(1, n + 1):
            length = np.arange(min(end, self.longest), 0, -1)
            lo = (start + end)[:, None] - length
            found = self.probe(A.span_hash(prefix, lo.ravel(), np.repeat(start + end, len(length)))).reshape(lo.shape)
            s = np.where(found >= 0, self.scores[found], -np.inf)
            s[:, -1] = np.where(found[:, -1] >= 0, s[:, -1], self.worst)
            s += best[:, end - length]
            pick = s.argmax(1)
            best[:, end] = s[np.arange(rows), pick]
            back[:, end] = end - length[pick]
        begins = np.zeros((rows, n), bool)
        at, live = np.full(rows, n), np.arange(rows)
        while len(live):
            at[live] = back[live, at[live]]
            begins[live, at[live]] = True
            live = live[at[live] > 0]
        return begins

    def units(self, codes: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the units, one after another, and how many each has."""
        owner, ids, counts = [], [], np.zeros(len(start), np.int64)
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n = int(size[part[0]])
            if self.kind == UNIGRAM:
                begins = self.viterbi(prefix, start[part], n)
            elif n > LONG:
                begins = np.concatenate([self.merge_long(prefix, s, n) for s in start[part].tolist()])
            else:
                begins = self.merges(prefix, start[part], n)
            row, col = np.nonzero(begins)
            end = np.append(col[1:], 0)
            end[np.append(row[1:] != row[:-1], True)] = n
            lo, hi = start[part][row] + col, start[part][row] + end
            found = self.probe(A.span_hash(prefix, lo, hi))
            missing = np.flatnonzero(found < 0)
            if len(missing) and self.byte_fallback:
                raw = [chr(c).encode("utf-8", "replace") for c in codes[lo[missing]].tolist()]
                n_ids = np.ones(len(found), np.int64)
                n_ids[missing] = [len(r) for r in raw]
                first = np.cumsum(n_ids) - n_ids
                wide = np.repeat(found, n_ids)
                wide[A.ragged(first[missing], n_ids[missing])] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
                found, row = wide, np.repeat(row, n_ids)
            elif len(missing):
                found[missing] = self.unknown
            ids.append(found.astype(np.int32))
            counts[part] = np.bincount(row, minlength=len(part))
            owner.append(part)
        # from the order of the groups back to the order of the units
        owner = np.concatenate(owner)
        flat, n = np.concatenate(ids), counts[owner]
        first = np.empty(len(start), np.int64)
        first[owner] = np.cumsum(n) - n
        return flat[A.ragged(first, counts)], counts

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each text begin."""
        raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
        size = np.diff(chars)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        extra = (size > 0) * int(self.prefix)
        begin = np.concatenate(([0], np.cumsum(size + extra)))
        codes = np.full(begin[-1], SPACE, np.uint32)
        codes[np.arange(len(raw)) + np.repeat(np.cumsum(extra), size)] = np.where(raw == 32, SPACE, raw)
        space = codes == SPACE
        new = np.append(True, space[1:] & ~space[:-1])
        new[begin[:-1][size > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(codes))
        prefix = A.prefix_hash(_char_values(codes))
        keys, first, which = np.unique(A.span_hash(prefix, start, end), return_index=True, return_inverse=True)
        seen = np.searchsorted(self.known, keys)
        hit = np.zeros(len(keys), bool)
        if len(self.known):
            hit = self.known[np.minimum(seen, len(self.known) - 1)] == keys
        fresh = np.flatnonzero(~hit)
        ids, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(fresh):
            ids, n = self.units(codes, prefix, start[first[fresh]], (end - start)[first[fresh]])
        where, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        where[hit], count[hit] = self.where[seen[hit]], self.count[seen[hit]]
        where[~hit], count[~hit] = len(self.store) + np.cumsum(n) - n, n
        store = np.concatenate((self.store, ids))
        per_unit = count[which]
        out = store[A.ragged(where[which], per_unit)]
        total = np.concatenate(([0], np.cumsum(per_unit)))
        if len(self.known) + len(fresh) > CACHED:  # begin again with this chunk's units
            self.known, self.count, self.store = keys, count, store[A.ragged(where, count)]
            self.where = np.cumsum(count) - count
        elif len(fresh):
            at = np.searchsorted(self.known, keys[fresh])
            self.known, self.where, self.count = np.insert(self.known, at, keys[fresh]), np.insert(self.where, at, where[fresh]), np.insert(self.count, at, n)
            self.store = store
        return out, total[np.searchsorted(start, begin)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The texts of all lists of ids. Ids outside the vocabulary are an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("no such id")
        size = self.size[ids]
        flat = self.pool[A.ragged(self.at[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[off]
        if self.prefix and len(flat):  # the space before each text
            lead = ends[:-1][ends[1:] > ends[:-1]]
            lead = lead[flat[lead] == 32]
            keep = np.ones(len(flat), bool)
            keep[lead] = False
            flat = flat[keep]
            ends = ends - np.searchsorted(lead, ends)
        raw = flat.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.large_string())
        return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))


_models: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    """One for each worker process, with the units that it has met."""
    key = hash(raw)
    if key not in _models:
        _models[key] = Model(raw)
    return _models[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read()
    Model(raw)  # an unsuitable file fails here, on the driver
    return raw


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The columns of `keep`, then n_tokens, ids and exact: whether the decoded ids are the text."""
    keep = tuple(c for c in keep if c not in RESULTS)
    raw = docs.sparkSession.sparkContext.broadcast(_read(model))  # the size of the model file
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *(f"`{c}`" for c in keep))
    names = [*keep, *RESULTS]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, text = _model(raw.value), b.column(0)
        data, off = A.utf8(text)
        for i, j in A.chunks(off):
            ids, first = m.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
            part = text.slice(i, j - i)
            missing = part.is_null()
            same = pa.compute.equal(m.decode(ids, first), part.cast(pa.large_string()))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=missing)
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), pa.array(np.diff(first)), lists, same], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return A.map_batches(rows, run, ", ".join([*kinds, "n_tokens long, ids array<int>, exact boolean"]))


def decode(rows: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The columns of `keep`, then text; null ids give null text."""
    keep = tuple(c for c in keep if c != "text")
    raw = rows.sparkSession.sparkContext.broadcast(_read(model))
    rows = rows.select(F.col(ids_col).cast("array<int>").alias("__ids"), *(f"`{c}`" for c in keep))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = b.column(0)
        n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        off = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        text = _model(raw.value).decode(lists.flatten().to_numpy(zero_copy_only=False), off)
        text = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), text)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], text.cast(pa.string())], [*keep, "text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return A.map_batches(rows, run, ", ".join([*kinds, "text string"]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE: dict[str, str] = {}
