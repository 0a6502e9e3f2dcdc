"""SentencePiece encoding and decoding of merge-type vocabularies.

The encoder is written here: the symbols of a text stand in a row, an agenda holds the adjacent
pairs that make a piece, and the pair of the best score (the leftmost of equals) is merged until
none is left. Characters without a piece become bytes. Texts are cut where no piece can reach
across (before blanks and around line ends), and the agendas of many short segments advance
together, as rows of a matrix; long segments take a heap. Segments come back from a bounded cache.
In each Arrow batch, all segments that are new to the cache are encoded by the sentencepiece
library too, and any difference raises an error.

Defined cases: a null or empty text has the begin and end ids alone. Repeated rows are encoded
each. Other columns are kept; result columns that clash with them replace them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MATRIX_SYMBOLS = 32
# About what the cache may hold, and what texts are worked on together (or one longer text).
CACHE_BYTES = 64 << 20
SLICE_BYTES = 2 << 20
BLANK = "▁"


class PairTable:
    """Adjacent symbols to the piece they make: open addressing over a fixed array."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(left << 32) | right for left, right in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int32)
        self.bits = max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            self.made[slot[free]] = made[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces made, -1 where a pair makes none. Negative symbols make none."""
        out = np.full(left.shape, -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo].astype(np.int64) << 32) | right.ravel()[todo].astype(np.int64)
        slot = self._slot(keys)
        flat = out.ravel()
        while len(todo):
            seen = self.keys[slot]
            hit = seen == keys
            flat[todo[hit]] = self.made[slot[hit]]
            more = ~hit & (seen != -1)
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


class PieceEncoder:
    """A vocabulary of the merge type, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(self.size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): i for i in range(self.size) if i not in special}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.bytes):
            self.bytes = None
        # Characters of pieces that are no piece themselves take part in merges under ids of their own.
        alone = sorted({c for piece in pieces for c in piece} - set(pieces))
        symbols = pieces | {c: self.size + k for k, c in enumerate(alone)}
        self.own = np.array([-ord(c) - 2 for c in alone], np.int64)
        self.of_char = -np.arange(0x110000, dtype=np.int32) - 2
        for text, i in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        self.table = PairTable({
            (symbols[p[:k]], symbols[p[k:]]): i for p, i in pieces.items() for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols})
        scores = {i: sp.get_score(i) for i in pieces.values()}
        ranks = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # Last entry: no pair.
        self.rank = np.full(self.size + 1, len(ranks), np.int32)
        for i, s in scores.items():
            self.rank[i] = ranks[s]
        self.none = len(ranks)
        crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) or "\n" in p and len(p) > 1 for p in pieces)
        self.cut = re.compile("(?s).+" if crosses else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.cuts_lines = not crosses
        self.after_line = sp.encode("\n") if not crosses else []
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def learn(self, segments: set[str]) -> None:
        """Encode the segments that are not in the cache, and check them with the library."""
        if self.held > CACHE_BYTES // 2:
            # The older half is forgotten; what is asked for again moves to the newer one.
            self.older, self.cache, self.held = self.cache, {}, 0
        asked = segments - self.cache.keys()
        again = asked & self.older.keys()
        new = list(asked - again)
        # A text, some ids as bytes and a place in the table.
        self.held += sum(map(len, asked)) * 3 + 220 * len(asked)
        self.cache.update((s, self.older[s]) for s in again)
        if not new:
            return
        coded = self.encode_segments(new)
        self.check(new, coded)
        flat = np.fromiter(chain.from_iterable(coded), "<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, coded))]
        self.cache.update((s, flat[a:b]) for s, a, b in zip(new, [0, *ends], ends))

    def check(self, segments: list[str], coded: list[list[int]]) -> None:
        """The library adds a blank in front of a text; a segment without one is shown to it
        behind a line end, at which texts are cut anyway."""
        heads = [s[0] == BLANK for s in segments]
        theirs = self.library.encode(
            [s[1:].replace(BLANK, " ") if h else "\n" + s for s, h in zip(segments, heads)], num_threads=1)
        for segment, head, a, b in zip(segments, heads, coded, theirs):
            b = b if head else b[len(self.after_line):]
            if head and segment == BLANK:
                continue  # the library gives an empty text no blank
            if a != b:
                raise ValueError(f"encoding differs from the library on {segment[:80]!r}: {a[:20]} / {b[:20]}")

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        out: list = [None] * len(segments)
        lengths = np.array([len(s) for s in segments])
        low = 0
        for high in (4, 8, 12, 16, 24, MATRIX_SYMBOLS):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(rows), 50_000):
                part = rows[k:k + 50_000]
                for i, ids in zip(part.tolist(), self._matrix([segments[i] for i in part], lengths[part], high)):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(lengths > MATRIX_SYMBOLS).tolist():
            out[i] = self._heap(segments[i])
        return out

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _matrix(self, segments: list[str], lengths: np.ndarray, width: int) -> list[list[int]]:
        n = len(segments)
        symbols = np.full((n, width + 1), -1, np.int32)
        places = np.arange(width)
        symbols[:, :width][places < lengths[:, None]] = self._symbols("".join(segments))
        made = self.table.find(symbols[:, :-1], symbols[:, 1:])
        order = np.arange(n)
        done = symbols.copy()
        while len(order):
            ranks = self.rank[made]
            at = ranks.argmin(1)
            rows = np.arange(len(order))
            live = ranks[rows, at] < self.none
            done[order[~live]] = symbols[~live]
            symbols, made, order, at = symbols[live], made[live], order[live], at[live]
            if not len(order):
                break
            rows = np.arange(len(order))
            symbols[rows, at] = made[rows, at]
            behind = np.arange(width + 1) + (np.arange(width + 1) > at[:, None])
            symbols = np.take_along_axis(symbols, np.minimum(behind, width), 1)
            symbols[:, width] = -1
            behind = places + (places > at[:, None])
            made = np.take_along_axis(made, np.minimum(behind, width - 1), 1)
            made[:, width - 1] = -1
            made[rows, at] = self.table.find(symbols[rows, at], symbols[rows, at + 1])
            left = np.maximum(at - 1, 0)
            made[rows, left] = self.table.find(symbols[rows, left], symbols[rows, left + 1])
        keep = done != -1
        flat, ends = done[keep], np.cumsum(keep.sum(1))
        if ((flat < 0) | (flat >= self.size)).any():
            return [self._finished(row) for row in np.split(flat, ends[:-1])]
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _finished(self, symbols: np.ndarray) -> list[int]:
        """Symbols to ids: what is no piece becomes the bytes of its character, or the unknown id."""
        out: list[int] = []
        for s in symbols.tolist():
            if s >= self.size:
                s = int(self.own[s - self.size])
            if s >= 0:
                out.append(s)
            elif self.bytes is None:
                out.append(self.unk)
            else:
                out += [self.bytes[b] for b in chr(-s - 2).encode("utf-8", "replace")]
        return out

    def _heap(self, segment: str) -> list[int]:
        symbols = self._symbols(segment)
        n = len(symbols)
        first = self.table.find(symbols[:-1], symbols[1:])
        at, right, left = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(int(self.rank[m]), k, int(m), k + 1) for k, m in enumerate(first.tolist()) if m >= 0]
        heapq.heapify(agenda)
        valid = {k: (int(m), k + 1) for k, m in enumerate(first.tolist()) if m >= 0}

        def offer(a: int, b: int) -> None:
            m = int(self.table.find(np.array([at[a]]), np.array([at[b]]))[0])
            if m >= 0:
                valid[a] = (m, b)
                heapq.heappush(agenda, (int(self.rank[m]), a, m, b))
            else:
                valid.pop(a, None)

        while agenda:
            _, a, m, b = heapq.heappop(agenda)
            if valid.get(a) != (m, b):
                continue
            at[a], right[a] = m, right[b]
            valid.pop(a), valid.pop(b, None)
            at[b] = None
            if right[a] < n:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return self._finished(np.array([s for s in at if s is not None], np.int64))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts, with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        self.learn(set().union(*cut))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        get = self.cache.__getitem__
        return [b"".join((begin, *map(get, parts), end)) for parts in cut]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together."""
    a, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n + 64
        if size >= SLICE_BYTES:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder, and one cache, for each worker process and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids",
                     decoded: str = "decoded", keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of integers) and ``decoded`` (the library's decode of the ids),
    ``n_tokens``, and the digests ``ids_sha256`` and ``decoded_sha256``."""
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()),
             ("decoded_sha256", T.StringType(), pa.string())]
    if keep_ids:
        added.append((ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    if keep_decoded:
        added.append((decoded, T.StringType(), pa.string()))
    names = {name for name, _, _ in added}
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*[docs[c] for c in kept], docs[text].alias("_text")) if text not in kept else docs.select(*kept)
    read = text if text in kept else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for a, b in slices(whole.column(read)):
                batch = whole.slice(a, b - a)
                coded = enc.encode([t or "" for t in batch.column(read).to_pylist()])
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                values = {"n_tokens": pa.array(sizes), "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded], "decoded_sha256": []}
                back: list[str] = []
                for c in coded:
                    # One text's ids at a time become Python numbers.
                    text_back = enc.library.decode(np.frombuffer(c, "<u4").tolist())
                    values["decoded_sha256"].append(hashlib.sha256(text_back.encode()).hexdigest())
                    if keep_decoded:
                        back.append(text_back)
                if keep_ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                    values[ids] = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), "<i4")))
                if keep_decoded:
                    values[decoded] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), *(v if isinstance(v := values[n], pa.Array) else pa.array(v, t) for n, _, t in added)],
                    names=[*kept, *(n for n, _, _ in added)])

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t, _ in added)])
    return source.mapInArrow(run, schema)
