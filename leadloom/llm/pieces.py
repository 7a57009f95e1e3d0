"""SentencePiece encoding with seeded merge-dropout, and decoding (operator 6).

A piece model with byte fallback joins symbols by the score of what they form.  Here each candidate
merge (left part, right part) of an occurrence of a chunk is kept or skipped by a hash of its span,
keyed by seed, document, the chunk and its place in the document.  Pieces hold blanks only at their
start, so a text falls into chunks (blanks, then other characters) that merge on their own; equal
chunks of a block whose occurrences skip no candidate share one merge, all merges of a round are one
numpy step.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import named, nameless, small_batches
from .textblocks import Block, blocks, mix, mix_int

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
BLANK, NEVER, PAD = "▁", np.int32(2**31 - 1), -1
_U = np.uint64


@dataclass
class Pieces:
    """A piece model as arrays.  Symbols are piece ids; a character that has none is -2 - its code point."""

    pairs: np.ndarray  # left id << 32 | right id, sorted
    merged: np.ndarray  # the id that the pair forms
    rank: np.ndarray  # by id: 0 is merged first
    characters: tuple[np.ndarray, np.ndarray]  # code points, ids
    byte_ids: np.ndarray
    spelled: list[bytes]  # by id; blanks are spaces
    _made: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, model: bytes) -> Pieces:
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        byte_ids = np.zeros(256, dtype=np.int32)
        normal, spelled = {}, []
        for i, name in enumerate(names):
            if p.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                spelled.append(bytes([int(name[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                spelled.append(b"")
            else:
                normal[name] = i
                spelled.append(name.replace(BLANK, " ").encode())
        found = {}
        for name, i in normal.items():
            for k in range(1, len(name)):
                left, right = normal.get(name[:k]), normal.get(name[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = i
        pairs = np.array(sorted(found), dtype=np.int64)
        scores = np.array([p.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        single = {ord(name): i for name, i in normal.items() if len(name) == 1 and name != BLANK}
        single[ord(" ")] = normal[BLANK]
        codes = np.array(sorted(single), dtype=np.int64)
        return cls(pairs, np.array([found[k] for k in pairs.tolist()], np.int32), rank, (codes, np.array([single[c] for c in codes.tolist()], np.int32)), byte_ids, spelled)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def _table(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        def make():
            table = -2 - np.arange(0x110000, dtype=np.int32)
            table[:128] = self.byte_ids[:128]
            table[self.characters[0]] = self.characters[1]
            return table

        return self._table("symbols", make)[codes]

    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        def make():
            size = 1 << (4 * len(self.pairs)).bit_length()
            keys, ids = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
            rest, at = np.arange(len(self.pairs)), (mix(self.pairs.view(_U)) & _U(size - 1)).astype(np.int64)
            while len(rest):
                free = keys[at] == -1
                keys[at[free]] = self.pairs[rest[free]]
                placed = keys[at] == self.pairs[rest]
                ids[at[placed]] = self.merged[rest[placed]]
                rest, at = rest[~placed], (at[~placed] + 1) & (size - 1)
            return keys, ids

        return self._table("slots", make)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two symbols form, or -1."""
        keys, ids = self._slots()
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = (mix(wanted.view(_U)) & _U(len(keys) - 1)).astype(np.int64)
        seen = keys[at]
        out = np.where((seen == wanted) & (left >= 0) & (right >= 0), ids[at], -1)
        open_ = np.flatnonzero((seen != wanted) & (seen != -1) & (left >= 0) & (right >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(keys) - 1)
            seen = keys[at[open_]]
            hit = seen == wanted[open_]
            out[open_[hit]] = ids[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


def _kept(key, start, middle, end, dropout: float):
    """Whether the keyed hash keeps the merge of [start, middle) with [middle, end)."""
    if dropout <= 0:
        return np.ones(np.shape(start), dtype=bool)
    at = start.astype(_U) * _U(0x100000001B3) + middle.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + end.astype(_U) * _U(0x165667B19E3779F9)
    return (mix(key + at) >> _U(11)).astype(np.float64) * 2.0**-53 >= dropout


def merge_rows(vocab: Pieces, symbols: np.ndarray, size: np.ndarray, key: np.ndarray, dropout: float, seen: list | None = None) -> np.ndarray:
    """Merge each row of ``symbols`` (padded by PAD on the right); what a merge took in becomes PAD.

    ``seen`` takes the candidates: (row, start, middle, end).
    """
    n, width = symbols.shape
    s = np.full((n, width + 1), PAD, np.int32)
    s[:, :width] = symbols
    after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
    before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
    rank, forms = np.full((n, width + 1), NEVER), np.full((n, width + 1), PAD, np.int32)

    def weigh(rows, at):
        mid = after[rows, at]
        end = after[rows, np.minimum(mid, width)]
        new = vocab.join(s[rows, at], s[rows, np.minimum(mid, width)])
        ok = (new >= 0) & (mid < size[rows])
        if seen is not None:
            seen.append((rows[ok], at[ok], mid[ok], end[ok]))
        ok &= _kept(key[rows], at, mid, end, dropout)
        rank[rows, at] = np.where(ok, vocab.rank[new], NEVER)
        forms[rows, at] = new

    rows, at = np.nonzero(np.arange(width)[None, :] < size[:, None] - 1)
    weigh(rows, at.astype(np.int32))
    live = np.arange(n)
    while len(live):
        own = rank[live]
        best = own.argmin(axis=1).astype(np.int32)
        go = own[np.arange(len(live)), best] != NEVER
        live, best = live[go], best[go]
        if not len(live):
            break
        right = after[live, best]
        beyond = after[live, right]
        s[live, best] = forms[live, best]
        s[live, right] = PAD
        rank[live, right] = NEVER
        after[live, best] = beyond
        inside = beyond <= width
        before[live[inside], beyond[inside]] = best[inside]
        weigh(live, best)
        left = before[live, best]
        has = left >= 0
        weigh(live[has], left[has])
    return s[:, :width]


def merge_one(vocab: Pieces, symbols: list[int], key: int, dropout: float) -> list[int]:
    """The same for one row of any length, by an agenda of candidate merges."""
    n = len(symbols)
    s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(at: np.ndarray) -> None:
        mid = np.array([after[i] for i in at], dtype=np.int64)
        at, mid = at[mid < n], mid[mid < n]
        if not len(at):
            return
        end = np.array([after[m] for m in mid], dtype=np.int64)
        new = vocab.join(np.array([s[i] for i in at], np.int32), np.array([s[m] for m in mid], np.int32))
        ok = (new >= 0) & _kept(_U(key), at, mid, end, dropout)
        for i, m, e, k in zip(at[ok].tolist(), mid[ok].tolist(), end[ok].tolist(), new[ok].tolist()):
            heapq.heappush(agenda, (int(vocab.rank[k]), i, m, e, k))

    offer(np.arange(n))
    while agenda:
        _, i, m, e, k = heapq.heappop(agenda)
        if s[i] == PAD or after[i] != m or m >= n or after[m] != e:
            continue
        s[i], s[m], after[i] = k, PAD, e
        if e < n:
            before[e] = i
        offer(np.array([i] + ([before[i]] if before[i] >= 0 else []), dtype=np.int64))
    return [x for x in s if x != PAD]


#: Chunks of at most so many characters are merged together; longer ones one by one.
WIDTHS = (3, 6, 9, 12, 16, 24, 40)


def _hash_runs(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .textblocks import _powers

    power, back = _powers(1 << max(12, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(mix(codes.astype(_U) + _U(1)) * power[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(_U))


def merge_chunks(vocab: Pieces, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, dropout: float, seen: list | None = None):
    """Merge each chunk -> (ids, where each chunk's begin, how many they are).

    With ``seen`` the chunks that are merged together skip nothing, and it takes their candidates.
    """
    pool: list[np.ndarray] = []
    count = np.zeros(len(start), np.int64)
    order: list[np.ndarray] = []
    low = 0
    for width in WIDTHS:
        own = np.flatnonzero((size > low) & (size <= width))
        low = width
        if not len(own):
            continue
        at = start[own][:, None] + np.arange(width)[None, :]
        rows = np.where(np.arange(width)[None, :] < size[own][:, None], symbols[np.minimum(at, len(symbols) - 1)], PAD)
        met = None if seen is None else []
        done = merge_rows(vocab, rows, size[own], key[own], dropout if seen is None else 0.0, met)
        if met is not None:
            seen += [(own[m[0]], *m[1:]) for m in met]
        left = done != PAD
        pool.append(done[left])
        count[own] = left.sum(axis=1)
        order.append(own)
    for c in np.flatnonzero(size > low):
        done = merge_one(vocab, symbols[start[c] : start[c] + size[c]].tolist(), int(key[c]), dropout)
        pool.append(np.array(done, np.int32))
        count[c] = len(done)
        order.append(np.array([c]))
    if not pool:
        return np.zeros(0, np.int32), count, count
    order = np.concatenate(order)
    begin = np.zeros(len(start), np.int64)
    begin[order] = np.cumsum(count[order]) - count[order]
    return np.concatenate(pool), begin, count


def _skipping(seen: list, back: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
    """The occurrences (chunk number ``back``, key) that skip one of their chunk's candidates ``seen``."""
    if not seen:
        return np.zeros(0, np.int64)
    chunk, at, mid, end = (np.concatenate([m[k] for m in seen]) for k in range(4))
    order = np.argsort(chunk, kind="stable")
    at, mid, end = at[order], mid[order], end[order]
    number = np.bincount(chunk, minlength=int(back.max()) + 1)
    times = number[back]
    stop = np.cumsum(times)
    which = np.repeat((np.cumsum(number) - number)[back] - (stop - times), times) + np.arange(stop[-1])
    kept = _kept(np.repeat(key, times), at[which], mid[which], end[which], dropout)
    skips = np.zeros(len(back), dtype=bool)
    skips[np.repeat(np.arange(len(back)), times)[~kept]] = True
    return np.flatnonzero(skips)


def encode_block(vocab: Pieces, block: Block, names: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each text).  ``names``: a 64-bit key of each text's document."""
    raw = block.data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())]
    codes = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    length = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(block.rows, np.int64)
    bounds = np.concatenate([[0], np.cumsum(length)])
    blank = codes == 32
    begins = np.empty(len(codes), dtype=bool)
    begins[0] = True
    begins[1:] = blank[1:] & ~blank[:-1]
    begins[bounds[:-1][length > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(codes))
    first = np.searchsorted(start, bounds)
    chunks = np.diff(first)
    doc = np.repeat(np.arange(block.rows), chunks)
    size, symbols = end - start, vocab.symbols(codes)
    key = equal = _hash_runs(codes, start, end)
    if dropout > 0:
        nth = np.arange(len(start)) - first[doc]
        key = mix(equal + mix(mix(names[doc] + _U(mix_int(seed))) + nth.astype(_U)))
        equal = np.where(size > WIDTHS[-1], key, equal)  # long chunks nearly always skip something
    _, one, back = np.unique(equal, return_index=True, return_inverse=True)
    seen = [] if dropout > 0 else None
    flat, begin, count = merge_chunks(vocab, symbols, start[one], size[one], key[one], dropout, seen)
    begin, times = begin[back], count[back]
    if seen:
        own = _skipping(seen, back, key, dropout)
        more, at, times[own] = merge_chunks(vocab, symbols, start[own], size[own], key[own], dropout)
        begin[own] = len(flat) + at
        flat = np.concatenate([flat, more])
    stop = np.cumsum(times)
    ids = flat[np.repeat(begin - (stop - times), times) + np.arange(stop[-1])]
    per_doc = np.diff(np.concatenate([[0], stop])[first])
    if (ids < PAD).any():
        code = np.where(ids < PAD, -2 - ids.astype(np.int64), 0)
        wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ends = np.cumsum(wide)
        owner = np.repeat(np.arange(block.rows), per_doc)
        per_doc = np.bincount(owner, wide, block.rows).astype(np.int64)
        kth = np.arange(ends[-1]) - np.repeat(ends - wide, wide)
        code, total, ids = np.repeat(code, wide), np.repeat(wide, wide), np.repeat(ids, wide)
        part = code >> (6 * (total - 1 - kth)) & 0x3F | 0x80
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total] | code >> (6 * (total - 1))
        ids = np.where(ids < PAD, vocab.byte_ids[np.where(kth == 0, head, part) & 0xFF], ids).astype(np.int32)
    return ids, per_doc


def decode_ids(vocab: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds of each text): the spelled pieces without the blank that encoding put first."""
    def make():
        size = np.array([len(x) for x in vocab.spelled], np.int64)
        return np.frombuffer(b"".join(vocab.spelled), np.uint8), size, np.cumsum(size) - size

    letters, size, begin = vocab._table("letters", make)
    size = size[ids]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    data = letters[np.repeat(begin[ids] - (stop - size), size) + np.arange(total)]
    bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(total, dtype=bool)
    some = bounds[1:] > bounds[:-1]
    keep[bounds[:-1][some]] = data[bounds[:-1][some]] != 32
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _encode(vocab: Pieces, dropout: float, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text"))
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            null = text.is_null().to_numpy(zero_copy_only=False)
            for block in blocks(text, limit=1 << 20):
                own = slice(block.first, block.first + block.rows)
                ids, counts = encode_block(vocab, block, keys[own].view(_U), dropout, seed)
                data, bounds = decode_ids(vocab, ids, counts)
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                whole = np.array_equal(bounds, block.bounds) and np.array_equal(data, block.data)
                same = [True] * block.rows
                if not whole:
                    source = block.data.tobytes()
                    same = [source[block.bounds[i] : block.bounds[i + 1]] == raw[bounds[i] : bounds[i + 1]] for i in range(block.rows)]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                mask = pa.array(null[own])
                made = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=mask),
                    pa.array(counts.astype(np.int64), mask=null[own]),
                    pa.array(digests, pa.string(), mask=null[own]),
                    pa.array(same, pa.bool_(), mask=null[own]),
                ]
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *made], names=[*(f"c{k}" for k in range(len(names))), *ADDED])

    return run


ADDED = ("piece_ids", "n_pieces", "decoded_sha256", "lossless")


def read_model(path: str) -> Pieces:
    """The model file, read once by the driver; its arrays (under 5 MB) travel with the tasks."""
    with open(path, "rb") as f:
        return Pieces.read(f.read())


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``docs`` (doc_id, text, ...) and piece_ids, n_pieces, decoded_sha256 (of the decoded ids), lossless.

    ``key``: the columns whose values, with the seed, key a row's dropout.  The same row gives the same
    ids on every run.  A null text gives nulls, an empty one no pieces; nulls in a key count as one
    value; columns of ``docs`` that have the added names are replaced, all others stay whatever their
    names are.  A literal U+2581 and characters outside the model become byte pieces.
    """
    small_batches(docs.sparkSession)
    plain, names = nameless(docs, ADDED)
    fields = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    rows = plain.withColumn("key", F.xxhash64(*(f"c{names.index(k)}" for k in key)))
    made = rows.mapInArrow(
        _encode(read_model(model), dropout, seed, names), f"{fields}, piece_ids array<int>, n_pieces long, decoded_sha256 string, lossless boolean"
    )
    return named(made, [*names, *ADDED])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, piece_ids) -> (doc_id, text); null ids give a null text."""
    small_batches(encoded.sparkSession)
    vocab = read_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("piece_ids")
            counts = np.diff(ids.offsets.to_numpy())
            values = ids.values.to_numpy(zero_copy_only=False)[ids.offsets[0].as_py() : ids.offsets[-1].as_py()]
            data, bounds = decode_ids(vocab, values, counts)
            raw, null = data.tobytes(), ids.is_null().to_numpy(zero_copy_only=False)
            texts = [None if n else raw[a:b].decode(errors="replace") for a, b, n in zip(bounds[:-1], bounds[1:], null)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
