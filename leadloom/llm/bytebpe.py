"""Byte-level BPE encoding and decoding with the tokenizers library (operator 12).

A rank file becomes a model of the library: every token of more than one byte is one merge, of the
two parts that the ranks themselves leave when they build the token from its bytes.  No other pair
can ever form the token, since nothing has been merged across its limits before, so the library's
merges give the ids that the ranks give; a match of the pattern that is a token is taken whole.

The pattern never matches past a place where white space follows something else, so a text is cut
there into *chunks* and each different chunk of a task is encoded once.  The ids' bytes give each token's
place, and counting first bytes turns places into characters.  Decoding gathers the
bytes of the ids; a character that several tokens hold counts as the last one's.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import named, nameless, small_batches
from .textblocks import BLOCK_BYTES, blocks, lists

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ADDED = ("token_ids", "starts", "ends", "n_tokens", "n_shared")
#: Chunks that a task remembers at most, and the bytes of the longest one it does.
KNOWN, KNOWN_BYTES = 1 << 18, 64
#: About how many bytes of chunks the library encodes as one text.
PIECE_BYTES = 1 << 12

_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The library writes bytes as characters: visible ones as themselves, the others from U+0100 on.
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: on each line a token in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the ranks join last when they build ``token`` from its bytes; None if they never do."""
    parts = [token[k : k + 1] for k in range(len(token))]
    pair = None
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, len(ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            return None
        pair = (parts[k], parts[k + 1])
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return pair


@lru_cache(maxsize=2)
def specification(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> str:
    """The library's own text of the tokenizer with the ranks of ``path``, some 3 MB for 50,000 tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack a byte")

    def chars(token: bytes) -> str:
        return "".join(BYTE_CHARS[b] for b in token)

    pairs = [last_merge(token, ranks) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
    merges = [(chars(a), chars(b)) for a, b in filter(None, pairs)]
    made = Tokenizer(models.BPE(vocab={chars(t): k for t, k in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


@lru_cache(maxsize=2)
def tokenizer(spec: str):
    """The tokenizer of a specification, made once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def cuts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The places in ``begin`` to ``end`` where ASCII white space follows a character that is surely none."""
    own = data[max(0, begin - 3) : end]
    skip = begin - max(0, begin - 3)
    space = (own == 0x20) | ((own >= 0x09) & (own <= 0x0D))
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    at = at[at >= skip]

    def back(n: int) -> np.ndarray:
        return np.where(at >= n, own[np.maximum(at - n, 0)], 0)

    one, two, three = back(1), back(2), back(3)
    # Other white space: 0x1C to 0x1F for some libraries, two characters after 0xC2, some after 0xE1 to 0xE3.
    sure = np.where(one < 0x80, one > 0x1F, np.where(two >= 0xC0, two != 0xC2, (three < 0xE1) | (three > 0xE3)))
    return at[sure] + max(0, begin - 3)


def slices(data: np.ndarray, bounds: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Limits of consecutive chunks, a slice of about ``limit`` bytes of a block at a time."""
    begin, n = 0, len(data)
    while begin < n:
        end, size = begin, limit
        while end == begin:  # a chunk longer than the limit makes the slice longer
            stop = min(n, begin + size)
            inner = cuts(data, begin, stop)
            places = np.sort(np.concatenate([inner, bounds[(bounds > begin) & (bounds < stop)]]), kind="stable")
            places = places[(places > begin) & (np.diff(places, prepend=-1) > 0)]
            end = n if stop == n else int(places[-1]) if len(places) else begin
            size *= 2
        yield np.concatenate([[begin], places[places < end], [end]])
        begin = end


@lru_cache(maxsize=2)
def token_sizes(spec: str) -> np.ndarray:
    """The number of bytes of each id: a token's characters stand for one byte each."""
    vocab = tokenizer(spec).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, k in vocab.items():
        out[k] = len(token)
    return out


class Chunks:
    """The ids of the chunks that a task has met, laid end to end."""

    def __init__(self, spec: str):
        self.encode_batch, self.sizes = tokenizer(spec).encode_batch_fast, token_sizes(spec)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.first, self.lost = array("i"), array("q", [0]), 0

    def add(self, new: pa.Array) -> None:
        """Encode chunks.  Those that could follow each other in a text are encoded as one, since no match crosses their limits."""
        bounds = np.frombuffer(new.buffers()[1], np.int32)[: len(new) + 1]
        data = np.frombuffer(new.buffers()[2], np.uint8)[: bounds[-1]]
        joint = np.zeros(len(data) + 1, bool)
        joint[cuts(data, 0, len(data))] = True
        inner = bounds[1:-1]
        split = ~joint[inner] | (inner // PIECE_BYTES > bounds[:-2] // PIECE_BYTES)
        limits, whole = [0, *inner[split].tolist(), len(data)], data.tobytes()
        made = self.encode_batch([whole[a:b].decode() for a, b in zip(limits, limits[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(m.ids, np.int32) for m in made])
        # Tokens hold all bytes in order, so the bytes before each tell which chunk it begins.
        ends = np.cumsum(self.sizes[ids])
        self.first.frombytes((len(self.ids) + np.searchsorted(ends, bounds[1:]) + 1).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())

    def find(self, found: pa.Array) -> np.ndarray:
        """The places of different chunks' ids; what is not known is encoded now."""
        texts = found.to_pylist()
        if len(self.first) + len(texts) > KNOWN or self.lost > 16 * KNOWN:
            self.clear()
        new = [k for k, text in enumerate(texts) if text not in self.place]
        if new:
            at = len(self.first) - 1
            self.add(found.take(pa.array(new)))
            self.place.update(zip((texts[k] for k in new), range(at, at + len(new))))
        out = np.fromiter(map(self.place.__getitem__, texts), np.int64, len(texts))
        for k in new:
            if len(texts[k]) > KNOWN_BYTES:  # seldom met again: its text is not kept
                del self.place[texts[k]]
                self.lost += len(texts[k])
        return out


def encode_block(data: np.ndarray, bounds: np.ndarray, chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first and end character of each token in its text, tokens of each text) of a block of texts."""
    ids, starts, ends, per = [], [], [], np.zeros(len(bounds) - 1, np.int64)
    last_text, chars = -1, 0
    for limits in slices(data, bounds):
        part = data[limits[0] : limits[-1]]
        offsets = (limits - limits[0]).astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(limits) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))]).dictionary_encode()
        place = chunks.find(found.dictionary)[found.indices.to_numpy()]
        first = np.frombuffer(chunks.first, np.int64).copy()
        n = first[place + 1] - first[place]
        take = np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.frombuffer(chunks.ids, np.int32)[take]
        over = np.cumsum(chunks.sizes[own])
        # Characters before each byte; those before a text in the slice are not its own, those of it in the slice before are.
        before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)], dtype=np.int32)
        text = np.searchsorted(bounds, limits[:-1], side="right") - 1
        shift = -before[np.maximum(bounds[text] - limits[0], 0)]
        shift[text == last_text] += chars
        shifts = np.repeat(shift, n)
        ids.append(own)
        starts.append(before[over - chunks.sizes[own] + 1] - 1 + shifts)
        ends.append(before[over] + shifts)
        np.add.at(per, text, n)
        chars = int(before[-1] + shift[-1])
        last_text = int(text[-1])
    none = np.zeros(0, np.int32)
    return np.concatenate([*ids, none]), np.concatenate([*starts, none]), np.concatenate([*ends, none]), per


def shared(starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> np.ndarray:
    """How many tokens of each text begin before the end of the one before, within a character of both."""
    at = np.flatnonzero(starts[1:] < ends[:-1]) + 1
    over = np.cumsum(per)
    text = np.searchsorted(over, at, side="right")
    return np.bincount(text[at > (over - per)[text]], minlength=len(per)).astype(np.int64)


def _encode(spec: str, kept: int):
    """Batches of ``kept`` columns, the text last, -> the columns and ``ADDED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(spec)
        for batch in batches:
            for block in blocks(batch.column(kept)):
                ids, starts, ends, per = encode_block(block.data, block.bounds, chunks)
                part = batch.slice(block.first, block.rows)
                columns = [*part.columns[:kept], lists(ids, per), lists(starts, per), lists(ends, per), pa.array(per), pa.array(shared(starts, ends, per))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` (text, ...) and token_ids, starts, ends (the characters that a token holds, whole or in part), n_tokens and n_shared.

    Every match of ``pattern`` is encoded by itself, without special tokens; no text is cut.  A null or
    empty text has no tokens; n_shared counts those that begin within a character of the one before.  Each row stands alone, so repeated rows give equal ids; columns of
    ``docs`` that have the added names are replaced, all others stay whatever their names are.  The
    rank file is read by the driver; the tokenizer made of it, a few MB, travels with the tasks.
    """
    small_batches(docs.sparkSession)
    kept, names = nameless(docs, ADDED)
    text = F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))
    fields = ", ".join(f"{c} {t}" for c, t in kept.dtypes)
    n = len(names)
    added = ", ".join(f"c{n + k} {t}" for k, t in enumerate(("array<int>", "array<int>", "array<int>", "long", "long")))
    made = kept.withColumn(f"c{n}", text).mapInArrow(_encode(specification(ranks, pattern), n), f"{fields}, {added}")
    return named(made, [*names, *ADDED])


def byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids laid end to end, and where each id's begin; ids that no token has hold none."""
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, k in ranks.items():
        by_id[k] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)


def gathered(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``ids`` end to end, and where each one's begin."""
    data, first = table
    n = first[ids + 1] - first[ids]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return data[np.repeat(first[ids] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def token_texts(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The characters that end in each token; one that tokens share is the last one's, bytes of no character are U+FFFD."""
    whole = data.tobytes()
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    out, done = [], 0
    for k in range(1, len(bounds)):
        # A character is over where the next one starts, or at the end.
        j = int(np.searchsorted(starts, bounds[k], side="right")) - 1
        begin = int(starts[j]) if j >= 0 else 0
        lead = whole[begin] if begin < bounds[k] else 0
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        end = int(bounds[k]) if begin + size <= bounds[k] or k == len(bounds) - 1 else begin
        end = max(done, end)
        out.append(whole[done:end].decode("utf-8", "replace"))
        done = end
    return out


def decode(encoded: DataFrame, ranks: str = RANKS, pieces: bool = False) -> DataFrame:
    """``encoded`` (token_ids, ...) and decoded (the bytes), text (as UTF-8), with ``pieces`` also texts, one for each token.

    Tokens may hold parts of characters: ``text`` joins them, with U+FFFD for bytes that make none, and
    in ``texts`` a character belongs to the token that ends it.  Null ids give nulls, ids outside the table raise;
    columns that have the added names are replaced.
    """
    small_batches(encoded.sparkSession)
    added = ("decoded", "text", "texts") if pieces else ("decoded", "text")
    kept, names = nameless(encoded, added)
    n, at = len(names), names.index("token_ids")
    table = byte_table(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            limits, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            decoded, texts, parts = [], [], []
            for k in range(batch.num_rows):
                own = values[limits[k] : limits[k + 1]].astype(np.int64)
                if len(own) and (own.min() < 0 or own.max() >= len(table[1]) - 1):
                    raise ValueError("an id is outside the table")
                data, bounds = gathered(table, own)
                raw = data.tobytes()
                decoded.append(None if null[k] else raw)
                texts.append(None if null[k] else raw.decode("utf-8", "replace"))
                if pieces:
                    parts.append(None if null[k] else token_texts(data, bounds))
            columns = [*batch.columns, pa.array(decoded, pa.binary()), pa.array(texts, pa.string())]
            if pieces:
                columns.append(pa.array(parts, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{j}" for j in range(len(columns))])

    fields = ", ".join(f"{c} {t}" for c, t in kept.dtypes)
    kinds = ("binary", "string", "array<string>")[: len(added)]
    made = kept.mapInArrow(run, ", ".join([fields, *(f"c{n + k} {t}" for k, t in enumerate(kinds))]))
    return named(made, [*names, *added])
