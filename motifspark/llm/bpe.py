"""Byte-level BPE encoding and decoding on padded numpy matrices.

Each text is split by the tokenizer's pattern; every distinct piece of a batch
is encoded once. Pieces are bucketed by byte length into padded matrices; in
each round every row merges its leftmost pair of minimum rank, found through
an open-addressing hash table of token pairs, and is compacted by one column.
A piece of more than ``MATRIX_BYTES`` bytes is a matrix of its own, dealt over
rows of about the square root of its length: a round finds the leftmost row
with the minimum, merges that row's leftmost minimum-rank pair and compacts
that row alone, so it costs the square root of the piece and not all of it.

Defined results: a null text is empty, an empty text has no tokens (the
digests are those of the empty string), null ids stay null, repeated rows
give repeated rows, other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import ship

MATRIX_BYTES = 256
NONE = np.iinfo(np.int32).max
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class ByteBpe:
    """Ranks of a byte-level BPE, its pair table and its matrix encoder."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.split = regex.compile(pattern)
        self.token = {r: t for t, r in self.rank.items()}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self._fill(keys, np.array(merged, np.int32))
        size = max(self.token) + 1
        lengths = np.zeros(size + 1, np.int64)
        for r, t in self.token.items():
            lengths[r + 1] = len(t)
        self.starts = np.cumsum(lengths)
        self.flat = np.zeros(int(self.starts[-1]), np.uint8)
        for r, t in self.token.items():
            self.flat[self.starts[r] : self.starts[r + 1]] = np.frombuffer(t, np.uint8)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            slots = at[todo]
            free = self.keys[slots] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[todo[put]], values[todo[put]]
            todo = todo[~put]
            taken = self.keys[at[todo]] != keys[todo]
            at[todo[taken]] = (at[todo[taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE where there is none or where a side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        keys = (left[real].astype(np.uint64) << np.uint64(32)) | right[real].astype(np.uint64)
        found, at, todo = np.full(len(keys), NONE, np.int32), self._slot(keys), np.arange(len(keys))
        while len(todo):
            slots = at[todo]
            there = self.keys[slots]
            hit = there == keys[todo]
            found[todo[hit]] = self.values[slots[hit]]
            todo = todo[~hit & (there != _EMPTY)]
            at[todo] = (at[todo] + 1) & self.mask
        out[real] = found
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > MATRIX_BYTES:
                out[i] = self._encode_long(piece)
            else:
                width = 1 << max(1, (len(piece) - 1).bit_length())
                buckets.setdefault(width, []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(rows), step):
                self._encode_matrix([pieces[i] for i in rows[k : k + step]], rows[k : k + step], width, out)
        return out

    def _encode_matrix(self, pieces: list[bytes], places: list[int], width: int, out: list) -> None:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_id[raw], np.int32(-1))
        rank, place = self.pair_rank(ids[:, :-1], ids[:, 1:]), np.array(places)
        while len(place):
            at = rank.argmin(1)
            row = np.arange(len(place))
            best = rank[row, at]
            live = best != NONE
            for r in np.flatnonzero(~live):
                out[place[r]] = ids[r][ids[r] >= 0]
            if not live.all():
                ids, rank, place, at, best = ids[live], rank[live], place[live], at[live], best[live]
                row = np.arange(len(place))
            if not len(place):
                return
            width = ids.shape[1]
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids[row, at] = best
            ids = ids[keep].reshape(len(place), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(place), width - 2)
            if width == 2:
                for r in row:
                    out[place[r]] = ids[r]
                return
            for column in (at - 1, at):
                inside = (column >= 0) & (column < width - 2)
                r, c = row[inside], column[inside]
                rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])

    def _encode_long(self, piece: bytes) -> np.ndarray:
        width = 1 << ((len(piece) - 1).bit_length() + 1) // 2
        height = -(-len(piece) // width)
        ids = np.full(height * width, -1, np.int32)
        ids[: len(piece)] = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = np.append(self.pair_rank(ids[:-1], ids[1:]), NONE).astype(np.int32).reshape(height, width)
        ids = ids.reshape(height, width)
        # rank[r, c] is that of token c of row r and the next token, be it the first of the next row with tokens
        size = (ids >= 0).sum(1)
        low = rank.min(1)
        after, before = list(range(1, height + 1)), list(range(-1, height - 1))

        def rate(r: int, c: int) -> None:
            n = c + 1 < size[r]
            nxt = r if n else after[r]
            rank[r, c] = self._pair(int(ids[r, c]), int(ids[nxt, c + 1 if n else 0])) if nxt < height else NONE

        while True:
            r = int(low.argmin())
            if low[r] == NONE:
                return ids[ids >= 0]
            c = int(rank[r].argmin())
            ids[r, c] = rank[r, c]
            gone, g = (r, c + 1) if c + 1 < size[r] else (after[r], 0)
            n = int(size[gone])
            ids[gone, g : n - 1], rank[gone, g : n - 1] = ids[gone, g + 1 : n], rank[gone, g + 1 : n]
            ids[gone, n - 1], rank[gone, n - 1] = -1, NONE
            size[gone] = n - 1
            if n == 1:
                after[before[gone]] = after[gone]
                if after[gone] < height:
                    before[after[gone]] = before[gone]
            rate(r, c)
            last = (r, c - 1) if c else (before[r], int(size[before[r]]) - 1)
            if last[0] >= 0:
                rate(*last)
                low[last[0]] = rank[last[0]].min()
            low[r], low[gone] = rank[r].min(), rank[gone].min()

    def _pair(self, left: int, right: int) -> int:
        """pair_rank of one pair."""
        key = left << 32 | right
        at = (key * int(_MIX) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (there := int(self.keys[at])) != key:
            if there == int(_EMPTY):
                return int(NONE)
            at = (at + 1) & int(self.mask)
        return int(self.values[at])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, joined, in one gather."""
        if not len(ids):
            return b""
        sizes = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        source = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        return self.flat[source].tobytes()

    def encode(self, text: str) -> np.ndarray:
        pieces = [p.encode("utf-8", "surrogatepass") for p in self.split.findall(text)]
        return np.concatenate(self.encode_pieces(pieces)) if pieces else np.zeros(0, np.int32)


_built: dict[tuple[int, str], ByteBpe] = {}


def tokenizer(rank_file: bytes, pattern: str) -> ByteBpe:
    """One per process and rank file."""
    key = (hash(rank_file), pattern)
    if key not in _built:
        _built[key] = ByteBpe(rank_file, pattern)
    return _built[key]


class Cache:
    """Piece -> (its ids as decimal text, how many, the bytes they decode to); emptied when large."""

    def __init__(self, bpe: ByteBpe, most: int = 300_000):
        self.bpe, self.most, self.known = bpe, most, {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        ids = self.bpe.encode_pieces(raw)
        sizes = np.array([len(x) for x in ids], np.int64)
        if not len(sizes):
            return
        flat = np.concatenate(ids)
        decoded, ends = self.bpe.decode(flat), np.cumsum(sizes)
        cuts = np.concatenate([[0], np.cumsum(self.bpe.starts[flat + 1] - self.bpe.starts[flat])])[np.concatenate([[0], ends])]
        numbers = flat.tolist()
        for i, piece in enumerate(new):
            a, b = int(ends[i] - sizes[i]), int(ends[i])
            self.known[piece] = (",".join(map(str, numbers[a:b])), b - a, decoded[cuts[i] : cuts[i + 1]])


def _groups(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again; per row the number of tokens and both digests.

    The rank file (a fixed vocabulary of 50,256 entries, under 1 MB) is read
    where the query is planned and sent along with the tasks.
    """
    ranks = open(rank_path, "rb").read()
    ship(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(ranks, pattern)
        cache, split = Cache(bpe), bpe.split.findall
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, ids_sha, text_sha = [], [], []
            for a, b in _groups(texts):
                pieces = [split(t) for t in texts[a:b]]
                cache.learn(set().union(*pieces))
                known = cache.known
                for words in pieces:
                    found = [known[w] for w in words]
                    counts.append(sum([x[1] for x in found]))
                    ids_sha.append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id long, {DIGESTS}")


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's token ids: (id, ids array<int>). Null and empty texts give an empty array."""
    ranks = open(rank_path, "rb").read()
    ship(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(ranks, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Token ids back to bytes: (id, decoded binary). A null array gives empty bytes."""
    ranks = open(rank_path, "rb").read()
    ship(encoded.sparkSession)

    def run(batches):
        bpe = tokenizer(ranks, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    frame = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return frame.mapInArrow(run, "doc_id long, decoded binary")
