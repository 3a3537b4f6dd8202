"""N-gram Jaccard join on parity sketches, and the components of its links.

A document is its set of distinct word n-grams (64-bit hashes). Its sketch for
a size band is m chunks of 2**32 parity bits; every n-gram flips one bit of one
chunk. A differing n-gram changes one bit at most, so the Hamming distance of
two sketches, and the number of their differing chunks, bound the symmetric
difference from below. Sets as similar as asked differ in at most D n-grams, D
known from the band; with m > D chunks some chunk is equal in both
(pigeonhole), and m leaves room for chunks that no n-gram fell into: where a
sketch has so many empty chunks that they could be the only equal ones, the
empty chunks are keys too. A chunk is kept as the XOR of the 64-bit codes of
its set bits, which is the join key. A set is keyed in the band of its own size
and, where it can be the larger of a pair, in the bands below. No pair as
similar as asked is missed.

Equal sets are one class, which its least document stands for; a task deals the
keys of one of them. Documents that share a key are connected by a star around
the least of them (first within a task, then over all tasks, so a key of very
many sends one row a task), never by all pairs, and stars are then mapped to
classes. The components of these stars are clusters: every
link lies within one. A cluster is cut into blocks of bounded rows and hashes;
each pair of blocks is one group, in which sketches of 1024 bits or more rule
pairs out and the sets decide the others. A group emits the number of links of
each member and a spanning forest, not its pairs.

Clusters of all that share a key, over however many others, grow together with
the table, and are compared in the square of their size. Where only the
components are asked for there are none. The keys are then the rarest n-grams of
a set: in any one order of all n-grams, sets as similar as asked share one of
their first size - ceil(similarity * size) + 1. The order is by how often an
n-gram's cell of a table of ``CELLS`` is met in all texts, then by hash; a cell
counts all its n-grams, so the order is not exactly by frequency, which changes
how many documents share a key and no result. Only one document of equal sets is
dealt. Of a key of up to ``PAIRED`` documents all pairs are candidates, of
others the pairs with the least document; sizes, sketches and then the sets
decide. A key of more documents that these links leave in several parts is a
group, whose members are compared with the nearest sketches of other parts; what
these leave open is compared in full.

Defined results: words are split at ASCII white space after lower-casing A-Z;
with fewer words than n the whole sequence is the one n-gram; without words
the set is empty and linked with nothing. Rows with a null id have a size and
no component. Repeated rows are one node and get equal results; rows that
share an id but not the text are one node with several sets. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, release, ship
from .packing import batches_of, get48, get_ids, groups, mix, prefix_hash, put48, put_ids, slice_hash

PAIRED = 8  # documents of a key of which all pairs are candidates
GROWTH, BITS, BROADCAST_IDS, PART_ROWS = 1.25, 1024, 500_000, 50_000
BLOCK_ROWS, BLOCK_HASHES, SKETCH_ROWS, STRIP, ROUNDS = 1024, 1_000_000, 6144, 512, 2
#: Cells of the table of n-gram counts, and of one of its slices, in which tasks send it.
CELLS, SLICE = 1 << 18, 1 << 12
#: Join keys that a task sorts at once, and that a bucket holds on average.
_HASH_BYTES, _KEYS, _BUCKET_KEYS = 200_000, 250_000, 400_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _parted(df: DataFrame, rows: int) -> DataFrame:
    """In partitions by its number of rows: a small table read back in many parts costs each later exchange many small files."""
    return df.coalesce(max(8, -(-rows // PART_ROWS)))


def held(df: DataFrame) -> DataFrame:
    out = cut(df)
    return _parted(out, out.count())


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams."""
    data = np.frombuffer(b" ".join(t.translate(_FOLD) for t in texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = data != 32
    begin = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    end = np.flatnonzero(~solid & np.append(False, solid[:-1]))
    word = slice_hash(prefix_hash(data), begin, end)
    upto = np.searchsorted(begin, ends)
    out, rolled = [], word[: max(0, len(word) - n + 1)].copy()
    for i in range(1, n):
        rolled = mix(rolled * _STEP + word[i : i + len(rolled)])
    start = 0
    for stop in upto.tolist():
        if stop - start >= n:
            out.append(np.unique(rolled[start : stop - n + 1]))
        elif stop > start:
            whole = word[start : start + 1]
            for i in range(start + 1, stop):
                whole = mix(whole * _STEP + word[i : i + 1])
            out.append(mix(whole + np.uint64(stop - start)))
        else:
            out.append(word[:0])
        start = stop
    return out


def sets_of(texts: pa.Array, n: int):
    """(row, set) of every text, hashed in small pieces whose arrays are short-lived."""
    for first, some in batches_of(texts, _HASH_BYTES):
        yield from enumerate(ngram_sets(some, n), first)


class Bands:
    """Size bands, and of each the chunks of a sketch and the differences to bear. Similarity num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.first, self.sketch = num, den, [1], []

    def band(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(max(self.first[-1] + 1, int(self.first[-1] * GROWTH)))
        return int(np.searchsorted(self.first, size, side="right")) - 1

    def of(self, band: int) -> tuple[int, int]:
        """(m chunks, D differences) for pairs whose smaller set lies in the band."""
        while len(self.sketch) <= band:
            small = self.first[len(self.sketch) + 1] - 1
            both = small + small * self.den // self.num
            differ = both * (self.den - self.num) // (self.den + self.num)
            # room for the chunks expected to stay empty, and one more
            mean = self.first[len(self.sketch)] / (differ + 1)
            self.sketch.append((differ + 1 + int(np.ceil(2 * (differ + 1) * np.exp(-mean))) + (differ > 0), differ))
        return self.sketch[band]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Join keys of one set, in its own band and, where it can be the larger one, in the bands below."""
        size, out = len(hashes), []
        band = self.band(size)
        while band >= 0 and (self.first[band + 1] - 1) * self.den >= size * self.num:
            m, differ = self.of(band)
            chunk = (mix(hashes) % np.uint64(m)).astype(np.int64)
            order = np.argsort(chunk, kind="stable")
            at = np.flatnonzero(groups(chunk[order]))
            # the XOR of the codes of the bits that the n-grams flip is that of the codes of the bits left set
            parity = np.bitwise_xor.reduceat(mix((hashes >> np.uint64(32)) * _STEP)[order], at)
            used = chunk[order][at]
            if len(used) <= differ:
                empty = np.setdiff1d(np.arange(m), used)
                used, parity = np.append(used, empty), np.append(parity, np.zeros(len(empty), np.uint64))
            out.append(mix(parity + mix(np.uint64(band << 32) + used.astype(np.uint64))))
            band -= 1
        return np.concatenate(out)


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


class Rarest:
    """Join keys of a set: as many of its rarest n-grams as hold one of any other set that is as similar."""

    def __init__(self, num: int, den: int, counts: np.ndarray):
        self.num, self.den, self.counts = num, den, counts

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        # the hashes are sorted, so a stable order by count alone is one by count and hash
        size = len(hashes)
        return hashes[np.argsort(self.counts[cell_of(hashes)], kind="stable")[: size + 1 + -size * self.num // self.den]]


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity of the hashes per bit; as many bits as hashes, a power of two and ``BITS`` or more."""
    width = max(BITS, 1 << (max(1, len(hashes)) - 1).bit_length())
    return np.packbits(np.bincount((mix(hashes + np.uint64(1)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Sketches of that width (bytes) or more folded to it, as rows of 64-bit words."""
    out = np.empty((len(bits), width), np.uint8)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def _prints(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums, which tell a set from others."""
    return int(np.add.reduce(h)), int(np.bitwise_xor.reduce(mix(h + _STEP))) if len(h) else 0


def _profile(n: int, counted: bool):
    """Size and prints of every set; where counted, each task's table of n-gram counts follows in rows (slice, null, null, null, counts)."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            found = []
            for _, h in sets_of(batch.column(1), n):
                found.append((len(h), *_prints(h)))
                if counted:
                    # a set's n-grams are distinct, but two may share a cell; counting one of these is enough for an order
                    counts[cell_of(h)] += 1
            size, low, high = zip(*found, strict=True) if found else ((), (), ())
            facts = [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(np.array(high, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*facts, pa.nulls(len(batch), pa.binary())], names=["doc_id", "n", "f1", "f2", "counts"])
        if counts.any():
            cells = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in counts.reshape(-1, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int64()), *[pa.nulls(len(cells), pa.int64())] * 3, pa.array(cells, pa.binary())], names=["doc_id", "n", "f1", "f2", "counts"])

    return run


def _added(batches):
    """Rows (slice, counts) by slice: their sum."""
    at, total = None, None
    for batch in batches:
        for slice_, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = np.frombuffer(zlib.decompress(raw), "<i8")
            if slice_ != at and at is not None:
                yield pa.RecordBatch.from_pydict({"slice": [at], "counts": [total.tobytes()]})
            at, total = slice_, own if slice_ != at else total + own
    if at is not None:
        yield pa.RecordBatch.from_pydict({"slice": [at], "counts": [total.tobytes()]})


def ngram_counts(slices: DataFrame) -> np.ndarray:
    """The sum of the tasks' tables (slice, counts), in numbers of 16 bits: what is far above the mean may be told no more apart."""
    out = np.zeros((CELLS // SLICE, SLICE), np.int64)
    for row in slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_added, "slice long, counts binary").collect():
        out[row["slice"]] = np.frombuffer(bytes(row["counts"]), "<i8")
    return np.minimum(out.reshape(-1) >> max(0, int(out.mean()).bit_length() - 13), 65535).astype(np.uint16)


_DEALT = "bucket int, met boolean, x binary, y binary"


def _deal(n: int, keys_of, buckets: int, stars: bool):
    """Per run of keys: stars around the least document of each key, as they are (met), and that document with its key for the key's bucket; without stars, all documents."""

    def star(keys, docs):
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = groups(key)
        least = doc[first][np.cumsum(first) - 1]
        pairs = np.stack([doc, least], 1)[doc != least] if stars else ()
        if stars:
            key, doc = key[first], doc[first]
        bucket = (key >> np.uint64(48)).astype(np.int64) % buckets
        order = np.lexsort((doc, bucket))
        key, doc, bucket = key[order], doc[order], bucket[order]
        parts = np.split(np.arange(len(key)), np.flatnonzero(np.diff(bucket)) + 1)
        at, met, x, y = [int(bucket[p[0]]) for p in parts], [False] * len(parts), [put48(key[p]) for p in parts], [put_ids(doc[p]) for p in parts]
        if len(pairs):
            at, met, x, y = [*at, int(pairs[0, 0]) % buckets], [*met, True], [*x, pairs[:, 0].tobytes()], [*y, pairs[:, 1].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(met, pa.bool_()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["bucket", "met", "x", "y"])

    def run(batches):
        bands, seen, keys, docs, count = keys_of(), set(), [], [], 0
        for batch in batches:
            present = batch.filter(batch.column(0).is_valid())
            ids = present.column(0).to_pylist()
            for i, h in sets_of(present.column(1), n):
                # equal sets are told from the profiles: one of them is enough in a task
                mark = _prints(h)
                if not len(h) or mark in seen:
                    continue
                seen.add(mark)
                keys.append(bands.keys(h))
                docs.append(np.full(len(keys[-1]), ids[i]))
                count += len(keys[-1])
                if count >= _KEYS:
                    yield star(keys, docs)
                    keys, docs, count = [], [], 0
                if len(seen) > 500_000:
                    seen.clear()
        if count:
            yield star(keys, docs)

    return run


def _meet(batches):
    """(a, b): stars of the keys around their least document. Rows by bucket: one bucket is held at a time."""
    at, held = None, []

    def star():
        key = np.concatenate([get48(k) for k, _ in held])
        doc = np.concatenate([get_ids(d) for _, d in held])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = groups(key)
        least = doc[first][np.cumsum(first) - 1]
        return _pairs(doc[doc != least], least[doc != least])

    for batch in batches:
        for bucket, met, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if met:
                yield _pairs(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))
                continue
            if bucket != at and held:
                yield star()
                held = []
            at = bucket
            held.append((x, y))
    if held:
        yield star()


def _share(batches):
    """Of the keys' documents, rows by bucket: candidates (null, a, b), each once a bucket, and the documents (key, a, null) of keys of more than PAIRED."""
    at, held = None, []

    def shared():
        key = np.concatenate([get48(k) for k, _ in held])
        doc = np.concatenate([get_ids(d) for _, d in held])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = groups(key, doc)
        key, doc = key[new], doc[new]
        begin = np.flatnonzero(groups(key))
        size = np.diff(np.append(begin, len(key)))
        large = np.repeat(size > PAIRED, size)
        least = np.repeat(doc[begin], size)
        a, b = [doc[large & (doc != least)]], [least[large & (doc != least)]]
        for i in range(1, PAIRED):
            # the i-th document of every small group with those before it
            some = begin[(size > i) & (size <= PAIRED)] + i
            for j in range(1, i + 1):
                a.append(doc[some])
                b.append(doc[some - j])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order][groups(*pairs[order].T)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])
        # a bucket's number tells keys of the same 48 bits apart
        yield pa.RecordBatch.from_arrays([pa.array(mix(key[large] * np.uint64(1 << 16) + np.uint64(at)).view(np.int64)), pa.array(doc[large]), pa.nulls(int(large.sum()), pa.int64())], names=["key", "a", "b"])

    for batch in batches:
        for bucket, _, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != at and held:
                yield from shared()
                held = []
            at = bucket
            held.append((x, y))
    if held:
        yield from shared()


def _plausible(num: int, den: int):
    """Rows (a, b, x, y, nx, ny) with sketches and sizes: the (a, b) that these allow."""

    def run(batches):
        for batch in batches:
            size = [c.to_pylist() for c in batch.columns[4:]]
            open_ = []
            for x, y, nx, ny in zip(batch.column(2), batch.column(3), *size, strict=True):
                x, y = x.as_py(), y.as_py()
                both = folded([x, y], min(len(x), len(y)))
                open_.append(int(np.bitwise_count(both[0] ^ both[1]).sum()) <= (nx + ny) * (den - num) // (den + num))
            yield batch.select([0, 1]).filter(pa.array(open_, pa.bool_()))

    return run


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(n: int):
    def run(batches):
        seen = set()
        for batch in batches:
            # a repeated row is told from its id and text: one of them is enough in a task
            marks = [hash((d, t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            fresh = [not (m in seen or seen.add(m)) for m in marks]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            size, bits, out = [], [], []
            for _, h in sets_of(batch.column(1), n):
                size.append(len(h))
                bits.append(bit_sketch(h))
                out.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(out, pa.binary())], names=["a", "size", "bits", "hashes"])
            if len(seen) > 500_000:
                seen.clear()

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                links.append(shared * den >= (len(x) + len(y) - shared) * num and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node it reaches. Large-star, small-star."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = _parted(edges, state[0])
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        least = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("p")).groupBy(F.col("p.x").alias("v")).agg(F.least(F.min("p.y"), F.col("v")).alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.distinct())


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common hashes of each set of x with each of y. Hashes of many sets go through a matrix product, others pair by pair."""
    nx, ny = len(x), len(y)
    out = np.zeros(nx * ny, np.int64)
    column = np.unique(np.concatenate(x + y), return_inverse=True)[1]
    cut_ = sum(map(len, x))
    sides = []
    for sets, c in ((x, column[:cut_]), (y, column[cut_:])):
        order = np.argsort(c, kind="stable")
        sides.append((c[order], np.repeat(np.arange(len(sets)), [len(h) for h in sets])[order]))
    width = int(column.max()) + 1 if len(column) else 0
    (cx, rx), (cy, ry) = sides
    in_x, in_y = np.bincount(cx, minlength=width), np.bincount(cy, minlength=width)
    heavy = in_x * in_y * 256 > nx * ny
    many = np.flatnonzero(heavy)
    dense = np.zeros((nx, ny), np.float32)
    for a in range(0, len(many), 2048):
        some = many[a : a + 2048]
        at = np.full(width, -1)
        at[some] = np.arange(len(some))
        left, right = np.zeros((nx, len(some)), np.float32), np.zeros((ny, len(some)), np.float32)
        for m, c, r in ((left, cx, rx), (right, cy, ry)):
            hit = at[c] >= 0
            m[r[hit], at[c[hit]]] = 1
        dense += left @ right.T
    few = ~heavy[cx] & (in_y[cx] > 0)
    cx, rx = cx[few], rx[few]
    begin = np.cumsum(in_y) - in_y
    upto = np.cumsum(in_y[cx])
    a = 0
    while a < len(cx):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 4_000_000, side="right")))
        times = in_y[cx[a:b]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[cx[a:b]], times)
        out += np.bincount(np.repeat(rx[a:b], times) * ny + ry[place], minlength=nx * ny)
        a = b
    return out.reshape(nx, ny) + dense.astype(np.int64)


def possible(nx: np.ndarray, ny: np.ndarray, x: list[bytes], y: list[bytes], num: int, den: int) -> np.ndarray:
    """Distance of each sketch of x from each of y where sizes and sketches allow the similarity, else -1.

    Two sketches are compared at the width of the narrower one; sets that sizes allow have widths that differ little.
    """
    out = np.full((len(nx), len(ny)), -1, np.int32)
    wx, wy = np.array([len(b) for b in x]), np.array([len(b) for b in y])
    wider = 1 << int(np.ceil(np.log2(den / num)))
    for w in np.unique(np.append(wx, wy)).tolist():
        r, c = np.flatnonzero((wx >= w) & (wx <= w * wider)), np.flatnonzero((wy >= w) & (wy <= w * wider))
        if not len(r) or not len(c) or (wx[r].min() > w and wy[c].min() > w):
            continue
        fx, fy = folded([x[i] for i in r], w), folded([y[j] for j in c], w)
        for i, row in zip(r.tolist(), fx, strict=True):
            most = (nx[i] + ny[c]) * (den - num) // (den + num)
            at = np.flatnonzero((np.abs(nx[i] - ny[c]) <= most) & ((wx[i] == w) | (wy[c] == w)))
            apart = np.bitwise_count(fy[at] ^ row).sum(1, dtype=np.int32)
            out[i, c[at]] = np.where(apart <= most[at], apart, -1)
    return out


def block_links(x: list[tuple[int, np.ndarray]], y: list[tuple[int, np.ndarray]], num: int, den: int) -> np.ndarray:
    """Whether each id of x is linked with each of y. Rows (id, set) by id; an id with several sets is linked by any."""
    nx, ny = (np.array([len(h) for _, h in rows]) for rows in (x, y))
    open_ = possible(nx, ny, [bit_sketch(h) for _, h in x], [bit_sketch(h) for _, h in y], num, den) >= 0
    link = np.zeros(open_.shape, bool)
    # sets that no sketch leaves a partner are not compared
    r, c = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if len(r):
        shared = shared_counts([x[i][1] for i in r], [y[i][1] for i in c])
        link[np.ix_(r, c)] = (shared * den >= (nx[r][:, None] + ny[c] - shared) * num) & (shared > 0)
    begin = lambda rows: np.flatnonzero(groups(np.array([d for d, _ in rows])))
    return np.logical_or.reduceat(np.logical_or.reduceat(link, begin(x), axis=0), begin(y), axis=1)


def spanning(ids: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its part) of the parts that the links join, but for the least ones themselves."""
    todo, a, b = np.ones(len(ids), bool), [], []
    for i in np.argsort(ids):
        if todo[i]:
            reach, front = np.zeros(len(ids), bool), np.array([i])
            reach[i] = True
            while len(front):
                new = link[front].any(0) & ~reach
                reach |= new
                front = np.flatnonzero(new)
            todo &= ~reach
            reach[i] = False
            a.append(ids[reach])
            b.append(np.full(len(a[-1]), ids[i]))
    return np.concatenate(a), np.concatenate(b)


def _grouped(batches, close):
    """Rows (root, low, high, part, ...) by the first three: what close makes of each group's sides (lists of distinct rows, one or two)."""
    group, held = None, {}
    for batch in batches:
        for root, low, high, part, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (root, low, high) != group:
                if group and len(held) == 1 + (group[1] != group[2]):
                    yield from close([sorted(held[k]) for k in sorted(held)])
                group, held = (root, low, high), {}
            held.setdefault(part, set()).add(tuple(row))
    if group and len(held) == 1 + (group[1] != group[2]):
        yield from close([sorted(held[k]) for k in sorted(held)])


def _square(link: np.ndarray, alone: bool, none) -> np.ndarray:
    """Of both sides' members with both sides' members."""
    if alone:
        np.fill_diagonal(link, none)
        return link
    both = np.full((sum(link.shape),) * 2, none, link.dtype)
    both[: len(link), len(link) :] = link
    both[len(link) :, : len(link)] = link.T
    return both


def _cross(num: int, den: int):
    """Rows (a, hashes) of groups: the links of each a as (a, null, n), and a forest of them as (a, b, null)."""

    def close(sides):
        sides = [[(a, np.frombuffer(h, np.uint64)) for a, h in side] for side in sides]
        link = _square(block_links(sides[0], sides[-1], num, den), len(sides) == 1, False)
        ids = np.concatenate([np.array(sorted({d for d, _ in side})) for side in sides])
        a, b = spanning(ids, link)
        none = pa.nulls(len(ids), pa.int64()), pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), none[0], pa.array(link.sum(1), pa.int64())], names=["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none[1]], names=["a", "b", "n"])

    return lambda batches: _grouped(batches, close)


def _nearest(num: int, den: int):
    """Rows (a, v, size, bits) of groups: for each a that may be linked to a member of another v, the one whose sketch is nearest (a, b, gap)."""

    def close(sides):
        n, v, ids = ([np.array([r[k] for r in side], np.int64) for side in sides] for k in (2, 1, 0))
        gap, mate = ([np.full(len(x), fill) for x in n] for fill in (np.inf, np.int64(0)))
        # a strip of the distances at a time
        for i in range(0, len(n[0]), STRIP):
            at = slice(i, i + STRIP)
            strip = possible(n[0][at], n[-1], [r[3] for r in sides[0][at]], [r[3] for r in sides[-1]], num, den)
            share = np.where((strip < 0) | (v[0][at, None] == v[-1]), np.inf, strip / (n[0][at, None] + n[-1]))
            best = share.argmin(1)
            gap[0][at], mate[0][at] = share[np.arange(len(best)), best], ids[-1][best]
            if len(sides) > 1:
                best = share.argmin(0)
                least = share[best, np.arange(len(best))]
                nearer = least < gap[1]
                gap[1][nearer], mate[1][nearer] = least[nearer], ids[0][at][best[nearer]]
        gap, mate, ids = (np.concatenate(x) for x in (gap, mate, ids))
        some = gap < np.inf
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(mate[some], pa.int64()), pa.array(gap[some], pa.float64())], names=["a", "b", "gap"])

    return lambda batches: _grouped(batches, close)


def _crossings(members: DataFrame, most_rows: int, most_hashes: int, num: int, den: int) -> DataFrame:
    """(root, low, high, part, a) from (root, a, size): the groups of each cluster's pairs of blocks.

    A cluster that fits a block is one. A larger one is dealt into bands of sizes and these into blocks; as sets that
    may be linked lie in one band or in neighbours, only the blocks of such meet.
    """
    need = F.greatest(F.ceil(F.col("c") / most_rows), F.ceil(F.col("s") / most_hashes), F.lit(1)).cast("long")
    total = held(members.groupBy("root").agg(F.count("*").alias("c"), F.sum("size").alias("s")).withColumn("blocks", need))
    once = lambda df: df.select("root", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("part"), "a")
    large = total.where("blocks > 1").select("root")
    if large.isEmpty():
        return once(members)
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(den / num) + 1e-9) if den > num else F.col("size")
    rest = held(members.join(large, "root", "left_semi").withColumn("band", band))
    blocks = rest.groupBy("root", "band").agg(F.count("*").alias("c"), F.sum("size").alias("s")).select("root", "band", need.alias("nb"))
    placed = rest.join(blocks, ["root", "band"]).select("root", "a", F.xxhash64("band", F.pmod(F.xxhash64("a"), F.col("nb"))).alias("part"))
    parts = held(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("root", "band", F.xxhash64("band", "salt").alias("part")))
    # the blocks of a band meet themselves and those of the next band
    y = parts.select("root", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("own"), F.col("part").alias("other"))
    pairs = parts.join(y, ["root", "band"]).where("own > band OR part <= other").select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    pairs = pairs.withColumn("part", F.explode(F.array_distinct(F.array("low", "high"))))
    return once(members.join(large, "root", "left_anti")).unionByName(placed.join(pairs, ["root", "part"]).select("root", "low", "high", "part", "a"))


def crossed(members: DataFrame, sets: DataFrame, num: int, den: int, whole: bool) -> DataFrame:
    """Pairs of blocks of the clusters' members (root, v, a): whole sets (a, null, n) and (a, b, null), or nearest sketches (a, b, gap)."""
    work, schema, columns = (_cross(num, den), "a long, b long, n long", ["a", "hashes"]) if whole else (_nearest(num, den), "a long, b long, gap double", ["a", "v", "size", "bits"])
    sized = held(members.join(sets.groupBy("a").agg(F.max("size").alias("size")), "a").select("root", "v", "a", "size"))
    met = _crossings(sized, BLOCK_ROWS if whole else SKETCH_ROWS, BLOCK_HASHES if whole else 8 * BLOCK_HASHES, num, den)
    facts = sets.select("a", "hashes") if whole else sets.select("a", "size", "bits").join(members.select("a", "v").distinct(), "a")
    met = met.join(facts, "a").select("root", "low", "high", "part", *columns)
    return held(met.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(work, schema))


def connected(members: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what the links within the groups (root, a) connect, without comparing all pairs; links holds some of them and all others.

    As long as groups are torn, each member that a sketch leaves a partner in another part is verified with the nearest
    one; after ``ROUNDS`` of these, or one that joins nothing, the members that still have such partners are compared in
    full, those of groups that share members together.
    """
    rounds, joins = 0, True
    while True:
        release(members.sparkSession)
        parts = components(links).select(F.col("node").alias("a"), F.col("root").alias("v"))
        placed = held(members.select("root", "a").join(parts, "a", "left").withColumn("v", F.coalesce("v", "a")))
        torn = placed.groupBy("root").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("root")
        placed = held(placed.join(torn, "root", "left_semi"))
        if placed.isEmpty():
            return links
        near = crossed(placed, sets, num, den, False)
        if near.isEmpty():
            return links
        if rounds == ROUNDS or not joins:
            rest = held(placed.join(near.select("a").distinct(), "a", "left_semi"))
            stars = rest.join(rest.groupBy("root").agg(F.min("a").alias("b")), "root").select("a", "b")
            joined = components(stars).withColumnRenamed("node", "a")
            found = crossed(rest.select("a", "v").distinct().join(joined, "a"), sets, num, den, True)
            return links.unionByName(found.where("n IS NULL").select("a", "b"))
        tried = near.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select(F.greatest("a", "x.b").alias("a"), F.least("a", "x.b").alias("b")).distinct()
        good = held(_linked(tried, sets, num, den))
        rounds, joins = rounds + 1, not good.isEmpty()
        links = links.unionByName(good)


def _without(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of frame whose doc_id is not in ids. Up to ``BROADCAST_IDS`` ids go to the texts, of more the texts are dealt by id."""
    ids = held(ids)
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash"), "doc_id", "left_anti")


def connecting(frame: DataFrame, some: DataFrame, classes: DataFrame, same: DataFrame, counts: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of classes, by their least documents, that connect what all links connect."""
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    alone = _without(frame, some.select("doc_id").distinct().join(reps, "doc_id", "left_anti"))
    total = int(classes.agg(F.sum(F.col("n") * (den - num) / den + 1)).first()[0] or 0)
    parts = max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // _BUCKET_KEYS)
    dealt = alone.mapInArrow(_deal(n, functools.partial(Rarest, num, den, counts), 2 * parts, False), _DEALT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    met = held(dealt.mapInArrow(_share, "key long, a long, b long").distinct())
    release(frame.sparkSession)
    of = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"))
    sized = met.where("key IS NULL").select("a", "b").join(of("a"), "a").join(of("b"), "b")
    pairs = held(sized.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b").distinct())
    shared = met.where("key IS NOT NULL").select(F.col("key").alias("root"), "a")
    # of keys of the same documents, one is enough
    sums = shared.groupBy("root").agg(F.count("*").alias("c"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "a")).alias("x"))
    members = held(shared.join(sums.groupBy("c", "s", "x").agg(F.min("root").alias("root")).select("root"), "root", "left_semi"))
    sets = _set_table(frame, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select(F.col("a").alias("doc_id"))), n)
    release(frame.sparkSession)
    side = lambda c, x: sets.select(F.col("a").alias(c), F.col("bits").alias(x), F.col("size").alias(f"n{x}"))
    tried = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(_plausible(num, den), "a long, b long").distinct()
    links = held(_linked(tried, sets, num, den).unionByName(same))
    return connected(members, links, sets, num, den)


def _counted(frame: DataFrame, classes: DataFrame, node: DataFrame, same: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect what all links connect, and of each class its number of links (rep, n_links)."""
    spark = frame.sparkSession
    # a set has fewer keys than n-grams, but for the smallest
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // _BUCKET_KEYS)
    dealt = frame.mapInArrow(_deal(n, functools.partial(Bands, num, den), 2 * parts, True), _DEALT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    met = held(dealt.mapInArrow(_meet, "a long, b long").distinct())
    release(spark)
    # from documents to the classes they stand for
    of = lambda c: node.select(F.col("doc_id").alias(c), F.col("reps")[0].alias(f"r{c}"))
    mapped = met.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
    stars = held(mapped.distinct())
    clusters = components(stars.unionByName(same)).withColumnRenamed("node", "a")
    members = held(clusters.withColumn("v", F.col("a")))
    sets = _set_table(frame, members.select(F.col("a").alias("doc_id")), n)
    release(spark)
    near = crossed(members, sets, num, den, False)
    found = crossed(members.join(near.select("a").distinct(), "a", "left_semi"), sets, num, den, True)
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    return found.where("n IS NULL").select("a", "b").unionByName(same), counts


def similarity_classes(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with count_links, n_links of every row; linked at num / den of the union or more.

    n_links counts all links of the row's class of equal sets to other classes.
    """
    spark = docs.sparkSession
    ship(spark)
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = held(frame.mapInArrow(_profile(n, not count_links), "doc_id long, n long, f1 long, f2 long, counts binary"))
    slices, profile = profile.where("counts IS NOT NULL").select(F.col("doc_id").alias("slice"), "counts"), profile.where("counts IS NULL").drop("counts")
    some = profile.where("n > 0 AND doc_id IS NOT NULL")
    classes = held(some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    node = held(some.join(classes, ["n", "f1", "f2"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("rep")).alias("reps")))
    same = node.where("size(reps) > 1").select(F.explode(F.expr("slice(reps, 2, size(reps))")).alias("a"), F.col("reps")[0].alias("b"))
    counts = None
    if count_links:
        links, counts = _counted(frame, classes, node, same, n, num, den)
    else:
        links = connecting(frame, some, classes, same, ngram_counts(slices), n, num, den)
    roots = components(links)
    release(spark)
    final = node.select("doc_id", F.col("reps")[0].alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("node_id"), F.coalesce("root", "rep").alias("component_id"), "rep")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if counts is not None:
        final = final.join(counts, "rep", "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return profile.select("doc_id", "n").join(final.drop("rep"), F.col("doc_id") == F.col("node_id"), "left").select(*columns)


def _set_table(frame: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(a, size, bits, hashes) of the documents in ids (doc_id). Up to ``BROADCAST_IDS`` ids go to the texts, of more the texts are dealt by id."""
    ids = held(ids.distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return held(frame.join(ids, "doc_id", "left_semi").mapInArrow(_sets(n), "a long, size long, bits binary, hashes binary"))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked. Only their sets are dealt."""
    pairs = held(pairs)
    ids = held(pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct())
    sets = sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "a", "left_semi")
    side = lambda c: sets.select(F.col("a").alias(c), F.col("hashes").alias(f"h{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "hb").mapInArrow(_verify(num, den), "a long, b long").distinct()


def near_duplicate_keepers(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with one document of each class: that of the least id (its repeated rows once). Rows with a null id stay."""
    classes = similarity_classes(docs, n, num, den, count_links=False).where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(classes, "doc_id", "left_anti")
    return kept.select(*docs.columns)
