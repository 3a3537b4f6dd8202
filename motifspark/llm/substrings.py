"""Exact removal of repeated 100-byte strings with suffix arrays.

1. Every run of windows (100-byte strings at consecutive starts) that share
   their minimizer, the least of the 85 hashes of 16 bytes in a window, is a
   segment of at most 184 bytes. Equal windows have equal minimizers, so they
   can only meet in segments of one minimizer.
2. Segments are dealt by minimizer, each map task sending a repeated segment
   once. Of equal segments all but the earliest are repeats; of minimizers
   with several different segments the earliest copies are candidates.
3. The candidates' bytes are dealt by minimizer into shards of bounded size.
   A shard is one text in order of (document, start): a suffix array by
   Larsson-Sadakane refinement (ranks of 8 bytes, doubled to 128), common
   prefixes by Kasai's rule, and every group of neighbours with 100 common
   bytes keeps its earliest window. Where a minimizer is too large for one
   shard, the sorted windows of its shards are merged by binary search.
4. Repeated windows are laid back over the documents.

Defined results: a null text is empty; texts under 100 bytes lose nothing; a
null id comes after all others and is given back null, rows of different texts
with a null id being documents of their own; repeated rows (same id, same text)
count as one document and get equal results; rows that share an id but not the
text share the ranges found under that id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, ship
from .packing import LAST_ID, batches_of, get_ids, groups, ids_of, mix, prefix_hash, put_ids, slice_hash

LENGTH, SEED, SHARD_BYTES, DEPTH = 100, 16, 1 << 19, 128
_LOW = np.uint64((1 << 24) - 1)
_TEXT_BYTES, _HASH_BYTES = 2_000_000, 200_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over x[i : i + width]."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else (x if not rest else x[:0])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, minimizer and content hash of each segment of texts that lie end to end in data (under 2**24 bytes or one text)."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = h[:-size] * np.uint64(factor) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    h = mix(h)
    place = np.arange(len(h), dtype=np.uint64)
    low, best = (_LOW, None) if len(h) <= int(_LOW) else (None, None)
    if low is not None:
        best = (_sliding_min((h & ~_LOW) | place, LENGTH - SEED + 1) & _LOW).astype(np.int64)
    else:  # one very long text: in overlapping parts
        step, parts = 1 << 23, []
        for a in range(0, len(data) - LENGTH + 1, step):
            part = h[a : a + step + LENGTH - SEED]
            parts.append((_sliding_min((part & ~_LOW) | place[: len(part)], LENGTH - SEED + 1) & _LOW).astype(np.int64)[:step] + a)
        best = np.concatenate(parts)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[: len(best)]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (best[1:] != best[:-1])
    # a text of 100 bytes or more right after another one: its first window begins a segment
    begins[starts[long]] = True
    at = np.flatnonzero(begins)
    count = np.add.reduceat(valid.astype(np.int64), at) if len(at) else at
    # reduceat runs to the next beginning; what is not valid in between adds nothing
    prefix = prefix_hash(data)
    return at, count.astype(np.int64), h[best[at]], slice_hash(prefix, at, at + count + LENGTH - 1)


_PACKED = "bucket int, minimizer binary, content binary, doc binary, start binary, windows binary, repeat binary"


def _deal(buckets: int):
    def pack(facts):
        minimizer, content, doc, start, windows = map(np.concatenate, zip(*facts, strict=True))
        # of equal segments in these texts only the first is compared with others
        by = np.lexsort((start, doc, content, minimizer))
        first_of = np.zeros(len(by), bool)
        new = groups(minimizer[by], content[by])
        first_of[by[new]] = True
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
        same_place = np.zeros(len(by), bool)
        same_place[by] = (doc[head] == doc[by]) & (start[head] == start[by]) & ~new
        bucket = np.where(first_of, minimizer % np.uint64(buckets), mix(doc.astype(np.uint64) + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
        picked = np.flatnonzero(~same_place)
        picked = picked[np.lexsort((start[picked], doc[picked], bucket[picked]))]
        rows = [x for x in np.split(picked, np.flatnonzero(np.diff(bucket[picked])) + 1) if len(x)]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[x[0]]) for x in rows], pa.int32()), *(pa.array([f(x) for x in rows], pa.binary()) for f in (
                lambda x: minimizer[x[first_of[x]]].tobytes(), lambda x: content[x[first_of[x]]].tobytes(), lambda x: put_ids(doc[x]),
                lambda x: start[x].astype(np.int32).tobytes(), lambda x: windows[x].astype(np.uint8).tobytes(), lambda x: (~first_of[x]).tobytes()))],
            names=["bucket", "minimizer", "content", "doc", "start", "windows", "repeat"],
        )

    def run(batches):
        facts, size = [], 0
        for batch in batches:
            ids = ids_of(batch.column(0))
            # hashed in small pieces, whose arrays are short-lived; packed together
            for first, texts in batches_of(batch.column(1), _HASH_BYTES):
                data = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([len(t) for t in texts])
                at, windows, minimizer, content = segments(data, ends)
                row = np.searchsorted(ends, at, side="right")
                facts.append((minimizer, content, ids[first : first + len(texts)][row], (at - np.concatenate([[0], ends[:-1]])[row]).astype(np.int32), windows.astype(np.uint8)))
                size += len(data)
                if size >= _TEXT_BYTES:
                    yield pack(facts)
                    facts, size = [], 0
        if facts:
            yield pack(facts)

    return run


_FOUND = "doc_id long, start int, windows int, minimizer long"


def _found(doc, start, windows, minimizer) -> pa.RecordBatch:
    """minimizer is null for windows that are repeats, else that of a candidate."""
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), minimizer], names=["doc_id", "start", "windows", "minimizer"])


def _compare(batches):
    buckets = {}
    for batch in batches:
        for bucket, m, c, d, s, w, r in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            r = np.frombuffer(r, bool)
            if r.any():
                d, s, w = get_ids(d), np.frombuffer(s, np.int32), np.frombuffer(w, np.uint8)
                yield _found(d[r], s[r], w[r], pa.nulls(int(r.sum()), pa.int64()))
                d, s, w = put_ids(d[~r]), s[~r].tobytes(), w[~r].tobytes()
            if m:
                buckets.setdefault(bucket, []).append((m, c, d, s, w))
    # a minimizer lies in one bucket: one after the other
    while buckets:
        yield from _compare_bucket(buckets.popitem()[1])


def _compare_bucket(rows: list[tuple[bytes, ...]]):
    m, c, s, w = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in ((0, np.uint64), (1, np.uint64), (3, np.int32), (4, np.uint8)))
    d = np.concatenate([get_ids(r[2]) for r in rows])
    by = np.lexsort((s, d, c, m))
    m, c, d, s, w = m[by], c[by], d[by], s[by], w[by]
    new = groups(m, c)
    head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    repeat = ~new & ~((d == d[head]) & (s == s[head]))
    if repeat.any():
        yield _found(d[repeat], s[repeat], w[repeat], pa.nulls(int(repeat.sum()), pa.int64()))
    firsts = np.flatnonzero(new)
    new_m = groups(m[firsts])
    size = np.diff(np.append(np.flatnonzero(new_m), len(firsts)))
    several = firsts[np.repeat(size, size) > 1]
    if len(several):
        yield _found(d[several], s[several], w[several], pa.array(m[several].view(np.int64)))


_SHARD = "bucket int, minimizer binary, doc binary, start binary, windows binary, bytes binary"


def _cut_out(buckets: int):
    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), {}
            for i, (text, found) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                text = text.as_py() or b""
                for x in found:
                    m, s, w = x["minimizer"], x["start"], x["windows"]
                    if s + w + LENGTH - 1 <= len(text):
                        parts.setdefault(m % buckets, []).append((m, int(ids[i]), s, w, text[s : s + w + LENGTH - 1]))
            rows = [(b, *zip(*x, strict=True)) for b, x in parts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([np.array(r[k], t).tobytes() for r in rows], pa.binary()) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.uint8))), pa.array([b"".join(r[5]) for r in rows], pa.binary())],
                names=["bucket", "minimizer", "doc", "start", "windows", "bytes"],
            )

    return run


def packed_words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place, big end first; zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(text)]
    return word


def suffix_array(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffixes in the order of their first depth bytes, by Larsson-Sadakane refinement.

    rank[p] is the place of the first suffix of p's group. Each round sorts
    only groups of two or more, by the rank of what follows h bytes later.
    """
    n = len(text)
    word = packed_words(text)
    sa = np.argsort(word, kind="stable")
    new = groups(word[sa])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    h = 8
    while h < depth:
        size_one = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~size_one)
        if not len(open_):
            break
        p = sa[open_]
        after = np.where(p + h < n, rank[np.minimum(p + h, n - 1)] + 1, 0)
        key = (rank[p] << 32) | after
        order = np.argsort(key, kind="stable")
        sa[open_], key = p[order], key[order]
        fresh = groups(key)
        new[open_] = fresh
        head = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        rank[sa[open_]] = head
        h *= 2
    return sa


def kasai(text: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int = 3 * LENGTH) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in sa, by place in the text.

    Kasai's rule: where the predecessor of p is that of p - 1 moved by one,
    the prefix is one shorter. Only other places, and those in breaks, compare
    bytes (up to most of them); all others follow by counting down. With a break
    every 184 bytes or sooner, counts stay exact up to LENGTH.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (before[1:] != before[:-1] + 1) | (before[1:] <= 0)
    own[breaks] = True
    padded, word, place, length = np.append(text, np.zeros(8, np.uint8)), packed_words(text), np.arange(n), np.zeros(n, np.int64)

    def compare(todo):
        done = 0
        while len(todo) and done < most:
            a, b = todo + done, before[todo] + done
            inside = np.maximum(a, b) + 8 <= n
            same = inside & (word[np.minimum(a, n - 1)] == word[np.minimum(b, n - 1)])
            ends = todo[~same]
            run, going = np.zeros(len(ends), np.int64), np.ones(len(ends), bool)
            for _ in range(8):
                x, y = ends + done + run, before[ends] + done + run
                going &= (np.maximum(x, y) < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
                run += going
            length[ends] = done + run
            length[todo[same]] = done + 8
            todo, done = todo[same], done + 8

    def counted():
        last = np.maximum.accumulate(np.where(own, place, 0))
        return np.where(own, length, length[last] - (place - last))

    compare(np.flatnonzero(own & (before >= 0)))
    # the rule says nothing after a prefix of 0
    over = np.flatnonzero(~own & (counted() <= 0))
    own[over] = True
    compare(over)
    return counted()


def shard_repeats(strings: list[bytes], doc: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For strings in document order, one shard: places of repeated windows, places of the windows kept in sorted order, text, string of each place, its begin.

    With the document and start of each string, a window is no repeat of one at its own place in its own document.
    """
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes) - sizes
    string = np.repeat(np.arange(len(strings)), sizes)
    whole = np.arange(len(text)) + LENGTH <= (begin + sizes)[string]
    sa = suffix_array(text)
    common = kasai(text, sa, begin)
    new = common[sa] < LENGTH
    new[0] = True
    place = np.where(whole[sa], sa, len(text))
    first = np.minimum.reduceat(place, np.flatnonzero(new))[np.cumsum(new) - 1]
    again = (place != first) & (place < len(text))
    repeats = place[again]
    if doc is not None:
        first_of = first[again]
        a, b = string[repeats], string[first_of]
        repeats = repeats[(doc[a] != doc[b]) | (start[a] + repeats - begin[a] != start[b] + first_of - begin[b])]
    return np.sort(repeats), place[(place == first) & (place < len(text))], text, string, begin


class Runs:
    """Sorted windows of the shards of one large minimizer, merged by binary search."""

    def __init__(self):
        self.window = np.zeros(0, f"S{LENGTH}")
        self.doc = self.place = np.zeros(0, np.int64)

    def merge(self, window, doc, place) -> tuple[np.ndarray, np.ndarray]:
        """Adds a sorted run of distinct windows; (doc, place) of what is a repeat by it, on either side."""
        at = np.searchsorted(self.window, window)
        hit = np.flatnonzero((at < len(self.window)) & (self.window[np.minimum(at, len(self.window) - 1)] == window)) if len(self.window) else np.zeros(0, np.int64)
        old = at[hit]
        earlier = (doc[hit] < self.doc[old]) | ((doc[hit] == self.doc[old]) & (place[hit] < self.place[old]))
        moved = (doc[hit] != self.doc[old]) | (place[hit] != self.place[old])
        lost_doc, lost_place = np.where(earlier, self.doc[old], doc[hit])[moved], np.where(earlier, self.place[old], place[hit])[moved]
        self.doc[old[earlier]], self.place[old[earlier]] = doc[hit[earlier]], place[hit[earlier]]
        fresh = np.ones(len(window), bool)
        fresh[hit] = False
        self.window, self.doc, self.place = np.insert(self.window, at[fresh], window[fresh]), np.insert(self.doc, at[fresh], doc[fresh]), np.insert(self.place, at[fresh], place[fresh])
        return lost_doc, lost_place


def _windows(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(text[places[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel() if len(places) else np.zeros(0, f"S{LENGTH}")


def _ranges(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return _found(doc[at], place[at], place[last] - place[at] + 1, pa.nulls(len(at), pa.int64()))


def _search(batches):
    buckets = {}
    for batch in batches:
        for bucket, *packed in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            buckets.setdefault(bucket, []).append(packed)
    while buckets:
        yield from _search_bucket(buckets.popitem()[1])


def _search_bucket(packed: list[list[bytes]]):
    rows = []
    for m, d, s, w, raw in packed:
        sizes = np.frombuffer(w, np.uint8).astype(np.int64) + LENGTH - 1
        ends = np.cumsum(sizes)
        rows += zip(np.frombuffer(m, np.int64).tolist(), np.frombuffer(d, np.int64).tolist(), np.frombuffer(s, np.int32).tolist(), (raw[b - a : b] for a, b in zip(sizes.tolist(), ends.tolist(), strict=True)), strict=True)
    # repeated rows send the same segment each
    rows = sorted(set(rows))
    start, runs = 0, None
    while start < len(rows):
        end = size = 0
        for end in range(start, len(rows)):  # noqa: B007
            size += len(rows[end][3])
            if size > SHARD_BYTES:
                break
        else:
            end = len(rows)
        if end < len(rows):  # back to where a minimizer begins, unless it fills the shard
            end = max(end, start + 1)
            back = end
            while back > start and rows[back - 1][0] == rows[end][0]:
                back -= 1
            end = back if back > start else end
        shard = sorted(rows[start:end], key=lambda r: r[1:3])
        doc, first = np.array([r[1] for r in shard], np.int64), np.array([r[2] for r in shard], np.int64)
        repeats, kept, text, string, begin = shard_repeats([r[3] for r in shard], doc, first)
        where = lambda p: (doc[string[p]], first[string[p]] + p - begin[string[p]])  # noqa: B023, E731
        lost = [where(repeats)]
        follows = start > 0 and rows[start - 1][0] == rows[start][0]
        goes_on = end < len(rows) and rows[end][0] == rows[end - 1][0]
        if follows or goes_on:
            runs = runs if follows and runs is not None else Runs()
            lost.append(runs.merge(_windows(text, kept), *where(kept)))
        else:
            runs = None
        d, p = (np.concatenate(x) for x in zip(*lost, strict=True))
        if len(d):
            yield _ranges(d, p)
        start = end


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, windows): runs of windows that also start earlier. docs: (key, doc_id, raw), key being doc_id or, without one, a number after all ids. doc_id of the result is a key."""
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 2
    dealt = docs.select("key", "raw").mapInArrow(_deal(buckets), _PACKED).repartition("bucket")
    found = cut(dealt.mapInArrow(_compare, _FOUND))
    wanted = found.where("minimizer IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "windows", "minimizer")).alias("found"))
    # all three columns, as in strip_repeats: both joins then read one exchange of the texts
    cuts = docs.join(wanted, "key").select("key", "raw", "found", "doc_id")
    shards = cuts.mapInArrow(_cut_out(buckets), _SHARD).repartition("bucket")
    by_suffix = shards.mapInArrow(_search, _FOUND)
    return found.where("minimizer IS NULL").unionByName(by_suffix).select("doc_id", "start", "windows")


_RESULT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _strip(names):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in _RESULT}
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                text, found = text.as_py() or b"", found.as_py()
                kept, removed, spans = text, 0, 0
                if found:
                    step = np.zeros(len(text) + 1, np.int32)
                    start = np.minimum(np.array([x["start"] for x in found]), len(text))
                    end = np.minimum(start + np.array([x["windows"] for x in found]) + LENGTH - 1, len(text))
                    np.add.at(step, start, 1)
                    np.add.at(step, end, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for k, v in zip(_RESULT, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    if k in names:
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], _RESULT[k]) for k in names)], names=["doc_id", *names])

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, the kept bytes of every row."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    greatest = own.agg(F.max("doc_id")).first()[0]
    # texts without an id by their hash, after the greatest id
    room = LAST_ID - max(0, greatest or 0)
    after = F.lit(LAST_ID) - F.pmod(F.xxhash64("raw"), F.lit(max(1, room)).cast("long"))
    raw = own.select(F.coalesce("doc_id", after).alias("key"), "doc_id", "raw")
    ranges = repeated_windows(raw).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    joined = raw.join(ranges, "key", "left").select("doc_id", "raw", "found")
    names = list(_RESULT)[: None if texts else -1]
    return joined.mapInArrow(_strip(names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
