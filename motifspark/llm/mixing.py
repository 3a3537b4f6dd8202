"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; a document's wish is target / size
of its source, in copies. Whole copies are given at once. The fractional
parts are rounded pairwise: two fractions meet, mass moves at random from one
to the other so that each keeps its expectation, until one of them is 0 or 1.
Units meet in order of size, so the words taken follow the target closely.
Rounding runs in chunks of one source and size class, streamed through a task
in sorted order; each chunk leaves at most one fraction, and these residuals
meet in a reduction tree over chunks and then over size classes.

Random numbers derive from the seed and the names of chunk and level, chunks
from a hash of the row: the same rows give the same mix on any cluster.

Defined results: a null text has size 0 (and so takes nothing); the null
source is a source of its own and comes last; rows with a null id take part;
repeated rows are separate units; an empty table gives an empty mix.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, cut, ship

CHUNK_ROWS, FAN_IN = 4096, 64


def with_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with weight and target.

    The table has a row per source. Sources are taken by the ratio of cap to
    weight: up to some place all are capped, and the level x that spends the
    rest on the others, by weight, is read off at the first place where it
    stays under the cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    named = named.withColumn("level", level)
    fits = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(Window.partitionBy())
    return named.withColumn("target", F.least("most", F.coalesce(fits * F.col("weight"), F.col("most")))).select("source", "source_size", "weight", "target")


class Pivot:
    """One running unit; meets the next ones in turn. Units are (key, p) with 0 < p < 1."""

    def __init__(self, name: str):
        self.random, self.unit = random.Random(name), None

    def meet(self, key, p: float):
        """The unit decided by this meeting as (key, copies), or None."""
        if self.unit is None:
            self.unit = (key, p)
            return None
        other, q = self.unit
        total, u = p + q, self.random.random()
        if abs(total - 1) < 1e-12:
            win, lose = ((key, other) if u < p else (other, key))
            self.unit = None
            return [(win, 1), (lose, 0)]
        if total < 1:
            win, lose = ((key, other) if u < p / total else (other, key))
            self.unit = (win, total)
            return [(lose, 0)]
        stays, full = ((other, key) if u < (1 - q) / (2 - total) else (key, other))
        self.unit = (stays, total - 1)
        return [(full, 1)]


def _level_zero(seed: int):
    """Rows sorted by group in; rows with their extra copy out. left is the fraction of a group's last, undecided row."""

    def run(batches):
        group, pivot, kept = None, None, {}
        names = ["doc_id", "source", "size", "size_class", "chunk", "whole", "fraction", "extra", "left"]
        for batch in batches:
            out = {k: [] for k in names}

            def put(row, extra, left):
                for k, v in zip(names, (*row, extra, left), strict=True):
                    out[k].append(v)

            def close():
                if pivot is not None and pivot.unit is not None:
                    put(kept.pop(pivot.unit[0]), 0, pivot.unit[1])

            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            for i, row in enumerate(rows):
                key = (row[1], row[3], row[4])
                if key != group:
                    close()
                    group, pivot = key, Pivot(f"{seed}|0|{key}")
                if not 0 < row[6] < 1:
                    put(row, 0, None)
                    continue
                unit = object()
                kept[unit] = row
                for done, extra in pivot.meet(unit, row[6]) or ():
                    put(kept.pop(done), extra, None)
            # the running unit stays in hand from batch to batch
            yield _batch(out)
        out = {k: [] for k in names}
        if pivot is not None and pivot.unit is not None:
            for k, v in zip(names, (*kept.pop(pivot.unit[0]), 0, pivot.unit[1]), strict=True):
                out[k].append(v)
            yield _batch(out)

    return run


_KINDS = {"doc_id": pa.int64(), "source": pa.string(), "size": pa.int64(), "size_class": pa.int32(), "chunk": pa.int64(), "whole": pa.int64(), "fraction": pa.float64(), "extra": pa.int32(), "left": pa.float64(), "node_class": pa.int32(), "node": pa.int64()}


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for k, v in out.items()], names=list(out))


def _merge(seed: int, level: int):
    """Residuals sorted by node in; each with extra (decided) or left (still a fraction) out."""

    def run(batches):
        names = ["source", "size_class", "chunk", "node_class", "node", "extra", "left"]
        group, pivot = None, None
        for batch in batches:
            out = {k: [] for k in names}

            def close():
                if pivot is not None and pivot.unit is not None:
                    for k, v in zip(names, (*pivot.unit[0], None, pivot.unit[1]), strict=True):
                        out[k].append(v)

            for *row, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = (row[0], row[3], row[4])
                if key != group:
                    close()
                    group, pivot = key, Pivot(f"{seed}|{level}|{key}")
                for done, extra in pivot.meet(tuple(row), p) or ():
                    for k, v in zip(names, (*done, extra, None), strict=True):
                        out[k].append(v)
            yield _batch(out)
        if pivot is not None and pivot.unit is not None:
            yield _batch({k: [v] for k, v in zip(names, (*pivot.unit[0], None, pivot.unit[1]), strict=True)})

    return run


def mix_to_targets(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    ship(docs.sparkSession)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"),
    ).withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    sized = cut(sized)
    classes = sized.groupBy("source", "size_class").agg(F.count("*").alias("n"), F.sum("size").alias("class_size"))
    targets = cut(with_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, share, most))
    plan = classes.select("source", "size_class", F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks")).alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target")
    plan = cut(plan)
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size_class") == F.col("p.size_class")))
        .select("d.doc_id", "d.source", "d.size", "d.size_class", F.pmod("d.h", "p.chunks").alias("chunk"), F.floor(wish).alias("whole"), (wish - F.floor(wish)).alias("fraction"), "d.h")
        .repartition("source", "size_class", "chunk").sortWithinPartitions("source", "size_class", "chunk", "size", "doc_id", "h").drop("h")
    )
    rounded = cut(rows.mapInArrow(_level_zero(seed), "doc_id long, source string, size long, size_class int, chunk long, whole long, fraction double, extra int, left double"))
    largest = plan.agg(F.max("chunks")).first()[0] or 1
    fractions = rounded.where("left IS NOT NULL").select("source", "size_class", "chunk", F.col("size_class").alias("node_class"), F.col("chunk").alias("node"), "left")
    decided, level = None, 0
    while True:
        level += 1
        last = largest <= 1
        up = fractions.withColumn("node_class", F.lit(0) if last else F.col("node_class")).withColumn("node", F.floor(F.col("node") / FAN_IN))
        up = up.repartition("source", "node_class", "node").sortWithinPartitions("source", "node_class", "node", "size_class", "chunk")
        met = cut(up.select("source", "size_class", "chunk", "node_class", "node", "left").mapInArrow(_merge(seed, level), "source string, size_class int, chunk long, node_class int, node long, extra int, left double"))
        done = met.where("left IS NULL").select("source", "size_class", "chunk", "extra")
        decided = done if decided is None else decided.unionByName(done)
        fractions = met.where("left IS NOT NULL").drop("extra")
        if last:
            break
        largest = -(-largest // FAN_IN)
    coin = (F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("left")
    decided = decided.unionByName(fractions.select("source", "size_class", "chunk", coin.cast("int").alias("extra")))
    open_rows = rounded.where("left IS NOT NULL").alias("r").join(decided.alias("x"), F.col("r.source").eqNullSafe(F.col("x.source")) & (F.col("r.size_class") == F.col("x.size_class")) & (F.col("r.chunk") == F.col("x.chunk")))
    keep = ["doc_id", "source", "size", (F.col("whole") + F.col("extra")).cast("long").alias("copies")]
    mixed = rounded.where("left IS NULL").select(*keep).unionByName(open_rows.select("r.doc_id", "r.source", "r.size", (F.col("r.whole") + F.col("x.extra")).cast("long").alias("copies")))
    return (
        mixed.alias("m").join(targets.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
        .select("m.doc_id", "m.source", "m.size", "t.source_size", "t.target", "m.copies", (F.col("m.size") * F.col("m.copies")).alias("taken"))
    )
