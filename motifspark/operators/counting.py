"""Exact homomorphism counts by variable elimination with eager aggregation.

Every edge of a pattern is a factor (its two vertices, count). To eliminate a
vertex, the factors that hold it (and those over the same vertices) are joined
and their product is summed over it; a leaf needs no join, only a grouped sum. Trees thus never build tuples,
and cycles build only the core that their width asks for. Labels may be kept
as columns, which counts all label sequences of a shape in one job.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import hash_part
from ..plans.pattern import Pattern

OPS = {"<": lambda c, x: c < x, ">": lambda c, x: c > x, "<=": lambda c, x: c <= x, ">=": lambda c, x: c >= x, "=": lambda c, x: c == x}


def passes(column, op: str, value: int):
    """A missing property passes every comparison."""
    return column.isNull() | OPS[op](column, value)


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    keys = [c for c in left.columns if c in right.columns and c != "c"]
    joined = left.withColumnRenamed("c", "c_left").join(right.withColumnRenamed("c", "c_right"), keys) if keys else left.withColumnRenamed("c", "c_left").crossJoin(right.withColumnRenamed("c", "c_right"))
    return joined.withColumn("c", F.col("c_left") * F.col("c_right")).drop("c_left", "c_right")


def _joined(parts: list[DataFrame], closed: bool) -> DataFrame:
    """Product of the factors. Where they form a cycle (closed), the two whose join is smallest come first, by its exact size: a join over a hub is put off until two columns decide it."""
    vertices = lambda f: {c for c in f.columns if c[0] == "v"}
    if not closed or len(parts) < 3:
        return reduce(_product, parts)
    sizes = []
    for i, j in itertools.combinations(range(len(parts)), 2):
        if keys := sorted(vertices(parts[i]) & vertices(parts[j])):
            left, right = (parts[k].groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for k, n in ((i, "n"), (j, "m")))
            sizes.append(left.join(right, keys).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0)).alias("size")).select("size", F.lit(i).alias("i"), F.lit(j).alias("j")))
    _, i, j = min(tuple(r) for r in reduce(DataFrame.unionByName, sizes).collect())
    whole, rest = _product(parts[i], parts[j]), [f for k, f in enumerate(parts) if k not in (i, j)]
    while rest:
        k = max(range(len(rest)), key=lambda k: len(vertices(rest[k]) & vertices(whole)))
        whole = _product(whole, rest.pop(k))
    return whole


def _summed(frame: DataFrame, keep: list[str]) -> DataFrame:
    if keep:
        return frame.groupBy(*keep).agg(F.sum("c").alias("c"))
    return frame.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("c"))


def project_counts(edges: DataFrame, pattern: Pattern, keep=(), props: DataFrame | None = None, filters: dict | None = None, labels: bool = False, bound: dict | None = None) -> DataFrame:
    """Instances of the pattern per binding of the vertices in keep: columns v<k>, with labels l<i>, and c.

    filters: vertex -> (op, value) on props; bound: vertex -> id; labels: the
    pattern's labels are ignored and every label sequence is counted.
    """
    factors = []
    for i, (s, label, d) in enumerate(pattern.edges):
        part = edges if labels else edges.where(F.col("label") == label)
        for v, column in ((s, "src"), (d, "dest")):
            if bound and v in bound:
                part = part.where(F.col(column) == bound[v])
        if s == d:
            part = part.where("src = dest")
        cols = [F.col("src").alias(f"v{s}")] + ([F.col("dest").alias(f"v{d}")] if s != d else []) + ([F.col("label").alias(f"l{i}")] if labels else [])
        factors.append(part.select(*cols, F.lit(1).cast("bigint").alias("c")))
    for v, (op, value) in (filters or {}).items():
        good = props.where(~F.coalesce(OPS[op](F.col("year"), value), F.lit(True))).select(F.col("vid").alias(f"v{v}"))
        at = next(i for i, f in enumerate(factors) if f"v{v}" in f.columns)
        factors[at] = factors[at].join(good, f"v{v}", "left_anti")
    names = lambda f: [c for c in f.columns if c != "c"]
    kept, open_ = {f"v{v}" for v in keep}, {f"v{v}" for v in pattern.vertices} - {f"v{v}" for v in keep}
    while open_:
        def cost(v):
            touched = [f for f in factors if v in f.columns]
            return (len({c for f in touched for c in names(f) if c[0] == "v"}), len(touched), v)

        v = min(open_, key=cost)
        open_.discard(v)
        touched, factors = [f for f in factors if v in f.columns], [f for f in factors if v not in f.columns]
        # factors that close a cycle over the touched vertices can only shrink the product
        scope = {c for f in touched for c in names(f) if c[0] == "v"}
        closes = lambda f: len(at := {c for c in names(f) if c[0] == "v"}) > 1 and at <= scope  # noqa: B023, E731
        inside, factors = [f for f in factors if closes(f)], [f for f in factors if not closes(f)]
        whole = _joined(touched + inside, bool(inside))
        factors.append(_summed(whole, [c for c in names(whole) if c != v]))
    whole = reduce(_product, factors)
    order = [f"v{v}" for v in keep] + [c for c in names(whole) if c[0] == "l"]
    return _summed(whole, order) if set(order) != set(names(whole)) or len(factors) > 1 or not order else whole.select(*order, "c")


def count_pattern(edges: DataFrame, pattern: Pattern, **options) -> DataFrame:
    """One row, one column: c."""
    return project_counts(edges, pattern, **options)


def count_shape(edges: DataFrame, vlist: str) -> DataFrame:
    """vlist, label_seq, card of every label sequence that the shape has."""
    n = vlist.count(";") + 1
    counts = project_counts(edges, Pattern.parse(vlist, "->".join(["0"] * n)), labels=True)
    return counts.select(F.lit(vlist).alias("vlist"), F.array_join(F.array(*[F.col(f"l{i}").cast("string") for i in range(n)]), "->").alias("label_seq"), F.col("c").cast("bigint").alias("card"))


def needed_counts(edges: DataFrame, patterns) -> DataFrame:
    """vlist, label_seq, card of the given patterns; a pattern without instances has 0."""
    parts = [count_pattern(edges, p).select(F.lit(p.vlist).alias("vlist"), F.lit(p.label_seq).alias("label_seq"), F.col("c").alias("card")) for p in patterns]
    return reduce(DataFrame.unionByName, parts)


def catalogue_of(edges: DataFrame, pattern: Pattern, masks) -> dict[int, int]:
    """Counts of sub-patterns, collected: one number per mask of one query."""
    found = {(r.vlist, r.label_seq): r.card for r in needed_counts(edges, [pattern.sub(m) for m in masks]).collect()}
    return {m: found[pattern.sub(m).vlist, pattern.sub(m).label_seq] for m in masks}


def count_sql(pattern: Pattern, select: str = "count(*)", where: str = "", group: str = "") -> str:
    """The plain join over a relation e, for oracles."""
    at: dict[int, str] = {}
    conds = []
    for i, (s, label, d) in enumerate(pattern.edges):
        conds.append(f"e{i}.label = {label}")
        for v, c in ((s, f"e{i}.src"), (d, f"e{i}.dest")):
            if v in at:
                conds.append(f"{at[v]} = {c}")
            else:
                at[v] = c
    select = select.format(**{f"v{v}": c for v, c in at.items()})
    where = where.format(**{f"v{v}": c for v, c in at.items()})
    return f"SELECT {select} FROM {', '.join(f'e e{i}' for i in range(pattern.size))} WHERE {' AND '.join(conds)}{' AND ' + where if where else ''}{' GROUP BY ' + group.format(**{f'v{v}': c for v, c in at.items()}) if group else ''}"


def max_extension(edges: DataFrame, pattern: Pattern, base: int, ext: int) -> DataFrame:
    """max_deg: most instances of the extension at one binding of what it shares with the base (over bindings the base has)."""
    shared = sorted(pattern.ends(base) & pattern.ends(ext))
    keys = [f"v{v}" for v in shared]
    b = project_counts(edges, pattern.sub(base), keep=shared).select(*keys)
    e = project_counts(edges, pattern.sub(ext), keep=shared)
    return e.join(b, keys, "left_semi").agg(F.coalesce(F.max("c"), F.lit(0)).cast("bigint").alias("max_deg"))


def extension_distribution(edges: DataFrame, pattern: Pattern, base: int, ext: int) -> DataFrame:
    """ext_size, n: how many base instances have how many extensions, none included."""
    shared = sorted(pattern.ends(base) & pattern.ends(ext))
    keys = [f"v{v}" for v in shared]
    b = project_counts(edges, pattern.sub(base), keep=shared)
    e = project_counts(edges, pattern.sub(ext), keep=shared).withColumnRenamed("c", "ext_size")
    return b.join(e, keys, "left").groupBy(F.coalesce("ext_size", F.lit(0)).cast("bigint").alias("ext_size")).agg(F.sum("c").cast("bigint").alias("n"))


def combo_counts(edges: DataFrame, pattern: Pattern, masks, parts: dict[int, int]) -> DataFrame:
    """mask, h<v> of every vertex in parts (null where the sub-pattern lacks it), c: counts by the hash parts of the vertices."""
    out = []
    for m in masks:
        keep = [v for v in sorted(parts) if v in pattern.ends(m)]
        hs = [(hash_part(F.col(f"v{v}"), parts[v]) if v in keep else F.lit(None)).cast("int").alias(f"h{v}") for v in sorted(parts)]
        out.append(project_counts(edges, pattern.sub(m), keep=keep).select(F.lit(m).alias("mask"), *hs, "c"))
    return reduce(DataFrame.unionByName, out).groupBy("mask", *[f"h{v}" for v in sorted(parts)]).agg(F.sum("c").alias("c"))


def combo_degrees(edges: DataFrame, pattern: Pattern, parts: dict[int, int]) -> DataFrame:
    """edge, v, h<v> of every vertex in parts, d: the most edges that a binding of v has within one combination of parts."""
    out = []
    for i, (s, label, t) in enumerate(pattern.edges):
        ends = {s: "src", t: "dest"}
        hs = [(hash_part(F.col(ends[v]), parts[v]) if v in ends else F.lit(None)).cast("int").alias(f"h{v}") for v in sorted(parts)]
        for v in ends:
            if any(v in pattern.ends(1 << j) for j in range(pattern.size) if j != i):
                out.append(edges.where(F.col("label") == label).select(F.lit(i).alias("edge"), F.lit(v).alias("v"), F.col(ends[v]).alias("at"), *hs))
    key = ["edge", "v", *[f"h{v}" for v in sorted(parts)]]
    return reduce(DataFrame.unionByName, out).groupBy(*key, "at").agg(F.count("*").alias("d")).groupBy(*key).agg(F.max("d").alias("d"))


def by_combo(edges: DataFrame, pattern: Pattern, masks, parts: dict[int, int], degrees: bool = False) -> list[tuple[dict, dict]]:
    """(counts by mask, greatest degrees by (base edge, added edge)) of every combination of parts; what a combination lacks is 0.

    The product of the parts is the budget of combinations, so what is collected does not grow with the graph.
    """
    order = sorted(parts)
    found = {(r["mask"], tuple(r[f"h{v}"] for v in order)): r["c"] for r in combo_counts(edges, pattern, masks, parts).collect()}
    degree = {(r["edge"], r["v"], tuple(r[f"h{v}"] for v in order)): r["d"] for r in combo_degrees(edges, pattern, parts).collect()} if degrees else {}
    out = []
    for combo in itertools.product(*[range(parts[v]) for v in order]):
        at = lambda ends: tuple(h if v in ends else None for v, h in zip(order, combo, strict=True))  # noqa: B023, E731
        cards = {m: found.get((m, at(pattern.ends(m))), 0) for m in masks}
        most = {}
        for j, i in itertools.permutations(range(pattern.size), 2) if degrees else ():
            if shared := pattern.ends(1 << j) & pattern.ends(1 << i):
                most[j, i] = min(degree.get((i, v, at(pattern.ends(1 << i))), 0) for v in shared)
        out.append((cards, most))
    return out
