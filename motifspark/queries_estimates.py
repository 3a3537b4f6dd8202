"""Registered queries of the partitioned, cyclic, sampled and guided estimators, workloads and files of statistics, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .operators import counting as C, stats as S
from .plans import estimate as P, sparql
from .plans.pattern import Pattern
from .queries import _CSETS, CYCLIC5, FORK, NINE, ORACLE, PATH3, STAR3, TREE6, TRIANGLE, _counts_cte, _degree_sql, _dist_sql, _folder, _MEASURE, degrees_of, formula_estimates, qerror_rank, query
from .sources.edges import edges, properties

T = Pattern.parse


def _labels(p: Pattern) -> set[int]:
    return {label for _, label, _ in p.edges}


# ---- parts: every combination of the hash parts of the join vertices is estimated by itself


def _combo_sql(p: Pattern, masks, parts: dict[int, int], degrees: bool = False) -> str:
    """Relation w: a row per combination with c<mask> and, if asked for, g<vertex>_<edge>."""
    ctes, joins, cols = [f"k AS (SELECT * FROM {', '.join(f'range({n}) r{v}(h{v})' for v, n in sorted(parts.items()))})"], [], []

    def add(name, ends, body, column):
        ctes.append(f"{name} AS ({body})")
        joins.append(f"LEFT JOIN {name} USING ({', '.join(f'h{v}' for v in sorted(parts) if v in ends)})")
        cols.append(f"coalesce({column}, 0) AS {column}")

    for m in masks:
        inside = [v for v in sorted(parts) if v in p.ends(m)]
        add(f"t{m}", p.ends(m), C.count_sql(p.sub(m), ", ".join(f"{{v{v}}} % {parts[v]} AS h{v}" for v in inside) + f", count(*) AS c{m}", group=", ".join(f"{{v{v}}} % {parts[v]}" for v in inside)), f"c{m}")
    for i, (s, label, t) in enumerate(p.edges) if degrees else ():
        ends = {s: "src", t: "dest"}
        hs = ", ".join(f"{ends[v]} % {parts[v]} AS h{v}" for v in sorted(parts) if v in ends)
        by = ", ".join(f"h{v}" for v in sorted(parts) if v in ends)
        for v in ends:
            if any(v in p.ends(1 << j) for j in range(p.size) if j != i):
                add(f"u{v}_{i}", ends, f"SELECT {by}, max(n) AS g{v}_{i} FROM (SELECT {ends[v]} AS at, {hs}, count(*) AS n FROM e WHERE label = {label} GROUP BY ALL) GROUP BY ALL", f"g{v}_{i}")
    return f", {', '.join(ctes)}, w AS (SELECT {', '.join(cols)} FROM k {' '.join(joins)})"


FORK_PARTS = {0: 2, 2: 2, 3: 2}
PAIRS, SINGLES = FORK.subsets(2, 2), FORK.subsets(1, 1)


def _pcat_sql() -> str:
    entries = P.entries_of(FORK, 2)
    masks, forms = P.formula_sql(FORK, entries)
    sums = ", ".join(f"sum(CASE WHEN {' AND '.join(f'c{m} > 0' for m in entries)} THEN {x} ELSE 0 END) AS f{k}" for k, (_, x) in enumerate(forms))
    names = [f"f{k}" for k in range(len(forms))]
    return _combo_sql(FORK, masks, FORK_PARTS) + f" SELECT round(least({', '.join(names)}), 3) AS est_min, round(greatest({', '.join(names)}), 3) AS est_max, round(({' + '.join(names)}) / {len(names)}, 3) AS est_avg FROM (SELECT {sums} FROM w)"


@query(_pcat_sql())
def pcat_formulas(spark, d):
    """Optimistic estimates by formula, summed over the combinations of hash parts."""
    entries = P.entries_of(FORK, 2)
    combos = C.by_combo(edges(spark, d, _labels(FORK)), FORK, sorted(P.overlaps(FORK, entries)), FORK_PARTS)
    out = P.per_formula(FORK, [cards for cards, _ in combos], entries)
    return spark.createDataFrame([tuple(round(out[k], 3) for k in ("min", "max", "avg"))], "est_min double, est_max double, est_avg double")


def _touching(p: Pattern, a: int, i: int) -> list[int]:
    return [j for j in range(p.size) if a >> j & 1 and p.ends(1 << j) & p.ends(1 << i)]


def _path_sums_sql(p: Pattern, least: int, step) -> list[str]:
    out = []
    for path in P.lattice_paths(p, least):
        expr = f"CAST(c{path[0]} AS DOUBLE)"
        for a, b in zip(path, path[1:]):
            i = (a ^ b).bit_length() - 1
            expr += f" * {step(_touching(p, a, i), i)}"
        out.append(f"sum({expr})")
    return out


def _ratio_sql(pick: str):
    return lambda js, i: f"{pick}({', '.join(f'CASE WHEN c{1 << j} = 0 THEN 0 ELSE c{1 << i | 1 << j} / CAST(c{1 << j} AS DOUBLE) END' for j in js)}, {'1e300' if pick == 'least' else '0'})"


@query(_combo_sql(FORK, SINGLES + PAIRS, FORK_PARTS) + f" SELECT round(least({', '.join(_path_sums_sql(FORK, 2, _ratio_sql('least')))}), 3) AS est_min, round(greatest({', '.join(_path_sums_sql(FORK, 2, _ratio_sql('greatest')))}), 3) AS est_max FROM w")
def ceg_optimistic(spark, d):
    """Least and greatest sum over the orders of adding edges; a step multiplies by the least or greatest ratio over the base edges it touches."""
    combos = C.by_combo(edges(spark, d, _labels(FORK)), FORK, SINGLES + PAIRS, FORK_PARTS)

    def ratio(pick):
        return lambda cards, _, js, i: pick(cards[1 << i | 1 << j] / cards[1 << j] if cards[1 << j] else 0.0 for j in js)

    return spark.createDataFrame([(round(min(P.per_path(FORK, combos, ratio(min))), 3), round(max(P.per_path(FORK, combos, ratio(max))), 3))], "est_min double, est_max double")


def _degree_pick(p: Pattern):
    return lambda js, i: "least(" + ", ".join(f"g{v}_{i}" for j in js for v in sorted(p.ends(1 << j) & p.ends(1 << i))) + ", 9007199254740992)"


@query(_combo_sql(FORK, PAIRS, FORK_PARTS, True) + f" SELECT CAST(least({', '.join(_path_sums_sql(FORK, 2, _degree_pick(FORK)))}) AS BIGINT) AS bound FROM w")
def ceg_pessimistic_parts(spark, d):
    """Least sum over the orders of adding edges, of counts times greatest degrees within each combination."""
    combos = C.by_combo(edges(spark, d, _labels(FORK)), FORK, PAIRS, FORK_PARTS, True)
    return spark.createDataFrame([(min(P.per_path(FORK, combos, lambda _, degree, js, i: min(degree[j, i] for j in js))),)], "bound long")


STAR_PARTS = {0: 4}


@query(_combo_sql(STAR3, STAR3.subsets(2, 2), STAR_PARTS, True) + f" SELECT CAST(sum(least({', '.join(x[4:-1] for x in _path_sums_sql(STAR3, 2, _degree_pick(STAR3)))})) AS BIGINT) AS bound FROM w")
def cllp_partitioned(spark, d):
    """The linear program of each hash part of the centre, summed."""
    combos = C.by_combo(edges(spark, d, _labels(STAR3)), STAR3, STAR3.subsets(2, 2), STAR_PARTS, True)
    return spark.createDataFrame([(sum(P.lp_bound(STAR3, cards, degree) for cards, degree in combos),)], "bound long")


# ---- cycles

_TRI = CYCLIC5.triangles()[0]
_SIDES = [i for i in range(CYCLIC5.size) if _TRI >> i & 1]


def _closing_sql() -> str:
    """The most triangles of each side, as z<edge>."""
    tri = CYCLIC5.sub(_TRI)
    out = []
    for i in _SIDES:
        s, _, t = CYCLIC5.edges[i]
        out.append(f"z{i}_ AS (SELECT coalesce(max(n), 0) AS z{i} FROM ({C.count_sql(tri, 'count(*) AS n', group=f'{{v{s}}}, {{v{t}}}')}))")
    return ", ".join(out)


def _cyclic_bound_sql() -> str:
    parts = {(j, i) for j in range(CYCLIC5.size) for i in range(CYCLIC5.size) if i != j and CYCLIC5.ends(1 << j) & CYCLIC5.ends(1 << i)}
    exprs, open_ = [], [(m, f"CAST(c{m} AS BIGINT)") for m in CYCLIC5.subsets(2, 2)]
    while open_:
        m, expr = open_.pop()
        if m == CYCLIC5.full:
            exprs.append(expr)
            continue
        for i in range(CYCLIC5.size):
            if not m >> i & 1 and (js := [j for j in range(CYCLIC5.size) if m >> j & 1 and (j, i) in parts]):
                open_.append((m | 1 << i, expr + " * least(" + ", ".join(f"d{j}_{i}" for j in js) + ", 9007199254740992)"))
        for j in _SIDES:
            if m >> j & 1 and _TRI & ~m:
                open_.append((m | _TRI, f"{expr} * z{j}"))
    tables = [f"t{m}" for m in CYCLIC5.subsets(2, 2)] + [f"m{j}_{i}" for j, i in sorted(parts)] + [f"z{i}_" for i in _SIDES]
    return f"{_counts_cte(CYCLIC5, CYCLIC5.subsets(2, 2))}, {_degree_sql(CYCLIC5)}, {_closing_sql()} SELECT least({', '.join(exprs)}) AS bound FROM {', '.join(tables)}"


@query(_cyclic_bound_sql())
def cllp_cyclic(spark, d):
    """The linear program with arcs that add the two other sides of a triangle by the most triangles on one."""
    e = edges(spark, d, _labels(CYCLIC5))
    tri = CYCLIC5.sub(_TRI)
    most = [C.project_counts(e, tri, keep=sorted(CYCLIC5.ends(1 << i))).agg(F.coalesce(F.max("c"), F.lit(0)).alias("m")).select(F.lit(i).alias("i"), "m") for i in _SIDES]
    closing = {(r.i, _TRI ^ 1 << r.i): r.m for r in reduce(DataFrame.unionByName, most).collect()}
    return spark.createDataFrame([(P.lp_bound(CYCLIC5, C.catalogue_of(e, CYCLIC5, CYCLIC5.subsets(2, 2)), degrees_of(e, CYCLIC5), closing),)], "bound long")


@query(_counts_cte(TRIANGLE, [1, 2, 4]) + " SELECT round(sqrt(CAST(c1 AS DOUBLE)) * sqrt(CAST(c2 AS DOUBLE)) * sqrt(CAST(c4 AS DOUBLE)), 3) AS bound FROM t1, t2, t4")
def sqrt_bound(spark, d):
    """The product of the square roots of a triangle's edge counts, which bounds its count."""
    cards = C.catalogue_of(edges(spark, d, _labels(TRIANGLE)), TRIANGLE, [1, 2, 4])
    value = 1.0
    for m in (1, 2, 4):
        value *= cards[m] ** 0.5
    return spark.createDataFrame([(round(value, 3),)], "bound double")


def _closing_formulas():
    """(hops, SQL) of every formula over two-edge entries whose last side of the triangle is added by the triangle's share of its 2-paths."""
    entries, out = P.entries_of(CYCLIC5, 2), []
    open_ = [(m, 1, f"CAST(c{m} AS DOUBLE)") for m in entries]
    while open_:
        m, hops, expr = open_.pop()
        if m == CYCLIC5.full:
            out.append((hops, expr))
            continue
        for x in entries:
            if 0 < (x & m).bit_count() < x.bit_count():
                new = x & ~m
                top, bottom = (_TRI, _TRI ^ new) if new & _TRI and not _TRI & ~(m | new) else (x, x & m)
                open_.append((m | x, hops + 1, f"{expr} * (CASE WHEN c{top} = 0 OR c{bottom} = 0 THEN 0 ELSE c{top} / CAST(c{bottom} AS DOUBLE) END)"))
    return out


def _nine_of(rows: str) -> str:
    parts = [f"round({a}(est) FILTER ({cond}), 3) AS {k}_{a}" for k, cond in (("all", "true"), ("min_hop", "h = lo"), ("max_hop", "h = hi")) for a in ("min", "max", "avg")]
    return f", f AS ({rows}), g AS (SELECT *, min(h) OVER () AS lo, max(h) OVER () AS hi FROM f) SELECT {', '.join(parts)} FROM g"


_CLOSE_MASKS = sorted({*CYCLIC5.subsets(1, 2), _TRI})


@query(_counts_cte(CYCLIC5, _CLOSE_MASKS) + _nine_of(" UNION ALL ".join(f"SELECT {h} AS h, {x} AS est FROM {', '.join(f't{m}' for m in _CLOSE_MASKS)}" for h, x in _closing_formulas())))
def cyclic_triangle_closing_9(spark, d):
    """A step that closes a triangle multiplies by its count over that of the two sides covered."""
    entries = P.entries_of(CYCLIC5, 2)
    cards = C.catalogue_of(edges(spark, d, _labels(CYCLIC5)), CYCLIC5, _CLOSE_MASKS)

    def rate(covered, x):
        two = _TRI & ~(x & ~covered)
        return cards[_TRI] / cards[two] if cards[two] else 0.0

    out = P.closings(CYCLIC5, cards, entries, rate)
    return spark.createDataFrame([tuple(round(out[x], 3) for x in P.NINE)], NINE)


STARTS = 20


def _walk_sql(steps: int, name: str) -> str:
    """CTEs of the walks from sampled edges of label 4 to the targets of label 3; relation <name>: walks, closed."""
    out = [f"{name}0 AS (SELECT src AS a, dest AS v, 1::BIGINT AS n FROM e WHERE label = 4 ORDER BY (src * 31 + dest) * 7919 % 1000003, src, dest LIMIT {STARTS})"]
    out += [f"{name}{k + 1} AS (SELECT a, w AS v, CAST(sum(n) AS BIGINT) AS n FROM {name}{k} JOIN b USING (v) GROUP BY ALL)" for k in range(steps)]
    out.append(f"{name} AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS walks, CAST(coalesce(sum(n * m), 0) AS BIGINT) AS closed FROM (SELECT a, e.src AS z, sum(n) AS n FROM {name}{steps} q JOIN e ON e.label = 3 AND e.dest = q.v GROUP BY ALL) LEFT JOIN (SELECT src AS a, dest AS z, count(*) AS m FROM e WHERE label = 6 GROUP BY ALL) USING (a, z))")
    return ", ".join(out)


_CYCLES = {4: 1, 5: 2, 6: 3}
_SHARES = {4: 1, 5: 1, 6: 5}
_B = "b AS (SELECT src AS v, dest AS w FROM e UNION ALL SELECT dest, src FROM e)"


@query(f", {_B}, {', '.join(_walk_sql(s, f'w{k}_') for k, s in _CYCLES.items())} " + " UNION ALL ".join(f"SELECT {k} AS cycle, walks, closed, CASE WHEN walks = 0 THEN 0 ELSE CAST(closed AS DOUBLE) / walks END AS rate FROM w{k}_" for k in _CYCLES))
def closing_rates(spark, d):
    """Share of the walks of a sample of start edges that the closing label closes, for cycles of 4, 5 and 6 edges."""
    e = edges(spark, d)
    rows = [S.closing_rate(e, 4, 6, 3, s, STARTS).select(F.lit(k).alias("cycle"), "walks", "closed") for k, s in _CYCLES.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("rate", F.when(F.col("walks") == 0, 0.0).otherwise(F.col("closed").cast("double") / F.col("walks")))


_WALK3 = T("0-1;1-2;3-2", "4->1->3")


@query(f", {_B}, {', '.join(_walk_sql(s, f'w{k}_') for k, s in _CYCLES.items())}, t AS ({C.count_sql(_WALK3, 'count(*) AS c')}), r AS ({' UNION ALL '.join(f'SELECT {_SHARES[k]} / 7.0::DOUBLE * CASE WHEN walks = 0 THEN 0 ELSE CAST(closed AS DOUBLE) / walks END AS x FROM w{k}_' for k in _CYCLES)}) SELECT round(max(c) * sum(x), 3) AS estimate FROM t, r")
def cyclic_extension_rate(spark, d):
    """The 4-cycle as its 3-path times the weighted sampled closing rate (4, 5 and 6 edges weigh 1, 1 and 5)."""
    rate = F.sum(F.col("rate") * F.element_at(F.create_map(*[F.lit(x) for k, n in _SHARES.items() for x in (k, n / 7)]), F.col("cycle")))
    total = closing_rates(spark, d).agg(rate.alias("x"))
    return C.count_pattern(edges(spark, d, {1, 3, 4}), _WALK3).crossJoin(F.broadcast(total)).select(F.round(F.col("c") * F.col("x"), 3).alias("estimate"))


# ---- formulas chosen by the entropy of their steps

_CHOICE = [(seq, steps) for seq, steps in P.steps_of(FORK, P.entries_of(FORK, 2)) if len(seq) == max(len(s) for s, _ in P.steps_of(FORK, P.entries_of(FORK, 2)))]
_STEPS = sorted({x for _, steps in _CHOICE for x in steps})


def _entropy_sql() -> str:
    ctes = [f"n{b}_{x} AS (SELECT coalesce(entropy, 0) AS n{b}_{x} FROM ({_MEASURE.format(_dist_sql(FORK, b, x))}))" for b, x in _STEPS]
    masks, _ = P.formula_sql(FORK, P.entries_of(FORK, 2))
    forms = dict(zip([s for s, _ in P.formulas(FORK, dict.fromkeys(P.overlaps(FORK, P.entries_of(FORK, 2)), 1), P.entries_of(FORK, 2))], [x for _, x in P.formula_sql(FORK, P.entries_of(FORK, 2))[1]], strict=True))
    rows = []
    for seq, steps in _CHOICE:
        names = [f"n{b}_{x}" for b, x in steps]
        for rule, score in (("mean", f"({' + '.join(names)}) / {len(names)}"), ("sum", " + ".join(names)), ("max", f"greatest({', '.join(names)})")):
            rows.append(f"SELECT '{rule}' AS rule, '{'.'.join(map(str, seq))}' AS formula, round({forms[seq]}, 3) AS est, round({score}, 5) AS score FROM {', '.join(f't{m}' for m in masks)}, {', '.join(f'n{b}_{x}' for b, x in _STEPS)}")
    return f"{_counts_cte(FORK, masks)}, {', '.join(ctes)}, f AS ({' UNION ALL '.join(rows)}) SELECT rule, formula, est, score FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score, formula) AS k FROM f) WHERE k = 1"


@query(_entropy_sql())
def entropy_choice(spark, d):
    """Of the longest formulas, the one whose steps' extension distributions have the least mean, summed or greatest entropy."""
    e, entries = edges(spark, d, _labels(FORK)), P.entries_of(FORK, 2)
    measured = [S.distribution_measures(C.extension_distribution(e, FORK, b, x)).select(F.lit(b).alias("b"), F.lit(x).alias("x"), F.coalesce("entropy", F.lit(0.0)).alias("entropy")) for b, x in _STEPS]
    entropy = {(r.b, r.x): r.entropy for r in reduce(DataFrame.unionByName, measured).collect()}
    est = dict(P.formulas(FORK, C.catalogue_of(e, FORK, sorted(P.overlaps(FORK, entries))), entries))
    rows = []
    for rule, score in (("mean", lambda n: sum(n) / len(n)), ("sum", sum), ("max", max)):
        value, formula, seq = min((round(score([entropy[x] for x in steps]), 5), ".".join(map(str, seq)), seq) for seq, steps in _CHOICE)
        rows.append((rule, formula, round(est[seq], 3), value))
    return spark.createDataFrame(rows, "rule string, formula string, est double, score double")


@query(f"SELECT min(q_error) AS p_star, max(CASE WHEN k = 1 THEN rank END) AS max_max_rank FROM (SELECT formula, q_error, rank, row_number() OVER (ORDER BY hops DESC, est DESC, formula) AS k FROM ({ORACLE['formula_estimates']}) JOIN ({ORACLE['qerror_rank']}) USING (formula))")
def p_star(spark, d):
    """The best q-error of all formulas, and the rank of the greatest estimate among the longest ones."""
    both = formula_estimates(spark, d).join(qerror_rank(spark, d), "formula")
    last = F.max_by("rank", F.struct("hops", "est"))
    return both.agg(F.min("q_error").alias("p_star"), last.alias("max_max_rank"))


# ---- characteristic sets and path tables

_SETS = ", g AS (SELECT src, label, count(*) AS d FROM e GROUP BY ALL), a AS (SELECT src, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS ls FROM g GROUP BY src), star AS (SELECT sum(n) AS centres, sum(n * (s4 / n) * (s6 / n)) AS estimate FROM (SELECT ls, CAST(count(DISTINCT src) AS DOUBLE) AS n, sum(d) FILTER (label = 4) AS s4, sum(d) FILTER (label = 6) AS s6 FROM g JOIN a USING (src) GROUP BY ls) WHERE s4 > 0 AND s6 > 0)"


@query(_SETS + ", v AS (SELECT src AS v FROM e UNION SELECT dest FROM e), both_ AS (SELECT count(*) AS n FROM (SELECT dest AS v FROM e WHERE label = 6 INTERSECT SELECT src FROM e WHERE label = 3)) SELECT round(estimate * (SELECT count(*) FROM e WHERE label = 3) * n / (SELECT count(*) FROM v), 6) AS estimate FROM star, both_")
def cset_peel(spark, d):
    """The largest star by characteristic sets, then the edge that is left by its count, times the share of vertices that can be where they join."""
    e = edges(spark, d)
    star = S.star_by_sets(e, [4, 6])
    rest = e.where("label = 3").agg(F.count("*").alias("rest"))
    ends = e.where("label = 6").select(F.col("dest").alias("v")).intersect(e.where("label = 3").select(F.col("src").alias("v"))).agg(F.count("*").alias("joint"))
    whole = star.crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(S.graph_stats(e).select("n_vertices")))
    return whole.select(F.round(F.col("estimate") * F.col("rest") * F.col("joint") / F.col("n_vertices"), 6).alias("estimate"))


_HYBRID = T("0-1;0-2;2-3", "4->6->3")


@query(_SETS + _counts_cte(_HYBRID, [2, 3, 6, 7]).replace(", t2", ", t2", 1) + " SELECT round(least(estimate * c7 / c3, estimate * c6 / c2), 6) AS est_min, round(greatest(estimate * c7 / c3, estimate * c6 / c2), 6) AS est_max FROM star, t2, t3, t6, t7")
def cset_mt(spark, d):
    """A star by characteristic sets, extended by an edge through the ratios of 2- and 3-path counts."""
    e = edges(spark, d)
    cards = C.catalogue_of(e, _HYBRID, [2, 3, 6, 7])
    ways = [F.col("estimate") * cards[top] / F.lit(float(cards[bottom] or 1)) for top, bottom in ((7, 3), (6, 2))]
    return S.star_by_sets(e, [4, 6]).select(F.round(F.least(*ways), 6).alias("est_min"), F.round(F.greatest(*ways), 6).alias("est_max"))


_TWO = "SELECT x.label AS a, y.label AS b, count(*) AS n FROM e x JOIN e y ON x.dest = y.src GROUP BY ALL"
KEEP = 3


def _pairs(spark, d) -> DataFrame:
    labels = F.split("label_seq", "->")
    return C.count_shape(edges(spark, d), "0-1;1-2").select(labels[0].cast("int").alias("a"), labels[1].cast("int").alias("b"), F.col("card").alias("n"))


@query(f", t AS ({_TWO}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS k FROM t), f AS (SELECT a, CAST(sum(n) AS BIGINT) AS n, count(*) AS m FROM r WHERE k > {KEEP} GROUP BY a) SELECT a || '/' || b AS entry, CAST(n AS DOUBLE) AS n, CAST(1 AS BIGINT) AS entries FROM r WHERE k <= {KEEP} UNION ALL SELECT CASE WHEN m > 1 THEN a || '/*' ELSE '*/*' END AS entry, CAST(sum(n) AS DOUBLE) / sum(m) AS n, CAST(sum(m) AS BIGINT) AS entries FROM f GROUP BY 1")
def mt_suffix_star(spark, d):
    """The 2-path table with its least frequent entries folded into averages."""
    return S.folded_paths(_pairs(spark, d), KEEP)


@query(", c AS (SELECT src % 4 AS h, count(*) AS c FROM e WHERE label = 3 GROUP BY 1), x AS (SELECT b.src % 4 AS h, count(*) AS x FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 6 AND b.label = 3 GROUP BY 1), y AS (SELECT a.src % 4 AS h, count(*) AS y FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 3 AND b.label = 2 GROUP BY 1) SELECT CAST(sum(ceil(CAST(x AS DOUBLE) * y / c)) AS BIGINT) AS estimate FROM c JOIN x USING (h) JOIN y USING (h)")
def mt_partitioned(spark, d):
    """A 3-path from its windows in each part of the middle edge's source, rounded up and summed."""
    e = edges(spark, d, {2, 3, 6})
    per = lambda p, at, n: C.project_counts(e, p, keep=(at,)).groupBy(C.hash_part(F.col(f"v{at}"), 4).alias("h")).agg(F.sum("c").alias(n))
    j = per(T("0-1", "3"), 0, "c").join(per(T("0-1;1-2", "6->3"), 1, "x"), "h").join(per(T("0-1;1-2", "3->2"), 0, "y"), "h")
    return j.agg(F.sum(F.ceil(F.col("x").cast("double") * F.col("y") / F.col("c"))).cast("bigint").alias("estimate"))


_SAMPLED = "((o.src * 31 + o.dest) * 7919) % 1000003 % 10 = 0"
_MT = T("0-1;0-2;2-3", "5->4->1")


@query(_counts_cte(_MT, [2, 3, 6, 7]) + f", s AS (SELECT avg(CASE WHEN q.year IS NULL OR q.year > 1994 THEN 1.0 ELSE 0.0 END) AS p0, avg(CASE WHEN z.year IS NULL OR z.year <= 25 THEN 1.0 ELSE 0.0 END) AS p1 FROM e o JOIN e k ON k.label = 4 AND k.src = o.src LEFT JOIN p q ON q.vid = o.src LEFT JOIN p z ON z.vid = o.dest WHERE o.label = 5 AND {_SAMPLED}), f AS (SELECT CAST(c7 AS DOUBLE) AS long_, CAST(c3 AS DOUBLE) * c6 / c2 AS short_ FROM t2, t3, t6, t7) SELECT round((long_ + short_) / 2 * p0 * p1, 3) AS est_avg, round(least(long_, short_) * p0 * p1, 3) AS est_min, round(greatest(long_, short_) * p0 * p1, 3) AS est_max FROM s, f")
def mt_filtered(spark, d):
    """A filtered 3-path from its table entry and from its 2-paths, times the share of sampled instances whose vertices pass (without property: pass)."""
    e, props = edges(spark, d, _labels(_MT)), properties(spark, d)
    some = e.alias("o").where("label = 5 AND " + _SAMPLED).select("src", "dest").join(e.where("label = 4").select("src"), "src")
    at = lambda c, y: props.select(F.col("vid").alias(c), F.col("year").alias(y))
    share = lambda y, op, x: F.avg(F.when(C.passes(F.col(y), op, x), 1.0).otherwise(0.0))
    s = some.join(at("src", "y0"), "src", "left").join(at("dest", "y1"), "dest", "left").agg(share("y0", ">", 1994).alias("p0"), share("y1", "<=", 25).alias("p1"))
    cards = C.catalogue_of(e, _MT, [2, 3, 6, 7])
    ways = [float(cards[7]), float(cards[3]) * cards[6] / cards[2] if cards[2] else 0.0]
    est = lambda x: F.round(F.lit(x) * F.col("p0") * F.col("p1"), 3)
    return s.select(est(sum(ways) / 2).alias("est_avg"), est(min(ways)).alias("est_min"), est(max(ways)).alias("est_max"))


_HASHED = "({v}) * 7919 % 104729 % 10 = 0"


@query(f", v AS (SELECT src AS v FROM e UNION SELECT dest FROM e), s AS (SELECT v FROM v WHERE {_HASHED.format(v='v')}), n AS ({C.count_sql(T('0-1;0-2;2-3', '4->6->3'), 'count(*) AS n', _HASHED.format(v='{v0}'))}) SELECT round(CAST(n AS DOUBLE) * (SELECT count(*) FROM v) / (SELECT count(*) FROM s), 6) AS estimate FROM n")
def leaf_sampling(spark, d):
    """Trees around sampled vertices, scaled by all vertices over sampled ones; the tree is counted from its leaves to the centre."""
    e = edges(spark, d)
    vertices = e.select(F.explode(F.array("src", "dest")).alias("v")).distinct()
    sizes = vertices.agg(F.count("*").alias("every"), F.count_if(F.expr(_HASHED.format(v="v"))).alias("some"))
    near = C.project_counts(e.where(F.expr(_HASHED.format(v="src")) | (F.col("label") == 3)), T("0-1;0-2;2-3", "4->6->3"), keep=(0,))
    total = near.where(_HASHED.format(v="v0")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"))
    return total.crossJoin(F.broadcast(sizes)).select(F.round(F.col("t").cast("double") * F.col("every") / F.col("some"), 6).alias("estimate"))


# ---- samples by place, workloads, plans with injected estimates

STEP = 1000


@query(f", u AS (SELECT label, src, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY label ORDER BY src) AS BIGINT) AS upto FROM u), o AS (SELECT label, unnest(range(0, CAST(max(upto) AS BIGINT), {STEP})) AS place FROM w GROUP BY label) SELECT label, place, src FROM o JOIN w USING (label) WHERE place >= upto - n AND place < upto")
def sample_offsets(spark, d):
    """The source of every thousandth edge of each label, found by running counts."""
    return S.at_offsets(edges(spark, d), STEP)


_SHAPES = ("0-1;1-2;2-3", "0-1;0-2;0-3", "0-1;0-2;2-3")


def _seq_sql(shape: str) -> str:
    n = shape.count(";") + 1
    at, conds = {}, []
    for i, ends in enumerate(shape.split(";")):
        for v, c in zip(ends.split("-"), ("src", "dest"), strict=True):
            if v in at:
                conds.append(f"{at[v]} = e{i}.{c}")
            at.setdefault(v, f"e{i}.{c}")
    return f"SELECT '{shape}' AS vlist, {' || '.join((chr(39) + '->' + chr(39) + ' || ' if i else '') + f'e{i}.label' for i in range(n))} AS label_seq, {' + '.join(f'e{i}.label * {7 * i + 5}' for i in range(n))} AS h, count(*) AS card FROM {', '.join(f'e e{i}' for i in range(n))} WHERE {' AND '.join(conds)} GROUP BY ALL"


@query(" , ".join(["", *[f"q{k} AS (SELECT vlist, label_seq, card FROM ({_seq_sql(s)}) ORDER BY h % 11, label_seq LIMIT 20)" for k, s in enumerate(_SHAPES)]]) + " " + " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(len(_SHAPES))))
def workload(spark, d):
    """Twenty label sequences of each shape that have instances, in the order of a hash, with their counts (a sampling operator: twenty is its feature)."""
    e, out = edges(spark, d), []
    for shape in _SHAPES:
        labels = F.split("label_seq", "->")
        h = sum((labels[i].cast("int") * (7 * i + 5) for i in range(shape.count(";") + 1)), F.lit(0))
        out.append(C.count_shape(e, shape).orderBy(h % 11, "label_seq").limit(20))
    return reduce(DataFrame.unionByName, out)


@query(" UNION ALL ".join(_seq_sql(s).replace(f"{' + '.join(f'e{i}.label * {7 * i + 5}' for i in range(s.count(';') + 1))} AS h, ", "") for s in ("0-1;0-2;1-2",)))
def cyclic_workload(spark, d):
    """All label sequences of the triangle that have instances."""
    return C.count_shape(edges(spark, d), "0-1;0-2;1-2")


@query(C.count_sql(TREE6, "count(*) AS n"))
def plan_estimated(spark, d):
    """Answers counted by joins in the order that injected estimates choose: only one- and two-edge counts are taken."""
    e = edges(spark, d, _labels(TREE6))
    cards = P.extended(TREE6, C.catalogue_of(e, TREE6, TREE6.subsets(1, 2)))
    order, _ = P.join_order(TREE6, cards.__getitem__)
    text = "select ?v0 where { " + " . ".join(f"?v{s} <{label}> ?v{t}" for s, label, t in TREE6.edges) + " . }"
    return sparql.run(e, text, order=order).agg(F.count("*").alias("n"))


# ---- files of statistics


@query(" UNION ALL ".join(f"SELECT {b} AS base, {x} AS ext, ext_size, n FROM ({_dist_sql(PATH3, b, x)})" for b, x in ((1, 2), (3, 4))))
def dist_load(spark, d):
    """Extension distributions written and read back."""
    e, home = edges(spark, d, _labels(PATH3)), _folder(spark)
    parts = [C.extension_distribution(e, PATH3, b, x).select(F.lit(b).alias("base"), F.lit(x).alias("ext"), "ext_size", "n") for b, x in ((1, 2), (3, 4))]
    reduce(DataFrame.unionByName, parts).write.parquet(home)
    return spark.read.parquet(home)


@query(_CSETS + " SELECT out_labels, in_labels, n FROM sets")
def cset_load(spark, d):
    """Characteristic sets written and read back."""
    home = _folder(spark)
    S.characteristic_sets(edges(spark, d)).select("out_labels", "in_labels", "n").write.parquet(home)
    return spark.read.parquet(home)


@query(_TWO.join((", t AS (", ") SELECT a, b, n FROM t")))
def mt_load(spark, d):
    """The 2-path table written and read back."""
    home = _folder(spark)
    _pairs(spark, d).write.parquet(home)
    return spark.read.parquet(home)


@query("SELECT CAST(src % 4 AS INTEGER) AS part, label, count(*) AS n FROM e GROUP BY ALL")
def part_sink(spark, d):
    """The graph written in a folder per part and label, and read back by them."""
    home = _folder(spark)
    edges(spark, d).withColumn("part", C.hash_part(F.col("src"), 4).cast("int")).repartition("part", "label").write.partitionBy("part", "label").parquet(home)
    return spark.read.parquet(home).groupBy("part", "label").agg(F.count("*").alias("n"))
