"""The registered graph queries and their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window, functions as F

from .functions.scalar import hash_part
from .operators import counting as C, stats as S
from .plans import estimate as P, sparql
from .plans.pattern import Pattern, base_and_extensions, parse_query
from .sources.edges import EDGE_SQL, PROPS_SQL, edges, merge_catalogues, ntriples, properties, random_graph, read_catalogue, read_max_degrees, shuffle_labels, write_catalogue, write_max_degrees

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WITH = f"WITH e AS ({EDGE_SQL}), p AS ({PROPS_SQL})"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = WITH + " " + sql
        return f

    return put


def counted(name: str, pattern: Pattern, filters: dict | None = None, bound: dict | None = None) -> None:
    """Registers an exact count of one pattern."""
    conds = [f"coalesce((SELECT year {op} {x} FROM p WHERE vid = {{v{v}}}), true)" for v, (op, x) in (filters or {}).items()] + [f"{{v{v}}} = {x}" for v, x in (bound or {}).items()]

    def run(spark, d):
        e = edges(spark, d, {label for _, label, _ in pattern.edges})
        return C.count_pattern(e, pattern, props=properties(spark, d) if filters else None, filters=filters, bound=bound).select(F.col("c").cast("bigint").alias("n"))

    query(C.count_sql(pattern, "count(*) AS n", " AND ".join(conds)), name)(run)


T = Pattern.parse
PATH3, STAR3, FORK = T("0-1;1-2;2-3", "4->1->2"), T("0-1;0-2;0-3", "4->5->6"), T("0-1;0-2;2-3;4-3", "4->6->3->1")
TRIANGLE, SQUARE = T("0-1;0-2;1-2", "5->6->7"), T("0-1;0-3;1-2;3-2", "4->6->1->3")
CYCLIC5 = T("0-1;0-2;1-2;2-3", "5->6->7->3")

counted("path_count_3", PATH3)
counted("star_count_3", STAR3)
counted("fork_count", T("0-1;0-2;2-3;4-3", "4->6->3->1"))
counted("triangle_count", TRIANGLE)
counted("four_cycle_count", SQUARE)
counted("path_closure_count", T("0-1;1-2;3-2", "5->7->6").fused())
counted("square_diag", T("0-1;0-2;1-2;3-1;3-2", "5->6->7->5->6"))
counted("bow_tie", T("0-1;0-2;1-2;0-3;0-4;3-4", "5->6->7->5->6->7"))
counted("lollipop", T("0-1;0-2;1-2;2-3;3-4", "5->6->7->3->2"))
counted("tree_count_4", T("0-1;0-2;2-3;3-4", "5->6->3->2"))
counted("tree_count_6", T("0-1;0-2;0-3;1-4;4-5;3-6", "4->5->6->1->2->3"))
counted("filtered_tree_count", T("0-1;0-2;2-3", "4->5->7"), {0: (">", 1994), 2: ("<=", 25)})
counted("filtered_path_count", PATH3, {0: (">=", 1995), 1: ("<", 3)})
counted("bound_path_count", PATH3, bound={2: 2 * 10**9 + 3})
counted("repeated_label_path", T("0-1;2-1;2-3", "6->6->6"))


@query("SELECT label, count(*) AS n, sum(src % 1000003) AS src_sum, sum(dest % 1000003) AS dest_sum FROM e GROUP BY label".replace("sum(src % 1000003)", "CAST(sum(src % 1000003) AS BIGINT)").replace("sum(dest % 1000003)", "CAST(sum(dest % 1000003) AS BIGINT)"))
def edge_scan(spark, d):
    return edges(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("src") % 1000003).alias("src_sum"), F.sum(F.col("dest") % 1000003).alias("dest_sum"))


@query("SELECT vid, year FROM p")
def vertex_props(spark, d):
    return properties(spark, d)


LINES = ("0-1;1-2;2-3,4->1->2,15000", "0-1;0-2;0-3,4->5->6,291508", "10-11;2-3,5->6,1")


@query("SELECT * FROM (VALUES ('0-1;1-2;2-3', '4->1->2', 3, 'path', 15000), ('0-1;0-2;0-3', '4->5->6', 3, 'star', 291508), ('10-11;2-3', '5->6', 2, 'disconnected', 1)) t(vlist, label_seq, n_edges, shape, true_card)")
def query_parse(spark, d):
    rows = [(p.vlist, p.label_seq, p.size, p.shape, n) for p, n in map(parse_query, LINES)]
    return spark.createDataFrame(rows, "vlist string, label_seq string, n_edges int, shape string, true_card int")


@query("SELECT '<' || src || '> <' || label || '> <' || dest || '> .' AS line FROM e")
def ntriples_sink(spark, d):
    return ntriples(edges(spark, d))


@query("SELECT vlist, label_seq, card FROM (SELECT '0-1' AS vlist, CAST(label AS VARCHAR) AS label_seq, count(*) AS card FROM e GROUP BY label)")
def cat_size1(spark, d):
    return C.count_shape(edges(spark, d), "0-1")


TWO = {"0-1;0-2": "a.src = b.src", "0-1;1-2": "a.dest = b.src", "0-1;2-1": "a.dest = b.dest"}
_DEG = "o AS (SELECT src AS v, label, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT dest AS v, label, count(*) AS n FROM e GROUP BY ALL)"
_TWO_SQL = " UNION ALL ".join(f"SELECT '{v}' AS vlist, a.label || '->' || b.label AS label_seq, CAST(sum(a.n * b.n) AS BIGINT) AS card FROM {x} a JOIN {y} b USING (v) GROUP BY a.label, b.label" for v, (x, y) in {"0-1;0-2": "oo", "0-1;1-2": "io", "0-1;2-1": "ii"}.items())


@query(f", {_DEG} {_TWO_SQL}".lstrip())
def cat_size2(spark, d):
    e = edges(spark, d)
    out = C.count_shape(e, "0-1;0-2")
    for v in ("0-1;1-2", "0-1;2-1"):
        out = out.unionByName(C.count_shape(e, v))
    return out


ORIENT = tuple(f"{'0-1' if a else '1-0'};{'1-2' if b else '2-1'};{'2-3' if c else '3-2'}" for a in (1, 0) for b in (1, 0) for c in (1, 0))
_O = lambda x, a, b: (f"{x}.src", f"{x}.dest") if int(a) < int(b) else (f"{x}.dest", f"{x}.src")


def _orient_sql(v: str) -> str:
    s = [x.split("-") for x in sorted(v.split(";"))]
    by = {frozenset(x): (i, x) for i, x in enumerate(s)}
    (i0, x0), (i1, x1), (i2, x2) = by[frozenset("01")], by[frozenset("12")], by[frozenset("23")]
    col = lambda x, vertex: "src" if x[0] == vertex else "dest"
    lab = {i0: "a.label", i1: "m.label", i2: "b.label"}
    return f"SELECT '{';'.join('-'.join(x) for x in s)}' AS vlist, {lab[0]} || '->' || {lab[1]} || '->' || {lab[2]} AS label_seq, CAST(sum(a.n * b.n) AS BIGINT) AS card FROM e m JOIN {'o' if col(x0, '1') == 'src' else 'i'} a ON a.v = m.{col(x1, '1')} JOIN {'o' if col(x2, '2') == 'src' else 'i'} b ON b.v = m.{col(x1, '2')} GROUP BY a.label, m.label, b.label"


@query(f", {_DEG} " + " UNION ALL ".join(map(_orient_sql, ORIENT)))
def path3_orient(spark, d):
    e = edges(spark, d)
    out = None
    for v in ORIENT:
        part = C.count_shape(e, ";".join(sorted(v.split(";"))))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT CAST(a.label AS VARCHAR) || '->' || b.label || '->' || c.label AS labels FROM e a JOIN e b ON a.dest = b.src JOIN e c ON b.dest = c.src GROUP BY a.label, b.label, c.label")
def label_paths(spark, d):
    """Distinct label sequences of 3-paths; the frontier keeps (vertex, labels) only."""
    e = edges(spark, d)
    front = e.select("dest", F.col("label").cast("string").alias("labels")).distinct()
    for _ in range(2):
        front = front.withColumnRenamed("dest", "v").join(e, F.col("v") == F.col("src")).select("dest", F.concat_ws("->", "labels", F.col("label").cast("string")).alias("labels")).distinct()
    return front.select("labels").distinct()


@query("SELECT count(*) AS n FROM e a WHERE label = 5 AND EXISTS (SELECT 1 FROM e b WHERE b.label = 6 AND b.src = a.src)")
def triple_exists(spark, d):
    e = edges(spark, d, {5, 6})
    return e.where("label = 5").join(e.where("label = 6").select("src"), "src", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT dest AS v FROM e WHERE label = 4 AND dest IN (SELECT src FROM e WHERE label = 1)")
def starters(spark, d):
    e = edges(spark, d, {1, 4})
    return e.where("label = 4").select(F.col("dest").alias("v")).distinct().join(e.where("label = 1").select(F.col("src").alias("v")), "v", "left_semi")


@query("SELECT e.src, e.label, e.dest FROM e LEFT JOIN p ON p.vid = e.src WHERE e.label IN (1, 4) AND (p.year IS NULL OR p.year < 1995)")
def vertex_filter(spark, d):
    return edges(spark, d, {1, 4}).join(properties(spark, d), F.col("src") == F.col("vid"), "left").where(C.passes(F.col("year"), "<", 1995)).select("src", "label", "dest")


@query("SELECT round(avg(CASE WHEN year > 1994 THEN 1.0 ELSE 0 END), 6) AS ratio FROM p WHERE year IS NOT NULL")
def filter_ratio(spark, d):
    return properties(spark, d).where("year IS NOT NULL").agg(F.round(F.avg(F.expr("if(year > 1994, 1D, 0D)")), 6).alias("ratio"))


@query(", v AS (SELECT DISTINCT src AS v FROM e) SELECT round(count(*) FILTER (year > 1994) / count(*), 6) AS ratio FROM v LEFT JOIN p ON v = vid")
def baseline_hist_ratio(spark, d):
    v = edges(spark, d).select(F.col("src").alias("v")).distinct()
    return v.join(properties(spark, d), F.col("v") == F.col("vid"), "left").agg(F.round(F.count_if(F.col("year") > 1994) / F.count("*"), 6).alias("ratio"))


@query(""", o AS (SELECT src, label, count(*) AS d FROM e GROUP BY ALL), i AS (SELECT dest, label, count(*) AS d FROM e GROUP BY ALL),
lo AS (SELECT max(d) FILTER (k = a) AS low, max(d) FILTER (k = b) AS high FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, CAST(floor((count(*) OVER () - 1) * 0.1) AS BIGINT) AS a, CAST(floor((count(*) OVER () - 1) * 0.9) AS BIGINT) AS b FROM o)),
li AS (SELECT max(d) FILTER (k = a) AS low, max(d) FILTER (k = b) AS high FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, CAST(floor((count(*) OVER () - 1) * 0.1) AS BIGINT) AS a, CAST(floor((count(*) OVER () - 1) * 0.9) AS BIGINT) AS b FROM i))
SELECT e.src, e.label, e.dest FROM e JOIN o USING (src, label) JOIN i USING (dest, label), lo, li WHERE o.d BETWEEN lo.low AND lo.high AND i.d BETWEEN li.low AND li.high""")
def degree_cap(spark, d):
    return S.degree_cap(edges(spark, d), 0.1, 0.9)


@query("SELECT src, dest FROM e WHERE label = 3")
def bgp_scan(spark, d):
    return sparql.run(edges(spark, d, {3}), "select ?src ?dest where { ?src <3> ?dest . }")


@query("SELECT src, label, count(*) AS n FROM e GROUP BY ALL")
def agg_scan2(spark, d):
    return edges(spark, d).groupBy("src", "label").agg(F.count("*").alias("n"))


@query("SELECT src, count(*) AS n FROM e GROUP BY ALL")
def agg_scan1(spark, d):
    return edges(spark, d).groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT a.src AS o, b.dest AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1 AND b.dest >= 2000000010")
def sparql_filter(spark, d):
    return sparql.run(edges(spark, d, {1, 4}), "select ?o ?n where { ?o <4> ?c . ?c <1> ?n . filter(?n >= 2000000010) }")


@query("SELECT a.src AS o FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1")
def bgp_project(spark, d):
    return sparql.run(edges(spark, d, {1, 4}), "select ?o where { ?o <4> ?c . ?c <1> ?n . }")


@query("SELECT DISTINCT b.dest AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1")
def sparql_distinct(spark, d):
    return sparql.run(edges(spark, d, {1, 4}), "select distinct ?n where { ?o <4> ?c . ?c <1> ?n . }")


@query("SELECT a.src AS c, b.src AS o FROM e a LEFT JOIN e b ON b.label = 4 AND b.dest = a.src WHERE a.label = 1")
def sparql_optional(spark, d):
    return sparql.run(edges(spark, d, {1, 4}), "select ?c ?o where { ?c <1> ?n . optional { ?o <4> ?c . } }")


@query("SELECT src AS x, dest AS n FROM e WHERE label = 1 UNION ALL SELECT src, dest FROM e WHERE label = 3")
def sparql_union(spark, d):
    return sparql.run(edges(spark, d, {1, 3}), "select ?x ?n where { { ?x <1> ?n . } union { ?x <3> ?n . } }")


@query("SELECT a.src AS s, c.src AS c FROM e a JOIN e c ON a.dest = c.dest WHERE a.label = 3 AND c.label = 1")
def sparql_gjoin(spark, d):
    e = edges(spark, d, {1, 3})
    left, right = sparql.run(e, "select ?s ?n where { ?s <3> ?n . }"), sparql.run(e, "select ?c ?n where { ?c <1> ?n . }")
    return left.join(right, "n").select("s", "c")


_JOIN_SQL = "SELECT a.dest AS c, count(*) AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1 GROUP BY a.dest"


def _hinted(name: str, hint: str) -> None:
    def run(spark, d):
        e = edges(spark, d, {1, 4})
        return sparql.run(e, "select ?c where { ?o <4> ?c . ?c <1> ?n . }", hint=hint).groupBy("c").agg(F.count("*").alias("n"))

    query(_JOIN_SQL, name)(run)


_hinted("join_smj", "merge")
_hinted("join_hash", "shuffle_hash")


@query("SELECT a.src AS n, b.src AS s FROM e a, e b WHERE a.label = 2 AND b.label = 3")
def join_nl(spark, d):
    e = edges(spark, d, {2, 3})
    return e.where("label = 2").select(F.col("src").alias("n")).hint("shuffle_replicate_nl").crossJoin(e.where("label = 3").select(F.col("src").alias("s")))


@query("SELECT src, unnest([src % 10, dest % 10]) AS digit FROM e WHERE label = 3")
def lateral_fn(spark, d):
    e = edges(spark, d, {3})
    return e.select("src", F.explode(F.array(F.col("src") % 10, F.col("dest") % 10)).alias("digit"))


@query(", o AS (SELECT src AS v, label, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT dest AS v, label, count(*) AS n FROM e GROUP BY ALL) SELECT '0-1;2-1' AS vlist, a.label || '->' || b.label AS labels, CAST(sum(a.n * (b.n - CASE WHEN a.label = b.label THEN 1 ELSE 0 END)) AS BIGINT) AS n FROM i a JOIN i b USING (v) GROUP BY a.label, b.label UNION ALL SELECT '0-1;0-2', a.label || '->' || b.label, CAST(sum(a.n * (b.n - CASE WHEN a.label = b.label THEN 1 ELSE 0 END)) AS BIGINT) FROM o a JOIN o b USING (v) GROUP BY a.label, b.label")
def mt3_counts(spark, d):
    """Edge-injective pairs of edges that meet in their targets or sources, of all labels: an edge is not paired with itself."""
    e, out = edges(spark, d), None
    for vlist, end in (("0-1;2-1", "dest"), ("0-1;0-2", "src")):
        deg = e.groupBy(F.col(end).alias("v"), "label").agg(F.count("*").alias("n"))
        a, b = deg.select("v", F.col("label").alias("la"), F.col("n").alias("na")), deg.select("v", F.col("label").alias("lb"), F.col("n").alias("nb"))
        pairs = F.sum(F.col("na") * (F.col("nb") - (F.col("la") == F.col("lb")).cast("bigint")))
        part = a.join(b, "v").groupBy("la", "lb").agg(pairs.alias("n")).select(F.lit(vlist).alias("vlist"), F.concat_ws("->", F.col("la").cast("string"), F.col("lb").cast("string")).alias("labels"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT a.label || '->' || b.label AS labels, 100 * count(*) AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.dest % 100 = 0 GROUP BY a.label, b.label")
def acyclic_mt(spark, d):
    """2-path table from a hundredth of the middle vertices, scaled."""
    e = edges(spark, d)
    i = e.where("dest % 100 = 0").groupBy(F.col("dest").alias("v"), F.col("label").alias("a")).agg(F.count("*").alias("n_in"))
    o = e.where("src % 100 = 0").groupBy(F.col("src").alias("v"), F.col("label").alias("b")).agg(F.count("*").alias("n_out"))
    return i.join(o, "v").groupBy("a", "b").agg((F.sum(F.col("n_in") * F.col("n_out")) * 100).alias("n")).select(F.concat_ws("->", F.col("a").cast("string"), F.col("b").cast("string")).alias("labels"), "n")


@query(", r2 AS (SELECT a.label AS x, b.label AS y, b.dest AS v FROM e a JOIN e b ON a.dest = b.src), r3 AS (SELECT x, y, c.label AS z FROM r2 JOIN e c ON r2.v = c.src) SELECT CAST(label AS VARCHAR) AS labels, count(*) AS n FROM e GROUP BY label UNION ALL SELECT x || '->' || y, count(*) FROM r2 GROUP BY x, y UNION ALL SELECT x || '->' || y || '->' || z, count(*) FROM r3 GROUP BY x, y, z")
def path_mt(spark, d):
    """Counts of all directed paths of one to three edges; the frontier is summed per vertex before each join."""
    e = edges(spark, d)
    front = e.groupBy("dest", F.col("label").cast("string").alias("labels")).agg(F.count("*").alias("n"))
    out = front.groupBy("labels").agg(F.sum("n").alias("n"))
    for _ in range(2):
        front = front.withColumnRenamed("dest", "v").join(e, F.col("v") == F.col("src")).groupBy("dest", F.concat_ws("->", "labels", F.col("label").cast("string")).alias("labels")).agg(F.sum("n").alias("n"))
        out = out.unionByName(front.groupBy("labels").agg(F.sum("n").alias("n")))
    return out


@query("SELECT a.label AS from_label, b.label AS label, count(DISTINCT b.src) AS sources, count(DISTINCT b.dest) AS targets FROM e a JOIN e b ON a.dest = b.src GROUP BY a.label, b.label")
def path_mt_ctx(spark, d):
    """Edges of a label in the context of a label before them: distinct sources and targets."""
    e = edges(spark, d)
    came = e.select(F.col("label").alias("from_label"), F.col("dest").alias("src")).distinct()
    j = came.join(e, "src")
    src = j.select("from_label", "label", "src").distinct().groupBy("from_label", "label").agg(F.count("*").alias("sources"))
    dst = j.select("from_label", "label", "dest").distinct().groupBy("from_label", "label").agg(F.count("*").alias("targets"))
    return src.join(dst, ["from_label", "label"])


@query("SELECT a.src % 4 AS h0, a.dest % 4 AS h1, b.dest % 4 AS h2, count(*) AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1 GROUP BY ALL")
def hash_combs(spark, d):
    """2-path counts per combination of vertex hashes; equal to the product within each middle vertex."""
    e = edges(spark, d, {1, 4})
    a = e.where("label = 4").groupBy(F.col("dest").alias("v"), hash_part(F.col("src"), 4).alias("h0")).agg(F.count("*").alias("x"))
    b = e.where("label = 1").groupBy(F.col("src").alias("v"), hash_part(F.col("dest"), 4).alias("h2")).agg(F.count("*").alias("y"))
    return a.join(b, "v").groupBy("h0", hash_part(F.col("v"), 4).alias("h1"), "h2").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


@query(", v AS (SELECT src AS x FROM e UNION SELECT dest FROM e) SELECT (SELECT count(*) FROM e) AS n_triples, (SELECT count(*) FROM v) AS n_vertices, (SELECT count(DISTINCT label) FROM e) AS n_labels")
def graph_stats(spark, d):
    return S.graph_stats(edges(spark, d))


@query("SELECT label, count(*) AS n FROM e GROUP BY label")
def label_hist(spark, d):
    return edges(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT label, src, count(*) AS n FROM e GROUP BY ALL")
def label_src_hist(spark, d):
    return edges(spark, d).groupBy("label", "src").agg(F.count("*").alias("n"))


@query("SELECT 0 AS direction, label, max(n) AS max_deg FROM (SELECT label, src, count(*) AS n FROM e GROUP BY ALL) GROUP BY label UNION ALL SELECT 1, label, max(n) FROM (SELECT label, dest, count(*) AS n FROM e GROUP BY ALL) GROUP BY label")
def max_degree(spark, d):
    return S.max_degrees(edges(spark, d))


DIST = T("0-1;1-2", "4->1")
_SPLITS = base_and_extensions(STAR3)


def _shared(p, b, x):
    return sorted(p.ends(b) & p.ends(x))


def _dist_sql(p, b, x) -> str:
    keys = _shared(p, b, x)
    cols, on = ", ".join(f"{{v{v}}} AS k{v}" for v in keys), " AND ".join(f"b.k{v} = x.k{v}" for v in keys)
    group = ", ".join(f"{{v{v}}}" for v in keys)
    return f"SELECT coalesce(x.n, 0) AS ext_size, CAST(sum(b.n) AS BIGINT) AS n FROM ({C.count_sql(p.sub(b), cols + ', count(*) AS n', group=group)}) b LEFT JOIN ({C.count_sql(p.sub(x), cols + ', count(*) AS n', group=group)}) x ON {on} GROUP BY 1"


@query(" UNION ALL ".join(f"SELECT '{STAR3.sub(b).vlist}' AS base, '{STAR3.sub(x).vlist}' AS ext, ext_size, n FROM ({_dist_sql(STAR3, b, x)})" for b, x in _SPLITS))
def ext_dist(spark, d):
    """Every base and extension split of a star."""
    e, out = edges(spark, d, {4, 5, 6}), None
    for b, x in _SPLITS:
        part = C.extension_distribution(e, STAR3, b, x).select(F.lit(STAR3.sub(b).vlist).alias("base"), F.lit(STAR3.sub(x).vlist).alias("ext"), "ext_size", "n")
        out = part if out is None else out.unionByName(part)
    return out


_MEASURE = "SELECT round(sqrt(sum(n * power(ext_size - m, 2)) / sum(n)) / max(m), 6) AS cv, round(-sum(CASE WHEN ext_size > 0 THEN n / t * ln(n / t) END), 6) AS entropy FROM (SELECT *, sum(ext_size * n) OVER () / sum(n) OVER () AS m, sum(n) FILTER (ext_size > 0) OVER () AS t FROM ({}))"


def _measured(name, p, b, x):
    def run(spark, d):
        return S.distribution_measures(C.extension_distribution(edges(spark, d, {label for _, label, _ in p.edges}), p, b, x))

    query(_MEASURE.format(_dist_sql(p, b, x)), name)(run)


_measured("ext_cv", STAR3, 0b011, 0b100)
_measured("ext_entropy", T("0-1;1-2", "6->3"), 0b10, 0b01)
_measured("pattern_cv", FORK, 0b0111, 0b1000)


@query(" UNION ALL ".join(f"SELECT '{p.sub(b).vlist}' AS base, '{p.sub(x).vlist}' AS ext, coalesce(max(x.n), 0) AS max_deg FROM (SELECT DISTINCT k FROM ({C.count_sql(p.sub(b), '{v%d} AS k' % _shared(p, b, x)[0])})) b JOIN ({C.count_sql(p.sub(x), '{v%d} AS k, count(*) AS n' % _shared(p, b, x)[0], group='{v%d}' % _shared(p, b, x)[0])}) x USING (k)" for p in (DIST, T("0-1;0-2", "5->6")) for b, x in ((1, 2), (2, 1))))
def cat_max_degree(spark, d):
    out = None
    for p in (DIST, T("0-1;0-2", "5->6")):
        e = edges(spark, d, {label for _, label, _ in p.edges})
        for b, x in ((1, 2), (2, 1)):
            part = C.max_extension(e, p, b, x).select(F.lit(p.sub(b).vlist).alias("base"), F.lit(p.sub(x).vlist).alias("ext"), "max_deg")
            out = part if out is None else out.unionByName(part)
    return out


@query(""", i AS (SELECT dest AS v, count(*) AS x FROM e WHERE label = 6 GROUP BY dest), o AS (SELECT src AS v, count(*) AS y FROM e WHERE label = 3 GROUP BY src), j AS (SELECT v, x, coalesce(y, 0) AS y FROM i LEFT JOIN o USING (v))
SELECT max(y) AS max_ext, min(y) AS min_ext, round(avg(y), 6) AS mean_ext, round(stddev_pop(y), 6) AS sd_ext, min(y) FILTER (y > 0) AS min_live, round(avg(y) FILTER (y > 0), 6) AS mean_live, round(stddev_pop(y) FILTER (y > 0), 6) AS sd_live,
count(*) AS unique_dests, count(*) FILTER (y > 0) AS live_dests, round(avg(x), 6) AS mean_in, CAST(coalesce(sum(x) FILTER (y > 0), 0) AS BIGINT) AS live_prefixes FROM j""")
def path_profile(spark, d):
    return S.path_profile(edges(spark, d, {3, 6}), 6, 3)


def _variation_sql(ends: str, key: str) -> str:
    cv = lambda n: f"sqrt(greatest({n} * q - s * s, 0)) / s"
    return f"SELECT {key}, b, {cv('n')} AS live, {cv('every')} AS whole FROM (SELECT {key}, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS s, CAST(sum(d * d) AS DOUBLE) AS q FROM {ends} JOIN o USING (v) GROUP BY ALL) JOIN (SELECT {key}, CAST(count(*) AS DOUBLE) AS every FROM {ends} GROUP BY ALL) USING ({key})"


@query(f""", o AS (SELECT src AS v, label AS b, count(*) AS d FROM e GROUP BY ALL), one AS (SELECT DISTINCT label AS a, dest AS v FROM e), two AS (SELECT DISTINCT x.label AS z, y.label AS a, y.dest AS v FROM e x JOIN e y ON x.dest = y.src),
m AS ({_variation_sql('one', 'a')}), l AS (SELECT a, b, avg(live) AS live, avg(whole) AS whole FROM ({_variation_sql('two', 'z, a')}) GROUP BY a, b)
SELECT m.a || '->' || m.b AS labels, round(m.live, 6) AS cv_live, round(m.whole, 6) AS cv_all, round(l.live, 6) AS longer_live, round(l.whole, 6) AS longer_all FROM m LEFT JOIN l ON l.a = m.a AND l.b = m.b""")
def suffix_cv(spark, d):
    return S.suffix_variation(edges(spark, d))


_CSETS = """, s AS (SELECT src AS v, label, 'o' AS w, count(*) AS d FROM e GROUP BY ALL UNION ALL SELECT dest, label, 'i', count(*) FROM e GROUP BY ALL),
per AS (SELECT v, coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FILTER (w = 'o'), '') AS out_labels, coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FILTER (w = 'i'), '') AS in_labels, coalesce(sum(d) FILTER (w = 'o'), 0) AS a, coalesce(sum(d) FILTER (w = 'i'), 0) AS b FROM s GROUP BY v),
sets AS (SELECT out_labels, in_labels, count(*) AS n, CAST(sum(a) AS BIGINT) AS out_degree, CAST(sum(b) AS BIGINT) AS in_degree FROM per GROUP BY ALL)"""


@query(_CSETS + " SELECT * FROM sets")
def char_sets(spark, d):
    return S.characteristic_sets(edges(spark, d))


@query(_CSETS + """, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, out_labels, in_labels) AS k, list_filter(string_split(out_labels, ','), lambda x: x <> '') AS o, list_filter(string_split(in_labels, ','), lambda x: x <> '') AS i FROM sets),
c AS (SELECT a.out_labels, a.in_labels, a.n, a.out_degree, a.in_degree, t.out_labels AS to_out, t.in_labels AS to_in, row_number() OVER (PARTITION BY a.out_labels, a.in_labels ORDER BY len(t.o) + len(t.i), t.n DESC, t.out_labels, t.in_labels) AS pick FROM r a JOIN r t ON t.k <= 4 AND list_has_all(t.o, a.o) AND list_has_all(t.i, a.i))
SELECT to_out, to_in, CAST(sum(n) AS BIGINT) AS n, CAST(sum(out_degree) AS BIGINT) AS out_degree, CAST(sum(in_degree) AS BIGINT) AS in_degree, count(*) AS merged FROM c WHERE pick = 1 GROUP BY ALL""")
def char_set_merge(spark, d):
    return S.merge_characteristic_sets(S.characteristic_sets(edges(spark, d)), 4)


@query("SELECT label, src, n, CAST(sum(n) OVER (PARTITION BY label ORDER BY src) AS BIGINT) AS upto FROM (SELECT label, src, count(*) AS n FROM e GROUP BY ALL)")
def cum_counts(spark, d):
    return S.running_counts(edges(spark, d))


@query("SELECT * FROM (VALUES " + ", ".join(f"({m}, {m.bit_count()}, {'true' if FORK.sub(m).acyclic else 'false'})" for m in FORK.subsets()) + ") t(mask, n_edges, acyclic)")
def connected_subsets(spark, d):
    return spark.createDataFrame([(m, m.bit_count(), FORK.sub(m).acyclic) for m in FORK.subsets()], "mask int, n_edges int, acyclic boolean")


@query("SELECT * FROM (VALUES ('0-1', '4'), ('0-2', '6'), ('2-3', '3'), ('4-3', '1'), ('0-1;0-2', '4->6'), ('0-2;2-3', '6->3'), ('2-3;4-3', '3->1'), ('0-1;0-2;2-3', '4->6->3'), ('0-2;2-3;4-3', '6->3->1')) t(vlist, label_seq)")
def decompose(spark, d):
    return spark.createDataFrame([(FORK.sub(m).vlist, FORK.sub(m).label_seq) for m in FORK.subsets(1, 3, acyclic=True)], "vlist string, label_seq string")


def _counts_cte(p: Pattern, masks) -> str:
    return ", " + ", ".join(f"t{m} AS ({C.count_sql(p.sub(m), f'count(*) AS c{m}')})" for m in masks)


def _nine_sql(p: Pattern, entries, starts=None) -> str:
    masks, forms = P.formula_sql(p, entries, starts)
    rows = " UNION ALL ".join(f"SELECT {h} AS h, {x} AS est FROM {', '.join(f't{m}' for m in masks)}" for h, x in forms)
    parts = []
    for k, cond in (("all", "true"), ("min_hop", "h = lo"), ("max_hop", "h = hi")):
        parts += [f"round({a}(est) FILTER ({cond}), 3) AS {k}_{a}" for a in ("min", "max", "avg")]
    return _counts_cte(p, masks) + f", f AS ({rows}), g AS (SELECT *, min(h) OVER () AS lo, max(h) OVER () AS hi FROM f) SELECT {', '.join(parts)} FROM g"


NINE = ", ".join(f"{x} double" for x in P.NINE)


def _optimistic(name: str, p: Pattern, k: int, kind: str = "all") -> None:
    entries, starts = P.triangle_entries(p) if kind == "triangle" else (P.entries_of(p, k, kind), None)

    def run(spark, d):
        e = edges(spark, d, {label for _, label, _ in p.edges})
        cards = C.catalogue_of(e, p, sorted(P.overlaps(p, entries) | set(starts or ())))
        out = P.optimistic(p, cards, entries, starts)
        return spark.createDataFrame([tuple(round(out[x], 3) for x in P.NINE)], NINE)

    query(_nine_sql(p, entries, starts), name)(run)


TREE6 = T("0-1;0-2;0-3;1-4;4-5;3-6", "4->5->6->1->2->3")
_optimistic("optimistic_9_path", PATH3, 2)
_optimistic("optimistic_9_star", STAR3, 2)
_optimistic("optimistic_9_fork", FORK, 2)
_optimistic("optimistic_9_tree", TREE6, 3)
_optimistic("optimistic_9_paths_only", TREE6, 3, "path")
_optimistic("triangle_start_9", CYCLIC5, 2, "triangle")
# a cycle closed by the plain ratio of counts; steps whose overlap is not connected are left out
_optimistic("cyclic_baseline_9", SQUARE, 3)


@query(_counts_cte(FORK, P.formula_sql(FORK, P.entries_of(FORK, 2))[0]) + " " + " UNION ALL ".join(f"SELECT '{'.'.join(map(str, seq))}' AS formula, {len(seq)} AS hops, round({x}, 6) AS est FROM {', '.join(f't{m}' for m in P.formula_sql(FORK, P.entries_of(FORK, 2))[0])}" for (seq, _), (_, x) in zip(P.formulas(FORK, dict.fromkeys(P.overlaps(FORK, P.entries_of(FORK, 2)), 1), P.entries_of(FORK, 2)), P.formula_sql(FORK, P.entries_of(FORK, 2))[1], strict=True)))
def formula_estimates(spark, d):
    """Every formula with its estimate, by joins of states with entries and counts."""
    entries = P.entries_of(FORK, 2)
    cards = spark.createDataFrame(list(C.catalogue_of(edges(spark, d, {1, 3, 4, 6}), FORK, sorted(P.overlaps(FORK, entries))).items()), "mask long, card long")
    ext = cards.where(F.col("mask").isin(entries)).select(F.col("mask").alias("x"), F.col("card").alias("top"))
    states = ext.select(F.col("x").alias("covered"), F.col("x").cast("string").alias("formula"), F.lit(1).alias("hops"), F.col("top").cast("double").alias("est"))
    done = states.where(F.col("covered") == FORK.full)
    for _ in range(FORK.size - 2):
        step = states.where(F.col("covered") != FORK.full).crossJoin(F.broadcast(ext)).withColumn("both", F.col("covered").bitwiseAND(F.col("x"))).where("both <> 0 AND both <> x").join(F.broadcast(cards), F.col("both") == F.col("mask"))
        ratio = F.when((F.col("card") > 0) & (F.col("top") > 0), F.col("top") / F.col("card")).otherwise(0.0)
        states = step.select(F.col("covered").bitwiseOR(F.col("x")).alias("covered"), F.concat_ws(".", "formula", F.col("x").cast("string")).alias("formula"), (F.col("hops") + 1).alias("hops"), (F.col("est") * ratio).alias("est"))
        done = done.unionByName(states.where(F.col("covered") == FORK.full))
    return done.select("formula", "hops", F.round("est", 6).alias("est"))


@query(_counts_cte(FORK, [*P.formula_sql(FORK, P.entries_of(FORK, 2))[0], 15]) + ", f AS (" + " UNION ALL ".join(f"SELECT '{'.'.join(map(str, seq))}' AS formula, {x} AS est, c15 FROM {', '.join(f't{m}' for m in [*P.formula_sql(FORK, P.entries_of(FORK, 2))[0], 15])}" for (seq, _), (_, x) in zip(P.formulas(FORK, dict.fromkeys(P.overlaps(FORK, P.entries_of(FORK, 2)), 1), P.entries_of(FORK, 2)), P.formula_sql(FORK, P.entries_of(FORK, 2))[1], strict=True)) + ") SELECT formula, round(greatest(est / c15, c15 / est), 6) AS q_error, CAST(rank() OVER (ORDER BY round(greatest(est / c15, c15 / est), 6)) AS INTEGER) AS rank FROM f")
def qerror_rank(spark, d):
    true = C.count_pattern(edges(spark, d, {1, 3, 4, 6}), FORK)
    err = formula_estimates(spark, d).crossJoin(F.broadcast(true)).select("formula", F.round(F.greatest(F.col("est") / F.col("c"), F.col("c") / F.col("est")), 6).alias("q_error"))
    return err.withColumn("rank", F.rank().over(Window.orderBy("q_error")).cast("int"))


@query(_counts_cte(PATH3, [2, 3, 6, 7]) + " SELECT round(CAST(c3 AS DOUBLE) * c6 / c2, 6) AS estimate, c7 AS true_card, round(greatest(CAST(c3 AS DOUBLE) * c6 / c2 / c7, c7 / (CAST(c3 AS DOUBLE) * c6 / c2)), 6) AS q_error FROM t2, t3, t6, t7")
def flagship(spark, d):
    """Optimistic estimate, true count and q-error of customer orders per region."""
    e = edges(spark, d, {1, 2, 4})
    cards = C.needed_counts(e, [PATH3.sub(m) for m in (2, 3, 6, 7)])
    c = lambda m: F.max(F.when((F.col("vlist") == PATH3.sub(m).vlist) & (F.col("label_seq") == PATH3.sub(m).label_seq), F.col("card")))
    wide = cards.agg(c(2).alias("c2"), c(3).alias("c3"), c(6).alias("c6"), c(7).alias("c7"))
    est = F.col("c3").cast("double") * F.col("c6") / F.col("c2")
    return wide.select(F.round(est, 6).alias("estimate"), F.col("c7").alias("true_card"), F.round(F.greatest(est / F.col("c7"), F.col("c7") / est), 6).alias("q_error"))


def _degree_parts(p: Pattern) -> dict[tuple[int, int], int]:
    return {(j, i): p.ends(1 << j) & p.ends(1 << i) for j in range(p.size) for i in range(p.size) if i != j and p.ends(1 << j) & p.ends(1 << i)}


def degrees_of(e, p: Pattern) -> dict[tuple[int, int], int]:
    """Greatest extension degrees of all adjacent pairs of edges in one job."""
    pairs = list(_degree_parts(p))
    parts = None
    for j, i in pairs:
        one = C.max_extension(e, p, 1 << j, 1 << i).select(F.lit(j).alias("j"), F.lit(i).alias("i"), "max_deg")
        parts = one if parts is None else parts.unionByName(one)
    return {(r.j, r.i): r.max_deg for r in parts.collect()}


def _degree_sql(p: Pattern) -> str:
    out = []
    for (j, i), shared in _degree_parts(p).items():
        v = sorted(shared)[0]
        out.append(f"m{j}_{i} AS (SELECT coalesce(max(n), 0) AS d{j}_{i} FROM (SELECT DISTINCT k FROM ({C.count_sql(p.sub(1 << j), f'{{v{v}}} AS k')})) JOIN ({C.count_sql(p.sub(1 << i), f'{{v{v}}} AS k, count(*) AS n', group=f'{{v{v}}}')}) USING (k))")
    return ", ".join(out)


def _bound_sql(p: Pattern, least: int) -> str:
    """All lattice paths, spelled out."""
    exprs = []
    for path in P.lattice_paths(p, least):
        expr = f"c{path[0]}"
        for a, b in zip(path, path[1:]):
            i = (a ^ b).bit_length() - 1
            ds = [f"d{j}_{i}" for j in range(p.size) if a >> j & 1 and (j, i) in _degree_parts(p)]
            expr += f" * least({', '.join(ds)})" if len(ds) > 1 else f" * {ds[0]}"
        exprs.append(expr)
    starts = p.subsets(least, least)
    tables = [f"t{m}" for m in starts] + [f"m{j}_{i}" for j, i in _degree_parts(p)]
    return _counts_cte(p, starts) + ", " + _degree_sql(p) + f" SELECT CAST(least({', '.join(exprs)}) AS BIGINT) AS bound FROM {', '.join(tables)}"


@query(_bound_sql(FORK, 2))
def ceg_pessimistic(spark, d):
    e = edges(spark, d, {1, 3, 4, 6})
    return spark.createDataFrame([(P.pessimistic(FORK, C.catalogue_of(e, FORK, FORK.subsets(2, 2)), degrees_of(e, FORK)),)], "bound long")


@query(_bound_sql(FORK, 3))
def maxdeg_bound(spark, d):
    """Starts of three edges, the rest by greatest degrees."""
    e = edges(spark, d, {1, 3, 4, 6})
    return spark.createDataFrame([(P.pessimistic(FORK, C.catalogue_of(e, FORK, FORK.subsets(3, 3)), degrees_of(e, FORK), 3),)], "bound long")


@query(_bound_sql(STAR3, 2))
def cllp_bound(spark, d):
    """The linear program without submodularity; on a star its shortest path only adds edges."""
    e = edges(spark, d, {4, 5, 6})
    return spark.createDataFrame([(P.lp_bound(STAR3, C.catalogue_of(e, STAR3, STAR3.subsets(2, 2)), degrees_of(e, STAR3)),)], "bound long")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{'.'.join(map(str, x))}')" for x in P.lattice_paths(FORK, 2)) + ") t(path)")
def ceg_paths(spark, d):
    return spark.createDataFrame([(".".join(map(str, x)),) for x in P.lattice_paths(FORK, 2)], "path string")


_HASH_SQL = "k AS (SELECT label, src % 4 AS src_part, dest % 4 AS dest_part, src, dest FROM e)"
_CELL_SQL = "SELECT label, src_part, dest_part, n, max_out, max_in FROM (SELECT label, src_part, dest_part, CAST(sum(x) AS BIGINT) AS n, max(x) AS max_out FROM (SELECT label, src_part, dest_part, src, count(*) AS x FROM k GROUP BY ALL) GROUP BY ALL) JOIN (SELECT label, src_part, dest_part, max(x) AS max_in FROM (SELECT label, src_part, dest_part, dest, count(*) AS x FROM k GROUP BY ALL) GROUP BY ALL) USING (label, src_part, dest_part)"


@query(f", {_HASH_SQL} {_CELL_SQL}")
def hash_part_stats(spark, d):
    return S.hash_partition_stats(edges(spark, d), 4)


@query(f", o AS (SELECT label, src, CAST(floor(ln(count(*)) / ln(3.0::DOUBLE) + 1e-9) AS BIGINT) AS src_part FROM e GROUP BY label, src), i AS (SELECT label, dest, CAST(floor(ln(count(*)) / ln(3.0::DOUBLE) + 1e-9) AS BIGINT) AS dest_part FROM e GROUP BY label, dest), k AS (SELECT label, src_part, dest_part, src, dest FROM e JOIN o USING (label, src) JOIN i USING (label, dest)) {_CELL_SQL}")
def deg_part_stats(spark, d):
    return S.degree_partition_stats(edges(spark, d), 3.0)


@query("SELECT b.src % 4 AS part, count(*) AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1 GROUP BY ALL")
def part_catalogue(spark, d):
    e = edges(spark, d, {1, 4})
    return C.project_counts(e, DIST, keep=(1,)).groupBy(hash_part(F.col("v1"), 4).alias("part")).agg(F.sum("c").alias("n"))


@query(", c AS (SELECT a.dest % 4 AS h, count(*) AS n FROM e a WHERE label = 6 GROUP BY 1), x AS (SELECT a.dest % 4 AS h, count(*) AS n FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 6 AND b.label = 3 GROUP BY 1), y AS (SELECT a.dest % 4 AS h, count(*) AS n FROM e a JOIN e b ON a.dest = b.dest WHERE a.label = 6 AND b.label = 7 GROUP BY 1) SELECT round(sum(CAST(x.n AS DOUBLE) * y.n / c.n), 6) AS estimate FROM c JOIN x USING (h) JOIN y USING (h)")
def pcat_estimate(spark, d):
    """Estimate of order-supplier-nation with parts of the supplier, summed over hash parts of the supplier."""
    e = edges(spark, d, {3, 6, 7})
    per = lambda p, n: C.project_counts(e, p, keep=(1,)).groupBy(hash_part(F.col("v1"), 4).alias("h")).agg(F.sum("c").alias(n))
    c, x, y = per(T("0-1", "6"), "c"), per(T("0-1;1-2", "6->3"), "x"), per(T("0-1;2-1", "6->7"), "y")
    return c.join(x, "h").join(y, "h").agg(F.round(F.sum(F.col("x").cast("double") * F.col("y") / F.col("c")), 6).alias("estimate"))


@query(", g AS (SELECT dest, CAST(floor(ln(count(*))) AS BIGINT) AS bucket FROM e GROUP BY dest) SELECT label, bucket, count(*) AS n FROM e JOIN g USING (dest) GROUP BY ALL")
def terminal_partition(spark, d):
    return S.terminal_partition(edges(spark, d))


@query(_CSETS + " SELECT round(sum(CASE WHEN list_has_all(string_split(out_labels, ','), ['4', '5', '6']) THEN CAST(n AS DOUBLE) END), 6) AS centres, (SELECT count(*) FROM e WHERE label = 4) * (SELECT CAST(count(*) AS DOUBLE) FROM e WHERE label = 5) * (SELECT count(*) FROM e WHERE label = 6) / power(sum(CASE WHEN list_has_all(string_split(out_labels, ','), ['4', '5', '6']) THEN CAST(n AS DOUBLE) END), 2) AS estimate FROM sets")
def cset_estimate(spark, d):
    """Star of labels 4, 5, 6: centres with all three, times the average degrees."""
    e = edges(spark, d)
    labels = F.split("out_labels", ",")
    centres = S.characteristic_sets(e).where(F.array_contains(labels, "4") & F.array_contains(labels, "5") & F.array_contains(labels, "6")).agg(F.sum(F.col("n").cast("double")).alias("centres"))
    n = e.groupBy("label").agg(F.count("*").alias("n")).agg(*[F.max(F.when(F.col("label") == k, F.col("n"))).alias(f"n{k}") for k in (4, 5, 6)])
    return centres.crossJoin(F.broadcast(n)).select(F.round("centres", 6).alias("centres"), (F.col("n4") * F.col("n5").cast("double") * F.col("n6") / F.pow("centres", F.lit(2.0))).alias("estimate"))


@query(_counts_cte(T("0-1;1-2;2-3;3-4", "6->3->2->2"), [1, 2, 3, 6]) + ", q AS (SELECT 1) SELECT round(CAST(c3 AS DOUBLE) * c6 / c2, 6) AS estimate FROM t2, t3, t6")
def mt_path_estimate(spark, d):
    """A 3-path from windows of two edges; only the windows and overlaps that the path needs are counted."""
    path = T("0-1;1-2;2-3", "6->3->2")
    cards = C.catalogue_of(edges(spark, d, {2, 3, 6}), path, [0b001, 0b010, 0b100, 0b011, 0b110])
    table = {tuple(label for _, label, _ in path.sub(m).edges): n for m, n in cards.items()}
    return spark.createDataFrame([(round(P.markov_path([6, 3, 2], table, 2), 6),)], "estimate double")


_COUNTS = ", n AS (SELECT label, CAST(count(*) AS DOUBLE) AS c, CAST(count(DISTINCT src) AS DOUBLE) AS s FROM e GROUP BY label), v AS (SELECT CAST(count(*) AS DOUBLE) AS all_v FROM (SELECT src FROM e UNION SELECT dest FROM e))"


@query(_COUNTS + " SELECT round(max(c) FILTER (label = 4) * max(c) FILTER (label = 1) / max(all_v), 6) AS estimate FROM n, v")
def el_hist_uniform(spark, d):
    """Independence: every vertex equally likely in the middle of the path."""
    e = edges(spark, d)
    n = e.groupBy("label").agg(F.count("*").cast("double").alias("c")).agg(F.max(F.when(F.col("label") == 4, F.col("c"))).alias("a"), F.max(F.when(F.col("label") == 1, F.col("c"))).alias("b"))
    return n.crossJoin(F.broadcast(S.graph_stats(e))).select(F.round(F.col("a") * F.col("b") / F.col("n_vertices"), 6).alias("estimate"))


@query(_COUNTS + " SELECT round(max(c) FILTER (label = 4) * max(c) FILTER (label = 1) / sum(c), 6) AS estimate FROM n")
def el_hist_outdeg(spark, d):
    """Independence: vertices weighted by out-degree, of which each edge is one unit."""
    n = edges(spark, d).groupBy("label").agg(F.count("*").cast("double").alias("c"))
    pick = lambda k: F.max(F.when(F.col("label") == k, F.col("c")))
    return n.agg(F.round(pick(4) * pick(1) / F.sum("c"), 6).alias("estimate"))


@query(" UNION ALL ".join(f"SELECT '{o}' AS triple_order, count(*) AS firsts, CAST(sum(pairs) AS BIGINT) AS prefixes, CAST(max(n) AS BIGINT) AS largest FROM (SELECT {o.split(',')[0]}, count(*) AS pairs, sum(n) AS n FROM (SELECT {o.split(',')[0]}, {o.split(',')[1]}, count(*) AS n FROM e GROUP BY ALL) GROUP BY {o.split(',')[0]})" for o in S.ORDERS))
def rdf_hist_buckets(spark, d):
    return S.triple_histogram(edges(spark, d))


@query("SELECT round(CAST((SELECT count(*) FROM e a JOIN e b ON a.dest = b.src WHERE a.label = 4 AND b.label = 1) AS DOUBLE) / ((SELECT count(*) FROM e WHERE label = 4) * CAST((SELECT count(*) FROM e WHERE label = 1) AS DOUBLE)), 12) AS selectivity")
def rdf_hist_path(spark, d):
    """Selectivity of one join of two scans."""
    e = edges(spark, d, {1, 4})
    c = C.needed_counts(e, [DIST, DIST.sub(1), DIST.sub(2)]).agg(*[F.max(F.when((F.col("vlist") == DIST.sub(m).vlist), F.col("card"))).cast("double").alias(f"c{m}") for m in (3, 1, 2)])
    return c.select(F.round(F.col("c3") / (F.col("c1") * F.col("c2")), 12).alias("selectivity"))


SAMPLE = "(v * 7919) % 104729 % {k}"


def _node_sampling(name: str, k: int) -> None:
    """Star estimate from the centres whose hash is 0 modulo k, scaled by all centres over sampled ones; k = 1 is the count."""

    def run(spark, d):
        e = edges(spark, d, {4, 5, 6})
        centres = e.select(F.col("src").alias("v")).distinct()
        kept = centres.where(SAMPLE.format(k=k) + " = 0")
        product = kept
        for label in (4, 5, 6):
            product = product.join(e.where(F.col("label") == label).groupBy(F.col("src").alias("v")).agg(F.count("*").alias(f"n{label}")), "v")
        total = product.agg(F.coalesce(F.sum(F.col("n4") * F.col("n5") * F.col("n6")), F.lit(0)).alias("t"))
        sizes = centres.agg(F.count("*").alias("every"), F.count_if(F.expr(SAMPLE.format(k=k) + " = 0")).alias("some"))
        return total.crossJoin(F.broadcast(sizes)).select(F.round(F.col("t").cast("double") * F.col("every") / F.col("some"), 6).alias("estimate"))

    s = SAMPLE.format(k=k)
    query(f", c AS (SELECT DISTINCT src AS v FROM e WHERE label IN (4, 5, 6)), s AS (SELECT v FROM c WHERE {s} = 0) SELECT round(CAST(coalesce((SELECT count(*) FROM s JOIN e a ON a.src = v AND a.label = 4 JOIN e b ON b.src = v AND b.label = 5 JOIN e x ON x.src = v AND x.label = 6), 0) AS DOUBLE) * (SELECT count(*) FROM c) / (SELECT count(*) FROM s), 6) AS estimate", name)(run)


_node_sampling("node_sampling_full", 1)
_node_sampling("node_sampling_tenth", 10)


@query(", s AS (SELECT vid AS v, year FROM p) SELECT round(CAST(count(*) FILTER (year > 1994) AS DOUBLE) / count(*), 6) AS proportion FROM s WHERE (v * 7919) % 104729 % 10 = 0")
def sampled_proportion(spark, d):
    """Share of the sampled vertices with a property that pass a filter."""
    return properties(spark, d).withColumn("v", F.col("vid")).where(SAMPLE.format(k=10) + " = 0").agg(F.round(F.count_if(F.col("year") > 1994).cast("double") / F.count("*"), 6).alias("proportion"))


@query(", r AS (SELECT CAST(count(*) FILTER (year >= 1995 AND vid < 6000000000) AS DOUBLE) / count(*) FILTER (vid < 6000000000) AS a, CAST(count(*) FILTER (year <= 25 AND vid >= 6000000000) AS DOUBLE) / count(*) FILTER (vid >= 6000000000) AS b FROM p) SELECT round((SELECT count(*) FROM e WHERE label = 5) * a * b, 6) AS estimate FROM r")
def ratio_product(spark, d):
    """Edges of a label times the ratios of the filters on both ends."""
    late = F.col("vid") < 6 * 10**9
    ratio = lambda good, kind: F.count_if(good & kind).cast("double") / F.count_if(kind)
    r = properties(spark, d).agg(ratio(F.col("year") >= 1995, late).alias("a"), ratio(F.col("year") <= 25, ~late).alias("b"))
    n = edges(spark, d, {5}).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(r)).select(F.round(F.col("n") * F.col("a") * F.col("b"), 6).alias("estimate"))


_PATH2 = ", n AS (SELECT label, count(*) AS c FROM e GROUP BY label), t AS (SELECT a.label AS x, b.label AS y, count(*) AS t FROM e a JOIN e b ON a.dest = b.src GROUP BY ALL), q AS (SELECT x, y, t, CAST(l.c AS DOUBLE) * r.c / (SELECT sum(c) FROM n) AS est FROM t JOIN n l ON l.label = x JOIN n r ON r.label = y)"


@query(_PATH2 + " SELECT count(*) AS n FROM q a JOIN q b ON a.t < b.t AND a.est > b.est")
def inversions(spark, d):
    """Pairs of 2-paths that the independence estimate puts in the wrong order (a row per pair of labels)."""
    e = edges(spark, d)
    n = e.groupBy("label").agg(F.count("*").alias("c"))
    t = C.count_shape(e, "0-1;1-2").select(F.split("label_seq", "->").alias("l"), F.col("card").alias("t")).select(F.col("l")[0].cast("int").alias("x"), F.col("l")[1].cast("int").alias("y"), "t")
    q = t.join(F.broadcast(n.select(F.col("label").alias("x"), F.col("c").alias("cx"))), "x").join(F.broadcast(n.select(F.col("label").alias("y"), F.col("c").alias("cy"))), "y").crossJoin(F.broadcast(n.agg(F.sum("c").alias("total"))))
    q = q.withColumn("est", F.col("cx").cast("double") * F.col("cy") / F.col("total"))
    a, b = q.alias("a"), q.alias("b")
    return a.join(b, (F.col("a.t") < F.col("b.t")) & (F.col("a.est") > F.col("b.est"))).agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT src, dest FROM e WHERE label = {k}" for k in (1, 3)) + " ORDER BY src, dest")
def merge_union(spark, d):
    """Two scans in one order."""
    e = edges(spark, d, {1, 3})
    return e.where("label = 1").select("src", "dest").unionByName(e.where("label = 3").select("src", "dest")).orderBy("src", "dest")


@query(", o AS (SELECT dest AS v, src AS s, ((src * 31 + dest) * 7919) % 1000003 AS h FROM e WHERE label = 4) SELECT s AS v0, v AS v1, b.dest AS v2 FROM o JOIN e b ON b.label = 1 AND b.src = o.v ORDER BY h, s, v, b.dest LIMIT 20")
def path_sample(spark, d):
    """Twenty instances of a 2-path in the order of a hash of their first edge (a sampling operator: the limit is its feature)."""
    e = edges(spark, d, {1, 4})
    first = e.where("label = 4").select(F.col("src").alias("v0"), F.col("dest").alias("v1"), F.expr("((src * 31 + dest) * 7919) % 1000003").alias("h"))
    return first.join(e.where("label = 1").select(F.col("src").alias("v1"), F.col("dest").alias("v2")), "v1").orderBy("h", "v0", "v1", "v2").limit(20).select("v0", "v1", "v2")


def _folder(spark) -> str:
    """A folder of its own in the shared one (a local one on local masters only)."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/files-{uuid.uuid4().hex}"


@query("SELECT pattern_type, vlist, label_seq, card FROM (SELECT 1 AS pattern_type, '0-1' AS vlist, CAST(label AS VARCHAR) AS label_seq, count(*) AS card FROM e GROUP BY label UNION ALL SELECT 2, '0-1;1-2', a.label || '->' || b.label, count(*) FROM e a JOIN e b ON a.dest = b.src GROUP BY a.label, b.label)")
def catalogue_load(spark, d):
    """Two catalogues written, read back and merged."""
    e, home = edges(spark, d), _folder(spark)
    for i, shape in enumerate(("0-1", "0-1;1-2")):
        write_catalogue(C.count_shape(e, shape), f"{home}/{i}")
    return merge_catalogues(read_catalogue(spark, f"{home}/0"), read_catalogue(spark, f"{home}/1"), read_catalogue(spark, f"{home}/1", 1))


@query("SELECT 0 AS direction, label, max(n) AS max_deg FROM (SELECT label, src, count(*) AS n FROM e GROUP BY ALL) GROUP BY label UNION ALL SELECT 1, label, max(n) FROM (SELECT label, dest, count(*) AS n FROM e GROUP BY ALL) GROUP BY label")
def max_degree_load(spark, d):
    """Greatest degrees written and read back."""
    path = _folder(spark)
    write_max_degrees(S.max_degrees(edges(spark, d)), path)
    return read_max_degrees(spark, path)


_GROW = ", n1 AS (SELECT label AS a, count(*) AS c FROM e GROUP BY label), n2 AS (SELECT x.label AS a, y.label AS b, count(*) AS c FROM e x JOIN e y ON x.dest = y.src GROUP BY ALL), n3 AS (SELECT x.label AS a, y.label AS b, z.label AS c, count(*) AS n FROM e x JOIN e y ON x.dest = y.src JOIN e z ON y.dest = z.src GROUP BY ALL), q AS (SELECT n3.a || '->' || n3.b || '->' || n3.c AS labels, n, CAST(l.c AS DOUBLE) * r.c / m.c AS est FROM n3 JOIN n2 l ON l.a = n3.a AND l.b = n3.b JOIN n2 r ON r.a = n3.b AND r.b = n3.c JOIN n1 m ON m.a = n3.b)"


def _path3_estimates(spark, d):
    """labels, n and est of all 3-paths, estimated from the 2-path table."""
    t = path_mt(spark, d).withColumn("l", F.split("labels", "->"))
    t1, t2, t3 = (t.where(F.size("l") == k) for k in (1, 2, 3))
    j = lambda a, b: F.concat_ws("->", F.get("l", F.lit(a)), F.get("l", F.lit(b)))
    q = t3.withColumn("left", j(0, 1)).withColumn("right", j(1, 2)).withColumn("mid", F.get("l", F.lit(1)))
    q = q.join(t2.select(F.col("labels").alias("left"), F.col("n").alias("nl")), "left").join(t2.select(F.col("labels").alias("right"), F.col("n").alias("nr")), "right").join(t1.select(F.col("labels").alias("mid"), F.col("n").alias("nm")), "mid")
    return q.select("labels", "n", (F.col("nl").cast("double") * F.col("nr") / F.col("nm")).alias("est"))


@query(_GROW + " SELECT labels, round(greatest(est / n, n / est), 6) AS q_error FROM q ORDER BY q_error DESC, labels LIMIT 3")
def mt_grow(spark, d):
    """The three 3-paths that the 2-path table estimates worst."""
    return _path3_estimates(spark, d).select("labels", F.round(F.expr("greatest(est / n, n / est)"), 6).alias("q_error")).orderBy(F.desc("q_error"), "labels").limit(3)


@query(_GROW + " SELECT round(avg(abs(est - n) / n), 6) AS mre, round(avg(greatest(est / n, n / est)), 6) AS mqe FROM q")
def mre_mqe(spark, d):
    """Mean relative error and mean q-error of the 2-path table over all 3-paths."""
    return _path3_estimates(spark, d).agg(F.round(F.avg(F.expr("abs(est - n) / n")), 6).alias("mre"), F.round(F.avg(F.expr("greatest(est / n, n / est)")), 6).alias("mqe"))


@query(C.count_sql(CYCLIC5, "count(*) AS n"))
def plan_injected(spark, d):
    """Count by joins in the order that injected exact counts choose."""
    e = edges(spark, d, {label for _, label, _ in CYCLIC5.edges})
    cards = C.catalogue_of(e, CYCLIC5, CYCLIC5.subsets())
    order, _ = P.join_order(CYCLIC5, cards.__getitem__)
    text = "select ?v0 where { " + " . ".join(f"?v{s} <{label}> ?v{t}" for s, label, t in CYCLIC5.edges) + " . }"
    return sparql.run(e, text, order=order).agg(F.count("*").alias("n"))


@query("SELECT CAST(closed AS DOUBLE) / walks AS rate FROM (SELECT (" + C.count_sql(SQUARE, "count(*)") + ") AS closed, (" + C.count_sql(SQUARE.sub(0b1101), "count(*)") + ") AS walks)")
def closing_rate_4cycle(spark, d):
    """Of the 3-paths, the share (in closing edges) that the fourth edge closes, exactly."""
    e = edges(spark, d, {1, 3, 4, 6})
    closed, walks = C.count_pattern(e, SQUARE).withColumnRenamed("c", "closed"), C.count_pattern(e, SQUARE.sub(0b1101)).withColumnRenamed("c", "walks")
    return closed.crossJoin(walks).select((F.col("closed").cast("double") / F.col("walks")).alias("rate"))


def label_shuffle(spark, d):
    return shuffle_labels(edges(spark, d), 5)


def random_edges(spark, d):
    return random_graph(spark, 200, 500, 6)


_ADJACENT = {0: (1, 2), 1: (0, 3), 2: (0, 3), 3: (1, 2)}
_MIDEDGE = " UNION ALL ".join(f"SELECT CASE WHEN c{1 << a} = 0 OR c{1 << b} = 0 THEN 0 ELSE CAST(c{15 ^ 1 << i} AS DOUBLE) * c{15 ^ 1 << j} / (CAST(c{1 << a} AS DOUBLE) * c{1 << b}) END AS est FROM {', '.join(f't{m}' for m in sorted({15 ^ 1 << i, 15 ^ 1 << j, 1 << a, 1 << b}))}" for i, (a, b) in _ADJACENT.items() for j in range(4) if j != i)


@query(_counts_cte(SQUARE, [1, 2, 4, 8, 7, 11, 13, 14]) + f", f AS ({_MIDEDGE}) SELECT " + ", ".join(f"round({a}(est), 3) AS {h}_{a}" for h in ("all", "min_hop", "max_hop") for a in ("min", "max", "avg")) + " FROM f")
def cyclic_midedge_9(spark, d):
    """Where an entry closes a cycle its ratio is that of the middle edge to the two ends of the path."""
    entries = P.entries_of(SQUARE, 3)
    e = edges(spark, d, {1, 3, 4, 6})
    cards = C.catalogue_of(e, SQUARE, sorted(P.overlaps(SQUARE, entries) | set(SQUARE.subsets(1, 1))))

    def rate(covered, x):
        new = x & ~covered
        i = new.bit_length() - 1
        ends = [1 << j for j in range(SQUARE.size) if j != i and SQUARE.ends(1 << j) & SQUARE.ends(1 << i)]
        low = 1
        for m in ends:
            low *= cards[m]
        return cards[x] / low if low else 0.0

    out = P.closings(SQUARE, cards, entries, rate)
    return spark.createDataFrame([tuple(round(out[x], 3) for x in P.NINE)], NINE)


QUERIES |= {"label_shuffle": label_shuffle, "random_graph": random_edges}
