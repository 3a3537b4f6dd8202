import itertools
import random

import pytest

from motifspark.operators.counting import count_pattern, extension_distribution
from motifspark.plans import estimate as P, sparql
from motifspark.plans.pattern import Pattern, base_and_extensions, parse_legacy, to_sparql

SHAPES = ["0-1;0-2;0-3;0-4;1-2;3-4", "0-1", "0-1;1-2", "0-1;0-2;0-3", "0-1;0-2;2-3;4-3", "0-1;0-2;1-2", "0-1;0-3;1-2;3-2", "0-1;0-2;1-2;2-3", "0-1;1-0"]


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(0)
    rows = sorted({(rng.randrange(9), rng.randrange(3), rng.randrange(9)) for _ in range(60)})
    return rows, spark.createDataFrame(rows, "src long, label int, dest long").cache()


def brute(rows, pattern):
    by = {}
    for s, label, d in rows:
        by.setdefault(label, set()).add((s, d))
    n = 0
    for v in itertools.product(range(9), repeat=len(pattern.vertices)):
        at = dict(zip(pattern.vertices, v))
        n += all((at[s], at[d]) in by.get(label, ()) for s, label, d in pattern.edges)
    return n


@pytest.mark.parametrize("shape", SHAPES)
def test_counts(graph, shape):
    rows, e = graph
    p = Pattern.parse(shape, "->".join(str(i % 3) for i in range(shape.count(";") + 1)))
    assert count_pattern(e, p).first().c == brute(rows, p)


def test_distribution_sums_to_the_count(graph):
    rows, e = graph
    p = Pattern.parse("0-1;0-2;2-3", "0->1->2")
    n = brute(rows, p)
    for b, x in base_and_extensions(p):
        assert sum(r.ext_size * r.n for r in extension_distribution(e, p, b, x).collect()) == n


def test_dynamic_program_equals_enumeration():
    rng = random.Random(1)
    for labels in ("0-1;0-2;2-3;4-3", "0-1;1-2;2-3;3-4;4-5"):
        p = Pattern.parse(labels, "->".join(["1"] * (labels.count(";") + 1)))
        entries = P.entries_of(p, 2)
        cards = {m: rng.randrange(1, 50) for m in P.overlaps(p, entries)}
        every = P.formulas(p, cards, entries)
        got = P.optimistic(p, cards, entries)
        assert got["all_min"] == pytest.approx(min(x for _, x in every)) and got["all_avg"] == pytest.approx(sum(x for _, x in every) / len(every))


def test_bounds_hold(graph):
    rows, e = graph
    from motifspark.queries import degrees_of

    p = Pattern.parse("0-1;0-2;2-3", "0->1->2")
    cards = {m: brute(rows, p.sub(m)) for m in p.subsets(2, 2)}
    degree = degrees_of(e, p)
    assert P.lp_bound(p, cards, degree) <= P.pessimistic(p, cards, degree) and P.lp_bound(p, cards, degree) >= brute(rows, p)


def test_parsers(graph):
    _, e = graph
    pattern, filters, n = parse_legacy("2,0-[7]>1,1-[8]>2,3,-1,>1990,-1,42")
    assert (pattern.vlist, filters, n) == ("0-1;1-2", {1: (">", 1990)}, 42)
    p = Pattern.parse("0-1;1-2", "0->1")
    assert sparql.run(e, to_sparql(p)).count() == count_pattern(e, p).first().c
    assert Pattern.parse("10-11;2-3", "5->6").vlist == "10-11;2-3"


def test_shapes():
    shape = lambda v: Pattern.parse(v, "->".join("1" * (v.count(";") + 1))).shape
    assert [shape(v) for v in ("0-1", "0-1;1-2", "0-1;0-2;0-3", "0-1;0-2;1-2", "10-11;2-3")] == ["single", "path", "star", "cyclic", "disconnected"]


def test_partitioned_bounds_hold(graph):
    """Sums over parts bound the count, and no worse than the whole's; estimates of one part are those of the whole."""
    rows, e = graph
    from motifspark.operators.counting import by_combo

    p = Pattern.parse("0-1;0-2;2-3", "0->1->2")
    pairs, true = p.subsets(2, 2), brute(rows, p)
    one = by_combo(e, p, p.subsets(1, 2), {0: 1, 2: 1}, degrees=True)
    many = by_combo(e, p, p.subsets(1, 2), {0: 2, 2: 3}, degrees=True)
    least = lambda _, degree, js, i: min(degree[j, i] for j in js)
    assert len(many) == 6 and [sum(c[m] for c, _ in many) for m in pairs] == [brute(rows, p.sub(m)) for m in pairs]
    assert true <= min(P.per_path(p, many, least)) <= min(P.per_path(p, one, least))
    assert true <= sum(P.lp_bound(p, *x) for x in many) <= min(P.per_path(p, many, least))
    cards = one[0][0]
    assert P.per_formula(p, [cards], P.entries_of(p, 2))["max"] == pytest.approx(P.optimistic(p, cards, P.entries_of(p, 2))["all_max"])


def test_triangles_tighten_the_cyclic_bound(graph):
    rows, e = graph
    from motifspark.operators.counting import project_counts
    from motifspark.queries import degrees_of

    p = Pattern.parse("0-1;0-2;1-2;2-3", "0->1->2->0")
    tri = p.triangles()[0]
    cards, degree = {m: brute(rows, p.sub(m)) for m in p.subsets(2, 2)}, degrees_of(e, p)
    closing = {(i, tri ^ 1 << i): max((r.c for r in project_counts(e, p.sub(tri), keep=sorted(p.ends(1 << i))).collect()), default=0) for i in range(p.size) if tri >> i & 1}
    assert brute(rows, p) <= P.lp_bound(p, cards, degree, closing) <= P.lp_bound(p, cards, degree)


def test_running_counts(graph):
    rows, e = graph
    from motifspark.operators import stats as S

    found = {(r.label, r.src): (r.n, r.upto) for r in S.running_counts(e, 4).collect()}
    for label in {r[1] for r in rows}:
        upto = 0
        for src in sorted({s for s, k, _ in rows if k == label}):
            n = sum((s, k) == (src, label) for s, k, _ in rows)
            upto += n
            assert found[label, src] == (n, upto)
    assert S.running_counts(e.where("false")).count() == S.at_offsets(e.where("false"), 3).count() == 0
    in_order = {k: [s for s, x, _ in rows if x == k] for k in {r[1] for r in rows}}
    assert sorted(tuple(r) for r in S.at_offsets(e, 3).collect()) == sorted((k, i, s) for k, x in in_order.items() for i, s in enumerate(x) if i % 3 == 0)


def test_unreachable_bounds_are_unknown():
    p = Pattern.parse("0-1;0-2;2-3", "0->1->2")
    cards = {m: 5 for m in p.subsets(2, 2)}
    assert P.pessimistic(p, cards, {}) is None and P.lp_bound(p, cards, {}) is None


def test_triangles_start_formulas():
    p = Pattern.parse("0-1;0-2;1-2;2-3", "5->6->7->3")
    entries, starts = P.triangle_entries(p)
    assert starts and all(seq[0] in starts for seq, _ in P.formulas(p, dict.fromkeys(P.overlaps(p, entries) | set(starts), 2), entries, starts))


def test_unions_and_late_filters(spark):
    e = spark.createDataFrame([(1, 1, 2), (3, 2, 4), (2, 3, 9), (5, 1, 6)], "src long, label int, dest long")
    both = sparql.run(e, "select ?a ?b ?x where { ?a <1> ?b . { ?a <1> ?b } union { ?x <2> ?y } }")
    assert sorted((r.a, r.b, r.x or 0) for r in both.collect()) == [(1, 2, 0), (1, 2, 3), (5, 6, 0), (5, 6, 3)]
    late = sparql.run(e, "select ?a ?c where { ?a <1> ?b . optional { ?b <3> ?c . } filter(?c > 5) }")
    assert [tuple(r) for r in late.collect()] == [(1, 9)]


def test_files(spark, graph, tmp_path):
    from motifspark.operators import counting as C, stats as S
    from motifspark.sources import edges as E

    rows, e = graph
    E.write_edges(e, f"{tmp_path}/parquet")
    assert sorted(spark.read.parquet(f"{tmp_path}/parquet").select("src", "label", "dest").collect()) == sorted(rows)
    E.write_ntriples(e, f"{tmp_path}/nt")
    assert sorted(E.read_ntriples(spark, f"{tmp_path}/nt").collect()) == sorted(rows)
    e.write.csv(f"{tmp_path}/csv")
    assert sorted(E.read_edges(spark, f"{tmp_path}/csv").collect()) == sorted(rows)
    (tmp_path / "props.tsv").write_text("id\ta\tb\tc\tyear\n7\t\t\t\t1990\n8\t\t\t\t\n")
    assert [tuple(r) for r in E.read_properties(spark, f"{tmp_path}/props.tsv").collect()] == [(7, 1990), (8, None)]
    found = C.count_shape(e, "0-1;1-2")
    E.write_catalogue(found, f"{tmp_path}/cat")
    back = E.read_catalogue(spark, f"{tmp_path}/cat")
    assert sorted(tuple(r) for r in E.merge_catalogues(back, back).collect()) == sorted((2, *r) for r in found.collect())
    E.write_max_degrees(S.max_degrees(e), f"{tmp_path}/deg")
    assert sorted(E.read_max_degrees(spark, f"{tmp_path}/deg").collect()) == sorted(S.max_degrees(e).collect())


CHEAP = ("bow_tie", "triangle_start_9", "vertex_props", "join_nl", "mt3_counts", "query_parse", "inversions", "node_sampling_full", "node_sampling_tenth", "sampled_proportion", "ratio_product", "path_sample", "catalogue_load", "max_degree_load", "mre_mqe", "cum_counts", "label_src_hist", "sparql_union", "sparql_optional", "char_set_merge", "cyclic_midedge_9", "cyclic_baseline_9", "mt_path_estimate", "suffix_cv", "formula_estimates", "flagship")
ESTIMATES = ("pcat_formulas", "ceg_optimistic", "ceg_pessimistic_parts", "cllp_partitioned", "cllp_cyclic", "sqrt_bound", "cyclic_triangle_closing_9", "closing_rates", "cyclic_extension_rate", "entropy_choice", "cset_peel", "cset_mt", "mt_suffix_star", "mt_partitioned", "mt_filtered", "leaf_sampling", "sample_offsets", "workload", "cyclic_workload", "plan_estimated", "dist_load", "cset_load", "mt_load", "part_sink")


@pytest.mark.parametrize("name", CHEAP + ESTIMATES)
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    import motifspark.queries_estimates  # noqa: F401
    from motifspark.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {table} as from '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted(tuple("null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.project(",".join(f'"{c}"' for c in columns)).fetchall())
