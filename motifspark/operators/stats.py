"""Statistics over the edge relation: degrees, distributions, characteristic sets, path profiles, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import degree_bucket, hash_part


def graph_stats(e: DataFrame) -> DataFrame:
    """n_triples, n_vertices, n_labels. Vertices are first made distinct, so nothing but counts meets in one task."""
    vertices = e.select(F.explode(F.array("src", "dest")).alias("v")).distinct().agg(F.count("*").alias("n_vertices"))
    labels = e.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_triples"), F.count("*").alias("n_labels"))
    return labels.crossJoin(vertices).select("n_triples", "n_vertices", "n_labels")


def max_degrees(e: DataFrame) -> DataFrame:
    """direction (0 out, 1 in), label, max_deg."""
    parts = [e.groupBy("label", c).agg(F.count("*").alias("d")).groupBy("label").agg(F.max("d").alias("max_deg")).select(F.lit(i).alias("direction"), "label", "max_deg") for i, c in enumerate(("src", "dest"))]
    return parts[0].unionByName(parts[1])


def degree_cap(e: DataFrame, low: float, high: float) -> DataFrame:
    """Edges whose (src, label) out-degree and (dest, label) in-degree lie between two order statistics over all such groups.

    The statistic is the degree at place floor((n - 1) * p); it is read from the degree histogram, not from sorted degrees.
    """
    out = e.groupBy("src", "label").agg(F.count("*").alias("out_deg"))
    in_ = e.groupBy("dest", "label").agg(F.count("*").alias("in_deg"))

    def limits(d: DataFrame, column: str):
        hist = d.groupBy(F.col(column).alias("deg")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("deg"))
        total = F.sum("n").over(Window.partitionBy())
        at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * F.lit(p)), F.col("deg")))
        return hist.withColumn("upto", upto).withColumn("total", total).agg(at(low).alias(f"{column}_low"), at(high).alias(f"{column}_high"))

    # one row each
    kept = e.join(out, ["src", "label"]).join(in_, ["dest", "label"]).crossJoin(F.broadcast(limits(out, "out_deg"))).crossJoin(F.broadcast(limits(in_, "in_deg")))
    return kept.where("out_deg BETWEEN out_deg_low AND out_deg_high AND in_deg BETWEEN in_deg_low AND in_deg_high").select("src", "label", "dest")


def distribution_measures(dist: DataFrame) -> DataFrame:
    """cv (population deviation over mean) and entropy (natural log over sizes, 0 left out) of ext_size, n."""
    total = Window.partitionBy()
    share = F.col("n") / F.sum(F.when(F.col("ext_size") > 0, F.col("n"))).over(total)
    mean = F.sum(F.col("ext_size") * F.col("n")).over(total) / F.sum("n").over(total)
    measured = dist.withColumn("mean", mean).withColumn("share", F.when(F.col("ext_size") > 0, share))
    return measured.agg(
        F.round(F.sqrt(F.sum(F.col("n") * F.pow(F.col("ext_size") - F.col("mean"), 2)) / F.sum("n")) / F.max("mean"), 6).alias("cv"),
        F.round(-F.sum(F.col("share") * F.ln("share")), 6).alias("entropy"),
    )


def characteristic_sets(e: DataFrame) -> DataFrame:
    """out_labels, in_labels, n (vertices), out_degree and in_degree sums per set. Degrees are summed per vertex and label first."""
    ends = e.groupBy(F.col("src").alias("v"), "label").agg(F.count("*").alias("d")).withColumn("way", F.lit("out")).unionByName(e.groupBy(F.col("dest").alias("v"), "label").agg(F.count("*").alias("d")).withColumn("way", F.lit("in")))
    pick = lambda way: F.array_join(F.sort_array(F.collect_set(F.when(F.col("way") == way, F.col("label")))), ",")
    per = ends.groupBy("v").agg(pick("out").alias("out_labels"), pick("in").alias("in_labels"), F.sum(F.expr("if(way = 'out', d, 0)")).alias("out_degree"), F.sum(F.expr("if(way = 'in', d, 0)")).alias("in_degree"))
    return per.groupBy("out_labels", "in_labels").agg(F.count("*").alias("n"), F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))


def merge_characteristic_sets(sets: DataFrame, keep: int) -> DataFrame:
    """The keep largest sets stay; every other one joins the smallest superset among them (ties: more vertices, then labels), or stays out."""
    arr = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    order = Window.orderBy(F.desc("n"), "out_labels", "in_labels")
    ranked = sets.withColumn("rank", F.row_number().over(order)).withColumn("o", arr("out_labels")).withColumn("i", arr("in_labels"))
    top = ranked.where(F.col("rank") <= keep).select(F.col("out_labels").alias("to_out"), F.col("in_labels").alias("to_in"), F.col("o").alias("so"), F.col("i").alias("si"), F.col("n").alias("sn"))
    # at most keep rows
    inside = (F.size(F.array_except("o", "so")) == 0) & (F.size(F.array_except("i", "si")) == 0)
    paired = ranked.join(F.broadcast(top), inside)
    best = Window.partitionBy("out_labels", "in_labels").orderBy(F.size("so") + F.size("si"), F.desc("sn"), "to_out", "to_in")
    chosen = paired.withColumn("k", F.row_number().over(best)).where("k = 1")
    return chosen.groupBy("to_out", "to_in").agg(F.sum("n").alias("n"), F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"), F.count("*").alias("merged"))


def path_profile(e: DataFrame, first: int, second: int) -> DataFrame:
    """Profile of the 2-path: for each instance's end of the first edge, how many second edges follow."""
    ends = e.where(F.col("label") == first).groupBy(F.col("dest").alias("v")).agg(F.count("*").alias("in_deg"))
    after = e.where(F.col("label") == second).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out_deg"))
    j = ends.join(after, "v", "left").withColumn("out_deg", F.coalesce("out_deg", F.lit(0)))
    live = F.when(F.col("out_deg") > 0, F.col("out_deg"))
    return j.agg(
        F.max("out_deg").alias("max_ext"), F.min("out_deg").alias("min_ext"), F.round(F.avg("out_deg"), 6).alias("mean_ext"), F.round(F.stddev_pop("out_deg"), 6).alias("sd_ext"), F.min(live).alias("min_live"), F.round(F.avg(live), 6).alias("mean_live"),
        F.round(F.stddev_pop(live), 6).alias("sd_live"), F.count("*").alias("unique_dests"), F.count(live).alias("live_dests"), F.round(F.avg("in_deg"), 6).alias("mean_in"), F.sum(F.when(F.col("out_deg") > 0, F.col("in_deg")).otherwise(0)).alias("live_prefixes"),
    )


def suffix_variation(e: DataFrame) -> DataFrame:
    """Variation (deviation over mean) of a label's edges at the distinct ends of a path, for one-edge prefixes and on average over the two-edge prefixes that end in them.

    labels, cv_live and cv_all (ends without such edges left out or counted), longer_live and longer_all; null where no longer path exists.
    """
    out = e.groupBy(F.col("src").alias("v"), F.col("label").alias("b")).agg(F.count("*").alias("d"))
    one = e.select(F.col("label").alias("a"), F.col("dest").alias("v")).distinct()
    two = one.withColumnRenamed("a", "z").join(e, F.col("v") == F.col("src")).select("z", F.col("label").alias("a"), F.col("dest").alias("v")).distinct()

    def measured(ends: DataFrame, key: list[str]) -> DataFrame:
        every = ends.groupBy(*key).agg(F.count("*").cast("double").alias("every"))
        live = ends.join(out, "v").groupBy(*key, "b").agg(F.count("*").cast("double").alias("n"), F.sum("d").cast("double").alias("s"), F.sum(F.col("d") * F.col("d")).cast("double").alias("q"))
        cv = lambda n: F.sqrt(F.greatest(F.col(n) * F.col("q") - F.col("s") * F.col("s"), F.lit(0.0))) / F.col("s")
        return live.join(every, key).select(*key, "b", cv("n").alias("live"), cv("every").alias("whole"))

    longer = measured(two, ["z", "a"]).groupBy("a", "b").agg(F.avg("live").alias("longer_live"), F.avg("whole").alias("longer_all"))
    rows = measured(one, ["a"]).join(longer, ["a", "b"], "left")
    return rows.select(F.concat_ws("->", F.col("a").cast("string"), F.col("b").cast("string")).alias("labels"), F.round("live", 6).alias("cv_live"), F.round("whole", 6).alias("cv_all"), F.round("longer_live", 6).alias("longer_live"), F.round("longer_all", 6).alias("longer_all"))


ORDERS = ("src,label,dest", "src,dest,label", "label,src,dest", "label,dest,src", "dest,src,label", "dest,label,src")


def triple_histogram(e: DataFrame) -> DataFrame:
    """triple_order, buckets and n over the first column of each of the six orders."""
    parts = []
    for order in ORDERS:
        a, b, _ = order.split(",")
        parts.append(e.groupBy(a, b).agg(F.count("*").alias("n")).groupBy(a).agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).agg(F.count("*").alias("firsts"), F.sum("pairs").alias("prefixes"), F.max("n").alias("largest")).select(F.lit(order).alias("triple_order"), "firsts", "prefixes", "largest"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hash_partition_stats(e: DataFrame, parts: int) -> DataFrame:
    """label, src_part, dest_part, n, max_out, max_in."""
    cell = e.select("*", hash_part(F.col("src"), parts).alias("src_part"), hash_part(F.col("dest"), parts).alias("dest_part"))
    return _cells(cell)


def degree_partition_stats(e: DataFrame, base: float) -> DataFrame:
    """As hash_partition_stats, parts being buckets of the degree per label."""
    out = e.groupBy("label", "src").agg(degree_bucket(F.count("*"), base).alias("src_part"))
    in_ = e.groupBy("label", "dest").agg(degree_bucket(F.count("*"), base).alias("dest_part"))
    return _cells(e.join(out, ["label", "src"]).join(in_, ["label", "dest"]))


def _cells(cell: DataFrame) -> DataFrame:
    key = ["label", "src_part", "dest_part"]
    n = cell.groupBy(*key, "src").agg(F.count("*").alias("d")).groupBy(*key).agg(F.sum("d").alias("n"), F.max("d").alias("max_out"))
    return n.join(cell.groupBy(*key, "dest").agg(F.count("*").alias("d")).groupBy(*key).agg(F.max("d").alias("max_in")), key)


def terminal_partition(e: DataFrame) -> DataFrame:
    """label, bucket (floor of ln of the target's in-degree over all labels), n."""
    deg = e.groupBy("dest").agg(F.floor(F.ln(F.count("*"))).cast("bigint").alias("bucket"))
    return e.join(deg, "dest").groupBy("label", "bucket").agg(F.count("*").alias("n"))


def running_counts(e: DataFrame, width: int = 1 << 20) -> DataFrame:
    """label, src, n, upto: edges of each source and of all sources of its label up to it.

    Sums run within ranges of ids and over the ranges, so that a label's sources never meet in one task.
    """
    deg = e.groupBy("label", "src").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("src") / F.lit(width)))
    inner = deg.withColumn("within", F.sum("n").over(Window.partitionBy("label", "range").orderBy("src")))
    ranges = deg.groupBy("label", "range").agg(F.sum("n").alias("m"))
    before = ranges.withColumn("before", F.sum("m").over(Window.partitionBy("label").orderBy("range")) - F.col("m")).drop("m")
    return inner.join(before, ["label", "range"]).select("label", "src", "n", (F.col("within") + F.col("before")).alias("upto"))


def at_offsets(e: DataFrame, step: int) -> DataFrame:
    """label, place, src: the source that holds every step-th edge of its label in the order of sources."""
    counts = running_counts(e)
    first = F.ceil((F.col("upto") - F.col("n")) / F.lit(step)) * step
    return counts.withColumn("first", first.cast("bigint")).where("first < upto").select("label", F.explode(F.sequence("first", F.col("upto") - 1, F.lit(step).cast("bigint"))).alias("place"), "src")


def star_by_sets(e: DataFrame, labels: list[int]) -> DataFrame:
    """centres, estimate: stars of out-labels from characteristic sets, each set's vertices times its average degrees."""
    deg = e.groupBy("src", "label").agg(F.count("*").alias("d"))
    sets = deg.groupBy("src").agg(F.array_sort(F.collect_list("label")).alias("labels"), *[F.max(F.when(F.col("label") == k, F.col("d"))).alias(f"d{k}") for k in labels])
    per = sets.where(" AND ".join(f"d{k} IS NOT NULL" for k in labels)).groupBy("labels").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"d{k}").alias(f"s{k}") for k in labels])
    product = F.col("n")
    for k in labels:
        product = product * F.col(f"s{k}") / F.col("n")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("centres"), F.coalesce(F.sum(product), F.lit(0.0)).alias("estimate"))


def folded_paths(table: DataFrame, keep: int) -> DataFrame:
    """The keep most frequent 2-paths (a, b, n) stay; others that share their first label become its average a/*, single ones together */*."""
    ranked = table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "a", "b")))
    kept = ranked.where(F.col("rank") <= keep).select(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("entry"), F.col("n").cast("double").alias("n"), F.lit(1).cast("bigint").alias("entries"))
    rest = ranked.where(F.col("rank") > keep).groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    name = F.when(F.col("entries") > 1, F.concat(F.col("a").cast("string"), F.lit("/*"))).otherwise("*/*")
    return kept.unionByName(rest.groupBy(name.alias("entry")).agg((F.sum("n").cast("double") / F.sum("entries")).alias("n"), F.sum("entries").alias("entries")))


def closing_rate(e: DataFrame, first: int, closing: int, last: int, steps: int, starts: int) -> DataFrame:
    """walks, closed: walks from a sample of start edges by steps of any label and direction to a last edge, entered at its target, and the closing edges from the walk's first vertex to its last.

    The sample is the first edges by hash (its size is the operator's parameter). The frontier is summed by (first vertex, vertex).
    """
    sample = e.where(F.col("label") == first).orderBy(F.expr("(src * 31 + dest) * 7919 % 1000003"), "src", "dest").limit(starts)
    front = sample.select(F.col("src").alias("a"), F.col("dest").alias("v"), F.lit(1).cast("bigint").alias("n"))
    both = e.select(F.col("src").alias("v"), F.col("dest").alias("w")).unionByName(e.select(F.col("dest").alias("v"), F.col("src").alias("w")))
    for _ in range(steps):
        front = front.join(both, "v").groupBy("a", F.col("w").alias("v")).agg(F.sum("n").alias("n"))
    ends = front.join(e.where(F.col("label") == last).select(F.col("dest").alias("v"), F.col("src").alias("z")), "v").groupBy("a", "z").agg(F.sum("n").alias("n"))
    closed = e.where(F.col("label") == closing).groupBy(F.col("src").alias("a"), F.col("dest").alias("z")).agg(F.count("*").alias("m"))
    return ends.join(closed, ["a", "z"], "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("walks"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("closed"))
