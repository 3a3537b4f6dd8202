"""The edge relation (src, label, dest) and vertex properties, from files or from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EDGE_SCHEMA = "src bigint, label int, dest bigint"
CATALOGUE_SCHEMA = "pattern_type int, vlist string, label_seq string, card bigint"
#: kind of vertex -> first id; ids are kind + key.
CUSTOMER, NATION, REGION, SUPPLIER, ORDER, PART = (k * 10**9 for k in range(1, 7))
#: label, table, source kind and column, target kind and column.
VIEWS = (
    (1, "customer", CUSTOMER, "c_custkey", NATION, "c_nationkey"), (2, "nation", NATION, "n_nationkey", REGION, "n_regionkey"),
    (3, "supplier", SUPPLIER, "s_suppkey", NATION, "s_nationkey"), (4, "orders", ORDER, "o_orderkey", CUSTOMER, "o_custkey"),
    (5, "lineitem", ORDER, "l_orderkey", PART, "l_partkey"), (6, "lineitem", ORDER, "l_orderkey", SUPPLIER, "l_suppkey"), (7, "lineitem", PART, "l_partkey", SUPPLIER, "l_suppkey"),
)
EDGE_SQL = " UNION ALL ".join(f"SELECT {'DISTINCT ' if t == 'lineitem' else ''}CAST({s} + {a} AS BIGINT) AS src, {label} AS label, CAST({d} + {b} AS BIGINT) AS dest FROM {t}" for label, t, s, a, d, b in VIEWS)
PROPS_SQL = f"SELECT CAST({ORDER} + o_orderkey AS BIGINT) AS vid, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders UNION ALL SELECT CAST({PART} + p_partkey AS BIGINT), CAST(p_size AS INTEGER) FROM part"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str, labels=None) -> DataFrame:
    """Only the tables behind the labels asked for are read, two columns each."""
    out = None
    for label, name, s, a, d, b in VIEWS:
        if labels is None or label in labels:
            part = table(spark, sf_dir, name).select((F.lit(s) + F.col(a)).cast("bigint").alias("src"), F.lit(label).alias("label"), (F.lit(d) + F.col(b)).cast("bigint").alias("dest"))
            part = part.distinct() if name == "lineitem" else part
            out = part if out is None else out.unionByName(part)
    return out


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, year): the order's year or the part's size; other vertices have none."""
    orders = table(spark, sf_dir, "orders").select((F.lit(ORDER) + F.col("o_orderkey")).cast("bigint").alias("vid"), F.year("o_orderdate").cast("int").alias("year"))
    parts = table(spark, sf_dir, "part").select((F.lit(PART) + F.col("p_partkey")).cast("bigint").alias("vid"), F.col("p_size").cast("int").alias("year"))
    return orders.unionByName(parts)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges from a CSV file of src,label,dest without header."""
    return spark.read.schema(EDGE_SCHEMA).csv(path)


def write_edges(frame: DataFrame, path: str) -> None:
    """One folder per label, so that a scan of some labels reads only theirs."""
    frame.write.mode("overwrite").partitionBy("label").parquet(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated vertex file with header; column 0 the id, column 4 a number or empty."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(F.col(raw.columns[0]).cast("bigint").alias("vid"), F.nullif(F.trim(F.col(raw.columns[4])), F.lit("")).cast("int").alias("year"))


def ntriples(frame: DataFrame) -> DataFrame:
    return frame.select(F.format_string("<%d> <%d> <%d> .", "src", "label", "dest").alias("line"))


def write_ntriples(frame: DataFrame, path: str) -> None:
    ntriples(frame).write.mode("overwrite").text(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    part = lambda i: F.regexp_extract("value", r"<(\d+)>\s+<(\d+)>\s+<(\d+)>", i)
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*<\d+>")).select(part(1).cast("bigint").alias("src"), part(2).cast("int").alias("label"), part(3).cast("bigint").alias("dest"))


def read_catalogue(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Catalogue entries of at most so many edges."""
    frame = spark.read.schema(CATALOGUE_SCHEMA).csv(path)
    return frame if most is None else frame.where(F.size(F.split("label_seq", "->")) <= most)


def write_catalogue(frame: DataFrame, path: str) -> None:
    """vlist, label_seq, card as a catalogue; the pattern's type is its number of edges."""
    frame.select(F.size(F.split("label_seq", "->")).cast("int").alias("pattern_type"), "vlist", "label_seq", F.col("card").cast("bigint").alias("card")).write.mode("overwrite").csv(path)


def merge_catalogues(*frames: DataFrame) -> DataFrame:
    """One entry of each pattern; catalogues of the same graph agree on it."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("pattern_type", "vlist", "label_seq").agg(F.max("card").alias("card"))


DEGREE_SCHEMA = "direction int, label int, max_deg bigint"


def write_max_degrees(frame: DataFrame, path: str) -> None:
    frame.select("direction", "label", "max_deg").write.mode("overwrite").csv(path)


def read_max_degrees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEGREE_SCHEMA).csv(path)


def shuffle_labels(frame: DataFrame, labels: int, seed: int = 0) -> DataFrame:
    """Every edge gets a label from 0 by a hash of its ends and the seed."""
    return frame.withColumn("label", F.pmod(F.xxhash64("src", "dest", F.lit(seed)), F.lit(labels)).cast("int"))


def random_graph(spark: SparkSession, vertices: int, count: int, labels: int, directed: bool = True, seed: int = 0) -> DataFrame:
    """count distinct edges without loops; labels are numbered after the vertices. Draws four times as many as asked and keeps the first by hash."""
    if count > vertices * (vertices - 1) // (1 if directed else 2):
        raise ValueError("more edges than pairs of vertices")
    tries = 4 * count + 100
    while True:
        h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(vertices))
        drawn = spark.range(tries).select(h(1).alias("a"), h(2).alias("b")).where("a <> b")
        drawn = drawn if directed else drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        drawn = drawn.distinct()
        if drawn.count() >= count:
            break
        tries *= 2
    kept = drawn.orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b").limit(count)
    return shuffle_labels(kept.select(F.col("a").alias("src"), F.lit(0).alias("label"), F.col("b").alias("dest")), labels, seed).withColumn("label", F.col("label") + vertices)
