"""Quality rules and cross-document line frequency, in DataFrame functions only.

Per document: word and symbol counts, repeated lines, words in repeated
5-word windows. Across documents: lines are normalised (lower case, digits to
0, one space) and hashed; per host (the source) the distinct documents of a
line are counted. Copies of one text are one distinct document: were each to
count, a text copied more often than the limit would lose all its lines and go,
the last copy included (``count_copies`` counts them each). A line in more than ``MIN_DOCS``
documents of a host is removed, however many the host has; a document is
depleted, and rejected, where its remaining lines hold under ``LEFT_WORDS``
words or under ``LEFT_SHARE`` of the words of its distinct lines.

Defined results: a null or empty text has no words and fails; a null source is
a host; rows are told apart by id, source and a hash of the text, so repeated
rows get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import SPACE, cut

MIN_DOCS, LEFT_WORDS, LEFT_SHARE = 20, 10, 0.3
BLANKS = f"[{SPACE}]+"
HAS_WORD = f"[^{SPACE}]"
_KEY = ("doc_id", "source", "h")


def normal(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), BLANKS, " "))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def text_rules(docs: DataFrame) -> DataFrame:
    """_KEY and the rules that need one text only."""
    text = keyed(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))
    out = text.select(*_KEY, "text", F.array_remove(F.split("text", BLANKS), "").alias("words"), lines.alias("lines"))
    windows = F.expr("CASE WHEN size(words) >= 5 THEN transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) ELSE cast(array() AS array<bigint>) END")
    out = out.select(
        *_KEY, F.size("words").cast("long").alias("n_words"), (F.length("text") - F.regexp_count("text", F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    # only texts with a repeated window sort theirs: equal hashes are then neighbours
    pairs = F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (w, i) -> named_struct('w', w, 'i', i))) ELSE cast(array() AS array<struct<w:bigint,i:int>>) END")
    out = out.withColumn("pairs", pairs).drop("windows")
    starts = F.expr("sort_array(array_compact(transform(pairs, (x, k) -> CASE WHEN (k > 0 AND pairs[k - 1].w = x.w) OR (k + 1 < size(pairs) AND pairs[if(k + 1 < size(pairs), k + 1, k)].w = x.w) THEN x.i END)))")
    out = out.withColumn("starts", F.when(F.size("pairs") > 0, starts).otherwise(F.array().cast("array<int>"))).drop("pairs")
    covered = F.expr("aggregate(starts, named_struct('last', -5, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)), a -> cast(a.n AS bigint))")
    out = out.withColumn("n_repeat_words", covered).drop("starts")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def document_lines(docs: DataFrame) -> DataFrame:
    """_KEY, line hash and words of each distinct normalised line of each row."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD)), normal)
    hashed = F.transform(F.array_distinct(lines), lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))
    return keyed(docs).select(*_KEY, F.explode(hashed).alias("x")).select(*_KEY, "x.line", "x.words")


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, count_copies: bool = False) -> DataFrame:
    """(source, line) of the lines above the limit in their host."""
    per_line = lines.groupBy("source", "line", "h", *(["doc_id"] if count_copies else [])).agg(F.lit(1).alias("one")).groupBy("source", "line").agg(F.count("*").alias("n"))
    return per_line.where(F.col("n") > min_docs).select("source", "line")


def line_verdicts(docs: DataFrame, count_copies: bool = False) -> DataFrame:
    """_KEY, removed (hashes of the lines to remove) and depleted, for rows with such lines."""
    lines = cut(document_lines(docs))
    bad = frequent_lines(lines, count_copies=count_copies)
    hit = lines.alias("l").join(bad.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.line") == F.col("b.line")), "left_semi")
    gone = hit.groupBy(*_KEY).agg(F.collect_set(F.struct("line", "words")).alias("hit"))
    gone = gone.select(*_KEY, F.col("hit.line").alias("removed"), F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("gone_words"))
    every = lines.groupBy(*_KEY, "line").agg(F.max("words").alias("words")).groupBy(*_KEY).agg(F.sum("words").alias("line_words"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    both = gone.alias("g").join(every.alias("e"), same("g", "e"))
    left = F.col("line_words") - F.col("gone_words")
    return both.select("g.doc_id", "g.source", "g.h", "removed", ((left < LEFT_WORDS) | (left < F.col("line_words") * LEFT_SHARE)).alias("depleted"))


def judge_quality(docs: DataFrame, count_copies: bool = False) -> DataFrame:
    """_KEY, the rules' counts, base_failed, removed and kept of every row."""
    base, verdicts = text_rules(docs), line_verdicts(docs, count_copies)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.h") == F.col("b.h"))
    joined = base.alias("a").join(verdicts.alias("b"), same, "left")
    return joined.select("a.*", "b.removed", (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"))


def quality_report(docs: DataFrame, count_copies: bool = False) -> DataFrame:
    return judge_quality(docs, count_copies).drop("source", "h", "removed")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, without the lines above the limit; n_chars follows where there is one."""
    columns = docs.columns
    # materialised first: the filter would else be pushed into the rules and repeat their arrays for every row and place
    verdict = cut(judge_quality(docs)).where("kept").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("h").alias("__hash"), "removed").groupBy("__id", "__source", "__hash").agg(F.first("removed").alias("__removed"))
    text = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = text.join(verdict, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__h") == F.col("__hash")))
    stays = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__removed", F.xxhash64(normal(x)))), "\n")
    kept = kept.withColumn("text", F.when(F.col("__removed").isNotNull(), stays).otherwise(F.col("text")))
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*columns)
