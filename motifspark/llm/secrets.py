"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assign, access, hex) are always reported. Weak candidates -
an account name, a mixed random-looking word, an endpoint - say little alone;
each is reported only where a part of another class (identifier, secret,
endpoint) lies within ``SCOPE`` code points. That is an interval join: each
weak interval, widened by the scope, and each part are laid over bins of
``BIN`` code points, and a left-semi join on document and bin with the overlap
test keeps the weak ones that have a partner, without making the pairs.

Positions come from the lengths of matches and of the texts between them
(prefix sums in two levels, so that a text with many matches costs m**1.5 and
not m**2).

Defined results: a null or empty text has no spans; a null id is compared
null-safe; rows are told apart by id and a hash of the text, so repeated rows
get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, class of part, pattern. [A-Z0-9]{16,} after AKIA is the run of 20 characters or more, as is {24,} for hex.
STRONG = (("assign", "secret", ASSIGN), ("access", "id", r"AKIA[A-Z0-9]{16,}"), ("hex", "secret", r"[0-9a-f]{24,}"))
WEAK = (
    ("account", "id", r"""\b(?i:user|username|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""),
    ("mixed", "secret", r"[A-Za-z0-9+/_-]{20,}"),
    ("endpoint", "endpoint", r"""https?://[^\s"'<>]{4,}"""),
)
SCOPE, BIN, CHUNK = 200, 256, 512
ORDER = {kind: i for i, (kind, _, _) in enumerate(STRONG + WEAK)}
_SPAN = "struct<s:bigint,e:bigint>"


def _spans(matches: str, gaps: str) -> str:
    """Array of (s, e) from the matched strings and the lengths of what lies between."""
    return f"""CASE WHEN size({matches}) = 0 THEN cast(array() AS array<{_SPAN}>) ELSE
      transform(array(transform(sequence(0, (size({matches}) - 1) div {CHUNK}), c -> slice(zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, m) -> named_struct('g', cast(g AS bigint), 'l', cast(length(m) AS bigint))), c * {CHUNK} + 1, {CHUNK}))), ch ->
        flatten(zip_with(ch, aggregate(slice(ch, 1, size(ch) - 1), array(0L), (a, x) -> concat(a, array(element_at(a, -1) + aggregate(x, 0L, (b, y) -> b + y.g + y.l)))), (x, o) ->
          aggregate(x, named_struct('p', o, 'found', cast(array() AS array<{_SPAN}>)),
            (a, y) -> named_struct('p', a.p + y.g + y.l, 'found', concat(a.found, array(named_struct('s', a.p + y.g, 'e', a.p + y.g + y.l)))), a -> a.found))))[0] END"""


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, strong, weak, covered): arrays of (s, o, e, kind, class) of every row; covered holds the weak candidates that touch a strong span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    out = frame.withColumn("h", F.xxhash64("text"))
    out = out.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, _, p in STRONG + WEAK])
    none = F.array().cast("array<int>")
    gaps = [F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), F.length)).otherwise(none).alias(f"g_{k}") for k, _, p in STRONG + WEAK]
    values = F.when(F.size("m_assign") > 0, F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.length)).otherwise(none).alias("value_length")
    out = out.select("*", *gaps, values)
    out = out.select("doc_id", "h", "value_length", *[f"m_{k}" for k in ORDER], *[F.expr(_spans(f"m_{k}", f"g_{k}")).alias(f"s_{k}") for k in ORDER])

    def tagged(kind: str, part: str) -> Column:
        if kind == "assign":
            sound = "filter(zip_with(s_assign, value_length, (x, n) -> if(n >= 6, x, null)), x -> x IS NOT NULL)"
        elif kind == "mixed":
            sound = "filter(zip_with(s_mixed, m_mixed, (x, m) -> if(m RLIKE '[0-9]' AND m RLIKE '[A-Z]' AND m RLIKE '[a-z]', x, null)), x -> x IS NOT NULL)"
        else:
            sound = f"s_{kind}"
        return F.expr(f"transform({sound}, x -> named_struct('s', x.s, 'o', {ORDER[kind]}, 'e', x.e, 'kind', '{kind}', 'part', '{part}'))")

    strong = F.array_sort(F.concat(*[tagged(k, c) for k, c, _ in STRONG]))
    weak = F.concat(*[tagged(k, c) for k, c, _ in WEAK])
    out = out.select("doc_id", "h", strong.alias("strong"), weak.alias("weak"))
    # a weak candidate inside or across a strong span is not reported, but is a part of its class
    touches = lambda keep: F.expr(f"filter(weak, w -> {keep} exists(strong, b -> b.s < w.e AND w.s < b.e))")
    both = (F.size("strong") > 0) & (F.size("weak") > 0)
    return out.select("doc_id", "h", "strong", F.when(both, touches("NOT")).otherwise(F.col("weak")).alias("weak"), F.when(both, touches("")).otherwise(F.expr("slice(weak, 1, 0)")).alias("covered"))


def linked_weak(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, h, linked): the weak candidates with a part of another class in scope."""
    some = parts.where(F.size("weak") > 0).where(F.size("weak") + F.size("strong") > 1)
    each = some.select("doc_id", "h", F.explode(F.concat("strong", "weak", "covered")).alias("x")).select("doc_id", "h", "x.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    near = some.select("doc_id", "h", F.explode("weak").alias("x")).select("doc_id", "h", "x.*").withColumn("bin", bins(F.greatest(F.col("s") - scope, F.lit(0)), F.col("e") + scope)).alias("w")
    part = each.select("doc_id", "h", "s", "e", "part", bins(F.col("s"), F.col("e")).alias("bin")).alias("p")
    meet = F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.h") == F.col("p.h")) & (F.col("w.bin") == F.col("p.bin"))
    pair = (F.col("w.part") != F.col("p.part")) & (F.col("p.s") < F.col("w.e") + scope) & (F.col("w.s") < F.col("p.e") + scope)
    found = near.join(part, meet & pair, "left_semi")
    return found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "o", "e", "kind", "part")).alias("linked"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, strong, spans) of every row; spans holds strong and linked weak parts by start."""
    parts = cut(find_parts(docs, id_col, text_col))
    linked = linked_weak(parts, scope)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    joined = parts.alias("a").join(linked.alias("b"), same, "left")
    spans = F.when(F.col("linked").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", F.coalesce("linked", F.expr("slice(strong, 1, 0)")))))
    return joined.select("a.doc_id", "a.h", "a.strong", spans.alias("spans"))


def spelled(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("strong", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k, _, _ in STRONG], F.sha2(spelled("strong"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of its text replaced by a mark; n_chars follows where there is one."""
    kept = docs.columns
    keyed = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = scan_secrets(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("h").alias("__f"), "spans").groupBy("__id", "__f").agg(F.first("spans").alias("__spans"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__f")), "left")
    # pieces between spans; overlapping spans share one mark
    cutter = f"""aggregate(__spans, named_struct('at', 0L, 'out', cast(array() AS array<string>)), (a, x) ->
      CASE WHEN x.s >= a.at THEN named_struct('at', x.e, 'out', concat(a.out, array(substring(text, cast(a.at + 1 AS int), cast(x.s - a.at AS int)), '{mark}')))
      ELSE named_struct('at', greatest(a.at, x.e), 'out', a.out) END, a -> concat(array_join(a.out, ''), substring(text, cast(a.at + 1 AS int))))"""
    out = joined.withColumn("text", F.when(F.col("__spans").isNotNull(), F.expr(cutter)).otherwise(F.col("text")))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*kept)
