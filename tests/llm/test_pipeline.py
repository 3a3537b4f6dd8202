import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from motifspark.llm import queries as q

from . import brute
from .test_operators import RANKS, docs_of, rng_text


def texts():
    rng = random.Random(31)
    own = [rng_text(rng, 60, 10**6) for _ in range(30)]
    near = own[0].split()
    near[30] = "zz"
    return [*own, own[1], " ".join(near), None, "", "too short", "a b c d e " * 20, own[2] + " x password = hunter22 y"]


def test_stages(spark):
    df = docs_of(spark, texts()).withColumn("copies", F.lit(7)).withColumn("spans", F.lit(None).cast("string"))
    assert [name for name, _ in p.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]
    good = p.quality(spark, df, None)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept == {i: t for i, t in enumerate(texts()) if not brute.quality(t or "")[5]} and good.columns == df.columns
    alone = p.near_duplicates(spark, good, None)
    ids = {r.doc_id for r in alone.collect()}
    assert ids == {d for d, (_, root) in brute.classes(list(kept.items()), 5, 4, 5).items() if d == root} and alone.columns == df.columns
    clean = p.secrets(spark, alone, None)
    for r in clean.collect():
        assert not brute.base_secrets(r.text) and r.n_chars == len(r.text) and (r.text == kept[r.doc_id]) == (not brute.base_secrets(kept[r.doc_id]))
    mixed = p.mixture(spark, clean, None)
    assert mixed.columns == df.columns
    words = {r.doc_id: len(brute.words(r.text)) for r in clean.collect()}
    taken = mixed.groupBy("doc_id").count().collect()
    assert all(r["count"] <= 2 for r in taken) and abs(sum(words[r.doc_id] * r["count"] for r in taken) - 1.5 * sum(words.values())) <= 2 * max(words.values())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    said = {r.doc_id: r.text for r in mixed.collect()}
    rows = p.tokens(spark, mixed, None).collect()
    assert len(rows) == mixed.count() and all(r.n_tokens == len(plain.encode_ordinary(said[r.doc_id])) and r.decoded_sha256 == brute.sha(said[r.doc_id].encode()) for r in rows)


def test_stages_of_nothing(spark):
    docs = docs_of(spark, [])
    for _, stage in p.STAGES:
        docs = stage(spark, docs, None)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    rows = p.run(spark, sf_dir).collect()
    again = p.run(spark, sf_dir).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from motifspark.llm import common

    class Session:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_folder(Session)
    assert q.TOKENIZER
