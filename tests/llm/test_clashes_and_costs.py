"""Rows of the caller come back whole, whatever their columns are called; costs of rules are measured."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, quality

NAMES = ("n_words", "_w", "_text", "_kept", "_stop", "_row", "_copy", "_size", "_d", "_mix", "_id", "_source", "_key", "_block", "units", "shard", "place", "words", "rest", "dkey", "blk", "parts", "node", "component", "_words", "_again", "least", "sequence_id", "part")


def odd_columns(spark):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(60 + i % 3)), "s" if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: (F.col("doc_id") * 100 + k).cast("int") for k, c in enumerate(NAMES)})


def intact(out, columns):
    assert out.columns == columns
    rows = out.collect()
    assert rows and all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(NAMES))


def test_stages_keep_columns_of_any_name(spark):
    docs = odd_columns(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        intact(stage(spark, docs, None), docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() >= 30


def test_mixing_figures_with_columns_of_any_name(spark):
    docs = odd_columns(spark)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 30 and all(r.taken <= 2 * r.size for r in got)


def test_a_slow_rule_goes_last(spark):
    """Of two rules that reject alike, the one that hashes each text a thousand times runs later."""
    texts = spark.createDataFrame([(f"some words number {i} " * 20,) for i in range(500)], "_text string")
    slow = quality.Metric("slow", (("slow", lambda: F.aggregate(F.sequence(F.lit(1), F.lit(1000)), F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.xxhash64("_text", k)))),))
    quick = quality.Metric("quick", (("quick", lambda: F.xxhash64("_text")),))
    rules = [quality.Rule("slow", (slow,), "slow % 2 = 0"), quality.Rule("quick", (quick,), "quick % 2 = 0")]
    measured = quality.measure_rules(texts, rules)
    assert measured[0][1] > 5 * measured[1][1] and all(0.3 < share < 0.7 for share, _ in measured)
    assert quality.order_rules(texts, rules) == [1, 0]
    never = quality.Rule("never", (quick,), "quick = 1 AND quick = 2")
    assert quality.order_rules(texts, [never, rules[1]]) == [1, 0]
    assert quality.order_rules(texts.limit(0), rules) == [0, 1]
