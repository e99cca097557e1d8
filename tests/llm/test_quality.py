import pytest
from pyspark.sql import functions as F

import brute
from ridgework.llm import quality


def test_counts(spark, documents, nothing):
    got = quality.measures(documents).select("doc_id", "__measures.*").collect()
    wanted = sorted((str(r["doc_id"]), *brute.quality_counts(r["text"])) for r in documents.collect())
    assert sorted((str(r[0]), *r[1:6]) for r in got) == wanted
    assert quality.quality(nothing, spark.createDataFrame([], "doc_id bigint, quality int")).collect() == []


@pytest.mark.parametrize("n, p", [(10, 0.3), (1000, 0.004), (5000, 0.02), (40, 0.5)])
def test_binomial_bound(spark, n, p):
    ks = [k for k in {0, 1, 2, int(n * p / 2), int(n * p) - 1} if 0 <= k < n * p]
    rows = spark.createDataFrame([(k,) for k in ks], "k int").select("k", quality.binomial_at_most(F.col("k"), F.lit(n), p).alias("b")).collect()
    for r in rows:
        assert r["b"] == pytest.approx(brute.binomial_at_most(r["k"], n, p), rel=1e-9)


def test_certified_cutoffs(spark):
    """A stratum with enough clean labels certifies down to where good documents begin; a small one nothing."""
    def row(i, lang, symbols):
        return (i, " ".join(f"{i}w{j}" + "#" * symbols for j in range(60)), lang, "x")

    good = [row(i, "en", 0) for i in range(3000)] + [row(5000 + i, "de", 0) for i in range(40)]
    bad = [row(8000, "en", 3), row(8001, "de", 3)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, measures string").repartition(6)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(8000, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    verdicts = {r["doc_id"]: r for r in quality.quality(docs, labels).select("doc_id", "__verdict.*").collect()}
    assert not verdicts[8000]["kept"] and "symbols" in verdicts[8000]["failed"]
    assert verdicts[8001]["kept"] and verdicts[1]["kept"] and not verdicts[1]["base_failed"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in verdicts.items() if v["kept"]}


def test_stops_at_the_first_failure(spark):
    rule = quality.Rule("symbols", "n_symbols", "n_words", (2.0, 1.0, 0.5))
    promise = quality.Certificate(risk=0.05, delta=0.05, rules=(rule,))
    rows = [(i, {"n_words": 100, "n_symbols": 100 if i < 40 else 0, "n_repeat_words": 0}, "en") for i in range(400)]
    measured = spark.createDataFrame(rows, "doc_id bigint, __measures struct<n_words: bigint, n_symbols: bigint, n_repeat_words: bigint>, lang string").withColumn("__row", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id bigint, quality int")
    assert quality.certify(measured, labels, "lang", promise).collect()[0]["cutoffs"] == {"symbols": 2.0}
