import random

import brute
import pytest
from pyspark.sql import functions as F

from ridgework.llm import prefix_trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, key string, a bigint"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(spark, rows, **options):
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(5)
    found = prefix_trie.prefix_nodes(given, **options)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_given_and_odd_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    random.seed(3)
    # NULLs, ties, repeated rows, ids below zero, one long conversation and copies of another.
    rows += [(None, 1, "user", "nobody's"), (9000, None, None, None), (9000, None, "user", "first"), (9000, 0, "user", ""), (9000, 0, "user", ""),
             (9000, 0, "tool", " a\tb  c "), (9000, 1, "user:", "x"), (9021, 5, "user", ":x"), (-5, 0, "user", "minus"), (-41, 0, "user", "minus"), (-41, 2, "", "z")]
    rows += [(9100, i, "user", f"turn {i // 2} {'word ' * (i % 5)}") for i in range(300)]
    rows += [(9200 + c, i, "user", f"same {i}") for c in range(60) for i in range(6)]
    assert nodes(spark, rows) == brute.prefix_nodes(rows)
    assert nodes(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_branching_at_every_depth(spark, seed):
    """Conversations that leave a common one after any number of turns, branch again, or are prefixes of others."""
    random.seed(seed)
    rows = []
    for conv in range(1000, 1150):
        walk = ["t0"] * random.randint(0, 2)
        while random.random() < 0.85 and len(walk) < 25:
            walk.append(random.choice(["main", "main", "main", "side", f"own{random.randrange(3)}"]))
        rows += [(conv, i, "user", word) for i, word in enumerate(walk)]
    assert nodes(spark, rows, group=7, heads=3) == brute.prefix_nodes(rows, 7, 3)


def test_fattest_number_of_an_interval(spark):
    spans = [(low, high) for low in range(40) for high in range(low + 1, 41)]
    got = spark.createDataFrame(spans, "low bigint, high bigint").select("low", "high", prefix_trie.fattest("low", "high").alias("f")).collect()
    assert all(r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x) for r in got)


def test_ids_of_one_place_are_written_in_bounded_strings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    ends = spark.range(100).select((F.col("id") % 2).alias("end"), F.lit(1).cast("bigint").alias("a"), F.lit(2).cast("bigint").alias("b"), F.col("id").alias("conv_id"))
    got = {r["end"]: r["digest"] for r in prefix_trie.end_digests(ends).collect()}
    digest = lambda ids: brute.hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {0: digest(range(0, 100, 2)), 1: digest(range(1, 100, 2))}
