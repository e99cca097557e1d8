import random

import pytest
from pyspark.sql import functions as F

import brute
from ridgework.llm import fingerprints
from ridgework.llm.components import components


def test_documents(spark, documents, nothing):
    rows = fingerprints.near_duplicates(documents).collect()
    plain = {(r["doc_id"], r["text"]): brute.fingerprint(r["text"]) for r in documents.collect()}
    assert sorted((str(r["doc_id"]), r["print"] % 2**64) for r in rows) == sorted(
        (str(r["doc_id"]), brute.fingerprint(r["text"])) for r in documents.collect()
    )
    named = {i: p for (i, _), p in plain.items() if i is not None}
    wanted = brute.components(named)
    assert all(r["component_id"] == wanted[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert fingerprints.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowd", [64, 1])
def test_families_of_near_prints(spark, bits, crowd):
    random.seed(bits)
    prints = {0}
    for _ in range(6):
        center = random.getrandbits(64)
        for _ in range(40):
            prints.add(center)
            center ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 3)))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    found = fingerprints.near_prints(spark.createDataFrame(signed, "print bigint"), bits, crowd)
    got = {r["node"]: r["component"] for r in components(found).collect()}
    values = [p for p, in signed]
    wanted = brute.components({p: p % 2**64 for p in values}, bits) if bits else {}
    grouped = {p: c for p, c in wanted.items() if list(wanted.values()).count(c) > 1}
    assert got == grouped


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100}


def test_keep_one(spark, documents):
    kept = fingerprints.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    found = fingerprints.near_duplicates(documents).where(F.col("doc_id").isNotNull())
    assert sorted(i for i in ids if i is not None) == sorted(r[0] for r in found.select("component_id").distinct().collect())
    assert ids.count(None) == 1


def test_keep_one_of_rows_that_share_an_id(spark):
    a, b, c = ("%s one two three four five six seven %s" % (x, x * 3) for x in "abc")
    rows = [(5, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (8, c, "x"), (8, c, "y"), (None, c, "x")]
    kept = fingerprints.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, __head string"))
    assert sorted((r[0] or 0, r[1], r[2]) for r in kept.collect()) == sorted([(5, a, "x"), (5, b, "x"), (8, c, "x"), (8, c, "y"), (0, c, "x")])
