import random

import brute
import numpy as np
import pytest

from ridgework.llm import odd_sketches


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, sid int").repartition(5)
    got = sorted((tuple(r) for r in odd_sketches.near_copies(docs, **options).collect()), key=str)
    assert got == sorted(((i, n, c, i == c) for i, n, c in brute.alike_heads(rows)), key=str)


def edited(words, n):
    words = list(words)
    for i in random.sample(range(len(words)), n):
        words[i] = f"new{random.random()}"
    return " ".join(words)


def test_documents(spark, documents, nothing):
    check(spark, [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert odd_sketches.near_copies(nothing).collect() == []


@pytest.mark.parametrize("by_heads", [True, False])
def test_families_against_all_pairs(spark, by_heads):
    """Families around one text, chains, and unlike documents that share a passage; also by prefixes alone."""
    random.seed(by_heads)
    fresh = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    rows = []
    for size in (6, 30, 120, 300):
        base = fresh(size)
        rows += [(len(rows) + i, edited(base, random.randint(0, max(1, size // 25)))) for i in range(25)]
    link = fresh(150)
    for _ in range(12):
        for _ in range(2):
            link[random.randrange(150)] = f"step{random.random()}"
        rows.append((len(rows), " ".join(link)))
    passage = " ".join(fresh(150))
    rows += [(len(rows) + i, f"{' '.join(fresh(15))} {passage} {' '.join(fresh(10))}") for i in range(40)]
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a  B"), (904, "a b c"), (905, rows[3][1]), (906, rows[3][1].upper()), (907, " \n")]
    check(spark, rows, by_heads=by_heads)


def test_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    check(spark, [(5, a), (5, b), (7, b), (8, c), (8, c), (None, c), (None, "lone words are here"), (9, None), (9, ""), (None, None), (5, None)])


def test_sketches_tell_resemblance():
    """Over many pairs at the least resemblance none passes the cut or misses every band; unlike pairs mostly pass it."""
    random.seed(1)
    over, missed, unlike = 0, 0, 0
    rng = np.random.default_rng(1)
    for _ in range(300):
        both, one, two = rng.integers(0, 2**63, 170, dtype=np.uint64), *(rng.integers(0, 2**63, 15, dtype=np.uint64) for _ in range(2))
        x, y = (odd_sketches.samples(np.concatenate([both, own])) for own in (one, two))
        distance = lambda p, q: sum(int(v).bit_count() for v in (odd_sketches.odd_sketch(p) ^ odd_sketches.odd_sketch(q)).view(np.uint64))
        over += distance(x, y) > odd_sketches.odd_cut()
        missed += not set(odd_sketches.band_keys(x)) & set(odd_sketches.band_keys(y))
        differ = sum(int(v).bit_count() for v in (odd_sketches.whole_sketch(np.append(both, one)) ^ odd_sketches.whole_sketch(np.append(both, two))).view(np.uint64))
        assert 24 <= differ <= 30
        far = odd_sketches.samples(np.concatenate([both[:80], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
        unlike += distance(x, far) > odd_sketches.odd_cut()
    assert (over, missed) == (0, 0) and unlike > 290
    assert 80 < odd_sketches.odd_cut() <= 2 * odd_sketches.SAMPLES
