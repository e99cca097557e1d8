import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from ridgework.llm import repeats
from ridgework.llm.suffixes import common_prefix, front_code, front_decode, merge


def digests(docs, **how):
    rows = repeats.without_repeats(docs, **how).select("doc_id", "text", "__kept.n_bytes", "__kept.n_removed", "__kept.n_spans", "__kept.sha256").collect()
    return sorted((str(r[0]), r[1] or "", *r[2:]) for r in rows)


def wanted(docs, length):
    rows = docs.select("doc_id", "text").collect()
    return sorted((str(r[0]), r[1] or "", *d) for r, d in zip(rows, brute.repeats([r[1] for r in rows], length)))


def test_documents(spark, documents):
    assert digests(documents) == wanted(documents, 400)
    rows = repeats.without_repeats(documents.withColumn("tid", F.lit("x"))).select("doc_id", "text", "__kept.n_word_runs", "__kept.n_run_words").collect()
    assert [(r[2], r[3]) for r in rows] == brute.word_runs([r[1] for r in rows], 51) and sum(r[2] for r in rows) > 20


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_tiny_windows(spark, crowd):
    random.seed(crowd)
    texts = ["".join(random.choice("abé") for _ in range(random.randrange(90))) for _ in range(150)] + ["ab" * 50, None, "", "ab" * 50]
    passage = "".join(random.choice("abcdefgh") for _ in range(40))
    texts += [f"{i}x{passage[i % 7:40 - i % 5]}{i * 7919}" for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    assert digests(docs, length=12, core=4, crowd=crowd) == wanted(docs, 12)


def test_empty_and_pipeline_form(spark, documents, nothing):
    assert digests(nothing) == []
    assert repeats.cut_repeats(nothing).collect() == []
    cut = repeats.cut_repeats(documents)
    assert cut.columns == documents.columns and cut.count() == documents.count()
    changed = cut.join(documents.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before and n_chars <> length(text)")
    assert changed.count() == 0


def test_merge_gives_order_and_shared_prefixes():
    random.seed(3)
    for _ in range(100):
        runs, everything = [], []
        for _ in range(random.randint(1, 6)):
            run = sorted(bytes(random.choice(b"ab") for _ in range(random.randint(0, 8))) for _ in range(random.randint(0, 9)))
            shared, rests = front_code(run)
            assert front_decode(shared, rests) == run
            runs.append((run, shared))
            everything += run
        out, last = list(merge(runs)), b""
        assert [runs[r][0][p] for r, p, _ in out] == sorted(everything)
        for r, p, shared in out:
            assert shared == common_prefix(last, runs[r][0][p])
            last = runs[r][0][p]


def test_many_contexts_agree_with_pairs():
    random.seed(4)
    m, length = 160, 40
    rows = sorted(
        (b"c" * 10 + bytes(random.choice(b"ab") for _ in range(random.randint(10, 30))), bytes(random.choice(b"ab") for _ in range(random.randint(0, 15))))
        for _ in range(m)
    )
    shared, _ = front_code([a for a, _ in rows])
    sizes, before = [len(a) for a, _ in rows], [b for _, b in rows]
    many = repeats.reaches(before, shared.tolist(), sizes, [False] * m, length)
    for i in range(m):
        pairs = [(common_prefix(before[i], before[j]), common_prefix(rows[i][0], rows[j][0])) for j in range(m) if j != i]
        good = [(left, right) for left, right in pairs if left + right >= length]
        assert (many[0][i], many[1][i]) == (max((a for a, _ in good), default=0), max((b for _, b in good), default=0))


def test_stage_cuts_short_passages_of_51_words(spark):
    """Planted runs of 51 words, under 400 bytes, go from every document; runs of 50 stay."""
    random.seed(6)
    fresh = lambda n: " ".join(f"{random.choice('abc')}{random.randrange(10**5)}" for _ in range(n))
    long_, short, within = fresh(51), fresh(50), fresh(60)
    assert len(long_.encode()) < 400
    texts = [f"{fresh(30)} {long_} {fresh(20 + i)}" for i in range(4)] + [f"{fresh(30)} {short} {fresh(20)}" for _ in range(4)]
    texts += [long_, f"é {long_.replace(' ', chr(10))} ü", f"{within} {fresh(9)} {within}", f"{long_[:-1]}", "w " * 49, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}

    lists = [(t or "").split() for t in texts]
    seen = {}
    for words in lists:
        for i in range(len(words) - 50):
            seen[tuple(words[i:i + 51])] = seen.get(tuple(words[i:i + 51]), 0) + 1
    for i, words in enumerate(lists):
        gone = {j for k in range(len(words) - 50) if seen[tuple(words[k:k + 51])] > 1 for j in range(k, k + 51)}
        left = [w for j, w in enumerate(words) if j not in gone]
        assert (got[i] or "").split() == left
    assert got[4] == texts[4] and got[8] == "" and got[13] is None
