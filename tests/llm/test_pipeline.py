import corpus_pipeline
import brute
from ridgework.llm import packing, quality
from ridgework.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    """Every stage but quality's certified cutoffs is redone plainly on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, function in corpus_pipeline.STAGES:
        steps.append(stage(function(spark, steps[-1], SF), name))
    rows = [{r["doc_id"]: r.asDict() for r in step.collect()} for step in steps[:-1]]
    assert all(step.columns == docs.columns for step in steps[:-1])
    verdicts = quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("__verdict.kept").select("doc_id")
    assert set(rows[1]) == {r["doc_id"] for r in verdicts.collect()}
    heads = brute.components({i: brute.fingerprint(r["text"]) for i, r in rows[1].items()})
    assert set(rows[2]) == set(heads.values())
    ids = sorted(rows[2])
    assert set(rows[3]) == set(ids)
    cut = dict(zip(ids, brute.cut([rows[2][i]["text"] for i in ids], 400, 51)))
    assert {i: rows[3][i]["text"] for i in ids} == cut
    assert all(rows[3][i]["n_chars"] == len(cut[i]) for i in ids if cut[i] != rows[2][i]["text"])
    assert all(rows[3][i] == rows[2][i] for i in ids if cut[i] == rows[2][i]["text"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = dict(zip(sorted(rows[3]), brute.contamination([rows[3][i]["text"] for i in sorted(rows[3])], items)))
    assert set(rows[4]) == {i for i, f in found.items() if not f[-1]}
    pieces = steps[-1].collect()
    assert {r["doc_id"] for r in pieces} == set(rows[4]) and max(r["offset"] + r["length"] for r in pieces) <= packing.CAPACITY
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces
    )


def test_odd_documents(spark, documents, nothing):
    """NULLs, empty and long texts, copies, repeated rows and further columns go through every stage; so does no document."""
    for docs, some in ((documents, True), (nothing, False)):
        step = docs
        for name, function in corpus_pipeline.STAGES[:-1]:
            step = stage(function(spark, step, SF), name)
            assert step.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, step, SF)
        assert (packed.count() > 0) == some


def test_planted_cases(spark):
    """An exact copy goes, a passage of 51 words that two documents share goes, a document that holds a benchmark item goes."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    fresh = lambda seed, n: " ".join(f"word{seed}x{i}" for i in range(n))
    passage = fresh("p", 51)
    rows = [
        (1, fresh("a", 120)), (2, fresh("a", 120)), (3, f"{fresh('b', 70)} {passage} {fresh('c', 70)}"),
        (4, f"{fresh('d', 90)}\n{passage}\n{fresh('e', 40)}"), (5, f"{fresh('f', 100)} {item} {fresh('g', 100)}"), (6, fresh("h", 120)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, function in corpus_pipeline.STAGES[1:-1]:
        docs = stage(function(spark, docs, SF), name)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(got) == [1, 3, 4, 6] and got[1] == rows[0][1] and got[6] == rows[5][1]
    assert passage not in got[3] and passage not in got[4]
    assert got[3].split() == (fresh("b", 70) + " " + fresh("c", 70)).split()
