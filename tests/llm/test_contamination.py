import brute
from ridgework.llm import contamination


def test_documents(spark, documents, nothing, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "one"), (901, "one two"), (902, None), (903, "  "), (None, "same row same"), (904, "same row same row same row same row same row same"), (905, items[0][1])]
    benchmark = spark.createDataFrame(items + [items[3]], "item_id bigint, text string")
    rows = documents.select("doc_id", "text").collect()
    wanted = sorted(zip([str(r[0]) for r in rows], brute.contamination([r[1] for r in rows], items)))
    for words in (400_000, 300):
        monkeypatch.setattr(contamination, "BLOCK_WORDS", words)
        found = contamination.digest(contamination.contained(documents, benchmark)).collect()
        assert sorted((str(r[0]), tuple(r[1:])) for r in found) == wanted
    clean = contamination.clean(documents, benchmark)
    assert clean.columns == documents.columns and clean.count() == sum(not w[-1] for _, w in wanted)
    assert contamination.contained(nothing, benchmark).collect() == []
    none = contamination.digest(contamination.contained(documents, benchmark.where("false")))
    assert none.where("contaminated or n_hit > 0").count() == 0
