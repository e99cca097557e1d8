import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, bin bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Given documents with odd ones added: nulls, empty and long texts, copies, repeated rows, clashing columns."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    random.seed(5)
    long_text = " ".join(random.choice(["anan", "ereth", "onist", "theou", "lyish", "word"]) + str(random.randrange(900)) for _ in range(9000))
    passage = long_text[1000:1900]
    odd = [
        (9001, None, None, None, None, None, None), (9002, "", "en", "a", 0, "x", 2), (9003, " \n\t ", "en", "a", 4, "x", 2),
        (9004, long_text, "en", "a", 1, "x", 2), (9005, "Ünder the MIT license " + passage + " tail one", "en", "a", 1, "x", 2),
        (9006, "another start " + passage + " tail two é", "en", "a", 1, "x", 2), (9007, "a" * 1500, "en", "a", 1, "x", 2),
        (9008, "one", "en", "a", 1, "x", 2), (9009, "one two", "en", "a", 1, "x", 2), (9010, "12 34 !!", "en", "a", 1, "x", 2),
        (9011, "same row " * 70, "en", "a", 1, "x", 2), (9011, "same row " * 70, "en", "a", 1, "x", 2), (None, "no id " * 90, "de", "a", 1, "x", 2),
        (9012, "X  double  space\r\n tail  nbsp   sep", "fr", "a", 1, "x", 2),
    ]
    near = long_text.split(" ")[:400]
    for i in range(6):
        changed = list(near)
        changed[37 * (i + 1)] = f"changed{i}"
        odd.append((9100 + i, " ".join(changed), "en", "a", 1, "x", 2))
    return spark.createDataFrame(rows + odd, DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
