
import pytest

import brute
from ridgework.llm import language, licences


def test_licences(spark, documents, nothing):
    rows = licences.licences(documents).collect()
    wanted = []
    for r in documents.collect():
        w = brute.words(r["text"])
        starts, labels = [], set()
        for phrase, label in licences.BASE_PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        wanted.append((str(r["doc_id"]), len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    key = lambda row: tuple(map(str, row))
    assert sorted(((str(r["doc_id"]), *r[1:6]) for r in rows), key=key) == sorted(wanted, key=key)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licences.licences(nothing).collect() == []


@pytest.mark.parametrize("text, labels, score", [
    ("// SPDX-License-Identifier: MIT\nx", {"mit"}, 1.0),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", {"mit", "gpl-2.0-only", "apache-2.0"}, 1.0),
    ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 OR MIT and GPL-2.0", {"gpl-2.0-with-classpath-exception-2.0", "mit", "gpl-2.0"}, 0.4),
    ("SPDX-License-Identifier: GPL-3.0 this file is", {"gpl-3.0"}, 0.4),
    ("SPDX-License-Identifier: ) or and", set(), 0.0),
    ("under the MIT, license; Under The mit License!", {"mit"}, 1.0),
    (None, set(), 0.0),
])
def test_expressions(text, labels, score):
    found = licences.Scanner().scan(text)
    assert set(filter(None, found[5].split(","))) == labels and found[6] == pytest.approx(score)


def test_precedence():
    assert licences.to_postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    for wrong in ("a b", "( a", "a )", "a or", "or a", ""):
        with pytest.raises(ValueError):
            licences.to_postfix(wrong.split())


def test_languages(spark, documents, nothing):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.languages(given).join(given.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    rows = {r["doc_id"]: r for r in language.languages(documents).collect()}
    for i in (9001, 9002, 9003, 9010):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and not rows[None]["held_out"]
    assert language.languages(nothing).collect() == []
    assert {r["lang_pred"] for r in language.languages(documents.withColumn("lang", documents["lang"].substr(9, 1)).where("doc_id < 0")).collect()} <= {"und"}


def test_prediction_uses_text_alone(spark, documents):
    contents = language.dictionaries(language.sample(documents))
    a = {(r["doc_id"], r["lang_pred"]) for r in language.identify(documents, contents).collect()}
    b = {(r["doc_id"], r["lang_pred"]) for r in language.identify(documents.selectExpr("doc_id", "text"), contents).collect()}
    assert a == b
