import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ridgework.llm import packing


def check(rows, texts, capacity):
    """Round trip: pieces rebuild every document's ids, and sequences have no gaps."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for doc_id, text in texts:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = packing.cut(len(ids), capacity)
        assert all(size == capacity for _, size in cuts[1:]) and sum(size for _, size in cuts) == len(ids)
        wanted += [(str(doc_id), n, at, size, zlib.crc32(ids[at:at + size].tobytes())) for n, (at, size) in enumerate(cuts)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(wanted)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in wanted) // capacity)


def test_documents(spark, documents, nothing):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    used, least = check(packing.packed(documents).collect(), texts, 2048)
    assert used <= least * 1.02 + 1
    assert packing.packed(nothing).collect() == []


def test_rounds_of_merging(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "FIRST_PIECES", 20)
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    used, least = check(packing.packed(documents, capacity=512).collect(), texts, 512)
    assert used <= least * 1.02 + 2
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    check(packing.packed(documents, capacity=512).collect(), texts, 512)


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3], 10) == [(0, 0), (1, 0), (0, 6), (1, 5)]
    assert packing.best_fit([], 10) == []


def test_added_token(spark):
    """The added token of the JSON form is one id wherever it stands."""
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n<|endoftext|>", "a  <|endoftext|>\n b c", "<|endoftext|", "un<|endoftext|>der way <|ENDOFTEXT|>"]
    texts = list(enumerate(odd + [" word<|endoftext|> more" * 900]))
    check(packing.packed(spark.createDataFrame(texts, "doc_id bigint, text string"), capacity=512).collect(), texts, 512)
