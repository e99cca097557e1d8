"""Language of texts by compression: the dictionary that shortens a text most names its language.

One zstandard raw-content dictionary per language is filled with text of that language. A text is
reduced to lower-case letters and single spaces, split into blocks, and each block is compressed with
every dictionary; the sizes of all blocks are added, so the whole text counts. The smallest sum wins;
the share by which the next one is larger is the margin, and a prediction with a margin under
``MIN_MARGIN`` is marked as rejected.

Dictionaries are fitted on a bounded sample: at most ``SAMPLE_DOCS`` documents per language, the ones with
the least hash of their ``doc_id``, of which each gives at most ``SAMPLE_CHARS`` characters until a
dictionary holds ``DICTIONARY_BYTES``. Everything else reads all rows and whole texts.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; a tie goes to the language
that sorts first; a NULL ``doc_id`` is not held out but, having no hash, not learned from either; with no labelled text
at all every prediction is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 4
HELD_OUT = 2
SAMPLE_DOCS = 400
SAMPLE_CHARS = 2_000
DICTIONARY_BYTES = 112 * 1024
BLOCK_CHARS = 4_096
# Short matches count: words of a language recur in pieces, which the library's fast levels overlook.
MATCHING = dict(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY)
MIN_MARGIN = 0.02
UNKNOWN = "und"

_NOT_LETTERS = regex.compile(r"\P{L}+")
_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def letters(text: str | None) -> str:
    """Lower-case letters, with one space for everything between."""
    return _NOT_LETTERS.sub(" ", (text or "").lower())


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Texts to learn from, per language: at most ``SAMPLE_DOCS``, each cut to ``SAMPLE_CHARS``.

    Counts per language give the share of hashes to look at, so only a few thousand short rows per
    language are sorted, however large the language is.
    """
    learned = docs.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    totals = {row["lang"]: row["count"] for row in learned.groupBy("lang").count().collect()}
    place = F.xxhash64(F.col("doc_id").cast("bigint")) / F.lit(2.0**64) + 0.5
    out: dict[str, list[str]] = {}
    rows = None
    for lang in sorted(totals):
        share = min(1.0, 4.0 * SAMPLE_DOCS / totals[lang])
        few = learned.where((F.col("lang") == lang) & (place <= share)).orderBy(place, "doc_id", "text").limit(SAMPLE_DOCS)
        few = few.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        rows = few if rows is None else rows.unionByName(few)
    for row in rows.collect() if rows is not None else []:
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def dictionaries(texts: dict[str, list[str]]) -> list[tuple[str, bytes]]:
    """Language and raw dictionary content, in the order of the languages' names.

    Zstandard finds matches near the end of a dictionary cheapest, so every language gets the same
    number of bytes if there is enough text: size must not favour one.
    """
    content = {lang: " ".join(map(letters, rows)).encode() for lang, rows in texts.items()}
    size = min([DICTIONARY_BYTES, *[len(c) for c in content.values() if len(c) >= DICTIONARY_BYTES // 8]])
    return [(lang, content[lang][:size]) for lang in sorted(content)]


class Classifier:
    def __init__(self, contents: list[tuple[str, bytes]]):
        self.languages = [lang for lang, _ in contents]
        self.compressors = []
        for _, content in contents:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            matching = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **MATCHING)
            raw.precompute_compress(compression_params=matching)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=matching))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin, and whether the margin is narrow."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        plain = letters(text)
        blocks = [plain[i:i + BLOCK_CHARS].encode() for i in range(0, len(plain), BLOCK_CHARS)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        if not others:
            return self.languages[best], 1.0, 1.0, False
        margin = (min(others) - sizes[best]) / min(others)
        # A lead of b bytes makes the rival 2**-8b as likely under the code lengths; damped per block.
        lead = (min(others) - sizes[best]) / len(blocks)
        return self.languages[best], lead / (lead + 4.0), margin, margin < MIN_MARGIN


def identify(docs: DataFrame, contents: list[tuple[str, bytes]]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, rejected`` for every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # at most DICTIONARY_BYTES per language

    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            rows = [classifier.predict(text.as_py()) for text in batch.column(2)]
            lang, score, margin, rejected = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_()),
            ], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint"), held.alias("held_out"), "text")
    return rows.mapInArrow(classify, "doc_id bigint, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return identify(docs, dictionaries(sample(docs)))
