"""Documents that contain passages of benchmark items, found by a prefix-filtered set join.

Every window of ten consecutive words of an item (a shorter item is one window) is a set of shingles. A
document contains the window only if it contains each of its shingles, so one of them is a sufficient
prefix: the one that the fewest places of the corpus hold. Windows are listed by that rarest shingle,
with its position. Where a document holds the shingle, the position says where the window would have
to start; the length bound says whether it fits; and the words there are compared one by one.

The windows of a block of items travel to the tasks. A block holds at most ``BLOCK_WORDS`` item words;
larger benchmarks take several passes over the documents, whose hits are united per document.
Documents are never shuffled when one block holds the benchmark.

Defined cases: NULL texts and texts without words hold nothing and are hit by nothing; an item repeated
is one item; items without ``item_id`` hit words but are not listed; items that share a text all count;
repeated documents are judged each; other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ridgework.llm.tables import ascii_words

WINDOW = 10
SHINGLE = 2
# Words of one block of items; a window's entry takes some hundred bytes in a task.
BLOCK_WORDS = 400_000


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Pairs of neighbours; the word itself if there is just one."""
    return list(zip(words, words[1:])) or [tuple(words)]


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with words, one block of bounded size after the other."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).distinct().toLocalIterator():
        words = ascii_words(row["text"])
        if not words:
            continue
        if size and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    yield block


def shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """How many places of all documents hold each wanted shingle; tasks send one row per shingle at most."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = pa.schema([("shingle", pa.list_(pa.binary())), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, ...], int] = defaultdict(int)
        sought = shared.value
        singles = any(len(s) == 1 for s in sought)
        for batch in batches:
            for text in batch.column(0):
                words = ascii_words(text.as_py())
                for pair in zip(words, words[1:]):
                    if pair in sought:
                        held[pair] += 1
                if singles:
                    for word in words:
                        if (word,) in sought:
                            held[(word,)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([list(s) for s in held], kind.field(0).type), pa.array(list(held.values()), pa.int64())], schema=kind)

    rows = docs.select("text").mapInArrow(count, "shingle array<binary>, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    # At most one row per wanted shingle, and those are bounded by BLOCK_WORDS.
    return {tuple(map(bytes, row["shingle"])): row["n"] for row in rows.collect()}


def index_of(items: list[tuple[int | None, list[bytes]]], counts: dict[tuple[bytes, ...], int], width: int) -> dict:
    """Windows of one block of items by their rarest shingle, as ``(its position, window, numbers of items)``."""
    of: dict[tuple[bytes, ...], set] = defaultdict(set)
    for number, (_, words) in enumerate(items):
        for window in windows(words, width):
            of[window].add(number)
    pairs: dict[tuple[bytes, ...], list] = {}
    singles: dict[bytes, tuple] = {}
    for window, numbers in of.items():
        if len(window) == 1:
            singles[window[0]] = tuple(numbers)
            continue
        parts = shingles(list(window))
        rarest = min(range(len(parts)), key=lambda i: (counts.get(parts[i], 0), i))
        pairs.setdefault(parts[rarest], []).append((rarest, list(window), tuple(numbers)))
    return {"pairs": pairs, "singles": singles, "ids": [item for item, _ in items]}


def scan_words(index: dict, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Word spans of all windows that occur, and the numbers of their items."""
    spans, items = [], set()
    pairs, singles, size = index["pairs"], index["singles"], len(words)
    for at, pair in enumerate(zip(words, words[1:])):
        if pair in pairs:
            for position, window, numbers in pairs[pair]:
                start = at - position
                if start >= 0 and start + len(window) <= size and words[start:start + len(window)] == window:
                    spans.append((start, start + len(window)))
                    items.update(numbers)
    if singles:
        for at, word in enumerate(words):
            if word in singles:
                spans.append((at, at + 1))
                items.update(singles[word])
    return spans, items


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


FOUND = "struct<n_words: bigint, hits: array<struct<lo: int, hi: int>>, items: array<bigint>>"


def contained(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with a struct column ``__found``: ``n_words``, hit word spans and the items that occur."""
    spark: SparkSession = docs.sparkSession
    out, names = docs, []
    for number, items in enumerate(item_blocks(benchmark)):
        wanted = {s for _, words in items for w in windows(words, width) for s in shingles(list(w))}
        index = index_of(items, shingle_counts(docs, wanted) if wanted else {}, width)
        names.append(f"__found_{number}")
        out = out.withColumn(names[-1], _scanner(spark.sparkContext.broadcast(index))("text"))
    if len(names) == 1:
        return out.withColumnRenamed(names[0], "__found")
    joined = F.struct(
        F.col(f"{names[0]}.n_words").alias("n_words"), F.flatten(F.array(*[F.col(f"{n}.hits") for n in names])).alias("hits"),
        F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))).alias("items"),
    )
    return out.withColumn("__found", joined).drop(*names)


def _scanner(index):
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        known, rows = index.value, []
        for text in texts:
            words = ascii_words(text.as_py())
            spans, items = scan_words(known, words)
            rows.append({
                "n_words": len(words), "hits": [{"lo": a, "hi": b} for a, b in union(spans)],
                "items": sorted({known["ids"][i] for i in items} - {None}),
            })
        kind = pa.struct([
            ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
            ("items", pa.list_(pa.int64())),
        ])
        return pa.array(rows, kind)

    return scan


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of what ``contained`` found."""

    @F.arrow_udf("bigint")
    def hit_words(hits: pa.Array) -> pa.Array:
        return pa.array([sum(b - a for a, b in union((s["lo"], s["hi"]) for s in h)) for h in hits.to_pylist()], pa.int64())

    names = F.array_sort(F.transform("__found.items", lambda i: i.cast("string")))
    n_hit = hit_words("__found.hits")
    return found.select(
        "doc_id", "__found.n_words", n_hit.alias("n_hit"), F.size("__found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without a word of any benchmark window, with their own columns."""
    found = contained(docs, benchmark, width).where(F.size("__found.hits") == 0)
    return found.select(*[F.col(f"`{name}`") for name in docs.columns])
