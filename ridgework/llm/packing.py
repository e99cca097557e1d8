"""Packing of tokenised documents into sequences of a fixed number of tokens.

Documents become *pieces* (the tokens of a document and one separator; only longer ones are cut). Each
piece goes to one of many groups, where best-fit decreasing fills bins. Bins that are nearly full are
put out; of the others, the bins themselves are the items of the next round, in groups of ``FAN_IN``
groups, until one group is left or a round frees nothing. A bin keeps its inner order, so a piece's
place is its place in the bin plus the bin's place in the next.

Texts are read once and never shuffled: what travels is one short row per piece, and after the first
round only those in underfull bins. A group's size is bounded (``GROUP_PIECES``): the tree stops
merging where the bins left would overfill a group.

Defined cases: a NULL or empty text is one piece of just the separator; repeated rows and rows without
``doc_id`` are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import array
import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.session import stage

CAPACITY = 2048
SEPARATOR = 0
# The one added token of byte_bpe_50k.json; it is found before anything else is split.
ADDED, ADDED_ID = "<|endoftext|>", 50256
# A bin with no more free places than this is nearly full.
SLACK = 2
FAN_IN = 8
GROUP_PIECES = 50_000
FIRST_PIECES = 5_000
MOST_CACHED = 200_000

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECE + ", bin bigint, `offset` bigint, used int, slot int"


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(vocabulary: str):
    """A function from text to its ids as packed little-endian unsigned 32-bit numbers.

    The vocabulary is read in its rank form, which gives the ids of the JSON form; the JSON form's added
    token is not in it, so texts are split there first. Tokens never span the place before a single space
    between two words, so ids are remembered per word; texts with other white space there are encoded in
    one go.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> bytes:
        return array.array("I", encoding.encode_ordinary(text)).tobytes()

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= MOST_CACHED:
                self.clear()
            packed = ids(" " + word)
            if len(word) <= 64:
                self[word] = packed
            return packed

    known = Known()

    def encode_part(text: str) -> bytes:
        words = text.split(" ")
        if len(words) < 2 or any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            return ids(text)
        return ids(words[0]) + b"".join(map(known.__getitem__, words[1:]))

    added = array.array("I", [ADDED_ID]).tobytes()

    def encode(text: str) -> bytes:
        return added.join(map(encode_part, text.split(ADDED))) if ADDED in text else encode_part(text)

    return encode


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document; only the first may be shorter than ``capacity``."""
    first = tokens if tokens <= capacity else tokens % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, tokens, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    vocabulary = vocabulary or public_vocabulary()

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        separator = array.array("I", [SEPARATOR]).tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + separator
                for number, (at, size) in enumerate(cut(len(data) // 4, capacity)):
                    row.append(i)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at:4 * (at + size)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(tokenise, PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """``bin, offset`` of every item: largest first, each into the fullest bin that still holds it."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    free_mask, bins = 0, 0
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        fitting = free_mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = open_bins[free].pop()
            if not open_bins[free]:
                free_mask ^= 1 << free
        else:
            free, number = capacity, bins
            bins += 1
        placed[item] = (number, capacity - free)
        left = free - size
        if left:
            if not open_bins[left]:
                free_mask |= 1 << left
            open_bins[left].append(number)
    return placed


def pack(found: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``found`` pieces with ``sequence_id`` and ``offset``; ``found`` should be stored, it is read twice."""
    spark = found.sparkSession
    total = found.count()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // FIRST_PIECES + 1) if total > FIRST_PIECES else 1
    # A single piece is a bin of its own to begin with. Equal rows are told apart by their group's order.
    waiting = found.withColumns({
        "bin": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"), "used": F.col("length").cast("int"),
        "slot": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"),
    })
    done: list[DataFrame] = []
    level = 1
    while True:
        last = groups == 1
        # Every group of the round fits a task; numbers of bins say round, group and place in it.
        round_ = stage(waiting.groupBy("slot").applyInArrow(_fill(capacity, slack, level), PLACED + ", full boolean"), "bins")
        if not last:
            left = round_.where("not full").count()
            fewer = max(-(-groups // FAN_IN), left // GROUP_PIECES + 1)
            last = left == 0 or fewer >= groups
        if last:
            done.append(round_)
            break
        done.append(round_.where("full"))
        waiting = round_.where("not full").drop("full").withColumn("slot", F.pmod(F.col("slot"), F.lit(fewer)).cast("int"))
        groups, level = fewer, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def _fill(capacity: int, slack: int, level: int):
    def fill(key: tuple, table: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        bins, first, inverse = np.unique(table.column("bin").to_numpy(), return_index=True, return_inverse=True)
        used = table.column("used").to_numpy()[first]
        placed = np.array(best_fit(used.tolist(), capacity), np.int64).reshape(-1, 2)
        filled = np.bincount(placed[:, 0], weights=used, minlength=1).astype(np.int32)
        number, shift = placed[inverse, 0], placed[inverse, 1]
        changed = {
            "bin": pa.array((np.int64(level) << 56) | (np.int64(slot) << 28) | number),
            "offset": pa.array(table.column("offset").to_numpy() + shift),
            "used": pa.array(filled[number]),
        }
        columns = {name: changed.get(name, table.column(name)) for name in table.column_names}
        return pa.table(columns | {"full": pa.array(filled[number] >= capacity - slack)})

    return fill


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, slack: int = SLACK) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there."""
    return pack(stage(pieces(docs, capacity, vocabulary), "pieces"), capacity, slack)
