"""SimHash fingerprints of documents, linked through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``PIVOTS`` reference fingerprints once. Two
fingerprints within ``d`` bits differ by at most ``d`` in every such distance, so a pair with a larger
difference anywhere is discarded without comparing the fingerprints; what survives is verified.

Pairs are only formed between fingerprints that agree on a key. The keys follow from a pigeonhole:
``d`` differing bits touch at most ``d`` of ``d + 3`` bit ranges, so some three ranges agree. A key held
by more than ``CROWD`` fingerprints (large families of near copies) is not paired at all: such
fingerprints meet at their midpoints instead. Two fingerprints are within two bits exactly if some
fingerprint is within one bit of both, so each goes to itself and its 64 one-bit neighbours, where at
most 65 can meet, and links to the least one there. That way is exact, its work linear, and no group
emits all pairs.

Equal texts and equal fingerprints are one row from the first aggregation on, so no group of copies is
a hot key of any later step but the last join, whose large side adaptive execution can split.

Defined cases: a NULL text or one without words has fingerprint zero and links like any other; fewer
than three words are one shingle; a repeated ``doc_id`` is one node whose rows all get its component
(the least ``doc_id`` over all of its rows' links); rows without ``doc_id`` are linked with others but
give no component its name, and alone have none (NULL); empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ridgework.llm.components import components
from ridgework.session import checked_broadcast, stage

SHINGLE = 3
SEED = 42
BITS = 64
PIVOTS = 32
CROWD = 64


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], dtype="<u8")
    # Counting in slices keeps the unpacked bits of very long texts small.
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print bigint`` (the fingerprint as a signed number) for every row."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text.as_py()) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(hashed, "doc_id bigint, print bigint")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of 0, 1, 2, ..., as signed numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(count)], np.uint64).view(np.int64).tolist()


def distance_table(prints: DataFrame) -> DataFrame:
    """``prints`` with ``distances``, the Hamming distance to every pivot."""
    print_ = F.col("print")
    return prints.withColumn("distances", F.array(*[
        F.bit_count(print_.bitwiseXOR(F.lit(p).cast("bigint"))).cast("tinyint") for p in pivots()
    ]))


def range_keys(print_: Column, bits: int) -> Column:
    """One key per choice of three of ``bits + 3`` bit ranges: the number of the choice and those bits."""
    edges = [round(i * BITS / (bits + 3)) for i in range(bits + 4)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << BITS) if m >= 1 << (BITS - 1) else m
    return F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("choice"), print_.bitwiseAND(F.lit(signed(sum(chosen))).cast("bigint")).alias("bits"))
        for i, chosen in enumerate(combinations(masks, 3))
    ])


def near_prints(prints: DataFrame, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``print``s within ``bits`` (at most 2) of each other.

    Pairs of crowded keys are not listed one by one, but every two of them within ``bits`` are
    connected through links listed.
    """
    if not 0 <= bits <= 2:
        raise ValueError("crowded keys are resolved through midpoints, which reach two bits")
    keyed = prints.select("print").distinct().select("print", F.inline(range_keys(F.col("print"), bits)))
    # Stored counts come to the join by a shuffle of their own, so that adaptive execution can split a crowded key.
    sizes = stage(keyed.groupBy("choice", "bits").agg(F.count("*").alias("held")).where("held > 1"), "print-key-sizes")
    met = stage(distance_table(keyed.join(sizes, ["choice", "bits"])), "print-keys")

    few = met.where(F.col("held") <= crowd)
    left = few.select("choice", "bits", F.col("print").alias("a"), F.col("distances").alias("da"))
    right = few.select("choice", "bits", F.col("print").alias("b"), F.col("distances").alias("db"))
    apart = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y)))
    pairs = left.join(right, ["choice", "bits"]).where(F.col("a") < F.col("b")).where(apart <= bits)
    verified = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")

    crowded = met.where(F.col("held") > crowd).select("print").distinct()
    return verified.unionByName(midpoint_links(crowded, bits)).distinct()


def midpoint_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links of each fingerprint to the least one that shares a midpoint with it."""
    if bits == 0:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).where("false")
    flips = [0] + [(1 << b) - (1 << BITS if b == BITS - 1 else 0) for b in range(BITS)]
    if bits == 1:
        # Of neighbours one bit apart, the flipped one itself is the other's neighbour.
        keys = F.array(*[F.least(F.col("print"), F.col("print").bitwiseXOR(F.lit(f).cast("bigint"))) for f in flips[1:]])
        marks = F.transform(keys, lambda k, i: F.struct(k.alias("mid"), i.alias("bit")))
    else:
        marks = F.transform(
            F.array(*[F.col("print").bitwiseXOR(F.lit(f).cast("bigint")) for f in flips]),
            lambda k: F.struct(k.alias("mid"), F.lit(0).alias("bit")),
        )
    spread = prints.select("print", F.inline(marks))
    least = spread.groupBy("mid", "bit").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1")
    return spread.join(least, ["mid", "bit"]).where(F.col("print") != F.col("b")).select(F.col("print").alias("a"), "b")


def near_duplicates(docs: DataFrame, bits: int = 2) -> DataFrame:
    """``doc_id, print, component_id`` for every row; links join fingerprints within ``bits``."""
    rows = stage(fingerprints(docs), "fingerprints")
    # Rows of one doc_id are one node even when their texts differ: each print links to the least of its doc_id.
    ids = stage(rows.where("doc_id is not null").distinct(), "prints-of-ids")
    least = ids.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("top")).where("a <> top").select("doc_id", "a")
    shared = ids.join(stage(least, "ids-least"), "doc_id").where("print <> a").select("a", F.col("print").alias("b"))
    grouped = components(near_prints(rows, bits).unionByName(shared))
    named = rows.groupBy("print").agg(F.min("doc_id").alias("least")).join(
        grouped.select(F.col("node").alias("print"), F.col("component").alias("root")), "print", "left"
    ).withColumn("root", F.coalesce("root", "print"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(named.join(names, "root").select("print", "component_id"), "print-components")
    return rows.join(known, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, bits: int = 2) -> DataFrame:
    """Of each component the document that gives it its name.

    Equal rows of that ``doc_id`` become one; rows that differ in any column stay, as nothing says which
    of them is the document. Rows without ``doc_id`` are kept: nothing can name them.
    """
    found = near_duplicates(docs, bits).where("doc_id = component_id")
    heads = stage(found.groupBy(F.col("doc_id").alias("__head_id")).agg((F.count("*") > 1).alias("__again_id")), "heads")
    kept = docs.join(checked_broadcast(heads, 32), docs["doc_id"] == F.col("__head_id"))
    once, again = (kept.where(test).select(*[docs[name] for name in docs.columns]) for test in ("not __again_id", "__again_id"))
    told_by = [field.name for field in docs.schema if not isinstance(field.dataType, T.MapType)]
    return once.unionByName(again.dropDuplicates(told_by)).unionByName(docs.where("doc_id is null"))


def print_hex(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")
