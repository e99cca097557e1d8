"""Removal of every byte inside a long string that occurs more than once in the corpus.

Sorting all suffixes of a corpus moves each byte many times over. Here suffixes start at *anchors*
only: of all ``CORE``-byte strings inside a window of ``length`` bytes, the one with the least hash (the
leftmost of equals) is the window's anchor. Equal windows have equal anchors at equal offsets, so
nothing is missed, and about one byte in 150 is an anchor. Windows with one anchor are neighbours, so
an anchor's *context*, the bytes its windows span, decides about all of them.

1. Anchors whose core occurs once settle nothing and are dropped by counts per core.
2. Contexts that occur more than once are repeated wholly; counts per context find them.
3. Where one core has several contexts, tasks sort the suffixes from the anchors into front-coded runs,
   the runs are exchanged by core, and a loser tree that never compares a known prefix merges them. In
   the merged order, neighbours' common prefixes tell how far any two contexts agree to the right; the
   bytes before the anchors tell how far they agree to the left. Two contexts share the windows
   between, if both reaches add up to ``length``. All such stretches contain the anchor, so a context's
   repeated bytes are one stretch, from its longest reach to the left to its longest to the right.
4. Stretches are united per text and cut out.

A core with more than ``CROWD`` different contexts is settled without gathering it: each of its windows
is counted by a 128-bit hash over all tasks. Texts are told apart by a 128-bit hash, so copies share
one result and one set of stretches.

Repeated runs of words are found the same way: every word is written as ``CODE`` letters, so a run of
``WORDS`` words is a string of a fixed length whatever the words' own lengths. What a window shares beyond
whole words is left out again. They are counted beside the bytes, and cut only on request.

Defined cases: a NULL text is empty; texts under ``length`` bytes keep everything; repeated rows repeat
each other; matches never cross documents; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ridgework.llm.suffixes import common_prefix, front_code, front_decode, merge
from ridgework.session import discard, stage

LENGTH = 400
CORE = 100
# Runs of more than fifty words, in words, and the bytes that stand for a word there.
WORDS = 51
CODE = 8
CROWD = 20_000
RUN_ROWS = 20_000
PART_ROWS = 20_000
# Anchors of texts beyond this many bytes are found segment by segment; a task holds some 100 bytes for each.
SEGMENT = 1 << 18
PLACE_BITS = 24
BASE = 0x9E3779B97F4A7C15 | 1


def powers_of(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Hashing:
    """Hashes of all substrings of a text from one running sum of ``byte * BASE ** place``."""

    def __init__(self, size: int):
        self.grow(size)

    def grow(self, size: int) -> None:
        self.powers, self.inverses = (powers_of(base, size + 1) for base in (BASE, pow(BASE, -1, 1 << 64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self.grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start, end) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverses[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span:]) if span < width else out


def anchors_of(data: bytes, hashing: Hashing, length: int = LENGTH, core: int = CORE) -> list[np.ndarray]:
    """``core hash, context hash, anchor, first window, last window`` for every anchor of one text."""
    found: list[list[np.ndarray]] = []
    start = 0
    while start + length <= len(data):
        part = np.frombuffer(data, np.uint8, min(SEGMENT, len(data) - start), start)
        sums = hashing.sums(part)
        cores = mixed((sums[core:] - sums[:-core]) * hashing.inverses[: len(part) - core + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = (cores & ~low) | np.arange(len(cores), dtype=np.uint64)
        chosen = (sliding_min(keys, length - core + 1) & low).astype(np.int64)
        edges = np.flatnonzero(np.diff(chosen)) + 1
        first = np.concatenate([[0], edges])
        last = np.concatenate([edges, [len(chosen)]]) - 1
        at = chosen[first]
        context = hashing.between(sums, first, last + length)
        shape = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
        found.append([cores[at], mixed(context ^ mixed(shape + np.uint64(1))), at + start, first + start, last + start])
        start += len(part) - length + 1
    if not found:
        empty = np.zeros(0, np.int64)
        return [empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty]
    return [np.concatenate(column) for column in zip(*found)]


def text_id(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def utf8(text: str | None) -> bytes:
    return (text or "").encode()


def anchors(docs: DataFrame, length: int, core: int, read: Callable[[str | None], bytes]) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(1 << 16)
        for batch in batches:
            columns: list[list[np.ndarray]] = []
            counts = []
            for text in batch.column(2):
                columns.append(anchors_of(read(text.as_py()), hashing, length, core))
                counts.append(len(columns[-1][0]))
            if not sum(counts):
                continue
            core_, context, at, first, last = (np.concatenate(c) for c in zip(*columns))
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), batch.column(1).take(row), pa.array(core_.view(np.int64)), pa.array(context.view(np.int64)),
                pa.array(at.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
            ], names=["doc_id", "tid", "core", "context", "at", "first", "last"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_id("text").alias("tid"), "text")
    return rows.mapInArrow(find, "doc_id bigint, tid binary, core bigint, context bigint, at int, first int, last int")


def repeated_stretches(
    docs: DataFrame, length: int = LENGTH, core: int = CORE, crowd: int = CROWD, read: Callable[[str | None], bytes] = utf8,
) -> DataFrame:
    """``tid, stretches array<struct<lo, hi>>``: what to cut from each text, as byte offsets, overlaps included.

    ``read`` gives the bytes of a text that are looked at, inside the tasks that look at them, so that texts
    are moved as they are and a task needs no second Python worker.
    """
    if length < 2 * core:
        raise ValueError("a window must hold two cores at least")
    found = stage(anchors(docs, length, core, read), "anchors")
    # Stored counts come to the join by a shuffle of their own, so that adaptive execution can split a hot core.
    again = stage(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    met = stage(found.join(again, "core"), "anchors-met")
    contexts = stage(met.groupBy("core", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "tid", "at", "first", "last")).alias("from")
    ), "contexts")
    whole = met.join(contexts.where("n > 1").select("core", "context"), ["core", "context"]).select(
        "tid", F.col("first").alias("lo"), (F.col("last") + length).alias("hi")
    )
    # A core whose contexts are all repeated is settled; so is one with a single context.
    open_cores = contexts.groupBy("core").agg(
        F.count("*").alias("held"), F.count_if(F.col("n") == 1).alias("single")
    ).where("held > 1 and single > 0")
    unsettled = contexts.join(open_cores.select("core", "held"), "core").select(
        "core", "context", "held", (F.col("n") > 1).alias("whole"), "from.*"
    )
    bytes_of = stage(with_bytes(docs, unsettled, length, read), "context-bytes")
    few, many = bytes_of.where(F.col("held") <= crowd), bytes_of.where(F.col("held") > crowd)
    stretches = whole.unionByName(merged_stretches(few, length, core)).unionByName(counted_stretches(many, length))
    out = stage(stretches.distinct().groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches")), "stretches")
    discard(found, again, met, contexts, bytes_of)
    return out


def with_bytes(docs: DataFrame, contexts: DataFrame, length: int, read: Callable[[str | None], bytes]) -> DataFrame:
    """Contexts with the bytes before (reversed) and from their anchor, read from one document that has them."""
    wanted = contexts.groupBy("tid", "doc_id").agg(F.collect_list(
        F.struct("core", "context", "held", "whole", "at", "first", "last")
    ).alias("wanted"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("d"), text_id("text").alias("t"), "text")
    joined = rows.join(wanted, (F.col("t") == F.col("tid")) & F.col("d").eqNullSafe(F.col("doc_id")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, wanted_ in zip(*(batch.column(i) for i in range(3))):
                data, rows_ = read(text.as_py()), wanted_.as_py()
                for row in rows_:
                    row["tid"] = tid.as_py()
                    row["before"] = data[row["first"]:row["at"]][::-1]
                    row["after"] = data[row["at"]:row["last"] + length]
                yield pa.RecordBatch.from_pylist(rows_, schema=cut_schema)

    cut_schema = pa.schema([
        ("core", pa.int64()), ("context", pa.int64()), ("held", pa.int64()), ("whole", pa.bool_()), ("tid", pa.binary()),
        ("at", pa.int32()), ("before", pa.binary()), ("after", pa.binary()),
    ])
    return joined.select("tid", "text", "wanted").mapInArrow(
        cut, "core bigint, context bigint, held bigint, whole boolean, tid binary, at int, before binary, after binary"
    )


def merged_stretches(contexts: DataFrame, length: int, core: int) -> DataFrame:
    """Stretches of single contexts by merging sorted runs; every core's contexts meet in one part."""
    total = contexts.count()
    parts = max(total // PART_ROWS + 1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    run_type = pa.struct([
        ("shared", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("before", pa.list_(pa.binary())),
        ("whole", pa.list_(pa.bool_())), ("tid", pa.list_(pa.binary())), ("at", pa.list_(pa.int32())),
    ])

    def sort_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column("core")) % parts
            after = batch.column("after").to_pylist()
            for number in np.unique(part):
                rows = sorted(np.flatnonzero(part == number).tolist(), key=after.__getitem__)
                shared, rests = front_code([after[r] for r in rows])
                taken = batch.take(pa.array(rows))
                run = {"shared": shared.tolist(), "rests": rests} | {
                    name: taken.column(name).to_pylist() for name in ("before", "whole", "tid", "at")
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(number)], pa.int32()), pa.array([run], run_type)], names=["part", "run"]
                )

    def merge_runs(key: tuple, table: pa.Table) -> pa.Table:
        runs = table.column("run").to_pylist()
        strings = [front_decode(run["shared"], run["rests"]) for run in runs]
        out: list[tuple] = []
        group: list[tuple] = []

        def settle() -> None:
            if len(group) > 1:
                for (run, place, _), left, right in zip(group, *reaches(
                    [runs[r]["before"][p] for r, p, _ in group], [x for _, _, x in group],
                    [len(strings[r][p]) for r, p, _ in group], [runs[r]["whole"][p] for r, p, _ in group], length,
                )):
                    if left + right >= length:
                        at = runs[run]["at"][place]
                        out.append((runs[run]["tid"][place], at - left, at + right))
            group.clear()

        for run, place, prefix in merge([(s, r["shared"]) for s, r in zip(strings, runs)]):
            if prefix < core:
                settle()
            group.append((run, place, prefix))
        settle()
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"tid": pa.array(columns[0], pa.binary()), "lo": pa.array(columns[1], pa.int32()), "hi": pa.array(columns[2], pa.int32())})

    run_ddl = (
        "part int, run struct<shared: array<int>, rests: array<binary>, before: array<binary>, whole: array<boolean>, "
        "tid: array<binary>, at: array<int>>"
    )
    runs = contexts.select("core", "whole", "tid", "at", "before", "after").mapInArrow(sort_runs, run_ddl)
    return runs.groupBy("part").applyInArrow(merge_runs, "tid binary, lo int, hi int")


def reaches(before: list[bytes], prefix: list[int], sizes: list[int], whole: list[bool], length: int) -> tuple[list[int], list[int]]:
    """How far each context is repeated to the left and right of its anchor, in sorted order; 0, 0 if nowhere.

    ``prefix[i]`` is what suffix i shares with suffix i - 1. Wholly repeated contexts are known already
    and only serve as witnesses.
    """
    m = len(before)
    left, right = [0] * m, [0] * m
    if m <= 100:
        for i in range(m):
            shared = 1 << 30
            for j in range(i + 1, m):
                shared = min(shared, prefix[j])
                if whole[i] and whole[j]:
                    continue
                back = common_prefix(before[i], before[j])
                if back + shared >= length:
                    for x in (i, j):
                        left[x], right[x] = max(left[x], back), max(right[x], shared)
        return _open_only(left, right, whole)
    # Many contexts: at each offset o two of them share the window that starts o bytes before the
    # anchor if they agree on o bytes to the left and length - o to the right.
    widths = np.array([len(b) for b in before])
    grid = np.zeros((m, widths.max() + 1), np.uint8)
    for i, b in enumerate(before):
        grid[i, : len(b)] = np.frombuffer(b, np.uint8)
    steps, ends = np.array(prefix), np.array(sizes)
    best_left, least = np.full(m, -1), np.full(m, length + 1)
    hashes = np.zeros(m, np.uint64)
    for o in range(widths.max() + 1):
        fits = np.flatnonzero((widths >= o) & (ends >= length - o))
        if len(fits) > 1:
            classes = np.cumsum(steps < length - o).astype(np.uint64)
            key = mixed(hashes[fits] ^ mixed(classes[fits] + np.uint64(1)))
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            hit = fits[counts[inverse] > 1]
            best_left[hit] = o
            least[hit] = np.minimum(least[hit], o)
        hashes = mixed(hashes + grid[:, o].astype(np.uint64) + np.uint64(1)) if o < grid.shape[1] else hashes
    ok = best_left >= 0
    return _open_only(np.where(ok, best_left, 0).tolist(), np.where(ok, length - least, 0).tolist(), whole)


def _open_only(left: list[int], right: list[int], whole: list[bool]) -> tuple[list[int], list[int]]:
    return [0 if w else x for x, w in zip(left, whole)], [0 if w else x for x, w in zip(right, whole)]


def counted_stretches(contexts: DataFrame, length: int) -> DataFrame:
    """Stretches of the contexts of crowded cores: every window is counted by hash, none is gathered."""

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, at, before, after in zip(*(batch.column(n).to_pylist() for n in ("tid", "at", "before", "after"))):
                data = before[::-1] + after
                starts = range(len(data) - length + 1)
                hashes = [hashlib.blake2b(data[s:s + length], digest_size=16).digest() for s in starts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes, pa.binary()), pa.array([tid] * len(hashes), pa.binary()),
                    pa.array([at - len(before) + s for s in starts], pa.int32()),
                ], names=["window", "tid", "lo"])

    marked = contexts.select("tid", "at", "before", "after", "whole").where("not whole").mapInArrow(
        windows, "window binary, tid binary, lo int"
    )
    witnesses = contexts.where("whole").select("tid", "at", "before", "after").mapInArrow(windows, "window binary, tid binary, lo int")
    again = marked.unionByName(witnesses).groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return marked.join(again, "window").select("tid", "lo", (F.col("lo") + length).alias("hi"))


def coded_words(text: str | None) -> bytes:
    """Every word as eight letters, so that runs of words are strings of fixed length."""
    digest = xxhash.xxh3_64_digest
    return base64.b64encode(b"".join([digest(word)[:6] for word in utf8(text).split()]))


def repeated_words(docs: DataFrame, words: int = WORDS, core: int = CORE, crowd: int = CROWD) -> DataFrame:
    """``tid, runs``: where strings of ``words`` words lie that occur again, in places of the coded text.

    Words are what ASCII white space parts; the white space between them does not count. Coding a text again
    costs less than keeping what is coded, which is as long as the text.
    """
    return repeated_stretches(docs, CODE * words, core, crowd, coded_words).withColumnRenamed("stretches", "runs")


def word_runs(places: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Maximal runs of words from places of the coded text; a window may begin or end within a code, whose word is not shared."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((-(-lo // CODE), hi // CODE) for lo, hi in places):
        if hi - lo < words:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def cut_out(data: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data`` and the number of maximal runs removed."""
    kept, at, runs = [], 0, 0
    end = -1
    for lo, hi in sorted(stretches):
        if lo > end:
            runs += 1
            kept.append(data[at:lo])
        end = max(end, hi)
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


def without_repeats(
    docs: DataFrame, length: int = LENGTH, core: int = CORE, crowd: int = CROWD, words: int = WORDS, cut_words: bool = False,
) -> DataFrame:
    """``docs`` with a struct column ``__kept``: ``bytes`` left, ``n_bytes``, ``n_removed``, ``n_spans``, ``sha256``.

    ``n_word_runs`` and ``n_run_words`` tell the runs of words covered by strings of ``words`` words that occur again, and
    the words in them; with ``cut_words`` those runs go as well.
    """
    texts = docs.select("doc_id", "text")
    both = repeated_stretches(texts, length, core, crowd).join(repeated_words(texts, words, core, crowd), "tid", "full")
    stretches = stage(both, "stretches")
    joined = docs.withColumn("__tid", text_id("text")).join(stretches, F.col("__tid") == stretches["tid"], "left")
    names = ["bytes", "n_bytes", "n_removed", "n_spans", "sha256", "n_word_runs", "n_run_words"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    kind = "struct<bytes: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint, sha256: string, n_word_runs: bigint, n_run_words: bigint>"

    @F.arrow_udf(kind)
    def kept(text: pa.Array, stretches_: pa.Array, runs_: pa.Array) -> pa.Array:
        rows = []
        for t, found, places in zip(text, stretches_, runs_):
            data = (t.as_py() or "").encode()
            gone = [(s["lo"], s["hi"]) for s in found.as_py() or ()]
            runs = word_runs([(s["lo"], s["hi"]) for s in places.as_py() or ()], words)
            if runs and cut_words:
                spans = [m.span() for m in re.finditer(rb"[^\x09-\x0D\x20]+", data)]
                gone += [(spans[lo][0], spans[hi - 1][1]) for lo, hi in runs]
            left, n_spans = cut_out(data, gone)
            rows.append((
                left, len(data), len(data) - len(left), n_spans, hashlib.sha256(left).hexdigest(), len(runs), sum(hi - lo for lo, hi in runs)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    columns = [docs[name] for name in docs.columns]
    return joined.select(*columns, kept(docs["text"], stretches["stretches"], stretches["runs"]).alias("__kept"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """The documents with repeated bytes and runs of ``words`` cut from their text and ``n_chars`` counted anew.

    A character of which a part was cut goes whole; a NULL text stays NULL.
    """
    cut = without_repeats(docs, length, words=words, cut_words=True)

    @F.arrow_udf("string")
    def decoded(data: pa.Array) -> pa.Array:
        return pa.array([d.as_py().decode("utf-8", "ignore") for d in data], pa.string())

    changed = F.when(F.col("__kept.n_removed") > 0, decoded("__kept.bytes")).otherwise(F.col("text"))
    out = cut.select(*[changed.alias("text") if name == "text" else F.col(f"`{name}`") for name in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), out["n_chars"]).otherwise(F.length("text")).cast(out.schema["n_chars"].dataType))
    return out
