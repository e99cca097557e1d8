"""Quality rules whose cutoffs are certified on labelled documents.

Every rule compares one ratio of a document with a cutoff. Cutoffs are tried from the most lenient to
the strictest, per stratum; one is certified if an exact binomial test shows, on the labelled good
documents of the stratum, that it rejects fewer than ``risk / rules`` of them. Going through the
cutoffs in a fixed order and stopping at the first failure needs no correction; the tests of all
strata and rules share the error ``delta`` by Bonferroni. So with probability ``1 - delta`` no stratum
loses more than ``risk`` of its good documents. A stratum with too few labels certifies nothing and
keeps what the base rule keeps.

Only DataFrame functions are used, so nothing leaves the JVM.

Defined cases: a NULL text has no words (and fails the base rule); a NULL stratum is a stratum of its
own; a document labelled more than once is good only if every label says so; labels with a NULL
``doc_id`` or ``quality`` count for nothing; repeated documents are judged each; other columns pass
through untouched, also when named like a measure (what is added is named ``__measures`` and ``__verdict``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ridgework.llm.tables import SPACES
from ridgework.session import checked_broadcast, stage

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__measures`` of counts over the whole text, and ``__row``.

    A condition that also names the row number stays above the measures; pushed below them it would
    compute each measure once more for every place that names it.
    """
    taken = F.coalesce(F.col(text), F.lit(""))
    split = docs.select("*", taken.alias("__text")).select(
        "*",
        F.filter(F.split("__text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: _without(line, SPACES) != "").alias("__lines"),
    )
    words, last = F.col("__words"), F.size("__words") - 3
    hashed = split.select("*", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )).otherwise(F.array().cast("array<bigint>")).alias("__windows"))
    word_chars = F.length(_without(F.col("__text"), SPACES))
    counted = hashed.select(*[F.col(f"`{name}`") for name in docs.columns], F.struct(
        F.size("__words").cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        (F.length("__text") - F.length(_without(F.col("__text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__windows")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.length("__text") - F.length(_without(F.col("__text"), CAPITALS))).cast("long").alias("n_capitals"),
    ).alias("__measures"), F.monotonically_increasing_id().alias("__row"))
    return counted


def repeated_words(windows: Column) -> Column:
    """Words inside any three-word window whose hash occurs more than once.

    Sorting ``(hash, place)`` brings equal windows together; each repeated window then adds the words
    that the repeated window before it did not cover. Texts without a repeat skip the sort.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(order: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("words"))
    covered = F.aggregate(
        # The array of one sorted array lets the lambda name it, so that it is sorted once.
        F.flatten(F.transform(F.array(placed), again)), start,
        lambda state, i: F.struct(i.alias("last"), (state["words"] + F.least(F.lit(3), i - state["last"])).alias("words")),
        lambda state: state["words"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def base_failed(measured: Column) -> Column:
    words, repeated = measured["n_words"], measured["n_repeat_words"]
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``over / under`` reaches a cutoff; ``cutoffs`` go from lenient to strict."""

    name: str
    over: str
    under: str
    cutoffs: tuple[float, ...]

    def value(self, measured: Column) -> Column:
        return F.coalesce(measured[self.over] / F.nullif(measured[self.under], F.lit(0).cast("long")), F.lit(0.0))


    def level(self, measured: Column) -> Column:
        """How many cutoffs the value reaches; as they fall, these are the last ones."""
        value = self.value(measured)
        return F.size(F.filter(F.array(*[F.lit(c) for c in self.cutoffs]), lambda cutoff: cutoff <= value))


def _falling(top: float, step: float, count: int) -> tuple[float, ...]:
    return tuple(round(top * step**i, 6) for i in range(count))


RULES = (
    Rule("symbols", "n_symbols", "n_words", _falling(2.0, 0.8, 16)),
    Rule("dup_lines", "n_dup_lines", "n_lines", _falling(0.95, 0.9, 12)),
    Rule("repeats", "n_repeat_words", "n_words", _falling(0.5, 0.9, 12)),
    Rule("capitals", "n_capitals", "word_chars", _falling(0.9, 0.85, 12)),
    Rule("long_words", "word_chars", "n_words", _falling(12.0, 0.97, 16)),
)


@dataclass(frozen=True)
class Certificate:
    """What certification promises: at most ``risk`` good documents lost, but for ``delta``."""

    risk: float = 0.02
    delta: float = 0.05
    rules: tuple[Rule, ...] = field(default=RULES)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x >= 1, by Stirling's series eight steps further up."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    below = F.lit(0.0)
    for step in range(8):
        below = below + F.log(x + step)
    return series - below


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n draws of chance p; 1 where k is not under the mean.

    Below the mean the terms fall, so the sum starts at k and ends where terms no longer count.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, 64 + F.ceil(40 * F.sqrt(n * p)))
    terms = F.when(steps >= 1, F.sequence(F.lit(0), (steps - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, i: Column) -> Column:
        at = k - i
        term = state["term"] * at * (1 - p) / ((n - at + 1) * p)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    below = F.exp(top) * F.aggregate(terms, start, add, lambda state: state["total"])
    return F.when(k < n * p, F.least(below, F.lit(1.0))).otherwise(F.lit(1.0))


def certify(measured: DataFrame, labels: DataFrame, stratum: str | None = "lang", promise: Certificate = Certificate()) -> DataFrame:
    """Certified cutoffs as ``stratum, cutoffs map<rule, cutoff>``; a rule without one is missing.

    ``measured`` needs ``doc_id``, the stratum and ``__measures``. Labelled rows are reduced to counts
    per stratum, rule and cutoff before anything is shuffled by stratum, so a stratum that holds most
    of the rows is no hot key.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__good"))
    layer = F.col(stratum) if stratum else F.lit(None)
    levels = F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), rule.level(F.col("__measures")).alias("level")) for rule in promise.rules
    ])
    held = measured.where(~base_failed(F.col("__measures")) & (F.col("__row") >= 0)).select(
        "doc_id", F.coalesce(layer.cast("string"), F.lit("")).alias("stratum"), levels.alias("levels")
    ).join(good.where("__good = 1"), "doc_id", "left_semi")
    counts = stage(
        held.select("stratum", F.inline("levels")).groupBy("stratum", "rule", "level").count(), "quality-counts"
    )
    tests = counts.select("stratum", "rule").distinct().count()
    grid = F.create_map(*[
        part for rule in promise.rules for part in (F.lit(rule.name), F.array(*[F.lit(c) for c in rule.cutoffs]))
    ])
    # Counts of one stratum and rule are at most one row per cutoff and one: an array of them is small.
    each = counts.groupBy("stratum", "rule").agg(
        F.sum("count").alias("n"), F.collect_list(F.struct("level", "count")).alias("rows")
    ).withColumn("grid", grid[F.col("rule")])
    # The cutoff at a place, counted from 1, rejects what reaches it and so every stricter one behind it.
    lost = F.transform(F.sequence(F.lit(1), F.size("grid")), lambda place: F.aggregate(
        "rows", F.lit(0).cast("long"), lambda s, row: s + F.when(row["level"] > F.size("grid") - place, row["count"]).otherwise(0)
    ))
    tried = each.withColumn("lost", lost).withColumn("passed", F.transform(
        "lost", lambda k: binomial_at_most(k, F.col("n"), promise.risk / len(promise.rules)) <= promise.delta / max(tests, 1)
    ))
    # The fixed order stops at the first failure, so the last cutoff before it is the strictest certified.
    failed = F.array_position("passed", False)
    certified = tried.withColumn("taken", F.when(failed == 0, F.size("passed")).otherwise(failed - 1).cast("int")).where("taken > 0")
    return certified.groupBy("stratum").agg(F.map_from_entries(
        F.collect_list(F.struct("rule", F.get("grid", F.col("taken") - 1).alias("cutoff")))
    ).alias("cutoffs"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str | None = "lang", promise: Certificate = Certificate()) -> DataFrame:
    """``measured`` with ``__verdict struct<base_failed, failed array<rule>, kept>``."""
    layer = F.coalesce((F.col(f"`{stratum}`") if stratum else F.lit(None)).cast("string"), F.lit(""))
    known = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs"))
    joined = measured.join(checked_broadcast(known, 512), layer == F.col("__stratum"), "left")
    failed = F.filter(F.array(*[
        F.when(F.try_element_at("__cutoffs", F.lit(rule.name)) <= rule.value(F.col("__measures")), F.lit(rule.name))
        for rule in promise.rules
    ]), lambda name: name.isNotNull())
    base = base_failed(F.col("__measures"))
    verdict = F.struct(base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
    return joined.withColumn("__verdict", verdict).drop("__stratum", "__cutoffs")


def quality(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """One row per document: ``doc_id``, its stratum, ``__measures`` and ``__verdict``."""
    columns = ["doc_id", "text", *([stratum] if stratum else [])]
    measured = stage(measures(docs.select(*columns)).drop("text"), "quality")
    return judge(measured, certify(measured, labels, stratum), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """The documents that pass, with their own columns; texts are never shuffled.

    Measures are computed once for certification, where they meet the labels as a few numbers, and
    again beside the text, where the verdict filters.
    """
    columns = ["doc_id", "text", *([stratum] if stratum else [])]
    cutoffs = stage(certify(measures(docs.select(*columns)).drop("text"), labels, stratum), "quality-cutoffs")
    return judge(measures(docs), cutoffs, stratum).where("__verdict.kept and __row >= 0").select(*[F.col(f"`{c}`") for c in docs.columns])
