"""Document quality by a learned decision list: ordered threshold rules, as Spark conditional expressions.

Everything here is DataFrame expressions; the driver only picks the next condition from counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm.common import SPACE, stored, table, text_or_empty

SYMBOLS = "[#*$%&|<>]"
FEATURES = (
    "n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "exclaim_rate", "digit_rate",
    "mark_rate",
)
PACKED_BITS = 17  # of a window's place in the text, beside the hash of the window
GROW_PARTS, ALL_PARTS = 2, 3
END_CUTS = 4  # cuts beyond the outermost quantile on either side, each at half the share of the one before
ACCURACY = 4000


def removed(text: Column, pattern: str) -> Column:
    """How many characters of a text a character class matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are hashed and sorted with their places, so equal ones become neighbours; no two arrays are compared
    element by element. Place and hash share one long up to 2**17 words; longer texts
    sort pairs and keep the whole hash.
    """
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda ab, c: F.xxhash64(ab, c))
    windows = F.slice(windows, F.lit(1), n - 2)
    low = (1 << PACKED_BITS) - 1

    def packed(h: Column, i: Column) -> Column:
        return h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

    def both(a: Column, b: Column) -> Column:
        same = F.shiftright(a.bitwiseXOR(b), PACKED_BITS) == 0
        return F.when(same, F.shiftleft(a.bitwiseAND(F.lit(low)), 32).bitwiseOR(b.bitwiseAND(F.lit(low)))).otherwise(-1)

    def pair(h: Column, i: Column) -> Column:
        return F.struct(h.alias("h"), i.cast("long").alias("i"))

    def both_long(a: Column, b: Column) -> Column:
        return F.when(a["h"] == b["h"], F.shiftleft(a["i"], 32).bitwiseOR(b["i"])).otherwise(-1)

    def neighbours(ordered: Column, of) -> Column:
        return bound(ordered, lambda s: F.zip_with(F.slice(s, F.lit(1), n - 3), F.slice(s, F.lit(2), n - 3), of))

    def covered(x: Column) -> Column:
        a, b = F.shiftright(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))
        return F.array(a, a + 1, a + 2, b, b + 1, b + 2)

    found = F.when(n <= low, neighbours(F.sort_array(F.transform(windows, packed)), both))
    found = found.otherwise(neighbours(F.sort_array(F.transform(windows, pair)), both_long))
    found = F.filter(found, lambda x: x >= 0)
    return F.when(n < 4, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(found, covered)))))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``stats``: counts of each whole text; a null text has none of anything."""
    text = text_or_empty()
    rows = docs.withColumn("_words", F.array_remove(F.split(text, f"{SPACE}+"), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        removed(text, "[A-Z]").cast("long").alias("n_upper"),
        removed(text, "!").cast("long").alias("n_exclaims"),
        removed(text, "[0-9]").cast("long").alias("n_digits"),
        removed(text, "[.,;:?]").cast("long").alias("n_marks"),
    )
    return rows.withColumn("stats", counts).drop("_words", "_lines")


def feature(name: str, stats: Column) -> Column:
    """A feature that rules put thresholds on, from the counts of a text; rates are 0 where there is nothing to count."""
    n, chars = stats["n_words"], stats["word_chars"]

    def rate(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return {
        "n_words": n.cast("double"),
        "mean_word": rate(chars, n),
        "symbol_rate": rate(stats["n_symbols"], n),
        "dup_line_rate": rate(stats["n_dup_lines"], stats["n_lines"]),
        "repeat_rate": rate(stats["n_repeat_words"], n),
        "upper_rate": rate(stats["n_upper"], chars),
        "exclaim_rate": rate(stats["n_exclaims"], n),
        "digit_rate": rate(stats["n_digits"], chars),
        "mark_rate": rate(stats["n_marks"], n),
    }[name]


def base_failed(stats: Column, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_repeat_percent * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def of(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold

    def on(self, stats: Column) -> Column:
        return self.of(feature(self.feature, stats))

    def on_values(self) -> Column:
        return self.of(F.col("values")[FEATURES.index(self.feature)])

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def every(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def covers(rule: Rule) -> Column:
    return every([c.on_values() for c in rule])


def valued(labelled: DataFrame) -> DataFrame:
    """The labelled rows as (bad, growing, values)."""
    values = F.array(*[feature(f, F.col("stats")) for f in FEATURES])
    growing = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(ALL_PARTS)) < GROW_PARTS
    return stored(labelled.select("bad", growing.alias("growing"), values.alias("values")), "labelled-values")


def thresholds_of(rows: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Where a condition on these rows may cut each feature: quantiles of all of them and of the bad ones, finer towards both ends."""
    inner = [i / (cuts + 1) for i in range(1, cuts + 1)]
    ends = [inner[0] / 2**k for k in range(1, END_CUTS + 1)]
    shares = sorted([*inner, *ends, *[1 - e for e in ends]])
    values = [F.col("values")[at] for at in range(len(FEATURES))]
    found = rows.agg(
        *[F.percentile_approx(v, shares, ACCURACY) for v in values],
        *[F.percentile_approx(F.when(F.col("bad"), v), shares, ACCURACY) for v in values],
    ).first()
    return {f: sorted({*(found[at] or []), *(found[len(FEATURES) + at] or [])}) for at, f in enumerate(FEATURES)}


def histogram(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[tuple[int, int], list[int]]:
    """Rows that are not bad and bad by (feature, bin): the numbers of features and thresholds bound its size."""

    def bin_of(at: int, name: str) -> Column:
        value = F.col("values")[at]
        return F.size(F.filter(F.lit(thresholds[name]).cast("array<double>"), lambda t: value > t))

    bins = F.array(*[bin_of(at, f) for at, f in enumerate(FEATURES)])
    counts = rows.select("bad", F.posexplode(bins).alias("at", "bin")).groupBy("at", "bin").agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad")
    )
    return {(r["at"], r["bin"]): [r["good"], r["bad"]] for r in counts.collect()}


def gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """Information that a condition adds over the rows it keeps (FOIL)."""
    if not bad or not all_bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def best_condition(counts: dict[tuple[int, int], list[int]], thresholds: dict[str, list[float]]) -> tuple[float, Condition | None, int]:
    """The condition of most gain, its gain, and how many rows that are not bad it leaves."""
    best: tuple[float, Condition | None, int] = (0.0, None, 0)
    for at, name in enumerate(FEATURES):
        good, bad = ([counts.get((at, b), [0, 0])[k] for b in range(len(thresholds[name]) + 1)] for k in (0, 1))
        all_good, all_bad, under_good, under_bad = sum(good), sum(bad), 0, 0
        for bin_, threshold in enumerate(thresholds[name]):
            under_good, under_bad = under_good + good[bin_], under_bad + bad[bin_]
            for above, g, b in ((False, under_good, under_bad), (True, all_good - under_good, all_bad - under_bad)):
                value = gain(b, g, all_bad, all_good)
                if value > best[0] + 1e-9:
                    best = value, Condition(name, above, threshold), g
    return best


def centred(condition: Condition, rows: DataFrame) -> Condition:
    """The condition with its threshold in the middle of the gap between the labelled values on either side of it."""
    value = F.col("values")[FEATURES.index(condition.feature)]
    under = value <= condition.threshold
    low, high = rows.agg(F.max(F.when(under, value)), F.min(F.when(~under, value))).first()
    return condition if low is None or high is None else replace(condition, threshold=(low + high) / 2)


def prune(rule: Rule, rows: DataFrame, min_precision: float, min_rows: int) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on; empty if none is good enough."""
    worth = []
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k])
        worth += [F.count_if(hit & F.col("bad")).alias(f"bad{k}"), F.count_if(hit & ~F.col("bad")).alias(f"good{k}")]
    found, best, kept = rows.agg(*worth).first(), -2.0, ()
    for k in range(1, len(rule) + 1):
        bad, good = found[f"bad{k}"], found[f"good{k}"]
        if bad + good >= min_rows and bad >= min_precision * (bad + good) and (bad - good) / (bad + good) > best + 1e-9:
            best, kept = (bad - good) / (bad + good), rule[:k]
    return kept


def learn(
    labelled: DataFrame, cuts: int = 40, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.9, min_rows: int = 5, max_emptied: int = 8
) -> list[Rule]:
    """Rules for bad documents from (doc_id, stats, bad), by sequential covering.

    Two thirds of the rows grow a rule, condition by condition, each the threshold of most information gain, until it
    covers no good row; the others prune it back to the beginning that is worth most there. Every condition chooses from
    quantiles of the rows that are still covered, so a defect of few rows is cut out by ever finer ones. What a rule covers is
    taken away before the next one. A rule enters only with ``min_precision`` on at least ``min_rows`` of the rows it
    was not grown on; one that fails is emptied, the bad rows it grew on are set aside and the next is grown without them,
    until ``max_emptied`` have failed. Every step is two aggregates over the labelled rows. No rows give no rules.
    """
    rows = valued(labelled)
    rules: list[Rule] = []
    emptied: list[Rule] = []
    while len(rules) < max_rules and len(emptied) < max_emptied:
        left = rows.where(every([~covers(r) for r in rules]))
        growing = left.where(F.col("growing") & ~(F.col("bad") & ~every([~covers(r) for r in emptied])))
        grown: Rule = ()
        while len(grown) < max_conditions:
            covered = growing.where(covers(grown))
            thresholds = thresholds_of(covered, cuts)
            value, condition, good = best_condition(histogram(covered, thresholds), thresholds)
            if condition is None:
                break
            grown = (*grown, centred(condition, rows))
            if not good:
                break
        if not grown:
            break
        rule = prune(grown, left.where(~F.col("growing")), min_precision, min_rows)
        (rules if rule else emptied).append(rule or grown)
    return rules


def verdict(rules: Sequence[Rule], stats: Column) -> Column:
    """The decision list as one conditional expression: the number of the first rule that fits, from 1; 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        hit = every([c.on(stats) for c in rule])
        out = F.when(hit, number) if out is None else out.when(hit, number)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, stats, bad) of the rows that have a quality label; null labels and ids are left out, a doubly labelled
    document counts as bad if any label says so."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return rows.select("doc_id", "stats").join(marks, "doc_id")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, rule, kept) of every document.

    Rules learn from the labelled documents that pass the base. ``rule`` is the rule that rejects the document, else 0.
    Null or empty texts have no words and fail the base; rows that repeat are judged each on their own; with no
    usable labels only the base decides. An empty table gives an empty result, and further columns are not read.
    """
    stats = F.col("stats")
    rows = stored(text_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "text-statistics")
    rules = learn(labelled_rows(rows.where(~base_failed(stats)), labels))
    rule = verdict(rules, stats)
    return rows.select("doc_id", "stats.*", base_failed(stats).alias("base_failed"), rule.alias("rule"),
                       (~base_failed(stats) & (rule == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base and the learned rules keep, with all their columns."""
    stats = F.col("stats")
    labelled = docs.select("doc_id", "text").join(labels.where(F.col("quality").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    rows = stored(text_statistics(labelled).select("doc_id", "stats"), "text-statistics")
    rules = learn(labelled_rows(rows.where(~base_failed(stats)), labels))
    marked = text_statistics(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return marked.where(~base_failed(stats) & (verdict(rules, stats) == 0)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
