"""Quality rules: text statistics and a learned decision list, in DataFrame functions alone.

Sequential covering learns rules that reject: each rule is grown, one threshold at a time, on two thirds of the
labelled rows left, pruned on the other third, and kept while it is precise there. The list becomes one ordered
conditional expression. Only counts by feature and threshold reach the driver.

Defined results: a null text has no words; empty texts and very long ones are counted whole; a document that is
labelled twice teaches with its smallest label; null labels teach nothing; without a bad label the list is
empty and rejects nothing. Repeated rows are counted alike. Other columns pass through; a column named like a
statistic is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import stash, unused

#: Labelled rows that the list is learned from, about: a bounded sample.
ROWS = 20_000
#: Words of a window, bits that hold a window's place while its hash sorts; longer texts sort hash and place apart.
WINDOW, PLACE = 5, 24
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "other_share", "dup_line_share", "repeat_share", "line_words")
BINS = 24


def words(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words that occur twice or more.

    Windows sort by (part of a hash, place), packed in a long where the place fits; neighbours of equal hash are
    the candidates, and their words are compared before they count.
    """
    size = F.size(words)
    low = (1 << PLACE) - 1
    window = lambda i: F.slice(words, i, n)
    places = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
    packed = F.sort_array(F.transform(places, lambda i: F.xxhash64(window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    apart = F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(window(i)).alias("h"), i.alias("i"))))
    same = lambda a, b: F.shiftright(a, PLACE) == F.shiftright(b, PLACE)
    at = lambda xs, i: F.get(xs, i)

    def candidates(xs: Column) -> Column:
        near = F.filter(xs, lambda x, i: F.coalesce(same(x, at(xs, i - 1)), F.lit(False)) | F.coalesce(same(x, at(xs, i + 1)), F.lit(False)))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))

    def candidates_apart(xs: Column) -> Column:
        near = F.filter(xs, lambda x, i: F.coalesce(x["h"] == at(xs, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == at(xs, i + 1)["h"], F.lit(False)))
        return F.transform(near, lambda x: x["i"])

    def confirmed(places: Column) -> Column:
        rows = F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(window(i), " ").alias("w"), i.alias("i"))))
        return F.array_sort(F.transform(_twins(rows), lambda r: r["i"]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.coalesce(at(places, i + 1) - p, F.lit(n)), F.lit(n)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    step = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  names a value within an expression
    near = F.when(size < (1 << PLACE), step(packed, candidates)).otherwise(step(apart, candidates_apart))
    found = step(near, lambda places: F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(step(confirmed(places), covered)))
    return F.when(size < n + 1, F.lit(0).cast("long")).otherwise(found)


def _twins(rows: Column) -> Column:
    """The rows whose neighbour has the same words."""
    return F.get(
        F.transform(
            F.array(rows), lambda xs: F.filter(xs, lambda x, i: F.coalesce(x["w"] == F.get(xs, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(xs, i + 1)["w"], F.lit(False)))
        ),
        F.lit(0),
    )


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the learned features."""
    source = F.coalesce(F.col(text), F.lit(""))
    count = lambda kept: F.length(F.regexp_replace(source, kept, "")).cast("long")  # noqa: E731  characters outside a class
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(both: Column) -> Column:
        found, rows = both["w"], both["l"]
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            count(r"[\x20\x09-\x0D]+").alias("word_chars"),
            count(r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            repeated_words(found).alias("n_repeat_words"),
            F.struct(count(r"\P{Lu}+").alias("upper"), count(r"[\p{L}\s]+").alias("other"), F.size(rows).alias("lines")).alias(more),
        )

    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    more = unused(df, "_more")
    # A generator: filters on what it makes are not moved below it, where the counts would be made twice.
    counted = df.select(*kept, F.inline(F.transform(F.array(F.struct(words(F.col(text)).alias("w"), lines.alias("l"))), counts)))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "n_words"),
            "upper_share": share(f"{more}.upper", "word_chars"),
            "other_share": share(f"{more}.other", "word_chars"),
            "dup_line_share": share("n_dup_lines", f"{more}.lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "line_words": share("n_words", f"{more}.lines"),
        }
    ).drop(more)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list, tried in order, rejects."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS, max_rules: int = 6, max_conditions: int = 3, precision: float = 0.9) -> list[Rule]:
    """Learn the list that rejects rows with label 0, from about ``rows`` labelled rows chosen by a hash of the key.

    A rule must be right on ``precision`` of the rows it rejects, on its own third, to be kept.
    """
    drawn = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.min(label) == 0).alias("_bad"))
    total = drawn.count()
    if not total:
        return []
    drawn = drawn.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / total))).select(F.col(key).alias("_key"), "_bad")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(drawn), "_key")
    grow = F.pmod(F.xxhash64(F.col("_key"), F.lit("part")), F.lit(3)) < 2
    left = stash(statistics(texts).drop("text").where(~F.col("base_failed")).select("_bad", grow.alias("_grow"), *(F.col(f).cast("double").alias(f) for f in FEATURES)))
    share = [i / BINS for i in range(1, BINS)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    cuts = left.agg(*(F.sort_array(F.array_distinct(F.percentile_approx(f, sorted(share), 10_000))).alias(f) for f in FEATURES)).first()
    cuts = {f: cuts[f] or [] for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            bad, good, found = _counts(left.where(F.col("_grow") & _all(rule)), cuts)
            best = max(((_gain(b, g, bad, good), c) for c, (b, g) in found.items()), key=lambda x: (x[0], x[1].feature, x[1].above, x[1].threshold), default=(0, None))
            if best[0] <= 0:
                break
            rule += (best[1],)
            if found[best[1]][1] == 0:
                break
        shorter = [rule[:n] for n in range(1, len(rule) + 1)]
        tested = left.where(~F.col("_grow")).agg(*(x for r in shorter for x in (F.count_if(_all(r) & F.col("_bad")), F.count_if(_all(r) & ~F.col("_bad"))))).first() if rule else ()
        worth = [(tested[2 * i] / max(1, tested[2 * i] + tested[2 * i + 1]), tested[2 * i], -i) for i in range(len(shorter))]
        good_enough = [w for w in worth if w[0] >= precision and w[1] >= 2]
        if not good_enough:
            break
        kept = shorter[-max(good_enough, key=lambda w: (w[1] - 4 * (w[1] / w[0] - w[1]), w[2]))[2]]
        rules.append(kept)
        left = left.where(~_all(kept))
    return rules


def _gain(b: int, g: int, bad: int, good: int) -> float:
    """How many bits the rows kept say more about being bad, over the bad rows kept."""
    from math import log2

    if not b:
        return 0.0
    return b * (log2((b + 1) / (b + g + 2)) - log2((bad + 1) / (bad + good + 2)))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[int, int, dict[Condition, tuple[int, int]]]:
    """Bad and good rows, and those that each condition keeps, from counts by feature and bin."""
    def bin_of(f: str) -> Column:
        x, thresholds = F.col(f), F.array(*map(F.lit, cuts[f])).cast("array<double>")
        return F.struct(F.lit(f).alias("feature"), F.size(F.filter(thresholds, lambda t: t < x)).alias("bin"))

    bins = F.array(*map(bin_of, FEATURES))
    table = rows.select("_bad", F.inline(bins)).groupBy("feature", "bin").agg(F.count_if("_bad").alias("b"), F.count_if(~F.col("_bad")).alias("g")).collect()
    out = {}
    bad = good = 0
    for f in FEATURES:
        by = {r["bin"]: (r["b"], r["g"]) for r in table if r["feature"] == f}
        bad, good = sum(b for b, _ in by.values()), sum(g for _, g in by.values())
        below = [0, 0]
        for k, cut in enumerate(cuts[f]):
            below = [x + y for x, y in zip(below, by.get(k, (0, 0)), strict=True)]  # bins 0..k hold values <= cut k
            out[Condition(f, False, cut)] = (below[0], below[1])
            out[Condition(f, True, cut)] = (bad - below[0], good - below[1])
    return bad, good, out
