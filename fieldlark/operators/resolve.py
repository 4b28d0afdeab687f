"""Entity resolution: fuzzy aliases, identity previews, market mapping, review queues."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTO, NEAR = 0.95, 0.84
#: Confidence of an exact name, and of one whose context is another's; fixed values.
EXACT, OTHER_CONTEXT = 0.99, 0.88


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts, which the thresholds are tied to."""
    known: dict = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if (x, y) not in known:
            known[x, y] = None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
        out.append(known[x, y])
    return pd.Series(out, dtype="float64")


def grams(text: Column, n: int) -> Column:
    """The n-grams of a text, each with how many equal ones precede it, so that those of two texts are met one to one."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    numbered = F.transform(each, lambda g, i: F.concat(g, F.lit("\u0000"), F.size(F.filter(F.slice(each, F.lit(1), i), lambda h: h == g))))
    return F.when(F.length(text) >= n, numbered).otherwise(F.array().cast("array<string>"))


def _shared(n: int, total: Column, least: float) -> Column:
    """n-grams that two texts of ``total`` letters have in common at least if their ratio is ``least`` or more; may be negative.

    An unmatched letter of the one text breaks up to n of its n-grams, one of the other up to n - 1.
    """
    return F.ceil(total * ((2 * n - 1) * least / 2 - (n - 1)) - (n - 1) - 1e-9)


def _posted(names: DataFrame, least: float) -> DataFrame:
    """(text, key): the bigrams and, of short texts, the letters that a text of ratio ``least`` or more must share one of: the rarest.

    A text shares at least ``_shared`` grams with any partner, so it is posted under all but so many less one; frequent grams
    bring nobody together. Where bigrams bound nothing, texts so short that this holds are posted by letters.
    """
    size = F.length("text")
    total = size + F.ceil(size * (least / (2 - least)) - 1e-9)  # with the shortest partner
    two, one = _shared(2, total, least), _shared(1, total, least)
    spread = lambda n, bound, where: names.where(where).select("text", F.lit(n).alias("n"), bound.alias("bound"), F.explode(grams(F.col("text"), n)).alias("gram"))
    both = spread(2, two, two >= 1).unionByName(spread(1, one, two < 1))
    if 1.5 * least > 1:  # a longer text may have a partner so short that bigrams do not bound the pair
        most = 2 / (1.5 * least - 1)
        both = both.unionByName(spread(1, one, (two >= 1) & (total <= most)))
    counts = both.groupBy("n", "gram").agg(F.count("*").alias("_many"))
    ranked = both.join(counts, ["n", "gram"]).groupBy("text", "n").agg(F.first("bound").alias("bound"), F.sort_array(F.collect_list(F.struct("_many", "gram"))).alias("grams"))
    prefix = F.slice("grams", F.lit(1), (F.size("grams") - F.col("bound") + 1).cast("int"))
    return ranked.where(F.size("grams") >= F.col("bound")).select("text", F.explode(F.transform(prefix, lambda g: F.concat("n", g["gram"]))).alias("key"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, similarity) of the different texts of two tables (text) whose ratio is ``least`` or more.

    A prefix-filtered join: candidates share one of their rarest grams, lengths that can reach the ratio, and as many grams in all as
    it takes; only then the ratio is computed. All such pairs are found. Null and empty texts are similar to nothing.
    """
    own = [df.select("text").where("text <> ''").distinct() for df in (left, right)]
    # One order of grams for both sides: counts over both.
    posted = _posted(own[0].unionByName(own[1]).distinct(), least)
    side = lambda df, name: posted.join(df, "text", "left_semi").select(F.col("text").alias(name), "key")
    close = F.least(F.length("a"), F.length("b")) * (2 - least) >= F.greatest(F.length("a"), F.length("b")) * least - 1e-9
    met = side(own[0], "a").join(side(own[1], "b"), "key").where(close).select("a", "b").distinct()
    common = F.size(F.array_intersect(grams(F.col("a"), 2), grams(F.col("b"), 2)))
    letters = F.size(F.array_intersect(grams(F.col("a"), 1), grams(F.col("b"), 1)))
    total = F.length("a") + F.length("b")
    near = met.where((common >= _shared(2, total, least)) & (letters >= _shared(1, total, least)))
    return near.withColumn("similarity", similarity("a", "b")).where(F.col("similarity") >= least)


def resolve(names: DataFrame, aliases: DataFrame, name: str = "name", alias: str = "alias", value: str = "canonical_id", least: float = NEAR) -> DataFrame:
    """The best alias of each distinct name: exact 0.99, else the most similar at ``least`` or more; ``auto`` at 0.95 or more.

    Names are compared by ``similar_pairs``, which finds all. Ties go to the smallest value.
    """
    distinct = names.select(F.col(name).alias("_n")).where("_n IS NOT NULL").distinct()
    known = aliases.select(F.col(alias).alias("_a"), F.col(value).alias("_v")).distinct()
    exact = distinct.join(known, F.col("_n") == F.col("_a")).groupBy("_n").agg(F.min("_v").alias("_v")).select("_n", "_v", F.lit(EXACT).alias("confidence"))
    rest = distinct.join(exact, "_n", "left_anti")
    pairs = similar_pairs(rest.select(F.col("_n").alias("text")), known.select(F.col("_a").alias("text")), least)
    scored = pairs.withColumnsRenamed({"a": "_n", "b": "_a", "similarity": "_s"}).join(known, "_a")
    fuzzy = scored.groupBy("_n").agg(F.max("_s").alias("confidence"), F.min_by("_v", F.struct(-F.col("_s"), F.col("_v"))).alias("_v"))
    best = exact.unionByName(fuzzy.select("_n", "_v", "confidence"))
    return names.join(best.withColumnRenamed("_n", name), name, "left").withColumnRenamed("_v", value).withColumn("auto", F.coalesce(F.col("confidence") >= AUTO, F.lit(False)))


def resolve_in_context(names: DataFrame, aliases: DataFrame, context: list[str], name: str = "name", alias: str = "alias", value: str = "canonical_id", least: float = NEAR) -> DataFrame:
    """``resolve`` for names that several entities share, told apart by the ``context`` columns of both sides.

    An alias whose context is null or empty fits any; an exact name whose context fits none has confidence 0.88
    and so is not ``auto``. Of several that fit, or of several where none fits, the smallest value is taken.
    """
    distinct = names.select(F.col(name).alias("_n"), *context).where("_n IS NOT NULL").distinct()
    known = aliases.select(F.col(alias).alias("_n"), F.col(value).alias("_v"), *(F.col(x).alias(f"_{x}") for x in context)).distinct()
    fits = F.lit(True)
    for x in context:
        fits &= (F.coalesce(F.col(f"_{x}"), F.lit("")) == "") | F.coalesce(F.col(f"_{x}") == F.col(x), F.lit(False))
    exact = distinct.join(known, "_n").groupBy("_n", *context).agg(F.min(F.when(fits, F.col("_v"))).alias("_fit"), F.min("_v").alias("_any"))
    chosen = exact.select(F.col("_n").alias("_e"), *(F.col(x).alias(f"_{x}") for x in context), F.coalesce("_fit", "_any").alias("_exact"), F.when(F.col("_fit").isNotNull(), EXACT).otherwise(OTHER_CONTEXT).alias("_sure"))
    same = F.col(name) == F.col("_e")
    for x in context:
        same &= F.col(x).eqNullSafe(F.col(f"_{x}"))
    out = resolve(names, aliases, name, alias, value, least).join(chosen, same, "left")
    sure = F.coalesce("_sure", "confidence")
    made = {value: F.coalesce("_exact", value), "confidence": sure, "auto": F.coalesce(sure >= AUTO, F.lit(False))}
    return out.withColumns(made).drop("_e", "_exact", "_sure", *(f"_{x}" for x in context))


def identity_refs(**roles: DataFrame) -> DataFrame:
    """References (kind, provider, key) of several roles, each once, with the first role that has it."""
    out = None
    for i, (role, df) in enumerate(roles.items()):
        part = df.select("kind", "provider", "key", F.lit(role).alias("role"), F.lit(i).alias("_i"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "provider", "key").agg(F.min_by("role", "_i").alias("role"))


def preview(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolved and open references by kind."""
    known = aliases.select("kind", "provider", "key").distinct().withColumn("_known", F.lit(1))
    return refs.join(known, ["kind", "provider", "key"], "left").groupBy("kind").agg(F.count("_known").alias("resolved"), F.count_if(F.col("_known").isNull()).alias("review_required"))


def market_groups(outcomes: DataFrame) -> DataFrame:
    """Provider markets with their events, books and outcomes, for mapping."""
    return outcomes.groupBy("provider", "market_key").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("bookmaker").alias("books"), F.count("*").alias("outcomes"))


def candidates(df: DataFrame, confidence: Column, required: list[str]) -> DataFrame:
    """Review rows: what is not certain, with the fields a reviewer must fill."""
    return df.withColumn("confidence", confidence).where(F.coalesce(F.col("confidence") < AUTO, F.lit(True))).withColumn("required_fields", F.array(*map(F.lit, required)))


def promoted(decisions: DataFrame) -> DataFrame:
    """Accepted decisions as candidates only; nothing is promoted by itself."""
    return decisions.where(F.col("decision") == "accepted").withColumn("status", F.lit("candidate_only"))


def ready(identities: DataFrame, markets: DataFrame) -> bool:
    """Whether neither has anything under review, which promotion needs."""
    under = lambda df: df.where("review_required > 0").isEmpty()
    return under(identities) and under(markets)


def patched(markets: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """The dimension with the patch's new rows; rows whose key is known are not replaced."""
    return markets.unionByName(patch.dropDuplicates([key]).join(markets.select(key), key, "left_anti"))


#: What a market of a patch must say; fixed values.
MARKET_FIELDS = ("canonical_market_id", "family", "settlement_rule", "selection_scope", "correlation_group")


def patch_faults(patch: dict, markets: DataFrame, aliases: DataFrame, targets: list[str]) -> DataFrame:
    """(fault, rows) of a review patch that may not be applied: its flags, its new ``markets`` and ``aliases``, each fault with its rows.

    A patch is for offline samples alone, is never applied, used or trained on by itself, and has markets and aliases; a market fills
    MARKET_FIELDS, an alias no longer asks for review and is of one of the ``targets``. No faults: no rows.
    """
    blank = F.lit(False)
    for field in MARKET_FIELDS:
        blank |= F.trim(F.coalesce(field, F.lit(""))) == ""
    flags = {
        "scope_not_offline": patch.get("scope") != "offline_sample_only",
        "automatic_use_allowed": any(patch.get(f"{x}_allowed", False) for x in ("automatic_application", "production_use", "training_dataset_promotion")),
    }
    spark = markets.sparkSession
    out = spark.createDataFrame([(name, int(bad)) for name, bad in flags.items()], "fault string, rows long")
    counted = markets.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("no_markets"), F.count_if(blank).alias("market_without_field")).unpivot([], ["no_markets", "market_without_field"], "fault", "rows")
    named = aliases.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("no_aliases"), F.count_if(F.col("review_required")).alias("alias_needs_review"), F.count_if(~F.coalesce(F.col("provider_market_key").isin(*targets), F.lit(False))).alias("alias_of_another_market"))
    return out.unionByName(counted).unionByName(named.unpivot([], ["no_aliases", "alias_needs_review", "alias_of_another_market"], "fault", "rows")).where("rows > 0")


def applied(markets: DataFrame, aliases: DataFrame, new_markets: DataFrame, new_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(markets, aliases) with a patch's rows; what is known already, by market id or by provider and market key, stays as it is."""
    keys = ["provider_id", "provider_market_key"]
    more = new_aliases.dropDuplicates(keys).join(aliases.select(*keys), keys, "left_anti")
    return patched(markets, new_markets, "canonical_market_id"), aliases.unionByName(more)


def rank_within(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
