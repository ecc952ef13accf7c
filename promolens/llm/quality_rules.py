"""Quality rules whose cutoffs carry a risk guarantee.

Every document gets a few shares that are large in junk: symbols, repeated
lines, repeated five-word windows, capitals, shouting marks. A document is
rejected where a share exceeds the cutoff of its stratum, and a cutoff is used
only if labelled clean documents prove that it rejects few of them:

* per stratum and rule, candidate cutoffs are tried from the most lenient one
  on; a cutoff passes while the exact binomial tail P(X <= k | n, risk) of its
  k false rejections among n clean labelled documents is at most the error
  level, which is the same as a Clopper-Pearson upper bound below the risk;
* the first failure ends the sequence, so no correction is due among the
  cutoffs of one rule (fixed-sequence testing); the error level is divided by
  the number of strata times rules (Bonferroni), and the risk by the rules;
* of the cutoffs that passed, the one that rejects most labelled junk, minus a
  price for each clean document, is used; ties take the more lenient one.

Too few labels in a stratum certify nothing there, and nothing is rejected.
Everything is built-in expressions; only the number of strata reaches the driver.

Edge cases: a null text is empty (no words, base failure); a null stratum is
a stratum of its own; conflicting labels of one id count as clean; a null label
or a label without a document is not used; repeated rows are judged one by one.
An empty table gives an empty result. ``into`` names the one added struct
column and replaces a column of that name; all other columns pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.columns import any_names, let, whole_text, words
from promolens.operators.joins import broadcast_if_small

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "repeated_lines", "repeated_words", "capitals", "shouting")


@dataclass(frozen=True)
class Risk:
    """``risk``: clean documents that may be rejected, as a share per stratum;
    ``error``: probability that any of the guarantees fails; ``clean_price``:
    how many junk documents one lost clean document weighs when choosing."""

    risk: float = 0.01
    error: float = 0.05
    clean_price: float = 20.0
    cutoffs: Sequence[float] = (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5,
                                0.6, 0.7, 0.8, 0.9)
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    broadcast_rows: int = 10_000


def repeated_words(found: Column, width: int) -> Column:
    """Words covered by ``width``-word windows that occur twice or more.

    Windows are compared by 64-bit hash: a hash-set pass settles texts without
    a repeat, others sort (hash, place) and look at neighbours.
    """
    count = F.size(found)
    hashes = F.when(count >= width, F.transform(
        F.sequence(F.lit(1), F.greatest(count - (width - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.get(found, i + (k - 1)) for k in range(width)])))

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, i: x["h"].eqNullSafe(F.get(ordered, i - 1)["h"])
                         | x["h"].eqNullSafe(F.get(ordered, i + 1)["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["at"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, at: F.struct(
            at.alias("last"), (acc["n"] + F.least(F.lit(width), at - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    return let(hashes, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), 0)
               .otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(
                   x.alias("h"), i.alias("at")))), covered)))


def rule_statistics(docs: DataFrame, config: Risk = Risk(), text: str = "text",
                    into: str = "rules") -> DataFrame:
    """Counts and shares of every whole text, from one split into words and one into lines."""
    whole = whole_text(text)
    in_words = F.char_length(F.translate(whole, "\x20\x09\x0a\x0b\x0c\x0d", ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def removed(chars: str) -> Column:
        return F.char_length(whole) - F.char_length(F.translate(whole, chars, ""))

    counts = F.struct(
        let(words(whole), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w, config.window).cast("long").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        in_words.cast("long").alias("word_chars"), removed(SYMBOLS).cast("long").alias("n_symbols"),
        removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"), removed("!?").alias("shouts"))

    def share(part: Column, of: Column) -> Column:
        return part / F.greatest(of, F.lit(1))

    def shaped(c: Column) -> Column:
        w, line = c["w"], c["l"]
        chars = c["word_chars"]
        return F.struct(
            w["n_words"].alias("n_words"), chars.alias("word_chars"),
            c["n_symbols"].alias("n_symbols"), line["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            ((w["n_words"] < config.min_words) | (100 * w["n_repeat_words"]
             > config.max_repeat_percent * w["n_words"])).alias("base_failed"),
            F.array(share(c["n_symbols"], chars), share(line["n_dup_lines"], line["n_lines"]),
                    share(w["n_repeat_words"], w["n_words"]), share(c["capitals"], chars),
                    share(c["shouts"], chars)).alias("shares"))

    return docs.withColumn(into, let(counts, shaped))


def binomial_tail(failures: Column, trials: Column, rate: float) -> Column:
    """P(X <= failures) for X of Binomial(trials, rate), summed in logarithms."""
    first = trials * F.log1p(F.lit(-rate))
    step = math.log(rate / (1 - rate))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((trials - i + 1) / i) + step
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    # Above the mean no small tail is possible, so such counts need no sum.
    total = F.when(failures == 0, first).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(failures, F.lit(1)).cast("int")), start, add,
        lambda acc: acc["sum"]))
    return F.when(failures >= trials * rate, 1.0).otherwise(F.exp(total))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, config: Risk = Risk(),
                      key: str = "doc_id", stratum: str = "lang",
                      into: str = "rules") -> DataFrame:
    """(stratum, cutoffs): for each stratum an array with a cutoff or null per rule.

    Labelled documents are reduced to counts per (stratum, rule, bin), so what
    moves does not grow with the texts.
    """
    grid = sorted(config.cutoffs)
    judged = (labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
              .groupBy(F.col(key).alias("_key")).agg(F.max("quality").alias("_clean")))
    shares = stats.select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("stratum"),
                          F.col(into)["shares"].alias("_shares"),
                          F.col(into)["base_failed"].alias("_base"))
    bins = F.transform(F.col("_shares"), lambda v: F.size(F.filter(
        F.array(*map(F.lit, grid)), lambda c: v > c)))
    counted = (shares.filter(~F.col("_base")).join(judged, "_key")
               .select("stratum", "_clean", F.posexplode(bins).alias("rule", "bin"))
               .groupBy("stratum", "rule", "bin")
               .agg(F.sum(F.when(F.col("_clean") == 1, 1).otherwise(0)).alias("clean"),
                    F.sum(F.when(F.col("_clean") == 1, 0).otherwise(1)).alias("junk")))
    # A value in bin b exceeds the b lowest cutoffs.
    per_cutoff = (counted.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(grid)))))
                  .groupBy("stratum", "rule", "at")
                  .agg(*[F.sum(F.when(F.col("bin") >= F.col("at"), F.col(c)).otherwise(0)).alias(c)
                         for c in ("clean", "junk")]))
    trials = Window.partitionBy("stratum", "rule")
    tested = (per_cutoff.withColumn("n", F.max("clean").over(trials)).filter("at > 0")
              .withColumn("cutoff", F.element_at(F.array(*map(F.lit, grid)), F.col("at").cast("int"))))
    strata = tested.select("stratum").distinct().count()
    level = config.error / max(1, strata * len(RULES))
    risk = config.risk / len(RULES)
    in_order = trials.orderBy(F.desc("cutoff"))
    passing = (tested.withColumn("ok", binomial_tail(F.col("clean"), F.col("n"), risk) <= level)
               .withColumn("all_ok", F.min("ok").over(in_order)).filter("all_ok"))
    worth = F.struct((F.col("junk") - config.clean_price * F.col("clean")).alias("gain"), "cutoff")
    best = (passing.groupBy("stratum", "rule").agg(F.max(worth).alias("best"))
            .filter("best.gain > 0"))
    pairs = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(
        F.struct("rule", "best.cutoff"))).alias("by_rule"))
    return pairs.select("stratum", F.array(*[F.try_element_at("by_rule", F.lit(r))
                                             for r in range(len(RULES))]).alias("cutoffs"))


@any_names
def apply_cutoffs(stats: DataFrame, cutoffs: DataFrame, config: Risk = Risk(),
                  stratum: str = "lang", into: str = "rules") -> DataFrame:
    """Add ``kept`` to the struct: no base failure and no share above its cutoff.

    The cutoffs are staged, counted and broadcast up to ``broadcast_rows``
    strata; with more strata than that they are joined by shuffle.
    """
    side = broadcast_if_small(cutoffs.select(F.col("stratum").alias("_stratum"),
                                             F.col("cutoffs").alias("_cutoffs")),
                              config.broadcast_rows)
    above = F.exists(F.zip_with(F.col(into)["shares"], F.col("_cutoffs"),
                                lambda v, c: F.coalesce(v > c, F.lit(False))), lambda x: x)
    kept = ~F.col(into)["base_failed"] & ~F.coalesce(above, F.lit(False))
    joined = stats.join(side, F.col(stratum).cast("string").eqNullSafe(F.col("_stratum")), "left")
    return (joined.withColumn(into, F.col(into).withField("kept", kept))
            .drop("_stratum", "_cutoffs"))


