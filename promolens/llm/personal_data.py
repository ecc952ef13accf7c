"""Personal data in texts: fixed patterns, and boosted trees over further candidates.

Four patterns with their checks (email, ip, card, phone) always count. Beside
them, high-recall generators propose spans that may overlap each other and the
patterns: anything around an at sign or its spelled-out forms, any longer run
of digits and separators, dotted or colon-separated groups. Each candidate
gets format features (digits, separators, groups, check digit, ranges) and
context features (words before it, signs beside it). A candidate is an example
of personal data where a pattern with its checks confirms a span in it. One that
no pattern confirms is an example of other text only if nothing speaks for it:
with a hint before it (a word as in ``HINTS``), or an at sign that is spelled
out, it has no label, takes no part in training or calibration, and is what the
trees decide on. Others are never added, so text without a sign of personal data
stays as it is.

So that the trees cannot learn the patterns themselves, every confirmed
candidate is an example a second time with the sign hidden that its pattern
needs: the at sign spelled out, or the plus and the separators left out. Equal
feature rows are one weighted row, so training does not grow with copies.

The trees become plain column expressions. Per generator, the threshold is the
lowest score at which labelled candidates of the held-out fold, the confirmed
ones in their hidden form, reach ``precision``; a generator that never reaches
it with ``least`` candidates adds nothing. Spans that touch a base span add
nothing either.

All steps are built-in expressions and Spark's own tree training. The driver
sees the trees and counts per (generator, score bin), both of fixed size.

Edge cases: null text is empty; no candidate gives empty lists; a table whose
candidates are all of one class adds no span; an empty table gives an empty
result. ``into`` names the added struct and replaces a column of that name;
other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.llm.columns import let, whole_text
from promolens.llm.scratch import table
from promolens.llm.spans import by_kind, listed, of_kind, overlaps, redacted, spans

# Fixed values of the base rules. Possessive forms and a look behind match the same
# spans and keep the time in proportion to the text.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

GENERATORS = {
    "address": r"(?<![^\s<(\[\"'])[^\s@]{1,64}\s?(?:@|\(at\)|\[at\])\s?[^\s@]{1,64}",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}",
    "groups": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?:[:.][0-9A-Fa-f]{1,4}){3,8}"}
HINTS = r"(?i)(mail|contact|write|call|tel|phone|mobile|fax|card|visa|iban|account|ip|host|server)[^\s]{0,4}\s?$"
#: An at sign that is spelled out, between the parts of an address.
SPELLED = r"(?i)[A-Za-z0-9._%+-]\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SCORE_BINS = 100


@dataclass(frozen=True)
class Boosting:
    """``rounds`` trees of ``depth``; every fifth text by hash is held out for the thresholds."""

    rounds: int = 12
    depth: int = 3
    precision: float = 0.95
    least: int = 20
    context: int = 24


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
        d.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def only_digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The spans of the four patterns that pass their checks, by kind, then place."""
    def byte_parts(m: Column) -> Column:
        return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (
            F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255)))

    def card(m: Column) -> Column:
        return let(only_digits(m), lambda d: F.length(d).between(13, 19) & luhn(d))

    return by_kind(F.concat(
        of_kind(spans(text, EMAIL), 0, "email"), of_kind(spans(text, IP, byte_parts), 1, "ip"),
        of_kind(spans(text, CARD, card), 2, "card"),
        of_kind(spans(text, PHONE, lambda m: F.length(only_digits(m)).between(9, 15)), 3, "phone")))


def features(found: Column, before: Column, after: Column) -> Column:
    """Format and context of a candidate as an array of numbers."""
    def removed(chars: str) -> Column:
        return F.length(found) - F.length(F.translate(found, chars, ""))

    digits = only_digits(found)
    size = F.length(found)
    numbers = [size, F.length(digits), removed("."), removed("-"), removed(" "), removed("()"),
               removed("@") + F.size(F.regexp_extract_all(found, F.lit(r"(?i)[(\[]at[)\]]"), F.lit(0))),
               removed(":"), removed("+"),
               F.size(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))),
               F.size(F.regexp_extract_all(found, F.lit("[A-Za-z]+"), F.lit(0))),
               F.when(F.length(digits).between(8, 24), luhn(digits)).otherwise(False),
               found.rlike(r"^\+[0-9]"), found.rlike(r"\.[A-Za-z]{2,8}\W*$"),
               F.exists(F.split(found, "[^0-9]+"), lambda p: F.length(p) > 3),
               before.rlike(HINTS), before.rlike(r"[#$€=/_A-Za-z0-9]$"), after.rlike(r"^[%A-Za-z0-9_/]")]
    return F.array(*[F.coalesce(n.cast("double"), F.lit(0.0)) for n in numbers])


def hidden(found: Column, generator: int) -> Column:
    """A candidate without the sign that its pattern needs."""
    if list(GENERATORS)[generator] == "address":
        return F.regexp_replace(found, "@", "(at)")
    if list(GENERATORS)[generator] == "number":
        return F.regexp_replace(found, "[+().-]", "")
    return F.translate(found, ":", ".")


def candidates(text: Column, config: Boosting) -> Column:
    """Spans of all generators with their features; they may overlap."""
    near = config.context

    def of(rank: int, pattern: str) -> Column:
        def described(s: Column, before: Column, after: Column) -> Column:
            return F.struct(
                s["start"].alias("start"), F.lit(rank).alias("generator"), s["end"].alias("end"),
                features(s["found"], before, after).alias("x"),
                features(hidden(s["found"], rank), before, after).alias("hidden"),
                (before.rlike(HINTS) | s["found"].rlike(SPELLED)).alias("open"))

        def around(s: Column) -> Column:
            return F.struct(F.substring(text, F.greatest(s["start"] - near + 1, F.lit(1)),
                                        F.least(s["start"], F.lit(near))).alias("before"),
                            F.substring(text, s["end"] + 1, F.lit(near)).alias("after"))

        return F.transform(spans(text, pattern), lambda s: let(
            around(s), lambda n: described(s, n["before"], n["after"])))

    return F.concat(*[of(i, p) for i, p in enumerate(GENERATORS.values())])


def scanned(docs: DataFrame, config: Boosting = Boosting(), text: str = "text",
            into: str = "pii") -> DataFrame:
    """Base spans and candidates of every text: the struct (base, candidates, held_out)."""
    whole = whole_text(text)

    def marked(base: Column) -> Column:
        return F.transform(candidates(whole, config), lambda c: F.struct(
            c["start"].alias("start"), c["generator"].alias("generator"), c["end"].alias("end"),
            c["x"].alias("x"), c["hidden"].alias("hidden"), c["open"].alias("open"),
            overlaps(c, base).alias("personal")))

    return docs.withColumn(into, let(base_spans(whole), lambda b: F.struct(
        b.alias("base"), marked(b).alias("candidates"),
        (F.pmod(F.xxhash64(whole), F.lit(5)) == 0).alias("held_out"))))


def tree_column(node, x: Column) -> Column:
    """One regression tree as nested conditions over the features."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= float(split.threshold()),
                  tree_column(node.leftChild(), x)).otherwise(tree_column(node.rightChild(), x))


def examples(found: DataFrame, into: str, held_out: bool) -> DataFrame:
    """(generator, x, personal) of the labelled candidates of one side: confirmed ones in their
    hidden form and, for training, as they are; others unless they are open."""
    one = (found.filter(F.col(into)["held_out"] == held_out)
           .select(F.explode(F.col(into)["candidates"]).alias("c"))
           .filter("c.personal OR NOT c.open"))
    forms = F.when(F.col("c.personal"), F.array("c.hidden") if held_out else F.array(
        "c.x", "c.hidden")).otherwise(F.array("c.x"))
    return one.select("c.generator", F.explode(forms).alias("x"), "c.personal")


def trained(found: DataFrame, config: Boosting, into: str):
    """The scoring function of boosted trees, or None where one class is missing."""
    rows = (examples(found, into, False).groupBy("x", F.col("personal").cast("double").alias("label"))
            .agg(F.count(F.lit(1)).cast("double").alias("weight")))
    rows = table(rows, "candidates")
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=config.rounds, maxDepth=config.depth, weightCol="weight", seed=1,
                          cacheNodeIds=False).fit(rows.select(
                              array_to_vector("x").alias("features"), "label", F.sqrt("weight").alias("weight")))
    trees = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]

    def score(x: Column) -> Column:
        margin = sum((F.lit(float(w)) * tree_column(root, x) for w, root in trees[1:]),
                     F.lit(float(trees[0][0])) * tree_column(trees[0][1], x))
        return 1 / (1 + F.exp(-2 * margin))

    return score


def thresholds(found: DataFrame, score, config: Boosting, into: str) -> list[float]:
    """Per generator the lowest score bin whose held-out examples reach the precision."""
    counted = (examples(found, into, True)
               .groupBy("generator", F.floor(score(F.col("x")) * SCORE_BINS).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("personal").cast("long")).alias("hits")))
    out = [2.0] * len(GENERATORS)
    seen: dict[int, list[int]] = {}
    for r in counted.orderBy(F.desc("bin")).collect():  # at most generators x bins rows
        n, hits = seen.setdefault(r["generator"], [0, 0])
        seen[r["generator"]] = n, hits = [n + r["n"], hits + r["hits"]]
        if n >= config.least and hits >= config.precision * n:
            out[r["generator"]] = r["bin"] / SCORE_BINS
    return out


def personal_spans(docs: DataFrame, config: Boosting = Boosting(), text: str = "text",
                   into: str = "pii", keep_text: bool = True) -> DataFrame:
    """``docs`` with the struct ``into``: ``base`` and ``all`` spans by kind, then place."""
    found = scanned(docs, config, text, into)
    found = table(found if keep_text else found.drop(text), "pii")
    base, proposed = F.col(into)["base"], F.col(into)["candidates"]
    score = trained(found, config, into)
    extra = F.filter(proposed, lambda c: F.lit(False))
    if score:
        cuts = F.array(*map(F.lit, thresholds(found, score, config, into)))
        extra = F.filter(proposed, lambda c: c["open"] & ~c["personal"]
                         & (score(c["x"]) >= F.get(cuts, c["generator"])))
    names = F.array(*map(F.lit, GENERATORS))
    added = F.transform(extra, lambda c: F.struct(
        c["start"].alias("start"), (c["generator"] + len(BASE_KINDS)).alias("rank"),
        c["end"].alias("end"), F.get(names, c["generator"]).alias("kind")))
    return found.withColumn(into, F.struct(base.alias("base"),
                                           by_kind(F.concat(base, added)).alias("all")))


def redact(found: DataFrame, text: str = "text", into: str = "pii", mark: str = "[personal]") -> DataFrame:
    """The texts with every found span replaced; texts without a span stay as they are."""
    return found.withColumn(text, F.when(F.size(F.col(into)["all"]) > 0, redacted(
        whole_text(text), F.col(into)["all"], mark)).otherwise(F.col(text)))


def digest_columns(into: str = "pii") -> list[Column]:
    """Counts per base kind, hash of the base spans, and all spans as text."""
    base, every = F.col(into)["base"], F.col(into)["all"]

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
            listed(every).alias("spans")]
