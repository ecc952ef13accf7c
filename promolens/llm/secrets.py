"""Secrets in texts: fixed patterns, and random-looking tokens by a test battery.

Three patterns (assignments, access keys, long hexadecimal runs) always count.
Every other token of 20 or more key characters is read in the encoding its
characters suggest (hexadecimal, base32, base36 of either case, letters of both
cases, base64), or else in the widest, and put through three tests of "the
symbols are random": chi-squared uniformity over five groups of the alphabet
(vowels, common and rare consonants, capitals and digits where the encoding has
letters beyond f, which texts use very unevenly), Wald-Wolfowitz runs about the
alphabet's middle, and lag-one serial correlation. Fisher's method joins the
three p-values.

Errors of both kinds are controlled, over all documents and apart for each band
of lengths (short tokens have less power and must not share a family with long
ones) and group of encodings (plain words, which most tokens without an encoding
of their own are, must not share one with keys). A token is reported as kind
``random`` where the Benjamini-Hochberg step-up at rate ``q`` does not prove it
not random, and a second step-up at rate ``false`` rejects that it is a name.
The p-value of the second is the share of names of its group that look at least
as random. Every document gives one name in each of four styles (two cases, two
cases with a number, one case with a number, words with ``_``), of words of its
own from a place that its hash chooses; so the names grow with the table. They
are as short as the shortest band allows: longer names look less random, so that
share is safe for them, too. A group without a name has the first step-up alone.
Both work on counts per (family, p bin), a table of fixed size, and only one
threshold per family reaches the driver.

Letters of one case without a digit, digits alone, and letters of one case and
digits with a sign (``+/_-``) have no encoding of their own: most are words,
numbers, paths and names. They are tested in base64, which long ones of them
are proven not to be.

Everything is built-in expressions. Edge cases: null text is empty; no match
gives empty lists; tokens that touch a pattern's span are not reported twice;
an empty table gives an empty result; a text without words gives no name.
``into`` names the added struct and replaces a column of that name; other columns
may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.columns import let, normal_tail, whole_text, words
from promolens.llm.scratch import table
from promolens.llm.spans import by_start, listed, of_kind, overlaps, redacted, spans

# Fixed values of the base rules.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
             "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
WIDEST = "base64"
#: Encodings whose tokens share families of tests; tokens without one are the last group.
FAMILIES = (("hex", "base32", "base64"), ("base36",), ("letters",))
GROUPS = 5
VOWELS, COMMON, RARE = "aeiou", "tnsrlhdc", "bfgjkmpqvwxyz"
#: Groups of each alphabet for the test of uniformity; five, so that it has four degrees of freedom.
CELLS = {"hex": [ALPHABETS["hex"][-(-16 * g // GROUPS):-(-16 * (g + 1) // GROUPS)] for g in range(GROUPS)],
         "base32": [VOWELS.upper(), COMMON.upper(), RARE.upper(), "234", "567"],
         "base64": [VOWELS, COMMON, RARE, (VOWELS + COMMON + RARE).upper(), "0123456789+/"],
         "base36": [VOWELS, COMMON, RARE, "01234", "56789"],
         "letters": [VOWELS, COMMON, RARE, (VOWELS + COMMON).upper(), RARE.upper()]}
#: A word that names are made of, and how many words of a text are looked at for one style.
WORD, SPAN_OF_WORDS = "^[A-Za-z]{2,12}$", 48
BINS_PER_DECADE, MAX_BIN = 10, 300


@dataclass(frozen=True)
class Battery:
    """``bands``: lengths at which a new family of tests starts; ``q``: the share of random
    tokens that may be lost among those declared not random; ``false``: the share of names
    that may be among the tokens reported."""

    q: float = 0.05
    false: float = 0.05
    bands: tuple[int, ...] = (20, 28, 40, 64, 128)


def encoding(token: Column) -> Column:
    """The encoding by the characters present; null where none fits."""
    return (F.when(token.rlike("^[0-9]+$"), None)
            .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & token.rlike("[A-Fa-f]"), "hex")
            .when(token.rlike("^[A-Z2-7]+$") & token.rlike("[2-7]") & token.rlike("[A-Z]"), "base32")
            .when(token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]"), "base64")
            .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$") & token.rlike("[0-9]"), "base36")
            .when(token.rlike("^[A-Za-z]+$") & token.rlike("[A-Z]") & token.rlike("[a-z]"), "letters"))


def uniformity(plain: Column, cells: list[str]) -> Column:
    """p of the chi-squared statistic over five groups of the alphabet (4 degrees of freedom)."""
    size = sum(map(len, cells))
    n = F.length(plain)

    def part(cell: str) -> Column:
        seen = n - F.length(F.translate(plain, cell, ""))
        return F.pow(seen - n * (len(cell) / size), F.lit(2.0)) / (n * (len(cell) / size))

    return let(sum((part(c) for c in cells[1:]), part(cells[0])) / 2,
               lambda half: F.exp(-half) * (1 + half))


def runs(values: Column, size: int) -> Column:
    """Two-sided p of the number of runs above and below the alphabet's middle."""
    n = F.size(values).cast("double")
    count = 1 + F.size(F.filter(values, lambda v, i: (i > 0) & (
        (v >= size // 2) != (F.get(values, i - 1) >= size // 2))))

    def tail(both: Column) -> Column:
        mean = both / n + 1
        spread = both * (both - n) / (n * n * (n - 1.0))
        return F.when(spread > 0, let(F.abs(count - mean) / F.sqrt(spread),
                                      lambda z: 2 * normal_tail(z))).otherwise(0.0)

    return let(F.size(F.filter(values, lambda v: v >= size // 2)),
               lambda above: let(2.0 * above * (n - above), tail))


def serial(values: Column) -> Column:
    """Two-sided p of the lag-one correlation."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n

    def correlated(m: Column) -> Column:
        square = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        lag = F.aggregate(F.transform(values, lambda v, i: F.when(
            i > 0, (v - m) * (F.get(values, i - 1) - m)).otherwise(0.0)),
            F.lit(0.0), lambda a, v: a + v)
        return let(square, lambda all_squares: F.when(all_squares > 0, let(
            F.abs(lag / all_squares) * F.sqrt(n), lambda z: 2 * normal_tail(z))))

    return F.coalesce(let(mean, correlated), F.lit(0.0))


def randomness(token: Column, kind: Column) -> Column:
    """Fisher's combined p of the three tests, in the widest alphabet without an encoding."""
    def fisher(tests: list[Column]) -> Column:
        logs = [F.log(F.least(F.greatest(p, F.lit(1e-40)), F.lit(1.0))) for p in tests]
        return let(-(logs[0] + logs[1] + logs[2]),
                   lambda half: F.exp(-half) * (1 + half + half * half / 2))

    def of(name: str) -> Column:
        alphabet = ALPHABETS[name]
        plain = F.lower(token) if name in ("hex", "base36") else F.translate(token, "-_", "+/")
        values = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        return let(values, lambda v: fisher([uniformity(plain, CELLS[name]), runs(v, len(alphabet)),
                                             serial(v)]))

    found = of(WIDEST)
    for name in ALPHABETS:
        if name != WIDEST:
            found = F.when(kind == name, of(name)).otherwise(found)
    return found


def family(token: Column, kind: Column, config: Battery) -> Column:
    """The number of the token's family of tests: its band of lengths within its group of encodings."""
    group = F.lit(len(FAMILIES))
    for i, names in enumerate(FAMILIES):
        group = F.when(kind.isin(*names), i).otherwise(group)
    return group * len(config.bands) + sum(
        (F.when(F.length(token) >= b, 1).otherwise(0) for b in config.bands[1:]), F.lit(0))


def names(text: Column, config: Battery) -> Column:
    """One name of each style, joined from the text's own words; none where it has no words."""
    def near(all_words: Column, chosen: Column) -> Column:
        # Words from the chosen place on; a text that ends before goes on from its start.
        at = F.pmod(chosen, F.size(all_words)).cast("int") + 1
        found = F.concat(F.slice(all_words, at, SPAN_OF_WORDS), F.slice(all_words, 1, SPAN_OF_WORDS))
        return F.filter(found, lambda w: w.rlike(WORD))

    def joined(few: Column, chosen: Column) -> Column:
        number = F.lpad(F.pmod(chosen, F.lit(9973)).cast("string"), 4, "2")
        # The words are repeated as far as needed; the fewest that reach the length are joined.
        least = config.bands[0]
        many = F.flatten(F.array_repeat(F.slice(few, 1, least), F.ceil(
            F.lit(least / 2) / F.greatest(F.size(few), F.lit(1))).cast("int")))
        reach = F.aggregate(many, F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")),
                            lambda acc, w: F.when(acc["chars"] >= least, acc).otherwise(F.struct(
                                (acc["n"] + 1).alias("n"),
                                (acc["chars"] + F.length(w)).alias("chars"))), lambda acc: acc["n"])

        def styles(part: Column) -> Column:
            camel = F.array_join(F.transform(part, lambda w, i: F.when(
                i == 0, F.lower(w)).otherwise(F.initcap(w))), "")
            lower = F.lower(F.array_join(part, ""))
            return F.array(camel, F.concat(camel, number), F.concat(lower, number),
                           F.lower(F.array_join(part, "_")))

        return let(F.slice(many, 1, reach), styles)

    none = F.array().cast("array<string>")
    # The hash of a whole text is taken once, not for every word.
    return let(F.struct(words(text).alias("words"), F.xxhash64(text).alias("chosen")),
               lambda t: F.when(F.size(t["words"]) == 0, none).otherwise(
                   let(near(t["words"], t["chosen"]), lambda few: F.when(F.size(few) == 0, none)
                       .otherwise(joined(few, t["chosen"])))))


def scanned(docs: DataFrame, config: Battery = Battery(), text: str = "text",
            into: str = "secrets") -> DataFrame:
    """Base spans, tested tokens and tested names of every text: the struct (base, tokens, names)."""
    whole = whole_text(text)
    base = F.concat(
        of_kind(spans(whole, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
                0, "assign"),
        of_kind(spans(whole, ACCESS, lambda m: F.length(m) >= 20), 1, "access"),
        of_kind(spans(whole, HEX), 2, "hex"))

    def tested(found: Column) -> Column:
        tokens = F.filter(spans(whole, TOKEN), lambda s: ~overlaps(s, found))
        return F.transform(tokens, lambda s: let(encoding(s["found"]), lambda kind: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            randomness(s["found"], kind).alias("p"), family(s["found"], kind, config).alias("band"))))

    made = F.transform(names(whole, config), lambda t: let(encoding(t), lambda kind: F.struct(
        randomness(t, kind).alias("p"), family(t, kind, config).alias("band"))))
    return docs.withColumn(into, let(by_start(base), lambda b: F.struct(
        b.alias("base"), tested(b).alias("tokens"), made.alias("names"))))


def thresholds(found: DataFrame, config: Battery = Battery(), into: str = "secrets") -> list[float]:
    """Per family the p that a token must exceed to be reported: the larger one of the largest p
    that proves a token not random, and the largest p at which it may still be a name. At most
    one row a family is collected."""
    def tested(field: str, role: int) -> DataFrame:
        return (found.select(F.explode(F.col(into)[field]).alias("t")).select(
            "t.band", F.lit(role).alias("name"),
            F.least(F.floor(-F.log10(F.greatest(F.col("t.p"), F.lit(1e-300))) * BINS_PER_DECADE),
                    F.lit(MAX_BIN)).alias("bin")))

    bands = len(config.bands)
    binned = (tested("tokens", 0).unionByName(tested("names", 1)).groupBy("band", "bin")
              .agg(F.sum(1 - F.col("name")).alias("count"), F.sum("name").alias("names")))
    # Names count in every band of their group.
    group = F.floor(F.col("band") / bands).cast("int") * bands
    shared = binned.filter("names > 0").select(
        F.explode(F.sequence(group, group + (bands - 1))).alias("band"), "bin",
        F.lit(0).cast("long").alias("count"), "names")
    own = binned.filter("count > 0").select(
        F.col("band").cast("int").alias("band"), "bin", "count", F.lit(0).cast("long").alias("names"))
    binned = own.unionByName(shared).groupBy("band", "bin").agg(
        F.sum("count").alias("count"), F.sum("names").alias("names"))
    band = Window.partitionBy("band")
    likely, unlikely = band.orderBy("bin"), band.orderBy(F.desc("bin"))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    ranked = (binned.withColumns({"m": F.sum("count").over(band), "all": F.sum("names").over(band),
                                  "rank": F.sum("count").over(unlikely)})
              .withColumns({"above": F.sum("count").over(likely),
                            "tail": (F.sum("names").over(likely) + 1) / (F.col("all") + 1)}))
    proven = (F.col("count") > 0) & (edge * F.col("m") <= config.q * F.col("rank"))
    no_name = (F.col("above") > 0) & (F.col("tail") * F.col("m") <= config.false * F.col("above"))
    below = F.pow(F.lit(10.0), -(F.col("bin") + 1) / BINS_PER_DECADE)
    cut = ranked.groupBy("band").agg(
        F.max(F.when(proven, edge)).alias("random"),
        F.when(F.max("all") > 0, F.coalesce(F.min(F.when(no_name, below)), F.lit(1.0))).alias("named"))
    by_band = {r["band"]: max(r["random"] or 0.0, r["named"] or 0.0) for r in cut.collect()}
    return [by_band.get(b, 0.0) for b in range(bands * (len(FAMILIES) + 1))]


def secret_spans(docs: DataFrame, config: Battery = Battery(), text: str = "text",
                 into: str = "secrets", keep_text: bool = True) -> DataFrame:
    """``docs`` with the struct ``into``: ``base`` and ``all`` spans by start, then kind.

    One pass over the texts, staged; the decisions then touch the staged rows only.
    """
    found = scanned(docs, config, text, into)
    if not keep_text:
        found = found.drop(text)
    found = table(found, "secrets")
    cuts = F.array(*[F.lit(float(p)) for p in thresholds(found, config, into)])
    random = F.filter(F.col(into)["tokens"], lambda t: t["p"] > F.get(cuts, t["band"]))
    extra = of_kind(random, len(BASE_KINDS), "random")
    base = F.col(into)["base"]
    return found.withColumn(into, F.struct(base.alias("base"),
                                           by_start(F.concat(base, extra)).alias("all")))


def redact(found: DataFrame, text: str = "text", into: str = "secrets",
           mark: str = "[secret]") -> DataFrame:
    """The texts with every found span replaced; texts without a span stay as they are."""
    return found.withColumn(text, F.when(F.size(F.col(into)["all"]) > 0, redacted(
        whole_text(text), F.col(into)["all"], mark)).otherwise(F.col(text)))


def digest_columns(into: str = "secrets") -> list[Column]:
    """Counts per base kind, hash of the base spans, and all spans as text."""
    base, every = F.col(into)["base"], F.col(into)["all"]

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans")]
