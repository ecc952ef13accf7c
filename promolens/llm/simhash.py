"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints at no more than d differing bits, cut into d // 2 + 1
segments, have a segment in which they differ by at most one bit. Each segment
is therefore indexed once per bit place with that bit left out (a wildcard):
segments at distance one or zero share such a variant. Variants are joined for
equality and every candidate is verified on all 64 bits.

* Work is done on distinct fingerprints, so copies cost one row each.
* Small buckets are joined with themselves. The verification is part of the
  join, and a pair is accepted only in the first bucket it shares.
* In larger buckets (a big group of near copies) pairs would grow with the
  square. Members are dealt to blocks by hash; each pair of blocks meets in one
  bounded group, which returns a spanning forest of its links, at most one link
  a member. Any link of the bucket lies in some pair of blocks, so the
  connected groups are the same as with all pairs.
* Groups are found with alternating large-star and small-star steps, each
  written to the shared folder.

Edge cases: null text is empty; a text without words has fingerprint zero and
links like any other; fewer words than a shingle form one shingle; a null id
never names a group that has another id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.columns import any_names, whole_text
from promolens.llm.scratch import owned, release, table
from promolens.operators.joins import broadcast_if_small

BITS = 64


@dataclass(frozen=True)
class Near:
    shingle: int = 4
    max_bits: int = 4
    seed: int = 42
    small_bucket: int = 32
    block: int = 1024
    broadcast_rows: int = 200_000


def fingerprint_of(text: str, config: Near) -> int:
    """SimHash of one text as a signed 64-bit number."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < config.shingle:
        parts = [b" ".join(found)]
    else:
        parts = map(b" ".join, zip(*(found[k:] for k in range(config.shingle))))
    digest, seed = xxhash.xxh64_intdigest, config.seed
    hashes = np.array([digest(p, seed) for p in parts], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, config: Near = Near()) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t, config) for t in batch], dtype="int64")

    return simhash(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(start, width) of max_bits // 2 + 1 segments that cover the fingerprint."""
    if max_bits < 2:
        raise ValueError("deletion variants of segments need max_bits of 2 or more")
    n = max_bits // 2 + 1
    cuts = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fp: Column, max_bits: int) -> Column:
    """For every bit place, the place and its segment without that bit, packed in a long.

    A segment has at most 33 bits (max_bits >= 2), and the place is in the upper bits.
    """
    keys = []
    for start, width in segments(max_bits):
        part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            below = part.bitwiseAND(F.lit((1 << bit) - 1))
            above = F.shiftleft(F.shiftrightunsigned(part, bit + 1), bit)
            keys.append(above.bitwiseOR(below).bitwiseOR(F.lit((start + bit) << 40)))
    return F.array(*keys)


def first_shared(diff: Column, max_bits: int) -> Column:
    """The first bit place whose variant two fingerprints with this difference share."""
    found = F.lit(None).cast("int")
    for start, width in reversed(segments(max_bits)):
        part = F.shiftrightunsigned(diff, start).bitwiseAND(F.lit((1 << width) - 1))
        found = F.when(F.bit_count(part) <= 1, F.lit(start) + F.when(
            part == 0, 0).otherwise(F.bit_count(part - 1))).otherwise(found)
    return found


def forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what distances of at most ``max_bits`` connect, fewer than members."""
    left = np.unique(members).view(np.uint64)
    links: list[tuple[int, int]] = []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= max_bits
        if near.any():
            for other in left[near]:
                links.append((int(at.astype(np.int64)), int(other.astype(np.int64))))
            queue.extend(left[near])
            left = left[~near]
    return links


def links(fingerprints: DataFrame, config: Near = Near()) -> DataFrame:
    """(a, b) that connect distinct fingerprints exactly as all links within reach do."""
    keyed = fingerprints.select("fp", F.explode(variants(F.col("fp"), config.max_bits)).alias("key"))
    sized = keyed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))
    small = sized.filter(F.col("m").between(2, config.small_bucket)).drop("m")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "key")
             .filter((F.col("a") < F.col("b")) & (F.bit_count(diff) <= config.max_bits)
                     & (F.shiftright("key", 40) == first_shared(diff, config.max_bits)))
             .select("a", "b"))
    blocks = F.ceil(F.col("m") / config.block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (sized.filter(F.col("m") > config.small_bucket).withColumn("blocks", blocks)
             .withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("fp", "key", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j")))
    reach = config.max_bits

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        found = forest(group["fp"].to_numpy(np.int64), reach)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    large = dealt.groupBy("key", "i", "j").applyInPandas(connect, "a long, b long")
    return pairs.unionByName(large).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(fp, root): for each linked fingerprint the smallest one it is connected with."""
    with owned() as made:
        edges = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), "links")
        before = None
        while True:
            # Large star: larger neighbours of a node are linked to its smallest neighbour.
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
            large = (both.filter("v > u").join(least, F.col("u") == F.col("w"))
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
            # Small star: a node and its smaller neighbours are linked to the smallest of them.
            least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
            small = (large.join(least, F.col("u") == F.col("w"))
                     .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
                             .alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
                     .filter("u != v").distinct())
            edges = table(small, "stars")
            release(edges.sparkSession, made, unless=edges)
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
            before = state


@any_names
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    into: str = "near", keep_text: bool = True,
                    config: Near = Near()) -> DataFrame:
    """``docs`` with the struct ``into`` (fingerprint, component_id, group); every row comes back.

    ``group`` is the smallest fingerprint of the row's group, which tells groups
    apart also where rows of two groups share an id.

    Fingerprints are computed once and staged with the other columns. Groups
    of more than one row are counted and broadcast up to ``broadcast_rows``
    (32 bytes each); beyond that they are joined by shuffle.
    """
    others = [c for c in docs.columns if c != into and (keep_text or c != text)]
    rows = table(docs.select(*[f"`{c}`" for c in others],
                             fingerprint(whole_text(text), config).alias("_fp")), "simhash")
    nodes = table(rows.groupBy(F.col("_fp").alias("fp")).agg(
        F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = connected(links(nodes.select("fp"), config))
    # The smallest fingerprint of a group is no link's larger end, so it joins by its own name.
    members = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    lone = nodes.filter("n > 1").select("fp", "least").join(members, "fp", "left_anti") \
        .select("fp", F.col("least").alias("component"), F.col("fp").alias("root"))
    grouped = members.join(nodes, "fp")
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    groups = broadcast_if_small(grouped.join(named, "root").select("fp", "component", "root")
                                .unionByName(lone).toDF("_fp", "_component", "_root"),
                                config.broadcast_rows)
    found = rows.join(groups, "_fp", "left")

    def digits(value: Column) -> Column:
        return F.lower(F.lpad(F.hex(value), 16, "0"))

    return found.select(*[f"`{c}`" for c in others], F.struct(
        digits(F.col("_fp")).alias("fingerprint"),
        F.coalesce("_component", F.col(key)).alias("component_id"),
        digits(F.coalesce("_root", "_fp")).alias("group")).alias(into))
