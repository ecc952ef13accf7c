"""Hard negatives of anchors by clustered shared lists.

Anchors are grouped by direction (spherical k-means, fitted on a bounded
sample, applied to all). All rows are dealt to blocks of bounded size and
anchors, in the order of their clusters, to rounds of bounded size; one task
meets one block with one round. There, for each cluster, the block's rows are
sorted once by an upper bound of their inner product with any member: with b
the largest angle between the cluster's centre and a member, and t the angle
between the centre and a row, ``|row| * cos(max(0, t - b))`` times the
member's length. Every member walks that shared list in chunks and stops when
the bound of what is left is below what it still needs, which is certain as
the bounds fall along the list.

Two walks: the first finds each anchor's positives (its nearest rows of the
same label), the second, which knows their scores, for each positive the
nearest rows of another label between two shares of that score. Per block and
anchor at most ``positives``, then ``positives * negatives`` rows leave a task
and are ranked over all blocks by a window, so results are exact and nothing
is capped on the way: the bounds only skip rows that cannot enter.

Components become ``floor(scale * x)`` and scores are whole numbers: sums are
done in doubles where these are exact for them, else in Python's own numbers,
saturating at the range of a long.

Edge cases: rows with a null label, a null vector, or a null or non-finite
component take no part; vectors of different lengths are filled up with zeros;
ties go to the smaller id, then the earlier row, a null id last; rows that
repeat an id are rows of their own, so an anchor's twin may be its positive,
and each of the twins has its own result. A score of zero or below has
negatives only if the window is not empty (at zero: zero itself). No anchors or
no rows give an empty result. Other columns, whatever their names, are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.scratch import table


@dataclass(frozen=True)
class Mining:
    """Windows are ``low`` to ``high`` percent of a positive's score, both included.

    ``block_rows`` and ``round_anchors`` bound what a task holds (expected
    numbers); on a large table raise both, as every row is sent once a round
    and every anchor once a block. ``sample``: anchors the centres are fitted on.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    clusters: int = 32
    sample: int = 4096
    block_rows: int = 8192
    round_anchors: int = 8192
    chunk: int = 1024


#: Scores end here on either side.
MOST = np.iinfo(np.int64).max
CENTRE_STEPS = 8


def prepared(rows: DataFrame, anchors: Column, config: Mining, key: str, vector: str,
             label: str) -> DataFrame:
    """Rows that take part: id, label, whole-number vector, own row number, whether an anchor."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (rows.filter(F.col(f"`{label}`").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                    F.transform(x, lambda v: F.floor(v * config.scale)).alias("q"),
                    F.coalesce(anchors, F.lit(False)).alias("anchor"),
                    F.monotonically_increasing_id().alias("row")))


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A column of lists as a matrix of doubles or, beyond their whole numbers, of Python's."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    values, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths())
    width = max(width, int(cuts.max(initial=0)))
    exact = not values.size or max(abs(float(values.min())), abs(float(values.max()))) < 2 ** 53
    out = np.zeros((len(lists), width), np.float64 if exact else object)
    out[np.repeat(np.arange(len(lists)), cuts),
        np.arange(values.size) - np.repeat(np.cumsum(cuts) - cuts, cuts)] = (
            values if exact else values.astype(object))
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the rows, exact, saturating at a long."""
    largest = [float(np.abs(side).max(initial=0)) for side in (left, right)]
    if left.dtype != object and right.dtype != object and largest[0] * largest[1] * left.shape[1] < 2 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = [np.frompyfunc(int, 1, 1)(side).astype(object) for side in (left, right)]
    found = whole[0] @ whole[1].T if left.shape[1] else np.zeros((len(left), len(right)), object)
    return np.clip(found, -MOST, MOST).astype(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, sizes, out=np.zeros_like(vectors), where=sizes > 0)


def centres(vectors: np.ndarray, count: int) -> np.ndarray:
    """Directions of spherical k-means, from evenly spaced rows on."""
    points = unit(vectors)
    found = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)]
    for _ in range(CENTRE_STEPS):
        nearest = (points @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found = np.where(np.any(sums != 0, axis=1, keepdims=True), unit(sums), found)
    return found


def shared_list(block: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the block's rows by falling bound for any member, and the bounds in that order."""
    centre = unit(unit(members).sum(axis=0, keepdims=True))[0]
    sizes = np.linalg.norm(block.astype(np.float64), axis=1)
    angle = np.arccos(np.clip(unit(block) @ centre, -1, 1))
    widest = np.arccos(np.clip(unit(members) @ centre, -1, 1)).max(initial=0)
    bound = sizes * np.cos(np.maximum(0, angle - widest))
    bound += 1e-9 * sizes.max(initial=0)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def first(scores: np.ndarray, ranks: np.ndarray, where: np.ndarray, count: int,
          held: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ``count`` best of ``held`` and of the rows at ``where``, as (-score, rank)."""
    if len(where) > count:
        least = -np.partition(-scores[where], count - 1)[count - 1]
        where = where[scores[where] >= least]
    return sorted(held + list(zip((-scores[where]).tolist(), ranks[where].tolist())))[:count]


class Block:
    """One block of rows, ranked by (id, row), with the walks along its shared lists."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        ids = rows.column("id").to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0)
        null = np.asarray(rows.column("id").is_null())
        order = np.lexsort((rows.column("row").to_numpy(), np.where(null, 0, ids), null))
        self.rows = rows.take(order)
        self.row = self.rows.column("row").to_numpy()
        self.label = np.array(self.rows.column("label").to_pylist(), dtype=object)
        self.q = matrix(self.rows.column("q"), width)

    def walk(self, members: np.ndarray, order: np.ndarray, bounds: np.ndarray, chunk: int,
             needs: np.ndarray, meet: Callable[[int, np.ndarray, np.ndarray], float]) -> None:
        """Walk the list with every member until what is left is below its need.

        ``meet(member, rows, scores)`` takes a chunk and gives the member's new need.
        """
        lengths = np.linalg.norm(members.astype(np.float64), axis=1)
        for at in range(0, len(order), chunk):
            # Half a score and a share of the length cover the rounding of the bound.
            active = np.flatnonzero(lengths * bounds[at] * (1 + 1e-9) + 0.5 >= needs)
            if not len(active):
                return
            some = order[at:at + chunk]
            for i, scores in zip(active, products(members[active], self.q[some])):
                needs[i] = meet(i, some, scores)


def cell(walks: Callable[[Block, pa.Table, np.ndarray, Mining], pa.Table], config: Mining):
    """A function over one round of anchors and one block of rows."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = max([0, *(max(side.column("q").combine_chunks().value_lengths().to_pylist(), default=0)
                          for side in (anchors, rows))])
        return walks(Block(rows, width), anchors, matrix(anchors.column("q"), width), config)

    return meet


def clusters_of(anchors: pa.Table) -> Iterator[np.ndarray]:
    cluster = anchors.column("cluster").to_numpy()
    for c in np.unique(cluster):
        yield np.flatnonzero(cluster == c)


POSITIVES = "anchor_row long, id long, row long, score long"
NEGATIVES = ("anchor_row long, anchor_id long, place int, positive_id long, positive_score long,"
             " negative_id long, row long, score long")


def near_rows(block: Block, anchors: pa.Table, q: np.ndarray, config: Mining) -> pa.Table:
    """Per anchor its nearest rows of the same label in the block."""
    own, label = anchors.column("row").to_numpy(), np.array(anchors.column("label").to_pylist(), dtype=object)
    who, what, score = [], [], []
    for cluster in clusters_of(anchors):
        order, bounds = shared_list(block.q, q[cluster])
        for name in set(label[cluster]):
            members = cluster[label[cluster] == name]
            mine = np.flatnonzero(block.label[order] == name)
            best: list[list[tuple[int, int]]] = [[] for _ in members]

            def meet(i: int, rows: np.ndarray, scores: np.ndarray) -> float:
                best[i] = first(scores, rows, np.flatnonzero(block.row[rows] != own[members[i]]),
                                config.positives, best[i])
                return -best[i][-1][0] if len(best[i]) == config.positives else -np.inf

            block.walk(q[members], order[mine], bounds[mine], config.chunk,
                       np.full(len(members), -np.inf), meet)
            for i, found in zip(members, best):
                who += [own[i]] * len(found)
                what += [rank for _, rank in found]
                score += [-s for s, _ in found]
    there = block.rows.take(pa.array(what, pa.int64()))
    return pa.table({"anchor_row": pa.array(who, pa.int64()), "id": there.column("id"),
                     "row": there.column("row"), "score": pa.array(score, pa.int64())})


def window(score: int, config: Mining) -> tuple[int, int]:
    """Lowest and highest whole score within the two shares of a positive's score."""
    return -(-config.low * score // 100), config.high * score // 100


def between(block: Block, anchors: pa.Table, q: np.ndarray, config: Mining) -> pa.Table:
    """Per anchor and positive the nearest rows of other labels in the positive's window."""
    label = np.array(anchors.column("label").to_pylist(), dtype=object)
    positives = [[(p["score"], *window(p["score"], config)) for p in found]
                 for found in anchors.column("positives").to_pylist()]
    who, place, what, score = [], [], [], []
    for cluster in clusters_of(anchors):
        order, bounds = shared_list(block.q, q[cluster])
        best = [[[] for _ in positives[i]] for i in cluster]

        def need(i: int) -> float:
            """The lowest score that some positive could still take."""
            return min((max(low, -found[-1][0]) if len(found) == config.negatives else low
                        for found, (_, low, high) in zip(best[i], positives[cluster[i]]) if low <= high),
                       default=np.inf)

        def meet(i: int, rows: np.ndarray, scores: np.ndarray) -> float:
            windows = positives[cluster[i]]
            fit = np.flatnonzero((scores >= need(i)) & (scores <= max(high for _, _, high in windows))
                                 & (block.label[rows] != label[cluster[i]]))
            if len(fit):
                for j, (_, low, high) in enumerate(windows):
                    inside = fit[(scores[fit] >= low) & (scores[fit] <= high)]
                    if len(inside):
                        best[i][j] = first(scores, rows, inside, config.negatives, best[i][j])
            return need(i)

        block.walk(q[cluster], order, bounds, config.chunk,
                   np.array([need(i) for i in range(len(cluster))], np.float64), meet)
        for i, by_place in zip(cluster, best):
            for j, found in enumerate(by_place):
                who += [i] * len(found)
                place += [j] * len(found)
                what += [rank for _, rank in found]
                score += [-s for s, _ in found]
    there, anchor = (rows.take(pa.array(at, pa.int64())) for rows, at in ((block.rows, what), (anchors, who)))
    listed = anchors.column("positives").to_pylist()
    chosen = [listed[i][j] for i, j in zip(who, place)]
    return pa.table({
        "anchor_row": anchor.column("row"), "anchor_id": anchor.column("id"),
        "place": pa.array(place, pa.int32()),
        "positive_id": pa.array([p["id"] for p in chosen], pa.int64()),
        "positive_score": pa.array([p["score"] for p in chosen], pa.int64()),
        "negative_id": there.column("id"), "row": there.column("row"), "score": pa.array(score, pa.int64())})


def with_clusters(anchors: DataFrame, config: Mining) -> DataFrame:
    """Anchors with ``cluster``, and ``round``: runs of clusters of about ``round_anchors``."""
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(config.sample).select("q").toArrow()
    middle = centres(matrix(sample.column("q")), config.clusters) if sample.num_rows else np.zeros((0, 0))

    @F.pandas_udf("int")
    def nearest(vectors):
        points = unit(matrix(pa.chunked_array([pa.array(vectors, pa.list_(pa.int64()))]), middle.shape[1]))
        return pd.Series((points[:, :middle.shape[1]] @ middle.T).argmax(axis=1))

    dealt = table(anchors.withColumn("cluster", nearest("q")), "anchors")
    sizes = sorted((r["cluster"], r["n"]) for r in dealt.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n")).collect())  # at most `clusters` rows
    number, before = F.lit(0), 0
    for c, n in sizes:
        spread = F.floor((F.lit(before) + F.pmod(F.xxhash64("row"), F.lit(n))) / config.round_anchors)
        number = F.when(F.col("cluster") == c, spread).otherwise(number)
        before += n
    return dealt.withColumn("round", number.cast("int"))


def met(anchors: DataFrame, rows: DataFrame, blocks: int, rounds: int, walks, schema: str,
        config: Mining) -> DataFrame:
    """Every round of anchors with every block of rows."""
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (rows.select("id", "label", "q", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
             .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))))
    return left.groupBy("block", "round").cogroup(right.groupBy("block", "round")).applyInArrow(
        cell(walks, config), schema)


def mined(rows: DataFrame, anchors: Column, config: Mining = Mining(), key: str = "vec_id",
          vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and positive the first negatives of its window, by falling score.

    ``anchors`` is a condition over ``rows``. Columns: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.
    """
    rows = table(prepared(rows, anchors, config, key, vector, label), "vectors")
    mine = with_clusters(rows.filter("anchor").select("id", "label", "q", "row"), config)
    blocks = max(1, -(-rows.count() // config.block_rows))
    rounds = 1 + (mine.agg(F.max("round")).first()[0] or 0)

    near = met(mine, rows, blocks, rounds, near_rows, POSITIVES, config)
    order = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))
    positives = (near.withColumn("place", place).filter(F.col("place") <= config.positives)
                 .groupBy("anchor_row").agg(F.sort_array(F.collect_list(
                     F.struct("place", "id", "score"))).alias("positives")))  # `positives` entries at most
    known = table(mine.join(positives, mine["row"] == positives["anchor_row"]).drop("anchor_row"), "positives")

    found = met(known, rows, blocks, rounds, between, NEGATIVES, config)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(
        F.desc("score"), F.asc_nulls_last("negative_id"), "row"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= config.negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    F.col("score").alias("negative_score")))
