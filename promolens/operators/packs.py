"""Discount packs chosen by the rule engine, unpacked from its JSON run log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions import pack_mode, pack_part
from promolens.operators.cdc import latest_per_key
from promolens.operators.experiments import with_variant
from promolens.schemas import BURN_FIELDS, CONTEXT
from promolens.sources.sinks import LOOKUP, date_file
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary

# A pack row is identified by these; the newest run wins.
PACK_KEYS = ("campaign_id", "run_date", "store_id", "segment", "store_seg", "pack_id", "slot",
             "emit_segment")


def parsed_runs(state: DataFrame) -> DataFrame:
    """Runs with their documents as VARIANT, to be stored and read instead of the log's text.

    A document is then parsed once, when it is stored, whatever reads it
    later. Malformed documents become NULL and yield no rows, as before.
    """
    return state.withColumn("campaign_context", F.try_parse_json("campaign_context"))


def _document(state: DataFrame) -> Column:
    """The document as a struct, from its text or from the stored VARIANT."""
    if isinstance(state.schema["campaign_context"].dataType, T.VariantType):
        return F.try_variant_get("campaign_context", "$", CONTEXT.simpleString())
    return F.from_json("campaign_context", CONTEXT)


_RUN = ["campaign_id", "run_date", "run_ts", "prev_burn_state", "event_id"]


def explode_stores(state: DataFrame, from_date: date | None = None) -> DataFrame:
    """One row per run and store of the JSON documents, with the store's pack selections."""
    kept = state.where(F.col("campaign_context").isNotNull())
    if from_date is not None:
        kept = kept.where(F.col("run_date") >= F.lit(from_date))
    # Each step keeps only what later steps read, or an exploded row would
    # carry its whole document. The outer explode yields a NULL store for a
    # document without stores, which ``explode_picks`` drops; a plain one
    # would have Spark parse each document again to test it for stores.
    documents = kept.select(*_RUN, _document(kept).alias("ctx"))
    stores = (documents.select(*_RUN, F.col("ctx.burn").alias("burn"),
                               F.col("ctx.stores").alias("stores"))
              .select(*_RUN, "burn", F.explode_outer("stores").alias("store")))
    return stores.select(*_RUN, "burn", "store.store_id", "store.pack_selections")


def explode_picks(stores: DataFrame, *others: str) -> DataFrame:
    """One row per pack selection of ``explode_stores``, with the columns ``others``."""
    picks = stores.select(*_RUN, "burn", "store_id", *others, F.explode("pack_selections").alias("pick"))
    return picks.select(*_RUN, "store_id", *others, "pick.pack_id", "pick.segment", "pick.store_seg",
                        "pick.slot", "pick.emit_segment",
                        *[F.col(f"burn.{name}").alias(name) for name in BURN_FIELDS])


def explode_context(state: DataFrame, from_date: date | None = None) -> DataFrame:
    """One row per run, store and pack selection of the JSON documents.

    Missing documents are dropped; malformed ones, and ones without stores or
    selections, yield no rows.
    """
    return explode_picks(explode_stores(state, from_date))


def stores_with_picks(state: DataFrame, from_date: date | None = None) -> DataFrame:
    """``explode_stores`` without the rows that yield no selection, to be dealt before they unfold."""
    return explode_stores(state, from_date).where(F.size("pack_selections") > 0)


def _tasks(state: DataFrame) -> int:
    """A number of tasks that Spark keeps: what unfolds after a shuffle is several times what the
    shuffle moved, so that size must not decide how many tasks are merged into one."""
    return int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack_mapping(state: DataFrame, from_date: date | None = None,
                 variants: DataFrame | None = None, files_per_date: int | None = None,
                 buckets: int | None = None) -> DataFrame:
    """Newest run per pack row, with the campaign-day's variant (else NULL).

    ``variants`` holds one row per (campaign_id, run_date), as made by
    ``latest_variant``; it is joined after the ranking, so the JSON documents
    never travel for it.

    Rows are dealt once, and ranked where they then lie. By default a store's
    selections travel together and unfold afterwards. ``files_per_date`` deals
    rows the way ``write_pack_mapping`` does, ``buckets`` the way
    ``write_bucketed_mapping`` does, which then need not be repeated
    (``dealt=True`` there); both are for mappings without variants.
    """
    if variants is not None and (files_per_date or buckets):
        raise ValueError("the join with variants does not keep a layout")
    if buckets:
        picks = explode_context(state, from_date).repartition(buckets, *LOOKUP)
    else:
        stores = stores_with_picks(state, from_date)
        if files_per_date:
            dealt = stores.withColumn("_file", date_file(files_per_date)).repartition(
                _tasks(state), "run_date", "_file")
            picks = explode_picks(dealt, "_file")
        else:
            picks = explode_picks(stores.repartition(_tasks(state), "campaign_id", "run_date", "store_id"))
    # A number of all keys sorts first, so that few rows are compared text by text.
    keys = ["_keys", *PACK_KEYS, *(["_file"] if files_per_date else [])]
    newest = latest_per_key(picks.withColumn("_keys", F.xxhash64(*PACK_KEYS)), keys, ["run_ts", "event_id"])
    if variants is None:
        newest = newest.withColumn("variant", F.lit(None).cast("string"))
    else:
        newest = with_variant(newest, variants)
    return newest.select("campaign_id", "run_date", "run_ts", "prev_burn_state", "variant",
                         "store_id", "pack_id", "segment", "store_seg", "slot", "emit_segment",
                         *BURN_FIELDS)


def pack_identities(state: DataFrame, from_date: date | None = None,
                    variants: DataFrame | None = None,
                    keys: Sequence[str] = PACK_KEYS) -> DataFrame:
    """Distinct ``keys`` of the pack rows, with the campaign-day's variant if asked for.

    Ranking keeps one row per ``PACK_KEYS``, so whoever reads nothing but
    those gets the same rows as from ``pack_mapping`` without ranking: nothing
    sorts. Keys without the campaign fold before the shuffle. With it few rows
    are alike, so a store's selections travel together and unfold afterwards,
    dealt by date and store, which later sums per date and store reuse.
    """
    if {"campaign_id", "run_date", "store_id"} <= set(keys):
        picks = explode_picks(stores_with_picks(state, from_date).repartition(
            _tasks(state), "run_date", "store_id"))
    else:
        picks = explode_context(state, from_date)
    found = picks.select(*keys).distinct()
    if variants is None:
        return found
    return with_variant(found, variants)


def pack_choices(mapping: DataFrame, start: date, end: date, keys: Sequence[str],
                 vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Distinct (keys, tier, mode) of the packs in a date window."""
    return (mapping.where(F.col("run_date").between(F.lit(start), F.lit(end)))
            .select(*keys, pack_part(F.col("pack_id"), 0).alias("tier"),
                    pack_mode(F.col("pack_id"), vocab).alias("mode"))
            .distinct())
