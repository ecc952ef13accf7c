"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read back as the next stage's documents. All but the last return
the columns of the documents. The order in ``STAGES`` is fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.llm import exact_dedup, packing, quality_rules, secrets, simhash
from promolens.llm.scratch import owned, release, table

OWN = "_stage"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the stage that this thread ran last.
_last: ContextVar[list[str] | None] = ContextVar("last", default=None)


def cleaning(stage: Stage) -> Stage:
    """``stage``, which begins by removing what the stage before it staged: that one's result is
    written by then. Folders of operators that others called, or of other threads, stay."""
    @wraps(stage)
    def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _last.get() or [], unless=docs)
        with owned() as made:
            result = stage(spark, docs, sf_dir)
        _last.set(made)
        return result

    return cleaned


@cleaning
def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; cutoffs are certified on the labels."""
    stats = table(quality_rules.rule_statistics(docs, into=OWN), "rules")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    cutoffs = quality_rules.certified_cutoffs(stats, labels, into=OWN)
    return quality_rules.apply_cutoffs(stats, cutoffs, into=OWN).filter(F.col(OWN)["kept"]).drop(OWN)


@cleaning
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.exact_duplicates(docs, into=OWN).filter(F.col(OWN)["kept"]).drop(OWN)


@cleaning
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    found = simhash.near_duplicates(docs, into=OWN)
    # Only rows with the smallest id of their group may stay; several can share that id.
    named = found.filter(F.col("doc_id").eqNullSafe(F.col(OWN)["component_id"]))
    first = Window.partitionBy(F.col(OWN)["group"]).orderBy(F.col(OWN)["fingerprint"], "text")
    return named.withColumn(OWN, F.row_number().over(first)).filter(F.col(OWN) == 1).drop(OWN)


@cleaning
def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and ``n_chars`` counted anew."""
    redacted = secrets.redact(secrets.secret_spans(docs, into=OWN), into=OWN)
    changed = F.size(F.col(OWN)["all"]) > 0
    chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", chars).select(*[f"`{c}`" for c in docs.columns])


@cleaning
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and places in the sequences."""
    packed = packing.packed(docs.select("doc_id", "text"))
    return packed.select("doc_id", *packing.digest_columns(), F.col("piece.ids").alias("ids"))


STAGES = [("quality rules", keep_by_rules), ("exact dedup", drop_exact_copies),
          ("SimHash near-dedup", drop_near_copies), ("secret scans", remove_secrets),
          ("best-fit packing", pack)]

#: Fingerprints, tokenisers and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with owned() as made:
            docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
