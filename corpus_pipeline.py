"""From raw documents to packed batches, one operator after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm.common import documents, pin
from panelgrid.llm.jaccard_join import one_of_each
from panelgrid.llm.packing import pack
from panelgrid.llm.quality import keep_good, load_labels
from panelgrid.llm.secret_scan import mask_secrets
from panelgrid.llm.substring_dedup import dedup_substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others stay as they are.

    A null, empty or short text fails the base rules and goes; repeated rows are judged each; without
    labelled rows every score is 0, which is kept; an empty table stays empty; columns of any name pass.
    """
    return keep_good(docs, load_labels(spark, sf_dir))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, as it is.

    Texts of fewer than five words are alike only if equal, null counting as empty, so one null or
    empty text stays; of repeated rows one stays; ties go to the smallest id; an empty table stays empty;
    columns of any name pass.
    """
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences go, but for their first occurrence; no row goes.

    A null text stays null, a text shorter than a run stays as it is; null ids come first; rows that
    repeat id and text are treated alike; an empty table stays empty; columns of any name pass, but
    ``removed_spans``, which is dropped.
    """
    return _recounted(dedup_substrings(docs).drop("removed_spans"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, whatever layer hides them; no row goes.

    A null text stays null, an empty one empty; repeated rows are masked alike; an empty table stays
    empty; columns of any name pass.
    """
    return _recounted(mask_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, position, padding), one row per document.

    Null and empty texts have length 0; repeated rows are packed each; a text longer than the budget is
    a batch of its own; an empty table gives no rows; other columns are not read, whatever their names.
    """
    return pack(docs)


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the changed text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join),
          ("substring_dedup", substring_dedup), ("secret_scans", secret_scans),
          ("packing", packing)]

#: MinHash bands, decoded layers and dynamic programming have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
