"""Documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) on the rows its predecessor kept, and maps
them to the interface of one operator: a document is a caption of a media item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediacat.llm import (
    caption_links, caption_toxicity, heldout_leaks, packing, queries, registry, surrogates,
)

TOXIC_FROM = 0.7


def _items(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "media_item_id", "text": "google_description"})


def _documents(items: DataFrame, docs: DataFrame) -> DataFrame:
    return items.withColumnsRenamed({"media_item_id": "doc_id", "google_description": "text"}).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM``, with the labels of the registered query."""
    flags = registry.table(spark, sf_dir, "labels").filter(queries.fold("doc_id", 3) != 1)
    flags = flags.select(F.col("doc_id").alias("media_item_id"), "toxic")
    scored = caption_toxicity.add_toxicity(_items(docs), flags)
    return _documents(scored.filter(F.col("toxicity") < TOXIC_FROM), docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a table with a number of its own for each row, for ids may be missing or repeated.

    The numbers are drawn once, when the table is written.
    """
    return registry.written(docs.withColumn("row_key", F.monotonically_increasing_id()))


def _by_key(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("row_key").alias("media_item_id"), F.col("text").alias("google_description"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id, of repeated rows one.

    NULL ids come last, texts decide between rows of one id. Rows under one id with texts
    that are not linked all stay.
    """
    numbered = _numbered(docs.dropDuplicates(["doc_id", "text"]))
    linked = caption_links.caption_links(_by_key(numbered), shingle_words=5, numerator=8, denominator=10)
    grouped = registry.written(linked.select(F.col("media_item_id").alias("row_key"), "component_id"))
    named = grouped.join(numbered.select("row_key", "doc_id", F.xxhash64("text").alias("tie")), "row_key")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "row_key")
    first = named.groupBy("component_id").agg(F.min_by("row_key", order).alias("row_key")).select("row_key")
    return numbered.join(first, "row_key", "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; a row goes for its own text, whatever its id."""
    benchmark = registry.table(spark, sf_dir, "benchmark").select("item_id", "text")
    numbered = _numbered(docs)
    leaks = heldout_leaks.find_leaks(_by_key(numbered), benchmark).select(F.col("media_item_id").alias("row_key"))
    return numbered.join(leaks.distinct(), "row_key", "left_anti").select(docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates in their texts; n_chars counts the new ones."""
    replaced = surrogates.replace_entities(_items(docs), queries.SURROGATE_KEY)
    if "n_chars" in docs.columns:
        new = F.length("google_description").cast(docs.schema["n_chars"].dataType)
        replaced = replaced.withColumn("n_chars", F.when(F.col("n_entities") > 0, new).otherwise(F.col("n_chars")))
    return _documents(replaced, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("private data", hide_private),
    ("packing", pack),
]

#: The stages learn, hash and tokenise; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder."""
    docs = registry.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = registry.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
