"""A training corpus from raw documents: five stages of the corpus operators, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
``documents``; the last returns their token ids. The forest, the field and the encoder can't be stated in SQL, so ``ORACLE_SQL`` is
None and the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.code_switch import identify_languages
from hazeline.llm.common import read_table, written
from hazeline.llm.decontaminate import contamination
from hazeline.llm.jaccard_join import jaccard_components
from hazeline.llm.secret_forest import scan
from hazeline.llm.sentencepieces import encode_pieces

ORACLE_SQL = None
#: A document whose best language has a smaller share of its letters is rejected; an even mix of two languages stays.
LEAST_LANGUAGE_SHARE = 0.35
CONTAMINATED_WORDS = 10


def with_row(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, ``doc_id`` if it is unique; the operators carry a key through under that name."""
    return docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))


def only_with(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key ``verdicts`` (column ``__row``) holds; rows that are the same in every column share a key."""
    return with_row(docs).join(verdicts.select("__row").distinct(), "__row", "left_semi").drop("__row")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as the operators read them, with the row's key for a doc_id."""
    rows = with_row(docs)
    lang = [F.col("lang")] if "lang" in docs.columns else []
    return rows.select(F.col("__row").alias("doc_id"), "text", *lang)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the field knows; ``lang`` is set where it was missing."""
    found = identify_languages(keyed(docs)).where(f"lang_pred <> 'und' AND score >= {LEAST_LANGUAGE_SHARE}")
    found = found.select(F.col("doc_id").alias("__row"), F.col("lang_pred").alias("__lang")).distinct()
    rows = with_row(docs).join(found, "__row")
    return rows.select(*[F.coalesce(F.col("lang").cast("string"), "__lang").alias("lang") if c == "lang" else F.col(f"`{c}`")
                         for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id from each component of near duplicates; documents without words stay.

    Rows are told apart by doc_id and content: rows that share a doc_id but not their text are documents of their own. Within a
    component a missing doc_id counts as behind all others, then the content decides; rows equal in every column are one.
    """
    rows = with_row(docs)
    groups = jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).distinct()
    # The smallest of each group first by doc_id, then by row key; maxima combine before the shuffle, so a hot group is no hot task.
    order = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row")).alias("__place"))
    stay = written(groups.join(order.distinct(), "__row").groupBy("__group").agg(F.min("__place").alias("__place")).select(
        F.col("__place.row").alias("__row")), "group-representatives")
    return rows.join(stay, "__row", "left_semi").distinct().drop("__row")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a passage can't be cut out of a training text without leaving its frame."""
    found = contamination(keyed(docs), read_table(spark, sf_dir, "benchmark"), n=CONTAMINATED_WORDS)
    return only_with(docs, found.where("NOT contaminated").select(F.col("doc_id").alias("__row")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mask; ``n_chars`` follows."""
    found = scan(keyed(docs), clean=True).where("n_secrets > 0")
    found = found.select(F.col("doc_id").alias("__row"), F.col("clean_text").alias("__text")).distinct()
    rows = with_row(docs).join(found, "__row", "left")
    masked = F.col("__text").isNotNull()
    new = {"text": F.coalesce("__text", "text"),
           "n_chars": F.when(masked, F.length("__text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col(f"`{c}`")).cast(kind).alias(c) for c, kind in docs.dtypes])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact ids of every text, with the digest of what they decode to."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True).drop("decoded")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secret_scan", without_secrets),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
