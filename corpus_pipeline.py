"""From raw documents to token ids: five stages, each on all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableglass.llm import bpe, decontaminate, language, line_dedup, near_dedup
from tableglass.llm.common import fold, stored, table

LEAST_COSINE = 0.05  # to the nearest language; what is farther from all is no language that was learned
KEY = "__key"


def keyed(docs: DataFrame) -> DataFrame:
    """With a hash of id and text, which repeated rows share."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null, without letters or far from every learned language go."""
    profiles = language.learn(docs.filter(fold() != 0))
    places = [f"c{i}" for i in range(len(docs.columns))]  # no column's name meets one that the operator makes
    judged = language.predict(docs.toDF(*places), profiles, text=places[docs.columns.index("text")])
    fine = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_COSINE)
    return judged.filter(fine).select(*places).toDF(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text.

    A document that would lose more than half of its characters is, as far as its lines tell, a copy rather than one with lines of a
    site's frame. It stays whole, so that the next stage compares whole copies and keeps one of each, and no fragments are left.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]  # the text goes through Python once
    kept = line_dedup.drop_shared_lines(docs, 10, carry=others, most=0.5)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("carried").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    docs = keyed(docs)
    classes = near_dedup.near_duplicates(docs, id_col=KEY).select(KEY, "class_id").distinct()
    ids = docs.select(KEY, "doc_id").distinct()
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("least")
    winners = ids.join(classes, KEY).groupBy("class_id").agg(order).select(F.col(f"least.{KEY}").alias(KEY))
    return docs.dropDuplicates([KEY]).join(winners, KEY, "left_semi").drop(KEY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    docs = keyed(docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), 10, id_col=KEY)
    return docs.join(found.filter("contaminated").select(KEY).distinct(), KEY, "left_anti").drop(KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the token ids, and a digest of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_decoded=False).drop("decoded")


STAGES = [
    ("language ID", language_id), ("line dedup", shared_lines), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]

ORACLE_SQL = None  # SQL can't express language ID, classes of near duplicates or BPE; tests/llm holds it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
