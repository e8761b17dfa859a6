"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. language_id: texts without a letter, or of no language with some certainty, go.
2. simhash_near_dedup: of each class of texts with a Jaccard similarity of 0.8 and
   more over five-word shingles the smallest doc_id stays. SimHash fingerprints link
   the closest; an exact prefix join finds the others.
3. substring_dedup: passages of 13 words and more that an earlier document has go,
   and with them documents of which nothing is left.
4. pii: personal data, keys, and terms that disclose persons are generalised or removed.
5. best_fit_packing: the texts become sequences of 2048 tokens.

All stages but the last return the columns of documents, whatever their names: what a
stage works with gets other names. ``n_chars`` follows the text. An empty input gives
an empty output at every stage. Rows without a text go in the first stage. Ties are
broken by doc_id; repeated rows (one doc_id, one text) stay or go together, and rows
without a doc_id are no copies of others for the stages 2 and 3, though others may be
copies of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import bydoc, common, langid, near, packing, pii, substring

#: Below this calibrated probability a document counts as of no known language.
LEAST_CERTAINTY = 0.4


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.modest(spark)
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    lang, score = (bydoc.fresh(docs.columns, stem) for stem in ("lang_pred", "score"))
    marked = langid.identify(docs, model, (lang, score))
    return marked.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_CERTAINTY)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.modest(spark)
    return near.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.modest(spark)
    words, removed, kept = (bydoc.fresh(docs.columns, stem) for stem in ("n_words", "n_removed", "kept"))
    cut = substring.cut(docs, added=(words, removed, kept))
    left = cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    return sized(left.withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))).select(*docs.columns))


def pii_sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.modest(spark)
    return sized(pii.sanitise(docs, pii.ALL_PAIRS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.modest(spark)
    return packing.pack(docs, packing.PackingConfig(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii_sanitise),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's input and its intermediate tables go when its output is written; the last output stays."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = common.fresh_folder(spark)
        with common.passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.deleted(spark, before)
        before = folder
    return docs
