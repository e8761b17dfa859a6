"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Two multinomials over hashed word uni- and bigrams are estimated: the target one
from documents that the labels call good, the raw one from every document. A
document's score is the mean, over its n-grams, of log p_target - log p_raw; it
is kept if it passes the base rules and scores at least ``threshold``. The rule
is a fixed comparison: the same counts give the same verdict.

The trusted documents are a bounded sample: the ``target_rows`` labelled ones
with the smallest hash of their doc_id, so their ids can be broadcast. The raw
counts cover every document. The model is one row of ``buckets`` numbers.

Words are dealt out as rows within a task and summed there, by a number of their
document, in generated code; a document leaves its task as one row of sums.

Defined cases: a null text has no words, so it fails the base rules, with score
0; a null doc_id is scored like any other; repeated rows are counted and
returned as often as they come; without labels the score is 0 throughout; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Ratios are whole multiples of 1 / UNITS, so a document's sum does not depend on the order of its n-grams.
UNITS = 1 << 30


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 16
    target_rows: int = 16_384
    smoothing: float = 1.0
    threshold: float = -0.1
    least_words: int = 50
    most_repeat_percent: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def gram_at(words: Column, place: Column, word: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket numbers of a word, and of it and its next neighbour (null at the end)."""
    after = F.get(words, place + 1)
    single = F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")
    return single, F.when(after.isNotNull(), F.pmod(F.xxhash64(word, after), F.lit(buckets)).cast("int"))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the document has twice or more, the first included."""
    n = F.size(words) - 2
    windows = F.when(n > 0, F.transform(
        F.slice(words, 1, F.greatest(n, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = F.transform(F.array(by_hash), lambda s: F.filter(
            s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        ))[0]
        at = F.transform(F.array(F.sort_array(F.transform(again, lambda x: x["i"]))), lambda p: F.aggregate(
            p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(3))).cast("long").alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        ))[0]
        return at

    return F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))[0]


def by_word(docs: DataFrame, rules: QualityRules, model: DataFrame) -> DataFrame:
    """One row a word (one for a document without words) with the document's own counts and the ratios of its n-grams."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != "")
    counted = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
        .select("row", "doc_id", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"))
        .select(
            "row", "doc_id", "words",
            (F.octet_length("text") - F.octet_length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
        )
    )
    # The model's array is met behind all that is worked out for a document, so it is looked into and never copied.
    each = counted.join(model, how="left", on=F.lit(True)).select("*", F.posexplode_outer("words").alias("place", "word"))
    single, pair = gram_at(F.col("words"), F.col("place"), F.col("word"), rules.buckets)
    ratio = F.coalesce(F.get("ratio", single), F.lit(0)) + F.coalesce(F.get("ratio", pair), F.lit(0))
    return each.select("row", "doc_id", "n_symbols", "n_dup_lines", "n_repeat_words", "word", F.length("word").alias("chars"), ratio.alias("ratio"))


def gram_counts(docs: DataFrame, sample: DataFrame, buckets: int) -> DataFrame:
    """How often each bucket comes in all texts (raw) and in the sample's (good), in one pass; every task sends one row per bucket at most.

    Every bucket is in the result."""
    marked = docs.select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words")).join(
        F.broadcast(sample.withColumn("good", F.lit(1).cast("long"))), "doc_id", "left"
    )
    # The outer form: from the inner one the optimizer infers a filter that splits every text once more.
    each = marked.select("words", F.coalesce("good", F.lit(0).cast("long")).alias("good"), F.posexplode_outer("words").alias("place", "word"))
    grams = F.array(*gram_at(F.col("words"), F.col("place"), F.col("word"), buckets))
    none = F.lit(0).cast("long")
    found = each.where("word IS NOT NULL").select(F.explode(grams).alias("bucket"), F.lit(1).cast("long").alias("raw"), "good").where("bucket IS NOT NULL")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), none.alias("raw"), none.alias("good"))
    return found.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))


def ratio_table(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> DataFrame:
    """One row, one array: log p_target - log p_raw by bucket number, in units of 1 / UNITS."""
    a = F.lit(rules.smoothing)
    sample = (
        trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.target_rows)
    )
    listed = gram_counts(docs, sample, rules.buckets).agg(
        F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"),
    )
    spread = a * rules.buckets
    return listed.select(F.transform("rows", lambda r: F.when(F.col("all_good") == 0, F.lit(0).cast("long")).otherwise(F.round(UNITS * (
        F.log((r["good"] + a) / (F.col("all_good") + spread)) - F.log((r["raw"] + a) / (F.col("all_raw") + spread))
    )).cast("long"))).alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the counts, base_failed, score, kept: one row for each row of docs."""
    model = F.broadcast(ratio_table(docs, trusted, rules))  # one row of a fixed length
    n = F.col("n_words")
    found = by_word(docs, rules, model).groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.count("word").alias("n_words"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("word_chars"), F.sum("ratio").alias("ratio"),
    )
    failed = (n < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * n)
    score = F.when(n > 0, F.col("ratio") / UNITS / (2 * n - 1)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), score.alias("score"),
        (~failed & (score >= rules.threshold)).alias("kept"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels.where(F.col("quality") == 1))
