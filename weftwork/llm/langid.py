"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, runs of spaces
become one, and n-grams of one to ``longest`` code points are hashed into
``buckets``. TF is the share of a document's n-grams; IDF comes from all
documents that may be learnt from. Weights are trained with
follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty, and a
temperature is fitted on rows kept apart. Only text and language are learnt from;
a prediction sees only text.

Because TF is a share, a document's scores are the mean of its n-grams' rows of
``idf * weight``; no document needs a sparse vector of its own, so prediction is
one pass without a shuffle. The model is ``buckets`` times languages floats.

The classifier is fitted on a bounded sample: at most ``sample_rows`` documents
for each language, those with the smallest hash of doc_id and text (documented
bound; repeated rows count once). Their n-grams are counted in the tasks; the
driver gets buckets and counts, at most ``buckets`` of them a document, and no
text. The document frequencies cover every learnable document.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every document when there is nothing to learn from; a null doc_id is never
held out; repeated rows get the same answer each; whole texts are read, in
pieces; an empty table gives no rows; extra columns are ignored by the query and
kept by ``identify``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm import common

UNKNOWN = "und"
PIECE = 1 << 20  # code points handled at once


@dataclass(frozen=True)
class LangidConfig:
    buckets: int = 1 << 15
    longest: int = 3
    sample_rows: int = 1000
    epochs: int = 3
    scale: float = 100.0  # shares are small numbers; this puts the features near 1
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    apart: int = 5  # one row of so many fits the temperature


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def cleaned(text: str) -> np.ndarray:
    """Letters and single spaces, with a space at either end; empty if there is no letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (points != 32).any():
        return np.empty(0, np.uint32)
    points = np.concatenate([np.array([32], np.uint32), points, np.array([32], np.uint32)])
    blank = points == 32
    return points[~(blank & np.concatenate([[False], blank[:-1]]))]


def gram_buckets(points: np.ndarray, config: LangidConfig) -> np.ndarray:
    """Bucket numbers of all n-grams."""
    found, h = [], np.zeros(len(points), np.uint32)
    shift = np.uint32(32 - (config.buckets - 1).bit_length())
    for n in range(config.longest):
        h = (h[: len(points) - n] * np.uint32(0x01000193)) ^ (points[n:] * np.uint32(0x9E3779B1) + np.uint32(n + 1))
        found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift)
    return np.concatenate(found).astype(np.int64)


def document_frequencies(docs: DataFrame, config: LangidConfig) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each bucket comes, and the number of texts with a letter."""

    def run(batches):
        counts, n = np.zeros(config.buckets, np.int64), 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    points = cleaned(text or "")
                    if len(points):
                        seen = np.zeros(config.buckets, bool)
                        for at in range(0, len(points), PIECE):
                            seen[gram_buckets(points[at : at + PIECE + config.longest - 1], config)] = True
                        counts += seen
                        n += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], n), pa.int64())], ["bucket", "n"]
        )

    rows = docs.select("text").mapInArrow(common.frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found, total = np.zeros(config.buckets), 0  # at most buckets + 1 rows
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            found[r["bucket"]] = r["n"]
    return found, total


def gram_counts(text: str, config: LangidConfig) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their counts."""
    points = cleaned(text)
    counts = np.zeros(config.buckets, np.int64)
    for at in range(0, len(points), PIECE):
        counts += np.bincount(gram_buckets(points[at : at + PIECE + config.longest - 1], config), minlength=config.buckets)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def sample(known: DataFrame, sizes: dict[str, int], config: LangidConfig) -> DataFrame:
    """(lang, h, at, counts): the n-grams of at most ``sample_rows`` texts a language, in the order of doc_id's hash, then h."""
    # A share of each language by hash, then a strict bound among the few that it leaves.
    limit = F.lit(0.0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, config.sample_rows / n))).otherwise(limit)
    by_hash = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    share = F.pmod(by_hash, F.lit(1 << 30)) / F.lit(float(1 << 30))
    turn = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [gram_counts(t, config) for t in part.column("text").to_pylist()]
                at, counts = (pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.int64())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "h", "turn")), at, counts], ["lang", "h", "turn", "at", "counts"])

    picked = known.where(share < limit).select("lang", by_hash.alias("h"), turn.alias("turn"), "text")
    grams = picked.mapInArrow(common.frugal(run), "lang string, h long, turn long, at array<int>, counts array<long>")
    once = grams.groupBy("lang", "h").agg(*(F.first(c).alias(c) for c in ("turn", "at", "counts")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("nth", nth).where(F.col("nth") <= config.sample_rows).orderBy("turn", "h", "lang").select("lang", "h", "at", "counts")


class Ftrl:
    """FTRL-proximal for a softmax over ``classes``, with L1 and L2 penalties; one example at a time."""

    def __init__(self, buckets: int, classes: int, config: LangidConfig) -> None:
        self.z, self.n, self.c = np.zeros((buckets, classes)), np.zeros((buckets, classes)), config

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, c = self.z[at], self.n[at], self.c
        return np.where(np.abs(z) <= c.l1, 0.0, -(z - np.sign(z) * c.l1) / ((c.beta + np.sqrt(n)) / c.alpha + c.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.c.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The positive number dividing the scores that gives the labels the greatest likelihood (golden section).

    Each label counts as (n + 1) / (n + 2) of a row and the others share the rest,
    so rows that are told apart without error don't ask for endless confidence.
    """
    if not len(labels):
        return 1.0
    classes = scores.shape[1]
    target = np.full(scores.shape, 1 / (len(labels) + 2) / max(1, classes - 1))
    target[np.arange(len(labels)), labels] = (len(labels) + 1) / (len(labels) + 2)

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -(target * np.log(np.maximum(p, 1e-300))).sum(axis=1).mean()

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(60):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class LangidModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: idf * weight / temperature
    config: LangidConfig

    def predict(self, text: str | None) -> tuple[str, float]:
        points = cleaned(text or "")
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(points), PIECE):
            buckets = gram_buckets(points[at : at + PIECE + self.config.longest - 1], self.config)
            counts = np.bincount(buckets, minlength=self.config.buckets) if len(buckets) > self.config.buckets else None
            total += counts @ self.table if counts is not None else self.table[buckets].sum(axis=0)
            n += len(buckets)
        p = softmax(total * self.config.scale / n)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(labelled: DataFrame, config: LangidConfig = LangidConfig()) -> LangidModel:
    """Learn from (doc_id, text, lang); rows without a language are left out."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    frequency, total = document_frequencies(known, config)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    number = {lang: k for k, lang in enumerate(languages)}
    learnt, apart = [], []
    rows = sample(known, sizes, config).toArrow()
    for k, (lang, at, counts) in enumerate(zip(rows["lang"].to_pylist(), *(rows[c].combine_chunks() for c in ("at", "counts")), strict=True)):
        if len(at):
            at, counts = np.asarray(at.values), np.asarray(counts.values)
            (apart if k % config.apart == 0 else learnt).append((at, (counts * (config.scale / counts.sum()) * idf[at]).astype(np.float32), number[lang]))
    model = Ftrl(config.buckets, len(languages), config)
    for epoch in range(config.epochs):
        for k in np.random.default_rng(epoch).permutation(len(learnt)):
            model.learn(*learnt[k])
    weights = model.weights(slice(None)) if languages else np.zeros((config.buckets, 0))
    scores = np.array([x @ weights[at] for at, x, _ in apart]) if apart else np.zeros((0, len(languages)))
    common.given_back()
    t = temperature(scores, np.array([label for _, _, label in apart], np.int64))
    return LangidModel(languages if learnt else [], np.ascontiguousarray(idf[:, None] * weights / t), config)


def identify(docs: DataFrame, model: LangidModel, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of docs with the language and its probability; ``added`` names the two, and columns of docs with these names are replaced."""
    fields = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    names = [f.name for f in fields]
    known = common.sent(docs.sparkSession, model)

    def run(batches):
        held = known.value
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [held.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    [*names, *added],
                )

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{added[0]}` string, `{added[1]}` double"])
    return docs.select(*names).mapInArrow(common.frugal(run), shape)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
