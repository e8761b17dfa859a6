"""Substring dedup: seed and extend on winnowed anchors.

A repeat is a run of at least ``length`` (13) words that an earlier document
(smaller doc_id) also has. Winnowing picks, from every window of 13 words, the
rightmost smallest hash of its seven 7-word grams: equal windows pick the same
anchor at the same place, so every repeat is seeded.

1. Seed. Anchors that two documents share are found by a grouped minimum and
   maximum of doc_id, and put into a bitmap of a fixed size.
2. Extend. Each seed that the bitmap lets through is extended by up to six words
   both ways. Extended seeds meet on (anchor, hash of the extension): a group of
   thousands of copies is met through its key and its smallest doc_id, never as
   pairs. Where a smaller document has the whole extension, all its words go.
3. Where a seed has several extensions, the windows around it are compared one
   by one in the same way, so the ends of each repeat are exact.
4. The overlapping spans of a document are merged: these are its maximal repeats.

The bitmap only saves work: a false yes brings rows that no group keeps. When a
corpus outgrows it, results stay and the rows of step 2 grow towards all anchors;
``seed_bits`` is to be set with the corpus.

Defined cases: null text has no words; documents with fewer than 13 words keep
all; a null doc_id is neither earlier nor later than any; rows that share a
doc_id never remove from each other, and each is cut by its own text; an empty
table gives no rows; extra columns are ignored by the query and kept by
``cut``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import bydoc, common

GRAM = 7
SLICE = 1 << 19
#: Which bytes are part of a word: all but the ASCII white space.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Odd multipliers of the two rolling hashes.
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


#: A window's choice compares so many bits of a gram, then the position, in one number.
PLACE_BITS = 28
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a multiplier and of its inverse, modulo 2**64; kept for the next slice."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, SLICE + (1 << 16))
        c = ROLL[which]
        held = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))) for x in (c, pow(c, -1, 1 << 64)))
        if size <= 1 << 22:
            _POWERS[which] = held
    return held


class Words:
    """All words of some texts, in one line, with rolling hashes over them."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        inside = IN_WORD[self.data]
        cut = np.zeros(len(inside) + 1, bool)  # where no word goes on from the byte before
        cut[bounds] = True
        cut[1:] |= np.append(~inside[1:], True) if len(inside) else True
        opens = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
        closes = np.flatnonzero(inside & cut[1:]) + 1
        self.opens, self.closes = opens, closes
        self.owner = np.searchsorted(bounds, opens, side="right") - 1  # text of each word
        counts = np.bincount(self.owner, minlength=len(texts))
        self.last = np.cumsum(counts)  # one past each text's last word
        self.first = self.last - counts
        self.sums: dict[int, np.ndarray] = {}

    def words(self, which: int) -> np.ndarray:
        """A hash of each word's bytes."""
        up, down = powers(which, len(self.data) + 1)
        s = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=s[1:])
        return common.mix((s[self.closes] - s[self.opens]) * down[self.opens])

    def running(self, which: int) -> np.ndarray:
        if which not in self.sums:
            n = len(self.owner)
            found = np.zeros(n + 1, np.uint64)
            if n:
                np.cumsum(self.words(which) * powers(which, n)[0][:n], out=found[1:])
            self.sums[which] = found
        return self.sums[which]

    def hashed(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.running(which)
        return common.mix((s[end] - s[start]) * powers(which, len(s))[1][start])

    def grams(self) -> np.ndarray:
        s = self.running(0)
        return common.mix((s[GRAM:] - s[:-GRAM]) * powers(0, len(s))[1][: len(s) - GRAM])

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes of the chosen grams; all windows' starts and each one's gram, by position."""
        n = len(self.owner)
        none = np.empty(0, np.int64)
        if n < length:
            return none, np.empty(0, np.uint64), none, none
        grams = self.grams()
        place = np.uint64((1 << PLACE_BITS) - 1)
        low = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64))
        wide, have = length - GRAM + 1, 1
        while have < wide:  # minima of ever longer runs; the last step overlaps
            step = min(have, wide - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        start = np.flatnonzero(self.owner[: n - length + 1] == self.owner[length - 1 :])
        chosen = (place - (low[start] & place)).astype(np.int64)
        spots = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
        return spots, grams[spots], start, chosen

    def around(self, spots: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each gram with up to ``side`` words of its text before and behind."""
        own = self.owner[spots]
        start = np.maximum(spots - side, self.first[own])
        end = np.minimum(spots + GRAM + side, self.last[own])
        shape = ((spots - start) * (side + 1) + (end - spots - GRAM)).astype(np.uint64)
        return start, end, common.mix(self.hashed(start, end, 1) + shape)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                words = Words(part.column("text"))
                spots, grams, _, _ = words.anchors(length)
                ids = part.column("doc_id").take(pa.array(words.owner[spots]))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), ids], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(common.frugal(run), "anchor long, doc_id long")


def extended_rows(docs: DataFrame, length: int, seeds) -> DataFrame:
    """Seeds with their words on both sides, as (anchor, around) keys."""
    side = length - GRAM

    def run(batches):
        bitmap = seeds.value
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                words = Words(part.column("text"))
                spots, grams, _, _ = words.anchors(length)
                pick = common.in_bitmap(bitmap, grams)
                spots, grams = spots[pick], grams[pick]
                start, end, around = words.around(spots, side)
                own = words.owner[spots]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), part.column("doc_id").take(take), part.column("version").take(take),
                     pa.array(start - words.first[own], pa.int32()), pa.array(end - start, pa.int32())],
                    ["anchor", "around", "doc_id", "version", "start", "n"],
                )

    return docs.mapInArrow(common.frugal(run), "anchor long, around long, doc_id long, version long, start int, n int")


def window_rows(docs: DataFrame, length: int, sent) -> DataFrame:
    """Every window around a seed whose extension is met here first, where the seed has several extensions."""
    side = length - GRAM

    def run(batches):
        several, firsts = sent.value
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                words = Words(part.column("text"))
                spots, grams, start, chosen = words.anchors(length)
                ids = np.asarray(part.column("doc_id")).view(np.uint64)
                held = common.in_bitmap(several, grams)
                likely = np.flatnonzero(held)
                at = spots[likely]
                held[likely] = common.in_bitmap(firsts, grams[likely] ^ words.around(at, side)[2] ^ ids[words.owner[at]])
                which = np.repeat(np.arange(len(spots)), np.diff(np.append(np.searchsorted(chosen, spots), len(chosen))))
                pick = held[which]
                start, chosen, which = start[pick], chosen[pick], which[pick]
                around = common.mix(words.hashed(start, start + length, 1) + (chosen - start).astype(np.uint64))
                own = words.owner[start]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[which].view(np.int64)), pa.array(around.view(np.int64)), part.column("doc_id").take(take), part.column("version").take(take),
                     pa.array(start - words.first[own], pa.int32()), pa.array(np.full(len(start), length), pa.int32())],
                    ["anchor", "around", "doc_id", "version", "start", "n"],
                )

    return docs.mapInArrow(common.frugal(run), "anchor long, around long, doc_id long, version long, start int, n int")


def firsts(rows: DataFrame) -> DataFrame:
    """(anchor, around, lo, hi): the smallest and the greatest doc_id of each key."""
    return rows.groupBy("anchor", "around").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


def later_than_first(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Rows whose key a smaller doc_id has too: a join with one row a key."""
    return rows.join(first.where("lo < hi").drop("hi"), ["anchor", "around"]).where("doc_id > lo").select("doc_id", "version", "start", "n")


def repeats(docs: DataFrame, length: int = 13, seed_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, version, spans array<struct<start, n>>): words that an earlier document has too; spans may overlap."""
    if length < GRAM:
        raise ValueError(f"length is {GRAM} words at least")
    spark = docs.sparkSession
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", common.text_hash().alias("version")
    )
    shared = anchor_rows(known, length).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    seeds = common.sent(spark, common.bitmap_of(shared, "anchor", seed_bits))
    extended = common.stored(extended_rows(known, length, seeds), "extended")
    first = common.stored(firsts(extended), "firsts")
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1 AND lo < hi")
    met_first = first.select(F.col("anchor").bitwiseXOR(F.col("around")).bitwiseXOR(F.col("lo")).alias("key"))
    edges = common.sent(spark, (common.bitmap_of(several, "anchor", seed_bits), common.bitmap_of(met_first, "key", seed_bits)))
    windows = window_rows(known, length, edges)  # made twice, which costs less than to keep them
    found = later_than_first(extended.where(F.col("n") >= length), first).unionByName(later_than_first(windows, firsts(windows)))
    return found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def kept_words(text: bytes | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the words that stay, joined by a space."""
    words = (text or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    level = np.zeros(len(words) + 1, np.int32)
    start = np.fromiter((s["start"] for s in spans), np.int64, len(spans))
    end = start + np.fromiter((s["n"] for s in spans), np.int64, len(spans))
    np.add.at(level, start, 1)
    np.add.at(level, end, -1)
    gone = np.cumsum(level[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def cut(docs: DataFrame, length: int = 13, seed_bits: int = 1 << 26, added: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """The rows of docs with the number of words, of removed words, and the words that stay, joined by one space.

    ``added`` names the three; columns of docs with these names are replaced.
    """
    fields = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    names = [f.name for f in fields]

    def answer(part: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        found = [kept_words(t, s) for t, s in zip(part.column("text").cast(pa.binary()).to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*(part.column(n) for n in names), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], pa.binary()).cast(pa.string())],
            [*names, *added],
        )

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{added[0]}` long, `{added[1]}` long, `{added[2]}` string"])
    with common.passing(docs.sparkSession):
        return bydoc.answered(docs.select(*names), repeats(docs, length, seed_bits), "spans", answer, shape)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) > 12)),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
