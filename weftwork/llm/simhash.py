"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

``fingerprints`` gives each document's SimHash. ``links`` compares the distinct
fingerprints tile by tile with numpy's exclusive-or and bit counts. A tile holds
the fingerprints with the same population counts in each of four 16-bit
quarters; the sum of the quarters' differences is a lower bound of the Hamming
distance, so tile pairs whose counts differ beyond the radius are never read.
``components`` joins the links into classes.

Scale: copies meet in one fingerprint before anything is compared. A tile of
more than ``block`` fingerprints is cut into blocks that are compared in turn,
so memory is one block whatever the tile holds. A block returns a spanning
forest of its links, at most one link for each fingerprint that it read, not all
pairs. Classes are found by star contraction (large-star and small-star rounds),
whose joins are on keys and whose rounds are stored in the shared folder.

Defined cases: null text has no words; no words give fingerprint zero, which
links like any other; fewer words than a shingle has give the whole sequence
as one shingle; rows with a null doc_id are compared, but a null never names
a class that has another member; repeated rows are returned as often as they
come; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common

QUARTERS = 4
WIDTH = 17  # population counts of 16 bits: 0 to 16


def shingle_hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; bytes.lower() changes A-Z only."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # for bytes: the ASCII white space 09-0D and 20
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    return np.fromiter(
        [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)],
        np.uint64, n,
    )


def voted(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero for none."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """SimHash over the hashes of the word shingles."""
    return voted(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, version, fp long): one row for each row of docs; version is common.text_hash."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found = np.array([fingerprint_of(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(found, pa.int64())], ["doc_id", "version", "fp"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.text_hash().alias("version"))
    return known.mapInArrow(common.frugal(run), "doc_id long, version long, fp long")


def tile_of(fp: Column) -> Column:
    """The four quarters' population counts as one number."""
    found = F.lit(0)
    for q in range(QUARTERS):
        found = found * WIDTH + F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF)))
    return found.cast("int")


def steps(radius: int) -> list[tuple[int, ...]]:
    """Moves to the tiles within the radius, one of each opposite pair, without the zero move."""
    span = range(-radius, radius + 1)
    return [m for m in product(span, repeat=QUARTERS) if 0 < sum(map(abs, m)) <= radius and m > (0,) * QUARTERS]


def neighbours(tile: Column, radius: int) -> Column:
    """array<int>: the tiles to visit besides the own one."""
    parts = [F.pmod(F.floor(tile / WIDTH ** (QUARTERS - 1 - q)), F.lit(WIDTH)) for q in range(QUARTERS)]
    found = []
    for move in steps(radius):
        at = [p + d for p, d in zip(parts, move, strict=True)]
        inside = F.lit(True)
        target = F.lit(0)
        for x, d in zip(at, move, strict=True):
            if d:
                inside = inside & x.between(0, WIDTH - 1)
            target = target * WIDTH + x
        found.append(F.when(inside, target.cast("int")))
    return F.array_compact(F.array(*found))


def classes_within(h: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a block the position of its class's first member: breadth-first over the link matrix."""
    n = len(h)
    near = np.empty((n, n), bool)
    for at in range(0, n, 1024):
        near[at : at + 1024] = np.bitwise_count(h[at : at + 1024, None] ^ h[None, :]) <= radius
    label = np.full(n, -1, np.int64)
    for first in range(n):
        if label[first] < 0:
            label[first] = first
            edge = np.array([first])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & (label < 0))
                label[edge] = first
    return label


class Block:
    """Home fingerprints of one block, their classes so far, and the spanning links found."""

    def __init__(self, home: list[np.ndarray], radius: int) -> None:
        self.home = np.concatenate(home) if home else np.empty(0, np.uint64)
        self.radius = radius
        self.label = classes_within(self.home, radius)
        led = np.flatnonzero(self.label != np.arange(len(self.home)))
        self.found = [(self.home[led], self.home[self.label[led]])]

    def visit(self, fps: np.ndarray, cells: int = 1 << 21) -> None:
        """Link each visitor to one member of each class that it is near to; classes that share a visitor become one."""
        step = max(1, cells // max(1, len(self.home)))
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ self.home[None, :]) <= self.radius)
            if not len(i):
                continue
            who, first = np.unique(i, return_index=True)
            self.found.append((part[who], self.home[j[first]]))
            main = self.label[j[first]][np.searchsorted(who, i)]
            apart = self.label[j] != main
            for x, y in np.unique(np.stack([main[apart], self.label[j[apart]]], axis=1), axis=0).tolist():
                x, y = int(self.label[x]), int(self.label[y])
                if x != y:
                    self.found.append((self.home[[max(x, y)]], self.home[[min(x, y)]]))
                    self.label[self.label == max(x, y)] = min(x, y)

    def rows(self) -> pa.RecordBatch:
        a, b = (np.concatenate([f[k] for f in self.found]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compare_blocks(radius: int):
    """Over rows sorted by (tile, part, visitor): each block's home fingerprints against each other and its visitors."""

    def run(batches):
        now, home = None, []
        block: Block | None = None
        for batch in batches:
            tile, part = np.asarray(batch.column("tile"), np.int64), np.asarray(batch.column("part"), np.int64)
            visitor, fp = np.asarray(batch.column("visitor"), np.int64), np.asarray(batch.column("fp")).view(np.uint64)
            key = np.stack([tile, part, visitor])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(fp)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                group = (int(tile[s]), int(part[s]))
                if group != now:
                    if now is not None:
                        yield (block or Block(home, radius)).rows()
                    now, home, block = group, [], None
                if visitor[s] == 0:
                    home.append(fp[s:e])
                else:
                    block = block or Block(home, radius)
                    if len(block.home):
                        block.visit(fp[s:e])
        if now is not None:
            yield (block or Block(home, radius)).rows()

    return run


def links(distinct: DataFrame, radius: int = 2, block: int = 2048, most_tasks: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``; their classes are those of all pairs within the radius."""
    tiled = distinct.select("fp", tile_of(F.col("fp")).alias("tile"))
    # At most WIDTH ** QUARTERS = 83,521 rows, whatever the input: small enough to send to all.
    sizes = F.broadcast(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    spread = F.xxhash64("fp")
    home = tiled.join(sizes, "tile").select(
        "tile", "fp", "parts", F.pmod(spread, F.col("parts")).cast("int").alias("own")
    )
    at_home = home.select("tile", F.col("own").alias("part"), F.lit(0).alias("visitor"), "fp")
    within = home.where("parts > 1 AND own > 0").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("part"), F.lit(1).alias("visitor"), "fp"
    )
    abroad = (
        tiled.select("fp", F.explode(neighbours(F.col("tile"), radius)).alias("tile"))
        .join(sizes, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("visitor"), "fp")
    )
    rows = at_home.unionByName(within).unionByName(abroad)
    # A partition for each full block's worth of fingerprints: by their bytes, blocks look smaller than their work is.
    tasks = max(1, min(most_tasks, -(-distinct.count() // block)))
    return rows.repartition(tasks, "tile", "part").sortWithinPartitions("tile", "part", "visitor").mapInArrow(common.frugal(compare_blocks(radius)), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node that it reaches.

    Large-star and small-star rounds. Each round is joins and grouped minima on
    node keys; only one number, whether the edges changed, comes to the driver.
    """
    spark = edges.sparkSession
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        with common.passing(spark):
            both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            low2 = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            after = common.stored(small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", outlives=True)
        total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        if now.agg(F.count(F.lit(1)), total).first() == after.agg(F.count(F.lit(1)), total).first():
            break
        now = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, block: int = 2048) -> DataFrame:
    """doc_id, version, fp, component_id: the smallest doc_id that links reach; one row for each row of docs."""
    marked = common.stored(fingerprints(docs, shingle), "fingerprints")
    with common.passing(docs.sparkSession):
        distinct = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        found = components(links(distinct, radius, block))
        roots = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
        by_fp = common.stored(roots.join(named, "root").select("fp", "component_id"), "classes", outlives=True)
    return marked.join(by_fp, "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
