"""Near copies: all pairs of texts with a Jaccard similarity of 4/5 and more over word shingles.

Candidates come from two sources. SimHash (``simhash.links`` over fingerprints of
the same shingles) links the closest; texts with one fingerprint meet through one
of them. What lies beyond its radius is found by an exact prefix join: all
shingles have one order for the whole corpus; two texts of that similarity share a
shingle among the first n - ceil(4 n / 5) + 1 of each. Whatever its source, a pair
is compared: first by how many shingles each has in every one of BUCKETS buckets,
which bounds what they share from above, then by their whole sets of shingles. So
the classes are those of a comparison of all pairs.
The order puts shingles last that a sample of the texts has often. It decides how
many texts are compared, never which are found.

Scale: texts with the same shingles meet first. In each group of texts that share
a shingle all are compared with one of them, and those of different classes then
with each other, so a large class costs a few rows for each text and not the
square. Texts that share a rare shingle and are not alike are compared pair by pair,
in blocks in numpy by the counts of their buckets. A block returns a spanning forest
of the pairs that these leave, at most two rows for each text that it read. The trees
that the forests make meet in blocks with their whole sets, all pairs of a tree, and
return a spanning forest of those that are alike. So no step has a row for each pair.
Only the sets of texts to compare are dealt out, once for each block of their tree.

Defined cases: a text without words, or null, has no near copy and stays; words are
split and lowered as in ``simhash``; fewer words than a shingle has are one shingle;
classes are transitive; rows with a null doc_id are compared, link others, and all
stay; repeated rows (one doc_id, one text) are one document, so they all stay or all
go; 64-bit hashes stand for shingles and for sets of them; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import bydoc, common, simhash

#: Least similarity as a fraction.
PART, WHOLE = 4, 5

#: A shingle that so many texts of the sample have comes later in the order, and later still from the second number on.
OFTEN = (3, 48)
SAMPLE = 8

#: Shingles are counted in so many buckets, by the hash.
BUCKETS = 256

#: So many hashes of whole sets are held at once.
HELD = 1 << 21


def shingles_of(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64).item()


def bucket_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes each bucket has, up to 255."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def packed(counts: np.ndarray) -> bytes:
    """Counts as four bits each where they are small enough, as bytes otherwise."""
    return (counts[0::2] | (counts[1::2] << 4)).tobytes() if counts.max() < 16 else counts.tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    whole = np.asarray(pc.equal(pc.binary_length(column), BUCKETS))
    found = np.empty((len(column), BUCKETS), np.uint8)
    bytes_of = lambda some: np.frombuffer(b"".join(column.filter(pa.array(some)).to_pylist()), np.uint8)
    found[whole] = bytes_of(whole).reshape(-1, BUCKETS)
    half = bytes_of(~whole).reshape(-1, BUCKETS // 2)
    found[~whole, 0::2], found[~whole, 1::2] = half & 15, half >> 4
    return found


def excess(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many hashes of a set its counts leave out."""
    return n - counts.sum(axis=-1, dtype=np.int64)


def enough(n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that share so many are alike."""
    return WHOLE * both >= PART * (n + m - both)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def often(docs: DataFrame, shingle: int, bits: int) -> list[np.ndarray]:
    """Bitmaps of the shingles that come often in a sample of the texts."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [shingles_of(t or b"", shingle) for t in part.column("text").cast(pa.binary()).to_pylist()]
                for at in range(0, len(found), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[at : at + 64]).view(np.int64), pa.int64())], ["token"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(common.frugal(run), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = common.stored(counts.where(F.col("n") >= OFTEN[0]), "often")
    return [common.bitmap_of(counts.where(F.col("n") >= least), "token", bits) for least in OFTEN]


def marked(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(doc_id, version, sig, fp, n, prefix, counts) for each row with words: its set of shingles, its fingerprint, their number, the first ones, and how many each bucket has."""
    with common.passing(docs.sparkSession):
        frequent = common.sent(docs.sparkSession, often(docs, shingle, bits), outlives=True)

    def first(h: np.ndarray) -> np.ndarray:
        rank = sum(common.in_bitmap(b, h).astype(np.int8) for b in frequent.value)
        return h[np.lexsort((h, rank))[: len(h) - -(-PART * len(h) // WHOLE) + 1]]

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [simhash.shingle_hashes(t or b"", shingle) for t in part.column("text").cast(pa.binary()).to_pylist()]
                keep = [k for k, h in enumerate(found) if len(h)]
                ids, versions = (part.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "version"))
                prints = np.array([simhash.voted(found[k]) for k in keep], np.uint64).view(np.int64)
                held = [np.unique(found[k]) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [ids, versions, pa.array([set_id(h) for h in held], pa.int64()), pa.array(prints, pa.int64()), pa.array([len(h) for h in held], pa.int32()), lists([first(h) for h in held]),
                     pa.array([packed(bucket_counts(h)) for h in held], pa.binary())],
                    ["doc_id", "version", "sig", "fp", "n", "prefix", "counts"],
                )

    return docs.mapInArrow(common.frugal(run), "doc_id long, version long, sig long, fp long, n int, prefix array<long>, counts binary")


def long_enough(n: Column, m: Column) -> Column:
    """Whether sets of n and m can be alike."""
    return WHOLE * F.least(n, m) >= PART * F.greatest(n, m)


def left_possible(batches):
    """The pairs (a, b) whose counts leave them as possible."""
    for batch in batches:
        n, m = (np.asarray(batch.column(c), np.int64) for c in ("n_a", "n_b"))
        x, y = (unpacked(batch.column(c)) for c in ("counts_a", "counts_b"))
        most = np.minimum(x, y).sum(axis=1, dtype=np.int64) + np.minimum(excess(n, x), excess(m, y))
        yield batch.select(["a", "b"]).filter(pa.array(enough(n, m, most)))


def sets_of(needed: DataFrame, docs: DataFrame, shingle: int, doc_bits: int) -> DataFrame:
    """(sig, hashes) of the sets (sig, version), read from their texts; to be used within the open scope."""
    bitmap = common.sent(docs.sparkSession, common.bitmap_of(needed.select(F.col("version").alias("key")), "key", doc_bits))

    def run(batches):
        for batch in batches:
            versions = np.asarray(batch.column("version")).view(np.uint64)
            for part in common.slices(batch.filter(pa.array(common.in_bitmap(bitmap.value, versions))), "text"):
                found = [h for t in part.column("text").cast(pa.binary()).to_pylist() if len(h := shingles_of(t or b"", shingle))]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in found], pa.int64()), lists(found)], ["sig", "hashes"])

    sets = docs.select("version", "text").mapInArrow(common.frugal(run), "sig long, hashes array<long>").join(needed.select("sig"), "sig", "left_semi")
    return common.stored(sets.groupBy("sig").agg(F.first("hashes").alias("hashes")), "sets")


def alike(pairs: DataFrame, one: DataFrame, docs: DataFrame, shingle: int, doc_bits: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is high enough."""
    with common.passing(docs.sparkSession):
        left, right = (one.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("counts").alias(f"counts_{k}")) for k in "ab")
        pairs = common.stored(pairs.join(left, "a").join(right, "b").mapInArrow(common.frugal(left_possible), "a long, b long"), "possible")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        needed = common.stored(needed.join(one.select("sig", "version"), "sig"), "needed")
        sets = sets_of(needed, docs, shingle, doc_bits)
        left, right = (sets.select(F.col("sig").alias(k), F.col("hashes").alias(f"of_{k}")) for k in "ab")
        both = F.size(F.array_intersect("of_a", "of_b"))
        met = pairs.join(left, "a").join(right, "b")
        return common.stored(met.where(WHOLE * both >= PART * (F.size("of_a") + F.size("of_b") - both)).select("a", "b"), "alike", outlives=True)


def fingerprint_pairs(one: DataFrame, radius: int) -> DataFrame:
    """(a, b): sets whose fingerprints are the same or linked, each met through the smallest set of its fingerprint."""
    heads = common.stored(one.groupBy("fp").agg(F.min("sig").alias("head")), "heads")
    own = one.join(heads, "fp").where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    left, right = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"head_{k}")) for k in "ab")
    linked = simhash.links(heads.select("fp"), radius).distinct().join(left, "a").join(right, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return own.unionByName(linked)


class Members:
    """Sets of a batch, or those of a part so far: how many hashes, which class, and the counts."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.sig, self.n, self.group = (np.asarray(batch.column(c), np.int64) for c in ("sig", "n", "class"))
        self.hashes: list[np.ndarray] = []
        if "hashes" in batch.schema.names:
            self.hashes = [np.asarray(h.values).view(np.uint64) for h in batch.column("hashes")]
            self.counts = np.array([bucket_counts(h) for h in self.hashes], np.uint8).reshape(-1, BUCKETS)
        else:
            self.counts = unpacked(batch.column("counts"))
        self.excess = excess(self.n, self.counts)

    def take(self, other: Members) -> None:
        for name in ("sig", "n", "group", "counts", "excess"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.hashes += other.hashes

    def long_enough(self, n: int, end: int) -> np.ndarray:
        return WHOLE * np.minimum(self.n[:end], n) >= PART * np.maximum(self.n[:end], n)

    def possible(self, at: np.ndarray, other: Members, k: int) -> np.ndarray:
        """Those of the rows ``at`` that the counts leave as possible for row k of the others."""
        most = np.minimum(self.counts[at], other.counts[k]).sum(axis=1, dtype=np.int64) + np.minimum(self.excess[at], other.excess[k])
        return at[enough(self.n[at], other.n[k], most)]

    def alike(self, at: np.ndarray, other: Members, k: int) -> np.ndarray:
        """Those of the rows ``at`` whose sets are alike with that of row k of the others."""
        h, found = other.hashes[k], []
        step = max(1, HELD // 4 // int(self.n[at].max(initial=1)))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            flat = np.concatenate([self.hashes[j] for j in part])
            hit = h[np.minimum(np.searchsorted(h, flat), len(h) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum([0, *self.n[part[:-1]]]), dtype=np.int64)
            found.append(part[enough(self.n[part], other.n[k], both)])
        return np.concatenate(found) if found else at


class Possible:
    """One part of a token's group: the trees of possible pairs of different classes so far."""

    def __init__(self, home: Members) -> None:
        self.home, self.tree = home, np.arange(len(home.sig))

    def take(self, other: Members) -> None:
        self.tree = np.concatenate([self.tree, np.arange(len(self.tree), len(self.tree) + len(other.sig))])
        self.home.take(other)

    def meet(self, other: Members, k: int, own: int | None) -> list[int]:
        """Row k of the others, which is row ``own`` here or a visitor, joins trees: a row of each tree that it is possible with."""
        home, found, step, end = self.home, [], 64, own
        now = None if own is None else int(self.tree[own])
        at = np.flatnonzero((home.group[:end] != other.group[k]) & home.long_enough(other.n[k], end))
        while len(at):
            some, at = home.possible(at[:step], other, k), at[step:]
            for tree, first in zip(*(x.tolist() for x in np.unique(self.tree[some], return_index=True)), strict=True):
                if tree != now:
                    found.append(int(some[first]))
                    if now is None:
                        now = tree
                    else:
                        self.tree[self.tree == tree] = now
            at, step = at[self.tree[at] != now] if now is not None else at, 4 * step
        return found


class Alike:
    """One part of a tree: its classes so far, those known before included."""

    def __init__(self, home: Members) -> None:
        self.home, self.label, self.led = home, home.group.copy(), {}

    def find(self, label: int) -> int:
        while label in self.led:
            label = self.led[label]
        return label

    def take(self, other: Members) -> None:
        self.label = np.concatenate([self.label, [self.find(x) for x in other.group.tolist()]])
        self.home.take(other)

    def meet(self, other: Members, k: int, own: int | None) -> list[int]:
        """Row k of the others joins classes: a row of each class that it is alike to."""
        home, found, end = self.home, [], own
        now = self.find(int(other.group[k]))
        at = home.possible(np.flatnonzero((self.label[:end] != now) & home.long_enough(other.n[k], end)), other, k)
        first = np.unique(self.label[at], return_index=True)[1]
        for some in (at[first], np.delete(at, first)):  # one of each class may do
            some = home.alike(some[self.label[some] != now], other, k)
            for j in some.tolist():
                if (label := int(self.label[j])) != now:
                    found.append(j)
                    self.led[label] = now
                    self.label[self.label == label] = now
        return found


def meet_in_parts(key_name: str, kind: type):
    """Over rows sorted by (key, part, visitor): each part's members meet each other and its visitors."""

    def run(batches):
        now, part_now = None, None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c), np.int64) for c in (key_name, "part", "visitor")])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                *at, visitor = key[:, s].tolist()
                members, before = Members(batch.slice(s, e - s)), 0
                if at != now:
                    now, part_now = at, kind(Members(batch.slice(s, 0 if visitor else e - s)))
                elif not visitor:
                    before = len(part_now.home.sig)
                    part_now.take(members)
                for k in range(len(members.sig)):
                    found = part_now.meet(members, k, None if visitor else before + k)
                    a += part_now.home.sig[found].tolist()
                    b += [members.sig[k]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def dealt(rows: DataFrame, key: str, columns: list[str], tasks: int, most_tasks: int = 20_000) -> DataFrame:
    """Each row to its part of its key, and as a visitor to the parts before it."""
    at_home = rows.select(key, F.col("own").alias("part"), F.lit(0).alias("visitor"), *columns)
    abroad = rows.where("own > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("part"), F.lit(1).alias("visitor"), *columns)
    return at_home.unionByName(abroad).repartition(max(1, min(most_tasks, tasks)), key, "part").sortWithinPartitions(key, "part", "visitor")


def own_part() -> Column:
    return F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("own")


def possible_links(held: DataFrame, one: DataFrame, rows_a_task: int = 4096) -> DataFrame:
    """(a, b): a forest of sets of different classes that share a token and that the counts of their buckets leave as possible.

    held: (token, sig, n, class, parts), the members of each token in so many parts.
    """
    full = held.select("token", "sig", "n", "class", own_part()).join(one.select("sig", "counts"), "sig")
    rows = dealt(full, "token", ["sig", "n", "class", "counts"], -(-held.count() // rows_a_task))
    return rows.mapInArrow(common.frugal(meet_in_parts("token", Possible)), "a long, b long")


def alike_links(trees: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(a, b): a forest of the sets of different classes that are alike, by all pairs of each tree.

    trees: (root, sig, n, class); sets: (sig, hashes).
    """
    of_tree = trees.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / HELD)).cast("int").alias("parts"))
    full = trees.join(of_tree, "root").select("root", "sig", "n", "class", own_part()).join(sets, "sig")
    size = trees.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("hashes")).first()
    rows = dealt(full, "root", ["sig", "n", "class", "hashes"], size["rows"] // 256 + size["hashes"] // (HELD // 8) + 1)
    return rows.mapInArrow(common.frugal(meet_in_parts("root", Alike)), "a long, b long")


def classes(docs: DataFrame, shingle: int = 5, radius: int = 2, bits: int = 1 << 24, block: int = 2048) -> DataFrame:
    """(doc_id, version, component_id) for each row with words: the smallest doc_id of its class. It is to be used within the open scope."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.text_hash().alias("version")).where("text IS NOT NULL")
    with common.passing(spark):
        marks = common.stored(marked(known, shingle, bits), "marked")
        one = common.stored(
            marks.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("version").alias("version"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts")),
            "sets", outlives=True,
        )
        rows = common.stored(marks.select("doc_id", "version", "sig"), "rows", outlives=True)
    tokens = one.select("sig", "n", F.explode("prefix").alias("token"))
    same = Window.partitionBy("token")
    met = tokens.select("*", F.count(F.lit(1)).over(same).alias("size"), F.min(F.struct("sig", "n")).over(same).alias("head"))
    shared = common.stored(met.where("size > 1").drop("size"), "shared")

    to_head = shared.where((F.col("sig") != F.col("head.sig")) & long_enough(F.col("n"), F.col("head.n")))
    to_head = to_head.select(F.col("head.sig").alias("a"), F.col("sig").alias("b")).unionByName(fingerprint_pairs(one, radius))
    to_head = common.stored(to_head.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    near = alike(to_head, one, known, shingle, bits)

    with common.passing(spark):
        found = simhash.components(near)
        held = shared.join(found, F.col("sig") == F.col("node"), "left").select("token", "sig", "n", F.coalesce("root", "sig").alias("class"))
        of_token = held.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        mixed = of_token.where("low < high").select("token", "parts")
        held = common.stored(held.join(mixed, "token"), "held")
        links = common.stored(possible_links(held, one).distinct(), "links")
        tree = simhash.components(links).select(F.col("node").alias("sig"), F.col("root").alias("tree"))
        labels = found.select(F.col("node").alias("sig"), F.col("root").alias("class"))
        trees = tree.join(one.select("sig", "n", "version"), "sig").join(labels, "sig", "left")
        trees = common.stored(trees.select(F.col("tree").alias("root"), "sig", "n", "version", F.coalesce("class", "sig").alias("class")), "trees")
        sets = sets_of(trees.select("sig", "version"), known, shingle, bits)
        rest = common.stored(alike_links(trees, sets, block), "alike", outlives=True)

    found = simhash.components(near.unionByName(rest))
    roots = one.join(found, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.select("sig", "root").join(named, "root"), "sig").select("doc_id", "version", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their class. Rows without a doc_id or without words all stay."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def answer(part: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        return part.filter(pa.array([not g for g in gone], pa.bool_()))

    with common.passing(docs.sparkSession):
        gone = classes(docs, shingle, radius).where("doc_id IS NOT NULL AND component_id < doc_id").select("doc_id", "version", F.lit(True).alias("gone")).distinct()
        return bydoc.answered(docs, gone, "gone", answer, shape)
