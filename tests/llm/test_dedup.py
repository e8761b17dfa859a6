import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftwork.llm import simhash, substring

from .cases import SCHEMA, WORD, documents, frame, with_clashes


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def brute_classes(codes, radius=2):
    codes = np.array(codes, np.uint64)
    label = list(range(len(codes)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[:i]) <= radius):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_simhash_against_brute_force(spark):
    rows = documents(50)
    got = simhash.near_duplicates(with_clashes(frame(spark, rows))).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    classes = brute_classes(fps)
    least = {}
    for r, c in zip(rows, classes, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    expected = sorted(str((r[0], np.uint64(f).view(np.int64).item(), least.get(c))) for r, f, c in zip(rows, fps, classes, strict=True))
    assert sorted(str((r["doc_id"], r["fp"], r["component_id"])) for r in got) == expected
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_links_of_clusters_and_chains(spark, block):
    """Chains of close codes, dense clusters and codes at the edges of the tiles."""
    rng = np.random.default_rng(3)
    codes = {0, (1 << 64) - 1, 1, 3, 7, 15, 31}
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63)) * 2
        codes.add(base)
        for _ in range(20):
            codes.add(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
        for _ in range(8):
            base ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            codes.add(base)
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3)
    links = simhash.links(df, block=block)
    pairs = links.collect()
    assert all((int(np.uint64(np.int64(a).view(np.uint64)) ^ np.int64(b).view(np.uint64)).bit_count() <= 2 * len(codes)) for a, b in pairs)
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    groups = {}
    for c, g in zip(signed, brute_classes(codes), strict=True):
        groups.setdefault(g, []).append(c)
    for members in groups.values():
        assert len({found.get(c, c) for c in members}) == 1
    assert len({found.get(c, c) for c in signed}) == len(groups)


def test_components_of_a_long_path(spark):
    path = list(np.random.default_rng(1).permutation(300))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(path[:-1], path[1:], strict=True)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(300)} | {900: 900, 901: 900}
    assert simhash.components(edges.limit(0)).count() == 0


def brute_cut(rows, n=13):
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        if r[0] is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w, gone = WORD.findall(r[1] or ""), set()
        if r[0] is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < r[0]:
                    gone |= set(range(i, i + n))
        out.append(str((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_against_brute_force(spark, seed):
    rows = documents(70, seed)
    got = substring.cut(with_clashes(frame(spark, rows)))
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got.collect()) == brute_cut(rows)


def test_substring_with_a_full_bitmap(spark):
    """A bitmap that is too small says yes too often; the result stays."""
    rows = documents(40, 5)
    got = substring.cut(frame(spark, rows), seed_bits=1)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got.collect()) == brute_cut(rows)


def test_substring_periodic_texts_and_empty_table(spark):
    rows = [(1, "a b " * 30, "en", "s", 1), (2, "a b " * 20 + "c " + "b a " * 20, "en", "s", 1), (3, "x " + "a b " * 6 + "a", "en", "s", 1), (4, "b a b a b a b a b a b a", "en", "s", 1)]
    got = substring.cut(frame(spark, rows))
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got.collect()) == brute_cut(rows)
    assert substring.cut(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes_split_like_the_pattern():
    import pyarrow as pa

    texts = ["", " a  b\tc\x0b\x0cd\r\n", None, "\x1c x y é", "z"]
    words = substring.Words(pa.array(texts, pa.string()))
    counts = [len(WORD.findall(t or "")) for t in texts]
    assert (words.last - words.first).tolist() == counts and len(words.owner) == sum(counts)
