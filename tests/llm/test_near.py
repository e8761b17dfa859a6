import random
from pathlib import Path

import numpy as np

import corpus_pipeline
from weftwork.llm import common, near

from .cases import SCHEMA, WORD, documents, frame, prose, with_clashes


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """(doc_id, text) of the rows that stay, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(str((r[0], r[1])) for r, c, s in zip(rows, label, sets, strict=True) if r[0] is None or not s or least[c] == r[0])


def near_rows():
    """Copies about the threshold, chains of copies, and a class that no member is alike to all of."""
    rng = random.Random(4)
    rows = documents(40)
    for k in range(30):
        words = prose(rng, rng.choice((20, 60, 150))).split()
        for c in range(4):
            rows.append((1000 + 10 * k + c, " ".join(words), "en", "s", 1))
            for _ in range(rng.choice((1, 1, 2, 3))):
                words[rng.randrange(len(words))] = f"other{rng.randrange(10**6)}"
    for k in range(25):
        shared = prose(random.Random(9), 50).split()
        shared[rng.randrange(50)] = f"own{k}"
        rows.append((2000 + k, " ".join(shared), "en", "s", 1))
    return rows


def test_near_copies_against_brute_force(spark):
    rows = near_rows()
    got = near.one_of_each(with_clashes(frame(spark, rows))).collect()
    expected = brute_kept(rows)
    assert len(expected) < len(rows) - 30
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == expected
    assert near.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_drops_near_copies(spark):
    rows = near_rows()
    docs = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, with_clashes(frame(spark, rows)), "")
    assert sorted(str((r["doc_id"], r["text"])) for r in docs.collect()) == brute_kept(rows)


def test_nothing_is_left_behind(spark):
    """Within a scope only what the result reads is kept; at its end that goes too."""
    folder = Path(common.scratch(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir())
    with common.passing(spark):
        assert near.one_of_each(frame(spark, near_rows())).count()
        assert len([x for x in set(folder.iterdir()) - before if x.name.startswith("weftwork-")]) == 1
    assert set(folder.iterdir()) == before


def test_small_blocks_give_the_same_classes(spark):
    docs = frame(spark, near_rows())
    with common.passing(spark):
        whole, small = ({(r["doc_id"], r["version"]): r["component_id"] for r in near.classes(docs, block=b).collect()} for b in (2048, 3))
    assert whole == small


def batch_of(found, key):
    """Sets as one part of one group, each in a class of its own."""
    import pyarrow as pa

    n = len(found)
    columns = {key: [1] * n, "part": [0] * n, "visitor": [0] * n, "sig": list(range(n)), "n": [len(h) for h in found], "class": list(range(n))}
    extra = near.lists(found) if key == "root" else pa.array([near.packed(near.bucket_counts(h)) for h in found], pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns.values()), extra], [*columns, "hashes" if key == "root" else "counts"])


def test_groups_make_rows_for_members_not_pairs():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 64, 85, np.uint64)
    found = [np.sort(np.concatenate([shared[k % 2 :], rng.integers(0, 1 << 64, 8 + 12 * (k % 3 == 0), np.uint64)])) for k in range(60)]
    assert near.unpacked(batch_of(found, "token").column("counts")).sum() == sum(map(len, found))
    pairs = {(i, j) for j in range(60) for i in range(j) if near.enough(len(found[i]), len(found[j]), len(np.intersect1d(found[i], found[j])))}
    assert 60 < len(pairs) < 60 * 59 // 2

    def grouped(edges):
        label = list(range(60))
        for i, j in edges:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
        return label

    for key, kind in (("token", near.Possible), ("root", near.Alike)):
        rows = [r for b in near.meet_in_parts(key, kind)([batch_of(found, key)]) for r in zip(*(b.column(c).to_pylist() for c in "ab"), strict=True)]
        assert len(rows) < 2 * len(found)
        if kind is near.Alike:
            assert set((min(r), max(r)) for r in rows) <= pairs and grouped(rows) == grouped(pairs)
        else:
            assert all(grouped(rows)[i] == grouped(rows)[j] for i, j in pairs)
