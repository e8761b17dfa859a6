import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.llm import chat, quality

from .cases import SCHEMA, WORD, documents, frame, with_clashes

TURNS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    return {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, TURNS)).withColumn("back", chat.parse(F.col("formatted"))).collect()}


def test_chat_round_trip_and_machine(spark):
    rows = [
        (1, 1, "assistant", "a\\</s>[INST]"), (1, 0, "user", "<s>[/INST]\\\\"), (2, 0, "assistant", "early"), (3, 0, "system", None), (3, 1, "user", "u"),
        (4, 0, "user", "x"), (4, 0, "user", "x"), (5, 0, "tool</s>", "[ROLE]q[/ROLE]"), (5, None, None, "first"), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
        (6, 0, "user", ""), (6, 1, "assistant", ""),
    ]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("user", "<s>[/INST]\\\\"), ("assistant", "a\\</s>[INST]")]
    assert got[1]["valid"] and got[None]["valid"] and got[6]["valid"]
    assert (got[2]["error_turn"], got[3]["error_turn"], got[4]["error_turn"], got[5]["error_turn"]) == (0, 2, 1, 0)
    assert [(t["role"], t["text"]) for t in got[5]["back"]] == [("", "first"), ("tool</s>", "[ROLE]q[/ROLE]")]
    assert [(s["text"], s["loss"]) for s in got[6]["segments"]] == [("<s>[INST]", False), ("", False), ("</s>", False), ("<s>[/INST]", False), ("", True), ("</s>", False)]
    assert len(got[4]["back"]) == 2 and "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    assert formatted(spark, []) == {}


PARTS = st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<", "s>", "[", "INST]", "x", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "</s>"]), PARTS), min_size=1, max_size=4), min_size=1, max_size=12))
def test_chat_any_text_comes_back(spark, conversations):
    got = formatted(spark, [(c, t, *turn) for c, turns in enumerate(conversations) for t, turn in enumerate(turns)])
    for c, turns in enumerate(conversations):
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == turns


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = [*documents(40), (900, "a b c a b c\n\na b c\na b c\n#*$%&|<>", "en", "s", 1), (901, "w " * 100, "en", "s", 1)]
    docs = frame(spark, rows)
    labels = docs.where("doc_id % 2 = 0").select("doc_id")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality.judge(with_clashes(docs), labels, quality.QualityRules(buckets=256)).collect()
    expected = sorted(str((r[0], *brute_counts(r[1]))) for r in rows)
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in got) == expected
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.1)


def test_quality_ratio_against_brute_force(spark):
    rows = [r for r in documents(30) if r[0] is not None]
    docs = frame(spark, rows)
    rules = quality.QualityRules(buckets=128)
    good = {r[0] for r in rows if r[0] % 3 == 0}
    labels = spark.createDataFrame([(g,) for g in good] + [(None,)], "doc_id long")
    got = {(r["doc_id"], r["n_words"]): r["score"] for r in quality.judge(docs, labels, rules).collect()}

    import math

    from xxhash import xxh64_intdigest

    def buckets(text):
        w = WORD.findall(text or "")
        spark_pair = pairs.get(hashlib.md5(" ".join(w).encode()).hexdigest(), [])
        return [((xxh64_intdigest(x, 42) ^ (1 << 63)) - (1 << 63)) % 128 for x in w] + spark_pair

    pairs = {}
    each = docs.select(quality.words_of(F.coalesce("text", F.lit(""))).alias("w")).distinct().select("w", F.posexplode("w").alias("place", "word"))
    for r in each.select(F.md5(F.array_join("w", " ")).alias("w"), F.size("w").alias("n"), "place", quality.gram_at(F.col("w"), F.col("place"), F.col("word"), 128)[1].alias("g")).collect():
        if r["place"] + 1 < r["n"]:
            pairs.setdefault(r["w"], []).append(r["g"])
        else:
            assert r["g"] is None
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r[1]))
        if r[0] in good:
            target.update(buckets(r[1]))
    ratio = [math.log((target[b] + 1) / (target.total() + 128)) - math.log((raw[b] + 1) / (raw.total() + 128)) for b in range(128)]
    for r in rows:
        g = buckets(r[1])
        assert got[r[0], len(WORD.findall(r[1] or ""))] == pytest.approx(sum(ratio[b] for b in g) / len(g) if g else 0.0)


def test_quality_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.judge(docs, docs.select("doc_id")).collect() == []
    one = spark.createDataFrame(documents(3), SCHEMA)
    assert {r["score"] for r in quality.judge(one, docs.select("doc_id"), quality.QualityRules(buckets=64)).collect()} == {0.0}


def test_chat_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    text = chat.CONTROL_TEXT
    assert got[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[-1]["loss_chars"] == len(text)
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[1]["loss_chars"] == 0 and got[1]["n_turns"] == 2
