import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftwork.llm import packing, sentence

from .cases import SCHEMA, documents, frame, prose, with_clashes

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def expected_pieces(rows, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    out = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        out += [str((r[0], k, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes()))) for k, a in enumerate(range(0, len(ids), length))]
    return sorted(out)


@pytest.mark.parametrize(("length", "open_bins"), [(2048, 256), (64, 4)])
def test_packing(spark, length, open_bins):
    rows = [
        *documents(50), (800, "<|endoftext|> don't we'll ab12cd <|startoftext|>", "en", "s", 1),
        (801, "a<|endoftext|>b ..<|endoftext|>, <|EndOfText|> <|endoftext|><|startoftext|> ÀÉ?! (Ünï) --- ab.cd 'tis e\u0301 \u0130 ΑΣ", "en", "s", 1),
    ]
    config = packing.PackingConfig(WORDS, length=length, open_bins=open_bins, cached_words=50)
    got = packing.pack(with_clashes(frame(spark, rows)), config).collect()
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == expected_pieces(rows, length)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.15 * total / length + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA), config).count() == 0


def test_packer_is_best_fit_and_closes_the_fullest():
    packer = packing.Packer(10, 2)
    assert packer.place(6) == (0, 0) and packer.place(7) == (1, 0)
    assert packer.place(3) == (1, 7) and packer.closed == [1]
    assert packer.place(9) == (2, 0)
    packer.closed.clear()
    assert packer.place(8) == (3, 0) and packer.closed == [2]  # 2 has 9 of 10
    assert packer.place(10) == (4, 0) and packer.closed == [2, 4]
    assert packer.place(4) == (0, 6)


def unigram():
    """The library's own unigram encoder over the same pieces; runs of spaces get scores that its 32-bit sums can hold."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1 and p.score < -1e8:
            p.score = -40_000.0
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), model.SerializeToString()


def test_pieces_as_the_library_finds_them(tmp_path):
    processor, raw = unigram()
    (tmp_path / "u.model").write_bytes(raw)
    model = sentence.PieceModel.load(str(tmp_path / "u.model"))
    rng = random.Random(3)
    lines = [line for _ in range(40) for line in prose(rng, 60).split("\n")] + ["", "a", " lead", "trail ", "two  spaces", "Ünï çé ñ 梦 мир", "▁", "x▁y"]
    for line in lines:
        assert model.encode(line) == processor.encode(line), line


def brute_viterbi(model, text):
    pieces = {p.decode(): i for i, p in enumerate(model_names(model))}
    best = [(0.0, 0, 0)] + [(-float("inf"), 0, 0)] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            i = pieces.get(text[s:e])
            score = model.scores[i] if i is not None else model.unknown_score if e - s == 1 else None
            if score is not None and best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s, -1 if i is None else i)
    out, at = [], len(text)
    while at:
        _, s, i = best[at]
        out = (model.byte_ids[list(text[s:at].encode())].tolist() if i < 0 else [i]) + out
        at = s
    return out


def model_names(model):
    names = [b""] * len(model.piece_bytes)
    for i, b in enumerate(model.piece_bytes):
        if i not in set(model.byte_ids.tolist()) and b and i != model.unknown:
            names[i] = b.replace(b" ", sentence.MARK.encode())
    return names


def test_viterbi_against_brute_force_and_round_trip():
    model = sentence.PieceModel.load(PIECES)
    rng = random.Random(9)
    for text in [prose(rng, 12), "a\nb\tc", "🎉é\x00", "  two  ", "мир"]:
        assert model.encode(text) == brute_viterbi(model, sentence.MARK + text.replace(" ", sentence.MARK))
        assert model.decode(model.encode(text)) == text
    assert model.encode("") == [] and model.decode([]) == ""


def test_sentencepiece_operator(spark):
    rows = documents(30)
    model = sentence.PieceModel.load(PIECES)
    docs = frame(spark, rows)
    got = sentence.summary(with_clashes(docs), model).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in got) == sorted(str((r[0], len(model.encode(r[1] or "")))) for r in rows)
    back = sentence.decode(sentence.encode(docs, model), model).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    assert sentence.summary(docs.limit(0), model).count() == 0


def test_trie_holds_all_pieces_and_no_others():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b\xff": 4, b"\x01": 5}
    trie = sentence.Trie.of(keys)
    text = b"abcb\xff\x01abd"
    data = np.frombuffer(text, np.uint8)
    s, e, i = trie.matches(data, np.arange(len(text)), np.full(len(text), len(text)))
    found = sorted((int(a), int(b), int(c)) for a, b, c in zip(s, e, i, strict=True))
    assert found == sorted((a, b, keys[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in keys)


def test_words_of_arrow_split():
    from weftwork.llm import common

    words, counts = common.split_words(pa.array(["a b", None, "", " c\n", "d"]))
    assert words.to_pylist() == ["a", "b", "c", "d"] and counts.tolist() == [2, 0, 0, 1, 1]
