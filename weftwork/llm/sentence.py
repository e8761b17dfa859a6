"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model is the pieces of a SentencePiece file with their scores. Encoding puts a
space in front, writes spaces as U+2581, and takes the segmentation with the
greatest sum of scores; among equals the one whose last pieces start earliest. A
character that no piece covers scores ten less than the lowest piece and is
written as its UTF-8 byte pieces (byte fallback). Decoding turns markers into
spaces, byte pieces into bytes, and drops the space in front.

No piece has a marker behind another character, so a text falls apart at its
spaces without loss. Each distinct word of a batch is segmented once, and all of
them together in numpy: the trie is walked from every position at once, one byte
deeper each time, then best scores go forward one byte offset at a time.

Defined cases: null and empty texts have no tokens and decode to the empty text;
runs of spaces and spaces at the ends come back unchanged; a null doc_id is
encoded like any other; repeated rows are encoded as often as they come; whole
texts are encoded; an empty table gives no rows; extra columns are ignored by
the query and kept by ``encode``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common

MARK = "▁"
SLICE = 1 << 23
CHUNK = 1 << 19  # bytes of distinct words segmented together
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "


@dataclass(frozen=True)
class Trie:
    """Double array: the child of node s by byte b is base[s] + b if check says so; value is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> Trie:
        words = sorted(keys)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = wide = 1  # where to look for room for one child, and for several
        stack = [(0, 0, len(words), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            if len(words[lo]) == depth:
                value[node] = keys[words[lo]]
                lo += 1
            if lo == hi:
                continue
            parts, at = [], lo
            while at < hi:
                byte, end = words[at][depth], at + 1
                while end < hi and words[end][depth] == byte:
                    end += 1
                parts.append((byte, at, end))
                at = end
            if max(free, wide) + 2048 > len(check):
                base += [0] * len(base)
                value += [-1] * len(value)
                check += [-1] * len(check)
            lowest = parts[0][0]
            if len(parts) == 1:
                while check[free] != -1 or free <= lowest:
                    free += 1
                start = free - lowest
            else:
                start, tried = max(1, wide - lowest), 0
                while any(check[start + b] != -1 for b, _, _ in parts):
                    start += 1
                    tried += 1
                    if start + 512 > len(check):
                        base += [0] * len(base)
                        value += [-1] * len(value)
                        check += [-1] * len(check)
                if tried > 32:  # the region is nearly full: go on behind it
                    wide = start + lowest
            base[node] = start
            for byte, s, e in parts:
                check[start + byte] = node
                stack.append((start + byte, s, e, depth + 1))
        top = max(k for k, c in enumerate(check) if c != -1) + 1
        pad = [0] * 256
        return cls(*(np.array(x, np.int32) for x in (base[:top] + pad, check[:top] + [-1] * 256, value[:top] + [-1] * 256)))

    def matches(self, text: np.ndarray, starts: np.ndarray, limit: np.ndarray):
        """(start, end, id) of every piece found from the given starts, shortest first; limit: where each start's word ends."""
        found = []
        state = np.zeros(len(starts), np.int32)
        at = starts
        depth = 0
        while len(at):
            inside = at + depth < limit
            at, state, limit = at[inside], state[inside], limit[inside]
            down = self.base[state] + text[at + depth]
            ok = (self.check[down] == state) & (down > 0)
            at, state, limit = at[ok], down[ok], limit[ok]
            depth += 1
            ids = self.value[state]
            hit = ids >= 0
            if hit.any():
                found.append((at[hit], np.full(int(hit.sum()), depth), ids[hit]))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        s, n, i = (np.concatenate(x) for x in zip(*found, strict=True))
        return s, s + n, i.astype(np.int64)


@dataclass(frozen=True)
class PieceModel:
    trie: Trie
    scores: np.ndarray
    unknown: int
    byte_ids: np.ndarray  # by byte value
    piece_bytes: list[bytes]  # what each id decodes to

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
        out = []
        for i, name in enumerate(names):
            if p.is_byte(i):
                out.append(bytes([int(name[3:5], 16)]))
            elif p.is_control(i):
                out.append(b"")
            else:
                out.append((UNKNOWN_TEXT if p.is_unknown(i) else name.replace(MARK, " ")).encode())
        byte_ids = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces with a marker inside are not supported")
        return cls(Trie.of({names[i].encode(): i for i in plain}), np.array([p.get_score(i) for i in range(n)]), p.unk_id(), byte_ids, out)

    @property
    def unknown_score(self) -> float:
        return float(self.scores.min()) - UNKNOWN_PENALTY

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (with their markers) in one line, and each word's number of ids."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        total = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.searchsorted(total, np.arange(0, int(total[-1]), CHUNK), side="left").tolist() + [len(words)]
        cuts = sorted({0, *cuts})
        parts = [self._segment(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def _segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if not len(text):
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        chars = np.flatnonzero((text & 0xC0) != 0x80)
        width = np.diff(np.append(chars, len(text)))
        s, e, ids = self.trie.matches(text, chars, ends[word[chars]])
        single = np.zeros(len(text), bool)
        width_at = np.zeros(len(text), np.int64)
        width_at[chars] = width
        single[s[e - s == width_at[s]]] = True
        lone = chars[~single[chars]]
        s, e = np.concatenate([s, lone]), np.concatenate([e, lone + width_at[lone]])
        ids = np.concatenate([ids, np.full(len(lone), self.unknown)])
        score = np.where(ids == self.unknown, self.unknown_score, self.scores[ids])
        depth = e - begins[word[s]]  # where a match ends, counted from its word's start
        # By offset, then end, then longest first; pieces and characters are shorter than 64 bytes.
        order = np.argsort((depth << 34) | (e << 6) | (63 - (e - s)))
        s, e, ids, score, depth = s[order], e[order], ids[order], score[order], depth[order]
        best = np.zeros(len(text) + 1)  # at a word's start it is read as 0, see below
        from_, by = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
        starts_word = np.zeros(len(text) + 1, bool)
        starts_word[begins[sizes > 0]] = True
        cuts = np.concatenate([[0], np.flatnonzero(depth[1:] != depth[:-1]) + 1, [len(depth)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s1, e1 = s[a:b], e[a:b]
            value = np.where(starts_word[s1], 0.0, best[s1]) + score[a:b]
            first = np.concatenate([[True], e1[1:] != e1[:-1]])
            heads = np.flatnonzero(first)
            top = np.maximum.reduceat(value, heads)
            group = np.cumsum(first) - 1
            wins = np.flatnonzero(value == top[group])
            lead = wins[np.concatenate([[True], group[wins][1:] != group[wins][:-1]])]
            best[e1[lead]], from_[e1[lead]], by[e1[lead]] = value[lead], s1[lead], a + lead
        # A word's end is the next one's start: both share a position, so what ends there was kept in from_ and by.
        chosen = np.full(len(text), -1, np.int64)
        active = np.flatnonzero(sizes > 0)
        at, start = ends[active], begins[active]
        while len(at):
            m = by[at]
            at = from_[at]
            chosen[at] = m
            more = at > start
            at, start = at[more], start[more]
        match = chosen[chosen >= 0]
        owner = word[s[match]]
        unknown = ids[match] == self.unknown
        n = np.where(unknown, e[match] - s[match], 1)
        total = np.cumsum(n)
        inner = np.arange(int(total[-1])) - np.repeat(total - n, n)
        out = np.repeat(ids[match], n)
        raw = np.repeat(unknown, n)
        out[raw] = self.byte_ids[text[(np.repeat(s[match], n) + inner)[raw]]]
        return out, np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one line, and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # A run of spaces belongs to the word behind it; without one, a chunk is a marker and a word.
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = np.asarray(pc.or_(odd, pc.equal(pc.binary_length(texts), 0)))
        even_at = np.flatnonzero(~odd)
        lists = pc.split_pattern(texts.take(pa.array(even_at)), " ")
        flat = pc.list_flatten(lists)
        count = np.zeros(len(texts), np.int64)
        count[even_at] = np.asarray(pc.list_value_length(lists))
        coded = flat.dictionary_encode()
        marker = MARK.encode()
        words = [marker + w for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
        codes = np.asarray(coded.indices, np.int64)
        if odd.any():
            more: dict[bytes, int] = {}
            parts, owner = [], []
            for k in np.flatnonzero(odd).tolist():
                text = texts[k].as_py()
                chunks = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK + text.replace(" ", MARK))) if text else []
                count[k] = len(chunks)
                parts += [more.setdefault(c.encode(), len(words) + len(more)) for c in chunks]
                owner += [k] * len(chunks)
            words += more
            place = np.concatenate([np.repeat(even_at, count[even_at]), np.array(owner, np.int64)])
            codes = np.concatenate([codes, np.array(parts, np.int64)])[np.argsort(place, kind="stable")]
        table, sizes = self.segment(words)
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(first[codes] - (ends - n), n) + np.arange(total)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])])

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of lists of ids laid in one line."""
        table = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        sizes = np.fromiter(map(len, self.piece_bytes), np.int64, len(self.piece_bytes))
        first = np.cumsum(sizes) - sizes
        n = sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = table[np.repeat(first[ids] - (ends - n), n) + np.arange(total)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[s + (raw[s : s + 1] == b" ") : e] if e > s else b"" for s, e in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def encode(docs: DataFrame, model: PieceModel, column: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of docs with an array<int> of token ids added."""
    fields = [f for f in docs.schema.fields if f.name != ids]
    names = [f.name for f in fields]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary: its size is fixed

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, column, SLICE):
                flat, counts = sent.value.encode_all(part.column(column))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], [*names, ids])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{ids}` array<int>"])
    return docs.select(*names).mapInArrow(common.frugal(run), shape)


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """The rows with the text of their token ids added; null ids give the empty text."""
    fields = [f for f in rows.schema.fields if f.name != column]
    names = [f.name for f in fields]
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                texts = sent.value.decode_all(np.asarray(pc.list_flatten(lists), np.int64), counts)
                texts = [t.decode("utf-8", "replace") for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, column])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{column}` string"])
    return rows.select(*names).mapInArrow(common.frugal(run), shape)


def summary(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip: digests of encoding and decoding in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = sent.value
        is_byte = np.zeros(len(held.piece_bytes), np.int64)
        is_byte[held.byte_ids] = 1
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                ids, counts = held.encode_all(part.column("text"))
                back = held.decode_all(ids, counts)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                ends = np.cumsum(counts)
                bytes_so_far = np.concatenate([[0], np.cumsum(is_byte[ids])])
                laid = ids.astype("<u4")
                crc = [zlib.crc32(laid[s:e].tobytes()) for s, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), pa.array(bytes_so_far[ends] - bytes_so_far[ends - counts]), pa.array(crc, pa.int64()),
                     pa.array([(t or b"") == b for t, b in zip(texts, back, strict=True)])],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(common.frugal(run), "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    return summary(common.read(spark, sf_dir, "documents"), model)
