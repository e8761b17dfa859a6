"""Best-fit packing: bounded-space online best-fit with the open bins in a bitset.

Documents become token ids and an end id; only those longer than a sequence are
cut. Pieces are placed one after another into the open bin that they fill best.
Open bins are kept by free space, and one big integer has a bit for each free
space that some bin has: the best bin for a piece is its lowest bit at or above
the piece's length. With ``open_bins`` open, the fullest closes first.

Each partition packs its own rows: no shuffle of texts. Pieces in bins that are
still open at a partition's end go on, without their texts, to a second round of
fewer packers, so a partition does not cost half-full sequences of its own.

Tokens come from a cache: white space parts tokens, so each distinct word of a
batch is encoded once and the ids are gathered by word number.

Defined cases: null text is empty and gives one piece, the end id; a null doc_id
is packed like any other; repeated rows are packed as often as they come; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common

SLICE = 1 << 22


@dataclass(frozen=True)
class PackingConfig:
    tokenizer: str  # path of a tokenizers file whose pre-tokenizer parts at white space
    length: int = 2048
    end_id: int = 0
    open_bins: int = 256
    cached_words: int = 200_000
    #: Open pieces of so many partitions meet in one packer of the second round.
    merged: int = 64


#: The one splitting rule under which units may be encoded alone (fixed value: the tokenizer file's own pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of one run of Latin letters with ASCII marks before and behind it. No apostrophe and no digit, which part words in other ways.
MARK = r"[!-&(-/:-@\[-`{-~]"
UNITS = f"^(?P<lead>{MARK}*)(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<tail>{MARK}*)$"
TOGETHER = 2000


class Encoder:
    """Token ids of whole texts, through the distinct words of a batch.

    White space parts tokens, and so do a run of letters and the marks around it:
    such a word is up to three units (marks, letters in lower case, marks), whose
    ids follow one another. Units are encoded once and kept, up to ``cached`` of
    them, as ranges of one array of ids. All other words, those with a special
    token in them too, are units as they stand and go through the tokenizer as it is.
    """

    def __init__(self, path: str, cached: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = self.ends = None
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        exact = not any(t["normalized"] or t["content"] != "".join(t["content"].split()) for t in spec.get("added_tokens", []))
        if spec["model"]["type"] == "BPE" and suffix and exact and steps and steps[0].get("pattern") == {"Regex": SPLIT}:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            # Units are in lower case and parted already: neither patterns nor special tokens have to be looked for.
            steps = [{"type": "WhitespaceSplit"}, *steps[1:]]
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
            self.bare = Tokenizer.from_str(json.dumps(spec))
        self.cached = cached
        self.known: dict[str, int] = {}
        self.ids, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in one line, and each word's number of ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain units as one text, which costs less than a call for each; the ends of words part the ids again."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(units) else self._each(units)

    def units(self, units: list[str], plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the number of them for each unit; the first ``plain`` units are plain."""
        number = np.fromiter((self.known.get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(number < 0)
        if len(new):
            at = int(np.searchsorted(new, plain))
            one, rest = [units[k] for k in new[:at].tolist()], [units[k] for k in new[at:].tolist()]
            found = [self._together(one[k : k + TOGETHER]) for k in range(0, len(one), TOGETHER)]
            if rest:
                found.append(self._each(rest))
            number[new] = len(self.size) + np.arange(len(new))
            ids, size = (np.concatenate([old, *(f[k] for f in found)]) for k, old in enumerate((self.ids, self.size)))
            if len(size) <= self.cached:
                self.known.update(zip((units[k] for k in new.tolist()), number[new].tolist(), strict=True))
                self.ids, self.size = ids, size
        else:
            ids, size = self.ids, self.size
        return ids, (np.cumsum(size) - size)[number], size[number]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the number of them for each of the distinct words."""
        if self.bare is None:
            return self.units(words.to_pylist(), 0)
        parts = pc.extract_regex(words, UNITS)
        whole = np.asarray(pc.is_null(parts))
        for token in self.special:
            whole = whole | np.asarray(pc.match_substring(words, token))
        lead, stem, tail = (pc.if_else(pa.array(whole), "", pc.struct_field(parts, k)) for k in range(3))
        plain = pa.concat_arrays([lead, pc.utf8_lower(stem), tail]).dictionary_encode()
        n, other = len(plain.dictionary), words.filter(pa.array(whole))
        ids, first, size = self.units(plain.dictionary.to_pylist() + other.to_pylist(), n)
        code = np.asarray(plain.indices).reshape(3, len(words)).astype(np.int64).T
        # Three units a word; a word that is a unit of its own stands in the first place. The empty unit has no ids.
        held = size[code]
        begin = first[code]
        held[whole], begin[whole, 0], held[whole, 0] = 0, first[n:], size[n:]
        return ids[ranges(begin.ravel(), held.ravel())], *bounds(held.sum(axis=1))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one line, and each text's number of ids."""
        flat, counts = common.split_words(texts)
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices)
        ids, first, size = self.words(coded.dictionary)
        n = size[codes]
        ends = np.append(0, np.cumsum(n))
        return ids[ranges(first[codes], n)], np.diff(ends[np.append(0, np.cumsum(counts))])


def bounds(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(size) - size, size


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range behind the other."""
    before, _ = bounds(size)
    at = np.repeat((first - before).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return at


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cached: int) -> Encoder:
    """One encoder for each Python worker, with its cache."""
    if (path, cached) not in _ENCODERS:
        _ENCODERS[path, cached] = Encoder(path, cached)
    return _ENCODERS[path, cached]


class Packer:
    """Bounded-space online best-fit. ``place`` gives a bin number and an offset."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.most = length, open_bins
        self.by_space: dict[int, list[int]] = {}
        self.bits, self.n_open, self.next = 0, 0, 0
        self.closed: list[int] = []  # bins closed since last asked

    def _put(self, space: int, number: int) -> None:
        if space == 0:
            self.closed.append(number)
            self.n_open -= 1
            return
        held = self.by_space.setdefault(space, [])
        held.append(number)
        self.bits |= 1 << space

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        number = held.pop()
        if not held:
            del self.by_space[space]
            self.bits &= ~(1 << space)
        return number

    def place(self, size: int) -> tuple[int, int]:
        if size == self.length:  # fills a bin alone: it takes no open place
            self.closed.append(self.next)
            self.next += 1
            return self.next - 1, 0
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open >= self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.n_open -= 1
            number, space = self.next, self.length
            self.next += 1
            self.n_open += 1
        self._put(space - size, number)
        return number, self.length - space


FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces_of(part: pa.RecordBatch, config: PackingConfig) -> list[np.ndarray | list]:
    """Columns of FIELDS for the texts of a batch."""
    ids, counts = encoder(config.tokenizer, config.cached_words).texts(part.column("text"))
    ends = np.cumsum(counts)
    end = np.array([config.end_id], "<u4")
    docs, piece, start, length, crc = [], [], [], [], []
    ids = ids.astype("<u4", copy=False)
    for doc, s, e in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
        whole = np.concatenate([ids[s:e], end])
        for k, at in enumerate(range(0, len(whole), config.length)):
            cut = whole[at : at + config.length]
            docs.append(doc)
            piece.append(k)
            start.append(at)
            length.append(len(cut))
            crc.append(zlib.crc32(cut.tobytes()))
    return [docs, piece, start, length, crc]


def packed_rows(columns: list, numbers: list[int], offsets: list[int]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
        [*NAMES, "sequence_id", "offset"],
    )


def pack_stream(parts, config: PackingConfig, first_id: int, keep_open: bool):
    """Pack lists of piece columns; rows of closed bins come at once, those of open bins at the end.

    keep_open: the rows of bins still open get their place too; else a null one.
    """
    packer = Packer(config.length, config.open_bins)
    waiting: dict[int, list[tuple]] = {}
    for columns in parts:
        done: list[tuple] = []
        for row in zip(*columns, strict=True):
            number, offset = packer.place(row[3])
            waiting.setdefault(number, []).append((*row, first_id + number, offset))
            for closed in packer.closed:
                done += waiting.pop(closed)
            packer.closed.clear()
        if done:
            *rest, numbers, offsets = map(list, zip(*done, strict=True))
            yield packed_rows(rest, numbers, offsets)
    left = [r for rows in waiting.values() for r in rows]
    if left:
        *rest, numbers, offsets = map(list, zip(*left, strict=True))
        yield packed_rows(rest, numbers, offsets) if keep_open else packed_rows(rest, [None] * len(left), [None] * len(left))


def pack(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """One row per piece: FIELDS, sequence_id, offset."""
    spark = docs.sparkSession
    shape = FIELDS + ", sequence_id long, offset long"

    def first(batches):
        parts = (pieces_of(p, config) for b in batches for p in common.slices(b, "text", SLICE))
        yield from pack_stream(parts, config, TaskContext.get().partitionId() << 32, False)

    def second(batches):
        parts = ([b.column(n).to_pylist() for n in NAMES] for b in batches)
        yield from pack_stream(parts, config, (1 << 62) + (TaskContext.get().partitionId() << 32), True)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = common.stored(source.mapInArrow(common.frugal(first), shape), "packed")
    packers = max(1, round(source.rdd.getNumPartitions() / config.merged))
    # Longest first within a packer: best-fit leaves least behind that way.
    rest = once.where("sequence_id IS NULL").select(*NAMES)
    rest = rest.repartition(packers).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return once.where("sequence_id IS NOT NULL").unionByName(rest.mapInArrow(common.frugal(second), shape))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    config = PackingConfig(public_tokenizers.path("word_bpe_49k.json"))
    return pack(common.read(spark, sf_dir, "documents"), config)
