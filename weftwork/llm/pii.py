"""PII: information-theoretic sanitisation.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers found in the texts (the base spans). Keys and passwords are found by
their information: runs of letters and digits whose length times the entropy of
their characters reaches ``secret_bits``; they are protected too (kind secret),
but no term is held against them. A term discloses an entity as far as it points
to it: with documents counted over the whole corpus,

    disclosure(e; t) = PMI(e, t) / IC(e) = log(N n(e,t) / n(e) n(t)) / log(N / n(e)),

where n(e,t) counts the documents that have t within ``reach`` words of e. It is
1 where every document with t has e beside it. A term that at least
``least_documents`` documents have beside one entity is removed from a
``remove`` disclosure on and generalised from ``generalise`` on, in every
document of the corpus that has it. The query and the pipeline ask for no such
support (``ALL_PAIRS``): their thresholds alone decide, for rare entities too.

Few passes read the texts; none deals them out. n(t) is at least the number of
documents that have t beside some entity, and at least the number that have it in
an eighth of the corpus. Only terms that these bounds let reach a threshold are
counted over the whole corpus: the bounds spare counting, they decide nothing. Which words
to count, and which to look up, goes to the tasks as a bitmap of a fixed size; its
false answers fall away in exact joins on the term. Words are lower-cased one by
one everywhere, so one that grows by it is the same word in all passes.

Defined cases: a null text is empty; a null doc_id keeps its base spans and
counts in the corpus but gets no term spans; repeated rows count as often as
they come and get the same spans; rows of one doc_id with different texts are
told apart; an entity that all documents have discloses nothing; an empty table
gives no rows; extra columns are ignored by the query and kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import bydoc, common

#: Kinds in the order in which spans with the same start are written; the last three are the method's.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove", "secret")
BASE, SECRET = 4, 6

# The base patterns. An address is found from its "@": what stands
# before it is the longest run of LOCAL characters, what follows matches DOMAIN.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+")

TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class PiiConfig:
    reach: int = 6
    shortest_term: int = 3
    least_documents: int = 3
    generalise: float = 0.8
    remove: float = 0.95
    secret_bits: float = 48.0
    bits: int = 1 << 23


#: One text of so many gives a lower bound of the counts of terms.
BOUND_PART = 8

#: Every pair of an entity and a term counts, however few documents have it.
ALL_PAIRS = PiiConfig(least_documents=1)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+, in time linear in the text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or 0) <= 255

    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for k, kind in enumerate((ips, cards, phones), 1):
            found += [(s, k, e) for s, e in kind(text)]
    return sorted(found)


def secrets(text: str, base: list[tuple[int, int, int]], least_bits: float) -> list[tuple[int, int, int]]:
    """Runs of letters and digits, two digits and four letters at least, with ``least_bits`` of information; none that a base span touches."""
    found = []
    for m in RUN.finditer(text):
        counts = Counter(m[0])
        n, digits = len(m[0]), sum(counts[d] for d in "0123456789")
        if 2 <= digits <= n - 4 and sum(c * log2(n / c) for c in counts.values()) >= least_bits:
            found.append((m.start(), SECRET, m.end()))
    return clear_of(found, base) if found and base else found


def clear_of(places: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The places that no span touches; both are in order. One step through each: spans nearly follow one another, their ends are summed up."""
    found, k, last = [], 0, -1
    for p in places:
        while k < len(spans) and spans[k][0] < p[2]:
            last = max(last, spans[k][2])
            k += 1
        if last <= p[0]:
            found.append(p)
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def words_of(text: str) -> set[str]:
    """The distinct words, each lower-cased by itself."""
    return {w.lower() for w in set(TERM.findall(text))}


def beside(text: str, spans: list[tuple[int, int, int]], config: PiiConfig) -> set[tuple[int, str]]:
    """(entity, term): each entity with an empty term, and with the terms among the ``reach`` words on either side, however far off; none that a span touches."""
    from xxhash import xxh64_intdigest

    found = set()
    words = [(m.start(), 0, m.end()) for m in TERM.finditer(text)]
    free = set(clear_of(words, spans))
    starts, ends = [w[0] for w in words], [w[2] for w in words]
    for s, kind, e in spans:
        entity = np.uint64(xxh64_intdigest(f"{KINDS[kind]}:{text[s:e].lower()}", 42)).view(np.int64).item()
        found.add((entity, ""))
        before, after = bisect_right(ends, s), bisect_left(starts, e)
        for w in (*words[max(0, before - config.reach) : before], *words[after : after + config.reach]):
            if w[2] - w[0] >= config.shortest_term and w in free:
                found.add((entity, text[w[0] : w[2]].lower()))
    return found


def find(docs: DataFrame, config: PiiConfig) -> DataFrame:
    """doc_id, version, counts of each base kind, base_sha256, base spans and secrets, and what stands beside the base spans."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = base_spans(text or "")
                    kinds = [k for _, k, _ in spans]
                    near = beside(text, spans, config) if spans else ()
                    whole = sorted(spans + secrets(text or "", spans, config.secret_bits))
                    rows.append((
                        *(kinds.count(k) for k in range(BASE)), hashlib.sha256(written(spans).encode()).hexdigest(),
                        [{"start": s, "kind": k, "end": e} for s, k, e in whole], [{"entity": a, "term": t} for a, t in near],
                    ))
                columns = list(zip(*rows, strict=True))
                triple = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
                pair = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), *(pa.array(c, pa.int64()) for c in columns[:BASE]),
                     pa.array(columns[BASE], pa.string()), pa.array(columns[BASE + 1], triple), pa.array(columns[BASE + 2], pair)],
                    ["doc_id", "version", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "beside"],
                )

    return docs.mapInArrow(
        common.frugal(run), "doc_id long, version long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "spans array<struct<start:int,kind:int,end:int>>, beside array<struct<entity:long,term:string>>",
    )


class Lookup:
    """Which lower-case words the bitmap has; remembers a bounded number of answers."""

    def __init__(self, bitmap: np.ndarray, most: int = 100_000) -> None:
        self.bitmap, self.most, self.known = bitmap.tobytes(), most, {}
        self.mask = len(bitmap) * 8 - 1

    def among(self, words: set[str]) -> list[str]:
        from xxhash import xxh64_intdigest

        known, bitmap, mask, found = self.known, self.bitmap, self.mask, []
        for w in words:
            yes = known.get(w)
            if yes is None:
                at = xxh64_intdigest(w, 42) & mask
                yes = bitmap[at >> 3] >> (at & 7) & 1
                if len(known) < self.most:
                    known[w] = yes
            if yes:
                found.append(w)
        return found


def document_counts(docs: DataFrame, bitmap, flush: int = 100_000) -> DataFrame:
    """(term, n): in how many texts each word comes that the bitmap lets through; added up in each task first."""

    def run(batches):
        lookup, counts = Lookup(bitmap.value), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for part in common.slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    if text:
                        counts.update(lookup.among(words_of(text)))
                if len(counts) > flush:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(common.frugal(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def term_places(docs: DataFrame, bitmap, config: PiiConfig) -> DataFrame:
    """(doc_id, version, term, start, end): each place, clear of all other spans, of a word that the bitmap lets through."""

    def run(batches):
        lookup = Lookup(bitmap.value)
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for doc, version, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True):
                    if text and (hit := set(lookup.among(words_of(text)))):
                        places = [(m.start(), 0, m.end()) for m in TERM.finditer(text) if m[0].lower() in hit]
                        spans = base_spans(text)
                        spans = sorted(spans + secrets(text, spans, config.secret_bits))
                        rows += [(doc, version, text[s:e].lower(), s, e) for s, _, e in (clear_of(places, spans) if spans else places)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "version", "term", "start", "end"])

    return docs.mapInArrow(common.frugal(run), "doc_id long, version long, term string, start int, end int")


def disclosing_terms(found: DataFrame, docs: DataFrame, config: PiiConfig) -> DataFrame:
    """(term, kind number, disclosure): terms beyond a threshold, with their greatest disclosure."""
    n = F.lit(float(max(1, found.count())))
    pairs = found.select(F.explode("beside").alias("x")).select("x.entity", "x.term").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    pairs = common.stored(pairs.where(F.col("both") >= config.least_documents), "pairs")
    of_entity = pairs.where("term = ''").select("entity", F.col("both").alias("n_entity"))
    # Documents that have the term beside some entity: no more than those that have it at all.
    met = found.select(F.explode(F.array_distinct(F.transform("beside", lambda x: x["term"]))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_met"))

    def disclosure(n_term: str) -> Column:
        ic = F.log(n / F.col("n_entity"))
        return F.when(ic > 0, F.log(n * F.col("both") / (F.col("n_entity") * F.col(n_term))) / ic)

    # The slack keeps what the bound and the final value round differently; the final value decides.
    able = pairs.where("term <> ''").join(of_entity, "entity").join(met, "term").where(disclosure("n_met") >= config.generalise - 1e-9)
    able = common.stored(able.select("term", "both", "n_entity"), "able")

    def counted(some: DataFrame) -> DataFrame:
        bitmap = common.sent(docs.sparkSession, common.bitmap_of(able.select(F.xxhash64("term").alias("key")).distinct(), "key", config.bits))
        return document_counts(some, bitmap).withColumnRenamed("n", "n_term")

    part = counted(docs.where(F.pmod(F.xxhash64("text"), F.lit(BOUND_PART)) == 0))
    able = able.join(part, "term", "left").withColumn("n_term", F.coalesce("n_term", F.lit(1))).where(disclosure("n_term") >= config.generalise - 1e-9)
    able = common.stored(able.select("term", "both", "n_entity"), "able")
    of_term = counted(docs)
    return (
        able.join(of_term, "term").withColumn("disclosure", disclosure("n_term"))
        .groupBy("term").agg(F.max("disclosure").alias("disclosure"))
        .where(F.col("disclosure") >= config.generalise)
        .select("term", F.when(F.col("disclosure") >= config.remove, 5).otherwise(4).alias("kind"), "disclosure")
    )


def spans_of(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """doc_id, version, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of docs."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", common.text_hash())
    found = common.stored(find(known, config), "found")
    with common.passing(spark):
        flagged = common.stored(disclosing_terms(found, known, config), "flagged")
        bitmap = common.sent(spark, common.bitmap_of(flagged.select(F.xxhash64("term").alias("key")), "key", config.bits))
        places = term_places(known.where("doc_id IS NOT NULL"), bitmap, config).join(flagged, "term")
        places = places.select("doc_id", "version", F.struct("start", "kind", "end").alias("place"))
        by_doc = common.stored(places.groupBy("doc_id", "version").agg(F.collect_set("place").alias("places")), "places", outlives=True)
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "places")
    joined = found.drop("beside").join(by_doc, (F.col("doc_id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("places", none)))).drop("_id", "_version", "places")


def replaced(text: str, spans: list[dict]) -> str:
    """The text with its spans generalised to a mark of their kind, or taken out; overlapping spans become the first's mark."""
    out, last = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], x["kind"], x["end"])):
        if s["start"] < last:
            last = max(last, s["end"])
            continue
        out.append(text[last : s["start"]])
        kind = KINDS[s["kind"]]
        out.append("" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]")
        last = s["end"]
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """The rows of docs with their text sanitised. A row without doc_id has its base spans and secrets replaced."""
    names = docs.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def answer(part: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        texts = []
        for doc, text, found in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), spans, strict=True):
            if doc is None and text:
                base = base_spans(text)
                found = [{"start": s, "kind": k, "end": e} for s, k, e in sorted(base + secrets(text, base, config.secret_bits))]
            texts.append(replaced(text, found) if found else text)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names], names)

    with common.passing(docs.sparkSession):
        facts = spans_of(docs, config).where("doc_id IS NOT NULL AND version IS NOT NULL AND size(spans) > 0").dropDuplicates(["doc_id", "version"])
        return bydoc.answered(docs, facts, "spans", answer, shape)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return spans_of(common.read(spark, sf_dir, "documents"), ALL_PAIRS).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == SECRET)).cast("long").alias("n_secret"),
        F.size(F.filter("spans", lambda s: (s["kind"] < BASE) | (s["kind"] == SECRET))).cast("long").alias("n_protected"),
    )
