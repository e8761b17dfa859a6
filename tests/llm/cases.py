"""Rows with everything that an operator has to bear."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STEMS = "the of and to in er on th ed re st ing ion be or ti ea ha nd le".split()
FOREIGN = {
    "de": "der die das und sch ein ung keit heit ver ge lich ß ä ö über".split(), "fr": "le la les eau é è tion que ment ai oi un eux oux ç".split(),
    "es": "el los que ción mente ado ar ez ñ ó ía para con esta rr".split(),
}


def prose(rng: random.Random, n: int, stems=STEMS) -> str:
    words = ["".join(rng.choices(stems, k=rng.choice((1, 1, 2, 3)))) for _ in range(n)]
    return "".join(w + rng.choice((" ", " ", " ", " ", ".\n", ", ")) for w in words).strip()


def documents(n: int = 60, seed: int = 7) -> list[tuple]:
    """Prose with copies, near copies, shared passages, nulls, blanks, ties and one very long text."""
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, 40)
    for k in range(n):
        lang = rng.choice(["en", "en", *FOREIGN])
        text = prose(rng, rng.choice((3, 12, 13, 14, 60, 200)), FOREIGN.get(lang, STEMS))
        if k % 5 == 0:
            text += " " + passage + " " + prose(rng, 5)
        if k % 11 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        if k % 13 == 4 and rows and rows[k - 1][1]:
            words = rows[k - 1][1].split(" ")
            words[len(words) // 2 :: 50] = ["changed"] * len(words[len(words) // 2 :: 50])
            text = " ".join(words)
        rows.append((k, text, lang, f"src{k % 3}", len(text)))
    rows += [
        (n, None, "en", None, None), (n + 1, "", None, "s", 0), (n + 2, " \t\n ", "en", "s", 4), (n + 3, "one", "en", "s", 3), (n + 4, "one two", None, "s", 7),
        (None, rows[0][1], "en", "s", 1), (None, None, None, None, None), (n + 5, prose(rng, 6_000), "en", "s", 1), (n + 6, "x" * 200_000, "en", "s", 1),
        rows[2], rows[2], (2, "another text under the id of a document that is there already, as long as it needs to be to have a window", "en", "s", 1),
        (n + 7, "  café \U0001f389 İı ﬁ é naïve\x00zero", "fr", "s", 1), (n + 8, "!!! 123 ???", "de", "s", 11),
    ]
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


#: Columns that operators use themselves.
CLASHING = ["n_words", "kept", "spans", "fp", "version", "_id", "_version", "_fact", "_key", "lang_pred", "score", "ids", "words", "key", "tile", "block", "hash", "anchor", "sequence_id", "n_removed", "answer"]


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def as_rows(df, *columns):
    """Rows as a sorted list of texts."""
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())
