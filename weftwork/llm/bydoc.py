"""Bring small facts about documents to their texts without dealing out every text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common


def fresh(names: list[str], stem: str) -> str:
    """A column name that none of ``names`` is; Spark's names don't heed case."""
    held, name = {n.lower() for n in names}, f"_{stem}"
    while name in held:
        name = f"_{name}"
    return name


def answered(
    docs: DataFrame, facts: DataFrame, fact: str, answer: Callable[[pa.RecordBatch, list], pa.RecordBatch], shape: str,
    doc_bits: int = 1 << 24, most_bytes: int = 1 << 21,
) -> DataFrame:
    """``answer`` over all rows of docs with each row's fact, None where it has none.

    facts: (doc_id, version, ``fact``), at most one row for each pair, neither part
    null; version is ``common.text_hash``, which tells rows of one doc_id apart. Only
    texts that a bitmap of those keys lets through are dealt out to meet their
    fact; the others are answered where they are read. A false yes of the bitmap
    meets no fact and is answered as such. The stored facts and the bitmap outlive
    the innermost open scope, for the result reads them.
    """
    names = docs.columns
    key_name, fact_name, id_name, version_name = (fresh(names, stem) for stem in ("key", "fact", "id", "version"))
    facts = common.stored(facts.select("doc_id", "version", fact), "facts", outlives=True)
    key = F.col("doc_id").cast("long").bitwiseXOR(F.col("version"))
    bitmap = common.sent(docs.sparkSession, common.bitmap_of(facts.select(key.alias("key")), "key", doc_bits), outlives=True)
    marked = docs.withColumn(key_name, F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(common.text_hash()), F.lit(-1).cast("long")))
    same = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def let_through(batch: pa.RecordBatch) -> np.ndarray:
        known = np.asarray(pc.and_(pc.is_valid(batch.column("doc_id")), pc.is_valid(batch.column("text"))))
        return known & common.in_bitmap(bitmap.value, np.asarray(batch.column(key_name)).view(np.uint64))

    def apart(batches):
        for batch in batches:
            for part in common.slices(batch.filter(pa.array(~let_through(batch))).select(names), "text", most_bytes):
                yield answer(part, [None] * part.num_rows)

    def through(batches):
        for batch in batches:
            yield batch.filter(pa.array(let_through(batch))).select(names)

    def met(batches):
        for batch in batches:
            for part in common.slices(batch, "text", most_bytes):
                yield answer(part.select(names), part.column(fact_name).to_pylist())

    held = facts.select(F.col("doc_id").alias(id_name), F.col("version").alias(version_name), F.col(fact).alias(fact_name))
    # Never a broadcast: with an exchange between them the two Python steps don't stand in one task with a worker each.
    joined = marked.mapInArrow(common.frugal(through), same).join(
        held.hint("merge"), (F.col("doc_id") == F.col(id_name)) & (common.text_hash() == F.col(version_name)), "left"
    ).drop(id_name, version_name)
    return marked.mapInArrow(common.frugal(apart), shape).unionByName(joined.mapInArrow(common.frugal(met), shape))
