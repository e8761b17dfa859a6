"""Exact top-k search over binary codes: incremental multi-index hashing.

A vector's code has a bit for the sign of each of its first ``bits`` components.
Codes are cut into segments. If two codes differ in at most m (r + 1) - 1 bits,
then one of their m segments differs in at most r bits. So a query looks at the
codes that share a segment with it exactly, then within one bit, and so on, and
stops once its k-th verified distance is covered by that bound: nothing unseen
can be nearer. Ties go to the smaller id.

Equal codes are met first: of each code only the k + 1 smallest ids can be among
the k nearest (one may be the query itself), found by a group limit that runs
before rows are dealt out. Distinct codes are dealt into blocks of bounded size,
each with its own index; all queries pass by each block in batches and each
block gives its k nearest. The queries are a stated set; no pair of rows is
emitted but those k.

Defined cases: null vectors have no code and are neither queries nor results; a
missing or null component counts as not positive; a null id is left out; rows
with the same id count as one per code; a query is never its own result; fewer
than k other rows give fewer results; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm import common


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    bits: int = 64
    block_rows: int = 16_384
    most_tasks: int = 20_000


def code_of(vector: str, bits: int):
    """long: bit i says whether component i is positive."""
    flags = [F.when(F.get(vector, i) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    found = flags[0]
    for f in flags[1:]:
        found = found.bitwiseOR(f)
    return found


def coded(vectors: DataFrame, config: SearchConfig, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code) of every row with an id and a vector."""
    if not 1 <= config.bits <= 64:
        raise ValueError("codes have 1 to 64 bits")
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), code_of(vector, config.bits).alias("code")
    )


class MultiIndex:
    """Distinct codes by the value of each segment."""

    def __init__(self, codes: np.ndarray, ids: list[np.ndarray], bits: int) -> None:
        self.codes, self.bits = codes, bits
        self.sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        # About log2(n) bits a segment: a segment's value then has about one code.
        self.m = max(1, min(bits, round(bits / max(1.0, np.log2(max(2, len(codes)))))))
        edges = [bits * j // self.m for j in range(self.m + 1)]
        self.segments = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            value = (codes >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            order = np.argsort(value, kind="stable")
            distinct, start = np.unique(value[order], return_index=True)
            self.segments.append((low, high - low, distinct, np.append(start, len(codes)), order))

    def nearest(self, query: np.uint64, own: int, k: int) -> list[tuple[int, int]]:
        """The k smallest (distance, id) of all ids but ``own``."""
        gaps = []
        for low, width, distinct, _, _ in self.segments:
            part = (query >> np.uint64(low)) & np.uint64((1 << width) - 1)
            gaps.append(np.bitwise_count(distinct ^ part))
        seen = np.zeros(len(self.codes), bool)
        best: list[tuple[int, int]] = []
        for radius in range(max((w for _, w, _, _, _ in self.segments), default=0) + 1):
            fresh = []
            for (_, _, _, start, order), gap in zip(self.segments, gaps, strict=True):
                for g in np.flatnonzero(gap == radius).tolist():
                    fresh.append(order[start[g] : start[g + 1]])
            if fresh:
                at = np.unique(np.concatenate(fresh))
                at = at[~seen[at]]
                seen[at] = True
                distance = np.bitwise_count(self.codes[at] ^ query).astype(np.int64)
                if len(best) >= k:
                    near = distance <= best[-1][0]
                    at, distance = at[near], distance[near]
                if len(at) > 4 * k:  # no further than the distance that covers k + 1 ids
                    room = np.cumsum(np.bincount(distance, weights=self.sizes[at], minlength=self.bits + 1))
                    near = distance <= np.searchsorted(room, k + 1)
                    at, distance = at[near], distance[near]
                found = [(d, i) for a, d in zip(at.tolist(), distance.tolist(), strict=True) for i in self.ids[self.first[a] : self.first[a] + self.sizes[a]].tolist() if i != own]
                best = sorted(best + found)[:k]
            if len(best) == k and best[-1][0] <= self.m * (radius + 1) - 1:
                break
        return best


def search_blocks(config: SearchConfig):
    """Over rows sorted by (block, query): a block's codes, then the queries that pass by."""

    def run(batches):
        block, codes, ids, index = None, [], [], None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("block", "is_query", "id", "code", "ids")), strict=True)
            found: list[tuple[int, int, int]] = []
            for b, is_query, number, code, held in rows:
                if b != block:
                    block, codes, ids, index = b, [], [], None
                value = code & (1 << 64) - 1
                if not is_query:
                    codes.append(value)
                    ids.append(np.array(held, np.int64))
                    continue
                if index is None:
                    index = MultiIndex(np.array(codes, np.uint64), ids, config.bits)
                found += [(number, i, d) for d, i in index.nearest(np.uint64(value), number, config.k)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["query_id", "vec_id", "distance"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each query (id, code) its k nearest of rows (id, code)."""
    per_code = Window.partitionBy("code").orderBy("id")
    few = rows.distinct().withColumn("nth", F.row_number().over(per_code)).where(F.col("nth") <= config.k + 1)
    distinct = common.stored(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    blocks = max(1, -(-distinct.count() // config.block_rows))
    none = F.array().cast("array<long>")
    home = distinct.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("is_query"), F.lit(0).cast("long").alias("id"), "code", "ids")
    passing = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("is_query"), "id", "code", none.alias("ids"))
    found = (
        home.unionByName(passing).repartition(min(blocks, config.most_tasks), "block").sortWithinPartitions("block", "is_query")
        .mapInArrow(common.frugal(search_blocks(config)), "query_id long, vec_id long, distance int")
    )
    nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "distance")


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = SearchConfig()
    rows = coded(common.read(spark, sf_dir, "embeddings"), config)
    return top_k(rows, rows.where(F.col("id") % 100 == 0), config)


OP7_SQL = """
WITH c AS (SELECT DISTINCT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, r.vec_id, min(bit_count(xor(q.code, r.code)))::INTEGER AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
