"""What several operators share: tables, scratch tables, bitmaps, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the op3, op4, op5 and op9 contracts: no ASCII white space.
DELIMITERS = "[\\x20\\x09-\\x0D]+"

#: Bits in one bucket of Spark's bitmap functions.
BUCKET_BITS = 32_768


#: Rows that go to a Python worker at once: texts are a few thousand bytes each, and both sides hold a batch.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20


def modest(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger: memory of a task follows them."""
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    held = int(spark.conf.get(rows))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set(size, f"{BATCH_BYTES}b")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; one is set only where the session has none and runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftwork-")
        spark.sparkContext.setCheckpointDir(folder)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


#: What the scopes that are open now have to clear away, the innermost last: folders and broadcasts.
_OPEN: ContextVar[tuple[list, ...]] = ContextVar("open", default=())


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder, whichever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """A scope: what ``stored`` and ``sent`` make within goes at its end, but for what is made to outlive it.

    Only what no DataFrame reads that is used later may be made in a scope.
    """
    held: list = []
    token = _OPEN.set((*_OPEN.get(), held))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for x in held:
            if isinstance(x, str):
                deleted(spark, x)
            else:
                x.destroy()
        given_back()


def _made(x, outlives: bool) -> None:
    scopes = _OPEN.get()
    if len(scopes) > outlives:
        scopes[-1 - outlives].append(x)


def fresh_folder(spark: SparkSession, outlives: bool = False) -> str:
    """A new folder's name in the shared folder; it is the open scope's to delete."""
    folder = f"{scratch(spark)}/weftwork-{uuid.uuid4().hex}"
    _made(folder, outlives)
    return folder


def stored(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts lineage and survives lost executors."""
    path = f"{fresh_folder(df.sparkSession, outlives)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value, outlives: bool = False):
    """A broadcast of something of a fixed size; it is the open scope's to destroy."""
    found = spark.sparkContext.broadcast(value)
    _made(found, outlives)
    return found


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) with bit ``key mod bits`` set for each long key.

    Its size is fixed by the parameter, whatever the number of keys, so it may be
    sent to all executors. It can say yes for a key that is not there, never no
    for one that is: users drop the false ones by an exact join later.
    """
    bits = max(bits, BUCKET_BITS)
    at = keys.select(F.pmod(F.col(key), F.lit(bits)).alias("at")).select(
        F.floor(F.col("at") / BUCKET_BITS).cast("int").alias("bucket"), F.pmod("at", F.lit(BUCKET_BITS)).alias("bit")
    )
    rows = (
        at.repartition(F.col("bucket"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("map"))
        .collect()
    )
    found = np.zeros(bits // 8, np.uint8)
    for r in rows:
        found[r["bucket"] * (BUCKET_BITS // 8) : (r["bucket"] + 1) * (BUCKET_BITS // 8)] = np.frombuffer(r["map"], np.uint8)
    return found


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys have their bit set."""
    at = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21):
    """Parts of a batch whose texts are together about ``most_bytes`` long; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start, n = 0, batch.num_rows
    total = np.concatenate([[0], np.cumsum(sizes)])
    while start < n:
        end = int(np.searchsorted(total, total[start] + most_bytes, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's number of words; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(lists)
    counts = np.asarray(pc.list_value_length(lists), np.int64)
    empty = np.asarray(pc.binary_length(flat)) == 0
    if empty.any():  # white space at an end of a text leaves an empty word there
        owner = np.repeat(np.arange(len(texts)), counts)
        counts = counts - np.bincount(owner[empty], minlength=len(texts))
        flat = flat.filter(pa.array(~empty))
    return flat, counts


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that gives unused memory back at its end: workers live on and serve other stages."""

    def runs(batches):
        try:
            yield from run(batches)
        finally:
            given_back()

    return runs


def given_back() -> None:
    """Give unused memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads nearby values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_hash(column: str = "text") -> Column:
    """64 bits that tell rows of one doc_id with different texts apart; null for a null text."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))
