"""Change detection: file contents or times against a stored fingerprint table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_SCHEMA = T.StructType([
    T.StructField("strategy", T.StringType(), False), T.StructField("owner", T.StringType(), False),
    T.StructField("path", T.StringType(), False), T.StructField("value", T.StringType(), False),
])


def content_hash(content: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(content, 256)


def epoch_seconds(time: Column) -> Column:
    return F.unix_timestamp(time)


def glob_regex(pattern: str) -> tuple[str, str]:
    """The folder above a pattern's first wildcard, and what a file's path below it has to match."""
    parts = pattern.split("/")
    at = next(k for k, p in enumerate(parts) if re.search(r"[*?\[{]", p))
    found = ""
    for k, part in enumerate(parts[at:], at + 1):
        last = k == len(parts)
        if part == "**":
            found += ".*" if last else "(?:[^/]+/)*"
            continue
        for token in re.findall(r"\[!?[^]]+\]|.", part):
            if len(token) > 1:
                found += "[" + token[1:].replace("!", "^", 1) if token[1] == "!" else token
            else:
                found += {"*": "[^/]*", "?": "[^/]"}.get(token, re.escape(token))
        found += "" if last else "/"
    return "/".join(parts[:at]) or ("/" if pattern.startswith("/") else "."), found


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    """The files of a pattern. Where it has ``**`` the folders below are walked, and names pruned by its last part."""
    reader = spark.read.format("binaryFile")
    if "**" not in pattern.split("/"):
        return reader.load(pattern)
    folder, regex = glob_regex(pattern)
    last = pattern.rsplit("/", 1)[-1]
    found = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*" if last == "**" else last).load(folder)
    folder = re.escape(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).removeprefix("./").rstrip("/"))
    above = ".*" if pattern[0] not in "/" and ":" not in pattern.split("/")[0] else "(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?"
    return found.where(F.col("path").rlike(f"^{above}{'' if folder == re.escape('.') else folder + '/'}{regex}$"))


def scan(spark: SparkSession, patterns: list[str], strategy: str) -> DataFrame:
    """(path, value) of all files that the glob patterns match; contents are read only for hashes."""
    empty = spark.createDataFrame([], "path string, value string")
    found = empty
    for pattern in patterns:
        try:
            files = _files(spark, pattern)
        except Exception as e:  # Spark names a pattern that matches nothing by this error class
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        value = content_hash(F.col("content")) if strategy == "hash" else epoch_seconds(F.col("modificationTime")).cast("string")
        found = found.unionByName(files.select("path", value.alias("value")))
    return found.distinct()


def changed(current: DataFrame, earlier: DataFrame, key: str, value: str = "value", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, changed): rows of current whose value is new or differs from the earlier one."""
    before = earlier.select(key, F.col(value).alias("_before"))
    return current.join(before, key, "left").select(key, *also, (~F.col("_before").eqNullSafe(F.col(value))).alias("changed"))


class StateTable:
    """Fingerprints in a Parquet folder. Each commit writes a new version; a pointer names the one that counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[tuple[int, str]]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted((int(n.split("-")[1]), n) for n in names if n.startswith("version-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        held = self._versions()
        if not held:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/{held[-1][1]}")

    def of(self, strategy: str, owner: str) -> DataFrame:
        return self.read().where((F.col("strategy") == strategy) & (F.col("owner") == owner)).select("path", "value")

    def commit(self, strategy: str, owner: str, current: DataFrame) -> None:
        """Replace the fingerprints of one owner. The version is whole once Spark has written its _SUCCESS file."""
        held = self._versions()
        kept = self.read().where(~((F.col("strategy") == strategy) & (F.col("owner") == owner)))
        new = current.select(F.lit(strategy).alias("strategy"), F.lit(owner).alias("owner"), "path", "value")
        number = held[-1][0] + 1 if held else 0
        kept.unionByName(new).write.parquet(f"{self.folder}/version-{number:010d}-{uuid.uuid4().hex[:8]}")
        fs, path = self._fs()
        for _, name in held[:-1]:  # the last one may still be read
            fs.delete(path(f"{self.folder}/{name}"), True)

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.folder), True)


def is_changed(spark: SparkSession, state: StateTable, owner: str, patterns: list[str], strategy: str) -> tuple[bool, DataFrame]:
    """Whether any matched file is new, differs or is gone; and the current fingerprints. Patterns without a file: unchanged."""
    current = scan(spark, patterns, strategy)
    before = state.of(strategy, owner)
    differs = changed(current, before, "path").agg(F.bool_or("changed").alias("x")).first()["x"]
    gone = not before.join(current, "path", "left_anti").isEmpty()
    return bool(differs) or gone, current
