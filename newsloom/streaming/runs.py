"""Tables that grow by small batches: rows in runs, looked up by key.

A batch adds one run. Each run is a Parquet folder dealt over buckets by the hash of its rows' keys, with as many buckets as its rows
need, so a look-up reads only the buckets that its keys fall in. FAN runs of one level are merged into one of the next, which
rewrites a row once a level: in proportion to the logarithm of the table, not to the table. A row that is written again stands
for the one before; a row that isn't ``live`` takes it away.

Which runs make up the table after a batch is written last, as that batch's list. So a batch that fails leaves nothing behind, and
one that is run again gives the same table.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket, about, runs of a level that are merged, and buckets of a run at most.
BUCKET_ROWS = 20_000
FAN = 8
MAX_BUCKETS = 1 << 14


class Run(NamedTuple):
    """A folder of rows: the batch that wrote it, its level, buckets and rows."""

    path: str
    level: int
    buckets: int
    rows: int


_LIST = "path string, level int, buckets int, rows long, top long"


class Files:
    """The few things that Spark's readers and writers don't do with folders, wherever these are."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def complete(self, path: str) -> bool:
        # Spark's committer leaves this file when all parts are there
        fs, p = self._at(f"{path}/_SUCCESS")
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class RunTable:
    """Rows of ``schema`` under ``folder``, looked up by the columns ``key``; of the rows alike in ``identity`` the latest holds.
    ``schema`` has a column ``live``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], identity: list[str], bucket_rows: int = BUCKET_ROWS, fan: int = FAN):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.identity, self.bucket_rows, self.fan = key, identity, bucket_rows, fan
        self.files = Files(spark)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def held(self, before: int) -> tuple[list[Run], int]:
        """The runs of the table, oldest first, and the number that was listed with them, before a batch."""
        batches = [int(m[1]) for n in self.files.names(f"{self.folder}/list") if (m := re.fullmatch(r"v=(\d+)", n))]
        for batch in sorted((b for b in batches if b < before), reverse=True):
            path = f"{self.folder}/list/v={batch:012d}"
            if self.files.complete(path):
                rows = self.spark.read.schema(_LIST).parquet(path).collect()
                runs = [Run(r["path"], r["level"], r["buckets"], r["rows"]) for r in rows if r["path"] is not None]
                return sorted(runs, key=lambda r: (-r.level, r.path)), max((r["top"] for r in rows), default=0)
        return [], 0

    def _read(self, run: Run, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{run.path}"] if buckets is None else [f"{self.folder}/{run.path}/bucket={b}" for b in buckets]
        # a folder of buckets adds their number as a column
        return self.spark.read.schema(self.schema).parquet(*paths).drop("bucket")

    def _newest(self, parts: list[DataFrame]) -> DataFrame:
        """Of rows alike in identity that of the last part, dead ones included."""
        rows = None
        for age, part in enumerate(parts):
            aged = part.withColumn("_age", F.lit(age))
            rows = aged if rows is None else rows.unionByName(aged)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return rows.drop("_age")
        names = parts[0].columns
        others = [c for c in names if c not in self.identity]
        best = rows.groupBy(*self.identity).agg(F.max_by(F.struct(*others), "_age").alias("_last"))
        return best.select(*self.identity, "_last.*").select(*names)

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """The live rows whose key is in keys (columns ``key``), as they are before a batch. Of each run only the buckets that these keys
        fall in are read."""
        runs, _ = self.held(before)
        wanted = keys.select(*self.key).distinct()
        numbers = sorted({r.buckets for r in runs})
        touched: dict[int, list[int]] = {n: [] for n in numbers}
        if numbers:
            # numbers of buckets: a bounded table, whatever the batch
            each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), self._bucket(n).alias("b")) for n in numbers))).alias("x")
            for r in wanted.select(each).select("x.*").distinct().collect():
                touched[r["n"]].append(r["b"])
        parts = []
        for run in runs:
            filled = set(self.files.names(f"{self.folder}/{run.path}"))
            there = sorted(b for b in touched[run.buckets] if f"bucket={b}" in filled)
            if there:
                parts.append(self._read(run, there).join(wanted, self.key, "left_semi"))
        return self._newest(parts).filter("live").drop("live")

    def rows(self, before: int) -> DataFrame:
        """All live rows before a batch."""
        return self._newest([self._read(r) for r in self.held(before)[0]]).filter("live").drop("live")

    def _write(self, rows: DataFrame, path: str, level: int, most: int) -> Run:
        buckets = 1
        while buckets < MAX_BUCKETS and buckets * self.bucket_rows < most:
            buckets *= 2
        # a bucket is one file, so that a look-up opens few
        dealt = rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{path}")
        return Run(path, level, buckets, most)

    def add(self, rows: DataFrame, batch: int, top: int = 0) -> None:
        """Appends a batch's rows (of ``schema``) and lists the table with them. ``rows`` is counted and written, so it should be cut."""
        runs, _ = self.held(batch)
        n = rows.count()
        if n:
            runs.append(self._write(rows, f"runs/v={batch:012d}-0", 0, n))
        level = 0
        while len(of_level := [r for r in runs if r.level == level]) >= self.fan:
            older = [r for r in runs if r.level > level]
            merged = self._newest([self._read(r) for r in of_level])
            if not older:
                merged = merged.filter("live")  # nothing is left to take away
            level += 1
            runs = [*older, self._write(merged, f"runs/v={batch:012d}-{level}", level, sum(r.rows for r in of_level))]
        listed = [(*r, top) for r in runs] or [(None, None, None, None, top)]
        self.spark.createDataFrame(listed, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list/v={batch:012d}")

    def vacuum(self, before: int) -> int:
        """Deletes the runs and lists that only the tables before ``before`` need: those can't be read any more. How many runs went."""
        lists = [n for n in self.files.names(f"{self.folder}/list") if re.fullmatch(r"v=\d+", n)]
        kept = {f"v={before:012d}", *(n for n in lists if int(n[2:]) >= before)}
        last = max((int(n[2:]) for n in lists if int(n[2:]) < before and self.files.complete(f"{self.folder}/list/{n}")), default=None)
        kept.add(f"v={last:012d}" if last is not None else "")
        needed = {r.path for n in lists if n in kept for r in self.held(int(n[2:]) + 1)[0]}
        gone = [n for n in self.files.names(f"{self.folder}/runs") if f"runs/{n}" not in needed and int(n[2:14]) < before]
        for n in gone:
            self.files.delete(f"{self.folder}/runs/{n}")
        for n in lists:
            if n not in kept:
                self.files.delete(f"{self.folder}/list/{n}")
        return len(gone)
