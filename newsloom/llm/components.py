"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut, plain_join


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) between neighbours of a stream (key, fp) sorted by key, the greater one first; equal ones give none."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key[-1:], batch.column("key").to_numpy()])
        fp = np.concatenate([fp[-1:], batch.column("fp").to_numpy()])
        same = np.flatnonzero((key[1:] == key[:-1]) & (fp[1:] != fp[:-1]))
        if len(same):
            a, b = fp[same], fp[same + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])


#: Edges of a task, about, where there are few.
TASK_EDGES = 50_000


def _few(rows: DataFrame, edges: int) -> DataFrame:
    """rows in as many partitions as so many edges need, if that is fewer than an exchange makes: each task of a round leaves files,
    and a round of few edges would leave little but files."""
    parts = max(2, -(-edges // TASK_EDGES))
    return rows.coalesce(parts) if parts < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Link the neighbours of each node to the least node among them and itself. Minima are aggregated before they meet the
    edges again, and they meet in a join with plain exchanges on both sides, so that adaptive execution can split a node with
    very many edges. n: about so many edges there are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = _few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
    met = _few(plain_join(both, least, ["u"]), n)
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return _few(out.filter("u != v").distinct(), n)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (u, v): label is the least node that can be reached.

    Self-loops and rows with a null end are ignored; repeated edges count once; no edges give no rows. Rounds are
    logarithmic in the number of nodes; each is cut with a checkpoint in the shared folder.
    """
    edges = edges.filter("u is not null and v is not null and u != v")
    # from here on u > v
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    before = None
    while True:
        after = now.agg(mark.alias("m")).first()["m"]
        if after == before or after["n"] == 0:
            break
        before = after
        now = cut(_star(_star(_few(now, after["n"]), True, after["n"]), False, after["n"]))
    # at the fixpoint every edge goes from a node to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
