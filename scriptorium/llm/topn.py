"""Top N items within every group, by merging stored sorted runs with a loser tree.

Where rows are read, each task keeps the N best distinct items of every group it
meets: batches are cut by array passes, and what is held is cut again whenever it
has doubled, so the work stays in proportion to the rows and the memory to the
groups of one partition.  At most N rows per group and partition are shuffled; an
item that is among the N best of its group is so in the partition of its best row.

The shuffled rows are stored in the shared folder in buckets of the group, each
bucket as runs ordered by group, score and item (a run holds the rows of some of
the reading tasks).  One task a bucket merges its runs with a loser tree; after N
outputs of a group every run seeks to its next group.  A group with millions of
items costs N rows per reading task, and no task gathers a whole group.

Defined results: rows with a null group or item, and rows with a null score,
are left out; an item that stands in several rows of a group counts with its
highest score; ties go to the smaller item by UTF-8 bytes; N < 1 gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Rows a reading task holds before it cuts them, at least; runs of a bucket.
HELD_ROWS, RUNS = 100_000, 16
ORDER = [("g", "ascending"), ("s", "descending"), ("i", "ascending")]
ROW = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", T.LongType()), T.StructField("i", T.StringType())])


class Run:
    """A sorted run of (group, score, item): the scores fall within a group."""

    __slots__ = ("at", "ends", "g", "head", "i", "s")

    def __init__(self, g: pa.Array, s: pa.Array, i: pa.Array):
        self.g, self.s, self.i, self.at = g, s, i, 0
        n = len(g)
        last = np.flatnonzero(np.append(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False), True)) if n else np.zeros(0, np.int64)
        self.ends = np.repeat(last + 1, np.diff(np.append(-1, last)))
        self._look()

    def _look(self) -> None:
        k = self.at
        self.head = (self.g[k].as_py(), -self.s[k].as_py(), self.i[k].as_py()) if k < len(self.g) else None

    def step(self) -> None:
        self.at += 1
        self._look()

    def seek_past(self, group: str) -> None:
        """To the first row behind ``group``."""
        if self.head is not None and self.head[0] == group:
            self.at = int(self.ends[self.at])
            self._look()


class LoserTree:
    """Tournament of runs: inner nodes keep the loser, the root's winner is the least head."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, len(runs)
        self.losers = [-1] * max(1, self.k)
        self.rebuild()

    def _less(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head, self.runs[b].head
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def replay(self, run: int) -> None:
        """Matches on the path of ``run`` to the root, after its head moved."""
        node, win = (run + self.k) // 2, run
        while node:
            if self._less(self.losers[node], win):
                self.losers[node], win = win, self.losers[node]
            node //= 2
        self.winner = win

    def rebuild(self) -> None:
        self.winner = self._build(1) if self.k else -1


def merge_runs(runs: list[Run], n: int) -> Iterator[tuple[str, int, str, int]]:
    """(group, score, item, place): the first ``n`` items of each group over all runs, in order."""
    runs = [r for r in runs if r.head is not None]
    if not runs or n < 1:
        return
    tree, group, given = LoserTree(runs), None, set()
    while (row := runs[tree.winner].head) is not None:
        g, less, i = row
        if g != group:
            group, given = g, set()
        if i not in given:
            given.add(i)
            yield g, -less, i, len(given)
        if len(given) < n:
            runs[tree.winner].step()
            tree.replay(tree.winner)
            continue
        for r in runs:
            r.seek_past(g)
        tree.rebuild()


def cut(table: pa.Table, n: int) -> pa.Table:
    """The ``n`` best distinct items of every group, sorted."""
    table = table.sort_by(ORDER).combine_chunks()
    if not len(table):
        return table
    g = np.asarray(table.column("g").combine_chunks().dictionary_encode().indices)
    i = np.asarray(table.column("i").combine_chunks().dictionary_encode().indices)
    by_item = np.lexsort((np.arange(len(g)), i, g))  # an item's best row comes first
    again = np.zeros(len(g), bool)
    again[by_item[1:]] = (g[by_item[1:]] == g[by_item[:-1]]) & (i[by_item[1:]] == i[by_item[:-1]])
    table, g = table.filter(pa.array(~again)), g[~again]
    at = np.arange(len(g))
    rank = at - np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), at, 0))
    return table.filter(pa.array(rank < n))


def _best(n: int):
    """Each task's ``n`` best items of every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows, limit = 0, HELD_ROWS
        for batch in batches:
            parts.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows > limit:
                parts = [cut(pa.concat_tables(parts), n)]
                rows = len(parts[0])
                limit = max(HELD_ROWS, 2 * rows)
        if parts:
            yield from cut(pa.concat_tables(parts), n).combine_chunks().to_batches(max_chunksize=10_000)

    return run


def _merge(n: int):
    """A bucket's runs, one behind the other, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        if not len(t):
            return
        number = t.column("run").to_numpy()
        bounds = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(t)]
        column = lambda name, a, b: pa.concat_arrays(t.column(name).slice(a, b - a).chunks)
        merged = merge_runs([Run(*(column(c, a, b) for c in "gsi")) for a, b in zip(bounds, bounds[1:], strict=False)], n)
        while part := [row for row, _ in zip(merged, range(10_000), strict=False)]:
            cols = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["g", "s", "i", "place"])

    return run


def stored_runs(rows: DataFrame, buckets: int, runs: int = RUNS) -> DataFrame:
    """``rows`` (g, s, i) stored in the shared folder in ``buckets`` of the group, each with up to
    ``runs`` sorted runs; read back, a partition is a bucket."""
    spark = rows.sparkSession
    name = f"runs_{uuid.uuid4().hex}"
    numbered = rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs))).withColumn("less", -F.col("s"))
    stored = numbered.repartition(buckets, "g").write.bucketBy(buckets, "g").sortBy("run", "g", "less", "i")
    stored.format("parquet").option("path", f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}").saveAsTable(name)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # a bucket must stay in one task
    back = spark.table(name).select("run", "g", "s", "i")
    spark.sql(f"drop table {name}")  # the catalogue's entry; the files stay
    if back.rdd.getNumPartitions() != buckets:
        raise RuntimeError("the buckets were not read as stored")
    return back


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, buckets: int | None = None) -> DataFrame:
    """``group``, ``item``, ``score``, ``place``: the ``n`` items of each group with the
    highest score.  ``buckets``: of the stored runs, by default as many as shuffles have partitions."""
    c = lambda name: F.col(f"`{name}`")
    rows = df.select(c(group).cast("string").alias("g"), c(score).cast("long").alias("s"), c(item).cast("string").alias("i")).where("g is not null and i is not null and s is not null")
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = stored_runs(rows.mapInArrow(_best(n), ROW), buckets) if n > 0 else rows.limit(0).select(F.lit(0).alias("run"), "g", "s", "i")
    out = stored.mapInArrow(_merge(n), T.StructType([*ROW.fields, T.StructField("place", T.LongType())]))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")
