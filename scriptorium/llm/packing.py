"""Containers of fixed capacity filled with items: planned on a histogram of lengths.

Only the histogram of sizes (at most ``capacity`` rows, whatever the corpus) is
planned on the driver: best fit, largest first, over counts.  Documents get a
rank within their size, in two levels (``SALTS`` slices of each size, by a hash of
the key) so that no task sorts all documents of a common size, and take the
planned slots by joining on size and rank; the plan is broadcast if it has at most
``SHIPPED_ROWS`` rows, else joined.

Defined results: an item larger than a container is divided into full containers
and a remainder, nothing else is divided; an empty or null text has size 0 and
no container (null); equal sizes take slots in order of a hash of the key; a
repeated row is an item of its own; an empty table gives no row.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CAPACITY = 2048
#: A public byte-level vocabulary as ranks; the path must be there on every executor.
TOKENIZER = os.environ.get("SCRIPTORIUM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's texts are cut into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Slices in which the documents of one size are ranked; rows of a plan that is broadcast, at most.
SALTS, SHIPPED_ROWS = 1_024, 200_000

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The encoding at ``path``, loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``key``, ``size`` in tokens."""
    src = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "size"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, size bigint").withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank, first container, items of this size per container): best fit,
    largest size first, over counts.  Containers with equal room are kept as ranges."""
    rooms: list[int] = []  # rooms in use, sorted
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first container, containers)
    out, fresh = [], 0

    def put(room: int, first: int, n: int) -> None:
        if not ranges[room]:
            insort(rooms, room)
        ranges[room].append((first, n))

    for size in sorted((s for s, n in counts.items() if s > 0 and n > 0), reverse=True):
        left, rank = counts[size], 1
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    rooms.pop(at)
            else:
                room, per = capacity, capacity // size
                n = -(-left // per)
                first, fresh = fresh, fresh + n
            per = room // size  # a container takes as many of this size as it holds
            full = min(n, left // per)
            if full:
                out.append((size, rank, rank + full * per - 1, first, per))
                put(room - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                out.append((size, rank, rank + left - 1, first + full, left))
                put(room - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                put(room, first + full, n - full)
    return out


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "size", capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``key``, ``piece`` from 0, ``start`` (tokens before it), ``size``, ``container`` for every item of ``sizes``."""
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias("key"), F.col(size).cast("long").alias("whole"))
    full = F.floor(F.col("whole") / capacity).cast("long")
    rest = F.col("whole") % capacity
    n_full = items.agg(F.sum(full)).first()[0] or 0
    rests = items.select("key", full.alias("piece"), (full * capacity).alias("start"), rest.alias("size")).where("size > 0 or piece = 0")
    none = rests.where("size = 0").select("key", "piece", "start", "size", F.lit(None).cast("long").alias("container"))
    rests = rests.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    # Ranks within a size: counted per (size, salt), then offset by the salts before.
    per = rests.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["size"]: r["n"] for r in per.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "salt").orderBy(F.xxhash64("key"), "key")
    ranked = rests.withColumn("rn", F.row_number().over(within))
    ranked = ranked.join(offsets, ["size", "salt"]).withColumn("rank", F.col("rn") + F.col("before")).drop("rn", "before", "salt")
    rows = plan(counts, capacity)
    if rows:
        slots = spark.createDataFrame(rows, "size long, rank_from long, rank_to long, first long, per long")
        on = (ranked["size"] == slots["size"]) & ranked["rank"].between(slots["rank_from"], slots["rank_to"])
        packed = ranked.join(F.broadcast(slots) if len(rows) <= SHIPPED_ROWS else slots, on).select(
            "key", "piece", "start", ranked["size"], (F.col("first") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per")) + n_full).cast("long").alias("container")
        )
    else:
        packed = none.limit(0)
    # Full containers of divided items: numbered by the offset of each slice of keys.
    big = items.where(full > 0).select("key", full.alias("n"), F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"))
    part = big.groupBy("salt").agg(F.sum("n").alias("n"))
    part = part.select("salt", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = Window.partitionBy("salt").orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, -1)
    big = big.withColumn("sofar", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(part, "salt")
    whole = big.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"), (F.col("sofar") + F.col("before")).alias("base"))
    whole = whole.select("key", F.col("piece").cast("long"), (F.col("piece") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("size"), (F.col("base") + F.col("piece")).cast("long").alias("container"))
    out = packed.unionByName(whole).unionByName(none)
    return out.withColumnRenamed("key", key)


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    return pack(materialize(token_sizes(documents, key, text, path)), key, "size", capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``n_items``, ``n_tokens``, ``n_containers``, ``fill`` and ``n_least`` (containers that would do if nothing were left free)."""
    one = packed.where("container is not null")
    per = one.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.ceil(F.sum("used") / capacity).alias("n_least"), F.max("used").alias("most_used"),
    )
