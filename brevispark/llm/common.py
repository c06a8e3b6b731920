"""What the operators of this subpackage share: the shared folder, checkpoints, word hashing and components."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brevispark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost nothing behind it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until df has no such column (names differ in more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, run, added: list[StructField]) -> DataFrame:
    """df through run, from batches of its columns (in order) to batches with the added columns behind them.

    Columns have plain names on the way, as mapInArrow takes no dots or backticks.
    """
    fields = [*df.schema, *added]
    plain = [f"c{k}" for k in range(len(fields))]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain, fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain)

    return df.toDF(*plain[: len(df.columns)]).mapInArrow(renamed, schema).toDF(*[f.name for f in fields])


#: Keys of at least HOT_ROWS rows, the MOST_HOT largest of them, are joined without moving their rows; any other key
#: then holds at most HOT_ROWS rows or one part in MOST_HOT of all.
HOT_ROWS, MOST_HOT = 4096, 4096


def join_spread(
    rows: DataFrame, table: DataFrame, keys: list[str], n: str, *, hot_rows: int | None = None
) -> DataFrame:
    """rows joined with table, which has one row for each key and the number n of rows with it.

    Large keys are broadcast (at most MOST_HOT rows of table), so that no task gets all rows of a key; the others meet in
    a shuffle. Both inputs are used more than once and should be cheap to read. n stays among the columns.
    """
    hot = table.where(
        F.col(n) >= (HOT_ROWS if hot_rows is None else hot_rows)
    ).orderBy(F.desc(n), *keys).limit(MOST_HOT)
    hot = cut(hot)
    if not hot.limit(1).count():
        return rows.join(table, keys)
    there = F.broadcast(hot.select(*keys))
    few = rows.join(F.broadcast(hot), keys)
    many = rows.join(there, keys, "left_anti").join(table.join(there, keys, "left_anti"), keys)
    return few.unionByName(many)


def settle() -> None:
    """Gives memory that a finished task leaves unused back to the system; workers live on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** k for k under n, modulo 2 ** 64. Tables of usual size are kept; longer ones are made anew, so none stays."""
    size = max(n, CHUNK)
    if name in _powers and n <= CHUNK:
        return _powers[name][:n]
    x = np.full(size, base, np.uint64)
    x[0] = 1
    x = np.cumprod(x)
    if n <= CHUNK:
        _powers[name] = x
    return x[:n]


_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] += np.uint64(32)
_MASK = (1 << 64) - 1


def _finish(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix64(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, 64-bit hash) of each word of raw; words are runs without ASCII white space, A-Z counts as a-z.

    A word's hash is that of the sum of value(byte i) * base ** i. The text is read in parts of CHUNK bytes and the sum of
    a word that goes on in the next part is carried along, so working memory does not follow the length of a text or a word.
    """
    data, starts, hashes = np.frombuffer(raw, np.uint8), [], []
    open_at, open_sum = -1, 0  # start and sum of a word that the last part left open
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        n = len(part)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~SPACES[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        if open_at >= 0 and (not len(s) or s[0] > 0):  # it ended with the last part
            starts.append(np.array([open_at]))
            hashes.append(_finish(np.array([open_sum], np.uint64), np.array([at - open_at])))
            open_at, open_sum = -1, 0
        if not len(s):
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[part] * _power("up", _BASE, n), out=sums[1:])
        value = (sums[e] - sums[s]) * _power("down", pow(_BASE, -1, 1 << 64), n)[s]
        begin, end = s + at, e + at
        if open_at >= 0:
            value[0] = np.uint64((open_sum + int(value[0]) * pow(_BASE, at - open_at, 1 << 64)) & _MASK)
            begin[0] = open_at
            open_at, open_sum = -1, 0
        if e[-1] == n and at + n < len(data):
            open_at, open_sum = int(begin[-1]), int(value[-1])
            begin, end, value = begin[:-1], end[:-1], value[:-1]
        starts.append(begin)
        hashes.append(_finish(value, end - begin))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts).astype(np.int64), np.concatenate(hashes)


def let_go(spark: SparkSession) -> None:
    """Has Spark remove shuffle files and checkpoints that nothing refers to; it sees them only when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an edge table that one task reads.
EDGES_A_TASK = 1 << 16


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (a, b), the smallest node reachable from it.

    Alternates large-star and small-star steps until the edges are a forest of stars. Every step is an aggregation with
    map-side combining and a join in which the edges of a hub stay spread over the tasks (join_spread); the edges are cut
    to the shared folder each round, read from there by a task for each EDGES_A_TASK of them (a step never makes more edges),
    and what earlier rounds shuffled is let go. An empty edge table gives an empty result; edges with null ends or equal
    ends are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut(e), None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        let_go(e.sparkSession)
        tasks = math.ceil(seen[0] / EDGES_A_TASK)
        e = e.coalesce(tasks)
        # a table of fewer edges has no hub
        joined = join_spread if seen[0] >= HOT_ROWS else lambda rows, table, keys, n: rows.join(table, keys)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        least = least.where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        large = joined(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct()).coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, low, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    tree = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.unionByName(tree.select(F.col("component").alias("node"), "component").distinct())


def merged_components(comps: DataFrame, merged: DataFrame) -> DataFrame:
    """comps (node, component) after components were merged: merged has (node, component) of components and of nodes that
    were in none. Rows of a large component stay where they are (join_spread)."""
    size = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    table = size.join(into, "component", "full_outer")
    table = cut(table.select("component", F.coalesce("root", "component").alias("root"), F.coalesce("n", F.lit(0)).alias("n")))
    inside = join_spread(comps, table.where("n > 0"), ["component"], "n").select("node", F.col("root").alias("component"))
    return inside.unionByName(table.where("n = 0").select(F.col("component").alias("node"), F.col("root").alias("component")))
