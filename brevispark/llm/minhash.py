"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash gives every element a random permutation of the slots and a random fraction per step; slot values are
step + fraction, minimal over the elements. Slots of one element are correlated, which lowers the variance, and once all
slots of a document were reached by earlier steps, later steps cannot lower them and are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevispark.llm.common import connected_components, cut, fresh, join_spread, let_go, merged_components, mix64, named, settle, word_hashes

K = 5
MISS, MOST_SLOTS = 1e-6, 128
BLOCK = 1024
#: Sets of pivots that are broadcast: of pivots with so many pairs, at most so many sets of at most so many bytes.
HOT_PIVOT, MOST_PIVOTS, MOST_BYTES = 4096, 64, 1 << 18
CHUNK_BYTES = 2 << 20


def shingle_sets(texts: list[bytes | None], k: int = K) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; with fewer words, of the whole sequence."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    starts, words = word_hashes(b"\n".join(t or b"" for t in texts))
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    shingles = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        shingles[: len(words) - j] = shingles[: len(words) - j] * np.uint64(0x9E3779B97F4A7C15) + words[j:]
    shingles = mix64(shingles)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at the threshold is missed with a probability below MISS."""
    found = []
    for rows in range(1, 9):
        p = min(1.0, percent / 100) ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(MISS) / math.log1p(-p))
        if rows == 1 or bands * rows <= MOST_SLOTS:
            found.append((bands, rows))
    return found[-1]


BANDS, ROWS = banding(85)
SLOTS = BANDS * ROWS


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of slot values (step + fraction) for each non-empty set."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    e = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    h = np.full((len(sets), slots), np.inf)
    flat = h.reshape(-1)
    first, perm = None, None
    for j in range(slots):
        r = mix64(e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = (((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        if j == 0:
            first = slot = k
        elif j == 1:
            slot = np.where(k == first, 0, k)
            second = k
        else:
            if perm is None:  # the few documents that need more steps
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(e), 1))
                at = np.arange(len(e))
                for step, other in ((0, first), (1, second)):
                    perm[at, step], perm[at, other] = perm[at, other], perm[at, step].copy()
            at = np.arange(len(e))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(flat, doc * slots + slot, j + (r >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        open_docs = np.isinf(h).any(1)
        more = open_docs[doc]
        if not more.any():
            break
        if not more.all():
            doc, e, first = doc[more], e[more], first[more]
            second = second[more] if j else None
            perm = perm[more] if perm is not None else None
    return h


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    x = h.view(np.uint64).reshape(len(h), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(h), 1))
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return out.view(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, texts) of consecutive rows with about CHUNK_BYTES of text."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary())):
        ids.append(i.as_py())
        texts.append(t.as_py())
        held += len(texts[-1] or b"")
        if held >= CHUNK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _sign(n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(superminhash(full, n_bands * rows), n_bands, rows).tolist() if full else ())
                bands = [next(keys) if len(s) else None for s in sets]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                cols = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "bands"])
        settle()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _pieces(batch):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())],
                ["doc_id", "shingles"],
            )
    settle()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                linked(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent)
                for a, b in zip(batch.column("sa"), batch.column("sb"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        settle()

    return run


def _within(percent: int):
    """Components that a link joins in one bucket or pair of its blocks; already joined ones are passed over."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("doc_id").sort_values(["comp", "doc_id"])
        ids, side = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        own, comp, out = rows["comp"].to_numpy(), pd.factorize(rows["comp"])[0], []
        for i in range(len(ids)):
            ok = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            ok[: i + 1] = False
            if key[2] != key[3]:
                ok &= side != side[i]
            for j in np.flatnonzero(ok):
                if comp[j] != comp[i] and linked(sets[i], sets[j], percent):
                    out.append((own[i], own[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id reachable over links) and kept (it is its own component).

    A link: percent or more of the union of two shingle sets is common. Bands miss a pair at that share with a probability
    below MISS; every candidate is decided on its full set. Rows with equal sets are one class, represented by its smallest
    id. In a bucket all members are first held against the smallest one. Only buckets that still hold several components
    are looked at again, in blocks, where every pair of different components is decided, so no link between buckets'
    members is lost and no task gets an unbounded group. Joins on a bucket or a class leave the rows of large ones where
    they are (join_spread).

    Ids are integers (others are cast). Null texts, texts without words and null ids link with nothing. Rows that share an
    id count as one document. Other columns are ignored; an empty table gives no row. Long texts are read in parts.
    """
    base = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    signed = cut(
        base.mapInArrow(_sign(*banding(percent)), "doc_id long, n_shingles long, digest binary, bands array<long>")
    )
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(
        usable.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n_rows")
        )
    )
    members = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    pivots = cut(
        members.groupBy("band", "key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    buckets = cut(join_spread(members, pivots, ["band", "key"], "n"))
    pairs = cut(buckets.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = cut(base.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"))
    let_go(docs.sparkSession)
    edges = cut(_linked_pairs(pairs, sets, percent))
    comps = cut(connected_components(edges))

    let_go(docs.sparkSession)
    more = cut(_second_look(buckets, comps, sets, percent))
    if more.limit(1).count():
        comps = cut(merged_components(comps, connected_components(more)))
    let_go(docs.sparkSession)

    placed = classes.select("digest", "rep", "n_rows").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    placed = cut(placed.select("digest", "n_rows", F.coalesce("component", "rep").alias("component_id")))
    out = join_spread(usable.select("doc_id", "n_shingles", "digest"), placed, ["digest"], "n_rows")
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. A pivot of many pairs is joined without moving them."""
    sa = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    of_b = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    sb = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    hot = of_b.where(F.col("n") >= HOT_PIVOT).orderBy(F.desc("n"), "b").limit(MOST_PIVOTS)
    hot = cut(sb.where(F.octet_length("sb") <= MOST_BYTES).join(F.broadcast(hot), "b").select("b", "sb"))
    both = pairs.join(sa, "a")
    if hot.limit(1).count():
        there = F.broadcast(hot.select("b"))
        cold = both.join(there, "b", "left_anti").join(sb, "b")
        both = both.join(F.broadcast(hot), "b").unionByName(cold)
    else:
        both = both.join(sb, "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long")


def _second_look(buckets: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (a, b) joined by a link within a bucket whose members beside the pivot are of several, by blocks of about
    BLOCK members."""
    owned = buckets.where("n > 2 AND rep <> pivot").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    owned = owned.select("band", "key", "rep", F.coalesce("component", "rep").alias("comp"))
    who = F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")
    split = owned.groupBy("band", "key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"), who
    )
    split = split.where("lo <> hi")
    first = F.min(F.struct("band", "key")).alias("x")  # buckets of equal members are looked at once
    one = cut(split.groupBy("members", "who", "lo", "hi").agg(first).select("x.band", "x.key", "members"))
    again = join_spread(owned, one, ["band", "key"], "members")
    again = again.withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
    again = again.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    again = again.select(
        "band",
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        F.col("rep").alias("doc_id"),
        "comp",
    )
    return again.join(sets, "doc_id").groupBy("band", "key", "i", "j").applyInPandas(_within(percent), "a long, b long")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document for each group, that with the smallest id (all rows that share that id).

    Null texts, texts without words and null ids stay. All columns are kept as they are, whatever their names; an empty
    table gives an empty table.
    """
    (key,) = fresh(docs, "gone_id")
    groups = near_groups(docs, id_col=id_col, text_col=text_col, percent=percent)
    gone = groups.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, named(id_col) == F.col(key), "left_anti").select(*map(named, docs.columns))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


SQL5 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
g AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)), l AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = doc_id
"""
