"""Substring dedup by sliding sentence spans: hash every run of several consecutive sentences, join them globally, and
remove the sentences covered by any repeated run that is not its first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevispark.llm.common import SPACES, _power, cut, join_spread, mix64, named, word_hashes

SENTENCES, WORDS, NEAR = 3, 20, 3
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_BASE = 0xC2B2AE3D27D4EB4F


def segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte of each word, hash of each word, first word of each sentence and at last the number of words).

    A sentence ends after a word that ends with . ! or ?, before a line break and after a word whose hash is the least
    within NEAR words on both sides. The last rule cuts a passage alike wherever it stands, marks or not, and one word over
    and over everywhere; all rules hold for sentences of any length.
    """
    starts, hashes = word_hashes(raw)
    n = len(starts)
    if not n:
        return starts, hashes, np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)
    inside = ~SPACES[data]
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False))
    lines = np.cumsum((data == 10) | (data == 13))
    stop = _ENDS[data[ends]]
    stop[:-1] |= lines[starts[1:]] != lines[ends[:-1]]
    stop[-1] = True
    least = hashes.copy()
    for k in range(1, NEAR + 1):
        least[k:] = np.minimum(least[k:], hashes[:-k])
        least[:-k] = np.minimum(least[:-k], hashes[k:])
    stop |= hashes == least
    first = np.concatenate([[0], np.flatnonzero(stop) + 1])
    return starts, hashes, first


def runs(
    hashes: np.ndarray, first: np.ndarray, sentences: int = SENTENCES, words: int = WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, end sentence) of the run that starts at each sentence: the shortest with enough sentences and words. Later starts have none."""
    n = len(first) - 1
    end = np.maximum(np.arange(n) + sentences, np.searchsorted(first, first[:-1] + words))
    end = end[end <= n]
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power("runs", _BASE, len(hashes)), out=sums[1:])
    a, b = first[: len(end)], first[end]
    back = _power("runs back", pow(_BASE, -1, 1 << 64), len(hashes))
    return mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)), end


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, inner = batch.column(0), [], []
        for t in batch.column(1).cast(pa.binary()):
            _, words, first = segment(t.as_py() or b"")
            h = runs(words, first)[0]
            u = np.unique(h)
            inner.append(len(u) < len(h))
            out.append(u.view(np.int64))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(inner, pa.bool_())],
            ["doc_id", "runs", "inner"],
        )


CLEAN = (
    "doc_id long, n_sentences long, n_removed long, n_words long, words_removed long, "
    "spans array<struct<start:long,end:long>>, first_docs array<long>, text string"
)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for key, text, bad, firsts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "bad", "first_docs"))):
                raw = (text or "").encode()
                starts, words, first = segment(raw)
                h, end = runs(words, first)
                drop = np.isin(h, np.array(bad or [], np.int64).view(np.uint64))
                seen = np.ones(len(h), bool)
                seen[np.unique(h, return_index=True)[1]] = False  # repeats within the document
                drop |= seen
                cover = np.zeros(len(first), np.int64)
                np.add.at(cover, np.flatnonzero(drop), 1)
                np.add.at(cover, end[drop], -1)
                gone = np.cumsum(cover)[:-1] > 0
                if not gone.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                byte = np.append(starts[first[:-1]], len(raw))
                spans = [(int(byte[a]), int(byte[b])) for a, b in edge.reshape(-1, 2)]
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                n = np.diff(first)
                rows.append(
                    (
                        key,
                        len(gone),
                        int(gone.sum()),
                        len(words),
                        int(n[gone].sum()),
                        [{"start": a, "end": b} for a, b in spans],
                        sorted(firsts or []),
                        b"".join(kept).decode(),
                    )
                )
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64()] * 5 + [span, pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                ["doc_id", "n_sentences", "n_removed", "n_words", "words_removed", "spans", "first_docs", "text"],
            )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that loses something (see CLEAN): its spans in bytes, the documents that hold the first
    occurrences, and the text that is left.

    Ids are integers (others are cast). The first occurrence of a run is that in the document of the smallest id, and there
    the foremost. Rows that share an id count as one document and take nothing from each other; null ids count as one
    document behind all others. Null and short texts hold no run; a text may become empty. Other columns are ignored; an
    empty table gives no row. Runs are compared by 64-bit hashes of all their words. The rows of a very common run are
    joined where they are (join_spread).
    """
    last = (1 << 63) - 1
    base = docs.select(
        F.coalesce(named(id_col).cast("long"), F.lit(last)).alias("doc_id"), named(text_col).alias("text")
    )
    hashed = cut(base.mapInArrow(_hash, "doc_id long, runs array<long>, inner boolean"))
    each = hashed.select("doc_id", F.explode("runs").alias("h"))
    first = cut(each.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = join_spread(each, first, ["h"], "n").where("doc_id <> first")
    bad = met.groupBy("doc_id").agg(F.collect_set("h").alias("bad"), F.collect_set("first").alias("first_docs"))
    inner = hashed.where("inner").select("doc_id").distinct()
    todo = cut(bad.join(inner, "doc_id", "full_outer"))
    out = base.join(todo, "doc_id").select("doc_id", "text", "bad", "first_docs").mapInArrow(_clean, CLEAN)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != last, F.col("doc_id")))


def op3_repeated_spans(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "first_docs",
        "n_sentences",
        "n_removed",
        "n_words",
        "words_removed",
        "spans",
        F.octet_length("text").cast("long").alias("bytes_left"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
