"""Cost-balanced packing of token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention within the piece). Documents, longest first, go to
the sequence of lowest cost that has room for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brevispark.llm.common import named, settle
from brevispark.llm.tokens import MOST_PIECES, byte_bpe_path, encoder

LENGTH = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
WINDOW = 1 << 21
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int | np.ndarray) -> float | np.ndarray:
    return LINEAR * n + QUADRATIC * n * n


def pack_window(sizes: list[int], length: int, last: bool) -> tuple[
    list[list[tuple[int, int, int]]], list[tuple[int, int, int]]
]:
    """(sequences, rest): sequences of (document, start, size) pieces, and the pieces that did not fill a sequence.

    Every sequence is full. What exceeds full sequences of its own goes, descending, to the sequence of lowest cost with
    remaining capacity; where no sequence has room for all of it, it is cut and fills the cheapest ones. With last, rest is
    cut to sequences whose lengths are powers of two, which need no padding, and comes back empty.
    """
    done: list[list[tuple[int, int, int]]] = []
    tails = []
    for d, n in enumerate(sizes):
        full = n // length
        done += [[(d, k * length, length)] for k in range(full)]
        if n % length:
            tails.append((n % length, d, full * length))
    tails.sort(key=lambda t: (-t[0], t[1]))
    bins = sum(t[0] for t in tails) // length
    room, load = np.full(bins, length), np.zeros(bins)
    packed: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    rest: list[tuple[int, int, int]] = []
    left = []
    for n, d, start in tails:
        k = int(np.where(room >= n, load, np.inf).argmin()) if bins else 0
        if not bins or room[k] < n:
            left.append((n, d, start))
            continue
        packed[k].append((d, start, n))
        room[k] -= n
        load[k] += cost(n)
    order = iter(np.argsort(load, kind="stable").tolist())
    k = next(order, None)
    for n, d, start in left:
        while n:
            while k is not None and not room[k]:
                k = next(order, None)
            if k is None:
                rest.append((d, start, n))
                break
            m = min(n, int(room[k]))
            packed[k].append((d, start, m))
            room[k] -= m
            start, n = start + m, n - m
    done += packed
    if last:
        total = sum(n for *_, n in rest)
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            own = []
            while want:
                d, start, n = rest.pop()
                m = min(n, want)
                own.append((d, start, m))
                if n > m:
                    rest.append((d, start + m, n - m))
                want -= m
            done.append(own)
    return done, rest


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    length: int = LENGTH,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_pieces: int = MOST_PIECES,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Packs each input partition by itself and without a shuffle, in windows of WINDOW tokens, so memory is bounded by the
    window and the longest document; pieces that do not fill a sequence wait for the next window. Only a partition's last
    tokens, under one sequence, make shorter sequences. Ids are integers (others are cast). Null texts count as empty, a
    null id is kept, rows that share an id are packed each for itself, other columns are ignored and an empty table gives
    no row. Sequence ids are unique: the partition's number in the high bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer_path, most_pieces), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        # waiting documents or parts of them: id, start of what is held, ids held, tokens of the document
        held: list[tuple[int | None, int, bytes, int]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            done, rest = pack_window([len(h[2]) // 4 for h in held], length, last)
            cols: list[list] = [[] for _ in range(7)]
            for pieces in done:
                at = 0
                for d, start, n in pieces:
                    key, before, ids, total = held[d]
                    for c, v in zip(cols, (key, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, sequence, at)):
                        c.append(v)
                    at += n
                sequence += 1
            held = [
                (held[d][0], held[d][1] + start, held[d][2][4 * start : 4 * (start + n)], held[d][3])
                for d, start, n in rest
            ]
            names = [x.split()[0] for x in OUT.split(", ")]
            for at in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], pa.int64()) for c in cols], names)

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    raw += end
                    held.append((key, 0, raw, len(raw) // 4))
                    waiting += len(raw) // 4
                if waiting >= WINDOW:
                    yield from flush(False)
                    waiting = sum(len(h[2]) // 4 for h in held)
        if held:
            yield from flush(True)
        settle()

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, OUT)


def op6_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe_path(), most_pieces=1_200_000)
