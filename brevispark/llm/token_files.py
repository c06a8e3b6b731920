"""Token-ID files: a concatenated id array with Elias-Fano encoded document boundaries.

A shard is: 8 bytes magic; little-endian uint64 numbers (documents n, ids u, bytes per id, first document id, and for each of
the two sequences the low bits l and the bytes of low bits, high bitmap and samples, at last the bytes of null flags); the
sequences of boundaries and of document ids less the first; null flags (bit packed); the ids. A sequence is: the low bits of
its values (l bits each, bit packed), the high bitmap (a one for value i at position (value >> l) + i) and the positions of
every 64th one (uint32; uint64 in a bitmap of 2 ** 32 bits or more). It takes about 2.5 + log2(top / n) bits a document.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevispark.llm.common import cut, named, settle, shared_dir
from brevispark.llm.tokens import byte_bpe_path, encoder, forget

MAGIC, EVERY = b"BRVTOK02", 64


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    return np.packbits(
        (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) != 0, bitorder="little"
    ).tobytes()


class EliasFano:
    """A non-decreasing sequence of n integers up to u, with select in near-constant time."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> "EliasFano":
        values, n = values.astype(np.uint64), len(values)
        l = max(0, int(np.log2(top / n))) if n and top > n else 0
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros((int(ones[-1]) + 1 if n else 0), bool)
        bitmap[ones] = True
        high = np.packbits(bitmap, bitorder="little").tobytes()
        return cls(n, l, _pack(values, l), high, ones[::EVERY].astype(cls._position(len(high))))

    @staticmethod
    def _position(n_high: int) -> np.dtype:
        """Samples are positions in a bitmap of so many bytes."""
        return np.dtype("<u4" if n_high < 1 << 29 else "<u8")

    def sizes(self) -> list[int]:
        return [self.l, len(self.low), len(self.high), self.samples.nbytes]

    def to_bytes(self) -> bytes:
        return self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(
        cls, raw: bytes, at: int, n: int, l: int, n_low: int, n_high: int, n_samples: int
    ) -> tuple["EliasFano", int]:
        """(the sequence at this place of raw, the place behind it)."""
        a, b = at + n_low, at + n_low + n_high
        kind = cls._position(n_high)
        return cls(n, l, raw[at:a], raw[a:b], np.frombuffer(raw, kind, n_samples // kind.itemsize, b)), b + n_samples

    def select(self, i: int) -> int:
        """The value at i, read from the bits around it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        word = self.high[at // 8] & (0xFF << at % 8)
        byte = at // 8
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first, last = i * self.l, (i + 1) * self.l
        low = int.from_bytes(self.low[first // 8 : (last + 7) // 8], "little") >> first % 8 & ((1 << self.l) - 1)
        return high << self.l | low

    def select_many(self, first: int, count: int) -> np.ndarray:
        """The values at first and the count - 1 places behind it: the samples say which bits hold them."""
        if not count:
            return np.zeros(0, np.uint64)
        last, block = first + count - 1, first // EVERY
        at = int(self.samples[block])
        stop = int(self.samples[last // EVERY + 1]) if last // EVERY + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, -(-stop // 8) - at // 8, at // 8), bitorder="little")
        ones = np.flatnonzero(bits[at % 8 :])[first - block * EVERY :][:count] + at
        high = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.l)
        if not self.l:
            return high
        a, b = first * self.l, (last + 1) * self.l
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8, -(-b // 8) - a // 8, a // 8), bitorder="little")
        low = bits[a % 8 : a % 8 + b - a].reshape(count, self.l).astype(np.uint64)
        return high | (low << np.arange(self.l, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        return self.select_many(0, self.n).astype(np.int64)


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One shard; doc_ids ascend (nulls anywhere); ids: little-endian, width bytes each, of all documents one after another."""
    ends = np.cumsum(np.array(lengths, np.int64))
    n, top = len(doc_ids), int(ends[-1]) if len(ends) else 0
    known = [x for x in doc_ids if x is not None]
    first = known[0] if known else 0
    keys, last = [], 0
    for x in doc_ids:  # a null repeats the key before it
        last = last if x is None else x - first
        keys.append(last)
    bounds, names = EliasFano.of(ends, top), EliasFano.of(np.array(keys, np.uint64), last)
    nulls = b"" if len(known) == n else np.packbits(
        np.array([x is None for x in doc_ids], bool), bitorder="little"
    ).tobytes()
    head = np.array([n, top, width, first % (1 << 64), *bounds.sizes(), *names.sizes(), len(nulls)], "<u8").tobytes()
    return b"".join([MAGIC, head, bounds.to_bytes(), names.to_bytes(), nulls, ids])


class Shard:
    """A shard that was written by shard_bytes()."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        head = list(map(int, np.frombuffer(raw, "<u8", 13, 8)))
        self.n, self.n_ids, self.width, first = head[:4]
        self.ends, at = EliasFano.read(raw, 112, self.n, *head[4:8])
        names, at = EliasFano.read(raw, at, self.n, *head[8:12])
        keys = names.select_many(0, self.n).tolist()
        nulls = np.unpackbits(
            np.frombuffer(raw, np.uint8, head[12], at), bitorder="little"
        ) if head[12] else np.zeros(self.n, bool)
        first -= (first >> 63) << 64
        self.doc_ids = [None if z else first + x for x, z in zip(keys, nulls)]
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at + head[12])

    def bounds(self) -> Iterator[tuple[int, int]]:
        """(start, end) of each document in the ids, by selects of a few thousand at a time."""
        start = 0
        for i in range(0, self.n, 4096):
            for end in self.ends.select_many(i, min(4096, self.n - i)).tolist():
                yield start, end
                start = end

    def document(self, i: int) -> np.ndarray:
        """The ids of the document at i, found with two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pafs.LocalFileSystem(), folder
    )


MANIFEST = "task long, shard int, file string, n_docs long, n_ids long"


def write(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = 1 << 23,
    most_pieces: int = 1_200_000,
) -> DataFrame:
    """Writes token shards in ascending id order below folder.

    Returns the manifest (see MANIFEST) with start long, the ids before each shard.

    Ids are integers (others are cast). Null texts count as empty; a null id sorts first; rows that share an id all stay,
    next to each other, in an order of their texts; other columns are ignored. An empty table gives an empty manifest. A
    task writes under a name of its own attempt, so a repeated task never damages a file, and only files in the manifest
    count. Shards hold about shard_ids ids, and a worker remembers most_pieces pieces, which bounds memory.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = _open(folder)
        enc, task, shard = encoder(tokenizer_path, most_pieces), TaskContext.get(), 0
        width = 2 if enc.size <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{shard:05d}-{uuid.uuid4().hex}.brvtok"
            with fs.open_output_stream(f"{base}/{name}.tmp") as f:
                f.write(shard_bytes(keys, lengths, b"".join(held), width))
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            cells = [[task.partitionId()], [shard], [name], [len(keys)], [sum(lengths)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["task", "shard", "file", "n_docs", "n_ids"],
            )

        fs.create_dir(base, recursive=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    raw += end
                    keys.append(key)
                    lengths.append(len(raw) // 4)
                    held.append(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                if sum(lengths) >= shard_ids:
                    yield flush()
                    keys, lengths, held, shard = [], [], [], shard + 1
        if keys:
            yield flush()
        settle()

    # rows that share an id are dealt by a hash of their text, so that they need not be one range
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shards = cut(rows.select("doc_id", "text").mapInArrow(run, MANIFEST))
    total, offsets = 0, []
    for task, n in sorted(tuple(r) for r in shards.groupBy("task").agg(F.sum("n_ids")).collect()):  # a row for each task
        offsets.append((task, total))
        total += n
    before = spark.createDataFrame(offsets, "task long, before long")
    w = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_ids").over(w), F.lit(0))
    out = shards.join(F.broadcast(before), "task").withColumn("start", start)
    return cut(out.repartition(max(1, min(shards.count(), parts)), "file"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it), n_tokens and ids_crc32 (of its little-endian uint32 ids).

    Documents are found through the select structure of the boundaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the tables of a worker that has written before
        fs, base = _open(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as f:
                    shard = Shard(f.read())
                ids = memoryview(shard.ids.astype("<u4")).cast("B")
                found = [(start + a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in shard.bounds()]
                cols = [
                    pa.array(shard.doc_ids, pa.int64()),
                    *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, folder, byte_bpe_path()), folder)
