"""Token ids of a corpus as binary files with Elias-Fano document boundaries.

Layout of a shard, one file each, little-endian::

    header    9 x int64: magic, documents n, ids m, id width in bytes, position of
              the shard, rows without doc_id, smallest doc_id, bytes of the two
              sections that follow
    doc ids   Elias-Fano code of doc_id - smallest doc_id, ascending
    bounds    Elias-Fano code of the n + 1 boundaries 0 ... m into the id array
    ids       m ids, each document's followed by the end id

An Elias-Fano code of k ascending numbers below u keeps floor(log2(u / k)) low
bits of each number as they are and the high bits in unary: two bits and the low
bits for a number.  A select structure stores where every 256th one of the unary part
is, in 32 bits, so a single boundary is read without decoding the others.

Shards follow ascending doc_id (rows without one come last) and are cut by size.
They are written and read by Spark itself (one shard per text record with its own
file; ``binaryFile`` to read), so any store that Spark reaches will do, and a
lost executor's shards are written again by the commit protocol.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgrain.llm.bpe import LibraryIds
from webgrain.llm.common import make_once, map_batches, ship, whole
from webgrain.llm.token_counts import vocabulary
from webgrain.session import work_folder

MAGIC = 0x314E4B54  # "TKN1"
HEADER = "<9q"
END_ID = 2
SAMPLE = 256
# A shard is closed when its ids reach so many bytes; a single document may be larger.
SHARD_BYTES = 4 << 20
# Characters of a text by which rows of one id are cut into ranges.
BEGINNING = 32
# Bits of a shard's position that count shards of one task; the task's number stands above them.
PLACES = 20


# Elias-Fano ------------------------------------------------------------------


class EliasFano:
    """Ascending non-negative integers; random access by ``select``, all at once by ``values``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self._low, self._high, self._samples = n, low_bits, low, high, samples

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        unary[ones] = 1
        return EliasFano(
            n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"),
            ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4q", self.n, self.low_bits, len(self._low), len(self._high))
        return head + self._low.tobytes() + self._high.tobytes() + self._samples.tobytes()

    @staticmethod
    def from_bytes(data: memoryview) -> EliasFano:
        n, low_bits, low, high = struct.unpack_from("<4q", data)
        take = lambda at, size: np.frombuffer(data, np.uint8, size, at)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), 32 + low + high)
        return EliasFano(n, low_bits, take(32, low), take(32 + low, high), samples)

    def _low_part(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= ((int(self._low[(at + k) >> 3]) >> ((at + k) & 7)) & 1) << k
        return out

    def select(self, i: int) -> int:
        """Number ``i``, from the sample before it and at most ``SAMPLE`` ones after that."""
        at, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        here = int(self._high[byte]) >> (at & 7) << (at & 7)
        while here.bit_count() <= left:
            left -= here.bit_count()
            byte += 1
            here = int(self._high[byte])
        for _ in range(left):
            here &= here - 1
        one = (byte << 3) + (here & -here).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low_part(i)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self._low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


# Shards ----------------------------------------------------------------------


def shard_bytes(place: int, doc_ids: list[int | None], packed: list[bytes], width: int) -> bytes:
    """One shard; ``doc_ids`` ascend, with None after all others."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([0] + [len(p) // width for p in packed])
    # The difference of two int64 fits uint64; numpy wraps to exactly that.
    ids = EliasFano.of(known.view(np.uint64) - np.array(least).view(np.uint64)).to_bytes()
    bounds = EliasFano.of(ends).to_bytes()
    head = struct.pack(HEADER, MAGIC, len(packed), int(ends[-1]), width, place, len(packed) - len(known), least, len(ids), len(bounds))
    return b"".join([head, ids, bounds, *packed])


class Shard:
    def __init__(self, data: bytes) -> None:
        magic, self.n, self.m, self.width, self.place, self.unnamed, self._least, ids, bounds = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(data)
        at = struct.calcsize(HEADER)
        self._ids = EliasFano.from_bytes(view[at:at + ids])
        self.bounds = EliasFano.from_bytes(view[at + ids:at + ids + bounds])
        self.tokens = np.frombuffer(data, f"<u{self.width}", self.m, at + ids + bounds)

    def doc_ids(self) -> list[int | None]:
        known = self._ids.values().astype(np.uint64) + np.array(self._least).view(np.uint64)
        return known.view(np.int64).tolist() + [None] * self.unnamed

    def document(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds.select(i):self.bounds.select(i + 1)]


# Jobs ------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, shard_size: int = SHARD_BYTES,
) -> None:
    """Write the shards of ``docs`` below ``path``.

    NULL text is empty: its document has the end id alone.  Rows without id come
    last; rows that repeat an id stand side by side, in the order of their texts.  Ranges of rows are
    cut by id and then by how the text begins, so rows without id, or of one id, need not meet in one task.
    Extra columns are ignored.  An empty table writes no shard.
    """
    spec = vocabulary(tokenizer)
    shared = ship(docs.sparkSession, spec, len(spec))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = make_once(f"ids-{hashlib.sha256(shared.value.encode()).hexdigest()}", lambda: LibraryIds(shared.value))
        width, end, held, shards, part = library.width, int(end_id).to_bytes(library.width, "little"), 0, 0, 0
        names: list[int | None] = []
        packed: list[bytes] = []

        def closed() -> pa.RecordBatch:
            nonlocal names, packed
            data = shard_bytes(part << PLACES | shards, names, packed, width)
            names, packed = [], []
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["shard"])

        for batch in batches:
            given, parts, texts = (c.to_pylist() for c in batch.columns)
            part = parts[0]
            for name, ids in zip(given, library.packed(texts), strict=True):
                if packed and held >= shard_size:
                    yield closed()
                    held, shards = 0, shards + 1
                names.append(name)
                packed.append(ids + end)
                held += len(packed[-1])
        if packed:
            yield closed()

    # As many ranges as the input has splits, at least, so that a range does not grow with the table.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = [F.col("doc_id").isNull(), F.col("doc_id")]
    given = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
        .repartitionByRange(parts, *order, F.left("text", F.lit(BEGINNING))).sortWithinPartitions(*order, "text")
        .select("doc_id", F.spark_partition_id().cast("long").alias("part"), "text")
    )
    shards = map_batches(given, work, "shard binary", keeps="ids-")
    # One record, one file; the record separator is the file's last byte.
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone, one row per document."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                yield pa.RecordBatch.from_pylist([{"path": name, "place": shard.place, "m": shard.m}])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                bounds = shard.bounds.values()
                crcs = [zlib.crc32(shard.tokens[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * shard.n), pa.array(shard.doc_ids(), pa.int64()), pa.array(bounds[:-1]),
                    pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["path", "doc_id", "at", "n_tokens", "ids_crc32"])

    # One shard at a time reaches a worker: files are large, and each is read whole.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    total = map_batches(files, headers, "path string, place long, m long")
    # Ids before each task's shards, one row for each task, and before each shard within its task.
    total = total.withColumn("part", F.shiftright("place", PLACES))
    before = lambda *by: F.coalesce(F.sum("m").over(
        Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = total.groupBy("part").agg(F.sum("m").alias("m")).select("part", before("part").alias("of_part"))
    bases = total.select("path", "part", before("part", "place").alias("within")).join(tasks, "part")
    bases = bases.select("path", (F.col("of_part") + F.col("within")).alias("base"))
    out = map_batches(files, rows, "path string, doc_id long, at long, n_tokens long, ids_crc32 long").join(bases, "path")
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` below the shared folder and read every document's place back from the files."""
    path = work_folder(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, **options)
    return read_token_files(docs.sparkSession, path)
