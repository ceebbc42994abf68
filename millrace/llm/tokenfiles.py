"""Token-id files: independent zstandard frames with a seek table.

A file (shard) is, in this order,
1. a skippable frame (magic 0x184D2A50) with the header below,
2. one zstandard frame per document, holding its ids as little-endian unsigned
   integers of 2 or 4 bytes, with content size and checksum,
3. a skippable frame (magic 0x184D2A51) with the documents' ids: a byte each
   that is 1 for a null id, then 8 bytes each,
4. the seek table of the public zstandard seekable format (skippable frame
   0x184D2A5E): for each frame above its compressed size, its decompressed size
   and the low 32 bits of the XXH64 of its content, then the number of frames,
   the descriptor 0x80 (checksums) and the magic number 0x8F92EAB1.
A reader finds the table from the file's end and decompresses the frames it
wants. Any zstandard tool can decompress a whole file.

Files are written by Spark's own text writer, so its commit protocol makes
them appear once even if tasks are retried, on any file system that Spark can
write: a row is a file without its last four bytes, and the line separator is
those four bytes, the magic number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import encoder
from millrace.llm.shared import stored

HEAD, INDEX, SEEK = 0x184D2A50, 0x184D2A51, 0x184D2A5E
MAGIC = struct.pack("<I", 0x8F92EAB1)
#: version, bytes of an id, partition, shard within it
_HEADER = struct.Struct("<4sHHIIQ")
SHARD_BYTES, SHARD_DOCS = 16 << 20, 65536
#: Texts that a worker takes out of a batch at once.
ROWS = 500


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Collects documents; ``finish`` gives the file without its last four bytes."""

    def __init__(self, partition: int, shard: int, width: int, level: int = 3):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.width = width
        head = _skippable(HEAD, _HEADER.pack(b"MRTK", 1, width, partition, shard, 0))
        self.frames, self.table, self.ids = [head], [(len(head), 0, 0)], []
        self.size = len(head)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian, of 4 bytes each."""
        data = ids if self.width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
        frame = self.packer.compress(data)
        self.frames.append(frame)
        self.table.append((len(frame), len(data), _xxh(data)))
        self.ids.append(doc_id)
        self.size += len(frame)

    def finish(self) -> bytes:
        none = np.array([i is None for i in self.ids], dtype=np.uint8)
        index = _skippable(INDEX, none.tobytes() + np.array([i or 0 for i in self.ids], dtype="<i8").tobytes())
        table = [*self.table, (len(index), 0, 0)]
        entries = np.array(table, dtype="<u4").tobytes()
        seek = _skippable(SEEK, entries + struct.pack("<IB", len(table), 0x80) + MAGIC)
        return b"".join([*self.frames, index, seek])[:-4]


class ShardReader:
    """Random access to a shard given as bytes or as a seekable file."""

    def __init__(self, source):
        import io

        import zstandard

        self.file = io.BytesIO(source) if isinstance(source, (bytes, memoryview)) else source
        self.unpacker = zstandard.ZstdDecompressor()
        size = self.file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != 0x8F92EAB1 or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(self.table[:, 0])]
        name, version, self.width, self.partition, self.shard, _ = _HEADER.unpack(self._at(8, _HEADER.size))
        if name != b"MRTK" or version != 1:
            raise ValueError("not a token-id file")
        docs = n - 2
        index = self._at(int(self.offsets[n - 1]) + 8, 9 * docs)
        ids = np.frombuffer(index[docs:], dtype="<i8")
        self.ids = [None if none else int(i) for none, i in zip(index[:docs], ids, strict=True)]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def raw(self, n: int) -> bytes:
        """The content of document ``n``; only its frame is read and decompressed. Fails if a checksum doesn't hold."""
        size, length, check = self.table[n + 1]
        data = self.unpacker.decompress(self._at(int(self.offsets[n + 1]), int(size)))
        if len(data) != length or _xxh(data) != check:
            raise ValueError(f"document {n} of the shard is damaged")
        return data

    def tokens(self, n: int) -> np.ndarray:
        return np.frombuffer(self.raw(n), dtype=f"<u{self.width}").astype("<u4")


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS,
) -> None:
    """Encode every text (null: empty), append ``end_id``, and write the shards in ascending order of id to ``path``.

    Null ids come first; equal ids are ordered by a hash of their text, and
    range bounds use that hash too, so even one id that many rows share is
    spread. Other columns are ignored; an empty table gives no file.
    """
    content = Path(tokenizer_file).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        width = 2 if max(encode.library.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        end, partition, shard, out = struct.pack("<I", end_id), TaskContext.get().partitionId(), 0, None
        row = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], names=["value"])
        for batch in batches:
            for some in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), encode.batch(texts), strict=True):
                    out = out or ShardWriter(partition, shard, width)
                    out.add(doc_id, ids + end)
                    if out.size >= shard_bytes or len(out.ids) >= shard_docs:
                        yield row(out)
                        out, shard = None, shard + 1
        if out:
            yield row(out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    ranged = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    files = ranged.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_token_files(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, tokens) of all documents, or of those asked for, whose frames alone are decompressed.

    Null ids and repeated rows come out as they went in, empty texts as the end
    id alone; ids that no file holds give nothing, an empty folder gives an
    empty result.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = ShardReader(content.as_py())
                for n, doc_id in enumerate(shard.ids):
                    if wanted is None or doc_id in wanted:
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([shard.tokens(n).astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    return _shards(spark, path).mapInArrow(unpack, "doc_id long, tokens array<long>")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of every document; start counts the ids of all before it.

    Null ids stand first and repeated rows side by side, each with a start of
    its own; an empty folder gives an empty result.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = ShardReader(content.as_py())
                sizes = shard.table[1:-1, 1] // shard.width
                sums = [zlib.crc32(shard.tokens(n).tobytes()) for n in range(len(shard.ids))]
                total = len(shard.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.partition] * total, pa.int64()), pa.array([shard.shard] * total, pa.int64()), pa.array(shard.ids, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["partition", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = stored(_shards(spark, path).mapInArrow(digest, "partition long, shard long, doc_id long, within long, n_tokens long, ids_crc32 long"), "token-digests")
    # ids before a shard: those of earlier partitions (one row each) and of earlier shards of its own
    shards = rows.groupBy("partition", "shard").agg(F.sum("n_tokens").alias("ids"))
    parts = shards.groupBy("partition").agg(F.sum("ids").alias("ids"))
    up_to = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("partition", up_to(Window.orderBy("partition")).alias("base"))
    shards = shards.select("partition", "shard", up_to(Window.partitionBy("partition").orderBy("shard")).alias("inner"))
    bases = shards.join(parts, "partition").select("partition", "shard", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(bases, ["partition", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
