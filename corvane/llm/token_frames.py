r"""Token-id files: independent zstandard frames with a trailing seek table.

One file (shard), in bytes:

    frame 0 .. frame n-1   zstandard frames, each of its own; a frame's content is
                           ids of whole documents, little-endian unsigned 32-bit
    directory              a skippable frame (magic 0x184D2A50): zstandard-compressed
                           rows (doc_id int64, frame uint32, n_tokens uint32, known
                           uint8: 0 for a null doc_id), one a document in file order
    seek table             a skippable frame (magic 0x184D2A5E), as in the public seekable
                           format: a row (compressed size, content size, checksum) of
                           three uint32 for each frame; then the number of frames
                           (uint32), a descriptor byte (0x80: with checksums) and the
                           magic number 0x8F92EAB1
    checksum               the low 32 bits of XXH64 (seed 0) of a frame's content

A reader needs the end of the file to find a document's frame, and decompresses only the
frames it asks for; plain zstandard tools decompress the whole file and skip the rest.
Files are ordered: shard k holds smaller doc_id than shard k + 1, and a shard ascends.

Files are written under another name and then renamed, so a task that runs twice leaves
one whole file; the folder must be one that all executors share. A document's start is
the number of ids in all documents before it. Documents with the same doc_id are ordered
by a hash of their text, equal rows by their place in the input, so they may fill any
number of shards; null ids come first. Null and empty texts have the end id alone. An
empty table has no file and no row. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm.common import durable, filesystem, id_and_text, small_batches

END_ID = 1
#: A frame ends at the first document that fills it to this many ids.
FRAME_IDS = 1 << 16

_SKIP, _SEEK, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_DIRECTORY = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("n_tokens", "<u4"), ("known", "u1")])
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def _check(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents to an open binary file."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.buffer, self.held = [], 0
        self.entries: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.directory.append((doc_id or 0, len(self.entries), len(packed) // 4, doc_id is not None))
        self.buffer.append(packed)
        self.held += len(packed) // 4
        if self.held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self.buffer:
            return
        content = b"".join(self.buffer)
        frame = self.zip.compress(content)
        self.out.write(frame)
        self.entries.append((len(frame), len(content), _check(content)))
        self.buffer, self.held = [], 0

    def close(self) -> None:
        self._flush()
        listed = self.zip.compress(np.array(self.directory, _DIRECTORY).tobytes())
        self.out.write(struct.pack("<II", _SKIP, len(listed)) + listed)
        table = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", _SEEK, len(table) + 9) + table)
        self.out.write(struct.pack("<IBI", len(self.entries), 0x80, _FOOT))


class FrameReader:
    """Reads documents from an open random-access file; checks each frame it decompresses."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _FOOT:
            raise ValueError("no seek table at the end")
        at = end - 9 - frames * _ENTRY.itemsize
        source.seek(at)
        self.entries = np.frombuffer(source.read(frames * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        source.seek(int(self.starts[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        if magic != _SKIP:
            raise ValueError("no directory behind the frames")
        self.directory = np.frombuffer(self.unzip.decompress(source.read(size)), _DIRECTORY)

    def frame(self, k: int) -> bytes:
        entry = self.entries[k]
        self.source.seek(int(self.starts[k]))
        content = self.unzip.decompress(self.source.read(int(entry["packed"])), max_output_size=int(entry["plain"]))
        if len(content) != entry["plain"] or _check(content) != entry["check"]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, packed ids) of the directory's rows, or of those given, by frame."""
        wanted = np.arange(len(self.directory)) if rows is None else np.sort(np.asarray(list(rows), np.int64))
        sizes = self.directory["n_tokens"].astype(np.int64) * 4
        before = np.concatenate([[0], np.cumsum(sizes)])
        first = np.searchsorted(self.directory["frame"], np.arange(len(self.entries)))
        k, content = -1, b""
        for row in wanted:
            if (f := int(self.directory["frame"][row])) != k:
                k, content = f, self.frame(f)
            at = int(before[row] - before[first[k]])
            yield int(self.directory["doc_id"][row]) if self.directory["known"][row] else None, content[at : at + int(sizes[row])]


def read_documents(folder: str, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """The ids of all documents with some doc_ids, in file order; only the frames that hold them are decompressed."""
    wanted = np.unique(np.asarray(list(doc_ids), np.int64))
    found: dict[int, list[np.ndarray]] = {}
    system, path = filesystem(folder)
    from pyarrow import fs

    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.path.endswith(".zst"):
            with system.open_input_file(info.path) as source:
                reader = FrameReader(source)
                rows = np.flatnonzero(np.isin(reader.directory["doc_id"], wanted) & (reader.directory["known"] == 1))
                for d, ids in reader.documents(rows):
                    found.setdefault(d, []).append(np.frombuffer(ids, "<u4"))
    return found


_WRITTEN = "shard int, path string, n_docs long, n_tokens long"
_READ = "shard int, row int, doc_id long, first long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; a row (shard, path, n_docs, n_tokens) for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from corvane.llm.tokens import encoder

        encode = encoder("word_bpe", tokenizer_path).packed
        tail = struct.pack("<I", end_id)
        shard = TaskContext.get().partitionId()
        system, path = filesystem(folder)
        final, own = f"{path}/shard-{shard:06d}.zst", f"{path}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        writer = out = None
        total = 0
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if writer is None:
                        system.create_dir(path, recursive=True)
                        writer = FrameWriter(out := system.open_output_stream(own))
                    writer.add(doc_id, packed := encode(text) + tail)
                    total += len(packed) // 4
            if writer is None:
                return
            writer.close()
        finally:
            if out is not None:
                out.close()
        system.move(own, final)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [final], "n_docs": [len(writer.directory)], "n_tokens": [total]}
        )

    small_batches(docs.sparkSession)
    # by range of doc_id, so that files ascend; an id with many rows is dealt out as well
    order = ("doc_id", "h", "at")
    own = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    placed = own.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    each = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return durable(each.mapInArrow(write, _WRITTEN))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document, read back from the files: see the module."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corvane.llm.tokens import crc32

        system, _ = filesystem(folder)
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as source:
                    reader = FrameReader(source)
                    firsts = np.concatenate([[0], np.cumsum(reader.directory["n_tokens"].astype(np.int64))])
                    crcs = np.fromiter((crc32(ids) for _, ids in reader.documents()), np.int64, len(reader.directory))
                    n = len(reader.directory)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array(np.full(n, shard, np.int32)),
                            "row": pa.array(np.arange(n, dtype=np.int32)),
                            "doc_id": pa.array(reader.directory["doc_id"].astype(np.int64), mask=reader.directory["known"] == 0),
                            "first": pa.array(firsts[:-1]),
                            "n_tokens": pa.array(reader.directory["n_tokens"].astype(np.int64)),
                            "ids_crc32": pa.array(crcs),
                        }
                    )

    # one row a file: the running sum over files needs no more than that
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    # files differ little in size; each goes to a task whole
    listed = files.select("shard", "path").repartition(max(n, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return (
        listed.mapInArrow(read, _READ)
        .join(F.broadcast(bases) if files.count() <= 100_000 else bases, "shard")
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard")
    )


def new_folder(docs: DataFrame) -> str:
    """A folder for files, in the folder that the cluster shares."""
    return common.new_folder(docs.sparkSession, "token-frames")
