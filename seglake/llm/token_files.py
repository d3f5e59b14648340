"""Token ids in seekable files: one independent zstandard frame per document and a trailing seek table.

A file is a header frame, one frame per document in ascending doc_id order, and a skippable frame with the size and the
checksum of every frame, laid out as in zstandard's published seekable format. A reader takes the end of the file, then the
header, then the frames of the documents asked for, and nothing else. Files lie in the cluster's shared folder. Each attempt
of a task writes names of its own, and only files of successful attempts get into the manifest."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_folder
from .common import spans, written
from .pieces import MOST_PIECES, encoder

#: Fixed numbers of the seekable format: skippable frame, seek table, and the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
HEADER = struct.Struct("<II")
#: A file is closed once it holds this many bytes.
FILE_BYTES = 128 << 20
#: Files are read in a task each, up to so many tasks.
MOST_TASKS = 20_000
MANIFEST = "path string, part long, seq long, n_docs long, n_ids long"


def shared_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """One file. ``width`` is the number of bytes of a stored id, 2 or 4."""

    def __init__(self, files: fs.FileSystem, path: str, width: int):
        self.files, self.path, self.width = files, path, width
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.size = self.n_ids = 0

    def _frame(self, raw: bytes) -> tuple[bytes, tuple[int, int, int]]:
        packed = self.squeeze.compress(raw)
        return packed, (len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        packed, entry = self._frame(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.frames.append(packed)
        self.entries.append(entry)
        self.ids.append(doc_id)
        self.size += len(packed)
        self.n_ids += len(ids)

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        names = np.array([i or 0 for i in self.ids], dtype="<i8")
        head, entry = self._frame(HEADER.pack(self.width, len(self.ids)) + names.tobytes() + known.tobytes())
        table = b"".join(ENTRY.pack(*e) for e in [entry, *self.entries]) + FOOTER.pack(len(self.ids) + 1, CHECKSUMS, SEEKABLE)
        with self.files.open_output_stream(self.path, compression=None) as out:
            out.write(head)
            for frame in self.frames:
                out.write(frame)
            out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Documents of one file by position; frames that are not asked for are neither read nor decompressed."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.source = files.open_input_file(path)
        size = self.source.size()
        n, _, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        length = n * ENTRY.size
        self.entries = np.frombuffer(self.source.read_at(length, size - FOOTER.size - length), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.cumsum(self.entries[:, 0]) - self.entries[:, 0]
        self.expand = zstandard.ZstdDecompressor()
        head = self.frame(0)
        self.width, self.n_docs = HEADER.unpack_from(head)
        self.names = np.frombuffer(head, dtype="<i8", count=self.n_docs, offset=HEADER.size)
        self.known = np.frombuffer(head, dtype=np.uint8, count=self.n_docs, offset=HEADER.size + 8 * self.n_docs)
        self.sizes = self.entries[1:, 1] // self.width

    def frame(self, i: int) -> bytes:
        packed, size, check = self.entries[i].tolist()
        raw = self.expand.decompress(self.source.read_at(packed, int(self.offsets[i])), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frame(i + 1), dtype="<u2" if self.width == 2 else "<u4").astype("<u4")

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, path: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes the ids of every whole text of ``docs`` (doc_id, text) and returns the manifest: path, part, seq, n_docs, n_ids.

    Documents are in ascending doc_id order over all files, null ids first, equal ids by a hash of their text; repeated rows
    are written as often as they come. A null text has no ids but ``end_id``, which ends every document if it is given.
    ``path`` is a tokenizer file whose pre-tokenizer drops white space. Without rows there are no files."""
    spark = docs.sparkSession
    target = f"{folder or checkpoint_folder(spark)}/token-files-{uuid.uuid4().hex}"
    files, base = shared_filesystem(target)
    files.create_dir(base, recursive=True)
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, MOST_PIECES * 3 // 2)  # nothing else takes memory here
        files, base = shared_filesystem(target)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        width = 2 if max(tokens.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0) < 1 << 16 else 4
        end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        done: list[Writer] = []
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in spans([len(t) for t in texts]):
                ids, bounds = tokens.encode(texts[lo:hi])
                for i in range(lo, hi):
                    if not done or done[-1].size >= FILE_BYTES:
                        if done:
                            done[-1].close()
                            done[-1].frames = []
                        done.append(Writer(files, f"{base}/part-{part:06d}-{len(done):04d}-{attempt}.zst", width))
                    done[-1].add(names[i], np.concatenate((ids[bounds[i - lo]:bounds[i - lo + 1]], end)))
        if done:
            done[-1].close()
        yield pa.RecordBatch.from_pylist(
            [{"path": f"{target}/{w.path.rpartition('/')[2]}", "part": part, "seq": i, "n_docs": len(w.ids), "n_ids": w.n_ids} for i, w in enumerate(done)],
            schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("part", "seq", "n_docs", "n_ids")]]))

    return written(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds base, the number of ids in all files before: sums per task are carried along first, then files within a task."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = manifest.withColumn("_own", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return inside.join(parts, "part").select(*manifest.columns, (F.col("_own") + F.col("_before")).alias("base"))


def read(manifest: DataFrame, wanted: Iterable[int] | None = None, ids: bool = True) -> DataFrame:
    """Documents read back from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for,
    ids. With ``wanted`` only the frames of these doc_ids are read."""
    asked = None if wanted is None else frozenset(wanted)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if ids:
        kinds, schema = [*kinds, ("ids", pa.list_(pa.int64()))], schema + ", ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(*shared_filesystem(path))
                starts = base + np.cumsum(reader.sizes) - reader.sizes
                rows: list[list] = [[] for _ in kinds]
                for i in range(reader.n_docs):
                    name = int(reader.names[i]) if reader.known[i] else None
                    if asked is not None and name not in asked:
                        continue
                    own = reader.document(i)
                    for column, value in zip(rows, (name, int(starts[i]), len(own), zlib.crc32(own.tobytes()), own.astype(np.int64))):
                        column.append(value)
                    if len(rows[0]) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, (_, k) in zip(rows, kinds)], names=[n for n, _ in kinds])
                        rows = [[] for _ in kinds]
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, (_, k) in zip(rows, kinds)], names=[n for n, _ in kinds])

    tasks = min(max(manifest.count(), 1), MOST_TASKS)  # a number that is given is not coalesced: files are read side by side
    return with_base(manifest).select("path", "base").repartition(tasks).mapInArrow(run, schema)
