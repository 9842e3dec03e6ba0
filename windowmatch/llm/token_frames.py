"""Token ids in seekable zstandard files.

A file holds the ids of consecutive documents (ascending ids) as little-endian unsigned 32-bit
numbers, in frames that are compressed independently. A frame ends at the end of a document: it holds
documents of up to ``FRAME`` ids together, or one longer document. Behind the frames lie two
skippable frames:

* the document index: for every document its id, whether it has one, frame and number of ids,
* the seek table of the public seekable format: sizes of every frame compressed and not, the low 32
  bits of the XXH64 (seed 0) of its content, the number of frames, a flag byte and the magic number.

A reader takes the tail of a file, finds the frames of the documents it wants, reads and decompresses
those alone and verifies them by their checksums.

Files are written by the tasks under names that no other attempt of a task has. A file counts only if
it is in the manifest that Spark commits, so failed and speculative attempts leave no trace in results.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from windowmatch.llm.shared import Staged, crc
from windowmatch.llm.tokens import encoder
from windowmatch.staging import fresh_path

END = 1
FRAME = 1 << 16
LEVEL = 3
#: Fixed values of the public formats: skippable frames (index, seek table) and the seek table's end.
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKED = 0x80


@dataclass(frozen=True)
class Tail:
    """Where the frames of a file are and what documents they hold."""

    starts: np.ndarray
    packed: np.ndarray
    unpacked: np.ndarray
    checksums: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    frames: np.ndarray
    sizes: np.ndarray


class Writer:
    """Writes one file; documents come in the order in which they are to be read."""

    def __init__(self, out):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, bool, int, int]] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and self.size + len(ids) > 4 * FRAME:
            self.flush()
        self.documents.append((doc_id or 0, doc_id is not None, len(self.frames), len(ids) // 4))
        self.open.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        if not self.open:
            return
        data = b"".join(self.open)
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        n = len(self.documents)
        ids, named, frames, sizes = zip(*self.documents) if n else ((), (), (), ())
        columns = (np.array(ids, "<i8"), np.array(named, "u1"), np.array(frames, "<u4"), np.array(sizes, "<u4"))
        index = self.compressor.compress(b"".join(c.tobytes() for c in columns))
        self.out.write(struct.pack("<III", INDEX_MAGIC, len(index) + 4, n) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKED, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)


def read_tail(source) -> Tail:
    """Seek table and document index of an open file."""
    size = source.size()
    count, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != FOOT_MAGIC or flags != CHECKED:
        raise ValueError("not a file of this format")
    begin = size - 9 - 12 * count - 8
    table = np.frombuffer(source.read_at(12 * count, begin + 8), "<u4").reshape(-1, 3).astype(np.int64)
    ends = np.cumsum(table[:, 0])
    at = int(ends[-1]) if count else 0
    magic, length, n = struct.unpack("<III", source.read_at(12, at))
    if magic != INDEX_MAGIC:
        raise ValueError("no document index")
    data = zstandard.ZstdDecompressor().decompress(source.read_at(length - 4, at + 12), max_output_size=max(1, 17 * n))
    ids, named = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n)
    frames, sizes = np.frombuffer(data, "<u4", n, 9 * n), np.frombuffer(data, "<u4", n, 13 * n)
    return Tail(ends - table[:, 0], table[:, 0], table[:, 1], table[:, 2], ids, named, frames, sizes)


def read_documents(source, wanted: Iterable[int] | None = None, tail: Tail | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(id, ids) of the wanted documents, or of all; only frames that hold one are read and decompressed."""
    tail = tail or read_tail(source)
    places = np.arange(len(tail.ids))
    if wanted is not None:
        places = places[np.isin(tail.ids, np.array(list(wanted), np.int64)) & (tail.named > 0)]
    decompressor = zstandard.ZstdDecompressor()
    bounds = np.searchsorted(tail.frames, np.arange(len(tail.starts) + 1))
    for frame in np.unique(tail.frames[places]):
        packed = source.read_at(int(tail.packed[frame]), int(tail.starts[frame]))
        data = decompressor.decompress(packed, max_output_size=max(1, int(tail.unpacked[frame])))
        if xxh64_intdigest(data) & 0xFFFFFFFF != tail.checksums[frame]:
            raise ValueError(f"frame {frame} is damaged")
        mine = np.arange(bounds[frame], bounds[frame + 1])
        ends = np.cumsum(tail.sizes[mine].astype(np.int64)) * 4
        for i in places[tail.frames[places] == frame]:
            end = int(ends[i - mine[0]])
            yield (int(tail.ids[i]) if tail.named[i] else None), data[end - 4 * int(tail.sizes[i]) : end]


def _open(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system, place


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append the end id and write files under ``folder``, ascending by id.

    Returns the manifest, a committed table (path, part, first, documents, tokens): ``first`` is the
    number of ids in all files before. NULL ids come first and stay unnamed; NULL texts are empty;
    repeated rows are written as often as they come; an empty table gives no file.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # so that many rows of one id are many tasks
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shared = encoder(docs.sparkSession, vocabulary, spaced=False)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = shared.value.encode, np.array([END], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.zst"
        writer = out = None
        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    system, place = _open(path)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                    writer = Writer(out)
                ids = encode(text.as_py()) + end
                tokens += len(ids) // 4
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            columns = {"path": [path], "part": [part], "documents": [len(writer.documents)], "tokens": [tokens]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns["path"]), pa.array([part], pa.int32()), pa.array(columns["documents"]), pa.array(columns["tokens"])],
                names=list(columns),
            )

    written = ordered.mapInArrow(write_part, "path string, part int, documents long, tokens long")
    manifest = Staged(written, "manifest").frame
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, in any order of rows.

    ``wanted``: a table of ids (one column); then only their frames are read. The wanted ids reach the
    files by their range of ids.
    """
    files, some = manifest.select("path", "first"), wanted is not None

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks = batch.column(2).to_pylist() if some else [None] * batch.num_rows
            for path, first, pick in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), picks):
                system, place = _open(path)
                with system.open_input_file(place) as source:
                    yield _described(source, first, pick)

    if wanted is not None:
        files = _with_wanted(files, wanted)
    spread = files.repartition(max(1, min(files.count(), 10_000)), "path")
    return spread.mapInArrow(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _described(source, first: int, wanted: list[int] | None) -> pa.RecordBatch:
    tail = read_tail(source)
    begins = first + np.cumsum(tail.sizes.astype(np.int64)) - tail.sizes
    if wanted is None:
        found = [(i, n, crc(ids)) for (i, ids), n in zip(read_documents(source, None, tail), tail.sizes.tolist())]
        starts = begins
    else:
        mask = np.isin(tail.ids, np.array(wanted, np.int64)) & (tail.named > 0)
        found = [(i, len(ids) // 4, crc(ids)) for i, ids in read_documents(source, wanted, tail)]
        starts = begins[mask]
    ids, sizes, sums = zip(*found) if found else ((), (), ())
    columns = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _with_wanted(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files with the ids wanted from them, by the ranges of ids in their indexes."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = _open(path)
                with system.open_input_file(place) as source:
                    tail = read_tail(source)
                ids = np.unique(tail.ids[tail.named > 0])
                columns = [pa.array([path] * len(ids)), pa.array([first] * len(ids), pa.int64()), pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "first", "id"])

    listed = files.mapInArrow(ranges, "path string, first long, id long")
    ids = wanted.select(F.col(wanted.columns[0]).cast("long").alias("id")).distinct()
    return listed.join(ids, "id", "left_semi").groupBy("path", "first").agg(F.collect_list("id").alias("ids"))


def round_trip(docs: DataFrame, vocabulary: str, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts to fresh files in the shared folder and read them back."""
    return read(write(docs, fresh_path(spark, "token-frames"), vocabulary, id_col, text_col))
