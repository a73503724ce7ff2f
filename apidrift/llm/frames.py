"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame per document: its ids as little-endian 32-bit integers, compressed alone and with zstandard's
own content checksum. Two skippable frames follow: the ids and lengths of the documents, and the seek table of the
public seekable format (compressed size, size, low half of the XXH64 of the content, per frame). A reader takes the
two from the end of the file and decompresses only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.llm.common import slices, with_row_id, written
from apidrift.llm.order import totals_before
from apidrift.llm.tokens import default_tokenizer, encoder
from apidrift.session import fresh_path

#: Fixed values of the seekable format: magic numbers, and the flag for checksums.
SKIPPABLE_SEEK, SKIPPABLE_OWN, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
END_ID = 2
LEVEL = 3
FRAMES_PER_READ = 4096


@dataclass
class FrameIndex:
    """What the end of a file tells: where frames lie, their checksums, whose they are."""

    offsets: np.ndarray
    sizes: np.ndarray
    checksums: np.ndarray
    doc_ids: np.ndarray
    named: np.ndarray
    n_tokens: np.ndarray


def write_file(out, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write (id, content) pairs as frames; returns the numbers of documents and of tokens."""
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
    table, owners = bytearray(), bytearray()
    for doc_id, content in documents:
        frame = compressor.compress(content)
        out.write(frame)
        table += struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        owners += struct.pack("<qBq", doc_id or 0, doc_id is not None, len(content) // 4)
    n = len(table) // 12
    own = compressor.compress(bytes(owners))
    # The own frame's length is repeated at its end, so that it can be found from the seek table.
    out.write(struct.pack("<II", SKIPPABLE_OWN, len(own) + 4) + own + struct.pack("<I", len(own)))
    out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + bytes(table) + struct.pack("<IBI", n, CHECKSUMS, SEEKABLE))
    return n, sum(x[0] for x in struct.iter_unpack("<9xq", bytes(owners)))


def read_index(file) -> FrameIndex:
    """The index of an opened file; raises where it is not such a file."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the file")
    at = size - 9 - 12 * n
    table = np.frombuffer(file.read_at(12 * n, at), "<u4").reshape(-1, 3)
    (own,) = struct.unpack("<I", file.read_at(4, at - 12))
    owners = np.frombuffer(
        zstandard.ZstdDecompressor().decompress(file.read_at(own, at - 12 - own)), np.dtype([("id", "<i8"), ("named", "u1"), ("n", "<i8")])
    )
    sizes = table[:, 0].astype(np.int64)
    return FrameIndex(np.cumsum(sizes) - sizes, sizes, table[:, 2], owners["id"], owners["named"].astype(bool), owners["n"])


def read_frame(file, index: FrameIndex, frame: int, decompressor: zstandard.ZstdDecompressor) -> bytes:
    """Content of one frame, checked against both checksums."""
    content = decompressor.decompress(file.read_at(int(index.sizes[frame]), int(index.offsets[frame])))
    if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != index.checksums[frame]:
        raise ValueError(f"frame {frame} does not match its checksum")
    return content


def opened(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents in ascending id order; returns the written list of files (part, path, documents, tokens).

    The rows are range-partitioned by id; each task writes one file under a name of its own attempt, and the list
    names the files of the attempts that ended well, so a lost executor leaves nothing but unlisted files.
    Null ids come first; equal ids follow each other. Null and empty texts are documents of the end id alone.
    An empty table has an empty list.
    """
    tokenizer = tokenizer or default_tokenizer()
    system, name = fs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)

    def contents(batches):
        for batch in slices(batches, "text"):
            ids, counts = encoder(tokenizer).encode(batch["text"])
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes()
            ends = np.cumsum(4 * (counts + 1))
            for doc_id, start, end in zip(batch["id"].to_pylist(), ends - 4 * (counts + 1), ends):
                yield doc_id, ids[start:end]

    def run(batches):
        documents = contents(batches)
        first = next(documents, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        system, name = fs.FileSystem.from_uri(path)

        def all_documents():
            yield first
            yield from documents

        with system.open_output_stream(name, compression=None) as out:
            n, tokens = write_file(out, all_documents())
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "documents": [n], "tokens": [tokens]})

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # Equal ids, and equal rows, may be dealt to several files, which keeps the order and no id in one task.
    tie = F.xxhash64("text")
    numbered = with_row_id(narrow, "row").repartitionByRange("id", tie, "row")
    ordered = numbered.sortWithinPartitions("id", tie, "text").select("id", "text")
    listed, _ = written(ordered.mapInArrow(run, "part bigint, path string, documents bigint, tokens bigint"), "token-file-list")
    return listed


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before it. Reads are dealt out in runs of frames, so one file does
    not hold up a task.
    """

    def run(batches):
        for batch in batches:
            for path, before, first, last in zip(*[batch[c].to_pylist() for c in ("path", "before", "first", "last")]):
                yield from frames(path, before, first, last)

    def frames(path, before, first, last) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        with opened(path) as file:
            index = read_index(file)
            starts = before + np.cumsum(index.n_tokens) - index.n_tokens
            for at in range(first, last, 256):
                part = slice(at, min(at + 256, last))
                contents = [read_frame(file, index, i, decompressor) for i in range(part.start, part.stop)]
                ids = pa.array(index.doc_ids[part], mask=~index.named[part])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts[part]), pa.array(index.n_tokens[part]), pa.array(contents, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("documents") - 1, F.lit(FRAMES_PER_READ).cast("bigint"))).alias("first")
    reads = (
        files.join(F.broadcast(totals_before(files, "tokens")), "part")
        .select("path", "before", "documents", first)
        .withColumn("last", F.least(F.col("first") + FRAMES_PER_READ, "documents"))
        .repartition("path", "first")
    )
    return reads.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def find_documents(spark: SparkSession, files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of the wanted documents alone; no other frame is decompressed."""
    wanted = sorted(set(doc_ids))

    def run(batches):
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch["path"].to_pylist():
                with opened(path) as file:
                    index = read_index(file)
                    found = np.flatnonzero(index.named & np.isin(index.doc_ids, wanted))
                    contents = [read_frame(file, index, i, decompressor) for i in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.doc_ids[found]), pa.array(index.n_tokens[found]), pa.array(contents, pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )

    return files.select("path").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def token_frames(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents written to token files in the shared folder and read back; see the two functions above."""
    folder = fresh_path(docs.sparkSession, "token-frames")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, id_col, text_col))


