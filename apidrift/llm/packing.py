"""Packing documents into token sequences, neighbours along a space-filling curve side by side.

Hashed document vectors are projected to a few dimensions; the Hilbert key of the projection gives the order.
In that order all tokens form one line, which is cut every ``length`` tokens. Only the end of the line can fall
short; it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.common import drop, slices, written
from apidrift.llm.hilbert import curve_key, projected
from apidrift.llm.order import with_running_total
from apidrift.llm.tokens import default_tokenizer, encoder

SEQUENCE_TOKENS = 2048
END_ID = 1
PIECES = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, at, key, doc_tokens, ids): ids little-endian, in two bytes each if all fit, else in four."""

    def run(batches):
        for batch in slices(batches, "text"):
            ids, counts = encoder(tokenizer).encode(batch["text"])
            keys = curve_key(projected(ids, counts))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            ids = ids.astype("<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4")
            counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(keys), pa.array(counts), packed.cast(pa.binary())], names=["id", "key", "doc_tokens", "ids"]
            )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = narrow.mapInArrow(run, "id bigint, key bigint, doc_tokens bigint, ids binary")
    return rows.withColumn("at", F.monotonically_increasing_id())


def cuts(total: int, length: int) -> tuple[int, np.ndarray]:
    """Number of full sequences, and the starts (from the end of those) of the sequences of the rest, with its end."""
    full, rest = divmod(total, length)
    sizes = [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
    return full, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def cut(position: int, tokens: int, length: int, full: int, tail: np.ndarray):
    """Pieces (first token, tokens, sequence, offset) of a document whose tokens start at this position of the line."""
    at, end = position, position + tokens
    while at < end:
        if at < full * length:
            sequence, offset = divmod(at, length)
            stop = (sequence + 1) * length
        else:
            within = int(np.searchsorted(tail, at - full * length, side="right")) - 1
            sequence, offset = full + within, at - full * length - int(tail[within])
            stop = full * length + int(tail[within + 1])
        stop = min(stop, end)
        yield at - position, stop - at, sequence, offset
        at = stop


def pack(
    docs: DataFrame, length: int = SEQUENCE_TOKENS, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its ids and ``end_id``; a piece holds ``length`` of them from ``start``, as little-endian 32-bit
    ``ids``, placed at ``offset`` of its sequence. Sequences have no gaps; all but those of the last few tokens
    are full, and these are powers of two.

    Null and empty texts are documents of the end id alone. Repeated rows and ids are separate documents, null
    ids come first among equal keys. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    texts, _ = written(tokenized(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    total = texts.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    full, tail = cuts(int(total), length)
    order = [F.col("key"), F.col("id"), F.col("at")]
    line, path = with_running_total(texts.select("key", "id", "at", "doc_tokens"), order, "doc_tokens", "position")
    places, _ = written(line.select("at", "position"), "positions")
    drop(spark, path)

    def run(batches):
        for batch in slices(batches, "ids"):
            rows = []
            for doc, position, tokens, packed in zip(*[batch[c].to_pylist() for c in ("id", "position", "doc_tokens", "ids")]):
                ids = np.frombuffer(packed, f"<u{len(packed) // tokens}").astype("<u4")
                for first, n, sequence, offset in cut(position, tokens, length, full, tail):
                    rows.append((doc, first, n, ids[first : first + n].tobytes(), tokens, sequence, offset))
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # Places grow with the documents: never broadcast, whatever the size.
    return texts.join(places.hint("merge"), "at").select("id", "position", "doc_tokens", "ids").mapInArrow(run, PIECES).withColumnRenamed("id", id_col)
