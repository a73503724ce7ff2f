"""Importance resampling towards a target by hashed word features, aggregated in bit slices.

The bucket counts of a document are kept as planes of one bit per bucket: plane i has the bits of value 2^i. The gains
of the buckets are planes as well, in two's complement, the last one counting negative. A document's weight is then

    sum over i, j of 2^i * 2^j * popcount(document plane i AND gain plane j)

in whole numbers, so it is exact. Texts are cut and hashed once; counts of the corpus and weights both come from the
written planes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.llm.common import drop, slices, written
from apidrift.llm.order import with_running_total
from apidrift.llm.words import Checksums, byte_table, cut, longer

BUCKETS = 10_000
LONGEST = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5
#: Everything in ASCII but letters and digits parts words.
TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Texts whose counts are held at once, and planes that are unpacked at once.
TEXTS, PLANES = 256, 1024


def _plane_bytes(buckets: int) -> int:
    return -(-buckets // 64) * 8


def feature_buckets(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every feature, and the number of words of each text."""
    found = cut(texts, TABLE)
    coded = found.words.dictionary_encode()
    sums = Checksums(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False))
    at = np.arange(len(found.words))
    value, owners, values = sums.first, [found.text], [sums.first]
    for _ in range(longest - 1):
        # Runs that end one word later; all words of a text follow each other here.
        at, value = longer(found.linked, at, value)
        value = sums.extended(value, at)
        owners.append(found.text[at])
        values.append(value)
    return np.concatenate(owners), np.concatenate(values) % buckets, found.counts


def planes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of each row of ``counts``, as bytes in a row, and the number of planes of each row."""
    rows, buckets = counts.shape
    most = counts.max(axis=1, initial=0)
    depth = np.ceil(np.log2(most + 1.0)).astype(np.int64)
    planes = np.zeros((rows, int(depth.max(initial=0)), _plane_bytes(buckets)), np.uint8)
    for i in range(planes.shape[1]):
        deep = np.flatnonzero(depth > i)
        planes[deep, i, : -(-buckets // 8)] = np.packbits(counts[deep] & (1 << i) != 0, axis=1, bitorder="little")
    return planes[np.arange(planes.shape[1]) < depth[:, None]], depth


def feature_planes(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, planes) of every row."""
    width = _plane_bytes(buckets)

    def run(batches):
        for batch in slices(batches, "text"):
            owner, bucket, n_words = feature_buckets(batch["text"], buckets, longest)
            n_features = np.bincount(owner, minlength=batch.num_rows)
            order = np.argsort(owner, kind="stable")
            owner, bucket = owner[order], bucket[order]
            for start in range(0, batch.num_rows, TEXTS):
                stop = min(start + TEXTS, batch.num_rows)
                mine = slice(*np.searchsorted(owner, [start, stop]))
                places = (owner[mine] - start) * buckets + bucket[mine]
                counts = np.bincount(places, minlength=(stop - start) * buckets).reshape(stop - start, buckets)
                data, depth = planes_of(counts)
                ends = np.concatenate([[0], np.cumsum(depth * width)])
                planes = pa.Array.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(start, stop - start), pa.array(n_words[start:stop]), pa.array(n_features[start:stop]), planes.cast(pa.binary())],
                    names=["id", "n_words", "n_features", "planes"],
                )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, planes binary")


def _unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All planes of a column as rows of 64-bit words, the row that each belongs to, and its power of two."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    depth = np.diff(ends) // width
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if depth.any() else np.zeros(0, np.uint8)
    power = np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth)
    return data.reshape(-1, width), np.repeat(np.arange(len(depth)), depth), power


def bucket_counts(planes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; ``buckets`` rows reach the driver."""
    width = _plane_bytes(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, _, power = _unpacked(batch["planes"], width)
            for i in np.unique(power):
                mine = np.flatnonzero(power == i)
                for start in range(0, len(mine), PLANES):
                    bits = np.unpackbits(data[mine[start : start + PLANES]], axis=1, count=buckets, bitorder="little")
                    total += bits.sum(axis=0, dtype=np.int64) << i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    result = np.zeros(buckets, np.int64)
    summed = planes.select("planes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        result[row["bucket"]] = row["n"]
    return result


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one feature a bucket."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source, target)], np.int64
    )


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement planes of the gains and what a bit of each is worth."""
    size = int(max(gains.max(initial=0), -(gains.min(initial=0) + 1))).bit_length()
    bits = (gains[None, :] >> np.arange(size + 1)[:, None]) & 1
    planes = np.zeros((size + 1, _plane_bytes(len(gains))), np.uint8)
    planes[:, : -(-len(gains) // 8)] = np.packbits(bits.astype(bool), axis=1, bitorder="little")
    worth = np.int64(1) << np.arange(size + 1, dtype=np.int64)
    worth[-1] = -worth[-1]
    return planes.view(np.uint64), worth


def weights(planes: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the sum of the gains over its features."""
    width = _plane_bytes(len(gains))
    sliced, worth = gain_planes(gains)

    def run(batches):
        for batch in batches:
            data, row, power = _unpacked(batch["planes"], width)
            value = np.zeros(len(data), np.int64)
            for start in range(0, len(data), PLANES):
                own = np.ascontiguousarray(data[start : start + PLANES]).view(np.uint64)
                for plane, bit in zip(sliced, worth):
                    value[start : start + PLANES] += bit * np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, value << power)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "n_words", "n_features")), pa.array(total)], names=["id", "n_words", "n_features", "weight"])

    kind = planes.schema["id"].dataType.simpleString()
    return planes.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: str, seed: int = SEED) -> Column:
    """floor(1000 g) with g Gumbel noise drawn from a hash of the id (null: as an empty id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Importance of every row and the ``percent`` of all rows with ``min_words`` that are drawn without replacement.

    Returns (id_col, n_features, weight, score, rank), one row per row of ``docs``; rank is null where a row isn't
    drawn. Features are runs of one to ``longest`` words, hashed to ``buckets``; ``weight`` is the exact sum of the
    gains of its features, ``score`` adds Gumbel noise of the id, so the highest scores are a draw in proportion
    to the weights.

    Null and empty texts, and texts without words: no features, weight 0, never drawn. Repeated ids are rows of
    their own with the same noise; equal scores go to the smaller id (null last), then to the first row read. A null
    id draws its noise from the empty id. An empty ``target`` or ``docs`` is smoothed like any other. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    planes, planes_path = written(feature_planes(docs, buckets, longest, id_col, text_col), "feature-planes")
    aims = feature_planes(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), buckets, longest, "id", "text")
    gains = gains_of(bucket_counts(planes, buckets), bucket_counts(aims, buckets))
    scored, scored_path = written(
        weights(planes, gains).withColumn("score", F.col("weight") + noise("id", seed)).withColumn("at", F.monotonically_increasing_id()), "importance"
    )
    drop(spark, planes_path)
    allowed = scored.filter(F.col("n_words") >= min_words)
    drawn = allowed.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("at").asc()]
    placed, _ = with_running_total(allowed.withColumn("one", F.lit(1).cast("bigint")), order, "one", "ahead")
    ranked = placed.withColumn("rank", F.when(F.col("ahead") < drawn, F.col("ahead") + 1))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
