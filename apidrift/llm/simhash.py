"""SimHash near-duplicates, found by Golay-code fuzzy hashing of fingerprint segments.

A fingerprint's 64 bits are three segments of 22, 21 and 21. Where two fingerprints differ in two bits at most,
some segment is equal and the one after it differs in one bit at most. So each fingerprint is filed three times,
under an equal segment and every nearby Golay codeword of the next one, and linked fingerprints meet under at
least one key. What meets is verified by its bit distance.

All steps work on distinct fingerprints, so copies never multiply. Keys with few fingerprints are joined with
themselves. For keys with many, each fingerprint is filed under itself and its 64 one-bit changes: fingerprints
two bits apart meet there, at most 65 can, and all that meet are linked, so a star replaces the pairs. Both ways
are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import drop, slices, split_words, written
from apidrift.llm.components import components
from apidrift.llm.golay import nearby

SEED = 42
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more fingerprints than this go by one-bit changes; either way gives all links.
PAIRED = 32
SHINGLE_BYTES = 2 << 20
BLOCK = 1 << 16
SPACE = pa.scalar(" ", pa.large_string())


def fingerprint_array(texts: pa.Array, shingle: int) -> np.ndarray:
    """64-bit SimHash of each text as uint64; zero for a text without words, null included."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, counts = split_words(lower)
    ends = np.cumsum(counts)
    windows = np.maximum(counts - shingle + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(ends - counts, windows)
    parts = [words.take(pa.array(first + i)) for i in range(shingle)]
    hashes = np.empty(len(owner), np.uint64)
    for start in range(0, len(owner), BLOCK):
        joined = pc.binary_join_element_wise(*[p.slice(start, BLOCK) for p in parts], SPACE).cast(pa.large_binary())
        hashes[start : start + len(joined)] = [xxhash.xxh64_intdigest(x, SEED) for x in joined.to_pylist()]
    ones = np.zeros((len(counts), 64), np.int64)
    for start in range(0, len(owner), BLOCK):
        bits = np.unpackbits(hashes[start : start + BLOCK, None].astype("<u8").view(np.uint8), axis=1, bitorder="little")
        docs = owner[start : start + BLOCK]
        runs = np.flatnonzero(np.diff(docs, prepend=-1))
        ones[docs[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    result = ((2 * ones > windows[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    for doc in np.flatnonzero((counts > 0) & (counts < shingle)):
        text = " ".join(words.slice(ends[doc] - counts[doc], counts[doc]).to_pylist())
        result[doc] = xxhash.xxh64_intdigest(text.encode(), SEED)
    return result


def with_fingerprint(docs: DataFrame, shingle: int, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint of the whole text as a signed bigint column ``name``."""

    def run(batches):
        for batch in slices(batches, text_col, SHINGLE_BYTES):
            values = pa.array(fingerprint_array(batch[text_col], shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def fuzzy_keys(fingerprints: DataFrame) -> DataFrame:
    """(key, fp): the keys under which each distinct fingerprint is filed."""

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False)
            parts = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & (1 << n) - 1 for at, n in SEGMENTS]
            for k in range(3):
                index = nearby(parts[(k + 1) % 3])
                key = (np.int64(k) << 34 | parts[k][:, None] << 12) | index
                full = index >= 0
                filed = np.broadcast_to(fp[:, None], index.shape)[full]
                yield pa.RecordBatch.from_arrays([pa.array(key[full]), pa.array(filed)], names=["key", "fp"])

    return fingerprints.select("fp").mapInArrow(run, "key bigint, fp bigint")


def links(fingerprints: DataFrame) -> tuple[DataFrame, list[str]]:
    """Edges (u, v) that connect every two distinct fingerprints at most two bits apart, and what to drop later."""
    keys, keys_path = written(fuzzy_keys(fingerprints), "keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared, path = written(keys.join(sizes, "key"), "shared-keys")
    drop(fingerprints.sparkSession, keys_path)
    few = shared.filter(F.col("n") <= PAIRED)
    left, right = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = left.join(right, "key").filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
    changes = [0, *[1 << bit for bit in range(63)], -(1 << 63)]
    many = shared.filter(F.col("n") > PAIRED).select("fp").distinct()
    probes = many.select("fp", F.explode(F.array(*[F.lit(c).cast("bigint") for c in changes])).alias("change"))
    met = probes.groupBy(F.col("fp").bitwiseXOR(F.col("change")).alias("probe")).agg(
        F.min("fp").alias("u"), F.collect_list("fp").alias("all")
    )
    stars = met.filter(F.size("all") > 1).select("u", F.explode("all").alias("v")).filter("u != v")
    return pairs.select("u", "v").unionByName(stars).distinct(), [path]


def group_of_fingerprint(grouped: DataFrame) -> DataFrame:
    """(fp, component): the smallest ``first`` that each distinct fingerprint can reach.

    ``grouped`` has one row (fp, first) per distinct fingerprint and must be a written table.
    """
    edges, paths = links(grouped)
    reached, roots_path = written(components(edges), "roots")
    drop(grouped.sparkSession, *paths)
    members = grouped.join(reached, grouped["fp"] == reached["node"]).select("fp", "first", "root")
    component = members.groupBy("root").agg(F.min("first").alias("component"))
    moved = members.join(component, "root").select("fp", "component")
    return (
        grouped.join(moved, "fp", "left")
        .select("fp", F.coalesce("component", "first").alias("component"))
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row: (id_col, fingerprint, component_id).

    Words are runs of characters other than space and \\x09-\\x0D after lower-casing A-Z; h is the XXH64 (seed 42)
    of every run of ``shingle`` words joined by a space, repeats included, or of all words where there are fewer.
    Fingerprints are given as 16 hex digits; rows at most two bits apart are linked, component_id is the smallest
    id that can be reached.

    Null and empty texts, and texts without words: fingerprint zero, linked like any other. Repeated rows give
    repeated rows. A null id gives a row and takes no part in the smallest id; it is null only if all ids are.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the Golay keys are complete for a distance of two bits")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, _ = written(with_fingerprint(narrow, shingle).select("id", "fp"), "fingerprints")
    grouped, _ = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    component, _ = written(group_of_fingerprint(grouped), "components")
    return prints.join(component, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest id (nulls last), the first read among equals.

    Cases as in :func:`near_duplicates`; all rows without words are one group.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the Golay keys are complete for a distance of two bits")
    columns = [F.col(c) for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    # Row numbers are stable only once written; the text itself is written once, inside its row.
    kept_rows, _ = written(
        with_fingerprint(named, shingle).select("row", "id", "fp", F.monotonically_increasing_id().alias("at")), "fingerprinted"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first")
    grouped, grouped_path = written(kept_rows.groupBy("fp").agg(first), "distinct-fingerprints")
    keep, _ = written(group_of_fingerprint(grouped).select(F.col("component.at").alias("at")).distinct(), "kept")
    drop(docs.sparkSession, grouped_path)
    # The kept numbers grow with the documents: never broadcast, whatever the size.
    return kept_rows.join(keep.hint("merge"), "at", "left_semi").select("row.*")
