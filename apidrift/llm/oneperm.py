"""Document fingerprints by one-permutation MinHash, in column functions alone.

Every run of words is hashed once. The top bits of a hash name its bin, and a bin keeps its least hash: after sorting a
document's hashes, the first of each bin. An empty bin takes the value of the first filled bin in a random order of
its own (optimal densification): a few drawn bins, and where all of these are empty as well, the filled bin with the
least hash of both numbers. What is stored of a bin are the low bits of its value hashed with the bin's number, so a
value that fills several bins is compared afresh in each. Two stored bins agree by chance in one case of 2^bits, which
the estimate of likeness takes off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.operators.ordered import running

SHINGLE = 5
BINS = 256
BITS = 4
#: Bins drawn for an empty bin before all filled ones are ranked.
DRAWS = 16
#: Repeated rows that are given back at once.
COPY_BLOCK = 10_000
WHITE = r"[\x20\x09-\x0D]+"


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("bigint")


def with_fingerprint(
    df: DataFrame, text_col: str, name: str, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS
) -> DataFrame:
    """``df`` and the packed fingerprint of the whole text as an array of 64-bit numbers; zeros for a text without words.

    Words are runs of characters other than white space after lower-casing; a text of fewer than ``shingle`` words is
    one run. ``bins`` is a power of two up to 2^16, ``bits`` a divisor of 64.
    """
    if bins & (bins - 1) or not 64 // bits <= bins <= 1 << 16 or 64 % bits:
        raise ValueError("bins must be a power of two of at least one packed number, bits a divisor of 64")
    shift = 64 - (bins.bit_length() - 1)
    words, hashes, heads, dense, low = (f"_{part}_{name}" for part in ("words", "hashes", "heads", "dense", "low"))

    def bin_of(value: Column) -> Column:
        return F.shiftright(value, shift) + F.lit(bins // 2).cast("bigint")

    split = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WHITE), "")
    # Each step is a column that later ones name more than once, so it is computed once per row.
    df = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(shingle))))
    df = df.withColumn(hashes, F.sort_array(F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<bigint>"))))
    df = df.withColumn(
        heads, F.filter(hashes, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(F.col(hashes), i - 1), shift)))
    )

    def gap_and_value(x: Column, i: Column) -> Column:
        before = F.coalesce(bin_of(F.get(F.col(heads), i - 1)), _long(-1))
        return F.concat(F.array_repeat(F.lit(None).cast("bigint"), (bin_of(x) - before - 1).cast("int")), F.array(x))

    rest = F.lit(bins - 1) - bin_of(F.element_at(F.col(heads), -1)).cast("int")
    df = df.withColumn(
        dense,
        F.when(
            F.size(heads) > 0, F.concat(F.flatten(F.transform(heads, gap_and_value)), F.array_repeat(F.lit(None).cast("bigint"), rest))
        ),
    )

    def stored(x: Column, i: Column) -> Column:
        own = _long(i)
        drawn = [F.get(F.col(dense), F.pmod(F.xxhash64(own, _long(draw)), F.lit(bins)).cast("int")) for draw in range(1, DRAWS + 1)]
        ranked = F.array_min(F.transform(heads, lambda h: F.struct(F.xxhash64(own, bin_of(h), _long(0)).alias("rank"), h.alias("value"))))
        return F.xxhash64(F.coalesce(x, *drawn, ranked["value"]), own).bitwiseAND(_long((1 << bits) - 1))

    df = df.withColumn(low, F.transform(dense, stored))
    per = 64 // bits

    def pack(k: Column) -> Column:
        return F.aggregate(F.slice(low, k * per + 1, F.lit(per)), _long(0), lambda whole, x: F.shiftleft(whole, bits).bitwiseOR(x))

    numbers = F.transform(F.sequence(F.lit(0), F.lit(bins // per - 1)), pack)
    df = df.withColumn(name, F.when(F.col(low).isNull(), F.array_repeat(_long(0), bins // per)).otherwise(numbers))
    return df.drop(words, hashes, heads, dense, low)


def printed(name: str) -> Column:
    """A packed fingerprint as lowercase hex digits."""
    return F.array_join(F.transform(name, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(left: str, right: str, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated share of common runs of words, from 0 to 1; a text without words is like its own kind alone."""
    ones = sum(1 << at for at in range(0, 64, bits))
    mask = F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("bigint")

    def unlike(x: Column, y: Column) -> Column:
        differs = x.bitwiseXOR(y)
        spread = differs
        for bit in range(1, bits):
            spread = spread.bitwiseOR(F.shiftrightunsigned(differs, bit))
        return F.bit_count(spread.bitwiseAND(mask))

    wrong = F.aggregate(F.zip_with(left, right, unlike), F.lit(0), lambda total, x: total + x)
    chance = 1.0 / (1 << bits)
    share = ((1 - wrong / float(bins)) - chance) / (1 - chance)
    zero = F.array_repeat(_long(0), bins * bits // 64)
    same = F.col(left) == F.col(right)
    bare = (F.col(left) == zero) | (F.col(right) == zero)
    return F.when(same, 1.0).when(bare, 0.0).otherwise(F.greatest(F.lit(0.0), share))


def with_next(docs: DataFrame, share: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """(id, key, copies, text, ``name``, next_id, next_text, next_``name``) of every distinct pair of id and text.

    The next row is the one with the next smaller id, after the last one the first; equal ids go by a checksum of
    id and text. ``next_text`` is its beginning alone, as long as a ``share``-th of this row's text. Repeated rows are
    dropped before texts are shuffled; texts are shuffled once by key, beginnings once more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"), 256)
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.unhex(mark), F.lit(b"")).alias("key"), text.alias("text"))
    places = keyed.groupBy("id", "key", F.floor(F.length("text") / share).alias("size")).agg(F.count(F.lit(1)).alias("copies"))
    last = places.agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "key")).alias("last")).first()["last"]
    first_key = F.lit(bytes(last["key"]) if last else b"")
    # Upwards, the row before has the next smaller id.
    wanted = running(places, [], ["id", "key"], previous={"source": F.col("key")}).select(
        F.coalesce("source", first_key).alias("source"), F.col("key").alias("target"), "size", "copies"
    )
    copy = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    once = with_fingerprint(keyed, "text", name).withColumn("copy", copy).filter("copy = 1").drop("copy")
    # Both joins read the same shuffled texts: they need the same columns.
    begins = once.join(wanted.hint("merge"), once["key"] == wanted["source"]).select(
        "target", "copies", F.col("id").alias("next_id"), F.left(F.col("text"), F.col("size").cast("int")).alias("next_text"), F.col(name).alias(f"next_{name}")
    )
    return once.join(begins.hint("merge"), once["key"] == begins["target"]).drop("target")


def edited_fingerprints(docs: DataFrame, *, share: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited text that ends with the beginning of the next one.

    Returns (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id). The edited
    text has the last ``share``-th of its characters replaced by as many from the beginning of the next text in descending
    order of ids (after the last: the first), or by all that there are.

    Null and empty texts, and texts without words: a fingerprint of zeros, like another of that kind (1) and nothing else
    (0). Rows with equal id and text have equal results and count as one place in the order; equal ids with different
    texts are ordered by a checksum; a null id comes last. A single row follows itself. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    paired = with_next(docs, share, id_col, text_col, "print")
    size = F.length("text")
    kept = F.left(F.col("text"), (size - F.floor(size / share)).cast("int"))
    edited = with_fingerprint(paired.withColumn("edited", F.concat(kept, "next_text")), "edited", "edited_print")
    found = edited.select(
        F.col("id").alias(id_col),
        size.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("print").alias("fingerprint"),
        printed("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
        "next_id",
        "copies",
    )
    # In two steps, so that no array has a length that grows with the table.
    blocks = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPY_BLOCK))))
    rows = F.least(F.lit(COPY_BLOCK), F.col("copies") - F.col("block") * COPY_BLOCK).cast("int")
    return blocks.withColumn("row", F.explode(F.array_repeat(F.lit(0), rows))).select(*found.drop("copies").columns)
