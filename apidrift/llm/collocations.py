"""Phrase collocations from count streams in prefix and in suffix order.

Phrases are counted order by order: a run of words is counted only where both shorter runs inside it occur often
enough, told by a bit map of fixed size. What the bit map lets through by chance is dropped by its own count, so all
counts are exact. The counts of all orders form one table, an ordered trie with the number of all words at its root.

That table is kept sorted by its words (prefix order) and by its words from the last to the first (suffix order). One
pass over either stream has the counts of all beginnings (or all endings) of a phrase on a stack. A stream's parts are
cut anywhere; what a part must know of the earlier ones is the path to its first row, a few counts. The two
streams are then merged. A longer phrase knows by its own row the counts of the phrases one word shorter inside
it, and so which of them it covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import drop, slices, written
from apidrift.llm.words import Checksums, byte_table, cut, longer

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
COVERED_PERCENT = 100
NO_LANG = "und"
#: Words are parted by space and tab; pieces by closing punctuation and line ends.
TABLE = byte_table(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Bits of the map over frequent phrases of one order, 8 MB at every size of the corpus.
MAP_BITS = 26
SLICE_BYTES = 8 << 20
#: Groups that the best phrases of a language are chosen in before they meet.
SALTS = 64


def _runs(texts: pa.Array, langs: pa.Array, order: int, bits: np.ndarray | None):
    """Distinct runs of ``order`` words: (language, phrase, occurrences)."""
    found = cut(texts, TABLE)
    coded = found.words.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    coded_langs = pc.fill_null(langs.cast(pa.large_string()), NO_LANG).dictionary_encode()
    lang = coded_langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.text]
    at = np.arange(len(word))
    if order > 1:
        # The checksum of language and words tells the place in the bit map, as it does for the stored phrases.
        sums = Checksums(coded.dictionary, word)
        of_lang = Checksums(coded_langs.dictionary, lang).first
        value, often = sums.extended(of_lang, at), None
        for size in range(1, order):
            if size > 1:
                at, value = longer(found.linked, at, value)
                value = sums.extended(value, at)
            if size == order - 1:
                place = value & np.uint32(8 * len(bits) - 1)
                often = np.zeros(len(word), bool)
                often[at[bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]] = True
        at = np.flatnonzero(often[1:] & often[:-1] & found.linked[1:]) + 1
    group = lang[at]
    for back in range(order - 1, -1, -1):
        _, first, group = np.unique(group * len(coded.dictionary) + word[at - back], return_index=True, return_inverse=True)
    if not len(at):
        return None
    parts = [coded.dictionary.take(pa.array(word[at[first] - back])) for back in range(order - 1, -1, -1)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if order > 1 else parts[0]
    return coded_langs.dictionary.take(pa.array(lang[at[first]])), phrase, np.bincount(group, minlength=len(first))


def _counted(docs: DataFrame, order: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f) of all runs of ``order`` words that the bit map of the order below lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            runs = _runs(batch["text"], batch["lang"], order, shared.value)
            if runs:
                lang, phrase, f = runs
                for start in range(0, len(f), 1 << 16):
                    part = [lang.slice(start, 1 << 16).cast(pa.string()), phrase.slice(start, 1 << 16).cast(pa.string()), pa.array(f[start : start + (1 << 16)])]
                    yield pa.RecordBatch.from_arrays(part, names=["lang", "phrase", "f"])

    return docs.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bit_map(frequent: DataFrame) -> np.ndarray:
    """The bit map of these phrases. At most 2^(MAP_BITS - 6) words of 64 bits reach the driver, whatever their number."""
    place = F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = (
        frequent.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()
    )
    result = np.zeros(1 << (MAP_BITS - 6), np.int64)
    result[words["word"].to_numpy()] = words["bits"].to_numpy()
    return result.view(np.uint8)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[str]]:
    """(key, f): language and words of every run of one to ``longest`` words that occurs ``min_count`` times or more.

    The language alone has the number of all its words. Returns the table and the folders that it reads.
    """
    spark = docs.sparkSession
    every, every_path = written(_counted(docs, 1, None), "word-counts")
    often = every.filter(F.col("f") >= min_count)
    tables = [every.groupBy("lang").agg(F.sum("f").alias("f")).select(F.array("lang").alias("key"), "f")]
    paths, stays = [every_path], every_path
    for order in range(1, longest + 1):
        tables.append(often.select(F.concat(F.array("lang"), F.split("phrase", " ")).alias("key"), "f"))
        if order < longest:
            often, path = written(_counted(docs, order + 1, _bit_map(often)).filter(F.col("f") >= min_count), "phrase-counts")
            paths.append(path)
    counts = tables[0]
    for table in tables[1:]:
        counts = counts.unionByName(table)
    stored, path = written(counts, "counts")
    drop(spark, *paths)
    return stored, [path]


def with_path_counts(counts: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``counts`` with the array ``name``: the counts of all shorter keys that a key begins with, shortest first.

    ``counts`` must hold every beginning of a key. It is range-partitioned and sorted by its unique keys.
    """

    def run(batches):
        part, path, known = TaskContext.get().partitionId(), [], []
        for batch in batches:
            found = []
            for key, f in zip(batch["key"].to_pylist(), batch["f"].to_pylist()):
                same = 0
                while same < len(path) and same < len(key) and path[same] == key[same]:
                    same += 1
                # What the stack lacks stands in an earlier part and is filled in from the path to this part.
                known = known[:same] + [None] * (len(key) - 1 - same)
                found.append(list(known))
                path, known = key, [*known, f]
            new = [pa.array(found, pa.list_(pa.int64())), pa.array(np.full(len(found), part, np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, name, "part"])

    schema = T.StructType([*counts.schema.fields, T.StructField(name, T.ArrayType(T.LongType())), T.StructField("part", T.LongType())])
    stream, path = written(counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, schema), "stream")
    heads = stream.groupBy("part").agg(F.min("key").alias("head")).filter(F.size("head") > 1)
    wanted = heads.select("part", F.explode(F.sequence(F.lit(1), F.size("head") - 1)).alias("size"), "head").select(
        "part", "size", F.slice("head", F.lit(1), F.col("size")).alias("key")
    )
    # A few rows per part of the stream, whatever the data.
    handed = (
        counts.join(F.broadcast(wanted), "key")
        .groupBy("part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("size", "f"))), lambda x: x["f"]).alias("before"))
    )
    joined = stream.join(F.broadcast(handed), "part", "left")
    filled = F.transform(F.col(name), lambda x, i: F.coalesce(x, F.get(F.col("before"), i)))
    return joined.select(*counts.columns, filled.alias(name)), [path]


def scored_phrases(counts: DataFrame, covered_percent: int = COVERED_PERCENT) -> tuple[DataFrame, list[str]]:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words or more that no longer one covers."""
    prefix, prefix_paths = with_path_counts(counts, "firsts")
    backwards = F.concat(F.slice("key", 1, 1), F.reverse(F.slice("key", F.lit(2), F.size("key"))))
    suffix, suffix_paths = with_path_counts(counts.select(backwards.alias("key"), "f"), "lasts")
    merged, path = written(
        prefix.filter(F.size("key") > 2).join(suffix.select(backwards.alias("key"), "lasts").hint("merge"), "key"), "phrases"
    )
    drop(counts.sparkSession, *prefix_paths, *suffix_paths)
    whole = F.col("f") * 100
    longer = merged.filter(F.size("key") > 3)
    shorter = [(F.col("firsts"), F.slice("key", F.lit(2), F.size("key") - 2)), (F.col("lasts"), F.slice("key", F.lit(3), F.size("key") - 2))]
    covered = [
        longer.filter(whole >= covered_percent * F.element_at(known, -1)).select(F.concat(F.slice("key", 1, 1), words).alias("key"))
        for known, words in shorter
    ]
    kept = merged.join(covered[0].unionByName(covered[1]).distinct().hint("merge"), "key", "left_anti")
    # firsts and lasts begin with n; decimals of 38 digits hold 1000 a n for up to 10^17 words.
    cuts = F.expr(
        """transform(sequence(1, size(key) - 2), k -> struct(
             (cast(1000 as decimal(38, 0)) * f * firsts[0]) div (cast(firsts[k] as decimal(38, 0)) * lasts[size(key) - 1 - k]) as score,
             k as k, firsts[k] as l, lasts[size(key) - 1 - k] as r))"""
    )
    lowest = kept.withColumn("n", F.col("firsts")[0]).withColumn("cut", F.array_min(cuts))
    phrase = F.array_join(F.slice("key", F.lit(2), F.size("key") - 1), " ")
    return lowest.select(F.col("key")[0].alias("lang"), phrase.alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"), [path]


def collocations(
    docs: DataFrame, *, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST, covered_percent: int = COVERED_PERCENT,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The ``top`` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase is a run of two to ``longest`` words inside a piece of text that occurs ``a >= min_count`` times. Its
    score is the lowest over all cuts in two of floor(1000 a n / (l r)), with l and r the counts of both parts and n
    that of all words of the language; equal cuts go to the shorter first part. A phrase is left out if a longer one
    that holds it has ``covered_percent`` of its count. Equal scores go to the greater count, then to the
    phrase first in byte order.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur. An
    empty table, or one without frequent phrases, gives no rows. Other columns are ignored, whatever their names.
    """
    narrow = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts, paths = phrase_counts(narrow, longest, min_count)
    scored, _ = scored_phrases(counts, covered_percent)
    drop(docs.sparkSession, *paths)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    some = Window.partitionBy("lang", salt).orderBy(*best)
    ahead = scored.withColumn("place", F.row_number().over(some)).filter(F.col("place") <= top).drop("place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    return ahead.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same as SQL, for the standard parameters.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces
), runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS p
  FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m
), counts AS (
  SELECT lang, m, p, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
), often AS (
  SELECT * FROM counts WHERE f >= 100
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, l.f AS l, r.f AS r, n, l.m AS k,
    (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM often c JOIN totals USING (lang)
  JOIN often l ON l.lang = c.lang AND l.m < c.m AND l.p = list_slice(c.p, 1, l.m)
  JOIN often r ON r.lang = c.lang AND r.m = c.m - l.m AND r.p = list_slice(c.p, l.m + 1, c.m)
  WHERE c.m > 1
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), covered AS (
  SELECT o.lang, list_slice(o.p, i, i + m.k - 1) AS p, m.k AS m, max(o.f) AS f
  FROM often o, (SELECT unnest(range(2, 5)) AS k) m, (SELECT unnest(range(1, 5)) AS i) s
  WHERE m.k < o.m AND i + m.k - 1 <= o.m GROUP BY ALL
), kept AS (
  SELECT x.lang, array_to_string(x.p, ' ') AS phrase, x.a, x.l, x.r, x.n, x.score
  FROM lowest x LEFT JOIN covered c ON c.lang = x.lang AND c.p = x.p WHERE c.f IS NULL OR 100 * c.f < 100 * x.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000"""
