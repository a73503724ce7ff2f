"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Matches of the fixed patterns (and long hexadecimal keys) are seeds. The one and two words before a seed are lexical
patterns. A pattern is judged by all of its occurrences in the corpus: the share that is followed by something
believed to be an identifier. Identifiers under trusted patterns are believed in turn, and the two scores are
repeated over the graph of patterns and instances. Patterns of high confidence then mark identifiers that no fixed
pattern knows. These count as known when candidates for patterns are looked for again, until no pattern is added.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import drop, slices, split_words, with_row_id, written

#: Fixed patterns, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){2}\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An identifier without fixed form that also serves as a seed.
HEX_KEY = re.compile(r"[0-9a-f]{32,}")
MARK = re.compile(r"[0-9@]")
CORE = re.compile(r"[A-Za-z0-9+](?:.*[A-Za-z0-9])?", re.DOTALL)
WORD_END = re.compile(r"[\x20\x09-\x0D]|\Z")
WHITE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})

MIN_LENGTH = 5
LONG_WORD = 200
MIN_SUPPORT = 3
TRUSTED, ACCEPTED, ROUNDS = 0.5, 0.8, 3
#: Size of the bit map that tells tasks which patterns may matter. What it lets through by chance is dropped by a join,
#: so the number of patterns has no bound; only the share let through by chance grows with it.
FILTER_BITS = 1 << 24


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run before each @ (not reaching into the match before), then a dotted domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", domain.end() if domain else at + 1)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns by kind, then start; code points, end exclusive."""
    spans = []
    if "@" in text:
        spans += [("email", *span) for span in _emails(text)]
    if re.search("[0-9]", text):
        for found in IP.finditer(text):
            if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) < 256 for part in found[0].split(".")):
                spans.append(("ip", *found.span()))
        for found in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", found[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *found.span()))
        for found in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in found[0]) <= 15:
                spans.append(("phone", *found.span()))
    return spans


def _named(word: str) -> str:
    """A word as patterns have it: in lower case, very long ones as a hash."""
    word = word.lower()
    return word if len(word) <= LONG_WORD else sha256(word.encode()).hexdigest()


def _context(plain: str, end: int) -> list[str]:
    """The last word before ``end`` and the last two, however far away they are."""
    words: list[str] = []
    while end > 0 and len(words) < 2:
        if plain[end - 1] == " ":
            end -= 1
            continue
        begin = plain.rfind(" ", 0, end) + 1
        words.insert(0, _named(plain[begin:end]))
        end = begin
    return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]


def mentions(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, bool, list[str]]]:
    """(start, end, seed, patterns) of words that look like identifiers: a digit or @ inside, five characters or more.

    A fixed match is one mention however many words it has. Patterns are the lower-cased word before, and the two
    words before.
    """
    plain = text.translate(WHITE)
    taken = sorted((start, end) for _, start, end in base)
    done, i, seen, patterns = 0, 0, 0, []
    found = MARK.search(plain)
    while found:
        at = found.start()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        if i < len(taken) and taken[i][0] <= at:
            start, end = taken[i]
            done, seed = max(end, at + 1), True
        else:
            word = max(plain.rfind(" ", done, at) + 1, done)
            done = WORD_END.search(plain, at).start()
            if i < len(taken):
                done = min(done, taken[i][0])
            core = CORE.search(plain, word, done)
            start, end = core.span() if core else (word, word)
            seed = bool(HEX_KEY.fullmatch(plain, start, end))
        if end - start >= MIN_LENGTH:
            # Characters stuck to the identifier, such as quotes, are no words of the context.
            space = plain.rfind(" ", seen, start)
            seen, patterns = start, _context(plain, space) if space >= 0 else patterns
            yield start, end, seed, patterns
        found = MARK.search(plain, done)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def _graph(texts: DataFrame) -> DataFrame:
    """(pattern, value, seed, n): how often an identifier (as a hash) stands under a pattern."""

    def run(batches):
        for batch in slices(batches, "text"):
            seen: Counter = Counter()
            for text in batch["text"].to_pylist():
                for start, end, seed, patterns in mentions(text or "", base_spans(text or "")):
                    seen.update((p, text[start:end], seed) for p in patterns)
            columns = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_()), pa.array(list(seen.values()), pa.int64())],
                names=["pattern", "value", "seed", "n"],
            )

    found = texts.mapInArrow(run, "pattern string, value string, seed boolean, n bigint")
    return found.groupBy("pattern", F.xxhash64("value").alias("value")).agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def _hash(pattern: str) -> int:
    """Hash of a pattern; its lowest bits are the place in the bit map."""
    first, _, last = pattern.rpartition(" ")
    return zlib.crc32(first.encode()) * 31 + zlib.crc32(last.encode())


def _filter(patterns: DataFrame) -> np.ndarray:
    """The bit map of a table of patterns, as 64-bit words; its size is the same for any number of them."""
    last = F.substring_index("pattern", " ", -1)
    first = F.when(F.col("pattern") == last, "").otherwise(F.substring_index("pattern", " ", 1))
    places = patterns.select((F.crc32(first.cast("binary")) * 31 + F.crc32(last.cast("binary"))).bitwiseAND(FILTER_BITS - 1).alias("bucket"))
    words = places.groupBy(F.expr("bucket div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket % 64 as int))")).alias("bits"))
    found, bits = words.toPandas(), np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    buckets = hashes & len(bits) * 64 - 1
    return (bits[buckets >> 6] >> (buckets & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _occurrences(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(pattern, total): how often a pattern is followed by any word, for all patterns that the bit map may hold."""

    def run(batches):
        for batch in slices(batches, "text"):
            words, counts = split_words(batch["text"])
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = [_named(w) for w in coded.dictionary.to_pylist()]
            crc = np.array([zlib.crc32(w.encode()) for w in names], np.int64)
            followed = np.ones(len(codes), bool)
            followed[(np.cumsum(counts) - 1)[counts > 0]] = False
            first = np.zeros(len(codes), bool)
            first[(np.cumsum(counts) - counts)[counts > 0]] = True
            single = np.bincount(codes[followed], minlength=len(names))
            ones = np.flatnonzero((single > 0) & _may_hold(bits, crc))
            second = np.flatnonzero(followed & ~first)
            left, right = codes[second - 1], codes[second]
            hit = _may_hold(bits, crc[left] * 31 + crc[right])
            pairs, times = np.unique(left[hit] * len(names) + right[hit], return_counts=True)
            found = [names[i] for i in ones.tolist()] + [f"{names[i]} {names[j]}" for i, j in zip(*np.divmod(pairs, max(len(names), 1)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate([single[ones], times]), pa.int64())], names=["pattern", "n"])

    return texts.mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("total"))


def _believed(edges: DataFrame, confidence: DataFrame, least: float) -> DataFrame:
    """(value, found): how far identifiers under patterns of at least that confidence are believed."""
    sure = confidence.filter(F.col("confidence") >= least).select("pattern", F.least("confidence", F.lit(0.999)).alias("confidence"))
    together = (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("found")
    return edges.join(sure.hint("merge"), "pattern").groupBy("value").agg(together)


def _confidence(edges: DataFrame) -> tuple[DataFrame, str]:
    """(pattern, confidence) after ``ROUNDS`` over the graph, and the folder of this intermediate.

    ``known`` is how far an identifier was believed before: 1 for seeds.
    """
    belief, path = F.col("known"), None
    scored = edges.withColumn("belief", belief)
    for _ in range(ROUNDS):
        before = path
        shares = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("confidence"))
        confidence, path = written(shares, "pattern-confidence")
        if before:
            drop(edges.sparkSession, before)
        scored = edges.join(_believed(edges, confidence, TRUSTED).hint("merge"), "value", "left").withColumn("belief", F.greatest(belief, F.coalesce("found", F.lit(0.0))))
    return confidence, path


def trusted_contexts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """(pattern): the patterns of high confidence in this corpus, with the folder of this intermediate.

    A pattern becomes a candidate with ``MIN_SUPPORT`` different known identifiers, at every size: seeds at first, then
    what accepted patterns mark as well, believed as far as these are. Generations of candidates follow until one adds none; only the new ones are
    counted in the texts. Candidates, totals and confidences are tables and meet by merge joins on the pattern or the
    identifier. Patterns are unique on one side of each, so adaptive execution can split the other side of a hot one.
    """
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).alias("text"))
    graph, graph_path = written(_graph(texts), "patterns")
    seeds = F.col("seed").cast("double")
    nodes, totals, paths, accepted, accepted_path = graph.withColumn("known", seeds), None, [graph_path], None, None
    while True:
        support = nodes.filter("known > 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("support"))
        fresh = support.filter(F.col("support") >= MIN_SUPPORT).select("pattern")
        if totals is not None:
            fresh = fresh.join(totals.hint("merge"), "pattern", "left_anti")
        fresh, fresh_path = written(fresh, "pattern-candidates")
        if totals is not None and fresh.isEmpty():
            drop(spark, fresh_path, *paths)
            return accepted, accepted_path
        total, total_path = written(_occurrences(texts, _filter(fresh)).join(fresh.hint("merge"), "pattern"), "pattern-totals")
        totals = total if totals is None else totals.unionByName(total)
        edges, edges_path = written(nodes.join(totals.hint("merge"), "pattern"), "pattern-edges")
        confidence, confidence_path = _confidence(edges)
        before = accepted_path
        accepted, accepted_path = written(confidence.filter(F.col("confidence") >= ACCEPTED).select("pattern"), "pattern-accepted")
        values, values_path = written(_believed(edges, confidence, ACCEPTED), "found-values")
        drop(spark, fresh_path, edges_path, confidence_path, *([before] if before else []))
        paths += [total_path, values_path]
        nodes = graph.join(values.hint("merge"), "value", "left").withColumn("known", F.greatest(seeds, F.coalesce("found", F.lit(0.0)))).drop("found")


def accepted_patterns(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """``trusted_contexts`` collected, for a look at small tables; the operators leave it a table."""
    accepted, path = trusted_contexts(docs, text_col)
    patterns = frozenset(r[0] for r in accepted.collect())
    drop(docs.sparkSession, path)
    return patterns


def _with_spans(wide: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``wide`` with the fixed counts, ``base_sha256``, and ``spans``: the fixed spans and those that
    trusted contexts add where no fixed span lies.

    Columns of ``wide`` start with ``in_``. Tasks list the mentions that the bit map lets through; their patterns meet
    the accepted ones in a join, and only rows with such mentions meet their added spans in another.
    """
    accepted, accepted_path = trusted_contexts(wide, text)
    bits = _filter(accepted)
    added_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string())]))

    def run(batches):
        wanted = bits.any()
        for batch in slices(batches, text):
            rows = []
            for value in batch[text].to_pylist():
                base = base_spans(value or "")
                kinds = Counter(kind for kind, _, _ in base)
                found = [
                    (start, end, p)
                    for start, end, _, patterns in (mentions(value or "", base) if wanted else ())
                    if not any(s < end and start < e for _, s, e in base)
                    for p in patterns
                ]
                if found:
                    maybe = _may_hold(bits, np.array([_hash(p) for _, _, p in found], np.int64))
                    found = [dict(zip(("start", "end", "pattern"), f)) for f, keep in zip(found, maybe.tolist()) if keep]
                listed = digest(base)
                rows.append((*[kinds[k] for k in KINDS], sha256(listed.encode()).hexdigest(), listed, found, bool(found)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [added_type, pa.bool_()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    new = T.DataType.fromDDL(f"{SPANS}, added array<struct<start: bigint, end: bigint, pattern: string>>, listed boolean").fields
    names = [*kept, *[f.name for f in new]]
    marked = wide.mapInArrow(run, T.StructType([*[wide.schema[c] for c in kept], *new]))
    rows, _ = written(with_row_id(marked, "row"), "personal-data")
    pairs = rows.filter("listed").select("row", F.inline("added")).join(accepted.hint("merge"), "pattern", "left_semi")
    added = pairs.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))
    listed = F.array_join(F.transform("found", lambda x: F.concat(F.lit(f"{CONTEXT}:"), x["start"], F.lit(":"), x["end"])), ",")
    joined = rows.filter("listed").join(added.hint("merge"), "row", "left")
    both = joined.withColumn("spans", F.concat_ws(",", F.when(F.col("spans") != "", F.col("spans")), listed))
    columns = [*kept, *[c.split()[0] for c in SPANS.split(", ")]]
    return rows.filter("not listed").select(*columns).unionByName(both.select(*columns))


SPANS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, numbers of fixed matches by kind, the digest of their spans, and all spans.

    Null and empty texts have no spans. Repeated rows give repeated rows, null ids stay null, an empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    narrow = docs.select(F.col(id_col).alias("in_id"), F.col(text_col).alias("in_text"))
    return _with_spans(narrow, "in_text", ["in_id"]).withColumnRenamed("in_id", id_col)


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; null texts stay null, other columns as they are."""
    wide = docs.select(*[docs[c].alias(f"in_{c}") for c in docs.columns])
    found = _with_spans(wide, f"in_{text_col}", wide.columns)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, f"in_{text_col}"):
            spans = [[(k, int(s), int(e)) for k, s, e in (x.split(":") for x in listed.split(",") if x)] for listed in batch["spans"].to_pylist()]
            texts = [t if t is None else masked(t, s) for t, s in zip(batch[at].to_pylist(), spans)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return found.select(*wide.columns, "spans").mapInArrow(run, docs.schema)
