"""Quality rules: fixed limits, then gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apidrift.llm.common import slices, split_words, sums
from apidrift.llm.labelled import SAMPLE_ROWS, labelled_sample
from apidrift.llm.trees import Trees, boosted_trees

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics for the trees, and how the verdict may move with each: -1 only down, 1 only up, 0 freely.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": -1, "shout_share": -1, "line_words": 0,
}


def _bytes_in(data: pa.Array, ends: np.ndarray, characters: str) -> np.ndarray:
    """Number of these ASCII characters in each text; ``ends`` are the byte ends of the texts."""
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    buffer = np.frombuffer(data.buffers()[2] or b"", np.uint8)[: ends[-1] if len(ends) else 0]
    total = np.concatenate([[0], np.cumsum(table[buffer])])
    return np.diff(total[ends], prepend=0)


def _repeats(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in the text."""
    result = np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    windows = np.maximum(counts - 2, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    if not len(owner):
        return result
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(ends - counts, windows)
    # Dense numbers of word pairs, then of triples within their text, keep the keys inside 64 bits.
    step = int(codes.max()) + 1
    pair = np.unique(codes[at] * step + codes[at + 1], return_inverse=True)[1]
    triple = np.unique(pair * step + codes[at + 2], return_inverse=True)[1]
    _, same, times = np.unique(owner * (int(triple.max()) + 1) + triple, return_inverse=True, return_counts=True)
    first = at[times[same] > 1]
    covered = np.zeros(len(codes), bool)
    for i in range(3):
        covered[first + i] = True
    return sums(covered, counts)


def _duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and lines with a word."""
    lists = pc.split_pattern(texts, "\n")
    lines, per_text = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    owner = owner[full.to_numpy(zero_copy_only=False)]
    codes = lines.filter(full).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(owner * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1) if len(codes) else owner
    n = np.bincount(owner, minlength=len(per_text))
    return n - np.bincount(distinct, minlength=len(per_text)), n


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of whole texts (null: empty), and the rows of ``FEATURES``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    words, n_words = split_words(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = sums(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), n_words)
    dup_lines, lines = _duplicate_lines(texts)
    counts = dict(zip(COUNTS, (n_words, word_chars, _bytes_in(texts, ends, SYMBOLS), dup_lines, _repeats(codes, n_words))))
    chars, total = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    shares = [
        np.log1p(n_words), word_chars / total, counts["n_symbols"] / chars, dup_lines / np.maximum(lines, 1), counts["n_repeat_words"] / total,
        _bytes_in(texts, ends, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, _bytes_in(texts, ends, "0123456789") / chars,
        _bytes_in(texts, ends, "!") / total, n_words / np.maximum(lines, 1),
    ]
    return counts, np.stack(shares, axis=1)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees for the probability of quality 1, from at most ``rows`` labelled documents. No labels: always one half."""

    def run(batches):
        for batch in slices(batches, "text"):
            _, features = statistics(batch["text"])
            columns = [pa.array(features[:, i]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch["quality"].cast(pa.float64()), *columns], names=["quality", *FEATURES])

    schema = ", ".join(f"{name} double" for name in ("quality", *FEATURES))
    sample = labelled_sample(docs, labels, ["quality"], rows).select("text", "quality").mapInArrow(run, schema).toPandas()
    # Collected rows come in no fixed order; sums of doubles should not depend on it.
    sample = sample.sort_values(list(sample.columns))
    return boosted_trees(sample[list(FEATURES)].to_numpy(), sample["quality"].to_numpy(), np.array(list(FEATURES.values())))


def judged(docs: DataFrame, model: Trees, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` and ``kept``; new columns replace any of these names.

    ``kept`` is false where the base limits fail, else whether the trees give ``keep_from`` or more. Null and empty
    texts have no words and fail. Repeated rows are judged alike. An empty table stays empty.
    """
    added = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()),
             T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    names = {f.name for f in added}
    if text_col in names:
        raise ValueError(f"the text column cannot be called {text_col}")
    rest = reduce(DataFrame.drop, [c for c in docs.columns if c in names], docs)

    def run(batches):
        for batch in slices(batches, text_col):
            counts, features = statistics(batch[text_col])
            failed, score = base_failed(counts), model.probability(features)
            new = [*[counts[c].astype(np.int64) for c in COUNTS], failed, score, ~failed & (score >= keep_from)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=[*batch.schema.names, *[f.name for f in added]])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *added]))


def quality_verdicts(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts and verdict of every document, by trees fitted on its labelled rows; see :func:`judged`."""
    return judged(docs, fit(docs, labels, rows))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    wide = docs.select(*[docs[c].alias(f"in_{c}") for c in docs.columns])
    good = judged(wide, fit(docs, labels, rows), "in_text").filter("kept")
    return good.select(*[good[f"in_{c}"].alias(c) for c in docs.columns])
