"""Toxicity categories by a classifier chain.

The categories are predicted one after the other by linear models over the words of a text; a later model also sees
the probabilities of the earlier ones. In training these are out-of-fold predictions, so that a later model learns
how far it can rely on them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import slices, split_words
from apidrift.llm.labelled import labelled_sample
from apidrift.llm.linear import Sparse, fit_linear, sigmoid

#: The label table has one column of toxicity. The finer categories are two kinds of toxic texts, told apart in training
#: by which of their telling words go together.
CHAIN = ("first_kind", "second_kind", "toxic")
SAMPLE_ROWS = 2500
FOLDS = 5
THRESHOLD = 0.5
#: A word is a feature of a category where it stands in so many different labelled texts and in such a share of the
#: category's texts, and that share lies this many standard errors above its share among the other texts.
MIN_TEXTS, MIN_SHARE, MIN_ERRORS = 5, 0.02, 6.0


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Index and text number of every word, and the distinct words: lower case, without marks at both ends."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    return coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts), plain


#: Words are features as they are and by their first letters, so that forms of one stem count together.
PREFIXES = (3, 4, 5, 6, 7)


def hashed(words: pa.Array) -> np.ndarray:
    """Hashes of each word's features, one column per kind; -1 where a word is too short for a prefix."""
    rows = [
        [zlib.crc32(w.encode()), *[zlib.crc32(f"{w[:n]}*".encode()) if len(w) > n else -1 for n in PREFIXES]] for w in words.to_pylist()
    ]
    return np.array(rows, np.int64).reshape(-1, 1 + len(PREFIXES))


#: Texts that share so many of their 16 smallest hashes count as copies.
SHARED_HASHES, SIGNATURE_SEED = 12, 7


@dataclass
class Link:
    """One model of the chain: hashes of its words, their weights, weights of the earlier probabilities, intercept."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, owner: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``owner`` and ``word``: distinct pairs of a text and a word's hash."""
        if not len(self.words):
            return sigmoid(before @ self.earlier + self.bias)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        return sigmoid(np.bincount(owner[hit], self.weights[at[hit]], len(before)) + before @ self.earlier + self.bias)


def _telling(rows: Sparse, label: np.ndarray, width: int) -> np.ndarray:
    """Columns whose words stand clearly more often in the texts with the label."""
    ones, n = label.sum(), len(label)
    if not ones or ones == n:
        return np.zeros(0, np.int64)
    all_texts = np.bincount(rows.column, minlength=width)
    with_label = np.bincount(rows.column, label[rows.owner], width)
    share = all_texts / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / (n - ones)))
    lead = with_label / ones - (all_texts - with_label) / (n - ones)
    return np.flatnonzero((all_texts >= MIN_TEXTS) & (with_label >= MIN_SHARE * ones) & (lead > MIN_ERRORS * error))


def kinds_of(rows: Sparse, toxic: np.ndarray, width: int) -> np.ndarray:
    """Two columns: which toxic texts hold a telling word of the first and of the second kind; a text may be of both.

    Telling words are split by the sign of the second eigenvector of their cosines over the toxic texts (the first one
    only tells how frequent they are), so words that stand in the same texts are of one kind. The word with the largest
    part counts as of the first kind.
    """
    chosen = _telling(rows, toxic, width)
    if len(chosen) < 2:
        return np.zeros((rows.n_rows, 2), bool)
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    hit = (place[rows.column] >= 0) & toxic[rows.owner]
    holds = np.zeros((rows.n_rows, len(chosen)))
    holds[rows.owner[hit], place[rows.column[hit]]] = 1
    unit = holds / np.sqrt(holds.sum(axis=0))
    part = np.linalg.eigh(unit.T @ unit)[1][:, -2]
    first = part * np.sign(part[np.argmax(np.abs(part))]) > 0
    return np.column_stack([holds[:, first].any(axis=1), holds[:, ~first].any(axis=1)])


def _fit_link(rows: Sparse, names: np.ndarray, label: np.ndarray, before: np.ndarray) -> Link:
    chosen = _telling(rows, label, len(names))
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[rows.column] >= 0
    width, k = len(chosen) + before.shape[1], before.shape[1]
    features = Sparse(
        np.concatenate([rows.owner[kept], np.repeat(np.arange(rows.n_rows), k)]),
        np.concatenate([place[rows.column[kept]], np.tile(np.arange(len(chosen), width), rows.n_rows)]),
        np.concatenate([np.ones(kept.sum()), before.ravel()]),
        rows.n_rows,
    )
    weights, bias = fit_linear(features, label[:, None].astype(float), width, sigmoid, l2=1e-4, rounds=300)
    return Link(names[chosen], weights[: len(chosen), 0], weights[len(chosen) :, 0], float(bias[0]))


def fit_chain(rows: Sparse, names: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """Models of the chain; ``labels`` has a column per category, ``names`` are the hashes of the columns of ``rows``.

    For every category the models of the folds give out-of-fold probabilities, which the later categories are
    trained on; the model that is kept is fitted on all rows. Rows are dealt to folds by their number.
    """
    fold = np.arange(rows.n_rows) % folds
    before, links = np.zeros((rows.n_rows, 0)), []
    for category in range(labels.shape[1]):
        label = labels[:, category]
        links.append(_fit_link(rows, names, label, before))
        unseen = np.zeros(rows.n_rows)
        for f in range(folds):
            inside, outside = fold != f, fold == f
            if outside.any():
                part = rows.rows(outside)
                link = _fit_link(rows.rows(inside), names, label[inside], before[inside])
                unseen[outside] = link.probability(part.owner, names[part.column], before[outside])
        before = np.column_stack([before, unseen])
    return links


def chain_probabilities(links: list[Link], owner: np.ndarray, word: np.ndarray, n_rows: int) -> np.ndarray:
    """One column per category."""
    before = np.zeros((n_rows, 0))
    for link in links:
        before = np.column_stack([before, link.probability(owner, word, before)])
    return before


def _pairs(owner: np.ndarray, code: np.ndarray, hashes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text and a used feature; a pair is one number while they are made distinct."""
    parts = [owner[hit].astype(np.int64) << 32 | column[code[hit]] for column, marks in zip(hashes.T, used.T) if len(hit := np.flatnonzero(marks[code]))]
    pairs = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _distinct_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    code, owner, plain = normal_words(texts)
    hashes = hashed(plain)
    return *_pairs(owner, code, hashes, hashes >= 0), plain, hashes


def _unlike_earlier(texts) -> np.ndarray:
    """Which texts share few words with all earlier ones. Copies and near copies of a text count once in training, or
    the words of a much copied text would seem to tell something.

    Of 16 smallest hashes under different multipliers, texts of a Jaccard similarity of three quarters share twelve on
    average, texts that only have the language in common a few.
    """
    multipliers = np.random.default_rng(SIGNATURE_SEED).integers(1, 1 << 62, 16, dtype=np.uint64) | np.uint64(1)
    seen: dict[tuple[int, int], list[int]] = {}
    unlike = np.zeros(len(texts), bool)
    for number, words in enumerate(texts):
        if not len(words):
            continue
        signature = (np.asarray(words, np.uint64)[:, None] * multipliers[None, :] >> np.uint64(20)).min(axis=0).tolist()
        entries = list(enumerate(signature))
        shared = Counter(n for entry in entries for n in seen.get(entry, ()))
        if max(shared.values(), default=0) < SHARED_HASHES:
            unlike[number] = True
            for entry in entries:
                seen.setdefault(entry, []).append(number)
    return unlike


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Link]:
    """The chain from at most ``rows`` labelled documents; without any, models of no words."""

    def run(batches):
        for batch in slices(batches, "text"):
            owner, word, _, _ = _distinct_pairs(batch["text"])
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(word, pa.int64()))],
                names=["doc_id", "toxic", "words"],
            )

    sample = labelled_sample(docs, labels, ["toxic"], rows).select("doc_id", "toxic", "text")
    schema = T.StructType([sample.schema["doc_id"], *T.DataType.fromDDL("toxic bigint, words array<bigint>").fields])
    found = sample.mapInArrow(run, schema).toPandas().sort_values("doc_id", kind="stable")
    found = found[_unlike_earlier(found["words"])] if len(found) else found
    lengths = found["words"].map(len).to_numpy(np.int64) if len(found) else np.zeros(0, np.int64)
    columns, column = np.unique(np.concatenate([np.zeros(0, np.int64), *found["words"]]).astype(np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), lengths)
    toxic = found["toxic"].to_numpy(np.int64) == 1
    features = Sparse(owner, column, np.ones(len(column)), len(found))
    return fit_chain(features, columns, np.column_stack([kinds_of(features, toxic, len(columns)), toxic]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category>..., toxic): probabilities of every category of the chain, and whether one reaches ``threshold``.

    Whole texts count, each word once. Null and empty texts get the probabilities of a text without words. Repeated
    rows give repeated rows, null ids stay null, an empty table gives no rows. Other columns are ignored.
    """
    links = fit(docs, labels, rows)

    def run(batches):
        for batch in slices(batches, "text"):
            code, owner, plain = normal_words(batch["text"])
            hashes = hashed(plain)
            # Only the few features of the models matter; the others are dropped before texts are made of them.
            used = np.isin(hashes, np.concatenate([link.words for link in links]))
            p = chain_probabilities(links, *_pairs(owner, code, hashes, used), batch.num_rows)
            columns = [pa.array(p[:, i]) for i in range(len(CHAIN))]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *columns, pa.array((p >= threshold).any(axis=1))], names=["id", *[f"p_{c}" for c in CHAIN], "toxic"]
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    added = ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean"
    schema = T.StructType([narrow.schema["id"], *T.DataType.fromDDL(added).fields])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
