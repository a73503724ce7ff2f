"""Mixing to target weights under soft domain membership.

A classifier fitted on labelled rows gives every document a posterior over domains. Document rates, zero or more,
are fitted so that the expected token totals of the domains match their targets: least squares on the relative
misses, by projected gradient steps from one copy of everything. A step moves each document by its posterior times
the misses of the domains, so the misses of all steps so far (a few numbers each) are all that a task needs to
know a document's rate; every step is one aggregation over the posteriors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import drop, slices, sums, written
from apidrift.llm.labelled import labelled_sample
from apidrift.llm.linear import Sparse, fit_linear, softmax
from apidrift.llm.tokens import WordEncoder, default_tokenizer, encoder

#: Target share of the tokens by domain.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
SAMPLE_ROWS = 2000
BUCKETS = 1 << 14
STEPS, TOLERANCE = 60, 1e-4


def _hashed(kind: str, parts: pa.Array) -> np.ndarray:
    """Bucket of every part; equal parts are hashed once."""
    coded = parts.dictionary_encode()
    spelled = coded.dictionary.cast(pa.binary()).to_pylist()
    start = zlib.crc32(kind.encode())
    return (np.fromiter((zlib.crc32(x, start) for x in spelled), np.int64, len(spelled)) % BUCKETS)[coded.indices.to_numpy(zero_copy_only=False)]


def buckets(words: pa.Array) -> np.ndarray:
    """Hashed features of each word: itself, its first and its last three letters."""
    words = words.cast(pa.large_string())
    return np.column_stack(
        [_hashed("w", words), _hashed("a", pc.utf8_slice_codeunits(words, 0, 3)), _hashed("z", pc.utf8_slice_codeunits(words, -3))]
    )


@dataclass
class DomainModel:
    """Weights per bucket and domain; a document's features are the shares of its words."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    tokenizer: str
    _words: pa.Array | None = field(default=None, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_words": None, "_scores": None}

    def word_scores(self, known: WordEncoder) -> np.ndarray:
        """Scores of all words that the encoder knows; only new ones are hashed."""
        done = 0
        if self._words is not None and len(self._words) <= len(known.known) and self._words.equals(known.known.slice(0, len(self._words))):
            done = len(self._words)
        if done < len(known.known):
            first, *others = (self.weights[column] for column in buckets(known.known.slice(done)).T)
            new = sum(others, first)
            self._scores = np.concatenate([self._scores, new]) if done else new
            self._words = known.known
        return self._scores if self._scores is not None else np.zeros((0, len(self.domains)), np.float32)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior over the domains and number of tokens of each text; without words, the bias alone speaks."""
        words = encoder(self.tokenizer)
        at, counts = words.looked_up(texts)
        ends = np.concatenate([[0], np.cumsum(words.lengths[at], dtype=np.int64)])[np.cumsum(counts)]
        total = sums(self.word_scores(words)[at], counts)
        return softmax(total / np.maximum(counts, 1)[:, None] + self.bias), np.diff(ends, prepend=0)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS, tokenizer: str | None = None, domain_col: str = "lang") -> DomainModel:
    """A classifier from at most ``rows`` documents that have a row in ``labels`` and a known domain.

    Without such documents all domains are equally likely.
    """
    tokenizer = tokenizer or default_tokenizer()
    known = docs.select("doc_id", F.col(domain_col).alias("domain")).filter(F.col("domain").isin(domains))
    named = labels.select("doc_id").join(known, "doc_id")
    narrow = docs.select("doc_id", "text")

    def run(batches):
        for batch in slices(batches, "text"):
            words = encoder(tokenizer)
            at, counts = words.looked_up(batch["text"])
            places, used = np.unique(at, return_inverse=True)
            hashed = buckets(words.known.take(pa.array(places)))[used]
            ends = np.cumsum(counts)
            docs_buckets = [hashed[e - n : e].ravel() for e, n in zip(ends, counts)]
            found = [np.unique(b, return_counts=True) for b in docs_buckets]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["domain"], pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] / max(n, 1) for f, n in zip(found, counts)], pa.list_(pa.float64()))],
                names=["doc_id", "domain", "column", "value"],
            )

    sample = labelled_sample(narrow, named, ["domain"], rows).select("doc_id", "domain", "text")
    found = sample.mapInArrow(run, T.StructType([sample.schema["doc_id"], *T.DataType.fromDDL("domain string, column array<bigint>, value array<double>").fields])).toPandas()
    found = found.sort_values("doc_id", kind="stable")
    lengths = found["column"].map(len).to_numpy(np.int64) if len(found) else np.zeros(0, np.int64)
    joined = lambda name: np.concatenate([np.zeros(0), *found[name]])
    features = Sparse(np.repeat(np.arange(len(found)), lengths), joined("column").astype(np.int64), joined("value"), len(found))
    targets = (found["domain"].to_numpy()[:, None] == np.array(domains, object)[None, :]).astype(float).reshape(-1, len(domains))
    weights, bias = fit_linear(features, targets, BUCKETS, softmax, l2=1e-6) if len(found) else (np.zeros((BUCKETS, len(domains))), np.zeros(len(domains)))
    return DomainModel(domains, weights.astype(np.float32), bias, tokenizer)


def rates(posteriors: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """Rates after these projected steps, from one."""
    rate = np.ones(len(posteriors))
    for move in moves:
        rate = np.maximum(rate - posteriors @ move, 0.0)
    return rate


def _totals(table: DataFrame, k: int, moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the current rates, and the second moments of the posteriors by tokens."""

    def run(batches):
        for batch in batches:
            p = pc.list_flatten(batch["p"]).to_numpy(zero_copy_only=False).reshape(-1, k)
            n = batch["tokens"].to_numpy(zero_copy_only=False).astype(float)
            at_rates = (n * rates(p, moves)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([*at_rates, *((p * n[:, None]).T @ p).ravel()]), pa.array(range(k + k * k))], names=["x", "at"])

    found = dict(table.mapInArrow(run, "x double, at bigint").groupBy("at").agg(F.sum("x")).collect())
    values = np.array([found.get(i, 0.0) for i in range(k + k * k)])
    return values[:k], values[k:].reshape(k, k)


def fit_moves(table: DataFrame, shares: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The steps that bring the expected totals of (tokens, p) to ``shares`` of all tokens.

    Misses count relative to their domain's current total, which makes the steps about equally long in all domains.
    Stops when every domain is within ``tolerance`` of its target, or after ``steps``. A domain that no document can
    belong to stays missed.
    """
    moves: list[np.ndarray] = []
    k = len(shares)
    totals, moments = _totals(table, k, moves)
    wanted = shares * totals.sum()
    if not totals.sum():
        return moves
    weight = 1 / np.maximum(totals, 1e-9 * totals.sum())
    step = 1 / np.linalg.eigvalsh(np.sqrt(weight)[:, None] * moments * np.sqrt(weight)[None, :])[-1]
    while len(moves) < steps:
        miss = totals - wanted
        if (np.abs(miss) <= tolerance * np.maximum(wanted, 1.0)).all():
            break
        moves.append(step * weight * miss)
        totals, _ = _totals(table, k, moves)
    return moves


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p`` (posterior by domain) and ``tokens``; these names must be free."""

    def run(batches):
        for batch in slices(batches, text_col):
            p, tokens = model.posteriors(batch[text_col])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(tokens, pa.int64())], names=[*batch.schema.names, "p", "tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T.DataType.fromDDL("p array<double>, tokens bigint").fields]))


def with_rates(table: DataFrame, moves: list[np.ndarray]) -> DataFrame:
    """``table`` with ``rate``, from its posteriors ``p``."""
    k = len(moves[0]) if moves else 0

    def run(batches):
        for batch in batches:
            p = pc.list_flatten(batch["p"]).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p[:, :k], moves))], names=[*batch.schema.names, "rate"])

    return table.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())]))


def with_text_rates(docs: DataFrame, model: DomainModel, moves: list[np.ndarray], text_col: str) -> DataFrame:
    """``docs`` with ``rate``, from the posteriors of its texts in the same pass: one worker per task, not two."""

    def run(batches):
        for batch in slices(batches, text_col):
            rate = rates(model.posteriors(batch[text_col])[0], moves)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("rate", T.DoubleType())]))


def _draw(*identity: str):
    """A number per row from a hash of its id, its text and its place in the scan: rows without id and repeated rows are
    drawn one by one. Null columns leave the hash to the others."""
    return F.xxhash64(*identity, F.monotonically_increasing_id())


def _copies(draw: str):
    """Copies of a row: the whole part of its rate, and one more with the chance of the rest, by the row's ``draw``."""
    chance = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return (whole + (F.col("rate") - whole > chance).cast("bigint")).cast("bigint")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) of every row.

    ``tokens`` are those of the whole text; sum(rate * tokens * p) per domain meets its target share of all tokens.
    Null and empty texts have no tokens and move by the classifier's bias only. Equal texts have equal rates;
    copies are drawn for each row alone, repeated rows and rows with null ids as well, and so depend on the order of the
    files. Null ids stay null, an empty table gives no rows; other columns are ignored.
    """
    domains = list(targets)
    model = fit_domains(docs, labels, domains, rows)
    narrow = docs.select("doc_id", "text", _draw("doc_id", "text").alias("draw"))
    table, _ = written(with_posteriors(narrow, model).select("doc_id", "draw", "p", "tokens"), "posteriors")
    moves = fit_moves(table, np.array(list(targets.values())) / sum(targets.values()))
    columns = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    return with_rates(table, moves).select("doc_id", "tokens", *columns, "rate", _copies("draw").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` in as many copies as their rates say, with their own columns alone."""
    domains = list(targets)
    model = fit_domains(docs, labels, domains, rows)
    table, path = written(with_posteriors(docs.select("text"), model).select("p", "tokens"), "posteriors")
    moves = fit_moves(table, np.array(list(targets.values())) / sum(targets.values()))
    drop(docs.sparkSession, path)
    wide = docs.select(*[docs[c].alias(f"in_{c}") for c in docs.columns], _draw("doc_id", "text").alias("draw"))
    rated = with_text_rates(wide, model, moves, "in_text")
    repeated = rated.withColumn("copies", _copies("draw")).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return repeated.select(*[repeated[f"in_{c}"].alias(c) for c in docs.columns])
