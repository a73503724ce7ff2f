"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch, sorted, are a depth-first walk of their trie. The forward score of a node is
the best score of its prefix over all segmentations into vocabulary pieces; it is computed once, when the walk first
enters the node, and used by every pre-token below it. The count at a terminal node is the pre-token's.
"""

from __future__ import annotations

from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import slices, split_words, sums

#: Mark of a pre-token's start in the vocabulary (fixed value).
START = "▁"
#: How far below the worst piece an unknown character's bytes are.
UNKNOWN_PENALTY = 10.0
#: Distinct pre-tokens a worker remembers; beyond it the memory starts afresh.
CACHED_WORDS = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a model file and their scores, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return dict(zip(model.id_to_piece(ids), model.get_score(ids)))


class UnigramCounter:
    """Numbers of pieces in the best segmentation: highest sum of scores, then fewest pieces.

    A character that is no piece stands for as many tokens as it has UTF-8 bytes.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.known = pa.array([], pa.large_string())
        self.counts = np.zeros(0, np.int64)
        self.nodes = 0

    def walk(self, words: list[str]) -> list[int]:
        """Counts of sorted distinct words."""
        scores, numbers, before, counts = [0.0], [0], "", []
        pieces, longest = self.pieces, self.longest
        for word in words:
            word = START + word
            shared = len(commonprefix((before, word)))
            del scores[shared + 1 :], numbers[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, number = -np.inf, 0
                for start in range(max(0, end - longest), end):
                    score = pieces.get(word[start:end])
                    if score is not None:
                        score += scores[start]
                        if score > best or score == best and numbers[start] + 1 < number:
                            best, number = score, numbers[start] + 1
                if word[end - 1] not in pieces:
                    score = scores[end - 1] + self.unknown
                    if score > best:
                        best, number = score, numbers[end - 1] + len(word[end - 1].encode())
                scores.append(best)
                numbers.append(number)
            self.nodes += len(word) - shared
            counts.append(numbers[-1])
            before = word
        return counts

    def count(self, distinct: pa.Array) -> np.ndarray:
        """Counts of distinct words; only those not yet known are walked."""
        new = distinct.filter(pc.index_in(distinct, value_set=self.known).is_null())
        if len(new):
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known, self.counts, new = self.known.slice(0, 0), self.counts[:0], distinct
            words = sorted(new.to_pylist())
            self.known = pa.concat_arrays([self.known, pa.array(words, pa.large_string())])
            self.counts = np.concatenate([self.counts, np.array(self.walk(words), np.int64)])
        return self.counts[pc.index_in(distinct, value_set=self.known).to_numpy(zero_copy_only=False)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and of tokens of each text (null: none)."""
        words, n_words = split_words(texts)
        coded = words.dictionary_encode()
        return n_words, sums(self.count(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)], n_words)


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """One counter per worker process and file."""
    return UnigramCounter(load_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) of every row, over whole texts.

    Pre-tokens are runs of characters other than space and \\x09-\\x0D, marked at their start; no other normalisation.
    Null and empty texts, and texts of white space: zero. Repeated rows give repeated rows, null ids stay null, an
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        for batch in slices(batches, "text"):
            n_words, n_tokens = counter(path).texts(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n_words), pa.array(n_tokens)], names=["id", "n_words", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
