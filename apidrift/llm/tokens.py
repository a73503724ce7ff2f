"""Token ids of whole texts by the ``tokenizers`` library, one library call per distinct word."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from apidrift.llm.common import split_words

#: Distinct words whose ids a worker remembers (some 30 bytes each); beyond it the memory starts afresh.
CACHED_WORDS = 400_000
#: Closing punctuation after a letter is a token run of its own, so it may stand apart; "the," and "the" then share an entry.
CLOSING = r'(\pL)([.,;:!?*#$%&)"]+)(\s)'
#: What a special token starts with; its letters keep their case.
SPECIAL = "<|"
#: Words that are one run of letters or of ASCII punctuation, hence end in exactly one end-of-word token.
ONE_RUN = r'^(\pL+|[.,;:!?*#$%&)"]+)$'
#: Such words go to the library as one text of this many words.
JOINED_WORDS = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts word by word.

    Right only for tokenizers that lower case, drop white space and split at it and between letters and
    punctuation before anything else, as ``word_bpe_49k.json`` does: there the ids of a text are the ids of
    its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        #: Place of each known word; kept from slice to slice, as hashing all known words anew costs more than a slice.
        self.place: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Place of each of these distinct words among the known ones, which grow by the new ones."""
        spelled = words.to_pylist()
        found = np.fromiter((self.place.get(w, -1) for w in spelled), np.int64, len(spelled))
        if not (found < 0).any():
            return found
        lacking = np.flatnonzero(found < 0)
        if len(self.known) + len(lacking) > CACHED_WORDS:
            self.forget()
            lacking = np.arange(len(spelled))
        new = words.take(pa.array(lacking))
        one_run = pc.match_substring_regex(new, ONE_RUN)
        new = pa.concat_arrays([new.filter(one_run), rest := new.filter(pc.invert(one_run))])
        ids, lengths = self.encoded(new.slice(0, len(new) - len(rest)), rest)
        self.place.update(zip(new.to_pylist(), range(len(self.known), len(self.known) + len(new))))
        self.known = pa.concat_arrays([self.known, new])
        self.pool = np.concatenate([self.pool, *ids])
        self.lengths = np.concatenate([self.lengths, *lengths]).astype(np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        found[lacking] = [self.place[spelled[i]] for i in lacking.tolist()]
        return found

    def encoded(self, one_run: pa.Array, rest: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of these words in a row and the number of each, in parts."""
        ids, lengths = [], []
        for start in range(0, len(one_run), JOINED_WORDS):
            words = one_run.slice(start, JOINED_WORDS).to_pylist()
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[got])
            if len(ends) == len(words):
                ids.append(got)
                lengths.append(np.diff(ends, prepend=-1))
            else:  # a letter whose lower case is more than letters
                self.encode_each(words, ids, lengths)
        for start in range(0, len(rest), JOINED_WORDS):
            self.encode_each(rest.slice(start, JOINED_WORDS).to_pylist(), ids, lengths)
        return ids, lengths

    def encode_each(self, words: list[str], ids: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids += [np.array(x, np.uint32) for x in each]
        lengths.append(np.fromiter(map(len, each), np.int64, len(each)))

    def looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of every word of the texts, and the number of words of each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        low = pc.ascii_lower(texts)
        special = pc.match_substring(texts, SPECIAL)
        if pc.any(special).as_py():
            low = pc.if_else(special, texts, low)
        flat, counts = split_words(pc.replace_substring_regex(low, CLOSING, r"\1 \2\3"))
        coded = flat.dictionary_encode()
        return self.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text (null: none)."""
        at, counts = self.looked_up(texts)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.starts[at] - (ends - lengths), lengths)
        places += np.arange(total)
        return self.pool[places], np.diff(np.concatenate([[0], ends])[np.cumsum(counts)], prepend=0)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        at, counts = self.looked_up(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[at], dtype=np.int64)])
        return np.diff(ends[np.cumsum(counts)], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
