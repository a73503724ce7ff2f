"""Token files, packing and token counts against plain versions and round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from apidrift.llm import counts, frames, hilbert, packing, tokens
from apidrift.session import fresh_path

TOKENIZER = Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sS<|>.!é́İΣ\x0b\x1c\xa0")), max_size=60), max_size=4))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, n = tokens.encoder(tokens.default_tokenizer()).encode(pa.array(texts, pa.string()))
    assert [p.tolist() for p in np.split(ids, np.cumsum(n))[: len(texts)]] == [ids_of(t) for t in texts]
    assert tokens.encoder(tokens.default_tokenizer()).count(pa.array(texts, pa.string())).tolist() == n.tolist()


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 20)
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    for start in range(0, 60, 15):
        text = " ".join(f"word{i}, again" for i in range(start, start + 15))
        assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(text)


def test_token_files_round_trip(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    files = frames.write_token_files(docs.repartition(3), fresh_path(spark, "frames"))
    rows = frames.read_token_files(files).collect()
    assert sorted((r.doc_id or -99, bytes(r.ids)) for r in rows) == sorted((i or -99, np.array(ids_of(t) + [2], "<u4").tobytes()) for i, t in odd_rows)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, *sorted(x for x in order if x is not None)]
    wanted = frames.find_documents(spark, files, [6, 1, 1, 77]).collect()
    assert sorted(r.doc_id for r in wanted) == [1, 1, 6]
    assert {bytes(r.ids) for r in wanted if r.doc_id == 6} == {np.array(ids_of(dict(odd_rows)[6]) + [2], "<u4").tobytes()}
    # Any zstandard reader skips the two tables and sees the ids in a row.
    for path in [r.path for r in files.collect()]:
        with frames.opened(path) as file:
            index = frames.read_index(file)
            whole = b"".join(frames.read_frame(file, index, i, zstandard.ZstdDecompressor()) for i in range(len(index.sizes)))
            file.seek(0)
            assert zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read() == whole


def test_equal_rows_are_dealt_over_several_files(spark, docs_of):
    docs = docs_of([(1, "the same words")] * 4000 + [(2, "others")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = frames.write_token_files(docs.repartition(3), fresh_path(spark, "frames"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listed = files.collect()
    assert sum(f.documents for f in listed) == 4001 and max(f.documents for f in listed) < 3600
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in frames.read_token_files(files).collect())
    assert [r[0] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1]] and rows[-1][1] == 2


def test_damaged_frame_is_refused(tmp_path):
    path = tmp_path / "tokens"
    with path.open("wb") as out:
        assert frames.write_file(out, [(1, b"abcd" * 20), (None, b"efgh")]) == (2, 21)
    data = bytearray(path.read_bytes())
    with frames.opened(str(path)) as file:
        index = frames.read_index(file)
        assert index.named.tolist() == [True, False] and index.n_tokens.tolist() == [20, 1]
    data[int(index.offsets[1]) + 8] ^= 1
    path.write_bytes(data)
    with frames.opened(str(path)) as file:
        assert frames.read_frame(file, index, 0, zstandard.ZstdDecompressor()) == b"abcd" * 20
        with pytest.raises((ValueError, zstandard.ZstdError)):
            frames.read_frame(file, index, 1, zstandard.ZstdDecompressor())


def test_token_files_of_nothing(spark, docs_of):
    assert frames.token_frames(docs_of([])).collect() == []


def check_pieces(rows, odd_rows, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    expected = sorted((i or -99, t) for i, t in ((i, tuple(ids_of(t) + [1])) for i, t in odd_rows))
    found = []
    for doc, pieces in by_doc.items():
        # Repeated ids are documents of their own: split them where a document starts.
        for start in sorted(p.start for p in pieces if p.start == 0):
            assert start == 0
        found.append((doc, sum(p.length for p in pieces), sorted(p.start for p in pieces).count(0)))
    totals = defaultdict(int)
    number = defaultdict(int)
    for i, ids in expected:
        totals[i] += len(ids)
        number[i] += 1
    assert sorted((d or -99, n, k) for d, n, k in found) == sorted((i, totals[i], number[i]) for i in totals)
    sizes = []
    for sequence, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(n == length or n & (n - 1) == 0 for n in sizes) and sum(n != length for n in sizes) < 12


@pytest.mark.parametrize("length", [2048, 100])
def test_packing(spark, docs_of, odd_rows, length):
    rows = packing.pack(docs_of(odd_rows).repartition(3), length).collect()
    check_pieces(rows, odd_rows, length)
    unique = {i: ids_of(t) + [1] for i, t in odd_rows if i not in (1, None)}
    for doc, ids in unique.items():
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == ids
        assert all(p.doc_tokens == len(ids) for p in pieces)


def test_packing_of_nothing(spark, docs_of):
    assert packing.pack(docs_of([])).collect() == []


def test_curve_visits_every_cell_and_steps_to_a_neighbour(monkeypatch):
    monkeypatch.setattr(hilbert, "BITS", 3)
    axes = np.stack(np.meshgrid(*[np.arange(8)] * 4), axis=-1).reshape(-1, 4)
    keys = hilbert.curve_key(axes / 4 - 1)
    assert sorted(keys) == list(range(8**4))
    path = axes[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain_count(word, pieces, unknown):
    word, best = counts.START + word, [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        if word[end - 1] not in pieces:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] - len(word[end - 1].encode())))
        best.append(max(ways))
    return -best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=9), min_size=1, max_size=12, unique=True), st.dictionaries(st.text("▁abc", min_size=1, max_size=4), st.integers(-9, 0).map(float), min_size=1, max_size=15))
def test_trie_counts(words, pieces):
    counter = counts.UnigramCounter(pieces)
    assert counter.count(pa.array(words, pa.large_string())).tolist() == [plain_count(w, pieces, counter.unknown) for w in words]
    prefixes = {w[:n] for w in words for n in range(1, len(w) + 1)} | {""}
    assert counter.nodes == len(prefixes)


def test_token_counts(spark, docs_of, odd_rows):
    pieces = counts.load_pieces(counts.default_vocabulary())
    counter = counts.UnigramCounter(pieces)
    rows = counts.token_counts(docs_of(odd_rows)).collect()
    memo = {}
    expected = []
    for i, t in odd_rows:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
        n = sum(memo.setdefault(w, plain_count(w, pieces, counter.unknown)) for w in words)
        expected.append((i or -99, len(words), n))
    assert sorted((r.doc_id or -99, r.n_words, r.n_tokens) for r in rows) == sorted(expected)
    assert counts.token_counts(docs_of([])).collect() == []
