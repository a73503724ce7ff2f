"""Importance resampling, one-permutation fingerprints and collocations against plain versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from apidrift.llm import collocations, importance, oneperm, words
from apidrift.llm.labelled import labelled_sample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = st.text(st.sampled_from("aB1 é\n\t.,;-_\x00漢"), max_size=40)


# Words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6))
def test_words_are_cut_at_table_bytes(texts):
    found = words.cut(pa.array([None, *texts], pa.string()).slice(1), collocations.TABLE)
    plain = [[re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW))] for t in texts]
    assert found.words.to_pylist() == [w for pieces in plain for piece in pieces for w in piece]
    assert found.counts.tolist() == [sum(map(len, pieces)) for pieces in plain]
    assert found.linked.tolist() == [i > 0 for pieces in plain for piece in pieces for i, _ in enumerate(piece)]


def test_checksums_of_runs():
    spelled = ["a", "é漢", "x" * 700, ""]
    sums = words.Checksums(pa.array(spelled, pa.large_string()), np.arange(4))
    value = sums.extended(sums.extended(sums.first[:2], np.array([2, 3])), np.array([1, 2]))
    assert value.tolist() == [zlib.crc32(" ".join(x).encode()) for x in (("a", spelled[2], "é漢"), ("é漢", "", spelled[2]))]


# Importance resampling


def plain_features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(found), [zlib.crc32(" ".join(found[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def plain_resample(docs, target, percent=5):
    source = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in source for x in f), Counter(x for text in target for x in plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, n_words, features in source:
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (all_s + 10000) / ((s[x] + 1) * (all_t + 10000)))) for x in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    allowed = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(allowed[: len(allowed) * percent // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def many_docs(n=300):
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(["red", "Green", "blue-ish", "über", "7", "die", "the"]) for _ in range(rng.randrange(60)))) for i in range(1000, 1000 + n)]


def test_resampling(spark, docs_of, odd_rows):
    rows, target = odd_rows + many_docs(), ["the red Green 7", None, "", "the the the red"]
    aims = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id int, text string, planes string")
    got = sorted((tuple(r) for r in importance.resample(docs_of(rows), aims, percent=30).collect()), key=repr)
    assert got == plain_resample(rows, target, 30)
    assert sum(r[4] is not None for r in got) > 30


def test_resampling_of_little(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs_of([]), none).collect() == []
    rows = [(None, None), (1, ""), (1, "."), (2, "one two three")]
    assert sorted((tuple(r) for r in importance.resample(docs_of(rows), none).collect()), key=repr) == plain_resample(rows, [])


def test_bit_slices_are_exact():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (5, 130)) ** 9
    counts[2] = 0
    counts[4, 7] = 10**9
    for gains in (rng.integers(-9000, 9000, 130), np.zeros(130, np.int64), np.full(130, -1), np.full(130, 4096)):
        data, depth = importance.planes_of(counts)
        sliced, worth = importance.gain_planes(gains)
        power = np.concatenate([np.arange(d) for d in depth])
        value = sum(bit * np.bitwise_count(data.view(np.uint64) & plane).sum(axis=1, dtype=np.int64) for plane, bit in zip(sliced, worth))
        assert np.bincount(np.repeat(np.arange(5), depth), value << power, 5).astype(np.int64).tolist() == (counts @ gains).tolist()


# Fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_shingles(text, shingle=5):
    hashed = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {chained(hashed[i : i + shingle]) for i in range(max(len(hashed) - shingle + 1, 1))} if hashed else set()


def plain_fingerprint(text):
    heads = {}
    for x in plain_shingles(text):
        heads[(x >> 56) + 128] = min(x, heads.get((x >> 56) + 128, x))
    if not heads:
        return "0" * 256
    digits = ""
    for b in range(256):
        value = heads.get(b)
        for draw in range(1, 17):
            value = heads.get(chained([b, draw]) % 256) if value is None else value
        if value is None:
            value = min((chained([b, o, 0]), x) for o, x in heads.items())[1]
        digits += f"{chained([value, b]) & 15:x}"
    return digits


def plain_likeness(a, b):
    if a == b:
        return 1.0
    return 0.0 if "0" * 256 in (a, b) else max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


def plain_edited(rows):
    texts = {(i, t or "") for i, t in rows}
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1]}".encode()).digest()), reverse=True)
    found = {}
    for (i, t), (next_id, after) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        f, g, h = (plain_fingerprint(x) for x in (t, e, after))
        found[i, t] = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h), next_id)
    return sorted((found[i, t or ""] for i, t in rows), key=repr)


def test_fingerprints(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(oneperm, "COPY_BLOCK", 2)
    rows = odd_rows + many_docs(40) + [(70, "a b c d e f")] * 5
    got = sorted((tuple(r) for r in oneperm.edited_fingerprints(docs_of(rows)).collect()), key=repr)
    want = plain_edited(rows)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    assert [r[5:7] for r in got] == [pytest.approx(r[5:7]) for r in want]


def test_fingerprints_of_little(docs_of):
    assert oneperm.edited_fingerprints(docs_of([])).collect() == []
    (only,) = oneperm.edited_fingerprints(docs_of([(None, "a b c")])).collect()
    assert only.n_chars == 5 and only.next_id is None and only.near_next == 1.0


@pytest.mark.parametrize("bins,bits", [(256, 4), (1024, 1), (128, 8), (64, 16)])
def test_likeness_estimates_the_share_of_common_runs(spark, bins, bits):
    """Texts of many and of few runs with a known share in common; the estimate is unbiased in all sizes."""
    rows = []
    for i in range(60):
        size = (8, 40, 400, 2000)[i % 4]
        own = [f"w{i}x{j}" for j in range(size)]
        rows.append((size, " ".join(own), " ".join(own[: size // 2] + [f"v{i}x{j}" for j in range(size // 2)])))
    df = spark.createDataFrame(rows, "size int, a string, b string")
    df = oneperm.with_fingerprint(oneperm.with_fingerprint(df, "a", "p", 5, bins, bits), "b", "q", 5, bins, bits)
    found = df.select("size", "a", "b", oneperm.likeness("p", "q", bins, bits).alias("like")).collect()
    errors = []
    for r in found:
        a, b = plain_shingles(r.a), plain_shingles(r.b)
        errors.append(r.like - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.15


# Collocations


def plain_collocations(rows, top, min_count, longest=5, percent=100):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            found = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und" if lang is None else lang] += len(found)
            counts.update((("und" if lang is None else lang), *found[i : i + m]) for m in range(1, longest + 1) for i in range(len(found) - m + 1))
    often = {p: f for p, f in counts.items() if f >= min_count and len(p) > 2}
    covered = set()
    for (lang, *p), f in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                part = (lang, *p[i : i + m])
                if 100 * f >= percent * counts[part]:
                    covered.add(part)
    result = []
    for lang in {p[0] for p in often}:
        n, rows = totals[lang], []
        for p, a in often.items():
            if p[0] != lang or p in covered:
                continue
            cuts = [(1000 * a * n // (counts[p[: k + 1]] * counts[lang, *p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            rows.append((" ".join(p[1:]), a, counts[p[: k + 1]], counts[lang, *p[k + 1 :]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        result += [(lang, rank + 1, *r) for rank, r in enumerate(rows[:top])]
    return sorted(result)


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["New", "york", "city", "of", "the", "a\x01", "a", "b", "é", "Über,", "end."]
    texts = [" ".join(rng.choice(vocabulary[: 4 + i % 8]) for _ in range(rng.randrange(40))) for i in range(400)]
    langs = [None, "en", "en", "de", "und", ""]
    return [(langs[i % 6], t.replace("of the", "of\tthe") if i % 5 else t + "\nnew york") for i, t in enumerate(texts)] + [("en", None), (None, ""), ("xx", " . ")]


@pytest.mark.parametrize("top,min_count,longest,percent", [(2000, 10, 5, 100), (7, 5, 3, 100), (2000, 4, 4, 60), (50, 10**6, 5, 100)])
def test_collocations(spark, top, min_count, longest, percent):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, text, "x", "y", 1) for lang, text in rows], "lang string, text string, f string, phrase string, part int").repartition(3)
    got = collocations.collocations(docs, top=top, min_count=min_count, longest=longest, covered_percent=percent)
    want = plain_collocations(rows, top, min_count, longest, percent)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert bool(want) == (min_count < 10**6)


def test_counts_are_exact_when_the_bit_map_is_full(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAP_BITS", 6)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(docs, min_count=8).collect()) == plain_collocations(rows, 2000, 8)


def test_streams_cut_anywhere(spark):
    """Every row in a part of its own: all counts of the path are handed over."""
    keys = [(["en"], 9), (["en", "a"], 5), (["en", "a", "b"], 3), (["en", "a", "b", "c"], 2), (["en", "a", "c"], 1), (["fr"], 4), (["fr", "z"], 4)]
    counts = spark.createDataFrame(keys, "key array<string>, f bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        stream, _ = collocations.with_path_counts(counts, "firsts")
        got = {tuple(r.key): r.firsts for r in stream.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    known = {tuple(k): f for k, f in keys}
    assert got == {k: [known[k[:i]] for i in range(1, len(k))] for k in known}


def test_collocations_of_little(docs_of):
    assert collocations.collocations(docs_of([])).collect() == []
    big = [(None if i % 2 else i, "Big Apple, big  apple") for i in range(100)]
    assert [tuple(r) for r in collocations.collocations(docs_of(big)).collect()] == [("en", 1, "big apple", 200, 200, 200, 400, 2000)]


# Labelled samples


def test_a_sample_is_bounded_by_rows(spark):
    """One id ten thousand times is one row of the sample."""
    rows = [(7, "same")] * 10_000 + [(7, "other"), (8, None), (9, "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, None), (None, 1)], "doc_id bigint, quality int")
    got = [tuple(r) for r in labelled_sample(docs, labels, ["quality"], 10).collect()]
    assert len(got) == 2 and {r[1:] for r in got} == {(7, 1), (8, 1)}
    assert labelled_sample(docs, labels, ["quality"], 1).count() == 1
