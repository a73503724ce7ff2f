"""Quality, toxicity, personal data, near-duplicates and mixing against plain versions and held-out rows."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from apidrift.llm import golay, mixing, pii, quality, simhash, toxicity, trees
from apidrift.llm.common import table

TABLES = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# Quality


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é#\n \t\x0b|"), max_size=80)), min_size=1, max_size=5))
def test_base_counts(texts):
    found, _ = quality.statistics(pa.array(texts, pa.string()))
    assert list(zip(*[found[c].tolist() for c in quality.COUNTS])) == [plain_counts(t) for t in texts]


def test_quality_of_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = quality.quality_verdicts(docs, labels_of(spark, [])).collect()
    expected = sorted((i or -99, *plain_counts(t)) for i, t in odd_rows)
    assert sorted((r.doc_id or -99, *[r[c] for c in quality.COUNTS]) for r in rows) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    kept = quality.keep_good(docs, labels_of(spark, [(5, 1, 0), (None, 1, 0), (1, None, 0)]))
    assert kept.columns == docs.columns
    assert quality.keep_good(docs_of([]), labels_of(spark, [])).collect() == []


def test_boosted_trees_keep_their_constraints_and_learn():
    rng = np.random.default_rng(3)
    rows = rng.random((900, 3))
    label = (rows[:, 0] + 0.3 * np.sin(9 * rows[:, 1]) + 0.1 * rng.standard_normal(900) < 0.5).astype(float)
    model = trees.boosted_trees(rows[:600], label[:600], np.array([-1, 0, 0]), trees=40)
    assert ((model.probability(rows[600:]) > 0.5) == label[600:]).mean() > 0.85
    for other in rng.random((20, 2)):
        line = np.column_stack([np.linspace(0, 1, 200), np.tile(other, (200, 1))])
        assert (np.diff(model.probability(line)) <= 1e-12).all()
    constant = trees.boosted_trees(np.zeros((0, 2)), np.zeros(0), np.zeros(2, int))
    assert constant.probability(np.zeros((2, 2))).tolist() == [0.5, 0.5]


@needs_tables
def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    fitted = quality.fit(docs, labels.filter("doc_id % 3 = 0"))
    held = quality.judged(docs, fitted).filter("not base_failed").join(labels.filter("doc_id % 3 <> 0"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) >= 0.95 * len(held)


# Toxicity


@needs_tables
def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.toxicity(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    toxic, clean = ([r.toxic for r in rows if r.label == label] for label in (1, 0))
    # Some labels are wrong on purpose, so not all toxic rows can be found.
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in toxicity.CHAIN)


def test_kinds_are_words_that_go_together():
    """Four telling words in two pairs; a text of both pairs is of both kinds, toxic texts without them are of none."""
    texts = [(0, 1)] * 30 + [(2, 3)] * 20 + [(0, 3)] * 3 + [(9,)] * 5 + [(5, 6)] * 300
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    rows = toxicity.Sparse(owner, np.array([w for t in texts for w in t]), np.ones(len(owner)), len(texts))
    kinds = toxicity.kinds_of(rows, np.arange(len(texts)) < 58, 10)
    assert sorted([kinds[0].tolist(), kinds[30].tolist()]) == [[False, True], [True, False]]
    assert (kinds[:30] == kinds[0]).all() and (kinds[30:50] == kinds[30]).all() and kinds[50:53].all() and not kinds[53:].any()
    assert not toxicity.kinds_of(rows, np.zeros(len(texts), bool), 10).any()


def test_toxicity_of_odd_rows(spark, docs_of, odd_rows):
    for labels in ([], [(1, 1, 1), (5, 1, 0), (2, 1, None), (None, 0, 1)]):
        rows = toxicity.toxicity(docs_of(odd_rows), labels_of(spark, labels)).collect()
        assert sorted(r.doc_id or -99 for r in rows) == sorted(i or -99 for i, _ in odd_rows)
    assert toxicity.toxicity(docs_of([]), labels_of(spark, [])).collect() == []


def test_later_models_use_earlier_probabilities():
    """A category that equals the one before, on words that only the earlier one may use, is still predicted."""
    rng = np.random.default_rng(5)
    first = rng.random(400) < 0.3
    owner = np.flatnonzero(first)
    rows = toxicity.Sparse(owner, np.zeros(len(owner), np.int64), np.ones(len(owner)), 400)
    links = toxicity.fit_chain(rows, np.array([77]), np.column_stack([first, first]))
    links[1].words, links[1].weights = links[1].words[:0], links[1].weights[:0]
    p = toxicity.chain_probabilities(links, owner, np.full(len(owner), 77), 400)
    assert p[first, 1].min() > p[~first, 1].max()


# Personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((kind, *m.span()))
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a1@.-+ ()é9\n%"), max_size=60))
def test_fixed_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_fixed_patterns_of_usual_forms():
    text = "Mail a.b%c@mail.example.co.uk. or +1 (017) 555-7713; 4111 1111 1111 1111, 0001.2.3.255 256.1.1.1 1.2.3.4.5 4111111111111112"
    assert pii.base_spans(text) == plain_spans(text)
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "ip", "ip", "card", "phone"]


def test_contexts_discover_unseen_identifiers(spark, docs_of, odd_rows):
    """The account numbers after "account no" have no fixed form; the pattern is learnt from those that are cards."""
    cards = [n for n in (f"41111111{i:08d}" for i in range(400)) if luhn(n)][:20]
    seeds = [(100 + i, f"Please note: account no {c} was opened today.") for i, c in enumerate(cards)]
    plain = [(200 + i, f"The year {1000 + i} was a good one, and no 12345{i} more words.") for i in range(20)]
    unseen = [(300, "An account no AB-77812 was closed."), (301, None)]
    docs = docs_of(odd_rows + seeds + plain + unseen)
    accepted = pii.accepted_patterns(docs)
    assert "account no" in accepted and "year" not in accepted
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert rows[300].spans == "context:14:22" and rows[300].n_card == 0
    assert rows[301].spans == rows[3].spans == "" and rows[301].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[100].spans.startswith("card:24:40")
    assert not any(rows[i].spans for i, _ in plain)
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(docs).collect()}
    assert masked[300] == "An account no [CONTEXT] was closed." and masked[301] is None and masked[200] == plain[0][1]
    assert masked[100] == "Please note: account no [CARD] was opened today."
    assert pii.personal_data(docs_of([])).collect() == [] == pii.mask_personal_data(docs_of([])).collect()


def plain_contexts(texts):
    """Accepted patterns of all generations, in plain dictionaries."""
    graph, totals = Counter(), Counter()
    for text in texts:
        for start, end, seed, patterns in pii.mentions(text, pii.base_spans(text)):
            graph.update((p, text[start:end], seed) for p in patterns)
        words = [pii._named(w) for w in text.split()]
        totals.update(words[:-1])
        totals.update(" ".join(w) for w in zip(words[:-2], words[1:-1]))
    edges = {(p, v): (n, seed) for (p, v, seed), n in graph.items()}
    assert len(edges) == len(graph)
    found, counted, accepted = {}, set(), set()

    def believed(confidence, inside, least):
        doubt = {}
        for p, v in inside:
            if confidence[p] >= least:
                doubt[v] = doubt.get(v, 1.0) * (1 - min(confidence[p], 0.999))
        return {v: 1 - d for v, d in doubt.items()}

    while True:
        known = {(p, v): max(float(seed), found.get(v, 0.0)) for (p, v), (_, seed) in edges.items()}
        support = Counter(p for (p, _), b in known.items() if b > 0)
        fresh = {p for p, n in support.items() if n >= pii.MIN_SUPPORT} - counted
        if not fresh:
            return accepted
        counted |= fresh
        inside = [e for e in edges if e[0] in counted]
        belief = {e: known[e] for e in inside}
        for _ in range(pii.ROUNDS):
            mass = Counter()
            for p, v in inside:
                mass[p] += edges[p, v][0] * belief[p, v]
            confidence = {p: mass[p] / totals[p] for p in counted}
            marked = believed(confidence, inside, pii.TRUSTED)
            belief = {(p, v): max(known[p, v], marked.get(v, 0.0)) for p, v in inside}
        accepted = {p for p, c in confidence.items() if c >= pii.ACCEPTED}
        found = believed(confidence, inside, pii.ACCEPTED)


def test_found_identifiers_seed_patterns(spark, docs_of):
    """Account numbers found under "account no" make "pass" a pattern, and what stands there "locker" in turn."""
    cards = [n for n in (f"41111111{i:08d}" for i in range(400)) if luhn(n)][:20]
    texts = [f"Please note: account no {c} was opened." for c in cards]
    texts += [f"The account no AB-778{i} was closed." for i in range(4)] + [f"Show your pass AB-778{i} here." for i in range(4)]
    texts += ["Show your pass QX-90001 here.", "Show your pass QX-90002 here."]
    texts += [f"Key of locker {v} is lost." for v in ("AB-7780", "AB-7781", "QX-90001", "QX-90002", "ZZ-55555")]
    texts += [f"The year {10000 + i} was good." for i in range(9)] + ["The year AB-7780 was odd."]
    docs = docs_of(list(enumerate(texts)))
    accepted = pii.accepted_patterns(docs)
    assert accepted == plain_contexts(texts)
    assert {"account no", "your pass", "of locker"} <= accepted and "year" not in accepted
    rows = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert rows[texts.index("Key of locker ZZ-55555 is lost.")] == "context:14:22"


@pytest.mark.parametrize("gap", [" " * 1000, " \n\t" * 300])
def test_context_words_far_away(gap):
    found = lambda text: [(text[s:e], p) for s, e, _, p in pii.mentions(text, pii.base_spans(text))]
    assert found(f"Account{gap}No{gap}AB-77812") == [("AB-77812", ["no", "account no"])]
    long = "x" * 1000
    (_, one), = found(f"no {long} AB-77812")
    assert one == [hashlib.sha256(long.encode()).hexdigest(), f"no {hashlib.sha256(long.encode()).hexdigest()}"]
    assert found("is 'a@b.co','c@d.co' 12345") == [("a@b.co", ["is"]), ("c@d.co", ["is"]), ("12345", ["'a@b.co','c@d.co'", "is 'a@b.co','c@d.co'"])]


def test_few_seeds_are_enough_in_a_large_table(spark, docs_of):
    """Thousands of seeds under one context do not raise the support that another one needs."""
    cards = [n for n in (f"41111111{i:08d}" for i in range(100)) if luhn(n)][:3]
    hot = [(i, f"Please write to user{i}@mail{i}.example.org today.") for i in range(4000)]
    rare = [(5000 + i, f"His badge code {c} was shown.") for i, c in enumerate(cards)]
    docs = docs_of(hot + rare + [(6000, "Her badge code QX-4471 was lost."), (None, "Her badge code QX-4471 was lost.")])
    rows = pii.personal_data(docs).collect()
    assert len(rows) == 4005
    assert sorted(r.spans for r in rows if r.doc_id in (6000, None)) == ["context:15:22"] * 2
    assert sorted(r.text for r in pii.mask_personal_data(docs).filter("doc_id is null or doc_id = 6000").collect()) == ["Her badge code [CONTEXT] was lost."] * 2


def test_patterns_that_the_filter_lets_through_by_chance(spark, docs_of, monkeypatch):
    """A filter of 64 bits holds nearly every pattern; the joins drop what is not accepted."""
    cards = [n for n in (f"41111111{i:08d}" for i in range(400)) if luhn(n)][:20]
    seeds = [(100 + i, f"Please note: account no {c} was opened today.") for i, c in enumerate(cards)]
    docs = docs_of(seeds + [(200 + i, f"The year {10000 + i} w{i} {20000 + i} came.") for i in range(30)] + [(300, "An account no AB-77812 was closed.")])
    expected = sorted(map(tuple, pii.personal_data(docs).collect()))
    monkeypatch.setattr(pii, "FILTER_BITS", 64)
    assert sorted(map(tuple, pii.personal_data(docs).collect())) == expected
    assert sum("context" in r[-1] for r in expected) == 1


# Near-duplicates


def test_golay_neighbours_share_an_index():
    """Every word within the radius decodes to one codeword, and words one bit apart share one of their indices."""
    words = np.random.default_rng(7).integers(0, 1 << 23, 4000)
    index = golay.nearby(words)
    low, high, errors = golay.tables()
    assert (index[:, 0] >= 0).all() and ((index >= 0).sum(axis=1) % 5 == 1).all()
    nearest = words ^ errors[low[words & 2047] ^ high[words >> 11], 0]
    assert (np.bitwise_count(nearest ^ words) <= 3).all() and (golay.nearby(nearest)[:, 0] == nearest >> 11).all()
    for bit in range(23):
        other = golay.nearby(words ^ (1 << bit))
        assert ((index[:, :, None] == other[:, None, :]) & (index >= 0)[:, :, None]).any(axis=(1, 2)).all()


def plain_fingerprint(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBé \n\t"), max_size=30)), min_size=1, max_size=4))
def test_fingerprints(texts):
    assert simhash.fingerprint_array(pa.array(texts, pa.string()), 3).tolist() == [plain_fingerprint(t) for t in texts]


def plain_components(ids, prints):
    roots = list(range(len(ids)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                roots[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min((x for x in (least.get(find(i)), doc) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("paired", [32, 1])
def test_links_of_fingerprints(spark, monkeypatch, paired):
    """Chains, dense balls and far fingerprints; with the pair limit at one, every key goes by one-bit changes."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(11)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    prints = {0, (1 << 64) - 1, *centres}
    for c in centres[:3]:
        prints |= {c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))}
    chain = centres[4]
    for a, b in rng.integers(0, 64, (40, 2)):
        chain ^= (1 << int(a)) | (1 << int(b))
        prints.add(chain)
    prints = sorted(prints)
    ids = [int(i) for i in rng.permutation(len(prints))]
    signed = [(p - (1 << 64) if p >> 63 else p, i) for p, i in zip(prints, ids)]
    grouped = spark.createDataFrame(signed, "fp bigint, first bigint")
    found = {r.fp: r.component for r in simhash.group_of_fingerprint(grouped).collect()}
    assert [found[s] for s, _ in signed] == plain_components(ids, prints)


def test_near_duplicates_of_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t in odd_rows]
    components = plain_components([i for i, _ in odd_rows], prints)
    expected = sorted((i if i is not None else -99, f"{p:016x}", c) for (i, _), p, c in zip(odd_rows, prints, components))
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.fingerprint, r.component_id) for r in rows) == expected
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components))
    assert simhash.near_duplicates(docs_of([])).collect() == [] == simhash.drop_near_duplicates(docs_of([])).collect()
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, max_bits=3)


# Mixing


def test_rates_meet_the_targets(spark):
    """Soft posteriors, one domain far from its target; the plain version repeats the same steps in numpy."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet((0.4, 0.3, 0.2), 300)
    tokens = rng.integers(0, 500, 300)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "tokens bigint, p array<double>")
    shares = np.array([0.2, 0.5, 0.3])
    moves = mixing.fit_moves(rows, shares)
    found = sorted((r.tokens, r.p, r.rate) for r in mixing.with_rates(rows, moves).collect())
    rate, n, post = np.array([r[2] for r in found]), np.array([r[0] for r in found]), np.array([r[1] for r in found])
    assert (rate >= 0).all() and (rate == 0).any()
    assert np.allclose((n * rate) @ post, shares * n.sum(), rtol=2e-3)
    plain, totals = np.ones(300), tokens @ p
    weight = 1 / totals
    step = 1 / np.linalg.eigvalsh(np.sqrt(weight)[:, None] * ((p * tokens[:, None]).T @ p) * np.sqrt(weight)[None, :])[-1]
    for _ in moves:
        plain = np.maximum(0, plain - p @ (step * weight * ((tokens * plain) @ p - shares * tokens.sum())))
    assert np.allclose(sorted(plain), sorted(rate))


@needs_tables
def test_mixing_of_documents(spark):
    docs, labels = table(spark, str(TABLES), "documents"), table(spark, str(TABLES), "labels")
    rows = mixing.mixing_rates(docs, labels).collect()
    total = sum(r.tokens for r in rows)
    for domain, share in mixing.TARGETS.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{domain}"] for r in rows) - share * total) < 0.005 * total
    langs = {r.doc_id: r.lang for r in docs.collect()}
    labelled = {r.doc_id for r in labels.collect()}
    held = [r for r in rows if r.doc_id not in labelled and r.tokens > 100]
    right = sum(max(mixing.TARGETS, key=lambda d: r[f"p_{d}"]) == langs[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
    mixed = mixing.mixed(docs, labels)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_rows_with_null_or_repeated_ids_are_drawn_one_by_one(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "fit_moves", lambda *_: [np.full(len(mixing.TARGETS), 0.5)])
    docs = docs_of([(i, "The same words.") for i in (None, 7) for _ in range(400)] + [(None, None)] * 400)
    rows = mixing.mixing_rates(docs, labels_of(spark, [])).collect()
    assert all(abs(r.rate - 0.5) < 1e-9 for r in rows)
    for found in ([(r.doc_id, r.tokens > 0) for r in rows if r.copies], [(r.doc_id, r.text is not None) for r in mixing.mixed(docs, labels_of(spark, [])).collect()]):
        counts = Counter(found)
        assert len(counts) == 3 and all(140 < n < 260 for n in counts.values())


def test_mixing_of_odd_rows(spark, docs_of, odd_rows):
    for labels in ([], [(1, 1, 0), (5, 1, 0)]):
        rows = mixing.mixing_rates(docs_of(odd_rows), labels_of(spark, labels)).collect()
        assert sorted(r.doc_id or -99 for r in rows) == sorted(i or -99 for i, _ in odd_rows)
        assert all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert mixing.mixing_rates(docs_of([]), labels_of(spark, [])).collect() == []
    assert mixing.mixed(docs_of([]), labels_of(spark, [])).collect() == []
