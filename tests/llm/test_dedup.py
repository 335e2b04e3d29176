"""Exact dedup, n-gram join and suffix arrays against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from plumbline.llm import exact_dedup, ngram_join, suffix_dedup
from tests.llm.cases import SPACE, awkward, empty, words


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**57, 4000, dtype=np.uint64)
    parts = [np.unique(rng.choice(keys, 1500), return_counts=True) for _ in range(5)]
    merged = exact_dedup.QuotientFilter.merge([exact_dedup.QuotientFilter.build(k, c, 12, 0, 1 << 5) for k, c in parts])
    want = defaultdict(int)
    for k, c in parts:
        for x, n in zip(k, c, strict=True):
            want[int(x)] += int(n)
    assert dict(zip(merged.keys().tolist(), merged.counts.tolist(), strict=True)) == dict(want)


def test_exact_duplicates(spark):
    docs = awkward(spark)
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    for s, ids in sha.items():
        assert sum(r.kept for r in got if r.text_sha256 == s) == 1, ids
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert exact_dedup.deduplicated(empty(spark)).count() == 0


def _ngrams(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _near(spark):
    """Chains and a star of near copies around one text, beside the awkward rows."""
    docs = awkward(spark, 40)
    base = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(30):
        w = list(base)
        w[10 + 5 * k % 180] = f"changed{k}"
        w[(17 + 11 * k) % 190] = f"other{k}"
        rows.append((2000 + k, " ".join(w), "en", "s", 1, "g", 1.0))
    chain = list(base)
    for k in range(12):
        chain = [*chain[8:], *[f"tail{k}.{j}" for j in range(8)]]
        rows.append((3000 + k, " ".join(chain), "en", "s", 1, "g", 1.0))
    return docs.union(spark.createDataFrame(rows, docs.schema))


@pytest.mark.parametrize(("rows", "grams"), [(2048, 2_000_000), (2, 900)])
def test_similarity_classes(spark, monkeypatch, rows, grams):
    monkeypatch.setattr(ngram_join, "MOST_ROWS", rows)
    monkeypatch.setattr(ngram_join, "MOST_GRAMS", grams)
    docs = _near(spark)
    sets = {r.doc_id: _ngrams(r.text) for r in docs.collect() if r.doc_id is not None}
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    members, links = ngram_join.similarity_classes(docs)
    got = members.collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: find(i) for i in ids}
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    for r in links.collect():
        n = len(sets[r.a] & sets[r.b])
        assert abs(r.j - n / (len(sets[r.a]) + len(sets[r.b]) - n)) < 1e-12 and r.j >= 0.8
    assert ngram_join.representatives(docs).columns == docs.columns


@pytest.mark.parametrize("block", [2048, 40])
def test_all_links_of_a_large_group(spark, monkeypatch, block):
    """150 near copies, some with copies of their own: every link counts, whatever the size of a bucket."""
    monkeypatch.setattr(ngram_join, "MOST_ROWS", block)
    rng = np.random.default_rng(7)
    base = [f"word{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.choice(120, k % 3, replace=False):
            w[at] = f"changed{k}.{at}"
        rows.append((k, " ".join(w), "en", "s", 1, "g", 1.0))
    docs = spark.createDataFrame(rows, empty(spark).schema)
    sets = {r[0]: _ngrams(r[1]) for r in rows}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = {i: sum(i in p for p in near) for i in sets}
    members, links = ngram_join.similarity_classes(docs)
    got = members.collect()
    assert {r.doc_id: r.n_links for r in got} == want and len(set(want.values())) > 5
    reps = {r.rep for r in got}
    assert len(reps) > 90 and sorted((r.a, r.b) for r in links.collect()) == sorted(p for p in near if set(p) <= reps)


def test_rounds_of_a_large_group_run_on_pairs_of_hubs(spark, monkeypatch):
    """200 near copies meet in many buckets; the components' rounds take few edges for them, and the classes stay."""
    from plumbline.operators import graph

    rng, base = np.random.default_rng(11), [f"word{k}" for k in range(160)]
    rows = []
    for k in range(200):
        w = list(base)
        w[int(rng.integers(160))] = f"changed{k}"
        rows.append((k, " ".join(w), "en", "s", 1, "g", 1.0))
    edges, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag: edges.append(df.count()) or write(df, tag) if tag == "edges" else write(df, tag))
    monkeypatch.setattr(ngram_join, "MOST_ROWS", 60)
    members, _ = ngram_join.similarity_classes(spark.createDataFrame(rows, empty(spark).schema))
    assert {r.class_id for r in members.collect()} == {0}
    assert edges and max(edges) < 200  # both directions; before, an edge for each node and bucket


@pytest.mark.parametrize("seed", [1, 2])
def test_hub_components_are_those_of_all_ties(spark, seed):
    from plumbline.operators import graph

    rng = np.random.default_rng(seed)
    groups = [sorted(set(map(int, rng.choice(300, 3)))) for _ in range(90)]
    ties = spark.createDataFrame([(n, g[0]) for g in groups for n in g], "node long, hub long")
    assert {tuple(r) for r in graph.hub_components(ties).collect()} == {tuple(r) for r in graph.connected_components(ties, "node", "hub").collect()} | {(g[0], g[0]) for g in groups if len(g) == 1 and sum(g[0] in h for h in groups) == 1}


def test_repeated_ids_and_rows(spark):
    """Rows of one id with different texts are judged each by its text; of repeated rows one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    rows = [(1, a), (7, near), (7, b), (3, b), (9, c), (9, c), (None, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "g", 1.0) for i, t in rows], empty(spark).schema)
    members, links = ngram_join.similarity_classes(docs)
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in members.collect()) == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (3, 3, 1), (7, 1, 1), (7, 3, 1), (9, 9, 1), (9, 9, 1)]
    assert [(r.a, r.b) for r in links.collect()] == [(1, 7)]
    kept = ngram_join.representatives(docs)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (3, b), (9, c), (0, c), (0, c)])


def test_join_of_an_empty_table(spark):
    assert ngram_join.similarity_classes(empty(spark))[0].count() == 0


def test_bands_meet_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


@pytest.mark.parametrize("most", [2048, 3, 1])
def test_repeated_spans(spark, monkeypatch, most):
    """Every covered word, with all n-grams sorted, with some, and with windows alone."""
    monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", most)
    docs = awkward(spark)
    passage = " ".join(f"shared{k}" for k in range(57))
    extra = [(4000 + k, f"own{k} " * (3 * k + 1) + passage + f" end{k}" * (2 * k), "en", "s", 1, "g", 1.0) for k in range(6)]
    extra += [(4100, " ".join(passage.split()[:49]) + " cut", "en", "s", 1, "g", 1.0), (4101, (passage + " sep ") * 3, "en", "s", 1, "g", 1.0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    texts = defaultdict(list)
    for r in docs.collect():
        if r.doc_id is not None:
            texts[r.doc_id].append(words(r.text))
    seen = defaultdict(set)
    for i, all_w in texts.items():
        for w in all_w:
            for k in range(len(w) - 49):
                seen[tuple(w[k : k + 50])].add(i)
    want = defaultdict(set)
    for i, all_w in texts.items():
        for w in all_w:
            for k in range(len(w) - 49):
                if len(seen[tuple(w[k : k + 50])]) > 1:
                    want[i] |= set(range(k, k + 50))
    got = defaultdict(set)
    for r in suffix_dedup.repeated_spans(docs).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.other_id != r.doc_id
    assert got == want
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0


def test_spans_hidden_by_half_matches(spark):
    """A and B share 15 words left and right of a 20-gram; C-like texts share only one half, closer in the sort order."""
    gram = [f"g{k}" for k in range(20)]
    left, right = [f"l{k}" for k in range(15)], [f"r{k}" for k in range(15)]
    texts = {1: [*left, *gram, *right, "m"], 2: [*left, *gram, *right, "p"]}
    texts[1], texts[2] = ["m", *texts[1]], ["p", *texts[2]]
    for k in range(20):
        texts[10 + k] = [f"x{k}", *gram, *right, f"n{k}"]
        texts[50 + k] = [f"n{k}", *left, *gram, f"y{k}"]
    rows = [(i, " ".join(w), "en", "s", 1, "g", 1.0) for i, w in texts.items()]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, empty(spark).schema)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_id) for r in got) == [(1, 1, 51, 2), (2, 1, 51, 1)]


def test_partners_of_sorted_suffixes(spark):
    """Random halves around one n-gram: spans and the least partner of each document are those of all pairs."""
    rng = np.random.default_rng(3)
    gram, texts = [f"g{k}" for k in range(20)], {}
    for i in range(60):
        cuts, kinds = rng.integers(5, 40, 2), rng.integers(0, 4, 2)
        halves = [[f"{side}{k}" if k < cut else f"{side}{k}.{kind}" for k in range(rng.integers(cut, 41))] for side, cut, kind in zip("lr", cuts, kinds, strict=True)]
        texts[i] = [*halves[0][::-1], *gram, *halves[1]]
    spans, partner = {}, {}
    for i, a in texts.items():
        for j, b in texts.items():
            if i == j:
                continue
            p, q = a.index("g0"), b.index("g0")
            left = next((k for k in range(min(p, q)) if a[p - 1 - k] != b[q - 1 - k]), min(p, q))
            x, y = a[p + 20 :], b[q + 20 :]
            right = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            if left + right + 20 >= 50:
                spans.setdefault(i, set()).update(range(p - left, p + 20 + right))
                partner[i] = min(partner.get(i, j), j)
    rows = [(i, " ".join(w), "en", "s", 1, "g", 1.0) for i, w in texts.items()]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, empty(spark).schema)).collect()
    assert {r.doc_id: set(range(r.start_word, r.end_word)) for r in got} == spans and len(spans) > 20
    assert {r.doc_id: r.other_id for r in got} == partner
