"""Ranked search against plain scores of all documents, and the tree's bounds."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from plumbline.llm import lexical_search
from tests.llm.cases import awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = set(terms(text))
        found = []
        for (i, c), n in zip(held, sizes, strict=True):
            m = 100 - 90 + (90 * n * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(8192, 1 << 19, 32, 1 << 17), (50, 300, 3, 200)])
def test_ranks_are_those_of_all_scores(spark, monkeypatch, blocks):
    docs = awkward(spark, 190).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(k, rows[k][1][:300]) for k in range(0, 60, 3)] + [(900, None), (901, " !! "), (902, "one TWO three"), (902, "one two"), (None, rows[2][1]), (903, " odd ends w5x5 W6X6"), (904, rows[3][1] + rows[9][1] + " absent")]
    for name, value in zip(("BLOCK_ROWS", "BLOCK_ENTRIES", "ITEM_BLOCKS", "ITEM_BYTES"), (blocks[0], blocks[1], 2 if blocks[0] == 50 else 16, blocks[3]), strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, items)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    n, width = 900, 400
    topic = rng.integers(0, 6, n)
    row = np.repeat(np.arange(n), 25)
    col = (topic[row] * 60 + rng.integers(0, 90, len(row))) % width
    key = np.unique(row * width + col)
    row, col = key // width, key % width
    weights = rng.integers(1, 9000, width)

    class Fake:
        pass

    items = Fake()
    items.columns, items.weights = np.arange(width, dtype=np.uint64), weights
    items.ids, items.null = np.arange(12), np.zeros(12, "u1")
    lists = [np.unique((t % 6) * 60 + rng.integers(0, 90, 20)) % width for t in range(12)]
    lists = [np.unique(x) for x in lists]
    items.cells, items.begin = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
    items.kept = [[] for _ in lists]
    saturation = rng.integers(1, 10**6, len(row))
    block = lexical_search.Block(items, np.arange(n), np.zeros(n, bool), saturation, row, col.astype(np.uint64))
    scored = block.search(items, 10)
    dense = np.zeros((n, width), np.int64)
    dense[row, col] = weights[col] * saturation
    for q, own in enumerate(lists):
        scores = dense[:, own].sum(1)
        wanted = sorted((-int(s), False, i) for i, s in enumerate(scores) if s > 0)[:10]
        assert items.kept[q] == wanted
    assert scored < 0.8 * len(lists) * (1 << block.balls.depth)


def test_no_rows(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(empty(spark), items).collect() == []
    assert lexical_search.search(awkward(spark, 2), items.limit(0)).collect() == []
