"""Spelling variants against every pair of words, and the rules of runs."""

import re
import zlib
from collections import Counter

import pytest
from plumbline.llm import spelling
from tests.llm.cases import awkward, empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, divisor):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % divisor == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(counts):
    around = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for size, some in by_length.items():
        for a in some:
            around[a] = [b for s in (size - 1, size, size + 1) for b in by_length.get(s, []) if near(a, b)]
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("divisor", [97, 3])
def test_variants_are_those_of_all_pairs(spark, divisor):
    docs = awkward(spark, 150)
    counts = plain_counts([(r.doc_id, r.text) for r in docs.collect()], divisor)
    got = [tuple(r) for r in spelling.variants(docs, divisor).collect()]
    assert len(got) == len(counts)
    assert set(got) == plain_variants(counts)
    assert any(r[4] > 1 for r in got)


def test_runs_of_equal_letters_ties_and_chains(spark):
    words = {"aaaaa": 3, "aaaaé": 6, "aaaaaa": 12, "aaaaab": 12, "baaaaa": 24, "abcde": 3, "abcdf": 4, "abcdg": 5, "xabcde": 5, "übermut": 3, "ubermut": 9, "lonely": 3, "b×b÷bb": 3, "b×b÷b": 40}
    rows = [(None if k % 2 else k, " ".join([w.upper().replace("É", "é").replace("Ü", "ü")] * n) + " €Āxα") for k, (w, n) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(docs, 1 << 40).collect()}
    counts = plain_counts(rows, 1 << 40)
    assert counts == words
    assert got == plain_variants(counts)


def test_words_whose_rotations_are_not_written(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WRITTEN", 7)
    docs = awkward(spark, 60)
    long = ["abcdefg", "abcdefgh", "abcdefghi", "abxdefgh", "aabbccddee", "abbccddee", "aabbccddeee", "aabbccddef", "zabcdefg", "z" * 3000, "z" * 3001, "z" * 2999 + "y"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + k, " ".join([w] * (3 + 2 * k))) for k, w in enumerate(long)]
    counts = plain_counts(rows, 97)
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_variants(counts)


def test_an_empty_table_has_no_words(spark):
    assert spelling.variants(empty(spark)).collect() == []
