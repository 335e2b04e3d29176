"""The corpus pipeline against a brute-force version of each stage."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import mixing, queries
from pyspark.sql import functions as F
from tests.llm.cases import SCHEMA, SPACE, real_texts, words
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, lang, s, len(t), "g", 0.5) for i, t, lang, s in real_texts(80)]
    base = words(rows[0][1])
    near = [(2000 + k, " ".join([*base[: 40 + k], f"changed{k}", *base[41 + k :]]), "en", "s", 1, "g", 1.0) for k in range(6)]
    more = [(1001, None, None, None, None, None, None), (1002, "", "en", "s", 0, "g", 0.0), (1003, "12 !! ##", "en", "s", 0, "g", 0.0), (1004, rows[3][1] + " ", "en", "s", 0, "g", 0.0), (1005, rows[3][1].replace(" ", "\n"), "en", "s", 0, "g", 0.0)]
    docs = spark.createDataFrame(rows + near + more, SCHEMA).select(*COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if k % 5 == 0 else 1, 1 if k % 7 == 0 else 0) for k, (i, *_) in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _sets(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == COLUMNS

    before, after = map(texts, seen["language_id"])
    assert after == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}

    before, after = map(texts, seen["exact_dedup"])
    groups = defaultdict(list)
    for i, t in before.items():
        groups[SPACE.sub(" ", t)].append(i)
    assert set(after) == {min(g) for g in groups.values()} and all(after[i] == before[i] for i in after)

    before, after = map(texts, seen["ngram_join"])
    sets, name = {i: _sets(t) for i, t in before.items()}, {i: i for i in before}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(before)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
                p, q = find(a), find(b)
                name[max(p, q)] = min(p, q)
    assert set(after) == {i for i in ids if find(i) == i} and len(after) < len(before)

    before, after = map(texts, seen["mixing"])
    rated = {r.doc_id: r.rate for r in mixing.rates(seen["mixing"][0], queries.domain_labels(spark.read.parquet(f"{folder}/labels.parquet")), queries.DOMAIN_SHARES).collect()}
    times = Counter(r.doc_id for r in seen["mixing"][1].collect())
    assert set(rated) == set(before) and all(after[i] == before[i] for i in after)
    assert all(times[i] in (int(rate), int(rate) + 1) for i, rate in rated.items())

    given = [(r.doc_id, r.text) for r in seen["packing"][0].collect()]
    rows = seen["packing"][1].collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, t in given:  # a document comes as often as its rate says
        want[i] += len(tok.encode(t, add_special_tokens=False).ids) + 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(o + n == q for (o, n), (q, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= 1024
    assert len(places) <= np.ceil(sum(want.values()) / 1024) * 1.05 + 1


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("percent", [3, 8, 20])
def test_mixing_meets_the_target(spark, tmp_path, percent):
    """The stage's output has 5 % of its tokens in toxic documents, whether they are too many or too few."""
    n, rows, labels = 3000, [], []
    for i in range(n):
        toxic = i % 100 < percent
        kind = "vile nasty hateful awful" if toxic else ("clear sound proper careful" if i % 2 else "plain loose short dull")
        rows.append((i, f"{kind} " * 3 + f"item{i} of the list", "en", "s", 1))
        labels.append((i, i % 2, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path))
    assert out.columns == COLUMNS
    tokens = {r.toxic: r.n for r in out.groupBy((F.col("doc_id") % 100 < percent).alias("toxic")).agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert abs(tokens.get(True, 0) / sum(tokens.values()) - 0.05) < 0.01
    assert abs(sum(tokens.values()) / (16 * n) - 1) < 0.03
