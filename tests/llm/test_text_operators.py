"""Tokens, packing, language model, language ID, quality rules, URLs, mixing: small cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import kneser_ney, language_id, mixing, packing, quality_rules, queries, token_scan, url_filter
from plumbline.llm.kit import words as hashed_words
from plumbline.llm.shared_files import shared_folder
from pyspark.sql import functions as F
from tests.llm.cases import awkward, empty, words
from tokenizers import Tokenizer

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(JSON)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from plumbline.llm import kit

    texts = ["one two  three", "", " lead", "a\x0bb\x1fc", "é ü", "tail "] * 3
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = hashed_words(data, offsets)
    monkeypatch.setattr(kit, "BLOCK_BYTES", 7)
    parts = hashed_words(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    spelled = [data[s:e].tobytes().decode() for s, e in zip(whole[0], whole[1], strict=True)]
    assert spelled == [w for t in texts for w in words(t)]


@pytest.mark.parametrize("text", ["a  b", "a   b", " a", "a ", "\n a", "a \n b", "it's, 3 don't.", "<|endoftext|> x<|endoftext|>", "a\u00a0 b", "x\x1c y", "é, è! ñ.", "a\t b  \n\n c", "...", " .", "abc.", "A.B c!"])
def test_chunked_ids_are_the_tokenizers(plain, text):
    tok = packing.ChunkTokenizer(JSON, RANKS, PATTERN)
    for t in (text, f"pre {text} post", text * 3):
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(spark, plain):
    docs = awkward(spark)
    got = queries.packed_digests(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, same in texts.items():
        ids = np.array([*plain.encode(same[0] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids) * len(same)
        rows = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))
        assert len(rows) == -(-len(ids) // 1024) * len(same)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 1024 or r.piece == 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-total // 1024) * 1.05 + 1
    assert queries.packed_digests(empty(spark)).count() == 0


def test_plan_gives_every_rank_one_place():
    rng = np.random.default_rng(3)
    for size in (8, 64, 1024):
        histogram = {int(k): int(n) for k, n in zip(rng.integers(1, size + 1, 40), rng.integers(1, 500, 40), strict=True)}
        used, placed = defaultdict(int), Counter()
        for length, rank, n, first, at in packing.plan(histogram, size):
            placed[length] += n
            assert rank + n <= histogram[length]
            for s in range(first, first + n):
                assert used[s] == at
                used[s] += length
        assert placed == Counter(histogram) and max(used.values()) <= size


@pytest.mark.parametrize("block", [3, 50, 1 << 22])
def test_token_scan(spark, block):
    docs = awkward(spark, 20)
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    folder = shared_folder(spark, "tokens")
    wrote = token_scan.write_token_files(docs, folder, JSON, RANKS, PATTERN).select("doc_id", "file", "doc").collect() if block > 3 else None
    if wrote is None:  # hand-made files: empty documents, no end at the tail, an empty file
        for name, ids in (("a", [7, 9, 1, 9, 9, 5, 5, 5, 5, 5, 9]), ("b", [9]), ("c", [4, 4, 4, 4, 4, 4, 4]), ("d", [])):
            np.array(ids, "<u2").tofile(f"{folder}/{name}.bin")
        got = {(r.file, r.doc): (r.start, r.n_tokens, r.closed) for r in token_scan.count_tokens(spark, folder, 9, block_tokens=block).collect()}
        assert got == {("a.bin", 0): (0, 1, True), ("a.bin", 1): (2, 1, True), ("a.bin", 2): (4, 0, True), ("a.bin", 3): (5, 5, True), ("b.bin", 0): (0, 0, True), ("c.bin", 0): (0, 7, False)}
        return
    counted = {(r.file, r.doc): r.n_tokens for r in token_scan.count_tokens(spark, folder, block_tokens=block).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(counted) == len(wrote)
    for r in wrote:
        assert counted[r.file, r.doc] == len(plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)


def test_language_model(spark):
    docs = awkward(spark, 40).where("doc_id is not null")
    model = kneser_ney.fit(docs)
    tok = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.collect()
    seen, pairs = Counter(), Counter()
    for r in rows:
        t = [*words((r.text or "").translate(low)), "\0end"]
        tok[r.doc_id] = t
        seen.update(t)
        pairs.update(zip(["\0begin", *t], t, strict=False))
    n, v = sum(seen.values()), len(seen)
    assert (model.tokens, model.vocabulary, model.contexts) == (n, v, len(pairs))
    d = kneser_ney.discounts(*[sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    spread = Counter(w for _, w in pairs)
    dw = kneser_ney.discounts(*[sum(c == k for c in spread.values()) for k in (1, 2, 3, 4)])
    cut = lambda c, by: 0.0 if not c else c - by[min(c, 3) - 1]
    rest = sum(dw[min(c, 3) - 1] for c in spread.values()) / len(pairs)
    total, gamma = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        gamma[a] += d[min(c, 3) - 1]
    single = lambda w: cut(spread[w], dw) / len(pairs) + rest / (v + 1)
    p = lambda a, w: (cut(pairs[a, w], d) + gamma[a] * single(w)) / total[a] if total[a] else single(w)
    context = tok[0][3]
    assert abs(sum(p(context, w) for w in seen) + p(context, "\0unknown") - 1) < 1e-9
    for r in kneser_ney.score(docs, model).collect():
        t = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), len(t), n)
        assert abs(r.base_score - sum(np.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 * len(t)
        assert abs(r.score - sum(np.log10(p(a, w)) for a, w in zip(["\0begin", *t], t, strict=False))) < 1e-6 * len(t)
    none = kneser_ney.fit(empty(spark))
    assert all(r.score == 0 for r in kneser_ney.score(docs, none).collect())
    assert kneser_ney.score(empty(spark), model).count() == 0


def test_language_id(spark):
    docs = awkward(spark, 200)
    model = language_id.fit(docs.where("doc_id < 1000 and doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1001, 1002, 1003, 1008)] == ["und"] * 4
    held = [r for r in docs.where("doc_id < 1000 and doc_id % 4 = 2").collect()]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    texts = {r.lang: r.text for r in held}
    mixed = spark.createDataFrame([(1, texts["en"][:1500] + " " + texts["de"][:1500])], "doc_id long, text string")
    shares = language_id.identify(mixed, model).first().shares
    assert set(shares) == {"en", "de"} and min(shares.values()) > 0.2
    nothing = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0
    stay = language_id.determined(docs, model)
    assert stay.schema == docs.schema
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in (1001, 1002, 1003, 1008))


def test_quality_rules(spark):
    docs = awkward(spark)
    extra = [(5000, "a b c a b c a b c", "en", "s", 1, "g", 1.0), (5001, "x y z\nx y z\n\n \nx y z", "en", "s", 1, "g", 1.0), (5002, "a a a a a", "en", "s", 1, "g", 1.0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    book = quality_rules.ledger(docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == want
    rows = book.collect()
    for r in quality_rules.ablations(book).collect():
        bit, mask = quality_rules.bit(r.rule), quality_rules.mask(r.policy)
        assert (r.n_documents, r.n_failed, r.n_only_this) == (len(rows), sum(bool(x.failed & bit) for x in rows), sum(x.failed & mask == bit for x in rows))
    assert quality_rules.ledger(empty(spark)).count() == 0


URLS = ["http://A.NET/x", "https://www.example.net/en/1?q=2", "https://Example.Net/de/", "http://sub.example.com/de/9#z", "http://x.org/fr/", "http://notexample.com/de/1", "ftp://b.org", "no scheme", None, "", "http://net/", "http://x.network/", "https://é.org/fr/ü", "http://h?p#q", "a://b://c.net/d"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(k, u, "clash", 1.5) for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, w double")
    labelled = spark.createDataFrame([(f"http://ads{k}.bad.com/click/{k}", 1) for k in range(60)] + [(f"http://site{k}.good.com/read/{k}", 0) for k in range(60)], "url string, label int")
    weights = url_filter.fit(url_filter.bounded_sample(labelled))
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES, weights).collect()}
    for k, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best and best.text)
        assert got[k].verdict == best.verdict if best else got[k].verdict in ("allow", "block")
    more = spark.createDataFrame([(1, "http://ads99.bad.com/click/7"), (2, "http://site99.good.com/read/7")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(more, [], weights).collect()} == {1: "block", 2: "allow"}
    none = url_filter.fit(url_filter.bounded_sample(labelled.where("false")))
    assert {r.verdict for r in url_filter.judge(more, [], none).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), queries.URL_RULES, weights).count() == 0


def _model(rows):
    """Hashed n-gram logistic regression by plain gradient descent, from (features, label)."""
    x = np.zeros((len(rows), url_filter.DIM + 1))
    for k, (fs, _) in enumerate(rows):
        x[k, fs] = 1 / np.sqrt(len(fs))
    y, w = np.array([label for _, label in rows], float), np.zeros(x.shape[1])
    for _ in range(url_filter.STEPS):
        touched = x.any(0)
        w += url_filter.RATE * ((y - 1 / (1 + np.exp(-x @ w))) @ x / len(rows) - url_filter.RIDGE * w) * touched
    return w


def test_url_scores_and_held_out_labels(spark):
    table = queries.labelled_urls(spark)
    host, path = url_filter.host_and_path(F.col("url"))
    rows = table.select("url", "label", url_filter.features(host, path).alias("fs")).collect()
    assert len(rows) == len({r.url for r in rows}) == 300
    want = _model([(r.fs, r.label) for r in rows])
    got = url_filter.fit(table)
    assert np.allclose(got, want, atol=1e-6)
    pages = spark.createDataFrame([(k, r.url) for k, r in enumerate(rows)] + [(900, None), (901, "x" * 20_000), (902, "http://ads-track.example.org/en/3"), (903, "http://river-museum.example.com/en/3")], "page_id long, url string")
    scores = {r.page_id: r for r in url_filter.judge(pages, [], got).collect()}
    for k, r in enumerate(rows):
        z = sum(want[f] for f in r.fs) / np.sqrt(len(r.fs))
        assert abs(scores[k].score - 1 / (1 + np.exp(-z))) < 1e-7 and scores[k].verdict == ("block" if scores[k].score > 0.5 else "allow")
    assert scores[902].verdict == "block" and scores[903].verdict == "allow"
    # Held out: all URLs that hold one of a fifth of the names.
    right = total = 0
    for fold in range(5):
        held = set(queries.BLOCKED_NAMES[fold::5]) | set(queries.ORDINARY_NAMES[fold::5])
        out = [r for r in rows if any(n in r.url for n in held)]
        w = _model([(r.fs, r.label) for r in rows if r not in out])
        right += sum((sum(w[f] for f in r.fs) > 0) == bool(r.label) for r in out)
        total += len(out)
    assert right / total > 0.75, right / total


def test_quality_rules_against_sql(spark, tmp_path):
    import duckdb

    docs = awkward(spark, 60).select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op10_quality_rules", "quality_ablations"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.sql(queries.ORACLE_SQL[name]).select(*got.columns).fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def _mixture(model, text):
    """Proportions by plain EM, elimination one by one, for one text."""
    word, grams_of = [], []
    body = language_id._LETTER[np.frombuffer(text.encode(), np.uint8)]
    grams = language_id._trigrams(language_id._letters(np.frombuffer(text.encode(), np.uint8)))
    for k, c in enumerate(body):
        if c != 0x20:
            word.append(grams[k])
        if word and (c == 0x20 or k == len(body) - 1):
            grams_of.append(word)
            word = []
    p = np.exp(np.array([[sum(model.table[lang][g] for g in w) for lang in range(len(model))] for w in grams_of], float))
    p /= p.max(1, keepdims=True)
    allowed, best = np.ones(len(model), bool), (np.inf, None)
    while allowed.any():
        share = allowed / allowed.sum()
        for _ in range(language_id.EM_STEPS):
            q = p * share
            share = (q / q.sum(1, keepdims=True)).mean(0)
        cost = language_id.PENALTY * allowed.sum() * np.log(len(p) + 1) - np.log((p * share).sum(1)).sum()
        best = min(best, (cost, tuple(share)), key=lambda x: x[0])
        allowed[np.argmin(np.where(allowed, share, np.inf))] = False
    return np.array(best[1])


def test_language_mixtures_of_many_languages(spark):
    """Nine invented languages: no set of languages is left out before the likelihood is looked at."""
    rng = np.random.default_rng(5)
    syllables = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(25)] for k in range(9)}
    write = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(n))
    train = spark.createDataFrame([(k * 10 + j, write(lang, 200), lang) for k, lang in enumerate(syllables) for j in range(4)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert len(model) == 9
    texts = [write(lang, n) for lang in syllables for n in (2, 8, 60)] + [write("l1", 40) + " " + write("l7", 25), " ".join(write(lang, 30) for lang in syllables), "zzz qqq"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        if texts[r.doc_id] == "zzz qqq":  # no language knows it: a tie, which goes to the first by name
            assert r.shares == {"l0": 1.0}
            continue
        want = _mixture(model, texts[r.doc_id])
        assert np.allclose([r.shares.get(lang, 0.0) for lang in model.langs], want, atol=2e-3), (r.doc_id, r.shares, want)
    assert set(got[27].shares) == {"l1", "l7"} and len(got[28].shares) == 9


def test_rates_against_least_squares(spark):
    """Projected-gradient rates meet what a plain solver says can be met."""
    rng = np.random.default_rng(11)
    for targets in ({"a": 3000.0, "b": 1000.0, "c": 500.0}, {"a": 0.0, "b": 9000.0, "c": 0.0}):
        p = rng.dirichlet([0.4, 0.4, 0.4], 120)
        n = rng.integers(1, 60, 120)
        soft = spark.createDataFrame([(k, int(n[k]), *map(float, p[k])) for k in range(120)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
        rated, history = mixing.fit_rates(soft, ["a", "b", "c"], targets)
        r = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
        gap = np.array(list(targets.values())) - (r * n) @ p
        rate, step = np.ones(120), 1 / np.linalg.norm((n[:, None] * p).T @ (n[:, None] * p), 2)
        for _ in range(4000):
            rate = np.maximum(0, rate + step * (n[:, None] * p * (np.array(list(targets.values())) - (rate[:, None] * n[:, None] * p).sum(0))).sum(1))
        best = np.linalg.norm(np.array(list(targets.values())) - (rate * n) @ p)
        known = [np.linalg.norm([targets[d] - h[d] for d in targets]) for h in history]
        assert (r >= 0).all() and abs(np.linalg.norm(gap) - min(known)) < 1e-6 * sum(targets.values())
        if targets["a"]:  # a target within reach is met; at the edge of the cone steps grow small
            assert best < 1 and np.linalg.norm(gap) < 1
        else:
            assert np.linalg.norm(gap) < 0.5 * known[0]


@pytest.mark.parametrize("share", [0.02, 0.05, 0.3])
def test_rates_of_nearly_hard_posteriors_meet_their_targets(spark, share):
    """Texts whose words tell their domain, with a soft edge: targets are met to a tenth of a per cent."""
    rng = np.random.default_rng(12)
    kind = rng.choice(3, 3000, p=[0.82, 0.08, 0.10])
    p = np.where(rng.random((3000, 1)) < 0.9, 0.99 * np.eye(3)[kind] + 0.01 / 3, rng.dirichlet([2, 1, 1], 3000))
    n = rng.integers(1, 3000, 3000)
    soft = spark.createDataFrame([(int(n[k]), *map(float, p[k])) for k in range(3000)], "n_tokens long, p0 double, p1 double, p2 double")
    now = (n[:, None] * p).sum(0)
    targets = {"good": (1 - share) * n.sum() * now[0] / (now[0] + now[1]), "poor": (1 - share) * n.sum() * now[1] / (now[0] + now[1]), "toxic": share * n.sum()}
    rated, history = mixing.fit_rates(soft, list(targets), targets)
    got = rated.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p{i}")) for i in range(3)], F.min("rate")).first()
    assert all(abs(got[i] - t) < 1e-3 * n.sum() for i, t in enumerate(targets.values())) and got[3] >= 0
    assert len(history) < 12


def test_mixing_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, domain string")
    got = mixing.rates(empty(spark), labels, {"bad": 0.1})
    assert got.collect() == [] and got.columns == ["doc_id", "n_tokens", "p_bad", "p_good", "rate"]


def test_mixing(spark):
    docs = spark.createDataFrame([(k, ("fine words here " if k % 4 else "nasty trash there ") * (3 + k % 5) + f"doc{k}", "x") for k in range(400)] + [(900, None, "x"), (901, "", "x"), (5, "fine words here", "x")], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(k, "good" if k % 4 else "bad") for k in range(0, 200)], "doc_id long, domain string")
    got = mixing.rates(docs, labels, {"bad": 0.1}).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(r.p_good + r.p_bad - 1) < 1e-9 for r in got)
    tokens = sum(r.n_tokens for r in got)
    assert abs(sum(r.rate * r.n_tokens * r.p_bad for r in got) / tokens - 0.1) < 1e-3
    assert abs(sum(r.rate * r.n_tokens for r in got) - tokens) < 1e-3 * tokens
    clear = [r for r in got if r.doc_id < 400]
    assert all((r.p_bad > 0.5) == (r.doc_id % 4 == 0) for r in clear)
    with pytest.raises(ValueError, match="domains"):
        mixing.labelled_sample(labels.where("false"))


def test_posteriors_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = docs.where("doc_id < 60").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("domain"))
    got = mixing.rates(docs, labels, {"other": 0.3}).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.n_tokens for r in got}[1001] == 0


def test_tokenizer_holds_little_and_packs_small_batches(monkeypatch):
    """Workers that have a JVM beside them keep no second tokenizer, and a bounded number of chunks that stay right after they go."""
    tok = packing.ChunkTokenizer(JSON, RANKS, PATTERN)
    assert tok._whole is None and packing.MOST_IDS <= 500_000
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 10)
    words = " ".join(f"wort{i}" for i in range(50))
    for text in (words, words, "a <|endoftext|> b, c. d!"):
        assert tok.ids(text) == np.array(tok.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(tok) <= 10
