"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: each partition reduces its (context, word) pairs to distinct ones
with counts and deals them to shards by half the bits of the context's hash and
half of the word's, as arrays, so that a frequent context is spread over many
shards.  A shard sums them, writes its sorted
hash array of bigrams to the shared folder, and deals what it has of each context
(total, words seen once, twice, more often) and of each word (occurrences,
distinct contexts), one row each, to shards by their hashes, which add up and
write the contexts and the unigrams.  The driver sees a few totals.

Scoring: workers map the arrays into memory and look hashes up by bisection.

    p(w | v) = (max(c(vw) - D(c(vw)), 0) + (D1 n1 + D2 n2 + D3 n3)(v) p(w)) / c(v)
    p(w)     = (max(k(w) - D'(k(w)), 0)) / K + rest / (V + 1)

with k(w) the number of distinct contexts of w and K their sum; a word outside
the V known ones has the share rest / (V + 1).  The order is two: three-word
entries of such a corpus would not fit the disk budget (see README).

Cases: tokens are words with A-Z in lower case, then one end.  A null or empty
text is the end alone.  Repeated rows count as often as they stand, and rows with
a null id as any other.  Ties cannot occur.  A text of any length is scored as a
whole.  Only the id and the text are read, so no other column can clash.  With no
training text every token has probability 1.  Counts are 64-bit where one word
can gather a share of the corpus.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, mix64, row_slices, utf8, words
from plumbline.llm.shared_files import save, shard_bits, shared_folder

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5A1E38B93)
FLUSH_TOKENS = 2_000_000


def _pair(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """Hash of a pair; its first ``bits`` bits, which name its shard, are half the context's first bits and half the word's."""
    by_word = bits // 2
    shard = ((context >> np.uint64(64 - bits + by_word)) << np.uint64(by_word)) | (word >> np.uint64(64 - by_word))
    return (shard << np.uint64(64 - bits)) | (mix64(context * np.uint64(0x9E3779B97F4A7C15) + word) >> np.uint64(bits))


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(context, word, where each row begins) of all tokens, the end included."""
    _, _, hashes, first = words(data, offsets, fold=True)
    rows = len(first) - 1
    begin = first + np.arange(rows + 1)
    word = np.full(int(begin[-1]), END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[begin[1:] - 1] = False
    word[inner] = hashes
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[begin[:-1]] = BEGIN
    return context, word, begin


def _by_shard(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys' first bits, and where each shard begins in it."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange((1 << bits) + 1))


def _count_partition(bits: int):
    def count(batches):
        begins("counts")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in row_slices(offsets):
                context, word, _ = tokens(data, offsets[i : j + 1])
                held.append((context, word))
                size += len(word)
                if size >= FLUSH_TOKENS:
                    yield _reduced(held, bits)
                    held, size = [], 0
        if size:
            yield _reduced(held, bits)

    return count


def _cuts(keys: np.ndarray, bits: int, *columns: np.ndarray) -> list:
    """Shards of the keys, which are sorted by shard, and each column's bytes shard by shard."""
    edges = np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    full = np.flatnonzero(np.diff(edges))
    return [full.astype(np.int32), *[[c[edges[s] : edges[s + 1]].tobytes() for s in full] for c in columns]]


def _reduced(held, bits: int) -> pa.RecordBatch:
    context, word = (np.concatenate(x) for x in zip(*held, strict=True))
    key, at, n = np.unique(_pair(context, word, bits), return_index=True, return_counts=True)
    order = np.lexsort((context[at], key >> np.uint64(64 - bits)))  # contexts side by side, which shuffles take as less
    key, at, n = key[order], at[order], n[order]
    shard, *parts = _cuts(key, bits, context[at], word[at], n.astype("<u4"))
    return pa.RecordBatch.from_arrays([pa.array(shard), *[pa.array(x, pa.binary()) for x in parts]], names=["shard", "context", "word", "n"])


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _sums(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys, and the sum of each column over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [keys[at], *[np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns]]


def _bigram_shard(folder: str, bits: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        context, word, n = _joined(pdf.context, "<u8"), _joined(pdf.word, "<u8"), _joined(pdf.n, "<u4").astype(np.int64)
        key = _pair(context, word, bits)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.add.reduceat(n[order], at)
        key, context, word = key[at], context[order][at], word[order][at]
        save(f"{folder}/bigram-{shard}.key", key)
        save(f"{folder}/bigram-{shard}.n", np.minimum(count, 2**32 - 1).astype("<u4"))
        kinds = [(count == 1).astype("<u4"), (count == 2).astype("<u4"), (count > 2).astype("<u4")]
        out = []
        for what, (names, total, *counted) in (("context", _sums(context, count, *kinds)), ("word", _sums(word, count, np.ones(len(word), "<u4")))):
            to, *parts = _cuts(names, bits, names, total.astype("<i8"), np.stack(counted, 1).astype("<u4"))
            out.append(pd.DataFrame({"what": what, "shard": to, **dict(zip(("name", "total", "kinds"), parts, strict=True))}))
        frame = pd.concat(out, ignore_index=True)
        for r in range(1, 5):  # counts of counts travel with the first row
            frame[f"b{r}"] = 0
            frame.loc[0, f"b{r}"] = int((count == r).sum())
        return frame

    return build


def _sum_shard(folder: str):
    """Sums of a shard's contexts or words, written; words add to the totals."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        what, shard = pdf["what"].iloc[0], int(pdf["shard"].iloc[0])
        wide = 3 if what == "context" else 1
        kinds = _joined(pdf.kinds, "<u4").astype(np.int64).reshape(-1, wide)
        names, total, *counted = _sums(_joined(pdf.name, "<u8"), _joined(pdf.total, "<i8"), *kinds.T)
        save(f"{folder}/{what}-{shard}.key", names)
        save(f"{folder}/{what}-{shard}.n", total)
        row = {f"b{r}": int(pdf[f"b{r}"].sum()) for r in range(1, 5)}
        row |= {"vocabulary": 0, "tokens": 0, "contexts": 0, "more": 0} | {f"u{r}": 0 for r in range(1, 5)}
        if what == "context":
            save(f"{folder}/context-{shard}.kinds", np.ascontiguousarray(np.stack(counted, 1).astype("<i8")))
        else:
            (contexts,) = counted
            save(f"{folder}/word-{shard}.k", contexts)
            row |= {"vocabulary": len(names), "tokens": int(total.sum()), "contexts": int(contexts.sum()), "more": int((contexts > 2).sum())}
            row |= {f"u{r}": int((contexts == r).sum()) for r in range(1, 5)}
        return pd.DataFrame([row])

    return build


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), r) for r, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the totals that hold for all of them."""

    folder: str
    bits: int
    vocabulary: int
    tokens: int
    contexts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    rest: float  #: share of the unigram distribution that is spread evenly


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count and store the model of all rows of ``docs``."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    bits = shard_bits(spark)
    pairs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_partition(bits), "shard int, context binary, word binary, n binary")
    bs = ", ".join(f"b{r} long" for r in range(1, 5))
    partial = pairs.groupBy("shard").applyInPandas(_bigram_shard(folder, bits), f"what string, shard int, name binary, total binary, kinds binary, {bs}")
    names = ["vocabulary", "tokens", "contexts", "more", *[f"b{r}" for r in range(1, 5)], *[f"u{r}" for r in range(1, 5)]]
    totals = partial.groupBy("what", "shard").applyInPandas(_sum_shard(folder), ", ".join(f"{c} long" for c in names))
    t = {c: int(v or 0) for c, v in totals.agg(*[F.sum(c).alias(c) for c in names]).first().asDict().items()}
    word_d = discounts(*[t[f"u{r}"] for r in range(1, 5)])
    rest = (word_d[0] * t["u1"] + word_d[1] * t["u2"] + word_d[2] * t["more"]) / t["contexts"] if t["contexts"] else 1.0
    return Model(folder, bits, t["vocabulary"], t["tokens"], t["contexts"], discounts(*[t[f"b{r}"] for r in range(1, 5)]), word_d, rest)


class Arrays:
    """The mapped arrays of one kind, by shard."""

    KINDS = {"n": {"bigram": "<u4", "context": "<i8", "word": "<i8"}, "k": {"word": "<i8"}, "kinds": {"context": "<i8"}}

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def _map(self, name: str, shard: int, part: str, kind: str) -> np.ndarray:
        key = (name, shard, part)
        if key not in self.maps:
            path = f"{self.model.folder}/{name}-{shard}.{part}"
            whole = os.path.exists(path) and os.path.getsize(path)
            self.maps[key] = np.memmap(path, kind, "r") if whole else np.zeros(0, kind)
        return self.maps[key]

    def find(self, name: str, keys: np.ndarray, parts: tuple[str, ...]) -> list[np.ndarray]:
        """For each part, the values of the keys; absent keys give zero."""
        wide = {"kinds": 3}
        out = [np.zeros((len(keys), wide[p]) if p in wide else len(keys), np.int64) for p in parts]
        order, edges = _by_shard(keys, self.model.bits)
        for shard in np.flatnonzero(np.diff(edges)):
            mine = order[edges[shard] : edges[shard + 1]]
            own = self._map(name, int(shard), "key", "<u8")
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
            hit = own[at] == keys[mine]
            for o, p in zip(out, parts, strict=True):
                values = self._map(name, int(shard), p, self.KINDS[p][name])
                o[mine[hit]] = (values.reshape(-1, wide[p]) if p in wide else values)[at[hit]]
        return out


_OPEN: dict[str, Arrays] = {}


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


def token_scores(model: Model, arrays: Arrays, context: np.ndarray, word: np.ndarray):
    """log10 probability, base log10 probability and count of every token."""
    names, inverse = np.unique(word, return_inverse=True)
    n, k = (x[inverse] for x in arrays.find("word", names, ("n", "k")))
    base = np.log10((n + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
    single = model.rest / (model.vocabulary + 1) + (_discounted(k, model.word_discounts) / model.contexts if model.contexts else 0.0)
    names, inverse = np.unique(context, return_inverse=True)
    total, kinds = (x[inverse] for x in arrays.find("context", names, ("n", "kinds")))
    (pair,) = arrays.find("bigram", _pair(context, word, model.bits), ("n",))
    spread = kinds @ np.array(model.pair_discounts)
    p = np.where(total > 0, (_discounted(pair, model.pair_discounts) + spread * single) / np.maximum(total, 1), single)
    return np.log10(p), base, n


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        begins("counts")
        arrays = _OPEN.get(model.folder)
        if arrays is None:
            _OPEN.clear()
            arrays = _OPEN[model.folder] = Arrays(model)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                context, word, begin = tokens(data, offsets[i : j + 1])
                p, base, n = token_scores(model, arrays, context, word)
                size = np.diff(begin)
                total = np.add.reduceat(p, begin[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(np.add.reduceat((n > 0).astype(np.int64), begin[:-1]), pa.int64()),
                        pa.array(np.full(j - i, model.tokens), pa.int64()), pa.array(np.add.reduceat(base, begin[:-1])), pa.array(total), pa.array(10.0 ** np.minimum(-total / size, 300)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    longs, doubles = ("n_tokens", "n_known", "train_tokens"), ("base_score", "score", "perplexity")
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.DoubleType()) for c in doubles]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
