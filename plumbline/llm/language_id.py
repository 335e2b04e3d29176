"""Language ID: each document as a mixture of languages.

A word's likelihood under a language is the product over its byte trigrams
(A-Z and the Latin-1 capitals in lower case, everything that is no letter as a
gap), from counts hashed to ``BUCKETS``.  For each document, expectation
maximisation estimates the proportions of the languages over its words, and
backward elimination from all languages keeps the set of the best penalised
likelihood: log likelihood - PENALTY * (languages in the set) * log(words + 1).
Languages go together where the likelihood that their words' posteriors can
lose is less than their penalties, which lowers the cost for certain; else the
weakest goes alone.

The model is languages x BUCKETS counts (at most ``MOST_LANGUAGES``; more is an
error), so it is small enough for every task whatever the corpus.

Cases: a text that is null, empty or without a letter is ``und`` with score 0.
Rows with a null lang or text are not learned from.  A tie between languages
goes to the first by name.  Repeated rows get equal results; rows with a null id
are judged as any other.  An empty learning set makes every row ``und``, and
``determined`` leaves every row.  A text of any length is judged as a whole.
Extra columns are not read, so none can clash; ``determined`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, row_slices, utf8

BUCKETS = 1 << 16
MOST_LANGUAGES = 128
SMOOTHING = 0.5
PENALTY = 2.0
EM_STEPS = 5
UNDETERMINED = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)


def _letters(data: np.ndarray) -> np.ndarray:
    """Folded bytes between two gaps."""
    out = np.full(len(data) + 2, 0x20, np.uint8)
    body = _LETTER[data]
    if len(data) > 1:  # U+00C0 to U+00DE, which UTF-8 writes as C3 80 to C3 9E
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        body[1:][capital] += 0x20
    out[1:-1] = body
    return out


def _trigrams(body: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte between the two gaps."""
    wide = body.astype(np.uint32)
    mixed = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA77)) ^ (wide[2:] * np.uint32(0xC2B2AE3D))
    return (mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a gap between rows, and the new offsets."""
    n = len(offsets) - 1
    new = offsets - offsets[0] + np.arange(n + 1)
    out = np.full(int(new[-1]), 0x20, np.uint8)
    at = np.ones(len(out), bool)
    at[new[1:] - 1] = False
    out[at] = data[offsets[0] : offsets[-1]]
    return out, new


def _count(batches):
    begins("language")
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), object)
        for i, j in row_slices(offsets):
            body, new = _joined(data, offsets[i : j + 1])
            grams = _trigrams(_letters(body))
            inside = _LETTER[body] != 0x20
            row = np.repeat(np.arange(j - i), np.diff(new))
            for lang in set(langs[i:j]):
                mine = inside & (langs[i:j] == lang)[row]
                seen[lang] = seen.get(lang, 0) + np.bincount(grams[mine], minlength=BUCKETS)
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


class MixtureModel:
    """Log likelihoods of trigram buckets under each language."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table  # table: languages x BUCKETS, float32

    def __len__(self) -> int:
        return len(self.langs)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """The model from all rows of ``docs`` that have a text and a language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = [r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names.sort()
    table = np.full((len(names), BUCKETS), SMOOTHING)
    got = counts.toPandas()
    if len(got):
        table[np.searchsorted(names, got.lang.to_numpy(str)), got.bucket.to_numpy()] += got.n.to_numpy()
    return MixtureModel(names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if names else table)


def _em(p: np.ndarray, first: np.ndarray, row: np.ndarray, allowed: np.ndarray, steps: int):
    """Proportions of the allowed languages in each row, the rows' log likelihoods, and the words' posteriors."""
    n = np.maximum(np.diff(first), 1)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for step in range(steps + 1):
        weighted = p * share[row].astype(np.float32)
        total = weighted.sum(1)
        np.divide(weighted, total[:, None], out=weighted)
        if step < steps:
            share = np.add.reduceat(weighted, first[:-1], axis=0, dtype=np.float64) / n
    return share, np.add.reduceat(np.log(total), first[:-1], dtype=np.float64), weighted


def _leaving(share: np.ndarray, posterior: np.ndarray, first: np.ndarray, row: np.ndarray, allowed: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Which of the allowed languages each row does without next; rows of one language lose none.

    Without the languages of a set, a word keeps at least the share of its
    likelihood that its posterior gives the others.
    """
    lost = lambda taken: np.add.reduceat(-np.log1p(-np.minimum(taken, 1 - 1e-6)), first[:-1], axis=0, dtype=np.float64)
    idle = allowed & (lost(posterior) < penalty[:, None] / 2)
    idle[np.arange(len(idle)), share.argmax(1)] = False
    sure = idle.any(1) & (lost((posterior * idle[row]).sum(1)) <= idle.sum(1) * penalty)
    weakest = np.zeros_like(allowed)
    weakest[np.arange(len(idle)), np.argmin(np.where(allowed, share, np.inf), axis=1)] = True
    return np.where(sure[:, None], idle, weakest) & (allowed.sum(1) > 1)[:, None]


def _mixtures(model: MixtureModel, data: np.ndarray, offsets: np.ndarray):
    """Proportions (rows x languages) of every row; rows without a word stay zero."""
    body, new = _joined(data, offsets)
    inside = _LETTER[body] != 0x20
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    shares = np.zeros((len(new) - 1, len(model)))
    if not len(starts):
        return shares
    grams = _trigrams(_letters(body))
    ll = np.empty((len(starts), len(model)), np.float32)
    for k in range(len(model)):
        sums = np.concatenate([[0.0], np.cumsum(model.table[k][grams], dtype=np.float64)])
        ll[:, k] = sums[ends] - sums[starts]
    ll -= ll.max(1, keepdims=True)
    p = np.exp(np.maximum(ll, -60))
    bounds = np.searchsorted(starts, new)
    full = np.flatnonzero(np.diff(bounds))
    first = np.append(bounds[:-1][full], len(starts))
    row = np.repeat(np.arange(len(full)), np.diff(first))
    penalty = PENALTY * np.log(np.diff(first) + 1.0)
    best, least = np.zeros((len(full), len(model))), np.full(len(full), np.inf)
    open_rows, allowed = np.arange(len(full)), np.ones((len(full), len(model)), bool)
    while len(open_rows):
        share, loglik, posterior = _em(p, first, row, allowed, EM_STEPS if len(model) > 1 else 0)
        cost = allowed.sum(1) * penalty[open_rows] - loglik
        better = cost < least[open_rows]
        best[open_rows[better]], least[open_rows[better]] = share[better], cost[better]
        stay = allowed.sum(1) > 1  # a row of one language is settled
        allowed &= ~_leaving(share, posterior, first, row, allowed, penalty[open_rows])
        if not stay.all():
            keep = stay[row]
            p, sizes = p[keep], np.diff(first)[stay]
            open_rows, allowed = open_rows[stay], allowed[stay]
            first = np.concatenate([[0], np.cumsum(sizes)])
            row = np.repeat(np.arange(len(open_rows)), sizes)
    shares[full] = best
    return shares


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _judged(own: MixtureModel, texts: pa.Array) -> tuple[list, list, list]:
    """Language, score and shares of every text of one batch."""
    langs = np.array(own.langs, object)
    data, offsets = utf8(texts)
    pred, score, mixed = [], [], []
    for i, j in row_slices(offsets):
        shares = _mixtures(own, data, offsets[i : j + 1]) if len(own) else np.zeros((j - i, 1))
        top = shares.argmax(1)
        part = data[offsets[i] : offsets[j]]
        letter = np.concatenate([[0], np.cumsum(((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A))])
        ascii_letters = letter[offsets[i + 1 : j + 1] - offsets[i]] - letter[offsets[i:j] - offsets[i]]
        for r in range(j - i):
            if len(own) and shares[r, top[r]] > 0 and (ascii_letters[r] or _has_letter(texts[i + r].as_py())):
                pred.append(langs[top[r]])
                score.append(min(1.0, float(shares[r, top[r]])))
                mixed.append([(langs[k], float(shares[r, k])) for k in np.flatnonzero(shares[r] > 0)])
            else:
                pred.append(UNDETERMINED)
                score.append(0.0)
                mixed.append([])
    return pred, score, mixed


def identify(docs: DataFrame, model: MixtureModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's share), and the set as a map lang -> share."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        begins("language")
        for batch in batches:
            pred, score, mixed = _judged(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "shares"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, schema)


def determined(docs: DataFrame, model: MixtureModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told, all columns as they are; nothing is shuffled."""
    if not len(model):
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches):
        begins("language")
        for batch in batches:
            pred, _, _ = _judged(shared.value, batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array([p != UNDETERMINED for p in pred], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
