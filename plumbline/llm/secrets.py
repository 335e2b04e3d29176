"""Secrets in texts: fixed patterns, and values of credential contexts by guess cost.

Patterns give the spans of kinds ``assign``, ``access`` and ``hex``.  Beside
them, every value that stands in a credential context (an assignment to such a
name with any characters, a bearer header, the password of an address) is costed:
the least number of guesses, as a power of ten, over all segmentations into words,
dates, repeats, keyboard walks and brute-force spans.  A value that needs
``GUESSES`` or more is a span of kind ``guess``, unless a pattern's span covers it.

Words cost by their rank among all words of all texts, counted in Spark with the
costed values and patterns' spans left out, so that a secret is never its own
dictionary entry.  The counts are stored as sorted hash arrays, which workers map
into memory and ask for every substring of a value at once.  A word that shares
its 64-bit hash with another one would be taken for it.

A cost adds up over segments, so one pass over a value finds it; a segment is at
most ``LONGEST`` characters but for brute force and repeats, so time is linear in the
value, whatever its length.

Cases: a null or empty text has no span; repeated rows and null ids are rows as any
other; equal costs give the same span whichever segmentation has them; a text of any
length is scanned as a whole; an empty table gives an empty result; only the id and
the text are read, so no other column can clash.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, holds, row_slices, utf8, words
from plumbline.llm.shared_files import HashCounts, shard_bits, shared_folder

# Fixed patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Names that a credential is assigned to; words may stand around them, joined by - or _.
NAMES = r"(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|encryption|signing)[_-]?key|auth|authorization|credentials?)(?:[_-][A-Za-z0-9]{1,32}){0,4}"
CONTEXTS = (
    re.compile(rf"""{NAMES}["']?\x20*(?:=>|:=|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))""", re.IGNORECASE | re.ASCII),
    re.compile(r"(?<![A-Za-z0-9])bearer\x20+([A-Za-z0-9+/_.=~-]+)", re.IGNORECASE | re.ASCII),
    re.compile(r"://[^\s:/@\"']+:([^\s@/\"']+)@", re.ASCII),
    re.compile(r"(?<![A-Za-z0-9])--pass(?:word|wd|phrase)?[=\x20]\x20*([^\s\"']+)", re.IGNORECASE | re.ASCII),
)
#: Addresses, variables to be filled in, and calls or look-ups of a program hold no secret themselves.
NO_VALUE = re.compile(r"[$<{%]|[A-Za-z][A-Za-z0-9+.-]*://|[A-Za-z_][A-Za-z0-9_.]*[(\[]", re.ASCII)
#: A text without any of these, in lower case, has no credential context.
HINTS = tuple(x.encode() for x in ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "://"))

GUESSES = 10.0  #: power of ten
SHORTEST, LONGEST = 6, 32
FLUSH_WORDS = 2_000_000
SEGMENT = math.log10(5)  #: which of the five kinds a segment is
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LOOKALIKES = str.maketrans("@4013$57!", "aaolessti")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

_LETTER = np.ones(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = False


def _keyboard() -> dict[str, set[str]]:
    at = {c: (y, x) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    spots = {v: k for k, v in at.items()}
    near = {c: {spots[p] for p in ((y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)) if p in spots} for c, (y, x) in at.items()}
    for a, b in zip(ALPHABET, ALPHABET[1:], strict=False):
        near[a].add(b)
        near[b].add(a)
    return near


NEAR_KEYS = _keyboard()
_DAY, _MONTH, _YEAR = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:(?:19|20)\d\d|\d\d)"
DATES = (
    (re.compile(rf"{_DAY}([-/._ ]?){_MONTH}\1{_YEAR}"), math.log10(366 * 120 * 4)),
    (re.compile(rf"{_MONTH}([-/._ ]?){_DAY}\1{_YEAR}"), math.log10(366 * 120 * 4)),
    (re.compile(rf"{_YEAR}([-/._ ]?){_MONTH}\1{_DAY}"), math.log10(366 * 120 * 4)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(120)),
)


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns, in order."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def values(text: str) -> list[tuple[int, int]]:
    """Places of the values of credential contexts, each once."""
    found = set()
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            k = next(k for k in range(1, pattern.groups + 1) if m[k] is not None)
            start, end = m.span(k)
            if m.lastindex == 3 or pattern is not CONTEXTS[0]:  # not in quotes: what closes a sentence or a list is no part
                while end > start and text[end - 1] in ".,;:!?)]}>":
                    end -= 1
            if end - start >= SHORTEST and not NO_VALUE.match(text, start, end):
                found.add((start, end))
    return sorted(found)


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else math.log10(200)


def _casing(word: str) -> float:
    """Guesses for which letters are capitals: none, the first, all, or any."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return math.log10(2)
    return math.log10(max(2, sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1))))


def _row_step(keys: str, k: int) -> bool:
    """Two steps in one direction, along a row of keys or the alphabet."""
    three = keys[k - 1 : k + 2]
    return any(three in row or three[::-1] in row for row in (*KEY_ROWS, ALPHABET))


def segments(value: str, ranks: dict[tuple[int, int], float] | None = None) -> dict[tuple[int, int], float]:
    """(start, end) -> log10 guesses of every segment of ``value`` that is a word, a date, a walk or a repeat.

    ``ranks``: log10 rank of the substrings that are words, look-alikes replaced.
    A repeat costs its unit, by brute force or as a word or date, times how often.
    """
    n = len(value)
    found: dict[tuple[int, int], float] = {}

    def offer(start: int, end: int, cost: float) -> None:
        found[start, end] = min(cost, found.get((start, end), math.inf))

    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LOOKALIKES)
    for (start, end), rank in (ranks or {}).items():
        offer(start, end, rank + _casing(value[start:end]) + (math.log10(2) if plain[start:end] != lower[start:end] else 0.0))
    for pattern, cost in DATES:
        for start in range(n):
            if "0" <= value[start] <= "9" and (m := pattern.match(value, start)):
                offer(start, m.end(), cost)
    units = dict(found)
    keys = lower.translate(SHIFTED)
    for start in range(n - 2):
        end, cost = start + 1, math.log10(len(NEAR_KEYS))
        while end < min(n, start + LONGEST) and keys[end] in NEAR_KEYS.get(keys[end - 1], ()):
            if end - start > 1 and not _row_step(keys, end - 1):
                cost += math.log10(5)  # a turn
            end += 1
            if end - start > 2:
                offer(start, end, cost + math.log10(end - start))
    brute = np.concatenate([[0.0], np.cumsum([_brute(c) for c in value])])
    for period in range(1, min(LONGEST // 2, n // 2) + 1):
        same = 0  # how many characters from here on equal the one a period later
        for start in range(n - period - 1, -1, -1):
            same = same + 1 if value[start] == value[start + period] else 0
            times = same // period + 1
            if times * period > 2 and times > 1:
                unit = min(brute[start + period] - brute[start], units.get((start, start + period), math.inf))
                offer(start, start + times * period, float(unit) + math.log10(times))
    return found


def guess_cost(value: str, ranks: dict[tuple[int, int], float] | None = None) -> float:
    """log10 of the guesses that ``value`` needs at the least, over all segmentations."""
    n = len(value)
    starts: dict[int, list[tuple[int, float]]] = {}
    for (start, end), cost in segments(value, ranks).items():
        starts.setdefault(start, []).append((end, cost))
    best = [0.0] + [math.inf] * n
    brute = math.inf  # the best whose last segment is a brute-force span
    for k in range(n):
        brute = min(brute, best[k] + SEGMENT) + _brute(value[k])
        best[k + 1] = min(best[k + 1], brute)
        for end, cost in starts.get(k, ()):
            best[end] = min(best[end], best[k] + SEGMENT + cost)
    return best[n]


@dataclass(frozen=True)
class Lexicon:
    """Where the counts of all words lie, and the rank of a count by its logarithm."""

    folder: str
    bits: int
    ranks: tuple[float, ...]  #: log10 of how many words have the count of a step, or more

    @staticmethod
    def step(n: np.ndarray) -> np.ndarray:
        return np.floor(4 * np.log2(np.maximum(n, 1))).astype(np.int64)

    def word_ranks(self, found: list[str]) -> list[dict[tuple[int, int], float]]:
        """For each value, the log10 rank of its substrings that are words of three letters or more."""
        counts = HashCounts.opened(self.folder, self.bits)
        places, parts = [], []
        for v, value in enumerate(found):
            lower = value.lower()
            plain = lower.translate(LOOKALIKES) if len(lower) == len(value) else value
            for m in re.finditer(r"[^\W\d_]{3,}", plain):
                for start in range(m.start(), m.end() - 2):
                    for end in range(start + 3, min(m.end(), start + LONGEST) + 1):
                        places.append((v, start, end))
                        parts.append(plain[start:end])
        out: list[dict[tuple[int, int], float]] = [{} for _ in found]
        if parts:
            data, offsets = utf8(pa.array(parts))
            starts, _, hashes, first = words(data, offsets, fold=True, outside=_LETTER)
            one = np.flatnonzero(np.diff(first) == 1)
            n = counts.find(hashes[first[one]])
            for k in np.flatnonzero(n):
                v, start, end = places[one[k]]
                out[v][start, end] = self.ranks[min(int(self.step(n[k])), len(self.ranks) - 1)]
        return out


def _hinted(raw: bytes) -> bool:
    lower = raw.lower()
    return any(h in lower for h in HINTS)


_HEX_BYTES = re.compile(rb"[0-9a-f]{24,}")


def _count_words(batches):
    """Partial counts of the words of texts, patterns' spans and the values of contexts left out."""
    begins("secrets")
    held, size = [], 0

    def reduced() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in row_slices(offsets):
            block, edges = data[offsets[i] : offsets[j]], np.asarray(offsets[i : j + 1]) - offsets[i]
            for r in range(j - i):
                raw = block[edges[r] : edges[r + 1]].tobytes()
                if _hinted(raw) or b"AKIA" in raw or _HEX_BYTES.search(raw):
                    text = raw.decode()
                    cut = [(a, b) for a, _, b in spans(text)] + values(text)
                    if cut:
                        block = block.copy() if not block.flags.writeable else block
                        for a, b in cut:
                            at = edges[r] + len(text[:a].encode())
                            block[at : at + len(text[a:b].encode())] = 32
            held.append(words(block, edges, fold=True, outside=_LETTER)[2])
            size += len(held[-1])
            if size >= FLUSH_WORDS:
                yield reduced()
                held, size = [], 0
    if size:
        yield reduced()


def lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """Count all words of all texts and store the counts."""
    spark = docs.sparkSession
    folder, bits = shared_folder(spark, "lexicon"), shard_bits(spark)
    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "h long, n long")
    HashCounts.write(partial.groupBy("h").agg(F.sum("n").alias("n")), folder, bits)
    steps = np.zeros(Lexicon.step(np.array([2**62]))[0] + 1)
    for row in HashCounts.histogram(spark, folder, bits, Lexicon.step).collect():  # at most as many rows as steps
        steps[row["step"]] = row["n"]
    above = np.cumsum(steps[::-1])[::-1]
    return Lexicon(folder, bits, tuple(float(x) for x in np.log10(np.maximum(above, 1))))


def find_secrets(docs: DataFrame, model: Lexicon, least: float = GUESSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (kind, start, end, guesses) of every row, in order of start and kind.

    Places are code points, the end exclusive; ``guesses`` is null but for values judged by cost.
    """
    kind = docs.schema[id_col].dataType
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())])

    def judged(text: str) -> list[dict]:
        base = spans(text)
        out = [{"kind": k, "start": a, "end": b, "guesses": None} for a, k, b in base]
        open_to, at, free = 0, 0, []
        for a, b in values(text):  # both are sorted by start
            while at < len(base) and base[at][0] <= a:
                open_to = max(open_to, base[at][2])
                at += 1
            if b > open_to:
                free.append((a, b))
        for (a, b), ranks in zip(free, model.word_ranks([text[a:b] for a, b in free]), strict=True):
            cost = guess_cost(text[a:b], ranks)
            if cost >= least:
                out.append({"kind": "guess", "start": a, "end": b, "guesses": cost})
        return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))

    def run(batches):
        begins("secrets")
        holds("secrets", HashCounts.close)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = []
            for r in range(len(offsets) - 1):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                suspect = _hinted(raw) or b"AKIA" in raw or _HEX_BYTES.search(raw)
                found.append(judged(raw.decode()) if suspect else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(struct))], names=["doc_id", "found"])

    inner = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("guesses", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("found", T.ArrayType(inner))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the kinds, a digest of the patterns' spans, and all spans as text."""

    def listed(spans_: str) -> Column:
        return F.expr(f"array_join(transform({spans_}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    counts = [F.expr(f"size(filter(found, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(listed("filter(found, s -> s.kind <> 'guess')"), 256)
    return found.select("doc_id", *counts[:3], base.alias("base_sha256"), listed("found").alias("spans"), counts[3])
