"""Spelling variants of words by permuterm rotations.

Every word is marked with a terminator and rotated.  The rotation that begins
behind a code point ends with it; without that last code point it is a prefix,
``rest$start``, that all words with any one code point in the same place share,
and that is itself a rotation of the word without it.  So replacements, insertions
and deletions are the rows that sort together under one prefix, and a group holds
at most one word for each code point of the alphabet, and one more: however
frequent a word is, no group grows with the input.  Groups are scanned in their
sorted order; each member learns how many others there are and the most frequent.

A code point within a run of equal ones can be deleted in several places with one
result; only the run's first place counts, so no pair of words meets twice.

Written out, the rotations of a word take the square of its length, so gaps in
words of more than ``WRITTEN`` code points are keyed by 128-bit fingerprints of
their prefixes in place of the prefixes.

Cases: a null or empty text has no run; a null id is written as nothing before the
colon; repeated rows count as often as they stand; ties of occurrences go to the
smallest word in code-point order; a text or word of any length is whole; an empty
table gives an empty result.  Only the id and the text are read, so no other
column can clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.kit import begins, mix64
from plumbline.storage import written

MARK = "$"
WRITTEN = 256
HELD_WORDS = 400_000
LEAST_LENGTH, LEAST_COUNT, FREQUENT = 5, 3, 2

#: Bytes of a run: letters in lower case, and the two bytes of U+00C0 to U+00FF; all others are white space.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))
_TAIL = bytes(range(0x80, 0xC0))


def _altered(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def count_runs(divisor: int, least_length: int):
    """Partial counts of the words of (id text, text) batches; a word that ``divisor`` chooses loses a code point."""

    def flush(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        begins("spelling")
        counts: dict[bytes, int] = {}
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32((name.as_py() or "").encode() + b":")
                for word, n in Counter(text.as_buffer().to_pybytes().translate(_KEPT).split()).items():
                    if 0x80 <= word[0] < 0xC0:  # what is left of a code point outside of runs
                        word = word.lstrip(_TAIL)
                        if not word:
                            continue
                    h = zlib.crc32(word, seed)
                    if h % divisor == 0:
                        word = _altered(word, h)
                    if len(word) >= least_length and len(word) - word.count(b"\xc3") >= least_length:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD_WORDS:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)

    return count


def counted_words(docs: DataFrame, divisor: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): all words of at least five code points with three occurrences or more."""
    pairs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    partial = pairs.mapInArrow(count_runs(divisor, LEAST_LENGTH), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _long_gaps(longest: int):
    """Rows of the gaps in (word, n) batches that are longer than ``longest``: one for each place, the rotation as a fingerprint."""

    def spread(batches):
        rng = np.random.Generator(np.random.PCG64(11))
        bases = rng.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)
        salts = rng.integers(1, 2**63, 2, dtype=np.uint64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = np.frombuffer(word.encode("utf-32-le"), "<u4")
                size = len(points)
                minus, full = [], []
                for base, salt in zip(bases, salts, strict=True):
                    back = np.uint64(pow(int(base), -1, 2**64))
                    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points.astype(np.uint64) + salt) * powers[:size])])
                    place = np.arange(size + 1, dtype=np.uint64) * salt
                    minus.append(mix64(mix64(sums[:-1] + (sums[-1] - sums[1:]) * back + np.uint64(size)) ^ place[:-1]))
                    full.append(mix64(mix64(sums[-1:] + np.uint64(size + 1)) ^ place))
                parts = [(full, np.full(size + 1, -1, np.int32), np.zeros(size + 1, bool))]
                if size > longest:
                    parts.append((minus, points.astype(np.int32), np.append(True, points[1:] != points[:-1])))
                name = hashlib.md5(word.encode()).hexdigest()
                for keys, gap, first in parts:
                    for i in range(0, len(gap), 10_000):
                        k = slice(i, i + 10_000)
                        m = len(gap[k])
                        key = np.stack([x[k] for x in keys], 1).astype("<u8").tobytes().hex()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key[32 * j : 32 * j + 32] for j in range(m)]), pa.array(gap[k]), pa.array(np.full(m, n, np.int64)), pa.array(first[k]), pa.array([name] * m)],
                            names=["key", "gap", "n", "first", "long"],
                        )

    return spread


def gaps(words: DataFrame) -> DataFrame:
    """Rotations under the prefixes that skip the edited code point.

    (key, gap, n, first, long): a word's code point ``gap`` in the place that ``key``
    leaves open, or -1 for the word that is ``key`` itself.  ``first``: the place is
    the first of its run.  ``long``: the md5 of the word, where the key does not give it.
    """
    rotation = "concat(substring(word, i + {skip}), '$', left(word, i - 1))"
    minus = f"transform(sequence(1, length(word)), i -> struct({rotation.format(skip=1)} AS key, ascii(substring(word, i, 1)) AS gap))"
    full = f"transform(sequence(1, length(word) + 1), i -> struct({rotation.format(skip=0)} AS key, -1 AS gap))"
    each = words.where(F.length("word") <= WRITTEN).select("n", F.expr(f"explode(concat({minus}, if(length(word) < {WRITTEN}, {full}, array())))").alias("g"))
    gap, before = F.col("g.gap"), F.right(F.substring_index("g.key", MARK, -1), F.lit(1))
    short = each.select("g.key", "g.gap", "n", ((gap >= 0) & (F.ascii(before) != gap)).alias("first"), F.lit(None).cast("string").alias("long"))
    long = words.where(F.length("word") >= WRITTEN).select("word", "n").mapInArrow(_long_gaps(WRITTEN), "key string, gap int, n long, first boolean, long string")
    return short.unionByName(long)


def _spelled(gap: str) -> Column:
    letter = F.when(F.col(gap) >= 0, F.char(F.col(gap))).otherwise("")
    return F.concat(F.substring_index("key", MARK, -1), letter, F.substring_index("key", MARK, 1))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the count of near words, and the most frequent as a struct of -n and the word."""
    order = Window.partitionBy("key").orderBy(F.desc("n"), "gap")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    minus, first, member = F.col("gap") >= 0, F.col("first"), F.struct("n", "gap", "long")
    scanned = gaps(words).select(
        "key", "gap", "n", "first", "long",
        F.count(F.when(minus, 1)).over(group).alias("others"),
        F.count(F.when(first, 1)).over(group).alias("firsts"),
        F.first(F.when(~minus, member), ignorenulls=True).over(group).alias("whole"),
        F.first(F.when(minus, member), ignorenulls=True).over(group).alias("top"),
        F.nth_value(F.when(minus, member), 2, ignoreNulls=True).over(group).alias("second"),
        F.first(F.when(first, member), ignorenulls=True).over(group).alias("top_first"),
    )
    whole = F.when(first, F.col("whole"))
    counted = scanned.select(
        "key", "gap", "long",
        F.when(minus, F.col("others") - 1 + F.when(whole.isNotNull(), 1).otherwise(0)).otherwise(F.col("firsts")).alias("n_near"),
        F.when(minus, F.when(F.col("top.gap") == F.col("gap"), F.col("second")).otherwise(F.col("top"))).otherwise(F.col("top_first")).alias("other"),
        F.when(minus, whole).alias("whole"),
    ).where("n_near > 0")
    offered = [F.when(F.col(x).isNotNull(), F.struct((-F.col(f"{x}.n")).alias("less"), _spelled(f"{x}.gap").alias("word"))) for x in ("other", "whole")]
    short = counted.where("long is null").select(_spelled("gap").alias("word"), "n_near", F.least(*offered).alias("best"))
    names = words.where(F.length("word") >= WRITTEN).select(F.md5("word").alias("id"), "word")
    each = counted.where("long is not null").select("long", F.posexplode(F.array_compact(F.array("other", "whole"))).alias("k", "c"), "n_near")
    told = each.join(names.select(F.col("id").alias("long"), "word"), "long").select("word", "k", "n_near", (-F.col("c.n")).alias("less"), F.col("c.long").alias("id"))
    long = told.join(names.withColumnRenamed("word", "best"), "id").select("word", F.when(F.col("k") == 0, F.col("n_near")).otherwise(0).alias("n_near"), F.struct("less", F.col("best").alias("word")).alias("best"))
    return short.unionByName(long).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``root`` beside (word, form): forms followed to the last, by pointers that jump twice as far each round.

    A form has at least twice the occurrences, so a chain ends after few steps.
    """
    far = written(forms.select("word", "form", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = far.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root <> next")
        if step.join(far.where("root <> word").select("root").distinct(), "root", "left_semi").isEmpty():
            return far
        far = written(far.join(step, "root", "left").select("word", "form", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, divisor: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the texts.

    ``divisor`` chooses the occurrences that lose a code point: those whose crc32
    of ``<id>:<run>`` it divides.
    """
    words = written(counted_words(docs, divisor, id_col, text_col), "words")
    near = neighbours(words)
    ample = -F.col("best.less") >= FREQUENT * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ample, F.col("best.word")).alias("form"), F.when(ample, -F.col("best.less")).alias("form_n")
    )
    told = written(told, "forms")
    rooted = with_roots(told.select("word", "form"))
    return told.join(rooted.select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")
