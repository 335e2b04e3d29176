"""Sparse suffix arrays: passages that repeat across documents.

1. In every window of ``LEAST - GRAM + 1`` word positions, the one whose
   ``GRAM``-word hash is smallest is selected, so any passage of ``LEAST`` words
   holds a selected position with its n-gram inside.  Only suffixes that begin
   there are kept.
2. The hashes of n-grams that stand in more than one document are stored as
   sorted arrays in the shared folder.  A second scan selects the same positions,
   asks the arrays, and drops the suffixes whose n-gram is in one document alone.
3. Suffixes carry the hashes of the ``LEAST - GRAM`` words after the n-gram and of
   those before it, which is as far as a passage of ``LEAST`` words around it can
   reach.  They are sorted by n-gram and by the words that follow, so that suffixes
   of one n-gram are neighbours, and within a task once more by the words before.
   Two suffixes share as many words as the least number that any two neighbours
   between them share; so the neighbours' matches tell, for every length to the
   right, which suffixes agree that far, and to the left which agree in the rest of
   ``LEAST`` words.  Those of both are extended both ways to a span, without pairs.
4. N-grams that begin more than ``SORTED_ROWS`` suffixes are no task's group.  They are
   settled by windows: all ``LEAST``-word windows around their positions are hashed
   (of a slice of texts the least and the greatest document of each window stand for
   all), and those in more than one document are stored as arrays that a last scan
   asks.  So a frequent passage is only counted.
5. Spans that overlap or touch are merged for each document.

N-grams, windows and carried words are equal by 64-bit hashes.  Nothing is missed:
a passage of ``LEAST`` words in two documents has a selected position in it, at the
same place of the passage in both, whose n-gram has either a sorted group with both
suffixes in it, or windows, one of which is the passage.

Cases: null, empty and short texts have no suffix and no span; they do not appear
in the result.  A passage that repeats only within one document gives none.  Rows
with a null id are left out.  Rows of the same id count as one document.  Of equal
hashes in a window of positions the last is selected, in any document.  A very
long text has as many suffixes as it has selected positions; a span longer than
the carried words is the union of the spans of its positions.  Only the id and
the text are read, so no other column can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, mix64, row_slices, utf8, windows, words
from plumbline.llm.shared_files import HashSet, shard_bits, shared_folder
from plumbline.storage import written

LEAST = 50
GRAM = 20
SORTED_ROWS = 2048  #: suffixes of one n-gram that a task sorts, about 1 MB; an n-gram with more is settled by windows
CARRIED_ROWS = 8192  #: suffixes in a batch with their words


def minimisers(hashes: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Positions (into ``hashes``) of the least value in any ``width`` consecutive ones of a row.

    Of equal values the last counts; a row of fewer values selects its least.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    last = begin[1:][row] - 1
    # Doubling: the place of the least value among the next 2 ** step ones.
    best, span = np.arange(n), 1
    while span < width:
        step = min(span, width - span)
        other = best[np.minimum(np.arange(n) + step, last)]
        best = np.where(hashes[other] <= hashes[best], other, best)
        span += step
    starts = np.arange(n) + width - 1 <= last
    starts[begin[:-1][np.diff(begin) > 0]] = True
    return np.unique(best[starts])


def _selected(data: np.ndarray, offsets: np.ndarray, least: int, gram: int):
    """Words of some rows and their suffixes: (word hashes, first, row, word, n-gram hash)."""
    _, _, hashes, first = words(data, offsets)
    grams, at, begin = windows(hashes, first, gram)
    chosen = minimisers(grams, begin, least - gram + 1)
    row = np.searchsorted(begin, chosen, side="right") - 1
    return hashes, first, row, at[chosen], grams[chosen]


def suffixes(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, at, h: every selected position and the hash of its n-gram."""
    kind = docs.schema[id_col].dataType

    def select(batches):
        begins("suffixes")
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                _, first, row, at, h = _selected(data, offsets[i : j + 1], least, gram)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array((at - first[:-1][row]).astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "at", "h"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType())])
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(select, schema)


def _windows_of(data: np.ndarray, offsets: np.ndarray, least: int, gram: int, frequent: HashSet):
    """(row, start, hash) of the ``least``-word windows around selected positions whose n-gram is in ``frequent``."""
    hashes, first, row, at, h = _selected(data, offsets, least, gram)
    keep = frequent.contains(h)
    row, at = row[keep], at[keep]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.maximum(at - (least - gram), first[:-1][row]), 1)
    np.add.at(change, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(change) > 0)
    row = np.searchsorted(first, starts, side="right") - 1
    whole = starts + least <= first[1:][row]
    row, starts = row[whole], starts[whole]
    out = np.zeros(len(starts), np.uint64)
    for k in range(least if len(starts) else 0):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + k] + np.uint64(k + 1))
    return row, starts - first[:-1][row], out


def _least_and_greatest(doc: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): of the rows with one hash, that of the least document number and that of the greatest."""
    order = np.lexsort((doc, h))
    doc, row, h = doc[order], row[order], h[order]
    change = h[1:] != h[:-1]
    first, last = np.flatnonzero(np.append(True, change)[: len(h)]), np.flatnonzero(np.append(change, True)[: len(h)])
    kept = np.concatenate([first, last[doc[last] != doc[first]]])
    return row[kept], h[kept]


def _window_spans(rows: DataFrame, frequent: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, low, high, other_id): spans of the windows around frequent n-grams that several documents hold."""
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType
    folder, shared_at, bits = shared_folder(spark, "frequent"), shared_folder(spark, "windows"), shard_bits(spark)
    HashSet.write(frequent, folder, bits)

    def spell(batches):
        wanted = HashSet(folder, bits)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                row, _, h = _windows_of(data, offsets[i : j + 1], least, gram, wanted)
                doc = batch.column(0).slice(i, j - i)
                row, h = _least_and_greatest(np.unique(doc.to_numpy(zero_copy_only=False), return_inverse=True)[1][row], row, h)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(h.view(np.int64))], names=["doc_id", "h"])

    spelled = rows.mapInArrow(spell, T.StructType([T.StructField("doc_id", kind), T.StructField("h", T.LongType())]))
    shared = written(spelled.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b"), "windows")
    HashSet.write(shared.select("h"), shared_at, bits)

    def join(batches):
        wanted, common = HashSet(folder, bits), HashSet(shared_at, bits)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                row, start, h = _windows_of(data, offsets[i : j + 1], least, gram, wanted)
                keep = common.contains(h)
                row, start, h = row[keep], start[keep], h[keep]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
                head = np.flatnonzero(fresh)
                tail = np.append(head[1:], len(row))[: len(head)] - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(row[head])), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + least).astype(np.int32)), pa.array(h[head].view(np.int64))],
                    names=["doc_id", "low", "high", "h"],
                )

    fields = [T.StructField("doc_id", kind), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("h", T.LongType())]
    spans = rows.mapInArrow(join, T.StructType(fields)).join(shared, "h")
    return spans.select("doc_id", "low", "high", F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other_id"))


def _contexts(least: int, gram: int, folder: str, bits: int):
    """Suffixes whose n-gram is in the set, with the words around it: as many as there are, and their hashes."""
    side = least - gram
    reach = np.arange(side)

    def carry(batches):
        begins("suffixes")
        shared = HashSet.opened(folder, bits)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                hashes, first, row, at, h = _selected(data, offsets[i : j + 1], least, gram)
                keep = np.flatnonzero(shared.contains(h))
                for k in range(0, len(keep), CARRIED_ROWS):
                    part = keep[k : k + CARRIED_ROWS]
                    r, p = row[part], at[part]
                    before, after = np.minimum(p - first[:-1][r], side), np.minimum(first[1:][r] - p - gram, side)
                    left, right = (hashes[np.clip(x, 0, len(hashes) - 1)] for x in ((p - 1)[:, None] - reach, (p + gram)[:, None] + reach))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, j - i).take(pa.array(r)), pa.array(h[part].view(np.int64)), pa.array((p - first[:-1][r]).astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)),
                            _fixed(left), _fixed(right),
                        ],
                        names=["doc_id", "h", "at", "before", "after", "left", "right"],
                    )

    return carry


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _agreeing(values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each row and each number of words k, a number of the rows with its n-gram and its first k words; rows are sorted."""
    differs = values[1:] != values[:-1]
    common = np.where(differs.any(1), differs.argmax(1), values.shape[1])
    common[h[1:] != h[:-1]] = -1
    out = np.zeros((len(h), values.shape[1] + 1), np.int64)
    out[1:] = np.cumsum(common[:, None] < np.arange(values.shape[1] + 1), axis=0)
    return out


def _others(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the least document number of its group that is not its own, or -1."""
    order = np.lexsort((doc, group))
    g, d = group[order], doc[order]
    head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(head, len(g)))
    least = np.repeat(d[head], size)
    none = np.iinfo(np.int64).max
    second = np.repeat(np.minimum.reduceat(np.where(d == least, none, d), head), size)
    out = np.empty(len(g), np.int64)
    out[order] = np.where(d == least, np.where(second == none, -1, second), least)
    return out


def _compared(rows: pa.Table, least: int, gram: int) -> pa.RecordBatch:
    """A span for each row that shares ``least`` words with one of its n-gram in another document; rows are sorted by n-gram and ``right``."""
    column = lambda c: rows.column(c).combine_chunks()
    doc, h, at, before, after = column("doc_id"), *(column(c).to_numpy() for c in ("h", "at", "before", "after"))
    side, n = least - gram, len(h)
    left, right = (np.frombuffer(b"".join(column(c).to_pylist()), np.int64).reshape(n, side) for c in ("left", "right"))
    follows = _agreeing(right, h)
    keyed = np.ascontiguousarray(np.concatenate([h[:, None], left], axis=1))
    by_left = np.argsort(keyed.view(np.dtype((np.void, keyed.shape[1] * 8))).reshape(-1), kind="stable")
    precedes = np.empty_like(follows)
    precedes[by_left] = _agreeing(left[by_left], h[by_left])
    _, named, code = np.unique(doc.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    most_left, most_right, other = np.full(n, -1), np.full(n, -1), np.full(n, len(named))
    for k in range(side + 1):
        full = np.flatnonzero((after >= k) & (before >= side - k))
        if len(full):
            met = _others(follows[full, k] * n + precedes[full, side - k], code[full])
            full, met = full[met >= 0], met[met >= 0]
            most_right[full] = k
            most_left[full] = np.maximum(most_left[full], side - k)
            other[full] = np.minimum(other[full], met)
    own = np.flatnonzero(most_right >= 0)
    low, high = at[own] - most_left[own], at[own] + gram + most_right[own]
    return pa.RecordBatch.from_arrays([doc.take(pa.array(own)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), doc.take(pa.array(named[other[own]]))], names=["doc_id", "low", "high", "other_id"])


def _compare(least: int, gram: int):
    """Spans from a partition sorted by n-gram; the last n-gram of a batch waits for the next batch."""

    def run(batches):
        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if waiting is not None:
                rows = pa.concat_tables([waiting, rows])
            if not rows.num_rows:
                continue
            h = rows.column("h").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            waiting = rows.slice(cut)
            if cut:
                yield _compared(rows.slice(0, cut), least, gram)
        if waiting is not None:
            yield _compared(waiting, least, gram)

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_id: each repeated passage of each document.

    ``other_id`` is the smallest id of a document found to share part of it.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    found = suffixes(docs, least, gram, id_col, text_col)
    shared = written(found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("h", "n"), "shared")
    folder, bits = shared_folder(spark, "suffixes"), shard_bits(spark)
    HashSet.write(shared.where(F.col("n") <= SORTED_ROWS).select("h"), folder, bits)
    ints, binaries = [T.StructField(c, T.IntegerType()) for c in ("at", "before", "after")], [T.StructField(c, T.BinaryType()) for c in ("left", "right")]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("h", T.LongType()), *ints, *binaries])
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    carried = rows.mapInArrow(_contexts(least, gram, folder, bits), schema)
    array = carried.repartition("h").sortWithinPartitions("h", "right", "left", "doc_id", "at")
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("other_id", kind)])
    spans = array.mapInArrow(_compare(least, gram), out)
    return merged(spans.union(_window_spans(rows, shared.where(F.col("n") > SORTED_ROWS).select("h"), least, gram)))


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document as one."""
    spans = spans.groupBy("doc_id", "low", "high").agg(F.min("other_id").alias("other_id"))
    by = Window.partitionBy("doc_id").orderBy("low", "high")
    fresh = F.coalesce(F.col("low") > F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = spans.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(by))
    return island.groupBy("doc_id", "island").agg(F.min("low").alias("start_word"), F.max("high").alias("end_word"), F.min("other_id").alias("other_id")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")
