"""Exact ranked lexical search: a ball tree over each block of sparse documents.

A document's score for an item is the sum over the item's terms of the term's
weight times its saturated frequency, all in integers.  That is an inner product of
two non-negative vectors, with the root of the weight on either side, so that a
document and an item that share rare terms point the same way.

One scan of the texts keeps, of each document, its length and the frequencies of
terms that any item has; counts of documents and terms come from these rows.  Then
each task cuts its documents into blocks, builds a balanced tree of balls over a
block (two far documents are the poles of a split at the median) and goes through
the items: the product with a node's centroid, plus the node's radius times the
item's length, bounds all scores below it.  One radius over all terms bounds next to
nothing in sparse text, as every document lies far from every centroid by terms that
the item does not have.  So the terms are dealt to ``SUBSPACES``, the frequent ones
alone, and a ball has a radius in each; and as an item's coordinates are not negative,
only what exceeds the centroid counts as distance.  Subtrees are opened best first
until the best bound is under the item's last kept score.  Bounds are widened by far more
than doubles can lose and compared with whole scores, and leaves are scored in 64-bit
integers, so the result is exact.  An item's kept scores pass from block to block,
so later blocks are mostly pruned; a task returns ``k`` rows an item.

Items are written in blocks of bounded text to the shared folder and mapped by the
tasks; a pass over the short rows serves ``ITEM_BLOCKS`` of them.  A tree has fewer
leaves where its terms are many, so a block's centroids stay within ``MOST_CELLS``
numbers.

Cases: a null or empty text has no term, so it is not counted and never found; an
item without terms has no rows; repeated rows are ranked each, and a repeated item
has its own ranks; a null doc_id comes after all ids of equal score; equal scores go
by ascending doc_id; texts of any length are whole; empty tables give an empty
result; only ids and texts are read, so no other column can clash.  Terms are known
by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.kit import begins, row_slices, unique_in_rows, utf8, words
from plumbline.llm.shared_files import HashCounts, HashSet, save, shard_bits, shared_folder
from plumbline.storage import written

ITEM_BYTES, ITEM_BLOCKS = 1 << 17, 16
BLOCK_ROWS, BLOCK_ENTRIES, LEAF_ROWS, MOST_CELLS, SUBSPACES = 8192, 1 << 19, 16, 1 << 22, 2048
SLACK = 1e-9

#: Bytes outside of terms: ASCII but for digits and letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    OUTSIDE[_low:_high] = False


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all terms, and where each row's begin."""
    _, _, hashes, first = words(data, offsets, fold=True, outside=OUTSIDE)
    return hashes, first


def _write_items(folder: str):
    """Blocks of items as files: ids, which of them are null, and the distinct terms of each."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets, ITEM_BYTES):
                terms, begin = unique_in_rows(*_terms(data, offsets[i : j + 1]))
                name, ids = uuid.uuid4().hex, batch.column(0).slice(i, j - i)
                save(f"{folder}/{name}.id", ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                save(f"{folder}/{name}.null", np.asarray(ids.is_null()).astype("u1"))
                save(f"{folder}/{name}.term", terms)
                save(f"{folder}/{name}.begin", begin.astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return run


def _distinct_terms(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in row_slices(offsets):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_terms(data, offsets[i : j + 1])[0]).view(np.int64))], names=["h"])


def _short_rows(folder: str, bits: int):
    """doc_id, number of terms, and the hashes and frequencies of those that items have."""

    def run(batches):
        begins("lexical")
        wanted = HashSet(folder, bits)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                hashes, first = _terms(data, offsets[i : j + 1])
                distinct, inverse = np.unique(hashes, return_inverse=True)
                kept = np.flatnonzero(wanted.contains(distinct)[inverse])
                row = np.searchsorted(first, kept, side="right") - 1
                order = np.lexsort((hashes[kept], row))
                row, term = row[order], hashes[kept][order]
                at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))) if len(row) else np.zeros(0, np.int64)
                tf = np.diff(np.append(at, len(row))).astype("<u4")
                term, edges = term[at].astype("<u8"), np.searchsorted(row[at], np.arange(j - i + 1))
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.array([term[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([tf[a:b].tobytes() for a, b in spans], pa.binary())],
                    names=["doc_id", "n", "term", "tf"],
                )

    return run


def _document_counts(batches):
    """Partial counts of the documents that hold each term."""
    for batch in batches:
        h, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """One block of items: their terms as columns, the columns' weights, and what is kept of each so far."""

    def __init__(self, folder: str, name: str, counts: HashCounts, n_docs: int):
        self.name = name
        self.ids, self.null = np.fromfile(f"{folder}/{name}.id", "<i8"), np.fromfile(f"{folder}/{name}.null", "u1")
        self.begin = np.fromfile(f"{folder}/{name}.begin", "<i8")
        self.columns, where = np.unique(np.fromfile(f"{folder}/{name}.term", "<u8"), return_inverse=True)
        self.weights = np.array([weight(n_docs, int(df)) for df in counts.find(self.columns)], np.int64)
        self.cells = where.astype(np.int64)
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in self.ids]

    def rows(self) -> pa.RecordBatch:
        found = [(p, -score, None if null else i) for p, kept in enumerate(self.kept) for score, null, i in kept]
        place = np.array([p for p, _, _ in found], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.name] * len(found), pa.string()), pa.array(place), pa.array(self.ids[place], pa.int64(), mask=self.null[place].astype(bool)),
                pa.array([i for _, _, i in found], pa.int64()), pa.array([s for _, s, _ in found], pa.int64()),
            ],
            names=["block", "place", "item_id", "doc_id", "score"],
        )


class Balls:
    """A balanced tree of balls over the rows of a sparse matrix; level ``l`` has 2 ** l nodes.

    ``space``: the subspace of each column.  A radius is the most that a row of the
    node exceeds the centroid by, within one subspace.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n_rows: int, space: np.ndarray, leaf_rows: int = LEAF_ROWS):
        n_cols, spaces = len(space), int(space.max()) + 1
        depth = max(0, math.ceil(math.log2(max(n_rows / leaf_rows, 1))))
        while depth and (n_cols << depth) > MOST_CELLS:
            depth -= 1
        order = np.lexsort((space[col], row))
        row, col, value = row[order], col[order], value[order]
        key = row * spaces + space[col]
        part = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        norm = np.bincount(row, value * value, n_rows)
        node = np.zeros(n_rows, np.int64)
        self.depth, self.centroids, self.radii = depth, [], []
        for level in range(depth + 1):
            n = 1 << level
            size = np.bincount(node, minlength=n)
            center = np.bincount(node[row] * n_cols + col, value, n * n_cols).reshape(n, n_cols) / size[:, None]
            over = np.add.reduceat(np.maximum(value - center[node[row], col], 0) ** 2, part)
            radius = np.zeros(n * spaces)
            np.maximum.at(radius, node[row[part]] * spaces + space[col[part]], over)
            self.centroids.append(center)
            self.radii.append(np.sqrt(radius).reshape(n, spaces))
            if level < depth:
                pole = self._farthest(self._distances(row, col, value, norm, node, center), node, n)
                first = self._dense(row, col, value, pole, node, n, n_cols)
                pole = self._farthest(self._distances(row, col, value, norm, node, first), node, n)
                axis = self._dense(row, col, value, pole, node, n, n_cols) - first
                along = np.bincount(row, value * axis[node[row], col], n_rows)
                order = np.lexsort((along, node))
                rank = np.empty(n_rows, np.int64)
                rank[order] = np.arange(n_rows) - np.repeat(np.cumsum(size) - size, size)
                node = 2 * node + (rank >= size[node] // 2)
        self.leaf = node

    @staticmethod
    def _distances(row, col, value, norm, node, center) -> np.ndarray:
        """Squared distance of each row to its node's point."""
        product = np.bincount(row, value * center[node[row], col], len(norm))
        return np.maximum(norm - 2 * product + np.einsum("ij,ij->i", center, center)[node], 0)

    @staticmethod
    def _farthest(far: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
        """One row of each node, at the greatest distance."""
        order = np.lexsort((far, node))
        return order[np.searchsorted(node[order], np.arange(n), side="right") - 1]

    @staticmethod
    def _dense(row, col, value, poles, node, n, n_cols) -> np.ndarray:
        out = np.zeros((n, n_cols))
        chosen = poles[node[row]] == row
        out[node[row[chosen]], col[chosen]] = value[chosen]
        return out


class Block:
    """Documents of one block against one block of items."""

    def __init__(self, items: Items, ids: np.ndarray, null: np.ndarray, saturation: np.ndarray, row: np.ndarray, term: np.ndarray):
        at = np.minimum(np.searchsorted(items.columns, term), max(len(items.columns) - 1, 0))
        hit = np.flatnonzero(items.columns[at] == term) if len(items.columns) else np.zeros(0, np.int64)
        score = items.weights[at[hit]] * saturation[hit]
        hit, score = hit[score > 0], score[score > 0]
        live, row = np.unique(row[hit], return_inverse=True)
        self.present, col = np.unique(at[hit], return_inverse=True)
        self.n = len(live)
        if not self.n:
            return
        value = np.sqrt(items.weights[self.present])[col] * saturation[hit]
        alone = SUBSPACES // 2 if len(self.present) > SUBSPACES else len(self.present)
        rank = np.empty(len(self.present), np.int64)
        rank[np.argsort(items.weights[self.present], kind="stable")] = np.arange(len(self.present))  # frequent terms first
        self.space = np.where(rank < alone, rank, alone + rank % max(SUBSPACES - alone, 1))
        self.balls = Balls(row, col, value, self.n, self.space)
        by_leaf = np.argsort(self.balls.leaf, kind="stable")  # rows leaf by leaf
        place = np.empty(self.n, np.int64)
        place[by_leaf] = np.arange(self.n)
        order = np.argsort(place[row], kind="stable")  # entries likewise
        self.col, self.score = col[order], score[order]
        self.entries = np.searchsorted(place[row][order], np.arange(self.n + 1))
        self.leaves = np.searchsorted(self.balls.leaf[by_leaf], np.arange((1 << self.balls.depth) + 1))
        self.ids, self.null = ids[live][by_leaf], null[live][by_leaf]

    def search(self, items: Items, k: int) -> int:
        """Goes through the items, keeps what is among their ``k`` best; returns how many leaves were scored."""
        if not self.n:
            return 0
        at = np.minimum(np.searchsorted(self.present, items.cells), len(self.present) - 1)
        known = self.present[at] == items.cells
        item = np.repeat(np.arange(len(items.ids)), np.diff(items.begin))[known]
        cells, begin = at[known], np.searchsorted(item, np.arange(len(items.ids) + 1))
        root = np.sqrt(items.weights[self.present[cells]])
        spaces = int(self.space.max()) + 1
        part, inverse = np.unique(item * spaces + self.space[cells], return_inverse=True)
        length, part_item, part_space = np.sqrt(np.bincount(inverse, root * root)), part // spaces, part % spaces
        bounds = []
        for center, radius in zip(self.balls.centroids, self.balls.radii, strict=True):
            product = np.stack([np.bincount(item, root * c[cells], len(items.ids)) + np.bincount(part_item, length * r[part_space], len(items.ids)) for c, r in zip(center, radius, strict=True)])
            bounds.append(product * (1 + SLACK) + 1)
        asked = np.zeros(len(self.present), bool)
        scored = 0
        for q in np.flatnonzero(np.diff(begin)):
            own, kept = cells[begin[q] : begin[q + 1]], items.kept[q]
            least = -kept[-1][0] if len(kept) == k else 1
            asked[own] = True
            heap = [(-bounds[0][0, q], 0, 0)]
            while heap and -heap[0][0] >= least:
                bound, level, node = heapq.heappop(heap)
                if level < self.balls.depth:
                    for child in (2 * node, 2 * node + 1):
                        tight = min(-bound, bounds[level + 1][child, q])
                        if tight >= least:
                            heapq.heappush(heap, (-tight, level + 1, child))
                    continue
                scored += 1
                a, b = self.leaves[node], self.leaves[node + 1]
                e, f = self.entries[a], self.entries[b]
                sums = np.add.reduceat(np.where(asked[self.col[e:f]], self.score[e:f], 0), self.entries[a:b] - e)
                for r in np.flatnonzero(sums >= least):
                    kept.append((-int(sums[r]), bool(self.null[a + r]), int(self.ids[a + r])))
                kept.sort()
                del kept[k:]
                least = -kept[-1][0] if len(kept) == k else 1
            asked[own] = False
        return scored


def _search(folder: str, names: list[str], counts_at: str, bits: int, n_docs: int, all_terms: int, k: int):
    def run(batches):
        begins("lexical")
        counts = HashCounts(counts_at, bits)
        blocks = [Items(folder, name, counts, n_docs) for name in names]
        for batch in batches:
            ids = batch.column(0)
            null, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            m = 10 + (90 * batch.column(1).to_numpy() * n_docs) // all_terms
            terms, tfs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ends = np.cumsum([0, *(len(t) // 8 for t in terms)])
            i = 0
            while i < len(ids):
                j = min(i + BLOCK_ROWS, max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_ENTRIES, side="right")) - 1), len(ids))
                term, tf = np.frombuffer(b"".join(terms[i:j]), "<u8"), np.frombuffer(b"".join(tfs[i:j]), "<u4").astype(np.int64)
                row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                saturation = (1_000_000_000 * tf) // (1000 * tf + 8 * m[i:j][row])
                for items in blocks:
                    Block(items, ids[i:j], null[i:j], saturation, row, term).search(items, k)
                i = j
        yield from (items.rows() for items in blocks)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item.

    Ids are integers.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    folder, terms_at, counts_at, bits = shared_folder(spark, "items"), shared_folder(spark, "terms"), shared_folder(spark, "counts"), shard_bits(spark)
    names = sorted(r["name"] for r in items.select(F.col(item_col).cast("long"), text).mapInArrow(_write_items(folder), "name string").collect())  # one for each 128 KB of items
    HashSet.write(items.select(text).mapInArrow(_distinct_terms, "h long").distinct(), terms_at, bits)
    short = written(docs.select(F.col(doc_col).cast("long").alias("doc_id"), text).mapInArrow(_short_rows(terms_at, bits), "doc_id long, n long, term binary, tf binary"), "short-rows")
    total = short.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    HashCounts.write(short.select("term").mapInArrow(_document_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), counts_at, bits)
    schema = "block string, place long, item_id long, doc_id long, score long"
    used = short.where(F.octet_length("term") > 0)
    passes = [used.mapInArrow(_search(folder, names[i : i + ITEM_BLOCKS], counts_at, bits, total["docs"], max(total["terms"], 1), k), schema) for i in range(0, len(names), ITEM_BLOCKS)]
    found = reduce(DataFrame.union, passes) if passes else spark.createDataFrame([], schema)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
