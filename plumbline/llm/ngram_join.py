"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Each text gives its set of word n-grams (five words; a text of one to four
   words gives one n-gram of them all), MinHash values in ``bands`` x ``rows``
   chosen for the target recall at the threshold, and a hash of the whole set.
2. Texts with the same set form a node, whatever their ids; a node is met once,
   so copies are never paired.
3. Nodes are shuffled on their band hashes.  Buckets of two nodes or more are
   tied to their least node, and connected components of these ties are the
   candidate sets: a node's n-grams are sent where its component meets, once.
4. A component of up to ``MOST_ROWS`` nodes and ``MOST_GRAMS`` n-grams is one group.
   A larger one meets by its buckets if that makes fewer pairs (buckets of the
   same nodes once, those inside a larger one not at all), else as a whole; what
   is larger than a group is split into blocks, and each pair of blocks is a group.
5. A group counts the shared n-grams of all its pairs by matrix products, and
   every pair is decided on its full sets.  A pair that meets in several buckets
   belongs to the least of them.  A group gives sums of links and components, not
   pairs, so that rows grow with the nodes; the time of a large group of near
   copies grows with its pairs, since each of them may be a link.
6. Connected components of the links are the classes.

Cases: null, empty and white-space texts have no n-gram: they are alone in their
class, without links.  Rows with a null id come back with a null class and no
links.  Repeated rows are copies of each other.  Rows of one id with different
texts are judged each by its text.  Ties between ids cannot occur: the smallest
id names a class.  A text of any length is one set.  An empty table gives an
empty result.  Extra columns are not read, so none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, lists, mix64, row_slices, unique_in_rows, utf8, windows, words
from plumbline.llm.shared_files import HashSet, shard_bits, shared_folder, without_ids
from plumbline.operators.graph import hub_components
from plumbline.storage import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 128
MOST_ROWS = 2048  #: nodes of a block
MOST_GRAMS = 2_000_000  #: n-grams of a block, but for one node's own
COLUMNS = 1024  #: n-grams in one matrix product
SEED = 0x5EED


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows whose recall at the threshold is met within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS):
    """Sorted distinct n-gram hashes of each row, and where each row begins."""
    _, _, hashes, first = words(data, offsets)
    grams, _, begin = windows(hashes, first, n, short=True)
    return unique_in_rows(grams, begin)


def _set_hashes(grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set; zero for an empty one."""
    full = np.flatnonzero(np.diff(begin))
    k0, k1 = np.zeros(len(begin) - 1, np.uint64), np.zeros(len(begin) - 1, np.uint64)
    if len(full):
        at = begin[:-1][full]
        k0[full] = np.add.reduceat(mix64(grams), at)
        k1[full] = np.add.reduceat(mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return k0.view(np.int64), k1.view(np.int64)


def signatures(docs: DataFrame, n: int = WORDS, bands: int | None = None, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_set, k0, k1 (hashes of the whole set), bands (array of band hashes)."""
    if bands is None or rows is None:
        bands, rows = choose_bands()
    kind = docs.schema[id_col].dataType

    def sign(batches):
        begins("ngrams")
        draw = np.random.Generator(np.random.PCG64(SEED))
        times = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                grams, begin = ngram_sets(data, offsets[i : j + 1], n)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                out = np.zeros((j - i, bands), np.uint64)
                for band in range(bands if len(full) else 0):
                    key = np.full(len(full), band + 1, np.uint64)
                    for row in range(rows):
                        value = (grams * times[band * rows + row]) >> np.uint64(32)
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value.astype(np.uint32), begin[:-1][full]))
                    out[full, band] = key
                k0, k1 = _set_hashes(grams, begin)
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(k0), pa.array(k1), lists(out[size > 0].reshape(-1).view(np.int64), ends, pa.int64())],
                    names=["doc_id", "n_set", "k0", "k1", "bands"],
                )

    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("n_set", "k0", "k1")], T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, schema)


def _sets(docs: DataFrame, ids: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(k0, k1, grams) of the documents whose id is in ``ids`` (rep).

    The ids' hashes are stored as mapped arrays that the scan asks, so texts are
    not shuffled; a text that only shares a hash, or an id, has another set hash.
    """
    spark = docs.sparkSession
    folder, bits = shared_folder(spark, "candidates"), shard_bits(spark)
    HashSet.write(ids.select(F.xxhash64("rep").alias("h")).distinct(), folder, bits)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("text"))

    def gather(batches):
        begins("ngrams")
        wanted = HashSet.opened(folder, bits)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.contains(batch.column(0).to_numpy().view(np.uint64))))
            data, offsets = utf8(batch.column(1))
            for i, j in row_slices(offsets):
                grams, begin = ngram_sets(data, offsets[i : j + 1], n)
                k0, k1 = _set_hashes(grams, begin)
                yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(k1), lists(grams.view(np.int64), begin, pa.int64())], names=["k0", "k1", "grams"])

    return texts.mapInArrow(gather, "k0 long, k1 long, grams array<long>")


def _shared_counts(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each row of ``left`` shares with each row of ``right``; row i has ``sizes[i]`` distinct values."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    row, column = row[keep], (np.cumsum(often > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)  # whole numbers far under 2 ** 24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        there = np.zeros((len(sizes), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        there[row[i:j], column[i:j] - at] = 1
        total += there[left] @ there[right].T
    return total


def _met(group: pa.Table, threshold: float):
    """The group with each node once, by node, the row numbers of the linked pairs that belong to it, and their similarity."""
    _, once = np.unique(group.column("node").to_numpy(), return_index=True)
    group = group.take(pa.array(once))
    flat = lambda name: group.column(name).combine_chunks()
    grams, names, part = flat("grams"), flat("names"), flat("part").to_numpy()
    size = np.diff(grams.offsets.to_numpy())
    key, low, high = (group.column(c)[0].as_py() for c in ("key", "low", "high"))
    left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
    same = _shared_counts(grams.flatten().to_numpy(), size, left, right).astype(np.float64)
    j = same / (size[left][:, None] + size[right] - same)
    linked = j >= threshold
    owner, named = np.repeat(np.arange(len(part)), np.diff(names.offsets.to_numpy())), names.flatten().to_numpy()
    before = named < key
    if before.any():
        linked &= _shared_counts(named[before], np.bincount(owner[before], minlength=len(part)), left, right) == 0
    if low == high:
        linked = np.triu(linked, 1)
    a, b = np.nonzero(linked)
    return group, left[a], right[b], j[a, b]


def _pairs_of(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group, a, b, j = _met(group, threshold)
        node = group.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b)), "j": pa.array(j)})

    return run


def _sums_of(threshold: float):
    """For each node with links: the rows that its partners stand for, and the first node of its component in the group."""

    def run(group: pa.Table) -> pa.Table:
        group, a, b, _ = _met(group, threshold)
        n, copies = group.num_rows, group.column("copies").to_numpy()
        links = (np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)).astype(np.int64)
        root = np.arange(n)
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        full = np.flatnonzero(links)
        node = group.column("node").combine_chunks()
        return pa.table({"node": node.take(pa.array(full)), "root": node.take(pa.array(root[full])), "links": pa.array(links[full]), "whole": pa.array(np.full(len(full), group.column("whole")[0].as_py()))})

    return run


def _buckets(reps: DataFrame) -> DataFrame:
    """(node, band, n, hub): buckets of two nodes or more from ``reps`` (node, bands); of buckets with the same nodes, one."""
    keyed = reps.select("node", F.explode("bands").alias("band")).repartition("band").distinct()
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), *hashes).where("n > 1")
    kept = sizes.groupBy("n", "s0", "s1", "hub").agg(F.min("band").alias("band")).select("band", "n", "hub")
    return keyed.join(kept, "band").select("node", "band", "n", "hub")


def _outer_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (node, band, n) without the buckets whose nodes all lie in one larger bucket."""
    largest = rows.groupBy("node").agg(F.max(F.struct("n", "band")).alias("best"))
    judged = rows.join(largest, "node").groupBy("band").agg(F.min("best").alias("low"), F.max("best").alias("high"))
    inside = judged.where((F.col("low") == F.col("high")) & (F.col("low.band") != F.col("band"))).select("band")
    return rows.join(inside, "band", "left_anti")


def _placed(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kind, key, low, high, part, names, whole): where each candidate node meets others.

    ``nodes`` (node, n_set).  ``kind`` tells components (0) from buckets (1).
    """
    tied = hub_components(buckets)
    sized = written(tied.join(nodes, "node").select("node", "component", "n_set"), "tied")
    cost = buckets.select("node", "n").join(sized, "node").groupBy("component").agg(F.sum("n").alias("pairs"))
    shapes = sized.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_set").alias("grams"))
    fits = (F.col("rows") <= MOST_ROWS) & (F.col("grams") <= MOST_GRAMS)
    judged = shapes.join(cost, "component").withColumn("by_bucket", ~fits & (F.col("pairs") < F.col("rows") * F.col("rows")))
    each = written(sized.join(judged, "component"), "placed")
    blocks_of = lambda rows, grams: F.greatest(F.ceil(rows / MOST_ROWS), F.ceil(grams / MOST_GRAMS)).cast("int")
    none = F.lit(None).cast("array<long>")
    whole = each.where("not by_bucket").select("node", F.lit(0).alias("kind"), F.col("component").alias("key"), blocks_of(F.col("rows"), F.col("grams")).alias("blocks"), none.alias("names"))
    loose = buckets.join(each.where("by_bucket").select("node", "n_set"), "node")
    outer = written(_outer_buckets(loose.select("node", "band", "n", "n_set")), "outer")
    weights = outer.groupBy("band").agg(F.sum("n_set").alias("grams"))
    names = outer.groupBy("node").agg(F.collect_list("band").alias("names"))  # as many as bands at most
    parted = outer.join(weights, "band").join(names, "node").select("node", F.lit(1).alias("kind"), F.col("band").alias("key"), blocks_of(F.col("n"), F.col("grams")).alias("blocks"), "names")
    dealt = whole.unionByName(parted).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        "node", "kind", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", F.coalesce("names", F.array().cast("array<long>")).alias("names"),
        ((F.col("kind") == 0) & (F.col("blocks") == 1)).alias("whole"),
    )


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, rep, copies, class_id, n_links) and links (a, b, j).

    ``rep`` is the smallest id with the same n-gram set, ``copies`` the number of
    rows with it; links tie all representatives that are similar; ``n_links``
    counts the other rows that a row is similar to: its copies, and all rows that
    its representative's partners stand for.
    """
    bands, rows = choose_bands(threshold)
    signed = written(signatures(docs, n, bands, rows, id_col, text_col), "signatures")
    usable = signed.where("n_set > 0 and doc_id is not null")
    grouped = usable.groupBy("k0", "k1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_set").alias("n_set"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = usable.select("doc_id", "k0", "k1", "bands").join(nodes.select("k0", "k1", "rep", "node"), ["k0", "k1"])
    members = written(own.select("doc_id", "node", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "members")
    buckets = written(_buckets(members.where("bands is not null").select("node", "bands")), "buckets")
    places = written(_placed(buckets, nodes.select("node", "n_set")).join(nodes.select("node", "k0", "k1", "rep", "copies"), "node"), "places")

    met = _sets(docs, places.select("rep"), n, id_col, text_col).join(places.drop("rep"), ["k0", "k1"]).drop("k0", "k1").groupBy("kind", "key", "low", "high")
    sums = written(met.applyInArrow(_sums_of(threshold), "node long, root long, links long, whole boolean"), "links")
    pairs = met.applyInArrow(_pairs_of(threshold), "a long, b long, j double")
    named = nodes.select("node", F.col("rep").alias("name"))
    at = lambda end: named.withColumnsRenamed({"node": end, "name": f"{end}_name"})
    links = pairs.join(at("a"), "a").join(at("b"), "b").select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b"), "j")

    roots = sums.where("whole").select("node", "root").unionByName(hub_components(sums.where("not whole"), "node", "root").withColumnRenamed("component", "root"))
    classes = roots.join(named, "node").groupBy("root").agg(F.min("name").alias("class_id"))
    degrees = sums.groupBy("node").agg(F.sum("links").alias("links"))
    linked = written(roots.join(classes, "root").select("node", "class_id").join(degrees, "node"), "classes")
    judged = nodes.join(linked, "node", "left").select("node", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    tied = members.select("doc_id", "node").join(judged, "node").drop("node")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = signed.where("n_set = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("rep"), one.alias("copies"), F.col("doc_id").alias("class_id"), none.alias("n_links"))
    return tied.unionByName(alone), links


def representatives(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one row for the smallest id of every class.

    Rows with a null id stay.  Of an id with different texts all rows stay if one
    of them names its class; of repeated rows (same id and text) one stays.
    """
    members, _ = similarity_classes(docs, threshold, n, id_col, text_col)
    own = F.col("doc_id") == F.col("class_id")
    fate = F.when(F.col("doc_id").isNull() | (F.bool_or(own) & (F.count(F.lit(1)) == 1)), "stays").when(F.bool_or(own), "looked at").otherwise("goes")
    fates = written(members.groupBy("doc_id").agg(fate.alias("fate")).select(F.col("doc_id").alias("id"), "fate"), "fates")
    stay, doubtful = without_ids(docs, id_col, fates)
    return stay.unionByName(doubtful.dropDuplicates([id_col, text_col]))
