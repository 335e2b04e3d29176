"""Best-fit packing, planned on a histogram of lengths.

1. Texts become ids with the given public tokenizer, plus an end id; only a
   document longer than a sequence is cut.
2. The counts of each length (at most ``size`` of them) are packed best-fit
   decreasing, many equal bins in one step.  The plan is a list of slots:
   length, first rank, number of them, first sequence, place in the sequence.
3. Pieces take slots by joining on their rank within their length.  Ranks come
   from the counts of ranges of (length, id, piece), so that one length that holds
   most pieces is still numbered in parallel.

Cases: a null or empty text is the end id alone.  Repeated rows, and rows with a
null id, are separate pieces.  Equal lengths are ranked by id and piece; ties
take either place.  An empty table gives an empty result.  A very long text is
cut into as many pieces as it needs.  ``pieces`` reads the id and the text alone;
``pack`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.kit import begins, holds, unused
from plumbline.operators.splits import numbered

SEQUENCE = 1024
END_ID = 2
MOST_SLOTS = 200_000  #: slots that are broadcast (10 MB); a longer plan is joined by a shuffle
CACHE_CHUNKS = 250_000  #: chunks of text whose ids a worker remembers
MOST_IDS = 500_000  #: ids in a batch of pieces
SPLIT = r"(?<=\S)(?= \S)"  #: before a single space between two characters that are no white space

_TOKENIZERS: dict = {}


class ChunkTokenizer(dict):
    """Ids of a byte-level BPE, remembered for chunks of text: chunk -> little-endian uint32 ids.

    A text is cut before single spaces between characters that are no white
    space.  The vocabulary's pattern always starts a token there and does not
    look back, so the ids of a text are those of its chunks, one after another.
    Chunks not seen before go to the byte-pair encoder with the same ranks; any
    that could hold a special token goes to the tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None, ordinary: bool = False):
        self.path, self.ordinary, self.fast, self._whole = tokenizer_path, ordinary, None, None
        self.marks = [] if ordinary else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._whole = None  # few texts need it, and each worker would hold it
        self.mark = commonprefix(self.marks)

    @property
    def whole(self):
        """The tokenizer file itself, read when a chunk needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = self.ordinary
        return self._whole

    def _encode(self, chunk: str) -> bytes:
        if self.fast is None or (self.marks and self.mark in chunk and any(m in chunk for m in self.marks)):
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(chunk)
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in ",.!" and chunk[-2:-1].isalpha():  # a letter and a mark are never one token
            found = self[chunk[:-1]] + self[chunk[-1]]
        else:
            found = self._encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_CHUNKS:  # the older half goes
                for old in list(islice(self, CACHE_CHUNKS // 2)):
                    del self[old]
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian uint32 ids of the text."""
        if not text:
            return b""
        if "  " in text or any(x in text for x in (" \n", "\n ", "\t", "\r", "\v", "\f", "\x85", "\xa0")) or not _plain(text):
            chunks = re.split(SPLIT, text)
        else:
            chunks = text.split(" ")
            head, rest = chunks[0], chunks[1:]
            chunks = [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]
        return b"".join(map(self.__getitem__, chunks))


def _plain(text: str) -> bool:
    """Whether no white space but space and line feed can stand beside a space."""
    return text[0] != " " and text[-1] != " " and not any(c.isspace() and c != "\n" for c in set(text) - {" "})


def tokenizer(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, ordinary: bool = False) -> ChunkTokenizer:
    """This process's tokenizer for the given files; ``ordinary``: special tokens' strings are plain text."""
    key = (tokenizer_path, ranks_path, ordinary)
    begins("tokenizer")
    holds("tokenizer", _TOKENIZERS.clear)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ChunkTokenizer(tokenizer_path, ranks_path, pattern, ordinary)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32) of every document's pieces.

    A document of more than ``size`` ids gives pieces of ``size``, the first of
    them shorter where the ids do not divide.
    """
    kind = docs.schema[id_col].dataType

    def cut(batches):
        tok = tokenizer(tokenizer_path, ranks_path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, ids, held = [], [], [], [], [], 0
            for r, text in enumerate(batch.column(1)):
                own = tok.ids(text.as_py() or "") + end
                n = len(own) // 4
                low, high, k = 0, n % size or size, 0
                high = min(high, n)
                while low < n:
                    at.append(r)
                    piece.append(k)
                    start.append(low)
                    length.append(high - low)
                    ids.append(own[4 * low : 4 * high])
                    low, high, k = high, high + size, k + 1
                held += n
                if held > MOST_IDS:
                    yield _piece_batch(batch, at, piece, start, length, ids)
                    at, piece, start, length, ids, held = [], [], [], [], [], 0
            yield _piece_batch(batch, at, piece, start, length, ids)

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def _piece_batch(batch, at, piece, start, length, ids):
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "piece", "start", "length", "ids"],
    )


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, how many, first sequence, offset): the
    pieces of that length and those ranks go to consecutive sequences, all at
    that offset.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> bins (first, how many)
    sizes: list[int] = []  # the keys of ``room``, ascending
    slots, sequences = [], 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            if not room[left]:
                insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    sizes.pop(at)
                take = min(n, count - rank)
                slots.append((length, rank, take, first, size - left))
                rank += take
                leave(left, first + take, n - take)
                leave(left - length, first, take)
                continue
            fit = size // length
            take = max(1, (count - rank) // fit)
            each = min(fit, count - rank)
            for k in range(each):
                slots.append((length, rank, take, sequences, k * length))
                rank += take
            leave(size - each * length, sequences, take)
            sequences += take
    return slots


def pack(parts: DataFrame, size: int = SEQUENCE, by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``parts`` (with ``length``) with sequence_id and offset.

    The histogram has at most ``size`` lengths and the plan a bounded number of
    slots for each, whatever the number of pieces.  ``parts`` is read twice:
    pass a written table where it is costly to make.
    """
    spark = parts.sparkSession
    histogram = {int(r["length"]): int(r["count"]) for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    slots = plan(histogram, size)
    bases, below = [], 0
    for length in sorted(histogram):
        bases.append((length, below))
        below += histogram[length]
    names = {n: unused(n, parts.columns) for n in ("__length", "__rank", "__n", "__seq", "__at", "__base", "__of", "__r")}
    slot_table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], ", ".join(f"`{names[n]}` long" for n in ("__length", "__rank", "__n", "__seq", "__at")))
    base_table = spark.createDataFrame(bases or [(0, 0)], f"`{names['__of']}` long, `{names['__base']}` long")
    col = {n: F.col(f"`{c}`") for n, c in names.items()}
    placed = numbered(parts, "length", *by).join(F.broadcast(base_table), F.col("length") == col["__of"]).withColumn(names["__r"], F.col("place") - col["__base"])
    fits = (F.col("length") == col["__length"]) & (col["__r"] >= col["__rank"]) & (col["__r"] < col["__rank"] + col["__n"])
    met = placed.join(F.broadcast(slot_table) if len(slots) <= MOST_SLOTS else slot_table, fits)
    return met.select(*[F.col(f"`{c}`") for c in parts.columns], (col["__seq"] + col["__r"] - col["__rank"]).alias("sequence_id"), col["__at"].alias("offset"))
