"""A small documents table with every awkward row, and brute-force helpers."""

import re

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, score double"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def real_texts(n=60):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, n).to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in t]


def awkward(spark, n=60):
    """Real rows, nulls, empties, a long text, ties, repeated rows; columns that clash with the operators' own."""
    rows = [(i, t, lang, s, len(t), "g", 0.5) for i, t, lang, s in real_texts(n)]
    base = rows[0][1]
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    more = [
        (1001, None, None, None, None, None, None),
        (1002, "", "en", "s", 0, "", 0.0),
        (1003, " \n\t ", "en", "s", 4, "", 0.0),
        (1004, long, "en", "s", len(long), "g", 1.0),
        (1005, base, "en", "s", len(base), "g", 1.0),
        (1006, base.replace(" ", "  \n", 3), "en", "s", 1, "g", 1.0),
        (1007, "one two three", "en", None, 13, "g", 1.0),
        (1007, "one two three", "en", None, 13, "g", 1.0),
        (1008, "12 345 !!! ###", None, "s", 14, "g", 1.0),
        (None, "a row without an id and some words", "en", "s", 5, "g", 1.0),
        (1009, "x" * 5000, "en", "s", 5000, "g", 1.0),
        (1010, "<|endoftext|> it's  3 spaces   here\r\n\u00a0odd\u2003ends ", "en", "s", 1, "g", 1.0),
    ]
    return spark.createDataFrame(rows + more, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
