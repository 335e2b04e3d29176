"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for every document.  The ledger stores one bit per
failed rule and the measurements behind them; policies are bit masks with a
version, applied later without reading a text again, and ablations are bitwise
aggregations over the ledger.

DataFrame functions only.  The repeated-window count sorts hashes within the
row, so that a text of any length costs n log n and nothing is shuffled.

Cases: a null text has no words (it fails ``few_words``); texts of one or two
words have no window; repeated rows get equal ledgers, and rows with a null id one
as any other; a text of any length is measured as a whole; a rule is met or not,
so there are no ties; an empty table gives an empty ledger.  Extra columns are
left out, so none can clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: name -> the condition, over the ledger's measurements, under which a document fails
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouts": "2 * n_shouts > n_words",
    "long_words": "word_chars > 24 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
#: version -> the rules that it applies
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols"),
    3: tuple(RULES),
}
CURRENT_POLICY = 3


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: int) -> int:
    """The bits that a policy looks at."""
    return sum(bit(rule) for rule in POLICIES[version])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = base.select(
        "doc_id",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!!")).cast("long").alias("n_shouts"),
    )
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_shouts",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > 3,
            F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"),
        ).alias("windows"),
    )
    # Only texts with a repeated window are sorted: pairs (hash, position), then the
    # positions of neighbours with equal hashes, then the words that they cover.
    marked = counted.withColumn(
        "pairs",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.expr("array_sort(transform(windows, (h, i) -> struct(h, i)))")),
    ).drop("windows")
    hit = marked.withColumn(
        "hits",
        F.expr(
            "array_sort(transform(filter(transform(pairs, (p, k) -> struct(p.i as i,"
            " (k > 0 and p.h = pairs[greatest(k - 1, 0)].h) or (k < size(pairs) - 1 and p.h = pairs[least(k + 1, size(pairs) - 1)].h) as twice)),"
            " x -> x.twice), x -> x.i))"
        ),
    ).drop("pairs")
    # A window adds its three words, less those that the window before it covers.
    covered = F.expr("aggregate(transform(hits, (x, k) -> if(k = 0, 3, least(3, x - hits[k - 1]))), 0L, (a, b) -> a + b)")
    return hit.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hits")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: a bit for every rule that the row fails."""
    bits = [F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, condition in RULES.items()]
    return measured(docs, id_col, text_col).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(book: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with ``policy`` and ``kept``: no bit of the policy's mask is set."""
    return book.withColumn("policy", F.lit(version)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long")) == 0)


def ablations(book: DataFrame) -> DataFrame:
    """For each policy and rule: rows that fail, and rows that only this rule rejects.

    The ledger is first counted by its bits: 2 ** rules rows at most.
    """
    by_bits = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit"), F.lit(mask(v)).cast("long").alias("mask")) for v, rules in POLICIES.items() for r in rules]
    each = by_bits.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
    inside = F.col("failed").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_documents"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(inside == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )
