"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    exact_dedup,
    kneser_ney,
    language_id,
    lexical_search,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    secrets,
    spelling,
    suffix_dedup,
    token_scan,
    url_filter,
)
from plumbline.llm.shared_files import shared_folder
from plumbline.storage import written

URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
#: The small labelled URL table: hosts of two names, from what filter lists and ordinary directories call such sites.
BLOCKED_NAMES = "casino poker betting lottery pills viagra pharma loans payday escort porn xxx spam ads adserver track tracker popup click cheap replica torrent crack keygen warez".split()
ORDINARY_NAMES = "news blog museum library garden school weather recipes history science college books travel health forum wiki music city photo docs theatre river kitchen village market".split()
SHARED_PARTS = ("com", "en/12"), ("org", "de/345.html"), ("net", "fr/6?page=2"), ("info", "es/78/"), ("com", ""), ("org", "en/901?ref=x")
#: Share of all tokens that a domain of the labels table shall have; the others keep their proportions.
DOMAIN_SHARES = {"toxic": 0.05}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class and links; copies are those with the same n-gram set."""
    return ngram_join.similarity_classes(read(spark, sf_dir, "documents"))[0]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files, then the documents' token counts from the files alone."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_folder(spark, "tokens")
    wrote = token_scan.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    names = written(wrote.select("doc_id", "file", "doc"), "token-docs")
    counted = token_scan.count_tokens(spark, folder)
    return counted.join(names, ["file", "doc"], "left").select("doc_id", "file", "doc", "start", "n_tokens", "closed")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = kneser_ney.score(docs, kneser_ney.fit(docs.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), *scored.columns[1:])


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(read(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids, in place of the ids, and their places."""
    import public_tokenizers

    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    slim = written(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(slim)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs.where(~F.coalesce(held, F.lit(False))).select("text", "lang"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM norm
"""


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, good or poor."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), domain_labels(read(spark, sf_dir, "labels")), DOMAIN_SHARES)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read(spark, sf_dir, "documents"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): each name with the six names after it, on top-level domains and paths that both classes share."""
    rows = []
    for label, names in ((1, BLOCKED_NAMES), (0, ORDINARY_NAMES)):
        for k, name in enumerate(names):
            for step, (top, path) in enumerate(SHARED_PARTS, 1):
                joint = "-" if (k + step) % 2 else ""
                rows.append((f"http://{'www.' if step % 2 else ''}{name}{joint}{names[(k + step) % len(names)]}.{top}/{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_filter.fit(url_filter.bounded_sample(labelled_urls(spark))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")))
    base = F.lit(quality_rules.mask(1)).cast("long")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed", "n_lines", "policy",
    )


_LEDGER_SQL = r"""
texts AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
each AS (SELECT k, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM split), next AS (SELECT k, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM each WINDOW w AS (PARTITION BY k ORDER BY i)),
grams AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM next WHERE c IS NOT NULL),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY k),
lines AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS twice FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
measured AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '!!')) AS n_shouts,
  coalesce(l.n, 0) AS n_lines, coalesce(l.twice, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM split LEFT JOIN lines l USING (k) LEFT JOIN covered c USING (k)),
ledger AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (2 * n_shouts > n_words)::BIGINT
  + 32 * (word_chars > 24 * n_words)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT AS failed FROM measured)"""
OP10_SQL = f"""WITH {_LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines, 3 AS policy FROM ledger"""
ABLATIONS_SQL = f"""WITH {_LEDGER_SQL}, rules AS (SELECT * FROM (VALUES ('few_words', 1, 1), ('repeated_windows', 2, 1), ('symbols', 4, 2), ('duplicate_lines', 8, 3), ('shouts', 16, 3), ('long_words', 32, 3), ('short_words', 64, 3)) r(rule, b, since)),
policies AS (SELECT * FROM (VALUES (1, 3), (2, 7), (3, 127)) p(policy, mask))
SELECT policy, rule, count(*) AS n_documents, count(*) FILTER (failed & b <> 0) AS n_failed, count(*) FILTER (failed & mask = b) AS n_only_this FROM ledger, rules JOIN policies ON policy >= since GROUP BY policy, rule"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule rejects, and what it alone rejects, under each policy: from the stored ledger, not the texts."""
    book = written(quality_rules.ledger(read(spark, sf_dir, "documents")).select("failed"), "ledger")
    return quality_rules.ablations(book)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH lower_docs AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
split AS (SELECT k, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM lower_docs),
totals AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM split),
items AS (SELECT row_number() OVER () AS q, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
asked AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
each AS (SELECT k, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM split),
held AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), totals),
parts AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM held JOIN weights USING (term), totals),
scores AS (SELECT q, item_id, k, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10
"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.digests(secrets.find_secrets(docs, secrets.lexicon(docs)))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_secret_scan": op13_secret_scan,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op10_quality_rules": OP10_SQL, "op12_lexical_search": OP12_SQL, "quality_ablations": ABLATIONS_SQL}
