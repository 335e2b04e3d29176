"""Soft-membership mixing: rates for documents that meet domain token targets.

1. A multinomial classifier is fitted on a labelled table (doc_id, domain), of which
   at most ``TRAIN_ROWS`` rows a domain are used; its words are all those of these
   rows whose evidence for a domain is high enough.
2. Every document gets a posterior over the domains from all its words.
3. Projected-gradient least squares finds rates r >= 0 so that the expected domain
   tokens sum(r * tokens * posterior) meet the targets.  The gradient of the squared
   gap for a rate is its posterior times the gap, so steps add up to one number a
   domain, m, and the projection is taken of their sum: r = max(0, 1 + m . posterior).
   Of all rates that meet the targets these are nearest to 1 (tokens as weights).  No
   state is kept for a document.  A step is one aggregation over all rows, which tries
   two directions, the gap and the gap scaled by the curvature of the rows above zero,
   at several lengths, and takes the least squared gap.  Steps end when every target
   is met to ``CLOSE``, or when none narrows the gap.

DataFrame functions only.  The words of the model, which the labelled sample
bounds, are the only broadcast side; a document's words never leave its task but
as partial sums.

Cases: a null or empty text has no tokens and no terms; its posterior is the
domains' prior.  Repeated rows count each for themselves; so do rows with a null
id, whose labels nothing tells.  A text of any length gives its distinct terms.
Ties between words are broken by the word.  An empty labelled table is an error,
since there is nothing to learn from; an empty document table gives an empty
result.  A target that no rates can meet ends in the least squared gap found.
Extra columns of the input are not touched by ``rates``; ``repeated`` keeps them,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import constant_array, unused
from plumbline.storage import written

TRAIN_ROWS = 2000  #: most labelled documents of each domain in the fit
LEAST_DOCS = 3  #: a word of the model occurs in so many labelled documents
LEAST_EVIDENCE = 60.0  #: and its likelihood ratio statistic for some domain is so high; of 12, 60, 120 and 250 it told held-out labels best
FIT_STEPS = 16
RIDGE = 0.3
CLOSE = 1e-5  #: of all tokens
LENGTHS = (1.0, 0.7, 0.4, 0.2, 0.1, 0.03, 0.01, 0.001)
STALLED = 1e-3  #: a step that narrows the squared gap by a lesser share is the last
SPACE = r"[\x20\x09-\x0D]+"


def _marks(text: Column, words: Column) -> Column:
    """Words of the text's shape: many symbols, many exclamations, capitals only, few different words."""
    n = F.size(words)
    many = lambda pattern: 4 * F.regexp_count(text, F.lit(pattern)) > n
    shapes = {"#symbols": many(r"[#*$%&|<>]"), "#exclaims": many("!!"), "#capitals": (text == F.upper(text)) & (n > 0), "#repeats": 5 * F.size(F.array_distinct(words)) < 2 * n}
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in shapes.items()]), lambda x: x.isNotNull())


def _terms(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep``, n_tokens and the distinct terms of every row: words without edge marks, and shapes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = docs.select(*keep, text.alias("text")).withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    term = lambda w: F.lower(F.btrim(w, F.lit(".,!?;:")))
    return raw.withColumn("terms", F.array_distinct(F.concat(_marks(F.col("text"), F.col("words")), F.transform("words", term)))).withColumn("n_tokens", F.size("words").cast("long")).drop("text", "words")


def labelled_sample(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, domain): at most ``most`` distinct ids of each domain, those of smallest hash."""
    distinct = labels.where("doc_id is not null and domain is not null").select("doc_id", "domain").dropDuplicates(["doc_id"])
    domains = sorted(r[0] for r in distinct.select("domain").distinct().limit(65).collect())
    if not domains or len(domains) > 64:
        raise ValueError("the labelled table needs 1 to 64 domains")
    parts = [distinct.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for d in domains]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[float], DataFrame]:
    """Domains, their biases, and the word table (word, w0, w1, ...: one weight a domain).

    Multinomial logistic regression on the presence of the words whose log odds
    between domains stand out.  Each step is one aggregation over the labelled
    sample; a row's words are numbers into the weights, an array for each domain.
    """
    spark = docs.sparkSession
    sample = written(labelled_sample(labels), "mix-labels")
    train = written(_terms(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).join(F.broadcast(sample), "doc_id"), text_col, F.col("domain")), "mix-train")
    sizes = {r[0]: r[1] for r in train.groupBy("domain").count().collect()}
    if not sizes:
        raise ValueError("no labelled document is in the table")
    domains = sorted(sizes)
    n, k = sum(sizes.values()), range(len(domains))
    counted = train.select("domain", F.explode("terms").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"c{i}") for i, d in enumerate(domains)])
    evidence = F.greatest(*[_evidence(F.col(f"c{i}"), F.col("df"), sizes[d], n) for i, d in enumerate(domains)], F.lit(0.0))
    chosen = counted.where(F.col("df") >= LEAST_DOCS).select("word", "df", *[f"c{i}" for i in k], evidence.alias("g")).where(F.col("g") >= LEAST_EVIDENCE).orderBy(F.desc("g"), "word").collect()
    vocabulary = spark.createDataFrame([(r[0], j) for j, r in enumerate(chosen)] or [("", 0)], "word string, j int")
    rows = train.withColumn("row", F.monotonically_increasing_id()).select("row", "domain", F.explode_outer("terms").alias("word"))
    ids = written(rows.join(F.broadcast(vocabulary), "word", "left").groupBy("row", "domain").agg(F.collect_list("j").alias("js")), "mix-ids")
    bias = [math.log(sizes[d] / n) for d in domains]
    # Step sizes bound the curvature: a row of m words moves with at most m weights.
    # The start is each word's own log odds, shared among the words of a row.
    active = max(1.0, float(ids.agg(F.avg(F.size("js"))).first()[0] or 1.0))
    shares = [[(r[f"c{i}"] + 0.5) / (sizes[d] + 1.0) for i, d in enumerate(domains)] for r in chosen]
    weights = [[(math.log(x[i]) - sum(map(math.log, x)) / len(x)) / math.sqrt(active) for x in shares] or [0.0] for i in k]
    before = weights
    for step in range(FIT_STEPS if chosen and len(domains) > 1 else 0):
        ahead = [[w + step / (step + 3) * (w - old) for w, old in zip(*pair, strict=True)] for pair in zip(weights, before, strict=True)]
        scored = [_weighed(bias[i], ahead[i]) for i in k]
        soft = _softmax(ids.select("js", "domain", *[x.alias(f"z{i}") for i, x in enumerate(scored)]), len(domains), "js", "domain")
        errors = soft.select("js", *[((F.col("domain") == d).cast("double") - F.col(f"p{i}")).alias(f"e{i}") for i, d in enumerate(domains)])
        slopes = errors.select(F.explode("js").alias("j"), *[f"e{i}" for i in k]).groupBy("j").agg(*[F.sum(f"e{i}") for i in k]).collect()
        before, weights = weights, [list(w) for w in ahead]
        for j, *slope in slopes:
            for i in k:
                weights[i][j] += 2.0 / active * (slope[i] - RIDGE * ahead[i][j]) / (chosen[j]["df"] + RIDGE)
    table = spark.createDataFrame([(r[0], *[weights[i][j] for i in k]) for j, r in enumerate(chosen)] or [("", *[0.0 for _ in k])], "word string, " + ", ".join(f"w{i} double" for i in k))
    return domains, bias, table


def _evidence(inside: Column, df: Column, size: int, n: int) -> Column:
    """Likelihood ratio statistic of a word's presence against one domain."""
    cells = ((inside, df * size / n), (df - inside, df * (n - size) / n), (size - inside, (n - df) * size / n), (n - size - df + inside, (n - df) * (n - size) / n))
    parts = [F.when((seen > 0) & (even > 0), 2 * seen * F.log(seen / even)).otherwise(0.0) for seen, even in cells]
    return sum(parts[1:], parts[0])


def _weighed(bias: float, weights: list[float]) -> Column:
    """The bias and the weights that the numbers in ``js`` pick."""
    table = constant_array(weights)
    return F.aggregate("js", F.lit(bias), lambda total, j: total + F.get(table, j))


def _softmax(scored: DataFrame, n: int, *keep: str) -> DataFrame:
    """``keep`` and p0, p1, ... from the scores z0, z1, ..."""
    z = [F.col(f"z{i}") for i in range(n)]
    top = F.greatest(*z, F.lit(-1e300))
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    return scored.select(*keep, *[(F.exp(x - top) / total).alias(f"p{i}") for i, x in enumerate(z)])


def posteriors(docs: DataFrame, domains: list[str], bias: list[float], table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and p0, p1, ...: the posterior of each domain, for every row.

    A row's evidence is summed inside its own task before anything is shuffled;
    rows are told apart by a number that the scan gives, so that a repeated id
    is not merged.
    """
    k = range(len(domains))
    rows = _terms(docs, text_col, F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    hits = rows.select("doc_id", "row", "n_tokens", F.explode_outer("terms").alias("word")).join(F.broadcast(table), "word", "left")
    sums = hits.groupBy("doc_id", "row", "n_tokens").agg(*[(F.sum(F.coalesce(f"w{i}", F.lit(0.0))) + bias[i]).alias(f"z{i}") for i in k])
    return _softmax(sums, len(domains), "doc_id", "n_tokens")


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """K x K linear system by elimination; K is the number of domains."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(n):
            if j != i and rows[i][i]:
                f = rows[j][i] / rows[i][i]
                rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [r[n] / r[i] if r[i] else 0.0 for i, r in enumerate(rows)]


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[DataFrame, list[dict[str, float]]]:
    """``soft`` with ``rate``, and the domain totals before each step and at the end.

    ``targets``: tokens wanted of each domain.
    """
    k, m = range(len(domains)), len(domains)
    p = [F.col(f"p{i}") for i in k]
    want = [float(targets[d]) for d in domains]

    def rated(moves: list[float]) -> Column:
        return F.greatest(F.lit(0.0), sum((moves[i] * p[i] for i in k), F.lit(1.0)))

    def measured(tried: list[list[float]]) -> list[list[float]]:
        """For each of the tried moves the domain totals."""
        rows = soft.select("n_tokens", *p, *[rated(c).alias(f"r{t}") for t, c in enumerate(tried)])
        got = rows.agg(*[F.sum(F.col(f"r{t}") * F.col("n_tokens") * p[i]) for t in range(len(tried)) for i in k]).first()
        return [[float(x or 0.0) for x in got[t * m : (t + 1) * m]] for t in range(len(tried))]

    def curvature(moves: list[float]) -> list[list[float]]:
        """Over the rows above zero, sum of tokens times the product of two posteriors."""
        got = soft.where(rated(moves) > 0).agg(*[F.sum(F.col("n_tokens") * p[i] * p[j]) for i in k for j in k]).first()
        return [[float(got[i * m + j] or 0.0) for j in k] for i in k]

    moves = [0.0 for _ in k]
    (totals,) = measured([moves])
    history = [dict(zip(domains, totals, strict=True))]
    while True:
        gap = [w - t for w, t in zip(want, totals, strict=True)]
        square = sum(g * g for g in gap)
        if max((abs(g) for g in gap), default=0.0) <= CLOSE * max(1.0, sum(want)):
            break
        curve = curvature(moves)
        ridge = 1e-9 * max(map(max, curve), default=0.0) + 1e-12
        scaled = _solve([[curve[i][j] + (ridge if i == j else 0.0) for j in k] for i in k], gap)
        bent = sum(gap[i] * curve[i][j] * gap[j] for i in k for j in k)
        plain = [g * square / bent if bent > 0 else 0.0 for g in gap]
        tried = [[a + length * x for a, x in zip(moves, c, strict=True)] for c in (scaled, plain) for length in LENGTHS]
        found = measured(tried)
        squares = [sum((w - t) ** 2 for w, t in zip(want, got, strict=True)) for got in found]
        best = min(range(len(tried)), key=squares.__getitem__)
        if squares[best] >= (1 - STALLED) * square:
            break
        moves, totals = tried[best], found[best]
        history.append(dict(zip(domains, totals, strict=True)))
    return soft.withColumn("rate", rated(moves)), history


def rates(docs: DataFrame, labels: DataFrame, shares: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, one posterior ``p_<domain>`` each, and ``rate`` for every row of ``docs``.

    ``shares``: wanted share of all tokens for each domain of ``labels``
    (doc_id, domain); a domain without one keeps its expected share of the rest.
    """
    if docs.isEmpty():
        kind = docs.schema[id_col].dataType.simpleString()
        names = sorted(r[0] for r in labels.where("domain is not null").select("domain").distinct().limit(65).collect())
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_tokens long, {''.join(f'`p_{d}` double, ' for d in names)}rate double")
    domains, bias, table = fit_classifier(docs, labels, id_col, text_col)
    soft = written(posteriors(docs, domains, bias, table, id_col, text_col), "mix-soft")
    now = soft.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col(f"p{i}")) for i in range(len(domains))]).first()
    all_tokens = float(now[0] or 0)
    expected = {d: float(x or 0) for d, x in zip(domains, now[1:], strict=True)}
    free = sum(expected[d] for d in domains if d not in shares) or 1.0
    left = max(0.0, 1.0 - sum(shares.get(d, 0.0) for d in domains))
    targets = {d: shares[d] * all_tokens if d in shares else left * all_tokens * expected[d] / free for d in domains}
    fitted, _ = fit_rates(soft, domains, targets)
    return fitted.select("doc_id", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def repeated(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each floor(rate) times and once more where its hash is below the fraction.

    The hash is that of id and text, so a run gives the same rows each time, and
    the tokens of a domain come out as its rates say but for the hash's deviation.
    Rows of the same id get their common rate, weighed by tokens.
    """
    own, rate, copies, turn = (unused(n, docs.columns) for n in ("rated_id", "rated", "rated_copies", "rated_turn"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("rate") * F.col("n_tokens")), F.sum("n_tokens")), F.avg("rate"))
    by_id = written(rated.groupBy(F.col("doc_id").alias(own)).agg(mean.alias(rate)), "mix-rates")
    draw = F.pmod(F.xxhash64(F.lit("copies"), id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    both = docs.join(by_id, docs[id_col].eqNullSafe(by_id[own])).withColumn(copies, times)
    return both.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[docs[c] for c in docs.columns])
