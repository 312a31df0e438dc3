"""Operator 7: quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects a document whose measure exceeds a cutoff. For each stratum and
rule, a fixed list of cutoffs is tried from lenient to strict on labelled holdouts: a cutoff
passes while the exact binomial test at level ``miss`` / (strata x rules) shows that the
rule rejects a share of at most ``risk`` / rules of good documents. Testing stops at the first
failure (a fixed sequence needs no further correction), and Bonferroni covers the
strata and rules, so that with probability 1 - ``miss`` no stratum loses more than ``risk``
of its good documents. Among the cutoffs that passed, the one that parts good from bad
documents best is taken, the more lenient of equals; where none parts them, the rule rejects nothing.

Null texts have no words and fail the base rules, as do empty ones. A stratum without
labels, or with too few for the test, has no rules of its own. Repeated rows each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SYMBOLS = "#*$%&|<>"

#: Each rule's measure (larger is worse) and its cutoffs, from lenient to strict.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(1, n_symbols + word_chars)", [0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01]),
    "duplicate_lines": ("n_dup_lines / greatest(1, n_lines)", [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeated_words": ("n_repeat_words / greatest(1, n_words)", [0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "few_words": ("20.0 / greatest(1, n_words)", [1.0, 0.8, 0.6, 0.5, 0.4]),
}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and the base counts of each whole text.

    Windows are told apart by 64-bit hashes of their words' hashes; only a text with a repeated window sorts them.
    """
    text = F.col("t")
    no_space = F.translate(text, common.SPACES, "")
    line_ok = lambda x: F.length(F.translate(x, common.SPACES, "")) > 0
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.select(
        "id", "stratum",
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), line_ok).alias("lines"),
    )
    hashed = split.select(
        "id", "stratum", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    h = F.col("h")
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - 8), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(8)]))
    windows = hashed.withColumn("g", F.when(F.size(h) >= 8, grams).otherwise(F.array().cast("array<long>"))).drop("h")
    pairs = F.array_sort(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size("g") > F.size(F.array_distinct("g"))
    ordered = windows.withColumn("o", F.when(repeats, pairs)).drop("g")
    same = lambda k, x: F.get(F.col("o"), k)["g"] == x["g"]
    twice = F.filter("o", lambda x, k: F.coalesce(same(k - 1, x), F.lit(False)) | F.coalesce(same(k + 1, x), F.lit(False)))
    places = ordered.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("o")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 8).alias("end"), (a["n"] + i + 8 - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def log_binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """The logarithm of P(X <= k), X binomial with n trials of chance p: exact, term by term."""
    odds = F.ln(p / (1 - p))
    step = lambda a, j: F.struct(
        (a["term"] + F.ln((n - j + 1) / j) + odds).alias("term"),
        (F.greatest(a["sum"], a["term"] + F.ln((n - j + 1) / j) + odds) + F.log1p(F.exp(-F.abs(a["sum"] - (a["term"] + F.ln((n - j + 1) / j) + odds))))).alias("sum"),
    )
    none = n * F.log1p(-p)
    start = F.struct(none.alias("term"), none.alias("sum"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, step, lambda a: a["sum"])


def thresholds(measures: DataFrame, labels: DataFrame, risk: float = 0.1, miss: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum, rule and cutoff of the rules that passed; ``measures`` as :func:`measured` gives them."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    entry = lambda name, x: F.struct(
        F.lit(name).alias("rule"), F.lit(len(x[1])).alias("cutoffs"), F.size(F.filter(F.array(*map(F.lit, x[1])), lambda c: F.expr(x[0]) <= c)).alias("passes")
    )
    long = measures.join(labelled, "id").select("stratum", "label", F.explode(F.array(*[entry(k, v) for k, v in RULES.items()])).alias("r")).select("stratum", "label", "r.*")
    # A document passes the first ``passes`` cutoffs, lenient ones first, and fails the later ones.
    counts = long.groupBy("stratum", "rule", "passes").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    grid = measures.sparkSession.createDataFrame([(k, j, float(c)) for k, v in RULES.items() for j, c in enumerate(v[1])], "rule string, j int, cutoff double")
    counts = common.written(counts, "counts")
    strata = counts.select("stratum").distinct().count()
    whole = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("passes", "good", "bad")).alias("parts"))
    failing = lambda what: F.aggregate(F.filter("parts", lambda x: x["passes"] <= F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x[what])
    tried = whole.join(F.broadcast(grid), "rule").select("stratum", "rule", "j", "cutoff", "n", "n_bad", failing("good").alias("k"), failing("bad").alias("caught"))
    p = F.lit(risk / len(RULES))
    level = math.log(miss / (max(1, strata) * len(RULES)))
    tested = tried.withColumn("ok", F.when((F.col("n") > 0) & (F.col("k") <= F.col("n") * p), log_binomial_tail(F.col("n"), F.col("k"), p) <= level).otherwise(False))
    order = Window.partitionBy("stratum", "rule").orderBy("j")
    safe = tested.withColumn("all_ok", F.min(F.col("ok").cast("int")).over(order)).filter("all_ok = 1")
    gain = F.col("caught") / F.greatest(F.lit(1), F.col("n_bad")) - F.col("k") / F.greatest(F.lit(1), F.col("n"))
    best = safe.withColumn("gain", gain).filter("gain > 0").groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("j"))).alias("cutoff"))
    return best


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.1, miss: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """id, the base counts, base_failed and kept of each document."""
    measures = common.written(measured(docs, id_col, text_col, stratum_col), "measures")
    cut = thresholds(measures, labels, risk, miss, id_col, label_col)
    by_rule = cut.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    by_rule = common.written(by_rule, "thresholds")
    small = by_rule.count() <= 10_000  # a row for each stratum that has rules
    joined = measures.join(F.broadcast(by_rule) if small else by_rule, "stratum", "left")
    rejected = F.lit(False)
    for name, (measure, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(measure) > F.col(name), F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def least_labels(strata: int, risk: float = 0.1, miss: float = 0.05) -> int:
    """Good labelled documents that a stratum needs before any cutoff can pass."""
    return math.ceil(math.log(miss / (strata * len(RULES))) / math.log1p(-risk / len(RULES)))
