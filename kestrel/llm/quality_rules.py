"""Quality rules as weak supervision, with DataFrame functions only.

One pass turns a text into counts (words, symbols, repeated lines, repeated 3-word windows, ...).
Each rule votes good (1) or bad (-1) or abstains (0) on a document. Documents with equal votes count
together: at most 3**RULES rows, whatever the input. Over that table, expectation-maximisation
alternates between each vote pattern's probability of being good and each rule's accuracy on good
and on bad documents (smoothed, kept better than chance, over documents that pass the base rules);
every round is one aggregation of the
pattern table to one row. A document is kept if its posterior probability of being good is at least
KEEP and the base rules pass.

Defined cases: a null text has no words; texts without words fail the base rules; rows without an id
are judged alike; repeated rows get equal results; an empty table gives no rows; input columns named
like results are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import read, under_plain_names, written

KEEP = 0.5
ROUNDS = 20
PRIOR = 0.9
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_ends"]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with COUNTS."""
    return under_plain_names(docs, ("doc_id", text_col), lambda plain: _counted(plain, text_col))


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """Repeated 3-word windows are found by sorting (window hash, place) pairs
    inside the row: a window whose neighbour in that order has the same hash occurs again."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COUNTS], text.alias("_t"), words.alias("_w"),
                      lines.alias("_l"))
    out = out.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window: they skip the sorting
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    again = F.filter("_s", lambda p, j: (F.get("_s", j + 1)["h"] == p["h"]) | ((j > 0) & (F.get("_s", j - 1)["h"] == p["h"])))
    places = F.array_distinct(F.flatten(F.transform(again, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))
    joined = F.array_join("_w", "")
    size = lambda c: F.length(c).cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in COUNTS],
        F.size("_w").cast("long").alias("n_words"), size(joined).alias("word_chars"),
        (size(F.col("_t")) - size(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (size(F.col("_t")) - size(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
        F.size(F.filter("_w", lambda w: F.substring(w, -1, 1).isin(".", "!", "?"))).cast("long").alias("n_ends"))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by counts; comparisons in whole numbers."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": vote(n < 50, n >= 80),
        "repetition": vote(100 * F.col("n_repeat_words") > 50 * n, 100 * F.col("n_repeat_words") < 20 * n),
        "symbols": vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") < 2 * n),
        "lines": vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("n_dup_lines") == 0) & (n > 0)),
        "letters": vote(20 * F.col("n_symbols") > chars, 100 * F.col("n_symbols") < chars),
        "word_length": vote((chars < 3 * n) | (chars > 7 * n), (5 * chars > 21 * n) & (2 * chars < 13 * n)),
        "capitals": vote(10 * F.col("n_capitals") > 3 * chars, 10 * F.col("n_capitals") < chars),
        "sentences": vote((1000 * F.col("n_ends") < 35 * n) | (4 * F.col("n_ends") > n),
                          (20 * F.col("n_ends") >= n) & (5 * F.col("n_ends") < n)),
    }


def posterior(params: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability of good given the votes; params: P(vote good | good), P(vote bad | bad) by rule."""
    import math

    log_odds = F.lit(math.log(prior / (1 - prior)))
    for name, (sure, strict) in params.items():
        up, down = math.log(sure / (1 - strict)), math.log((1 - sure) / strict)
        log_odds = log_odds + F.when(F.col(name) == 1, F.lit(up)).when(F.col(name) == -1, F.lit(down)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-log_odds))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict, float]:
    """Accuracies and prior by expectation-maximisation over (votes, n)."""
    params, prior = {k: (0.97, 0.5) for k in names}, PRIOR
    for _ in range(rounds):
        p = patterns.withColumn("_p", posterior(params, prior))
        good, bad = F.col("n") * F.col("_p"), F.col("n") * (1 - F.col("_p"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        row = p.agg(total(good).alias("good"), total(F.col("n")).alias("all"), *[
            total(F.when(cond, part)).alias(f"{k}_{tag}") for k in names for tag, cond, part in (
                ("gg", F.col(k) == 1, good), ("gb", F.col(k) == -1, good),
                ("bg", F.col(k) == 1, bad), ("bb", F.col(k) == -1, bad))]).first()
        # as if a few more votes had fallen at the first shares; a bad vote always tells for bad
        share = lambda hit, miss, at: min(0.999, (hit + 10 * at) / (hit + miss + 10))
        params = {}
        for k in names:
            sure = max(0.8, share(row[f"{k}_gg"], row[f"{k}_gb"], 0.97))
            params[k] = (sure, max(1.05 - sure, share(row[f"{k}_bb"], row[f"{k}_bg"], 0.5)))
        prior = min(0.99, max(0.01, (row["good"] + 9) / (row["all"] + 10)))
    return params, prior


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (without its text) with COUNTS, a vote column for each rule, base_failed, p_good and
    kept."""
    return under_plain_names(docs, ("doc_id", text_col), lambda plain: _judged(plain, text_col))


def _judged(docs: DataFrame, text_col: str) -> DataFrame:
    votes = rules()
    results = [*[f"vote_{k}" for k in votes], "base_failed", "p_good", "kept"]
    slim = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    counts = _counted(slim, text_col).drop(text_col)
    voted = written(counts.withColumns({f"vote_{k}": v.cast("int") for k, v in votes.items()}), "op1-votes")
    names = [f"vote_{k}" for k in votes]
    # documents that fail the base rules go anyway and would only pass for the typical bad ones
    patterns = written(voted.where(~base_failed()).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "op1-patterns")
    params, prior = estimate(patterns, names)
    return (voted.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(params, prior))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
