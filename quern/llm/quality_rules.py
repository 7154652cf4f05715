"""Weak supervision of document quality (native: DataFrame expressions only).

Rules vote good, vote bad or abstain on statistics of the whole text.
Expectation-maximisation over the vote patterns estimates how each rule votes
on good and on bad documents; the posterior probability of a good document
replaces an all-must-pass filter.

The vote patterns are at most 3^(number of rules) rows, whatever the size of
the corpus. Only their counts reach the driver, where the EM runs.

Defined cases: a null text has no words and fails the base rules; repeated rows
are judged alike; an empty table gives an empty result and EM keeps its prior;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_of, words_of

GOOD, BAD, ABSTAIN = 1, 0, -1


def statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of its whole text, computed without a shuffle.

    n_repeat_words: words inside 3-word windows that occur twice or more in the
    text. Windows are told apart by 64-bit hashes; only texts in which one
    recurs sort their windows.
    """
    blank = "[^\\x20\\x09-\\x0D]"
    df = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("t"))
    df = df.select(
        "doc_id",
        words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(blank)).alias("lines"),
        F.length("t").alias("n_chars"),
        F.length(F.regexp_replace("t", "[#*$%&|<>]+", "")).alias("unsigned"),
        F.length(F.regexp_replace("t", "\\p{Lu}+", "")).alias("lowered"),
        F.length(F.regexp_replace("t", "[^\\p{L}]+", "")).alias("n_letters"),
        F.length(F.regexp_replace("t", "[^!|]+", "")).alias("n_shouts"),
    )
    n = F.size("w")
    df = df.select(
        "*",
        F.when(n < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .alias("h"),
    )
    df = df.select(
        "*",
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(None))
        .otherwise(F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
        .alias("s"),
    )
    same = lambda j, k: F.get("s", j)["h"] == F.get("s", k)["h"]
    df = df.select(
        "*",
        F.array_sort(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size("s") - 1),
                    lambda j: F.coalesce(F.when(j > 0, same(j, j - 1)), F.lit(False)) | F.coalesce(F.when(j + 1 < F.size("s"), same(j, j + 1)), F.lit(False)),
                ),
                lambda j: F.get("s", j)["i"],
            )
        ).alias("p"),
    )
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("p") - 1),
        F.lit(0),
        lambda acc, j: acc + F.when(j + 1 < F.size("p"), F.least(F.lit(3), F.get("p", j + 1) - F.get("p", j))).otherwise(F.lit(3)),
    )
    return df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.col("n_chars") - F.col("unsigned")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        F.col("n_letters").cast("long").alias("n_letters"),
        (F.col("n_chars") - F.col("lowered")).cast("long").alias("n_upper"),
        F.col("n_shouts").cast("long").alias("n_shouts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[tuple[str, Column]]:
    """(name, vote) of each rule, over the columns of statistics(). Most rules only know what is bad and abstain otherwise; two speak for a text."""

    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(bad, BAD).when(F.lit(False) if good is None else good, GOOD).otherwise(ABSTAIN)

    words, letters = F.greatest("n_words", F.lit(1)), F.greatest("n_letters", F.lit(1))
    size, lines = F.col("word_chars") / words, F.greatest("n_lines", F.lit(1))
    prose = letters / F.greatest("word_chars", F.lit(1))
    return [
        ("symbols", vote(F.col("n_symbols") > 0.2 * words)),
        ("repeats", vote(F.col("n_repeat_words") > 0.35 * words)),
        ("capitals", vote(F.col("n_upper") > 0.4 * letters)),
        ("shouts", vote(F.col("n_shouts") > 0.3 * words)),
        ("dup_lines", vote(F.col("n_dup_lines") > 0.4 * lines)),
        ("variety", vote(F.col("n_distinct_words") < 2 * F.sqrt(words))),
        ("word_size", vote((size < 2.5) | (size > 12), (size > 3) & (size < 9))),
        ("prose", vote(prose < 0.8, prose > 0.93)),
    ]


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, prior: float = 0.8, rounds: int = 60, smooth: float = 1.0) -> tuple[float, list[list[list[float]]]]:
    """(share of good documents, model), by EM over (votes, count).

    model[rule][truth][vote] is the probability of the vote 0, 1 or abstain (2)
    given the truth. Starts from rules that seldom speak wrongly, and smooths
    towards that start, so that the classes can't change places. A vote never
    counts against what it says.
    """
    start = [[0.35, 0.25, 0.4], [0.02, 0.6, 0.38]]
    model = [[row[:] for row in start] for _ in range(n_rules)]
    total = sum(c for _, c in patterns)
    strength = smooth + 0.002 * total
    for _ in range(rounds):
        sums = [[[strength * x for x in row] for row in start] for _ in range(n_rules)]
        good = smooth * prior
        for votes, count in patterns:
            p = posterior(votes, prior, model)
            good += count * p
            for k, v in enumerate(votes):
                slot = v if v >= 0 else 2
                sums[k][GOOD][slot] += count * p
                sums[k][BAD][slot] += count * (1 - p)
        prior = min(0.995, max(0.3, good / (total + smooth)))
        model = [[[x / sum(row) for x in row] for row in rule] for rule in sums]
        for rule in model:
            for slot, truth in ((BAD, BAD), (GOOD, GOOD)):
                rule[truth][slot] = max(rule[truth][slot], rule[1 - truth][slot])
    return prior, model


def posterior(votes: Sequence[int], prior: float, model: list[list[list[float]]]) -> float:
    odds = math.log(prior / (1 - prior))
    for k, v in enumerate(votes):
        slot = v if v >= 0 else 2
        odds += math.log(max(model[k][GOOD][slot], 1e-9) / max(model[k][BAD][slot], 1e-9))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: float = 0.5) -> DataFrame:
    """statistics() with base_failed, the votes, posterior (probability of a good document) and kept."""
    from quern.llm.common import stored

    named = rules()
    df = statistics(docs, text, id_col).withColumn("base_failed", base_failed())
    df = stored(df.select("*", *(v.cast("tinyint").alias(f"vote_{k}") for k, v in named)), "votes")
    votes = [f"vote_{k}" for k, _ in named]
    # at most 3^len(rules) rows
    counted = [(tuple(r[v] for v in votes), r["count"]) for r in df.groupBy(*votes).count().collect()]
    prior, model = fit(counted, len(votes))
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, v in enumerate(votes):
        logs = [math.log(max(model[k][GOOD][s], 1e-9) / max(model[k][BAD][s], 1e-9)) for s in (0, 1, 2)]
        odds = odds + F.when(F.col(v) == BAD, logs[0]).when(F.col(v) == GOOD, logs[1]).otherwise(logs[2])
    df = df.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))
