"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). How often each vote falls among
good and bad documents is estimated by expectation-maximisation over the counts
of vote patterns, of which there are at most 3 to the power of the number of
rules; a document is kept by the posterior probability that it is good.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.tables import settled, whole_row

WINDOW = 5
#: White space between words (fixed values).
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column, window: int) -> Column:
    """Words inside windows that the text holds at least twice. The windows'
    64-bit hashes are compared; only texts with equal ones sort them."""

    def covered(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(places, lambda s: F.filter(s, lambda p, k: (p["h"] == F.get(s, k - 1)["h"]) | (p["h"] == F.get(s, k + 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.aggregate(starts, state, step, lambda s: s["n"]))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def text_facts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """Counts of every whole text (null: no words), one row for each input row;
    with `carry` the input row as the struct `row`."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANK, "") != "")
    cut = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"), *_carried(docs, carry))
    bare = F.translate("text", BLANK, "")
    number = lambda c: c.cast("long")
    return cut.select(
        "doc_id",
        number(F.size("words")).alias("n_words"),
        number(F.length(bare)).alias("word_chars"),
        number(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        number(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeated_words(F.col("words"), WINDOW).alias("n_repeat_words"),
        number(F.size("lines")).alias("n_lines"),
        number(F.size(F.array_distinct("words"))).alias("n_distinct_words"),
        number(F.size(F.filter("words", lambda w, i: w == F.get(F.col("words"), i - 1)))).alias("n_stutters"),
        number(F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        number(F.length("text") - F.length(F.translate("text", "0123456789", ""))).alias("n_digits"),
        number(F.length("text") - F.length(F.translate("text", ".!?", ""))).alias("n_stops"),
        number(F.length("text") - F.length(F.translate("text", "!", ""))).alias("n_exclaims"),
        number(F.length("text") - F.length(F.translate("text", PUNCTUATION, ""))).alias("n_marks"),
        number(F.size(F.filter("words", lambda w: F.length(w) == 1))).alias("n_lone"),
        *(["row"] if carry else []),
    )


def _carried(docs: DataFrame, carry: bool) -> list[Column]:
    return [whole_row(docs)] if carry else []


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes on a row of `text_facts`."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    return {
        "symbols": _vote(c("n_symbols") <= 0.02 * n, c("n_symbols") > 0.1 * n),
        "word_length": _vote(chars.between(4 * n, 8 * n), ~chars.between(2.5 * n, 12 * n)),
        "capitals": _vote(c("n_upper") <= 0.1 * chars, c("n_upper") > 0.3 * chars),
        "repeats": _vote(c("n_repeat_words") <= 0.02 * n, c("n_repeat_words") > 0.2 * n),
        "lines": _vote((c("n_lines") >= 3) & (c("n_dup_lines") == 0), c("n_dup_lines") > 0.5 * c("n_lines")),
        "variety": _vote(c("n_distinct_words") >= 0.5 * n, (c("n_words") >= 50) & (c("n_distinct_words") < 0.15 * n)),
        "sentences": _vote(c("n_stops").between(0.03 * n, 0.3 * n), (c("n_words") >= 30) & (c("n_stops") < 0.005 * n)),
        "exclaims": _vote(c("n_exclaims") <= 0.01 * n, c("n_exclaims") > 0.2 * n),
        "digits": _vote(c("n_digits") <= 0.05 * chars, c("n_digits") > 0.3 * chars),
        "stutter": _vote(c("n_stutters") <= 0.02 * n, c("n_stutters") > 0.15 * n),
        "marks": _vote(c("n_marks") <= 0.08 * chars, c("n_marks") > 0.15 * chars),
        "lone": _vote(c("n_lone") <= 0.08 * n, c("n_lone") > 0.25 * n),
        "length": _vote(c("n_words") >= 50, c("n_words") < 10),
    }


#: Right and wrong votes that each rule is given for each class beforehand.
PSEUDO = 1.0


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500, settled_at: float = 1e-10) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents, and for each rule its accuracy on good and
    on bad documents (how likely its vote is right where it votes), by
    expectation-maximisation. Abstaining says nothing about a document.

    `patterns` are distinct tuples of votes with counts. The start takes the
    share of a document's votes that are for it; from there the data decide, as
    every rule gets the same pseudo-counts for right and wrong votes on either
    class. A class is told by rules that agree beyond chance, so a rule on its
    own is outvoted. Without rows every accuracy is a half.
    """
    k = len(patterns[0][0]) if patterns else 0
    weights = [(1 + sum(v > 0 for v in votes)) / (2 + sum(v != 0 for v in votes)) for votes, _ in patterns]
    share, accuracies = 0.5, [(0.5, 0.5)] * k
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        share = (sum(w * n for w, (_, n) in zip(weights, patterns)) + PSEUDO) / (total + 2 * PSEUDO)
        accuracies = []
        for j in range(k):
            right, voted = [PSEUDO, PSEUDO], [2 * PSEUDO, 2 * PSEUDO]
            for w, (votes, n) in zip(weights, patterns):
                if votes[j]:
                    voted[0] += w * n
                    voted[1] += (1 - w) * n
                    right[votes[j] < 0] += (1 - w if votes[j] < 0 else w) * n
            accuracies.append((right[0] / voted[0], right[1] / voted[1]))
        before, weights = weights, [_posterior(share, accuracies, votes) for votes, _ in patterns]
        if all(abs(a - b) < settled_at for a, b in zip(before, weights)):
            break
    return share, accuracies


def vote_weights(accuracy: tuple[float, float]) -> dict[int, float]:
    """What a vote adds to the log-odds of a good document."""
    good, bad = accuracy
    return {1: math.log(good / (1 - bad)), -1: math.log((1 - good) / bad), 0: 0.0}


def _posterior(share: float, accuracies: list[tuple[float, float]], votes: tuple[int, ...]) -> float:
    odds = math.log(share / (1 - share)) + sum(vote_weights(a)[v] for a, v in zip(accuracies, votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_from: float = 0.5, carry: bool = False) -> DataFrame:
    """The counts of each document, its votes, base_failed, the posterior
    probability `p_good`, and kept; with `carry` the input row as the struct
    `row`. One row for each input row.

    Words are `[^\\x20\\x09-\\x0D]+`. A document fails the base rules with fewer
    than ten words or more than a fifth of its words in windows of five words
    that it repeats; such documents are not kept and not learned from. All
    other documents count in the fit, which sees vote patterns only: at most
    3 ** rules rows reach the driver, whatever the input.
    """
    names = list(rules())
    facts = text_facts(docs, id_column, text_column, carry)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = settled(facts.withColumns({f"vote_{k}": v for k, v in rules().items()} | {"base_failed": failed}), "votes")
    votes = [f"vote_{k}" for k in names]
    counted = voted.where(~F.col("base_failed")).groupBy(*votes).count().collect()
    share, accuracies = fit_votes(sorted((tuple(r[:-1]), r[-1]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for name, accuracy in zip(votes, accuracies):
        weights = vote_weights(accuracy)
        odds = odds + F.when(F.col(name) == 1, weights[1]).when(F.col(name) == -1, weights[-1]).otherwise(weights[0])
    good = 1 / (1 + F.exp(-odds))
    return voted.withColumn("p_good", good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
