"""Quality rules by weak supervision.

Rules look at counts of a text and vote that it is good (1), bad (-1), or abstain (0). Expectation-maximisation
over the vote patterns estimates how often each rule is right, without labels, and every document gets the
posterior probability that it is good, in place of a test that all rules must pass. A rule that votes at random gets a
weight near zero, and a single bad vote counts for what it is worth.

Counts and votes are expressions of the DataFrame API over one row: no explosion, no shuffle, no Python. They are
worked out once and kept without the texts. Patterns are then counted: with 8 rules and three votes
there are at most 6,561 of them, whatever the input, and the estimation runs over that table. Its result, a weight
for each rule, goes back as constants: log-odds for each vote of each rule.

Counts. Words are runs of anything but ASCII white space. n_repeat_words counts the words that lie in a window of
five words which is found twice or more in the text: windows are hashed to 64 bits, and only texts with equal
hashes sort them with their positions.

Defined cases: null text has no words and fails the base test; repeated rows are judged alike; a column of the
input that has the name of a result gives way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.llm.common import held

SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals", "n_stops", "n_marked")


def counts(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts n_lines,
    n_capitals, n_stops (sentence ends) and n_marked (words that hold a symbol) that only rules use."""
    own = [c for c in docs.columns if c not in (*BASE, *EXTRA, "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = lambda pattern: F.octet_length("__t") - F.octet_length(F.regexp_replace("__t", pattern, ""))  # noqa: E731  of ASCII characters
    rows = docs.select(*own, text.alias("__t"))
    rows = rows.select(
        *own, F.array_remove(F.split("__t", f"{SPACE}+", -1), "").alias("__w"), size("[#*$%&|<>]").cast("long").alias("n_symbols"),
        size("[A-Z]+").cast("long").alias("n_capitals"), size("[.!?]+").cast("long").alias("n_stops"),
        F.regexp_count("__t", F.lit("[#*$%&|<>][^\\x20\\x09-\\x0D]*+")).cast("long").alias("n_marked"),
        F.filter(F.split("__t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__l"),
    )
    many = F.size("__w") >= WINDOW
    window = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(WINDOW))))
    rows = rows.select(
        *own, F.size("__w").cast("long").alias("n_words"), F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"), "n_symbols", "n_capitals", "n_stops", "n_marked",
        F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.when(many, window).alias("__h"),
    )
    kept = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", *EXTRA]
    # the rest is null, and so free, where no two windows are equal
    rows = rows.select(*kept, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    again = F.filter("__s", lambda x, k: F.coalesce(x["h"] == F.get("__s", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__s", k + 1)["h"], F.lit(False)))
    rows = rows.select(*kept, F.array_sort(F.transform(again, lambda x: x["i"])).alias("__p"))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _vote(value: F.Column, good: F.Column, bad: F.Column) -> F.Column:
    return F.when(value.isNull(), 0).when(good, 1).when(bad, -1).otherwise(0)


def rules() -> dict[str, F.Column]:
    """Votes by rule, over the columns of counts()."""
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    length, symbols, lines, repeats, capitals, stops = share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), share("n_stops", "n_words")
    marked = share("n_marked", "n_words")
    words = F.col("n_words")
    return {
        "word_length": _vote(length, (length >= 2.5) & (length <= 12), (length < 2) | (length > 20)),
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.1),
        "repeated_lines": _vote(lines, lines <= 0.1, lines > 0.3),
        "repeated_words": _vote(repeats, repeats <= 0.1, repeats > 0.2),
        "capitals": _vote(capitals, capitals <= 0.2, capitals > 0.5),
        "sentences": _vote(stops, (stops >= 1 / 60) & (stops <= 0.5), (words >= 30) & ((stops < 1 / 200) | (stops > 0.8))),
        "length": _vote(words, words >= 30, words < 10),
        "marked_words": _vote(marked, marked <= 0.05, marked > 0.2),
    }


VOTES = (-1, 0, 1)


def seeds(votes: np.ndarray, counts: np.ndarray, kinds: int, lift: float) -> list[tuple[int, int]]:
    """Pairs of rules that vote bad together at least `lift` times as often as rules that know nothing of each other would.
    The pair that agrees on the most texts comes first; the next one is sought among the texts that no rule of the pairs
    before finds bad."""
    bad = (votes < 0).astype(float)
    out: list[tuple[int, int]] = []
    while len(out) < kinds and counts.sum() > 0:
        together = (bad * counts[:, None]).T @ bad
        alone = np.diag(together)
        fits = np.triu(together, 1) * (together >= np.maximum(2.0, lift * np.outer(alone, alone) / counts.sum()))
        i, j = (int(k) for k in np.unravel_index(fits.argmax(), fits.shape))
        if not fits[i, j]:
            break
        out.append((i, j))
        counts = counts * (bad[:, [i, j]].sum(axis=1) == 0)
    return out


def estimate(patterns: list[tuple[tuple[int, ...], int]], kinds: int = 3, lift: float = 2.0, rounds: int = 500, smooth: float = 2.0, close: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(log shares of the classes, log rates by class, rule and vote) from (votes, documents). The first class is the good one.

    Expectation-maximisation over a mixture of good texts and up to `kinds` kinds of bad ones, in each of which a rule
    has its own rates of voting bad, abstaining and voting good: a text that is all symbols and one that repeats itself
    are bad in different ways, which one class of bad texts could not tell from good. Without labels only agreement
    shows that a rule is right, so each kind starts from a pair of rules that agree more often than by chance, and a
    rule that votes at random comes to have the same rates in all classes. Every rate and share has a Dirichlet prior
    of `smooth`, which matters only where there are few texts; nothing else bounds them.
    """
    n = max((len(v) for v, _ in patterns), default=0)
    votes, counts = np.array([v for v, _ in patterns], np.int64).reshape(len(patterns), n), np.array([c for _, c in patterns], float)
    starts = seeds(votes, counts, kinds, lift)
    rates = np.full((1 + len(starts), n, 3), [0.05, 0.1, 0.85])
    for k, pair in enumerate(starts, 1):
        rates[k] = [0.25, 0.15, 0.6]
        rates[k, list(pair)] = [0.8, 0.1, 0.1]
    shares = np.array([0.9, *[0.1 / max(1, len(starts))] * len(starts)])
    log_shares, log_rates = np.log(shares / shares.sum()), np.log(rates)
    cast = (votes[:, None, :] == np.array(VOTES)[None, :, None]).astype(float)  # pattern, vote, rule
    last = -np.inf
    for _ in range(rounds if len(starts) else 0):
        joint = log_shares + np.einsum("pvr,crv->pc", cast, log_rates)
        top = joint.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        weight = np.exp(joint - total) * counts[:, None]
        shares = weight.sum(axis=0) + smooth
        rates = np.einsum("pvr,pc->crv", cast, weight) + smooth
        log_shares, log_rates = np.log(shares / shares.sum()), np.log(rates / rates.sum(axis=2, keepdims=True))
        now = float(total[:, 0] @ counts)
        if now - last <= close * counts.sum():
            break
        last = now
    return log_shares, log_rates


def probability(model: tuple[np.ndarray, np.ndarray], votes: list[Column]) -> Column:
    """The posterior probability of the good class, from columns of votes; 1 where no kind of bad text was found."""
    log_shares, log_rates = model
    odds = F.lit(0.0)
    for share, rates in zip(log_shares[1:], log_rates[1:], strict=True):
        x = F.lit(float(share - log_shares[0]))
        for vote, bad, good in zip(votes, rates, log_rates[0], strict=True):
            w = [float(b - g) for b, g in zip(bad, good, strict=True)]
            x = x + F.when(vote > 0, w[2]).when(vote < 0, w[0]).otherwise(w[1])
        odds = odds + F.exp(x)
    return 1 / (1 + odds)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without text, with the five counts, base_failed, probability and kept."""
    votes = rules()
    names = [f"__{k}" for k in votes]
    rows = held(counts(docs).select("*", *(v.alias(k) for k, v in zip(names, votes.values(), strict=True))))
    patterns = rows.groupBy(*names).count().collect()  # at most 3 ** 8 rows
    model = estimate([(tuple(r[:-1]), r[-1]) for r in patterns])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    new = ("base_failed", "probability", "kept")
    own = [c for c in docs.columns if c not in (*BASE, *new, *EXTRA, "text")]
    judged = rows.select(*own, *BASE, failed.alias("base_failed"), F.round(probability(model, [F.col(k) for k in names]), 9).alias("probability"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
