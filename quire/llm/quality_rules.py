"""Quality rules as a short-circuit cascade, with DataFrame functions only.

``judge`` counts the words, symbols, repeated lines and repeated passages of
every whole text and judges it by a list of rules. ``estimate`` measures each
rule's cost (seconds) and its rejections on a sample and puts the rules in the
order of rejections per cost among the rows that the rules before leave; they
run as one conditional expression, so that a text rejected by one rule is not
looked at by the next. The order changes the cost, never the verdict.

Repeated passages are found inside the row: a hash of each window of words, and
only where a text's hashes are not all distinct are (hash, position) pairs
sorted and neighbours compared, word by word; if windows of one hash differ (a
collision), that text's windows are compared as strings instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window that counts as a repeated passage (a power of two).
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rows aimed at for the sample that sets the order of the rules, and timed runs of each rule over it.
SAMPLE_ROWS = 2_000
RUNS = 2
#: The base verdict: fewer words than this, or more than this share (in percent) in repeated passages.
LEAST_WORDS, MOST_REPEATED = 20, 30


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of characters other than white space, in order."""
    blanks = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), common.SPACES[1:], text)
    return F.array_remove(F.split(blanks, " "), "")


def symbols_of(text: Column) -> Column:
    """How many characters of ``SYMBOLS`` the text has."""
    return F.length(text) - F.length(reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SYMBOLS, text))


def characters_of(words: Column) -> Column:
    """Code points in the words."""
    return F.length(F.array_join(words, ""))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != "")


def window_hashes(words: Column) -> Column:
    """One hash for each window of ``WINDOW`` words, by its position: hashes of
    2, 4, ... words, each made of two of the length before."""
    def doubled(h, length):
        if length == WINDOW:
            return h
        n = F.greatest(F.size(h) - length, F.lit(0))
        pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(length + 1), n), lambda a, b: F.xxhash64(a, b))
        return _let(pairs, lambda x: doubled(x, 2 * length))
    return doubled(words, 1)


def window_strings(words: Column) -> Column:
    """The windows themselves, words joined by one space."""
    every = F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " "))
    return F.slice(every, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _sorted(keys: Column) -> Column:
    return F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))


def _covered(pairs: Column) -> Column:
    """Words inside the windows whose key occurs twice or more."""
    def twice(s, i):
        before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
        return F.when(s["k"].eqNullSafe(before["k"]) | s["k"].eqNullSafe(after["k"]), s["p"])

    def length(positions):
        steps = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _let(F.sort_array(F.filter(F.transform(pairs, twice), lambda p: p.isNotNull())), length)


def repeated_words(words: Column, hashes_of: Callable = window_hashes) -> Column:
    """Words that stand in a window of ``WINDOW`` words found twice or more in
    the text, the first one included."""
    def differ(pairs):
        return F.exists(F.transform(pairs, lambda s, i: F.coalesce(
            (s["k"] == F.get(pairs, i + 1)["k"])
            & (F.slice(words, s["p"] + 1, F.lit(WINDOW)) != F.slice(words, F.get(pairs, i + 1)["p"] + 1, F.lit(WINDOW))),
            F.lit(False))), lambda x: x)

    def of_pairs(pairs):
        return F.when(differ(pairs), _let(_sorted(window_strings(words)), _covered)).otherwise(_covered(pairs))

    def of_hashes(hashes):
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
                .otherwise(_let(_sorted(hashes), of_pairs)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes_of(words), of_hashes))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: Column, words: Column, hashes_of: Callable = window_hashes) -> Column:
    """Struct of ``COUNTS`` (long each): number of words, code points in words,
    symbols of ``SYMBOLS``, lines equal to an earlier one, words in repeated
    passages."""
    made = (F.size(words), characters_of(words), symbols_of(text), repeated_lines(text), repeated_words(words, hashes_of))
    return F.struct(*[c.cast("long").alias(n) for c, n in zip(made, COUNTS)])


def base_failed(found: Column) -> Column:
    """The base verdict from a struct of ``COUNTS``."""
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])


# ------------------------------------------------------------------ the cascade

@dataclass(frozen=True)
class Rule:
    """``rejects(text, words, found)``: true for a text to be rejected (null
    counts as false), from the text, its words and its struct of ``COUNTS``."""
    name: str
    rejects: Callable[[Column, Column, Column], Column]


def _share(words: Column, test) -> Column:
    """Hundred times the words for which ``test`` is true."""
    return 100 * F.size(F.filter(words, test))


def _same_as_next(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: a == b)


#: Fixed limits, chosen loose: shares far outside of prose.
RULES = (
    Rule("symbols", lambda t, w, f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("word_length", lambda t, w, f: ~f["word_chars"].between(2 * f["n_words"], 20 * f["n_words"])),
    Rule("repeated_lines", lambda t, w, f: 2 * f["n_dup_lines"] > F.size(lines_of(t))),
    Rule("capitals", lambda t, w, f: _share(w, lambda x: (x == F.upper(x)) & (x != F.lower(x))) > 30 * f["n_words"]),
    Rule("letterless_words", lambda t, w, f: _share(w, lambda x: ~x.rlike(r"\p{L}")) > 30 * f["n_words"]),
    Rule("stutter", lambda t, w, f: _share(_same_as_next(w), lambda same: same) > 30 * f["n_words"]),
)


@dataclass(frozen=True)
class Estimate:
    """A rule's seconds over the sample, rejected rows of the sample, and
    rejections among the rows left by the rules before it."""
    name: str
    seconds: float
    rejected: int
    left_rejected: int


def _rejects(rule: Rule, text: Column, words: Column, found: Column) -> Column:
    return F.coalesce(rule.rejects(text, words, found), F.lit(False))


def in_order(patterns: list[tuple[str, int]], cost: dict[str, float]) -> list[tuple[str, int]]:
    """(rule, rows that it rejects of those left) in the order of most
    rejections per cost among the rows that the rules before leave; rules that
    reject none of them come last, the cheapest first. A pattern has one
    character for each rule of ``cost``: 1 if it rejects the pattern's rows."""
    out, at = [], {n: i for i, n in enumerate(cost)}
    while at:
        gain = {n: sum(rows for p, rows in patterns if p[i] == "1") for n, i in at.items()}
        best = min(at, key=lambda n: (-gain[n] / cost[n], cost[n], n))
        out.append((best, gain[best]))
        i = at.pop(best)
        patterns = [(p, rows) for p, rows in patterns if p[i] == "0"]
    return out


def estimate(documents: DataFrame, rules=RULES, text_column: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order in which to run them. About ``rows`` rows, chosen
    at random with a fixed seed, are written with their words and counts; each
    rule's cost is the best time of ``RUNS`` jobs over them, less that of a job
    which only reads them. The driver gets times and counts of rejection
    patterns, at most one a sampled row."""
    share = min(1.0, rows / max(1, documents.count()))
    sample = documents.select(common.text_of(text_column).alias("t")).sample(False, share, 11)
    sample = sample.withColumn("w", words_of(F.col("t")))
    sample = common.written(sample.withColumn("f", counts(F.col("t"), F.col("w"))), "rules-sample")
    facts = [F.col(c) for c in "twf"]

    def seconds(column):
        best = float("inf")
        for _ in range(RUNS):
            begun = time.perf_counter()
            sample.agg(F.sum(column)).collect()
            best = min(best, time.perf_counter() - begun)
        return best

    read = F.length("t") + F.size("w") + F.col("f.n_words")
    reading = seconds(read)
    cost = {r.name: max(seconds(read + _rejects(r, *facts).cast("int")) - reading, 1e-3) for r in rules}
    pattern = F.concat(*[F.when(_rejects(r, *facts), "1").otherwise("0") for r in rules])
    patterns = [(r["p"], r["count"]) for r in sample.groupBy(pattern.alias("p")).count().collect()]
    rejected = {n: sum(k for p, k in patterns if p[i] == "1") for i, n in enumerate(cost)}
    return [Estimate(n, cost[n], rejected[n], gain) for n, gain in in_order(patterns, cost)]


def first_rejecting(rules, *facts: Column) -> Column:
    """Name of the first rule that rejects the text, null if none does: one
    conditional, whose later branches run only for texts that pass the earlier."""
    chain = F
    for r in rules:
        chain = chain.when(_rejects(r, *facts), F.lit(r.name))
    return chain if rules else F.lit(None).cast("string")


MADE = (*COUNTS, "base_failed", "kept", "rejected_by")


def judge(documents: DataFrame, rules=RULES, text_column: str = "text", order: list[str] | None = None,
          hashes_of: Callable = window_hashes) -> DataFrame:
    """Every row with the columns of ``MADE`` (input columns of these names are
    replaced): ``COUNTS``; ``base_failed`` (fewer than ``LEAST_WORDS`` words, or
    more than ``MOST_REPEATED`` percent of them in repeated passages); ``kept``
    (the base does not fail and no rule rejects the text) and ``rejected_by``
    (``base``, or the first rule that rejects it in the order used; else null).

    ``order`` names the rules in the order to run; without it ``estimate`` sets
    it, so that ``rejected_by`` of a text that several rules reject may differ
    between runs; ``kept`` never does. Null texts count as empty: no words, the
    base fails. Texts of any length are counted and judged whole, inside their
    row; repeated rows each for itself; an empty table gives an empty result."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in MADE]
    by_name = {r.name: r for r in rules}
    if order is None:
        order = [e.name for e in estimate(documents, rules, text_column)] if rules else []
    ordered = [by_name[n] for n in order]

    def of_counts(t, w, f):
        reason = F.when(base_failed(f), F.lit("base")).otherwise(first_rejecting(ordered, t, w, f))
        return F.struct(f.alias("f"), reason.alias("rejected_by"))

    def of_text(t):
        return _let(words_of(t), lambda w: _let(counts(t, w, hashes_of), lambda f: of_counts(t, w, f)))

    out = documents.select(*rest, _let(common.text_of(text_column), of_text).alias("_judged"))
    return out.select(*rest, "_judged.f.*", base_failed(F.col("_judged.f")).alias("base_failed"),
                      F.col("_judged.rejected_by").isNull().alias("kept"), "_judged.rejected_by")
