"""Quality rules by weak supervision: rules vote good (1), bad (-1) or abstain (0); expectation-maximisation estimates how
accurate each rule is, and a document stays when the posterior probability that it is good reaches one half.

DataFrame functions only. Each feature comes from its own row, so no text is shuffled. The votes of all documents are counted
by pattern (at most 3 to the number of rules, whatever the input), and each EM step is one aggregate over those counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: EM rounds; before the first, the log odds of good are FIRST[0] + FIRST[1] * good votes - FIRST[2] * bad votes.
ROUNDS, FIRST = 25, (1.0, 0.7, 2.5)
#: Common words of the corpus's four languages.
STOP_WORDS = "the and of to in that is for with de la que el en los des les et une und der die das ist von y"


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the columns of features(); neither met (or null): the rule abstains."""

    name: str
    good: str
    bad: str


@dataclass(frozen=True)
class Model:
    """prior: probability of good. good, bad: for each rule the probabilities of its votes -1, 0, 1 in good and bad documents."""

    prior: float
    good: tuple[tuple[float, ...], ...]
    bad: tuple[tuple[float, ...], ...]


VOTES = (-1, 0, 1)
RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("word_length", "false", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "false", "10 * n_symbols > n_words"),
    Rule("dup_lines", "false", "3 * n_dup_lines > n_lines_words"),
    Rule("repeats", "false", "4 * n_repeat_words > n_words"),
    Rule("capitals", "false", "3 * n_upper > word_chars"),
    Rule("stop_words", "12 * n_stop >= n_words and n_words > 0", "50 * n_stop < n_words or n_words = 0"),
    Rule("sentences", "n_words <= 40 * n_ends and n_words >= 3 * n_ends and n_words > 0", "n_words > 150 * n_ends"),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of a window's place beside the upper bits of its hash; a text with more windows takes the longer way.
PLACE = 20


def _covered(starts: Column) -> Column:
    """Words in 3-word windows at these starts (sorted): each start adds the words that the start before it did not cover."""
    first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    return F.aggregate(starts, first, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])


def _starts(hashes: Column) -> Column:
    """Places of hashes found twice or more, sorted: equal hashes become neighbours by sorting them with their places."""
    near = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: near(s, k - 1, x) | near(s, k + 1, x)), lambda x: x["i"]))
    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)


def _quick_starts(hashes: Column) -> Column:
    """The same by one long for hash and place, null where two different hashes agree in the bits that it keeps."""
    low = (1 << PLACE) - 1
    kept = lambda x: F.shiftright(x, PLACE)
    packed = F.transform(hashes, lambda h, i: F.shiftleft(kept(h), PLACE).bitwiseOR(i.cast("long")))
    near = lambda s, k, x: F.coalesce(kept(F.get(s, k)) == kept(x), F.lit(False))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    differ = lambda t: F.exists(F.sequence(F.lit(1), F.size(t) - 1), lambda k: (kept(F.get(t, k)) == kept(F.get(t, k - 1))) & (F.get(hashes, at(F.get(t, k))) != F.get(hashes, at(F.get(t, k - 1)))))
    places = lambda t: F.when(F.size(t) < 2, F.array().cast("array<int>")).when(~differ(t), F.sort_array(F.transform(t, at)))
    return _let(F.sort_array(packed), lambda s: _let(F.filter(s, lambda x, k: near(s, k - 1, x) | near(s, k + 1, x)), places))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more. Texts whose windows all differ, which a hash set tells, aren't sorted."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    found = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).when(F.size(h) > (1 << PLACE), _covered(_starts(h))).otherwise(_let(_quick_starts(h), lambda q: F.when(q.isNull(), _covered(_starts(h))).otherwise(_covered(q))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(hashes, found))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stop", "n_ends", "n_lines_words")


def features(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what further rules use (n_upper, n_stop, n_ends, n_lines_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.btrim(text, F.lit(WHITE))
    words = F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    less = lambda c, pattern: (F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))).cast("long")
    # a generator over one struct holds its fields as they are: the optimizer computes them once, and never inside a later filter
    held = lambda df, cols: df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))))
    d = held(docs.drop(*FEATURES), {"__text": text, "__words": words, "__lines": lines})
    cols = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "n_symbols": less(F.col("__text"), "[#*$%&|<>]+"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
        "n_upper": less(F.col("__text"), "\\p{Lu}+"),
        "n_stop": F.size(F.filter("__words", lambda w: w.isin(*STOP_WORDS.split()))).cast("long"),
        "n_ends": less(F.col("__text"), "(?<=[^.!?\\s])[.!?](?=\\s|\\z)"),
        "n_lines_words": F.size("__lines").cast("long"),
    }
    return held(d, cols).drop("__text", "__words", "__lines")


def votes(rules=RULES) -> Column:
    """Array of each rule's vote."""
    return F.array(*(F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules))


def _first(v: Column) -> Column:
    good = F.size(F.filter(v, lambda x: x == 1))
    bad = F.size(F.filter(v, lambda x: x == -1))
    return F.lit(FIRST[0]) + F.lit(FIRST[1]) * good - F.lit(FIRST[2]) * bad


def _log_odds(v: Column, model: Model) -> Column:
    """Of good: the prior's log odds plus, for each rule, the log ratio of its vote's probability in good and bad documents."""
    # one constant array: literals of its kind stay out of the generated code, so each round runs code compiled once
    ratios = [math.log(model.prior / (1 - model.prior))] + [math.log(g / b) for good, bad in zip(model.good, model.bad, strict=True) for g, b in zip(good, bad, strict=True)]
    table = F.lit(ratios)
    odds = F.get(table, F.lit(0))
    for j in range(len(model.good)):
        odds = odds + F.get(table, F.get(v, F.lit(j)) + (3 * j + 2))
    return odds


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _expected(patterns: Column, odds) -> Column:
    """Patterns (v, n) as v with g and b, how many of the n documents are good and bad at these log odds."""
    return F.transform(patterns, lambda x: _let(_probability(odds(x["v"])), lambda p: F.struct(x["v"].alias("v"), (p * x["n"]).alias("g"), ((1 - p) * x["n"]).alias("b"))))


def _maximised(expected: Column, n_rules: int) -> Column:
    """[prior, each rule's vote probabilities in good documents, in bad ones], counts smoothed by one a vote."""
    votes_of = F.sequence(F.lit(0), F.lit(3 * n_rules - 1))
    cast = lambda x, k: F.get(x["v"], F.floor(k / 3).cast("int")) == k % 3 - 1
    sums = lambda part: F.transform(votes_of, lambda k: F.aggregate(expected, F.lit(0.0), lambda a, x: a + F.when(cast(x, k), x[part]).otherwise(0.0)))
    total = lambda s: F.get(s, F.lit(0)) + F.get(s, F.lit(1)) + F.get(s, F.lit(2))
    smooth = lambda s: F.transform(s, lambda x: (x + 1) / (total(s) + len(VOTES)))
    return _let(sums("g"), lambda g: _let(sums("b"), lambda b: F.concat(F.array((total(g) + 1) / (total(g) + total(b) + 2)), smooth(g), smooth(b))))


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> Model | None:
    """The accuracies of the rules in each class and the prior, by EM from a table of vote patterns (v, n); None without rows.

    The patterns (3 to the number of rules at most) become one row, and all rounds are one expression over it.
    """
    size = 3 * n_rules

    def odds(model: Column):
        """Log odds of votes: the prior's plus, for each rule, the log ratio of its vote's probability in good and bad documents."""
        own = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.log(F.get(model, k) / F.get(model, k + size)))
        return lambda table: lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(n_rules - 1)), F.get(table, F.lit(size)), lambda a, j: a + F.get(table, 3 * j + F.get(v, j) + 1)), F.concat(own, F.array(F.log(F.get(model, F.lit(0)) / (1 - F.get(model, F.lit(0))))))

    def step(model: Column) -> Column:
        by, table = odds(model)
        return _let(table, lambda t: _let(_expected(F.col("p"), by(t)), lambda e: _maximised(e, n_rules)))

    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("p")).where(F.size("p") > 0)
    first = _let(_expected(F.col("p"), _first), lambda e: _maximised(e, n_rules))
    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array().cast("array<double>"), lambda m, k: F.when(k == 1, first).otherwise(step(m))).alias("m")).first()
    if found is None:
        return None
    m = found["m"]
    part = lambda at: tuple(tuple(m[at + 3 * j : at + 3 * j + 3]) for j in range(n_rules))
    return Model(m[0], part(1), part(1 + size))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs plus the features, base_failed, p_good and kept, which replace columns of those names.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows; such a document isn't kept, whatever
    its posterior. Null text has no words. All documents vote, repeated rows each for itself. An empty table gives an empty
    table. Other columns pass through. The features are written once, with the columns of docs.
    """
    return _judged(features(docs), rules)


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """As quality_rules, without the text."""
    return _judged(features(docs).drop("text"), rules)


def _judged(featured: DataFrame, rules) -> DataFrame:
    scratch = Scratch(featured.sparkSession, "rules")
    voted = scratch.cut(featured.withColumn("__v", votes(rules)), "zstd")
    patterns = scratch.cut(voted.groupBy(F.col("__v").alias("v")).agg(F.count("*").alias("n")).coalesce(1))
    model = fit(patterns, len(rules)) or Model(0.5, ((1 / 3,) * 3,) * len(rules), ((1 / 3,) * 3,) * len(rules))
    scratch.drop(patterns)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "p_good": _probability(_log_odds(F.col("__v"), model))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop("__v")
