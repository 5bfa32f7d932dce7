"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them. SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import free_name, written

GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
ROUNDS, SETTLED = 60, 1e-4


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for a row however often `use` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marks(text: Column, pattern: str) -> Column:
    """How often the pattern, a class of single characters, occurs in the text."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that the array holds twice or more, the first one included.

    Windows are compared by 64-bit hashes. Equal ones meet by sorting, so the work is n log n for any text.
    """

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1), x + WINDOW) - x))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(found: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(found, i)["h"] == e["h"], F.lit(False))
        starts = F.transform(found, lambda e, i: F.when(same(e, i + 1) | ((i > 0) & same(e, F.greatest(i - 1, F.lit(0)))), e["i"]))
        return bound(F.sort_array(F.array_compact(starts)), covered)

    def compared(hashes: Column) -> Column:
        found = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(found, twice))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(bound(hashes, compared))

    return bound(words, windows)


def word_counts(words: Column, n_symbols: Column) -> Column:
    """Struct of counts that need the words: how many, those that end a sentence, equal the one before, hold a symbol, stand in repeated windows."""

    def counted(w: Column) -> Column:
        ends = F.filter(w, lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?"))
        marked = F.filter(w, lambda x: x.rlike(SYMBOLS))
        again = F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(ends).cast("long").alias("n_ends"), F.size(again).cast("long").alias("n_again"),
                        F.when(n_symbols == 0, F.lit(0).cast("long")).otherwise(F.size(marked).cast("long")).alias("n_marked"),
                        repeated_words(w).alias("n_repeat_words"))

    return bound(words, counted)


def line_counts(text: Column) -> Column:
    """Struct of counts: lines with a word, and those of them equal to an earlier one."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    return bound(kept, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts...) of every text; null is an empty text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("id", "text", marks(text, SYMBOLS).alias("n_symbols"))
    return rows.select("id", word_counts(words_in(text), F.col("n_symbols")).alias("w"), line_counts(text).alias("l"), "n_symbols", marks(text, "[A-Z]").alias("n_capitals"),
                       marks(text, "[!?]").alias("n_cries"), marks(text, "\\p{Punct}").alias("n_punctuation")).select(
        "id", "w.*", "l.*", "n_symbols", "n_capitals", "n_cries", "n_punctuation")


@dataclass(frozen=True)
class Rule:
    """A vote on counts of a text: -1 where `bad` holds, else 1 where `good` holds, else none."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("marked", "10 * n_marked > n_words", "50 * n_marked <= n_words"),
    Rule("punctuation", "100 * n_punctuation > 12 * word_chars", "100 * n_punctuation <= 8 * word_chars"),
    Rule("line_copies", "3 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines > 2"),
    Rule("phrase_copies", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    Rule("word_copies", "10 * n_again > n_words", "50 * n_again <= n_words"),
    Rule("capitals", "4 * n_capitals > word_chars", "10 * n_capitals <= word_chars"),
    Rule("cries", "4 * n_cries > n_words", "20 * n_cries <= n_words"),
    Rule("sentences", "n_words >= 20 and 100 * n_ends < n_words or 2 * n_ends > n_words", "n_ends between n_words / 50 and n_words / 3"),
)


@dataclass(frozen=True)
class RuleModel:
    """Share of good texts, and for each rule how often it votes 1 on good texts and -1 on bad ones when it votes."""

    rules: tuple[Rule, ...]
    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def probability(self, votes: list[Column]) -> Column:
        """Posterior probability of a good text given votes that are independent within a class."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            odds = odds + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_rules(votes: DataFrame, rules: tuple[Rule, ...] = RULES, *, n_col: str = "n", prior: float = 0.8, on_good: float = 0.9, on_bad: float = 0.4,
              weight: float = 2.0) -> RuleModel:
    """Expectation-maximisation over counted vote patterns (one column for each rule, and their number).

    There are at most 3 ** rules patterns whatever the corpus, and a round is one aggregate over them. Starts
    where rules seldom call a good text bad; `weight` texts that vote as at the start keep rates off 0 and 1.
    Without patterns the model stays at the start.
    """
    k = range(len(rules))
    model = RuleModel(rules, prior, (on_good,) * len(rules), (on_bad,) * len(rules))
    cols = [F.col(r.name) for r in rules]
    for _ in range(ROUNDS):
        p = model.probability(cols)
        sums = votes.select(*cols, (F.col(n_col) * p).alias("_g"), (F.col(n_col) * (1 - p)).alias("_b")).agg(
            F.sum("_g"), F.sum("_b"), *[F.sum(F.when(c == v, F.col(w))) for c in cols for w, v in (("_g", 1), ("_g", -1), ("_b", 1), ("_b", -1))]).first()
        s = [float(x or 0.0) for x in sums]
        rate = lambda hit, miss, start: (hit + weight * start) / (hit + miss + weight)
        after = RuleModel(rules, rate(s[0], s[1], prior), tuple(rate(s[2 + 4 * i], s[3 + 4 * i], on_good) for i in k),
                          tuple(rate(s[5 + 4 * i], s[4 + 4 * i], on_bad) for i in k))
        moved = max(abs(a - b) for a, b in zip((after.prior, *after.on_good, *after.on_bad), (model.prior, *model.on_good, *model.on_bad), strict=True))
        model = after
        if moved < SETTLED:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, counts, votes by rule, probability) of every document, with rates of the rules learnt from all of them.

    Counts are taken once and written; texts are not shuffled. A null or empty text has no words and is voted
    on like any other; repeated rows count as texts of their own; an empty table gives no rows. Other columns
    are not read.
    """
    counts = written(features(docs, id_col, text_col))
    names = [free_name(counts, r.name) for r in rules]
    voted = counts.select("*", *[r.vote().alias(n) for r, n in zip(rules, names, strict=True)])
    patterns = written(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1).withColumnsRenamed({n: r.name for n, r in zip(names, rules, strict=True)}))
    return voted.withColumn("probability", fit_rules(patterns, rules).probability([F.col(n) for n in names]))
