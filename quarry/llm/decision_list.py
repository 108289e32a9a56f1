"""Quality rules learned as a decision list.

Statistics of every whole text are column expressions.  On those of a bounded
sample of labelled documents, sequential covering learns rules for poor
documents: a rule grows by the threshold of the greatest information gain until
no good document of the growing set is left in it, loses its last conditions if
the pruning set is better off without them, and the documents that it covers
are set aside before the next rule.  The list becomes one ordered conditional
expression: the first rule that holds rejects, otherwise a document stays.

Everything that touches documents is DataFrame functions; only the learner, on
at most ``FIT_ROWS`` rows of numbers, runs in the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a list is learned from, at most.
FIT_ROWS = 6000
#: A rule is kept if at least this share of what it rejects, in the growing and the pruning set, is labelled poor; and so many rows.
PRECISION, LEAST_ROWS, MOST_RULES, MOST_CONDITIONS = 0.9, 5, 16, 4
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS, ENDS, DIGITS, CAPITALS = "#*$%&|<>", ".!?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_ends", "n_letters")
#: Features of the rules: a count, or the quotient of two (0 where the second is 0).
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "letters_per_char": ("n_letters", "word_chars"),
    "ends_per_word": ("n_ends", "n_words"),
    "lines_per_word": ("n_lines", "n_words"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of characters other than blanks; none of an empty text."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))


def how_many(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the array holds twice or more.

    Windows are told apart by 64-bit hashes; sorted with their places, equal
    ones are neighbours, so the cost is that of one sort however often windows
    repeat.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        places = F.sort_array(F.transform(let(placed, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def over(w: Column) -> Column:
        all_places = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        hashes = F.slice(all_places, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(words, over)


def counts(text: Column) -> Column:
    """A struct of ``COUNTS``, each a long, of a whole text; null counts as empty."""

    def over(s: Column) -> Column:
        lines = F.filter(F.split(s, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
        word_counts = let(words_of(s), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"), characters(F.array_join(w, "")).alias("chars")))
        return let(F.struct(line_counts.alias("lines"), word_counts.alias("words")), named)

    def characters(solid: Column) -> Column:
        """Counts of kinds of characters; what is left of a text without small letters, then without letters, is short."""
        shortened = lambda x: let(F.struct(x.alias("all"), F.regexp_replace(x, "[a-z]+", "").alias("odd")), lambda y: kinds(y["all"], y["odd"], F.regexp_replace(y["odd"], "\\p{L}+", "")))
        return let(solid, shortened)

    def kinds(solid: Column, odd: Column, rest: Column) -> Column:
        def over_rest(r: Column) -> Column:
            found = {"word_chars": F.char_length(solid), "n_letters": F.char_length(solid) - F.char_length(r), "n_capitals": how_many(odd, CAPITALS)}
            found |= {"n_symbols": how_many(r, SYMBOLS), "n_digits": how_many(r, DIGITS), "n_ends": how_many(r, ENDS)}
            return F.struct(*[c.alias(n) for n, c in found.items()])

        return let(rest, over_rest)

    def named(g: Column) -> Column:
        place = {"n_words": g["words"], "n_repeat_words": g["words"], "n_lines": g["lines"], "n_dup_lines": g["lines"]}
        return F.struct(*[place.get(c, g["words"]["chars"])[c].cast("long").alias(c) for c in COUNTS])

    return let(F.coalesce(text, F.lit("")), over)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``COUNTS``.

    A null or empty text, and one of blanks, has no words and counts of 0;
    repeated rows repeat; columns of the new names are replaced; an empty table
    gives an empty result.
    """
    others = [c for c in docs.columns if c != text and c not in COUNTS]
    return docs.select(*[F.col(f"`{c}`") for c in others], counts(F.col(text)).alias("_counts")).select(*[F.col(f"`{c}`") for c in others], "_counts.*")


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    if under is None:
        return F.col(over).cast("double")
    return F.when(F.col(under) == 0, F.lit(0.0)).otherwise(F.col(over) / F.col(under))


@dataclass(frozen=True)
class Condition:
    """``feature`` above the threshold, or not above it."""

    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.above else feature(self.name) <= self.threshold

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.name] > self.threshold if self.above else rows[self.name] <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    poor: int = 0
    good: int = 0

    def column(self) -> Column:
        found = self.conditions[0].column()
        for c in self.conditions[1:]:
            found = found & c.column()
        return found

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(rows) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def column(self) -> Column:
        """The first rule that holds, as text; null where none does."""
        found: Column | None = None
        for rule in self.rules:
            found = F.when(rule.column(), F.lit(str(rule))) if found is None else found.when(rule.column(), F.lit(str(rule)))
        return F.lit(None).cast("string") if found is None else found


def best_condition(rows: dict[str, np.ndarray], poor: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold, between two neighbouring values, of the greatest information gain over the rows ``inside``."""
    p0, n0 = int(poor[inside].sum()), int(inside.sum() - poor[inside].sum())
    best, gain = None, 1e-9
    for name in FEATURES:
        order = np.argsort(rows[name][inside], kind="stable")
        value, is_poor = rows[name][inside][order], poor[inside][order]
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        below_p = np.cumsum(is_poor)[cut]
        below_n = cut + 1 - below_p
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -np.inf)
            at = int(found.argmax())
            if found[at] > gain:
                low, high = float(value[cut[at]]), float(value[cut[at] + 1])
                middle = (low + high) / 2
                best, gain = Condition(name, above, middle if low < middle < high else low), float(found[at])
    return best


def grow(rows: dict[str, np.ndarray], poor: np.ndarray, inside: np.ndarray) -> Rule | None:
    conditions: list[Condition] = []
    while len(conditions) < MOST_CONDITIONS and poor[inside].any() and not poor[inside].all():
        if (found := best_condition(rows, poor, inside)) is None:
            break
        conditions.append(found)
        inside = inside & found.holds(rows)
    return Rule(tuple(conditions)) if conditions else None


def prune(rule: Rule, rows: dict[str, np.ndarray], poor: np.ndarray, inside: np.ndarray) -> Rule:
    """The first conditions of the rule that are best on the rows ``inside``: share of poor ones less that of good ones, the shorter if equal."""

    def worth(some: Rule) -> float:
        covered = some.holds(rows) & inside
        p = int(poor[covered].sum())
        n = int(covered.sum()) - p
        return (p - n) / (p + n) if p + n else -1.0

    return max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=worth)


def learn(rows: dict[str, np.ndarray], poor: np.ndarray, seed: int = 13) -> DecisionList:
    """Sequential covering over rows of features; two thirds of what is left grow each rule, the others prune it."""
    rng, left, rules = np.random.default_rng(seed), np.ones(len(poor), bool), []
    while len(rules) < MOST_RULES and poor[left].any():
        growing = rng.random(len(poor)) < 2 / 3
        if (rule := grow(rows, poor, left & growing)) is None:
            break
        rule = prune(rule, rows, poor, left & ~growing)
        covered = rule.holds(rows) & left
        p, n = int(poor[covered].sum()), int(covered.sum() - poor[covered].sum())
        pruning_p, pruning_n = int((poor & covered & ~growing).sum()), int((~poor & covered & ~growing).sum())
        if p < LEAST_ROWS or p < PRECISION * (p + n) or pruning_p < PRECISION * (pruning_p + pruning_n):
            break
        rules.append(Rule(rule.conditions, p, n))
        left &= ~covered
    return DecisionList(tuple(rules))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, label: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled ids by a seeded hash, with the documents of these ids; of several labels the least counts."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.min(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(rows)  # each task keeps no more than that
    return docs.join(F.broadcast(chosen), docs[id_column] == F.col("_id")).drop("_id")


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", unless: Column | None = None, rows: int = FIT_ROWS, seed: int = 13) -> DecisionList:
    """The decision list for documents labelled 0, learned from those of at most ``rows`` labelled ids.

    ``unless`` (on ``COUNTS``) leaves documents out that are judged otherwise.
    Without labels, or with one class alone, the list is empty.  Rows of one id
    more than ``rows`` times over are cut at ``rows`` in all.
    """
    found = statistics(labelled_sample(docs.select(id_column, text), labels, id_column, label, rows, seed), text)
    # left out in the driver: as a filter it would go below the join, and count the words of all documents
    out = (F.lit(False) if unless is None else unless).alias("_out")
    ordered = found.select("_label", out, *[feature(n).alias(n) for n in FEATURES]).orderBy(F.xxhash64(F.lit(seed), "_label", *FEATURES), *FEATURES).limit(rows).collect()
    ordered = [r for r in ordered if not r["_out"]]
    poor = np.array([r["_label"] == 0 for r in ordered], bool)
    return learn({n: np.array([r[n] for r in ordered], np.float64) for n in FEATURES}, poor, seed)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """All columns of ``stats``, the rule that rejects a document (null if none) and kept."""
    return stats.withColumn("rule", rules.column()).withColumn("kept", F.col("rule").isNull())
