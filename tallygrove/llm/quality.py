"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one figure of a text and votes 1 (good), -1 (bad) or abstains (0). Votes of all documents
are counted by pattern; there are at most 3 to the power of the number of rules. Expectation-maximisation over
those counts fits a mixture of good text and one kind of bad text per rule, which starts as the texts that rule
votes against. From it follow the rules' accuracies and, for each pattern, the posterior probability of good text.
(With a single kind of bad text, rules that look at unlike flaws outvote each other.)

Defined results: a null text counts as empty. A text without words fails the base rules. Repeated rows are
judged one by one and alike. An empty table gives an empty result. Columns of other names are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import written
from .common import SPACES, text_of, words


@dataclass(frozen=True)
class Rule:
    """Bad at or above ``bad``, good at or below ``good``, else it abstains."""

    name: str
    figure: str
    good: float
    bad: float


#: Figures are shares of words or characters, but for ``variety``, which sets the number of different words against the root
#: of all, so that length does not count, and ``shape``, the distance of the mean word length from 6.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0.05, 0.2),
    Rule("capitals", "n_upper / word_chars", 0.15, 0.4),
    Rule("loud", "n_loud / n_words", 0.1, 0.3),
    Rule("repeats", "n_repeat_words / n_words", 0.1, 0.3),
    Rule("variety", "sqrt(n_words) / greatest(n_distinct_words, 1)", 0.5, 1.0),
    Rule("lines", "n_dup_lines / n_words", 0.02, 0.06),
    Rule("shape", "abs(word_chars / n_words - 6)", 3.0, 6.0),
)

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 20
#: Imaginary votes of each kind that keep estimated shares off zero and one.
SMOOTHING = 0.5
THRESHOLD = 0.5
#: Share of good texts that a rule may vote against. Without a bound, a flaw that one rule alone sees and chance bad
#: votes on good texts explain the votes equally well.
FALSE_ALARMS = 0.002


def _with_next(values: str, skip: int, others: str | None = None) -> Column:
    """Hash of each value with the one ``skip`` places on, of the same list or of another."""
    other = others or values
    n = F.greatest(F.size(other) - skip, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(other, skip + 1, n), lambda a, b: F.xxhash64(a, b))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, as ``row``, with the figures that the rules look at; no row leaves its place."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = docs.select(
        F.struct("*").alias("row"),
        F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_loud"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words(t), lambda w: F.xxhash64(w)).alias("_split"),
    )
    # Windows of five words as 64-bit hashes, built from pairs and pairs of pairs.
    df = once(df, _words=F.col("_split")).drop("_split")
    df = once(df, _two=_with_next("_words", 1))
    df = once(df, _four=_with_next("_two", 2))
    df = once(df.withColumn("_four_words", F.slice("_words", 4, F.greatest(F.size("_words") - 3, F.lit(0)))),
              _five=_with_next("_four", 1, "_four_words"))
    n = F.size("_five")
    placed = F.sort_array(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = once(df, _placed=F.when(F.size(F.array_distinct("_five")) < n, placed))
    same = F.zip_with(
        F.slice("_placed", 1, n - 1), F.slice("_placed", 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    # Sorted places of the windows that are there twice or more.
    df = once(df, _places=F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    m = F.size("_places")
    steps = F.zip_with(F.slice("_places", 1, m - 1), F.slice("_places", 2, m - 1), lambda a, b: F.least(b - a, F.lit(5)))
    covered = F.aggregate(steps, F.lit(5), lambda total, step: total + step)
    return df.select(
        "row", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"), "n_upper", "n_loud",
    )


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")
    )


def vote(rule: Rule) -> Column:
    figure = F.expr(rule.figure.replace("/ n_words", "/ greatest(n_words, 1)").replace("/ word_chars", "/ greatest(word_chars, 1)"))
    return F.when(figure >= rule.bad, -1).when(figure <= rule.good, 1).otherwise(0)


@dataclass(frozen=True)
class Model:
    """Shares of the kinds of text and, for each kind and rule, how often the rule votes -1, 0 and 1.

    Kind 0 is good text; kind k is text with the flaw that rule k - 1 looks for.
    """

    weights: list[float]
    votes: list[list[dict[int, float]]]

    def kinds(self, pattern: tuple[int, ...]) -> list[float]:
        """Posterior probability of each kind."""
        logs = [
            math.log(w) + sum(math.log(shares[v]) for shares, v in zip(rules, pattern, strict=True))
            for w, rules in zip(self.weights, self.votes, strict=True)
        ]
        top = max(logs)
        odds = [math.exp(x - top) for x in logs]
        return [x / sum(odds) for x in odds]

    def good(self, pattern: tuple[int, ...]) -> float:
        return self.kinds(pattern)[0]


def _first_guess(pattern: tuple[int, ...]) -> list[float]:
    bad = [v == -1 for v in pattern]
    if not any(bad):
        return [1.0] + [0.0] * len(pattern)
    return [0.0] + [b / sum(bad) for b in bad]


def _few_alarms(shares: dict[int, float]) -> dict[int, float]:
    alarms = min(shares[-1], FALSE_ALARMS)
    rest = (1 - alarms) / (1 - shares[-1])
    return {-1: alarms, 0: shares[0] * rest, 1: shares[1] * rest}


def fit(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> Model | None:
    """Expectation-maximisation over pattern counts; None for no documents.

    The patterns of R rules are at most 3 to the power R, whatever the number of documents.
    """
    if not counts:
        return None
    size = len(next(iter(counts)))
    guess = {p: _first_guess(p) for p in counts}
    for _ in range(rounds):
        mass = [sum(n * guess[p][k] for p, n in counts.items()) for k in range(size + 1)]
        votes = [
            [
                {
                    v: (sum(n * guess[p][k] for p, n in counts.items() if p[r] == v) + SMOOTHING) / (mass[k] + 3 * SMOOTHING)
                    for v in (-1, 0, 1)
                }
                for r in range(size)
            ]
            for k in range(size + 1)
        ]
        votes[0] = [_few_alarms(shares) for shares in votes[0]]
        weights = [(m + SMOOTHING) / (sum(mass) + (size + 1) * SMOOTHING) for m in mass]
        model = Model(weights, votes)
        guess = {p: model.kinds(p) for p in counts}
    return model


def accuracies(model: Model, counts: dict[tuple[int, ...], int], rules: tuple[Rule, ...] = RULES) -> dict[str, float]:
    """Expected share of a rule's votes that agree with the quality, abstentions apart."""
    good = {p: model.good(p) for p in counts}
    out = {}
    for r, rule in enumerate(rules):
        cast = sum(n for p, n in counts.items() if p[r])
        right = sum(n * (good[p] if p[r] == 1 else 1 - good[p]) for p, n in counts.items() if p[r])
        out[rule.name] = right / cast if cast else float("nan")
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the document), its figures, votes ``v_<rule>``, ``probability``, ``base_failed`` and ``kept``."""
    seen = figures(docs, text)
    seen = written(seen.select("*", base_failed().alias("base_failed"), *(vote(r).alias(f"v_{r.name}") for r in rules)), "judged")
    names = [f"v_{r.name}" for r in rules]
    # Bounded: at most 3 ** len(rules) rows.
    counts = {tuple(r[v] for v in names): r["n"] for r in seen.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    model = fit(counts)
    rows = [(*p, model.good(p)) for p in counts]
    by_pattern = seen.sparkSession.createDataFrame(rows, ", ".join(f"{v} int" for v in names) + ", probability double")
    return seen.join(F.broadcast(by_pattern), names).select(
        *seen.columns, "probability", (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept")
    )
