"""Quality rules: a decision list learnt by sequential covering, applied as one ordered Spark conditional.

Rules are conjunctions of thresholds on statistics of a text. Each is grown condition by condition for the
largest information gain on two thirds of the labelled rows, then pruned on the other third; rows that it
covers are taken away and the next one is grown. A rule is accepted only if it is right for nearly all rows
of either part. The first rule that holds rejects a text; a text with no rule is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import fields, map_rows
from tallyspan.llm.samples import labelled

BLANKS, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = (*BASE, "n_lines", "n_upper", "n_letters", "n_marks")
#: Labelled documents of each class that learning takes at most.
PER_CLASS = 3000
MIN_PRECISION = 0.98
_UPPER, _LETTERS, _MARKS = re.compile(r"[A-Z]+"), re.compile(r"[A-Za-z]+"), re.compile(r"[!?]")


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of a text. A null text is the empty one: all are 0 but n_lines, which is 1."""
    t = text or ""
    words = t.encode().split()  # bytes split at ASCII white space only
    lines = t.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if x.strip(BLANKS):
            dup += x in seen
            seen.add(x)
    repeat = 0
    threes = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(threes)) < len(threes):
        n = Counter(threes)
        end = 0
        for i, x in enumerate(threes):
            if n[x] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words), len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), dup, repeat,
        len(lines), sum(map(len, _UPPER.findall(t))), sum(map(len, _LETTERS.findall(t))), len(_MARKS.findall(t)),
    )


def ratios(s: dict) -> dict:
    """What rules test, by name, from STATS as numbers, arrays or columns."""
    one = 1e-9
    return {
        "n_words": s["n_words"] * 1.0,
        "mean_word": s["word_chars"] / (s["n_words"] + one),
        "symbols": s["n_symbols"] / (s["n_words"] + one),
        "dup_lines": s["n_dup_lines"] / (s["n_lines"] + one),
        "repeats": s["n_repeat_words"] / (s["n_words"] + one),
        "upper": s["n_upper"] / (s["n_letters"] + one),
        "marks": s["n_marks"] / (s["n_words"] + one),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, r):
        return r[self.name] >= self.threshold if self.above else r[self.name] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, r: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(r)
    return hit


def _grow(r: dict[str, np.ndarray], bad: np.ndarray, most: int = 3) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, choice = 0.0, None
        for name, v in r.items():
            values = np.unique(v[inside])
            cuts = (values[:-1] + values[1:]) / 2
            b, g = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
            for above in (True, False):
                p, n = np.searchsorted(b, cuts), np.searchsorted(g, cuts)
                p, n = (len(b) - p, len(g) - n) if above else (p, n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                if len(gain) and gain.max() > best + 1e-12:
                    k = int(gain.argmax())
                    best, choice = float(gain[k]), Condition(name, above, float(cuts[k]))
        if choice is None:
            break
        rule = (*rule, choice)
        inside &= choice.holds(r)
    return rule


def learn(stats: np.ndarray, bad: np.ndarray, max_rules: int = 10, min_cover: int = 5) -> list[Rule]:
    """Decision list from rows of STATS and whether each is to be rejected."""
    r = {k: np.asarray(v, float) for k, v in ratios(dict(zip(STATS, stats.T.astype(float), strict=True))).items()} if len(stats) else {}
    grow = np.random.default_rng(0).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    sub = lambda m: {k: v[m] for k, v in r.items()}
    while len(rules) < max_rules and (left & bad & grow).sum() >= min_cover:
        g, p = left & grow, left & ~grow
        rule = _grow(sub(g), bad[g])
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            hit = _covers(rule[:k], sub(p), int(p.sum()))
            pos, neg = (hit & bad[p]).sum(), (hit & ~bad[p]).sum()
            worth.append(((pos - neg) / max(1, pos + neg), k))
        rule = rule[: max(worth)[1]]
        hit = _covers(rule, r, len(bad)) & left
        if (hit & bad).sum() < min_cover or (hit & bad).sum() < MIN_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rejects(rules: list[Rule], s: dict[str, Column]) -> Column:
    """The list as an ordered conditional: number of the first rule that holds, from 1, or 0."""
    r = ratios(s)
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.holds(r)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def add_statistics(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    return map_rows(docs, keep, [text], fields(**dict.fromkeys(STATS, "long")), lambda: lambda texts: list(zip(*map(statistics, texts), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    """Rules from at most ``per_class`` labelled documents of each quality; quality 0 is to be rejected."""
    rows = add_statistics(labelled(docs, labels, "quality", per_class), ("label",)).toArrow()
    stats = np.array([rows[c].to_numpy() for c in STATS], np.int64).T.reshape(-1, len(STATS))
    bad = rows["label"].to_numpy() == 0
    order = np.lexsort((bad, *stats.T))
    return learn(stats[order], bad[order])


def base_failed(s: dict[str, Column]) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def verdicts(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus statistics, base_failed, rule (first that holds, 0 for none) and kept, for every row.

    Null and empty texts have no words and so fail the base; equal rows get equal verdicts. A text is held whole with its
    words while it is measured. Only ``keep`` and the text are read, so other columns may have any name.
    """
    s = {c: F.col(c) for c in STATS}
    got = add_statistics(docs, keep, text)
    return got.select("*", base_failed(s).alias("base_failed"), rejects(rules, s).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """Rows of ``docs`` that are kept, all columns unchanged."""
    rules = fit(docs, labels, per_class)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return verdicts(row, rules, ("row",)).where("kept").select("row.*")
