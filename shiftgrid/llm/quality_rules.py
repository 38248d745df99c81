"""Quality rules: text statistics, fixed rules, and a decision list learned by sequential covering.

Rules are grown one condition at a time on two thirds of the labelled statistics, pruned on the last third, and emitted as one
ordered Spark conditional expression, so that a verdict can be read and rerun without this module.

Null and empty texts have no words: all statistics are 0 and the fixed rule rejects them. Repeated rows are judged alike, ties
between conditions go to the first statistic and the smallest threshold. Without labelled rows the list is empty and only the
fixed rules decide. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import SPACE, map_rows, need

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_adjacent_words",
    "n_short_words", "n_stops",
)
# What the learned conditions compare: ratios, so that a rule means the same for texts of any length.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "distinct_word_ratio": ("n_distinct_words", "n_words"),
    "adjacent_word_ratio": ("n_adjacent_words", "n_words"),
    "short_word_ratio": ("n_short_words", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *RATIOS)


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words inside windows of five that occur at least twice, first occurrence included."""
    n = ids.size - WINDOW + 1
    if n < 2 or distinct == ids.size:
        return 0
    if distinct < 6_000:  # five numbers below 6,000 fit one 64-bit number
        code = ids[:n].copy()
        for j in range(1, WINDOW):
            code = code * distinct + ids[j:n + j]
    else:
        _, two = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        _, four = np.unique(two[:-2] * ids.size + two[2:], return_inverse=True)
        code = four[:n] * distinct + ids[4:n + 4]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    hit = np.isin(code, twice)
    cover = np.zeros(ids.size + 1, np.int32)
    cover[:n] += hit
    cover[WINDOW:WINDOW + n] -= hit
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_counts(text: bytes | None) -> tuple:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    short = sum(len(w) < 4 for w in words)
    return (
        n, len(text.translate(None, SPACE + bytes(range(0x80, 0xC0)))), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated(ids, len(number)), len(lines), len(number),
        int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0, short, stops,
    )


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the COUNTS (long) of every whole text."""
    return map_rows(docs, keep, text, lambda: lambda texts: (text_counts(t) for t in texts),
                    T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))


def base_failed() -> Column:
    """The fixed rules: under ten words, or over 20 % of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    if name not in RATIOS:
        return F.col(name).cast("double")
    a, b = RATIOS[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = feature(self.name)
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.name)]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: np.ndarray, y: np.ndarray, most: int, thresholds: int) -> Rule:
    """Add the condition of the largest information gain until the rule covers targets only."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for j, name in enumerate(FEATURES):
            v, target = x[inside, j], y[inside]
            marks = np.unique(np.quantile(v, np.linspace(0, 1, thresholds + 2)[1:-1]))
            order = np.argsort(v, kind="stable")
            below = np.searchsorted(v[order], marks, side="right")
            p_below = np.concatenate(([0], np.cumsum(target[order])))[below]
            for above in (True, False):
                p = p0 - p_below if above else p_below
                n = (len(v) - below if above else below) - p
                gain = np.where(p > 0, p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best and 0 < below[k] < len(v):
                    best, found = float(gain[k]), Condition(name, above, float(marks[k]))
        if found is None:
            break
        v = x[inside, FEATURES.index(found.name)]
        low, high = v[v <= found.threshold].max(), v[v > found.threshold].min()
        rule.append(Condition(found.name, found.above, float(low + high) / 2))  # the middle of the gap keeps a margin on both sides
        inside &= rule[-1].holds(x)
    return tuple(rule)


def worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = covered(rule, x)
    p, n = int(y[hit].sum()), int((~y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drop last conditions while that does not lower the worth on rows that growing has not seen."""
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k], x, y) >= worth(best, x, y):
            best = rule[:k]
    return best


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.98, least: int = 5, most_conditions: int = 4,
          most_rules: int = 20, thresholds: int = 63) -> list[Rule]:
    """Ordered rules whose conjunctions tell rows with ``y`` True; a rule must keep ``precision`` on unseen and on all rows."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and y[left & ~part].sum() >= least:
        rule = grow(x[left & ~part], y[left & ~part], most_conditions, thresholds)
        if not rule:
            break
        rule = prune(rule, x[left & part], y[left & part])
        hit = covered(rule, x) & left
        unseen = hit & part
        if hit.sum() < least or y[hit].mean() < precision or (unseen.any() and y[unseen].mean() < precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, 0 if none: one CASE WHEN over the statistics."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = 30_000) -> list[Rule]:
    """Rules for the rows labelled 0, learned from at most ``sample`` labelled rows that pass the fixed rules.

    The labelled ids with the smallest hash are taken, so the choice does not depend on partitions; the list of ids is no
    larger than ``sample`` and may be broadcast.
    """
    need(labels, id_col, label)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isNotNull() & F.col("_id").isNotNull())
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    rows = statistics(labelled, ["_id", "_y"], "_text").where(~base_failed()).select(
        "_id", "_y", *[feature(c).alias(c) for c in FEATURES]).collect()
    if not rows:
        return []
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), tuple(r)))
    x = np.array([[r[c] for c in FEATURES] for r in rows], float)
    return learn(x, np.array([r["_y"] == 0 for r in rows]))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the statistics, base_failed, rule (number of the learned rule that rejects, else 0) and kept."""
    return statistics(docs, keep, text).withColumns({"base_failed": base_failed(), "rule": decision(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
