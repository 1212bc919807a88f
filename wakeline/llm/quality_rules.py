"""Quality rules: decision lists learned from labelled statistics, applied as Spark conditionals.

``text_statistics`` turns each text into counts, natively. ``learn_rules`` runs
sequential covering over the labelled rows: a rule for the rejected class grows
condition by condition (FOIL gain over quantile thresholds, two thirds of the
rows), is pruned from its end on the remaining third, and is accepted while its
precision there holds; the rows it covers leave, and the next rule is grown.
Each step is one grouped count over all labelled rows, so what reaches the
driver is ``features x thresholds`` counts whatever the input. ``verdict``
emits the ordered list as one ``CASE WHEN``.

Defined results: a null or empty text has no words (and fails the base rule);
repeated rows are judged one by one; labels that are null or not 0/1 are
ignored, and a document labelled both ways counts as rejected; without labels
the list is empty and only the base rule rejects; other columns of the inputs
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, bind, fence, materialise, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Candidate thresholds: these quantiles of each feature, per class.
QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
FEATURES = ["n_words", "mean_word", "symbol_rate", "bang_rate", "upper_rate", "repeat_rate", "dup_line_rate", "distinct_rate"]


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``precision`` and ``covered`` are of the rows held back for pruning."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return _all(self.conditions)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeated(words: Column, n: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text.

    Window hashes without a repeat (most texts) settle it; otherwise the windows
    with repeated hashes are compared as strings, sorted next to their equals,
    and the covered words counted from the sorted positions.
    """

    def text_of(i: Column) -> Column:
        return F.concat_ws(" ", F.slice(words, i + 1, WINDOW))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(positions), start, step, lambda s: s["n"])

    def twins(rows: Column) -> Column:
        """Positions of the rows whose key equals a neighbour's; rows are sorted (key, position) structs."""
        same = lambda r, i: (F.get(rows, i - 1)["k"] == r["k"]) | (F.get(rows, i + 1)["k"] == r["k"])
        return F.transform(F.filter(rows, lambda r, i: F.coalesce(same(r, i), F.lit(False))), lambda r: r["p"])

    def slow(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("p"))))
        maybe = bind(by_hash, twins)
        by_text = bind(F.sort_array(F.transform(maybe, lambda p: F.struct(text_of(p).alias("k"), p.alias("p")))), twins)
        return covered(by_text)

    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    found = bind(window, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), slow(h)).otherwise(F.lit(0)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(found)


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and the statistics of each text; one row per input row, no shuffle."""
    keep = ["doc_id"] if keep is None else keep
    t = F.col("_text")
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    base = base.withColumn("_words", words_of(t)).withColumn("_n", F.size("_words"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: _without(x, SEPARATORS) > 0)
    base = base.withColumn("_lines", lines)
    n, w = F.col("_n"), F.col("_words")
    base = base.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        _without(t, SEPARATORS).cast("long").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(w, n).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length(t) - _without(t, "!")).cast("long").alias("n_bangs"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
    )
    return base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def with_features(stats: DataFrame) -> DataFrame:
    """Adds the rates that rules may test; a rate over nothing is 0. ``n_words`` is a count already."""
    rate = lambda a, b: F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)).cast("double"), F.lit(0.0))
    return stats.withColumns(
        {
            "mean_word": rate("word_chars", "n_words"),
            "symbol_rate": rate("n_symbols", "word_chars"),
            "bang_rate": rate("n_bangs", "n_words"),
            "upper_rate": rate("n_upper", "word_chars"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "distinct_rate": rate("n_distinct", "n_words"),
        }
    )


def labelled_statistics(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Features of the labelled rows that pass the base rule, with ``bad`` and the fold kept for pruning."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col(f"`{label}`").alias("_y")).where("_id is not null and _y in (0, 1)")
    y = y.groupBy("_id").agg((F.min("_y") == 0).alias("bad"))
    joined = with_features(fence(stats).where(~F.col("base_failed") & (F.col("_fence") >= 0))).join(y, F.col("doc_id") == F.col("_id"))
    return joined.select(*[F.col(f).cast("double").alias(f) for f in FEATURES], "bad", (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("prune"))


def learn_rules(rows: DataFrame, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Sequential covering over ``labelled_statistics``; deterministic for given rows."""
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(f, QUANTILES, 10_000).alias(f) for f in FEATURES]).collect()
    grid = {f: sorted({float(x) for r in cuts for x in (r[f] or [])}) for f in FEATURES}
    found: list[Rule] = []
    left = rows
    while len(found) < max_rules:
        grown: tuple[Condition, ...] = ()
        trail: list[tuple[int, int]] = []  # prune-fold (bad, good) after each condition
        while len(grown) < max_conditions:
            best = _best_condition(left.where(_all(grown)), grid, min_covered)
            if best is None:
                break
            grown += (best[0],)
            trail.append(best[1])
            if best[2]:
                break
        if not grown:
            break
        worth = [(bad - good) / (bad + good) if bad + good else -1.0 for bad, good in trail]
        size = max(range(len(trail)), key=lambda i: (round(worth[i], 6), -i)) + 1
        bad, good = trail[size - 1]
        if bad + good < min_covered or bad / (bad + good) < min_precision:
            break
        found.append(Rule(grown[:size], bad / (bad + good), bad + good))
        left = left.where(~found[-1].column())
    return found


def _best_condition(rows: DataFrame, grid: dict[str, list[float]], min_covered: int):
    """The condition of most FOIL gain, its prune-fold counts, and whether no good grow row is left."""
    def level(f: str, cut: list[float]) -> Column:
        passed = F.filter(F.array(*[F.lit(x) for x in cut]), lambda x: x <= F.col(f)) if cut else F.array()
        return F.struct(F.lit(f).alias("f"), F.size(passed).alias("b"))

    counts = rows.select(F.explode(F.array(*[level(f, cut) for f, cut in grid.items()])).alias("x"), "bad", "prune").groupBy("x.f", "x.b", "bad", "prune").count().collect()
    cells = {(r["f"], r["b"], r["bad"], r["prune"]): r["count"] for r in counts}
    best = None
    for f, cut in grid.items():
        total = {(y, s): sum(cells.get((f, b, y, s), 0) for b in range(len(cut) + 1)) for y in (True, False) for s in (True, False)}
        p0, n0 = total[True, False], total[False, False]
        if not p0 or not n0:
            continue
        for i, x in enumerate(cut, 1):
            high = {k: sum(cells.get((f, b, *k), 0) for b in range(i, len(cut) + 1)) for k in total}
            for up in (True, False):
                side = high if up else {k: total[k] - high[k] for k in total}
                p, n = side[True, False], side[False, False]
                if p < min_covered:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(f, up, x), (side[True, True], side[False, True]), n == 0)
    return best and best[1:]


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, 0 where none does; the base rule is -1."""
    out = F.when(F.col("base_failed"), F.lit(-1))
    for i, r in enumerate(rules, 1):
        out = out.when(r.column(), F.lit(i))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` and ``kept`` per document; texts are read once."""
    stats = materialise(text_statistics(docs), "quality-stats")
    rules = learn_rules(materialise(labelled_statistics(stats, labels), "quality-labelled"))
    judged = with_features(stats).withColumn("rule", verdict(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("rule") == 0).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; statistics are made once and written beside what the base rule keeps."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), F.col("text").alias("_body"))
    stats = fence(text_statistics(own, text="_body", keep=["_own"])).where(~F.col("base_failed") & (F.col("_fence") >= 0)).drop("_fence")
    stats = materialise(stats, "quality-documents")
    rules = learn_rules(materialise(labelled_statistics(stats.withColumn("doc_id", F.col("_own.doc_id")).drop("_own"), labels), "quality-labelled"))
    return with_features(stats).where(verdict(rules) == 0).select("_own.*")
