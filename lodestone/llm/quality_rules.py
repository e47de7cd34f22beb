"""Quality rules: a decision list learned by sequential covering, in DataFrame expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, durable, fresh, small

SPACE = r"[\x20\x09-\x0D]+"
MOST_RULES = 8
MOST_CONDITIONS = 3
CUTS = 24
#: Part of the covered labelled rows that must be bad, both where a rule is grown and where it is pruned.
LEAST_PRECISION = 0.9
#: Labelled rows that a rule must cover in each of the two parts.
LEAST_ROWS = 5


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, given a hash for each window.

    Windows are equal if that hash and another one are, 96 bits in all. Texts without two equal hashes never get here.

    Windows are sorted by hash, those equal to a neighbour are kept by position, and one pass adds up what they cover.
    """
    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
        step = lambda s, x: F.struct((x + 5).alias("end"), (s["sum"] + x + 5 - F.greatest(s["end"], x)).alias("sum"))
        return F.aggregate(at, zero, step, lambda s: s["sum"])

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce((F.get(s, k)["h"] == x["h"]) & (F.get(s, k)["g"] == x["g"]), F.lit(False))
        places = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["p"]))
        return F.array_sort(F.filter(places, lambda p: p.isNotNull()))

    other = lambda p: F.hash(*[F.get(words, p + j) for j in range(5)])
    windows = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), other(p).alias("g"), p.cast("long").alias("p"))))
    return bind(bind(windows, repeated), covered)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``stats``: struct of counts over the whole text; null and empty texts count zero everywhere.

    Words are runs without ASCII white space. Windows are compared by hashes of their five words: 64 bits, and 32 more
    where these are equal.
    """
    t, words, hashes, out = fresh(docs, "text_or_empty"), fresh(docs, "words"), fresh(docs, "windows"), fresh(docs, "stats")
    rows = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    bare = F.btrim(F.col(t), F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn(words, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    w = F.col(words)
    window = lambda k: F.xxhash64(*[F.get(w, k + j) for j in range(5)])
    rows = rows.withColumn(hashes, F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), window)).otherwise(F.array().cast("array<long>")))
    h = F.col(hashes)
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("long").alias(name)
    kept = lambda pattern: F.length(F.regexp_replace(F.col(t), pattern, ""))
    stats = F.struct(
        long(F.size(w), "n_words"), long(kept(SPACE), "word_chars"), long(kept(r"[^#*$%&|<>]+"), "n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated_words(w, h)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        long(kept(r"[^A-Z]+"), "n_capitals"), long(kept(r"[^0-9]+"), "n_digits"), long(kept(r"[^.,;:!?]+"), "n_marks"),
        long(F.size(F.array_distinct(w)), "n_distinct_words"), bind(lines, F.size).cast("long").alias("n_lines"),
    )
    # one row each: filters on the statistics stay above, instead of computing them anew below for each condition
    return rows.select(*docs.columns, F.explode(F.array(stats)).alias(out))


def ratios(s: Column) -> dict[str, Column]:
    """The statistics that rules may test: counts and their shares, defined (0) for empty texts too."""
    share = lambda a, b: F.coalesce(s[a] / F.when(s[b] > 0, s[b]), F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"),
        "digits": share("n_digits", "word_chars"), "marks": share("n_marks", "n_words"), "distinct_words": share("n_distinct_words", "n_words"), "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def expr(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    rows: int

    def expr(self) -> str:
        return " AND ".join(c.expr() for c in self.conditions)


def _counts(cells: DataFrame, names: list[str]) -> dict:
    """(feature, bin, prune, bad) -> rows; at most features * (CUTS + 1) * 4 rows reach the driver."""
    stacked = cells.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names])).alias("x"), "prune", "bad", "n")
    rows = stacked.groupBy("x.f", "x.b", "prune", "bad").agg(F.sum("n").alias("n")).collect()
    return {(r.f, r.b, r.prune, r.bad): r.n for r in rows}


def _covered(counts: dict, feature: str, above: bool, b: int, prune: int) -> tuple[int, int]:
    """(bad, good) rows whose bin of ``feature`` is above ``b``, or not above."""
    of = lambda bad: sum(n for (f, k, p, y), n in counts.items() if f == feature and p == prune and y == bad and (k > b) == above)
    return of(1), of(0)


def learn_rules(labelled: DataFrame, names: list[str], bad: str = "bad", key: str = "doc_id", most_rules: int = MOST_RULES) -> list[Rule]:
    """An ordered list of threshold conjunctions that find bad rows, by sequential covering.

    Every labelled row takes part: its statistics are cut into quantile bins and equal rows are counted together; each
    step is one grouped count over those cells. Half of the rows (by a hash of ``key``) grow a rule by the gain of its
    next condition, the other half prune its last conditions and decide on it; then what it covers is removed.
    Without labels, or without a rule that is precise enough in both halves, the list is empty. A repeated row counts
    again.
    """
    quantiles = labelled.agg(*[F.percentile_approx(f, [k / (CUTS + 1) for k in range(1, CUTS + 1)], 2000).alias(f) for f in names]).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in names}
    if not any(cuts.values()):
        return []
    binned = [F.expr(" + ".join(["0", *[f"IF({f} > {c!r}D, 1, 0)" for c in cuts[f]]])).alias(f) for f in names]
    prune = (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 2).cast("int").alias("prune")
    cells = durable(labelled.select(*binned, prune, F.col(bad).cast("int").alias("bad")).groupBy(*names, "prune", "bad").agg(F.count("*").alias("n")), "cells")
    rules: list[Rule] = []
    left = cells
    while len(rules) < most_rules:
        inside, grown = left, []
        while len(grown) < MOST_CONDITIONS:
            counts = _counts(inside, names)
            n_bad, n_good = (sum(n for (f, _, p, y), n in counts.items() if f == names[0] and p == 0 and y == v) for v in (1, 0))
            if not n_bad or n_bad / (n_bad + n_good) >= 0.995:
                break
            best = None
            for f in names:
                for b in range(len(cuts[f])):
                    for above in (True, False):
                        p, g = _covered(counts, f, above, b, 0)
                        if p >= LEAST_ROWS:
                            lift = (p / (p + g)) / (n_bad / (n_bad + n_good))
                            gain = p * math.log2(lift)
                            if best is None or gain > best[0]:
                                best = (gain, f, above, b, _covered(counts, f, above, b, 1))
            if best is None or best[0] <= 0:
                break
            _, f, above, b, held = best
            grown.append((Condition(f, above, cuts[f][b]), b, held))
            inside = inside.where(F.col(f) > b if above else F.col(f) <= b)
        # prune: the prefix of conditions that is best on the other half
        best = None
        for k in range(1, len(grown) + 1):
            p, g = grown[k - 1][2]
            if p >= LEAST_ROWS and p / (p + g) >= LEAST_PRECISION and (best is None or p - 4 * g > best[0]):
                best = (p - 4 * g, k, p, g)
        if best is None:
            break
        _, k, p, g = best
        rules.append(Rule(tuple(c for c, _, _ in grown[:k]), p / (p + g), p + g))
        hit = None
        for c, b, _ in grown[:k]:
            one = F.col(c.feature) > b if c.above else F.col(c.feature) <= b
            hit = one if hit is None else hit & one
        left = left.where(~hit)
    return rules


def rule_expression(rules: list[Rule]) -> str:
    """The ordered list as one Spark expression: the number of the first rule that fires, else 0."""
    return "CASE " + " ".join(f"WHEN {r.expr()} THEN {k}" for k, r in enumerate(rules, 1)) + " ELSE 0 END" if rules else "0"


def _judged(scored: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, list[Rule]]:
    """``scored`` (judged: the key, stats) with base_failed, rule and kept."""
    f = ratios(F.col("stats"))
    names = list(f)
    rows = scored.select("judged", "stats", *[c.alias(n) for n, c in f.items()])
    marks = labels.where(F.col("quality").isNotNull()).select(F.col(key).alias("marked"), (F.col("quality") == 0).alias("bad"))
    rules = learn_rules(rows.join(marks, F.col("judged") == F.col("marked")), names, key="judged")
    s = F.col("stats")
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    rows = rows.withColumn("base_failed", failed).withColumn("rule", F.expr(rule_expression(rules)))
    return rows.select(F.col("judged").alias(key), "stats", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")), rules


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, list[Rule]]:
    """(key, stats, base_failed, rule, kept) for every row of ``docs``, and the rules learned from ``labels``.

    Base rules (too few words, too many repeated words) reject first, then the learned list does; ``rule`` is the
    number of the rule that fired, 0 for none. ``labels`` has ``key`` and ``quality`` (0 is bad; null is ignored). Rows
    without labels are judged alike; rows with a null key are judged but teach nothing. Repeated rows are kept.
    """
    stats = text_statistics(docs.select(key, text), text)
    return _judged(durable(stats.select(F.col(key).alias("judged"), F.col(stats.columns[-1]).alias("stats")), "stats"), labels, key)


#: So many labelled ids may be broadcast to pick the labelled documents; with more, they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, all columns as they are.

    The list is learned from the labelled rows' statistics and applied in place, so that texts aren't shuffled; the
    statistics of labelled rows are computed twice, which is less than writing all texts once more.
    """
    mark = fresh(docs, "marked")
    ids = labels.where(F.col("quality").isNotNull()).select(F.col(key).alias(mark)).distinct()
    labelled = docs.join(small(ids, BROADCAST_LABELS), F.col(key) == F.col(mark), "left_semi")
    _, rules = judge_quality(labelled, labels, text, key)
    rows = text_statistics(docs, text)
    stats = rows.columns[-1]
    rows = rows.withColumn(fresh(rows, "tests"), F.struct(*[c.alias(n) for n, c in ratios(F.col(stats)).items()]))
    tests, s = rows.columns[-1], F.col(stats)
    fired = F.lit(False)
    for r in rules:
        hit = F.lit(True)
        for c in r.conditions:
            hit = hit & (F.col(tests)[c.feature] > c.cut if c.above else F.col(tests)[c.feature] <= c.cut)
        fired = fired | hit
    return rows.where((s["n_words"] >= 10) & (100 * s["n_repeat_words"] <= 20 * s["n_words"]) & ~fired).select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents with all quality labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, _ = judge_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("stats")
    return rows.select("doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule")
