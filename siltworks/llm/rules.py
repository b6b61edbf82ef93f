"""Quality rules: text statistics and a learned decision list, in DataFrame functions alone.

The list is learned by sequential covering.  A rule grows one threshold at a time by information gain on two thirds of
the labelled rows and is pruned on the other third; rows it covers leave, and the next rule is grown.  Each step is one
grouped count over binned statistics, so only a table of bins (statistics x bins) reaches the driver, whatever the
number of labelled rows.  The result is an ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import WORD, crc32_mod, row_back, stored, text_of, whole_row

# Fixed: the symbols that n_symbols counts.
SYMBOLS = "[#*$%&|<>]"
BINS = 64
RATIOS = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "digit_share", "distinct_share", "word_length", "n_words")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares of `RATIOS`.

    A null text has no words; every share of an empty text is 0.  Whole texts are read, once.  Windows of three words
    are compared by 64-bit hashes within one text.  Statistics replace columns of the same name.
    """
    results = (*RATIOS, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", text)
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    a = docs.select(whole_row(docs), text_of(text).alias("_text"))
    a = a.withColumns({
        "_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)),
    })
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    a = a.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_distinct": F.size(F.array_distinct("_words")),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
        "_windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)),
        "n_symbols": count(SYMBOLS), "_upper": count(r"[A-Z\x{C0}-\x{DE}]"), "_marks": count("[!?]"), "_digits": count("[0-9]"),
        "_chars": F.length("_text"),
    })
    # only a text with a repeated window is sorted
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    a = a.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(pairs)))
    twice = F.filter("_sorted", lambda e, j: (e["h"] == F.get("_sorted", j - 1)["h"]) | (e["h"] == F.get("_sorted", j + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    a = a.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), 0).otherwise(covered).cast("long"))
    share = lambda x, of: F.coalesce(F.col(x) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    return a.select(
        *row_back(docs, results), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "n_words").alias("symbol_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("_upper", "word_chars").alias("upper_share"),
        share("_marks", "n_words").alias("mark_share"), share("_digits", "word_chars").alias("digit_share"),
        share("_distinct", "n_words").alias("distinct_share"), share("word_chars", "n_words").alias("word_length"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        verdict = None
        for rule in self.rules:
            hit = F.lit(True)
            for c in rule:
                hit = hit & c.column()
            verdict = F.when(hit, F.lit(False)) if verdict is None else verdict.when(hit, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def sql(self) -> str:
        lines = [f"WHEN {' AND '.join(map(str, r))} THEN false" for r in self.rules]
        return f"CASE {' '.join(lines)} ELSE true END" if lines else "true"


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """FOIL's gain of keeping p of p0 positives and n of n0 negatives."""
    return p * (math.log2((p + 1) / (p + n + 1)) - math.log2((p0 + 1) / (p0 + n0 + 1))) if p else 0.0


def learn(labelled: DataFrame, label: str = "label", key: str = "doc_id", features=RATIOS, most_rules: int = 12, most_conditions: int = 3, precision: float = 0.9, least: int = 5) -> DecisionList:
    """A list of rules that find label 0.

    Thresholds are the edges of up to `BINS` quantile bins of each statistic.  A rule stops growing when it covers no
    label 1 or has `most_conditions`; it is pruned from its end while that does not lower (p - n) / (p + n) on the
    pruning third.  A rule is taken if it covers at least `least` rows of label 0 and its share of label 0 over all labelled
    rows is at least `precision`; the first that fails ends the list.  Rows without label or statistics are left out;
    without any labelled row the list is empty.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 0).cast("int").alias("bad"), (crc32_mod(key, 3) == 0).alias("prune"), *[F.col(f).cast("double").alias(f) for f in features]
    ).dropna()
    rows = stored(rows, "labelled")
    quantiles = [k / BINS for k in range(1, BINS)]
    found = rows.select(*[F.percentile_approx(f, quantiles, 10000).alias(f) for f in features]).first()
    if found[0] is None:
        return DecisionList(())
    # the edges of rare, extreme values come from the rejected rows
    bad = rows.where("bad = 1").select(*[F.percentile_approx(f, quantiles, 10000).alias(f) for f in features]).first()
    edges = {f: sorted({*found[f], *(bad[f] or [])}) for f in features}
    # bin b: as many edges are <= the value, found by the sorted position of the value among them
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), lambda e: e <= F.col(f))).alias(f"bin_{f}")

    placed = rows.select("bad", "prune", *features, *[bin_of(f) for f in features])
    placed = stored(placed, "binned")

    def counts(df: DataFrame) -> dict:
        cells = df.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in features])).alias("c"))
        got = cells.groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        table: dict = {f: [[0, 0] for _ in range(len(edges[f]) + 1)] for f in features}
        for r in got:
            table[r["f"]][r["b"]] = [r["p"], r["n"]]
        return table

    def best(table: dict, p0: int, n0: int) -> tuple[float, Condition | None, int, int]:
        top: tuple = (0.0, None, p0, n0)
        for f in features:
            cells = table[f]
            p = n = 0
            for b in range(len(cells) - 1, 0, -1):  # value >= edges[b - 1]
                p, n = p + cells[b][0], n + cells[b][1]
                if (g := _gain(p0, n0, p, n)) > top[0] + 1e-9:
                    top = (g, Condition(f, True, float(edges[f][b - 1])), p, n)
            p = n = 0
            for b in range(len(cells) - 1):  # value < edges[b], written as <= the largest double below it
                p, n = p + cells[b][0], n + cells[b][1]
                if (g := _gain(p0, n0, p, n)) > top[0] + 1e-9:
                    top = (g, Condition(f, False, math.nextafter(float(edges[f][b]), -math.inf)), p, n)
        return top

    rules: list[tuple[Condition, ...]] = []
    rest = placed
    while len(rules) < most_rules:
        grow, rule = rest.where("not prune"), []
        while len(rule) < most_conditions:
            table = counts(grow)
            p0, n0 = (sum(c[k] for c in table[features[0]]) for k in (0, 1))
            if not p0 or not n0:
                break
            _, condition, p, n = best(table, p0, n0)
            if condition is None or (rule and p < least):
                break
            rule.append(condition)
            grow = grow.where(condition.column())
        if not rule:
            break
        # all heads of the rule in one pass, on the pruning rows and on all
        hits, sums = F.lit(True), []
        for k, c in enumerate(rule):
            hits = hits & c.column()
            for part, where in (("v", F.col("prune")), ("t", F.lit(True))):
                for x, bad_is in (("p", 1), ("n", 0)):
                    sums.append(F.count_if(hits & where & (F.col("bad") == bad_is)).alias(f"{part}{x}{k}"))
        got = rest.select(*sums).first()
        worth = [(got[f"vp{k}"] - got[f"vn{k}"]) / max(1, got[f"vp{k}"] + got[f"vn{k}"]) for k in range(len(rule))]
        keep = max(range(len(rule)), key=lambda k: (worth[k], -k))
        p, n = got[f"tp{keep}"], got[f"tn{keep}"]
        if p < least or p < precision * (p + n):
            break
        rules.append(tuple(rule[: keep + 1]))
        hit = F.lit(True)
        for c in rules[-1]:
            hit = hit & c.column()
        rest = rest.where(~hit)
    return DecisionList(tuple(rules))
