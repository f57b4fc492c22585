"""Quality rules: document statistics as Spark expressions, and an ordered decision list learned from labels.

Statistics, thresholds and verdicts are DataFrame expressions only. The list is grown by sequential covering on a
bounded sample of labelled rows: a conjunction of thresholds is grown on two thirds of the sample, pruned on the other
third, kept if it is precise enough there, and the rows that it covers are set aside before the next one is grown. The
finished list is one ``CASE WHEN`` chain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "symbols_per_word",
)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (all long) in place of like-named columns.

    Words are runs of characters other than space and U+0009 to U+000D. ``n_repeat_words`` counts the words inside
    five-word windows that the text holds twice or more; window equality is decided by a 64-bit hash of the five words.
    All other input columns, whatever their names, pass through. A null or empty text has five zeros.
    """
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.coalesce(df[text_col], F.lit("")).alias("t"))
    spaced = F.translate("t", SPACES, " " * len(SPACES))
    words = packed.select("row", "t", F.filter(F.split(spaced, " ", -1), lambda w: w != "").alias("words"))
    sized = words.select("row", "t", "words", F.size("words").alias("n"))
    at = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    starts = F.when(F.col("n") >= WINDOW, F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    hashed = sized.select("row", "t", "n", F.transform(starts, at).alias("h"))
    # Only texts that repeat a window are sorted; the others have as many different hashes as windows.
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = hashed.select(
        "row", "t", "n",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(none).alias("s"),
    )
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    twice = ordered.select(
        "row", "t", "n",
        F.sort_array(
            F.transform(
                F.filter("s", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1)),
                lambda x: x["i"],
            )
        ).alias("p"),
    )
    covered = F.aggregate(
        F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = twice.select(
        "row", "n", "t", covered.alias("n_repeat_words"), lines.alias("lines")
    ).select(
        "row",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )
    made = counted.columns[1:]
    # A generator of one row: a filter on the statistics stays above it, instead of being evaluated with all of the
    # expressions above substituted into it.
    fenced = counted.select("row", F.explode(F.array(F.struct(*made))).alias("s"))
    return fenced.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in made], *[F.col("s")[c].alias(c) for c in made])


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    """A rule's statistic, as an expression over the five counts."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
    }[name]


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` if ``above``, else ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _tally(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if _covers(rule, r)]
    return sum(hit), len(hit)


def _cuts(rows: list[dict], name: str, n: int) -> list[float]:
    """Midpoints at up to ``n`` quantiles of a statistic."""
    values = sorted({r[name] for r in rows})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    if len(middles) <= n:
        return middles
    return [middles[i * (len(middles) - 1) // (n - 1)] for i in range(n)]


def _grow(rows: list[dict], first: str, n_cuts: int, max_conditions: int) -> Rule:
    """Add the condition of the highest information gain until no good row is covered; the first one is on ``first``."""
    rule: Rule = ()
    inside = rows
    while len(rule) < max_conditions and any(not r["bad"] for r in inside):
        p, n = sum(r["bad"] for r in inside), len(inside)
        best = (0.0, None)
        for name in FEATURES if rule else (first,):
            ranked = sorted((r[name], r["bad"]) for r in inside)
            below_p = below_n = k = 0
            for cut in _cuts(inside, name, n_cuts):
                while k < n and ranked[k][0] <= cut:
                    below_p, below_n, k = below_p + ranked[k][1], below_n + 1, k + 1
                for above, hp, hn in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                    if hp and hn < n:
                        gain = hp * (math.log2(hp / hn) - math.log2(p / n))
                        if gain > best[0] + 1e-12:
                            best = (gain, Condition(name, above, cut))
        if best[1] is None:
            break
        rule += (best[1],)
        inside = [r for r in inside if best[1].holds(r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drop trailing conditions while (bad - good) / covered on unseen rows does not fall."""
    def worth(r: Rule) -> float:
        p, n = _tally(r, rows)
        return (2 * p - n) / n if n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_rules(
    rows: list[dict], min_precision: float = 0.97, min_cover: int = 5, max_rules: int = 8, n_cuts: int = 64, max_conditions: int = 4
) -> list[Rule]:
    """Ordered rejecting rules from rows with the keys of :data:`FEATURES` and ``bad`` (0 or 1).

    Every third row prunes, the others grow. A rule is grown from each statistic; of those that cover ``min_cover`` bad
    rows and are as pure as ``min_precision`` on both parts, the one that covers most bad rows enters the list. The list
    ends where there is none. No rows, or one class only, give an empty list.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        best: tuple[int, Rule] = (0, ())
        for name in FEATURES:
            rule = _prune(_grow(grow, name, n_cuts, max_conditions), prune)
            p, n = _tally(rule, grow)
            q, m = _tally(rule, prune)
            if rule and p >= min_cover and p >= min_precision * n and q >= min_precision * m and p + q > best[0]:
                best = (p + q, rule)
        if not best[1]:
            break
        rules.append(best[1])
        grow, prune = [r for r in grow if not _covers(best[1], r)], [r for r in prune if not _covers(best[1], r)]
    return rules


def rejects(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, as a chain of conditions; null if none does."""
    chain = F
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        chain = chain.when(test, F.lit(k + 1))
    return chain.otherwise(F.lit(None).cast("int")) if rules else F.lit(None).cast("int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 3000) -> list[Rule]:
    """Learn the list from at most ``sample_rows`` labelled documents, those of the smallest id hashes.

    ``labels(doc_id, quality)``: 0 is bad. Rows with a null id or quality are passed over; of repeated labels of an id the
    lowest counts. The ids (``sample_rows`` at most) are broadcast, and as many rows of six numbers reach the driver.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.min("quality").alias("label_quality"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("label_text"))
    picked = texts.join(F.broadcast(chosen), "label_id")
    stats = with_statistics(picked, "label_text").where(~base_failed())
    rows = stats.select("label_id", (F.col("label_quality") == 0).cast("int").alias("bad"), *[feature(f).alias(f) for f in FEATURES])
    # an id may stand for many rows, so the bound is stated again
    bounded = rows.orderBy(F.xxhash64("label_id"), "label_id", *FEATURES).limit(sample_rows).collect()
    return learn_rules([r.asDict() for r in bounded])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 3000) -> DataFrame:
    """All columns of ``docs`` and the five statistics, ``base_failed``, ``rule`` (int, first rejecting rule) and ``kept``.

    One row per input row; columns of these names give way to those made here. A null or empty text has no words and fails
    the base rules. Null ids and repeated rows are judged like any others, and equal texts alike; without labels the list is
    empty, and an empty table gives an empty result. Nothing is shuffled but the labels.
    """
    rules = fit(docs, labels, id_col, text_col, sample_rows)
    made = ("base_failed", "rule", "kept")
    out = with_statistics(docs.drop(*made), text_col)
    judged = out.withColumns({"base_failed": base_failed(), "rule": rejects(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
