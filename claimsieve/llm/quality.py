"""Text quality by a sparse rule ensemble.

Small trees over text statistics are grown on a bounded sample of labelled rows. Every path from a root to a
node is a rule: a conjunction of comparisons. A lasso-penalised logistic regression weighs rules and statistics
and sets most weights to zero. What is left is one column expression, so scoring is a projection over
the scan: no shuffle, no Python, no model object.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import packed, remainder, text_or_empty, unpacked
from claimsieve.llm.labels import labelled_sample, row_weight, times
from claimsieve.operators.layout import reliable

ROWS_PER_CLASS = 10_000
TREES = 24
DEPTH = 3
PENALTY = 0.002
THRESHOLD = 0.7
MODULUS, HELD_OUT = 4, 2
#: One comparison: statistic, whether it must be at most the bound, bound.
Rule = tuple[tuple[str, bool, float], ...]


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a text, all finite. ``words`` must be a plain column: a lambda would split the text per word."""
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    repeats = F.size(F.filter(words, lambda w, i: (w == F.get(words, i - 1))))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {
        "log_words": F.log1p(n_words),
        "word_length": n_chars / n_words,
        "distinct_share": F.size(F.array_distinct(words)) / n_words,
        "repeat_share": repeats / n_words,
        "symbol_share": count(r"[#$%&*+/<=>@\\^_`{|}~]") / n_chars,
        "shout_share": count("[!?]") / n_words,
        "capital_share": count("[A-Z]") / n_chars,
        "digit_share": count("[0-9]") / n_chars,
        "stop_share": count("[.,;:]") / n_words,
        "line_share": count("\n") / n_words,
    }


STATISTICS = (
    "log_words word_length distinct_share repeat_share symbol_share shout_share capital_share digit_share "
    "stop_share line_share"
).split()


def stat(name: str) -> Column:
    return F.col(f"stats_of_row.{name}")


def with_statistics(df: DataFrame) -> DataFrame:
    """``stats_of_row``: all statistics of a text.

    The struct passes through a generator, which no filter and no projection is merged with: otherwise the
    optimizer would put the text expressions in the place of every use, once per comparison of every rule.
    """
    rows = df.withColumn("words_of_row", words_of(text_or_empty(df)))
    stats = statistics(F.coalesce("text", F.lit("")), F.col("words_of_row"))
    row = F.array(F.struct(*[c.alias(n) for n, c in stats.items()]))
    return rows.select(*df.columns, F.explode_outer(row).alias("stats_of_row"))


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The paths of a printed tree: one rule per node below the root."""
    rules, path = [], []
    for line in description.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line)
        if m:
            level = len(m[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, (names[int(m[3])], m[4] == "<=", float(m[5]))))
            rules.append(tuple(step for _, step in path))
    return rules


def simplified(rule: Rule) -> Rule:
    """The tightest bound per statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, below, bound in rule:
        old = bounds.get((name, below))
        bounds[name, below] = bound if old is None else min(old, bound) if below else max(old, bound)
    return tuple(sorted((n, b, v) for (n, b), v in bounds.items()))


def holds(rule: Rule) -> Column:
    condition = F.lit(True)
    for name, below, bound in rule:
        condition = condition & (stat(name) <= bound if below else stat(name) > bound)
    return condition


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[str, float, float, float], ...]  # statistic, low, high, weight: clipped to [low, high]

    def score(self) -> Column:
        """Probability of label 1, over the columns of :func:`with_statistics`."""
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            margin = margin + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
        for name, low, high, weight in self.linear:
            margin = margin + weight * clipped(name, low, high)
        return 1.0 / (1.0 + F.exp(-margin))


def clipped(name: str, low: float, high: float) -> Column:
    """A statistic cut to its usual range and scaled to 0..1."""
    value = F.least(F.greatest(stat(name), F.lit(low)), F.lit(high))
    return (value - low) / (high - low)


def fit_rules(
    sample: DataFrame, whole: dict[int, int], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY
) -> RuleModel:
    """Rules and weights from (text, label), which stand for ``whole`` rows of each label.

    With no row, or one label only, a constant model."""
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (whole.get(1, 0) + 1) / (sum(whole.values()) + 2)
        return RuleModel(math.log(share / (1 - share)), (), ())
    weight = row_weight(times(whole, counts)).alias("weight")
    data = reliable(with_statistics(sample).drop("text"))
    flat = data.select("label", weight, *[stat(n).alias(n) for n in STATISTICS])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(flat)
    forest = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="0.5", subsamplingRate=0.7, minInstancesPerNode=5
    ).fit(vectors)
    rules = sorted({simplified(r) for tree in forest.trees for r in tree_rules(tree.toDebugString, STATISTICS)})
    ends = flat.approxQuantile(list(STATISTICS), [0.02, 0.98], 0.001)
    ranges = [(n, low, high) for n, (low, high) in zip(STATISTICS, ends, strict=True) if high > low]
    columns = [holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    columns += [clipped(*x).alias(f"s{i}") for i, x in enumerate(ranges)]
    names = [f"r{i}" for i in range(len(rules))] + [f"s{i}" for i in range(len(ranges))]
    table = VectorAssembler(inputCols=names, outputCol="features").transform(data.select("label", weight, *columns))
    lasso = LogisticRegression(labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    fitted = lasso.fit(reliable(table.select("label", "weight", "features")))
    weights = fitted.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights[: len(rules)], strict=True) if abs(w) > 1e-9)
    linear = tuple((*x, float(w)) for x, w in zip(ranges, weights[len(rules) :], strict=True) if abs(w) > 1e-9)
    return RuleModel(float(fitted.intercept), kept, linear)


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> RuleModel:
    """The model for ``labels.quality``, from rows outside the held-out remainder.

    At most ``rows_per_class`` rows of each label are used, weighted by the rows they stand for, so scores keep to
    the shares of all labelled rows.
    """
    return fit_rules(*labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, rows_per_class))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Null and empty texts are scored as an empty text. A null doc_id is never held out. Columns of
    ``docs`` that carry the names of the added columns are replaced.
    """
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    held_out = F.coalesce(remainder(docs["doc_id"], MODULUS) == HELD_OUT, F.lit(False))
    rows = with_statistics(docs.select(packed(docs, rest), held_out.alias("held_out"), docs["text"].alias("text")))
    rows = rows.select("row", "held_out", model.score().alias("score")).select(*unpacked(rest), "held_out", "score")
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
