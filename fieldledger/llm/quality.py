"""A sparse rule ensemble that scores text quality.

Statistics of a text are plain column expressions. Shallow trees are grown over the
statistics of labelled rows; every path from a root to a node becomes a rule, a conjunction
of bounds. A logistic model with an L1 penalty weighs the rules, most of them by zero, and
what is left is compiled into one column expression, so scoring is a projection.

Statistics cover every whole text. The model is fitted on at most `train_rows` labelled
rows, drawn by a hash of the id. A row is held out of fitting if crc32 of its id mod 4 is 2.

Defined results: null and empty texts have all statistics 0; a null id is never held out
and matches no label; ids with contradictory labels, and labels other than 0 and 1, are not
used; without labels of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import WHITE, free_name, staged, table, whole_text

TRAIN_ROWS = 50_000
TREES, DEPTH, BINS, PENALTY = 24, 3, 64, 0.0005
# The rows of a fit are bounded, and so are the tasks of its many short passes.
FIT_TASKS = 8
ACCEPT = 0.7
SHORT_WORD = 3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text that do not name its language, source or id."""
    text = whole_text(text)
    chars = F.char_length(text)
    words = F.filter(F.split(text, f"{WHITE}+"), lambda word: word != "")
    n_words = F.size(words)
    lines = F.split(text, "\n")
    per_char, per_word = F.greatest(chars, F.lit(1)), F.greatest(n_words, F.lit(1))

    def share(pattern: str) -> Column:
        return (chars - F.char_length(F.regexp_replace(text, pattern, ""))) / per_char

    short = F.size(F.filter(words, lambda word: F.char_length(word) <= SHORT_WORD))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": chars / per_word,
        "symbols": share(r"[^\p{L}\p{N}\s]+"),
        "rare_symbols": share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "short_words": short / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": n_words / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """True where every statistic lies within its bounds: above the low, up to the high."""

    bounds: tuple[tuple[str, float, float], ...]

    def expression(self) -> Column:
        tests = []
        for name, low, high in self.bounds:
            if low > float("-inf"):
                tests.append(F.col(name) > low)
            if high < float("inf"):
                tests.append(F.col(name) <= high)
        return reduce(lambda a, b: a & b, tests).cast("double")


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept, on the log-odds scale."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        terms = [F.lit(self.intercept)]
        terms += [rule.expression() * F.lit(weight) for rule, weight in self.rules]
        while len(terms) > 1:  # a shallow tree of sums
            pairs = zip(terms[::2], terms[1::2], strict=False)
            terms = [a + b for a, b in pairs] + ([terms[-1]] if len(terms) % 2 else [])
        return 1 / (1 + F.exp(-terms[0]))


def tree_rules(root, names: list[str]) -> set[Rule]:
    """The path to every node below the root of a fitted tree."""
    rules, open_nodes = set(), [(root, {})]
    while open_nodes:
        node, bounds = open_nodes.pop()
        if bounds:
            rules.add(Rule(tuple((n, *bounds[n]) for n in sorted(bounds))))
        if node.getClass().getSimpleName() == "InternalNode":
            name, cut = names[node.split().featureIndex()], node.split().threshold()
            low, high = bounds.get(name, (float("-inf"), float("inf")))
            open_nodes.append((node.leftChild(), {**bounds, name: (low, min(high, cut))}))
            open_nodes.append((node.rightChild(), {**bounds, name: (max(low, cut), high)}))
    return rules


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def clear_labels(labels: DataFrame) -> DataFrame:
    """One label per id, where its rows agree."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    found = known.groupBy("doc_id").agg(
        F.min("quality").cast("double").alias("label"), F.max("quality").alias("most")
    )
    return found.where(F.col("label") == F.col("most")).drop("most")


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleModel:
    """`stats` has `doc_id` and the statistics; `labels` has `doc_id` and `quality`."""
    names = [name for name in stats.columns if name != "doc_id"]
    known = stats.where(~held_out(F.col("doc_id"))).join(clear_labels(labels), "doc_id")
    known = staged(known, "quality-train")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        odds = (ones + 1) / (n - ones + 1)
        return RuleModel(math.log(odds), ())
    if n > train_rows:
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(n)) < train_rows
        known = known.where(drawn)
    known = known.coalesce(FIT_TASKS)
    vectors = known.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=9, featureSubsetStrategy="sqrt"
    ).fit(vectors)
    found = set()
    for tree in forest.trees:
        found |= tree_rules(tree._call_java("rootNode"), names)
    rules = sorted(found, key=lambda rule: rule.bounds)
    fired = known.select(
        "label", array_to_vector(F.array(*[rule.expression() for rule in rules])).alias("features")
    )
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(
        staged(fired, "quality-rules").coalesce(FIT_TASKS)
    )
    weighed = zip(rules, lasso.coefficients.toArray().tolist(), strict=True)
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in weighed if w))


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score; one pass over the texts."""
    stats = staged(text_statistics(docs), "quality-stats")
    score = fit(stats, labels).score()
    return stats.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is high enough, in their own columns."""
    stats = staged(text_statistics(docs), "quality-stats")
    model = fit(stats, labels)
    names = {name: free_name(docs, name) for name in stats.columns if name != "doc_id"}
    scored = docs.withColumns({names[n]: c for n, c in statistics(F.col("text")).items()})
    return scored.where(renamed(model, names).score() >= ACCEPT).select(*docs.columns)


def renamed(model: RuleModel, names: dict[str, str]) -> RuleModel:
    """The model over statistics that bear other names."""
    rules = tuple(
        (Rule(tuple((names[n], low, high) for n, low, high in rule.bounds)), weight)
        for rule, weight in model.rules
    )
    return RuleModel(model.intercept, rules)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
