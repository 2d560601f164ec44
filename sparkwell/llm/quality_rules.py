"""Quality rules: a learned decision list over structure statistics.

Sequential covering on labelled statistics: each rule is a conjunction of thresholds, grown greedily by FOIL's
gain on two thirds of the sample, pruned from its end on the other third, and kept while it stays precise; what it
covers is removed and the next rule is learned.  The list is emitted as one ordered Spark conditional expression.

Defined cases: a null or empty text has no words, so it fails the base rule; a null id gives a null id; repeated rows
each get a row; long texts are read whole; other columns are ignored.  A label goes to every row of its id; where labelled
rows are drawn to learn from, a row that repeats another counts once.  Without labelled rows of both classes the list
is empty and only the base rule decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.llm.common import free_prefix, slices, table, trim
from sparkwell.llm.quality_classifier import labelled_sample
from sparkwell.llm.text_stats import BASE, RATIOS, stats

FIT_ROWS = 6000
#: A rule rejects only if at least this share of what it covers, in growing and in pruning rows alike, has label 0.
PRECISION, LEAST_COVERED, MOST_TERMS, MOST_RULES, CUTS = 0.95, 3, 3, 24, 32
TRIES = 8
NAMES = BASE + RATIOS
#: Rules test ratios alone: a count says as much about a text's length as about its quality.
TESTED = RATIOS
MIN_WORDS, MOST_REPEATED = 50, 50

#: A term is (statistic, ">" or "<=", threshold); a rule is a list of terms.
Term = tuple[str, str, float]


def holds(x: np.ndarray, term: Term) -> np.ndarray:
    col = x[:, NAMES.index(term[0])]
    return col > term[2] if term[1] == ">" else col <= term[2]


def covered(x: np.ndarray, rule: list[Term]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for term in rule:
        out &= holds(x, term)
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> list[Term]:
    """Adds the threshold with the largest FOIL gain until only bad rows are covered."""
    rule: list[Term] = []
    live = np.ones(len(x), bool)
    while len(rule) < MOST_TERMS and bad[live].sum() and not bad[live].all():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        before, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name in TESTED:
            col, y = x[live, NAMES.index(name)], bad[live]
            cuts = np.unique(np.quantile(np.concatenate([col, col[y]]), np.linspace(0, 1, CUTS)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            for cut in cuts:
                above = col > cut
                for op, got in ((">", above), ("<=", ~above)):
                    p = (got & y).sum()
                    if p and (gain := p * (np.log2(p / got.sum()) - before)) > best[0] + 1e-9:
                        best = (gain, (name, op, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= holds(x, best[1])
    return rule


def prune(x: np.ndarray, bad: np.ndarray, rule: list[Term]) -> list[Term]:
    """The shortest beginning of the rule with the best (bad - good) / covered on rows that growing hasn't seen."""

    def worth(r):
        got = covered(x, r)
        return (2 * bad[got].mean() - 1) if got.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 5) -> list[list[Term]]:
    """x: a row of NAMES for each labelled text; bad: its label is 0.

    Rows are dealt anew to growing and pruning for each rule; covering ends when TRIES deals in a row give no rule that is
    precise on both parts.
    """
    if not bad.any() or bad.all():
        return []
    rng, failed = np.random.default_rng(seed), 0
    rules: list[list[Term]] = []
    left = np.ones(len(x), bool)
    while bad[left].sum() >= LEAST_COVERED and len(rules) < MOST_RULES and failed < TRIES:
        third = rng.permutation(len(x)) % 3 == 0
        rule = prune(x[left & third], bad[left & third], grow(x[left & ~third], bad[left & ~third]))
        got = covered(x, rule) & left
        if not rule or got.sum() < LEAST_COVERED or any(bad[s].mean() < PRECISION for s in (got & third, got & ~third) if s.any()):
            failed += 1
            continue
        failed = 0
        rules.append(rule)
        left &= ~got
    return rules


def condition(rule: list[Term], prefix: str = "") -> Column:
    out = F.lit(True)
    for name, op, cut in rule:
        c = F.col(prefix + name)
        out = out & (c > F.lit(cut) if op == ">" else c <= F.lit(cut))
    return out


def verdict(rules: list[list[Term]], prefix: str = "") -> Column:
    """1, 2, ...: the first rule that rejects the row; 0: none."""
    out = F.lit(0)
    for k in reversed(range(len(rules))):
        out = F.when(condition(rules[k], prefix), F.lit(k + 1)).otherwise(out)
    return out


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MOST_REPEATED * n)


def with_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with a column for each of NAMES, named with the prefix."""
    at = docs.columns.index(text_col)
    kinds = [T.LongType()] * len(BASE) + [T.DoubleType()] * len(RATIOS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, k) for n, k in zip(NAMES, kinds))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at):
                found = list(zip(*(stats(t) for t in part.column(at).to_pylist())))
                cols = [pa.array(c, pa.int64() if i < len(BASE) else pa.float64()) for i, c in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], schema.names)
        trim()

    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **columns) -> list[list[Term]]:
    """The rules from a bounded sample of the labelled rows; the tasks compute its statistics, and only those reach the driver."""
    sample = with_stats(labelled_sample(docs, labels, rows=rows, seed=23, **columns)).select("key", "y", *NAMES).collect()
    sample = sorted(map(tuple, sample))
    x = np.array([r[2:] for r in sample], np.float64).reshape(-1, len(NAMES))
    rules = learn_rules(x, np.array([r[1] == 0 for r in sample], bool))
    del sample, x
    trim()  # the driver goes on to other stages
    return rules


def apply_rules(docs: DataFrame, rules: list[list[Term]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the base statistics, base_failed, rule (the first that rejects, or 0), kept."""
    rows = with_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.select("doc_id", *BASE, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[list[Term]], text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the base rule and the list, with all their columns."""
    p = free_prefix(docs.columns)
    return with_stats(docs, text_col, p).where(~base_failed(p) & (verdict(rules, p) == 0)).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, learn(docs, table(spark, sf_dir, "labels")))
