"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text (lengths, shares of kinds of characters, repetition, line shapes) are built-in column functions. On a
bounded sample of labelled rows, boosted trees of depth ``DEPTH`` are grown; every path from a root to a node is a conjunctive
rule. Logistic regression with a lasso penalty weighs the rules, most to zero, and the remaining ones are compiled into one
column expression: scoring is a scan, without Python or a shuffle.

Learning takes at most about ``SAMPLE_ROWS`` labelled rows, the first by a hash of the id (reruns agree); their ids are broadcast
to the scan that works out their statistics, and only numbers come to the driver. Rows with a null label are left out.
Repeated ids count as often as they match.

Null texts score like empty ones. Repeated rows each get their row. Extra columns are kept by ``score``. Without labelled rows
every score is 0.5; with one label only, that label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, with_steps

SAMPLE_ROWS = 6000
TREES, DEPTH, CUTS, LEAF = 16, 3, 24, 15
SHRINK = 0.4
LASSO = 0.001
THRESHOLD = 0.3


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with a struct column ``stats``: doubles, 0 where there is nothing to count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = with_steps(df, {"__text": text, "__words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), "__lines": F.filter(F.split(text, "\n"), lambda x: x != "")})
    words, lines = F.col("__words"), F.col("__lines")
    count = lambda pattern: F.regexp_count("__text", F.lit(pattern)).cast("double")
    df = with_steps(df, {
        "__n": F.length("__text").cast("double"),
        "__w": F.size(words).cast("double"),
        "__l": F.size(lines).cast("double"),
        "__again": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("double"),
        "__distinct": F.size(F.array_distinct(words)).cast("double"),
        "__lines_distinct": F.size(F.array_distinct(lines)).cast("double"),
        "__ended": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;\"')]\s*$"))).cast("double"),
        "__upper": count(r"\p{Lu}"),
        "__letters": count(r"\p{L}"),
        "__digits": count(r"[0-9]"),
        "__signs": count(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"),
        "__shouts": count(r"[!?]{2}"),
        "__bars": count(r"(?<![^\x20\n])[^\x20\w\n](?![^\x20\n])"),
    })
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    stats = {
        "chars": F.log1p("__n"),
        "words": F.log1p("__w"),
        "word_length": share("__n", "__w"),
        "distinct_words": share("__distinct", "__w"),
        "repeated_next": share("__again", "__w"),
        "upper": share("__upper", "__letters"),
        "letters": share("__letters", "__n"),
        "digits": share("__digits", "__n"),
        "signs": share("__signs", "__w"),
        "shouts": share("__shouts", "__w"),
        "lone_signs": share("__bars", "__w"),
        "line_length": share("__n", "__l"),
        "distinct_lines": share("__lines_distinct", "__l"),
        "ended_lines": share("__ended", "__l"),
    }
    kept = [c for c in df.columns if not c.startswith("__")]
    return with_steps(df, {"stats": F.struct(*[c.alias(k) for k, c in stats.items()])}).select(*[F.col(f"`{c}`") for c in kept], "stats")


#: (statistic, True for "above" or False for "at most", threshold) conditions that hold together.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of rules that hold)))"""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: str = "stats") -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for name, above, cut in rule:
                x = F.col(f"{stats}.{name}")
                one = x > cut if above else x <= cut
                holds = one if holds is None else holds & one
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def predict(self, names: list[str], x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * holds(rule, names, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        column = x[:, names.index(name)]
        out &= column > cut if above else column <= cut
    return out


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], names: list[str]) -> tuple[list[Rule], np.ndarray]:
    """(paths to all nodes below the root, the tree's step for every row) by second-order gain."""
    paths: list[Rule] = []
    step = np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        step[rows] = g / (h + 1)
        if len(path) == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-6, None)
        for f, values in enumerate(cuts):
            below = x[rows, f][:, None] <= values
            n, gl, hl = below.sum(0), grad[rows] @ below, hess[rows] @ below
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, float(values[gain.argmax()])))
        if best[1] is None:
            return
        f, cut = best[1]
        for above in (False, True):
            mine = rows[(x[rows, f] > cut) == above]
            longer = (*path, (names[f], above, cut))
            paths.append(longer)
            grow(mine, longer)

    grow(np.arange(len(x)), ())
    return paths, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean log-loss + penalty * |w|; the bias is free."""
    design = np.hstack([z, np.ones((len(z), 1))])
    rate = 4 * len(z) / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    w = v = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ v, -35, 35)))
        new = v - rate * (design.T @ (p - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = new + (last - 1) / t * (new - w)
        w = new
    return float(w[-1]), w[:-1]


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, their paths as rules, and lasso weights."""
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(20.0 if y[0] else -20.0, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    # rare values matter too: quantiles of what lies outside the middle
    cuts = [np.unique(np.concatenate([c, np.quantile(x[:, f], [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998])])) for f, c in enumerate(cuts)]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        paths, step = _tree(x, y - p, p * (1 - p), cuts, names)
        rules |= dict.fromkeys(tuple(sorted(r)) for r in paths)
        total += SHRINK * step
    rules = list(rules)
    z = np.array([holds(r, names, x) for r in rules], float).reshape(len(rules), len(y)).T
    bias, weights = _lasso(z, y.astype(float), LASSO)
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-3))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """A model of label_col (0 or 1) from the rows of labels, which hold what may be learnt from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y"))
    every = max(1, -(-known.count() // SAMPLE_ROWS))
    key = F.xxhash64("__id", F.lit("quality"))
    sample = known.where(F.pmod(key, F.lit(every)) == 0).orderBy(key, "__id", "__y").limit(2 * SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("__key") == F.col("__id")).select("text", F.col("__y").alias("y"), F.col("__key").alias("key"))
    found = with_statistics(rows).select("key", "y", "stats.*")
    found = found.orderBy(*found.columns).limit(4 * SAMPLE_ROWS).toPandas()
    found = found.sort_values(list(found.columns), kind="stable")
    names = list(found.columns[2:])
    return fit_rules(names, found[names].to_numpy(float), found["y"].to_numpy(int))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1, higher is better), in place of a column of that name."""
    rows, at = by_place(docs)
    scored = with_statistics(rows, at[text_col])
    return scored.select(*[F.col(v).alias(c) for c, v in at.items() if c != score_col], model.column().alias(score_col))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with the columns of docs, whatever they are called."""
    rows, at = by_place(docs)
    kept = score(rows, model, at[text_col]).where(F.col("score") >= threshold)
    return kept.select(*[F.col(v).alias(c) for c, v in at.items()])
