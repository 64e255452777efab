"""Quality classifier: a sparse ensemble of rules over text statistics.

``statistics`` are Spark columns over whole texts. Small trees, boosted on the logistic loss, are grown on a bounded
sample of labelled rows (``SAMPLE_ROWS``, the first by a hash of the id); every path from a root to a node is a
conjunctive rule; a logistic regression with a lasso penalty keeps few of them; and the kept rules are compiled into
one Spark column that scores every row without Python.

Rows whose crc32 of the id modulo 3 is 1 are held out: their labels aren't read. Labels, language, source and id are no
inputs of a score.

Defined cases: a null text is the empty text, whose statistics are all 0; null labels aren't used; repeated rows
count as often as they occur; a row without an id isn't held out and has no label; a very long text is read whole, only
the statistics of length stop to grow (``LONG``); of equally good splits the first by statistic and threshold is taken;
without labels, or with one class only, every score is the smoothed share of label 1; an empty table gives an empty
result. ``score`` and ``predicted`` take the place of columns of these names in a scored table; ``accepted`` keeps all
columns as they are. Columns named like a statistic are neither read nor lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import bind, first_by_hash, materialize, runs_of, word_hashes

SAMPLE_ROWS = 10_000
TREES, DEPTH, LEAST, CUTS, RATE = 24, 3, 15, 24, 0.3
PENALTY, ITERATIONS = 0.004, 600

#: Marks that running text seldom holds, and marks that end or part its sentences.
SYMBOLS, POINTS = "|#$%&*<>=+~^_{}[]\\@/", ".,;:?!"

#: Repetition is the share of distinct runs of so many words, which unlike that of distinct words hardly falls with
#: a text's length. Lengths count up to so many words (and six characters a word): no length makes a long text worse.
RUN, LONG = 3, 300

STATISTICS = ("chars_log", "words_log", "word_length", "symbol_share", "point_share", "digit_share", "upper_share", "exclaim_share", "distinct_runs", "distinct_lines", "words_per_line", "ends_per_word", "repeat_share")


def _without(text: Column, marks: str) -> Column:
    return F.char_length(F.translate(text, marks, ""))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column for each of STATISTICS, of whole texts."""
    said = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({
        "_n": F.char_length(said).cast("double"), "_words": word_hashes(said), "_lines": F.filter(F.split(said, "\n"), lambda x: x != ""),
        "_symbols": _without(said, SYMBOLS), "_points": _without(said, POINTS), "_digits": _without(said, "0123456789"),
        "_upper": F.char_length(F.regexp_replace(said, r"\p{Lu}+", "")), "_exclaims": _without(said, "!"), "_ends": _without(said, ".?"),
    })
    df = df.withColumns({
        "_w": F.size("_words").cast("double"),
        "_d": F.when(F.size("_words") >= RUN, F.size(F.array_distinct(bind(F.col("_words"), lambda h: runs_of(h, RUN))))).otherwise(0).cast("double"), "_l": F.size("_lines").cast("double"), "_dl": F.size(F.array_distinct("_lines")).cast("double"),
        # words that equal the one before
        "_same": F.aggregate("_words", F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last")), lambda s, w: F.struct((s["n"] + F.when(s["last"] == w, 1).otherwise(0)).alias("n"), w.alias("last")))["n"],
    })
    share = lambda left: (F.col("_n") - F.col(left)) / F.greatest("_n", F.lit(1.0))
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1.0))
    return df.withColumns({
        "chars_log": F.log1p(F.least("_n", F.lit(6.0 * LONG))), "words_log": F.log1p(F.least("_w", F.lit(1.0 * LONG))), "word_length": over("_n", "_w"), "symbol_share": share("_symbols"), "point_share": share("_points"), "digit_share": share("_digits"),
        "upper_share": share("_upper"), "exclaim_share": share("_exclaims"), "distinct_runs": F.col("_d") / F.greatest(F.col("_w") - (RUN - 1), F.lit(1.0)), "distinct_lines": over("_dl", "_l"), "words_per_line": over("_w", "_l"),
        "ends_per_word": (F.col("_n") - F.col("_ends")) / F.greatest("_w", F.lit(1.0)), "repeat_share": over("_same", "_w"),
    }).drop("_n", "_words", "_lines", "_symbols", "_points", "_digits", "_upper", "_exclaims", "_ends", "_w", "_d", "_l", "_dl", "_same")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: A rule is a tuple of conditions (statistic index, threshold, is_above).
Rule = tuple[tuple[int, float, bool], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Spark column over the statistics' columns."""
        terms = [F.when(reduce(lambda a, b: a & b, [F.col(STATISTICS[i]) > t if above else F.col(STATISTICS[i]) <= t for i, t, above in rule]), w).otherwise(0.0) for rule, w in zip(self.rules, self.weights)]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, t, above in rule:
        out &= x[:, i] > t if above else x[:, i] <= t
    return out


def _best_split(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float] | None:
    """The cut that lowers the squared error of the residuals most: (gain, statistic, threshold)."""
    best, total, n = None, residual.sum(), len(residual)
    for i, at in enumerate(cuts):
        if not len(at):
            continue
        slot = np.searchsorted(at, x[:, i], side="left")  # slot <= k: x <= at[k]
        count = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1]
        left = np.cumsum(np.bincount(slot, residual, minlength=len(at) + 1))[:-1]
        fits = (count >= LEAST) & (n - count >= LEAST)
        if fits.any():
            gain = np.where(fits, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -np.inf) - total**2 / n
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), i, float(at[k]))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, without repetitions."""
    rng, cuts = np.random.default_rng(seed), []
    for i in range(x.shape[1]):
        levels = np.unique(x[:, i])
        middle = (levels[:-1] + levels[1:]) / 2
        cuts.append(middle if len(middle) <= CUTS else np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 2)[1:-1])))
    rules: dict[Rule, None] = {}
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        nodes: list[tuple[Rule, np.ndarray]] = [((), rows)]
        step = np.zeros(len(y))
        while nodes:
            rule, at = nodes.pop()
            found = _best_split(x[at], (y - p)[at], cuts) if len(rule) < DEPTH and len(at) >= 2 * LEAST else None
            if found is None:
                if rule:
                    inside = holds(rule, x)
                    step[inside] = (y - p)[at].sum() / max(1e-3, (p * (1 - p))[at].sum())
                continue
            _, i, t = found
            for above in (False, True):
                child = tuple(sorted({*rule, (i, t, above)}))
                rules.setdefault(child)
                nodes.append((child, at[(x[at, i] > t) == above]))
        z = z + RATE * np.clip(step, -4, 4)
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, iterations: int = ITERATIONS) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient; columns of r are scaled by their deviation for the penalty."""
    scale = np.maximum(r.std(axis=0), 0.02)
    a = r / scale
    mean = a.mean(axis=0)
    a = a - mean
    rate = 4 / max(1.0, float(np.linalg.eigvalsh(a.T @ a / len(y))[-1]) + 1)
    w, v, b, c, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 0.0, 0.0, 1.0
    for _ in range(iterations):
        g = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - rate * (a.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, t2 = c - rate * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b - (w * mean).sum()), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    prior = (y.sum() + 0.5) / (len(y) + 1)
    constant = RuleEnsemble(float(np.log(prior / (1 - prior))))
    if len(y) < 4 * LEAST or y.min() == y.max() or not (rules := grow_rules(x, y)):
        return constant
    intercept, weights = lasso_logistic(np.stack([holds(k, x) for k in rules], axis=1).astype(float), y)
    kept = [(k, float(w)) for k, w in zip(rules, weights) if abs(w) > 1e-3]
    return RuleEnsemble(intercept, tuple(k for k, _ in kept), tuple(w for _, w in kept))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from labelled rows that aren't held out, at most so many."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    picked = materialize(first_by_hash(usable, rows, "doc_id", "quality"), "label-sample")
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by rows
    got = with_statistics(known).select("doc_id", "quality", *STATISTICS).orderBy("doc_id", "quality").limit(rows).collect()
    if not got:
        return RuleEnsemble(0.0)
    data = np.array([r[1:] for r in got], float)
    return fit_rules(data[:, 1:], data[:, 0])


def _scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(row, score): each row as a struct beside its score, so that no column's name can clash with a statistic's."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__text"))
    return with_statistics(rows, "__text").select("row", model.column().alias("score"))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with score and predicted, in the place of columns of these names."""
    own = [F.col(f"row.{c}") for c in docs.columns if c not in ("score", "predicted")]
    return _scored(docs, model).select(*own, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows of docs that are predicted to have label 1, with all of their own columns."""
    return _scored(docs, model).where("score >= 0.5").select("row.*")
