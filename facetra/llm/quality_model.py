"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Statistics of every text are columns. Small trees are grown on a bounded sample of labelled rows, every path from a root
is a conjunctive rule, lasso logistic regression keeps few of the rules, and the result is one SQL expression, so that
scoring runs inside Spark's own code. Nothing but the sample's statistics (at most ``sample`` rows of about a dozen
numbers) reaches the driver.

Defined results: null text is the empty text and is scored like it; labels other than 0 and 1 and null labels are not
learned from; repeated rows are scored each; a label is joined by id, and of rows
that share an id one is learned from;
with one class or no label at all the score is that class's share (0.5 without any); further columns pass through
``score``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetra.llm.common import crc_mod, fresh, let

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 6000
TREES, DEPTH, LEAF = 24, 3, 10
PENALTY = 0.002
THRESHOLD = 0.3

#: Statistics of a text; shares are over characters, words or lines.
STATISTICS = ("words", "word_length", "upper", "digits", "symbols", "pipes", "exclaims", "stops", "commas", "dup_lines", "lines", "line_words", "variety")


def statistics(text: Column) -> Column:
    """A struct of STATISTICS, all doubles."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    found = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.greatest(F.length(F.array_join(w, "")), F.lit(1)).cast("double")
        return let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("double").alias("words"),
                (chars / n).alias("word_length"),
                (found(r"\p{Lu}") / chars).alias("upper"),
                (found(r"\p{Nd}") / chars).alias("digits"),
                (found(r"[#*$%&|<>]") / n).alias("symbols"),
                (found(r"\|") / n).alias("pipes"),
                (found("!") / n).alias("exclaims"),
                (found(r"\.") / n).alias("stops"),
                (found(",") / n).alias("commas"),
                ((F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1))).cast("double").alias("dup_lines"),
                F.size(x).cast("double").alias("lines"),
                (n / F.greatest(F.size(x), F.lit(1))).cast("double").alias("line_words"),
                (F.size(F.array_distinct(w)) / n).cast("double").alias("variety"),
            ),
        )

    return let(words, of)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether over the cut, cut) and so on


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def expression(self) -> str:
        """The score as SQL over columns of the statistics' names."""
        total = [repr(self.bias)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            when = " AND ".join(f"`{self.names[k]}` {'>' if over else '<='} {cut!r}D" for k, over, cut in rule)
            total.append(f"CASE WHEN {when} THEN {weight!r}D ELSE 0D END")
        return f"1D / (1D + exp(-({' + '.join(total)})))"

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests."""
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, cut in rule:
        out &= (x[:, k] > cut) == over
    return out


def _grow(x: np.ndarray, g: np.ndarray, w: np.ndarray, columns: np.ndarray, depth: int, path: Rule, rules: list[Rule], leaves: list) -> None:
    """A regression tree on gradients g with weights w; every node's path is a rule."""
    if path:
        rules.append(path)
    best = (1e-9, -1, 0.0)
    if depth and len(x) >= 2 * LEAF:
        for k in columns:
            order = np.argsort(x[:, k], kind="stable")
            v, sg, sw = x[order, k], np.cumsum(g[order]), np.cumsum(w[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at >= LEAF - 1) & (at < len(v) - LEAF)]
            if len(at):
                gain = sg[at] ** 2 / (sw[at] + 1) + (sg[-1] - sg[at]) ** 2 / (sw[-1] - sw[at] + 1) - sg[-1] ** 2 / (sw[-1] + 1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(k), float((v[at[i]] + v[at[i] + 1]) / 2))
    if best[1] < 0:
        leaves.append((path, float(g.sum() / (w.sum() + 1))))
        return
    _, k, cut = best
    over = x[:, k] > cut
    for side in (False, True):
        part = over == side
        _grow(x[part], g[part], w[part], columns, depth - 1, (*path, (k, side, cut)), rules, leaves)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients; the bias has none."""
    n, m = z.shape
    step = 4.0 / (np.linalg.norm(np.column_stack((z, np.ones(n))), 2) ** 2 / n)
    w = p = np.zeros(m)
    b = q = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ p + q))) - y
        moved = p - step * (z.T @ r) / n
        new_w = np.sign(moved) * np.maximum(0, np.abs(moved) - step * penalty)
        new_b = q - step * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        p, q = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new_w, new_b, s
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, seed: int = 7, trees: int = TREES, penalty: float = PENALTY) -> Model:
    """Boost small trees on random halves of rows and statistics, keep their paths, and weight them by lasso."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(names, (), (), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    r = np.random.default_rng(seed)
    rules: list[Rule] = []
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = r.random(len(y)) < 0.5
        columns = r.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        leaves: list = []
        _grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], columns, DEPTH, (), rules, leaves)
        for path, value in leaves:
            f += 0.3 * np.clip(value, -4, 4) * _holds(path, x)
    rules = list(dict.fromkeys(rules))
    if not rules:  # too few rows to tell any apart
        return Model(names, (), (), float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([_holds(rule, x) for rule in rules], 1).astype(float)
    some = np.flatnonzero((z.mean(0) > 0.002) & (z.mean(0) < 0.998))
    _, first = np.unique(z[:, some], axis=1, return_index=True)  # rules that hold for the same rows count once
    some = some[np.sort(first)]
    w, b = _lasso(z[:, some], y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(names, tuple(rules[some[i]] for i in kept), tuple(float(w[i]) for i in kept), b)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample: int, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Up to ``sample`` labelled rows of each class outside the held-out fold, those whose ids have the smallest hashes, and
    the numbers of labels of each class. A bound on the hash leaves little more than the sample before it is ordered."""
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (crc_mod(doc_id, modulus) != held))
    known = known.groupBy(doc_id).agg(F.max("_y").alias("_y")).withColumn("_h", F.pmod(F.xxhash64(doc_id), F.lit(1 << 31)))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}  # two rows
    picked = known.limit(0)
    for y, n in counts.items():
        limit = (1 << 31) if n <= sample else int((1.2 * sample + 100) / n * (1 << 31))
        picked = picked.union(known.where((F.col("_y") == y) & (F.col("_h") < limit)).orderBy("_h", doc_id).limit(sample))
    return docs.join(F.broadcast(picked.drop("_h")), doc_id), counts  # at most 2 * sample ids


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from rows whose crc32 of the id is not 0 modulo 5."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows, _ = training_rows(narrow, labels.withColumnRenamed(doc_id, "doc_id"), label, 5, 0, sample)
    each = rows.groupBy("doc_id").agg(F.min(F.struct("_y", statistics(F.col("text")).alias("s"))).alias("r"))  # one row an id
    got = sorted(each.select("doc_id", "r._y", "r.s.*").collect())
    x = np.array([[r[n] for n in STATISTICS] for r in got], float).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r["_y"] for r in got], float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; input columns with these names are replaced."""
    columns, s = [c for c in docs.columns if c not in {"held_out", "score", "predicted"}], fresh(docs.columns, "s")
    with_s = docs.select(*[F.col(f"`{c}`") for c in columns], statistics(F.col(f"`{text}`")).alias(s))
    expression = model.expression()
    for n in STATISTICS:
        expression = expression.replace(f"`{n}`", f"{s}.`{n}`")
    out = with_s.select(*[F.col(f"`{c}`") for c in columns], (crc_mod(f"`{doc_id}`", 5) == 0).alias("held_out"), F.expr(expression).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
