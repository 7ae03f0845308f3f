"""Dirichlet calibration of class probabilities, drawn towards leaving them as they are.

Calibrated probabilities are softmax(W log p + b); W and b make the mean log loss plus `penalty` times the sum of squares of W - I
least. The loss is convex, so Newton steps reach the one optimum; each step is one aggregation of the gradient's and the second
derivative's sums, with partial sums before the shuffle, and only these reach the driver. Halved steps make sure that the loss falls.

Rows with a null class or a null probability are left out of the fit; probabilities count as FLOOR at least.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions import text

#: The penalty, and the least probability.
PENALTY, FLOOR = 0.01, 1e-10
#: b has next to no penalty: enough to make the optimum one, since adding a constant to all of b changes nothing.
SHIFT_PENALTY = 1e-9
STEPS = 50


def _logits(w: np.ndarray, b: np.ndarray, logs: list[Column]) -> list[Column]:
    return [reduce(lambda a, c: a + c, [float(w[k, i]) * x for i, x in enumerate(logs)]) + float(b[k]) for k in range(len(logs))]


def apply(rows: DataFrame, w: np.ndarray, b: np.ndarray, probabilities: list[str], names: list[str]) -> DataFrame:
    """rows with the calibrated probabilities under `names`."""
    logs = [F.log(F.greatest(F.col(p), F.lit(FLOOR))) for p in probabilities]
    soft = text.softmax(*_logits(w, b, logs))
    return rows.withColumns({n: soft[i] for i, n in enumerate(names)})


def fit(rows: DataFrame, probabilities: list[str], label: str, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(W, b) for label, the number of the right class."""
    k = len(probabilities)
    logs = [F.log(F.greatest(F.col(p), F.lit(FLOOR))).alias(f"l{i}") for i, p in enumerate(probabilities)]
    x = rows.where(F.col(label).isNotNull()).dropna(subset=probabilities).select(F.col(label).cast("int").alias("y"), *logs)
    inputs = [F.col(f"l{i}") for i in range(k)] + [F.lit(1.0)]
    # Parameters in order of class, then input: W's row and b of each class.
    start = np.hstack([np.eye(k), np.zeros((k, 1))]).reshape(-1)
    weight = np.tile([penalty] * k + [SHIFT_PENALTY], k)
    pairs = [(a, c) for a in range(k) for c in range(a, k)]
    products = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def sums(t: np.ndarray, second: bool):
        """(mean loss with penalty, gradient, second derivative) at t."""
        m = t.reshape(k, k + 1)
        soft = x.withColumn("p", F.array(*[text.softmax(*_logits(m[:, :k], m[:, k], inputs[:k]))[i] for i in range(k)]))
        p = [F.col("p")[i] for i in range(k)]
        own = F.get("p", F.col("y"))
        found = [F.count(F.lit(1)).alias("n"), F.sum(-F.log(F.greatest(own, F.lit(1e-300)))).alias("loss")]
        if second:
            found += [F.sum((p[a] - (F.col("y") == a).cast("double")) * z).alias(f"g{a}_{i}") for a in range(k) for i, z in enumerate(inputs)]
            found += [F.sum(p[a] * ((1.0 if a == c else 0.0) - p[c]) * inputs[i] * inputs[j]).alias(f"h{a}_{c}_{i}_{j}") for a, c in pairs for i, j in products]
        r = soft.agg(*found).first()  # one row
        n = max(r["n"], 1)
        off = t - start
        loss = (r["loss"] or 0.0) / n + float((weight * off * off).sum())
        if not second:
            return loss, None, None
        g = np.array([r[f"g{a}_{i}"] or 0.0 for a in range(k) for i in range(k + 1)]) / n + 2 * weight * off
        h = np.zeros((k, k + 1, k, k + 1))
        for a, c in pairs:
            for i, j in products:
                h[a, i, c, j] = h[a, j, c, i] = h[c, i, a, j] = h[c, j, a, i] = (r[f"h{a}_{c}_{i}_{j}"] or 0.0) / n
        return loss, g, h.reshape(len(t), len(t)) + 2 * np.diag(weight)

    t = start.copy()
    for _ in range(STEPS):
        loss, g, h = sums(t, True)
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        if float(g @ step) < 1e-14:
            break
        size = 1.0
        while size > 1e-6 and not sums(t - size * step, False)[0] < loss:
            size /= 2
        if size <= 1e-6:
            break
        t = t - size * step
    m = t.reshape(k, k + 1)
    return m[:, :k], m[:, k]
