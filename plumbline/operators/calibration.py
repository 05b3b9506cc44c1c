"""Score calibration: distributed fits of temperature, Platt and multinomial models, and their application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import col, logit, sigmoid, softplus
from plumbline.session import cut_lineage


@dataclass(frozen=True)
class Calibration:
    """Parameters of a fitted map from the logit difference to a probability."""
    method: str = "raw"
    T: float = 1.0
    A: float = 1.0
    B: float = 0.0


def apply_calibration(p: str | Column, calibration: Calibration | None, s: str | Column | None = None) -> Column:
    """Calibrated positive probability. ``s`` is the logit difference when known, else it is taken from ``p``.

    Without a calibration the probability passes through unchanged.
    """
    if calibration is None or calibration.method == "raw":
        return col(p)
    z = logit(p) if s is None else col(s)
    if calibration.method == "temperature":
        return sigmoid(z / F.lit(max(calibration.T, 1e-4)))
    if calibration.method == "platt":
        return sigmoid(z * F.lit(calibration.A) + F.lit(calibration.B))
    raise ValueError(f"unknown calibration method {calibration.method!r}")


def binary_nll(z: Column, y: Column) -> Column:
    return softplus(z) - y * z


def logit_cells(df: DataFrame, s: str, y: str) -> DataFrame:
    """Distinct (logit, label) with counts: what the fits read on every step. Written to the checkpoint folder
    once, so a step neither rescans the facts nor depends on executors staying alive."""
    return cut_lineage(df.groupBy(F.col(s).cast("double").alias("s"), F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("w")))


def fit_temperature(df: DataFrame, s: str = "s", y: str = "y", low: float = 0.01, high: float = 10.0,
                    tolerance: float = 1e-10, steps: int = 60) -> Calibration:
    """Minimise the mean NLL of sigmoid(s/T) over T in [low, high].

    In beta = 1/T the loss is convex, so a Newton step guarded by a bracket converges in a few passes. One
    pass is one aggregate; the driver sees three sums.
    """
    cells = logit_cells(df, s, y)
    lo, hi, beta = 1.0 / high, 1.0 / low, 1.0
    for _ in range(steps):
        q = sigmoid(F.col("s") * F.lit(beta))
        row = cells.agg(F.sum(F.col("w") * (q - F.col("y")) * F.col("s")).alias("g"),
                        F.sum(F.col("w") * q * (F.lit(1.0) - q) * F.col("s") * F.col("s")).alias("h"),
                        F.sum("w").alias("n")).first()
        if not row.n:
            raise ValueError("no rows to fit")
        g, h = row.g / row.n, row.h / row.n
        if g > 0:
            hi = beta
        else:
            lo = beta
        step = beta - g / h if h > 1e-300 else (lo + hi) / 2
        new = step if lo < step < hi else (lo + hi) / 2
        settled = abs(g) < tolerance or abs(new - beta) < tolerance * max(1.0, beta)
        beta = new
        if settled:
            break
    else:
        raise RuntimeError(f"the temperature did not settle in {steps} steps (gradient {g:.3g})")
    return Calibration("temperature", T=min(max(1.0 / beta, low), high))


def fit_platt(df: DataFrame, s: str = "s", y: str = "y", l2: float = 1e-5, a_range: tuple[float, float] = (1e-4, 20.0),
              b_range: tuple[float, float] = (-20.0, 20.0), tolerance: float = 1e-10, steps: int = 60, settled: float = 1e-6) -> Calibration:
    """Minimise mean NLL of sigmoid(A s + B) + l2 (A^2 + B^2) inside the box.

    Damped Newton: one aggregate per pass gives the gradient and Hessian at the current point together
    with the loss at that point; the step is halved when the loss rose. A coordinate at its bound
    whose gradient points outwards is held there while the other is solved for.
    """
    cells = logit_cells(df, s, y)

    def at(a: float, b: float) -> tuple[float, float, float, float, float, float]:
        z = F.col("s") * F.lit(a) + F.lit(b)
        q = sigmoid(z)
        w, x = F.col("w"), F.col("s")
        v = w * q * (F.lit(1.0) - q)
        r = cells.agg(F.sum(w).alias("n"), F.sum(w * binary_nll(z, F.col("y"))).alias("f"),
                      F.sum(w * (q - F.col("y")) * x).alias("ga"), F.sum(w * (q - F.col("y"))).alias("gb"),
                      F.sum(v * x * x).alias("haa"), F.sum(v * x).alias("hab"), F.sum(v).alias("hbb")).first()
        if not r.n:
            raise ValueError("no rows to fit")
        n = r.n
        return (r.f / n + l2 * (a * a + b * b), r.ga / n + 2 * l2 * a, r.gb / n + 2 * l2 * b,
                r.haa / n + 2 * l2, r.hab / n, r.hbb / n + 2 * l2)

    def clamp(v: float, r: tuple[float, float]) -> float:
        return min(max(v, r[0]), r[1])

    a, b = 1.0, 0.0
    f, ga, gb, haa, hab, hbb = at(a, b)
    for _ in range(steps):
        hold_a = (a <= a_range[0] and ga > 0) or (a >= a_range[1] and ga < 0)
        hold_b = (b <= b_range[0] and gb > 0) or (b >= b_range[1] and gb < 0)
        if (hold_a or abs(ga) < tolerance) and (hold_b or abs(gb) < tolerance):
            break
        if hold_a or hold_b:
            da, db = (0.0 if hold_a else -ga / haa), (0.0 if hold_b else -gb / hbb)
        else:
            det = haa * hbb - hab * hab
            da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        scale = 1.0
        for _ in range(40):
            na, nb = clamp(a + scale * da, a_range), clamp(b + scale * db, b_range)
            trial = at(na, nb)
            if trial[0] <= f + 1e-15:
                break
            scale /= 2
        else:  # no step this way lowers the loss: as good as rounding allows, if the point is flat
            if (hold_a or abs(ga) < settled) and (hold_b or abs(gb) < settled):
                return Calibration("platt", A=a, B=b)
            raise RuntimeError(f"the Platt fit found no better point, yet its gradient is {ga:.3g}, {gb:.3g}")
        moved = abs(na - a) + abs(nb - b)
        a, b = na, nb
        f, ga, gb, haa, hab, hbb = trial
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"the Platt fit did not settle in {steps} steps (gradient {ga:.3g}, {gb:.3g})")
    return Calibration("platt", A=a, B=b)


def fit_fusion(df: DataFrame, label: str, features: tuple[str, str] = ("p_generated", "p_manipulated"), labels=None, iterations: int = 100):
    """Class-weighted multinomial regression on the two scores, fitted by Spark ML; returns a FusionModel.

    Rows with any other label are left out, and weights are those of the labels that occur: n / (k n_c).
    Softmax weights are known only up to a common shift; they are centred so that each column sums to zero.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from plumbline.operators.rules import LABELS, FusionModel

    labels = tuple(labels or LABELS)
    known = df.where(F.col(label).isin(*labels))
    counts = {r[label]: r.n for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per known label
    total = sum(counts.values())
    if not total:
        raise ValueError("no row has a known label")
    weight = None
    for name, n in counts.items():
        share = F.lit(total / (len(counts) * n))
        weight = F.when(F.col(label) == name, share) if weight is None else weight.when(F.col(label) == name, share)
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    data = known.select(index.cast("double").alias("_y"), weight.alias("weight"), *features)
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(data)
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", family="multinomial",
                            standardization=False, regParam=0.0, maxIter=iterations, tol=1e-7)
    model = lr.fit(vectors)
    cells = cut_lineage(data.groupBy("_y", *features).agg(F.sum("weight").alias("w")))
    w, b = _polish(cells, features, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), total)
    w, b = w - w.mean(axis=0), b - b.mean()
    return FusionModel(tuple(tuple(float(x) for x in row) for row in w), tuple(float(x) for x in b), labels)


def _class_shares(features, w, b) -> list[Column]:
    """Softmax of linear scores as columns, shifted by the largest."""
    z = [sum((F.col(f) * F.lit(float(x)) for f, x in zip(features, row, strict=True)), F.lit(float(c))) for row, c in zip(w, b, strict=True)]
    e = [F.exp(x - F.greatest(*z)) for x in z]
    return [x / sum(e[1:], e[0]) for x in e]


def _polish(cells: DataFrame, features, w, b, total: float, tolerance: float = 1e-11, steps: int = 25):
    """Newton steps on the weighted log loss from a fit near its minimum, each one aggregate over counted cells for gradient and Hessian, until no entry of the mean
    gradient exceeds ``tolerance``; raises where that is not reached."""
    import numpy as np

    k = len(w)
    x = [*[F.col(f) for f in features], F.lit(1.0)]
    m = len(x)
    for _ in range(steps):
        q = [F.col(f"_q{c}") for c in range(k)]
        shares = cells.select("*", *[s.alias(f"_q{c}") for c, s in enumerate(_class_shares(features, w, b))])
        grads = [F.sum(F.col("w") * (q[c] - (F.col("_y") == c).cast("double")) * x[j]) for c in range(k) for j in range(m)]
        pairs = [(c, d, i, j) for c in range(k) for d in range(c, k) for i in range(m) for j in range(i, m)]
        curves = [F.sum(F.col("w") * q[c] * ((1.0 if c == d else 0.0) - q[d]) * x[i] * x[j]) for c, d, i, j in pairs]
        row = shares.agg(*[g.alias(f"g{n}") for n, g in enumerate(grads)], *[h.alias(f"h{n}") for n, h in enumerate(curves)]).first()
        g = np.array([row[f"g{n}"] for n in range(len(grads))]) / total
        if np.abs(g).max() < tolerance:
            return w, b
        h = np.zeros((k, m, k, m))
        for n, (c, d, i, j) in enumerate(pairs):
            h[c, i, d, j] = h[c, j, d, i] = h[d, i, c, j] = h[d, j, c, i] = row[f"h{n}"] / total
        step = -(np.linalg.pinv(h.reshape(k * m, k * m), rcond=1e-10) @ g).reshape(k, m)
        w, b = w + step[:, :-1], b + step[:, -1]
    raise RuntimeError(f"the fusion fit did not settle in {steps} steps (gradient {np.abs(g).max():.3g})")


def fusion_certificate(df: DataFrame, label: str, model, features: tuple[str, str] = ("p_generated", "p_manipulated")) -> DataFrame:
    """One row per label of the model that occurs: rows ``n``, and the class-weighted means of one (``share``) and of each feature under the model's probability of the label
    (``model_*``) and over the label's own rows (``own_*``). A model is the minimum of its convex loss exactly where the two agree; ``residual`` is their largest difference."""
    known = df.where(F.col(label).isin(*model.labels))
    sizes = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total, k = sizes.agg(F.sum("n"), F.count("*")).first()
    weighted = known.join(sizes.withColumn("_w", F.lit(1.0 / k) / F.col("n")), F.col(label) == F.col("label"))
    q = _class_shares(features, model.weights, model.biases)
    per = F.explode(F.array(*[F.struct(F.lit(name).alias("of"), share.alias("q"), (F.col("label") == name).cast("double").alias("own")) for name, share in zip(model.labels, q, strict=True)]))
    rows = weighted.select("_w", *features, per.alias("_c")).select("_w", *features, "_c.*")
    sums = rows.groupBy(F.col("of").alias("label")).agg(*[F.sum(F.col("_w") * F.col(c) * x).alias(f"{side}_{name}") for side, c in (("model", "q"), ("own", "own"))
                                                          for name, x in (("share", F.lit(1.0)), *[(f, F.col(f)) for f in features])])
    gaps = [F.abs(F.col(f"model_{n}") - F.col(f"own_{n}")) for n in ("share", *features)]
    return sums.join(sizes, "label").withColumn("residual", F.greatest(*gaps))
