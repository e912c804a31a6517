"""Linear and fractional-logit regression from distributed cross products.

The data is read in aggregates of the size of the number of coefficients; systems of that size are
solved on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def chi2_sf(x: float, d: int) -> float:
    """Upper tail of the chi-square distribution: the regularised upper incomplete gamma function."""
    a, x = d / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d_ = 1 / tiny, 1 / b
    h = d_
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d_ = 1 / (an * d_ + b or tiny)
        c = b + an / c or tiny
        h *= d_ * c
        if abs(d_ * c - 1) < 1e-15:
            break
    return front * h


def dummies(df: DataFrame, column: str, base: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    """Treatment coding: a 0/1 column for each level but the base."""
    names = [f"{column}[{v}]" for v in levels if v != base]
    return df.withColumns({f"{column}[{v}]": (F.col(column) == v).cast("double") for v in levels if v != base}), names


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double") if name != "Intercept" else F.lit(1.0)


def cross_products(df: DataFrame, terms: list[str], y: str | Column, weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, y'y, sum y, X'X (upper triangle) and X'y by ``keys``, in one pass."""
    w = F.lit(1.0) if weight is None else weight
    target = F.col(y).cast("double") if isinstance(y, str) else y
    parts = [F.count("*").alias("n"), F.sum(w * target * target).alias("yy"), F.sum(w * target).alias("sy"), F.sum(w).alias("sw")]
    for i, a in enumerate(terms):
        parts.append(F.sum(w * _c(a) * target).alias(f"xy{i}"))
        parts += [F.sum(w * _c(a) * _c(terms[j])).alias(f"xx{i}_{j}") for j in range(i, len(terms))]
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*parts)


def unpack(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    xx, xy = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        xy[i] = row[f"xy{i}"] or 0.0
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"xx{i}_{j}"] or 0.0
    return xx, xy


@dataclass(frozen=True)
class Fit:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    r2: float

    @property
    def p(self) -> np.ndarray:
        """Two-sided p-values by the normal distribution."""
        se = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        return np.array([2 * normal_sf(abs(b / s)) if s > 0 else float("nan") for b, s in zip(self.coef, se)])

    def wald(self, terms: list[str]) -> tuple[float, float]:
        """Robust test that all of ``terms`` are 0: statistic and p-value."""
        at = [self.terms.index(t) for t in terms]
        b = self.coef[at]
        stat = float(b @ np.linalg.pinv(self.cov[np.ix_(at, at)]) @ b)
        return stat, chi2_sf(stat, len(at))


def ols_hc3(df: DataFrame, y: str, terms: list[str]) -> Fit:
    """Least squares with HC3 covariance, in two passes."""
    names = ["Intercept", *terms]
    k = len(names)
    row = cross_products(df, names, y).first()
    xx, xy = unpack(row, k)
    inverse = np.linalg.pinv(xx)
    coef = inverse @ xy
    fitted, lever = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(names):
        fitted = fitted + float(coef[i]) * _c(a)
        lever = lever + _c(a) * sum((float(inverse[i, j]) * _c(names[j]) for j in range(k)), F.lit(0.0))
    met = df.withColumn("_e", F.col(y).cast("double") - fitted).withColumn("_u", F.pow(F.col("_e") / F.greatest(1.0 - lever, F.lit(1e-12)), F.lit(2.0)))
    second = met.agg(F.sum(F.col("_e") * F.col("_e")).alias("ee"), *[F.sum(_c(names[i]) * _c(names[j]) * F.col("_u")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = second[f"m{i}_{j}"]
    total = row["yy"] - row["sy"] ** 2 / row["n"]
    return Fit(names, coef, inverse @ meat @ inverse, row["n"], 1 - second["ee"] / total if total > 0 else 0.0)


def fractional_logit(df: DataFrame, y: str, terms: list[str], weight: str | None = None, steps: int = 25) -> Fit:
    """Weighted binomial GLM of a share by iterated least squares; one pass for each step."""
    names = ["Intercept", *terms]
    coef = np.zeros(len(names))
    w0 = F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(1.0))
    n = 0
    for step in range(steps):
        eta = sum((float(b) * _c(a) for b, a in zip(coef, names)), F.lit(0.0))
        mu = (F.col(y).cast("double") + 0.5) / 2 if step == 0 else 1.0 / (1.0 + F.exp(-eta))
        link = F.log(mu / (1 - mu)) if step == 0 else eta
        spread = F.greatest(mu * (1 - mu), F.lit(1e-12))
        row = cross_products(df, names, link + (F.col(y) - mu) / spread, w0 * spread).first()
        xx, xy = unpack(row, len(names))
        new = np.linalg.pinv(xx) @ xy
        n, moved, coef = row["n"], float(np.abs(new - coef).max()), new
        if moved < 1e-10:
            break
    return Fit(names, coef, np.linalg.pinv(xx), n, float("nan"))


def vif(df: DataFrame, terms: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    names = ["Intercept", *terms]
    row = cross_products(df, names, F.lit(0.0)).first()
    xx, _ = unpack(row, len(names))
    n, mean = row["n"], xx[0, 1:] / row["n"]
    cov = xx[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    varies = sd > 1e-12  # a constant term inflates nothing and has no factor
    inverse = np.linalg.pinv(cov[np.ix_(varies, varies)] / np.outer(sd[varies], sd[varies]))
    found = iter(np.diag(inverse).tolist())
    return {t: next(found) if v else float("nan") for t, v in zip(terms, varies)}


def cluster_bootstrap(df: DataFrame, y: str, terms: list[str], cluster: str, b: int, seed: int) -> np.ndarray:
    """Coefficients (replicates x terms) of fits to whole clusters drawn with replacement.

    Cross products by cluster add up, so a replicate is a weighted sum of small matrices."""
    names = ["Intercept", *terms]
    rows = cross_products(df, names, y, keys=(cluster,)).orderBy(cluster).collect()  # one row a cluster (chapter)
    parts = [unpack(r, len(names)) for r in rows]
    xx, xy = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(b):
        w = np.bincount(rng.integers(0, len(parts), len(parts)), minlength=len(parts)).astype(float)
        out.append(np.linalg.pinv(np.tensordot(w, xx, 1)) @ (w @ xy))
    return np.array(out)
