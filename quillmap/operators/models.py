"""Fits on the driver from sums that Spark takes, resampling, and the neural surrogate trained a group a task."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import round_table


def ols_multi(df: DataFrame, xs: list[str], y: str) -> dict[str, float]:
    """Least squares with an intercept: the normal equations' sums come from one aggregation, the small system is solved here."""
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(terms)
    sums = df.agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(t * F.col(y)).alias(f"t{i}") for i, t in enumerate(terms)], F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).first()
    a = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    t = np.array([sums[f"t{i}"] for i in range(k)])
    beta = np.linalg.lstsq(a, t, rcond=None)[0]
    residual = sums["yy"] - beta @ t
    total = sums["yy"] - t[0] ** 2 / sums["n"]
    return {"intercept": float(beta[0]), **{x: float(b) for x, b in zip(xs, beta[1:])}, "r2": float(1 - residual / total) if total else float("nan"), "n": sums["n"]}


def poly_detrend(df: DataFrame, value: str, x: str = "px", y: str = "py", degree: int = 3) -> tuple[DataFrame, float]:
    """The rows with ``trend`` and ``residual`` of a polynomial in centred kilometres, and its R2."""
    c = df.agg(F.avg(x), F.avg(y)).first()
    u, v = (F.col(x) - F.lit(c[0])) / 1000.0, (F.col(y) - F.lit(c[1])) / 1000.0
    powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i) if i + j]
    p = df.withColumns({f"__m{i}_{j}": F.pow(u, F.lit(i)) * F.pow(v, F.lit(j)) for i, j in powers})
    names = [f"__m{i}_{j}" for i, j in powers]
    fit = ols_multi(p, names, value)
    trend = F.lit(fit["intercept"])
    for n in names:
        trend = trend + F.lit(fit[n]) * F.col(n)
    return p.withColumn("trend", trend).withColumn("residual", F.col(value) - F.col("trend")).drop(*names), fit["r2"]


def exponential_fit(lags, gamma, counts, rounds: int = 200) -> tuple[float, float, float]:
    """(nugget, partial sill, range) of nugget + sill * (1 - exp(-lag / range)) by damped Gauss-Newton on a variogram's few rows."""
    h, g, w = (np.asarray(a, dtype=float) for a in (lags, gamma, counts))
    ok = np.isfinite(g) & (w > 0)
    h, g, w = h[ok], g[ok], w[ok] / w[ok].sum()
    theta, damp = np.array([max(g.min(), 0.0), max(g.max() - g.min(), 1e-9), max(h.mean(), 1e-9)]), 1e-3
    cost = lambda t: float((w * (t[0] + t[1] * (1 - np.exp(-h / t[2])) - g) ** 2).sum())
    for _ in range(rounds):
        e = np.exp(-h / theta[2])
        r = theta[0] + theta[1] * (1 - e) - g
        jac = np.stack([np.ones_like(h), 1 - e, -theta[1] * e * h / theta[2]], axis=1)  # the range by its logarithm
        a = jac.T @ (jac * w[:, None])
        step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), jac.T @ (w * r))
        new = np.array([max(theta[0] - step[0], 0.0), max(theta[1] - step[1], 1e-12), theta[2] * np.exp(-np.clip(step[2], -1, 1))])
        if cost(new) < cost(theta):
            if np.abs(new - theta).max() <= 1e-12 * np.abs(theta).max():
                break
            theta, damp = new, damp / 3
        else:
            damp *= 4
            if damp > 1e12:
                break
    return tuple(float(t) for t in theta)


def dirichlet_weights(n: int, center: dict[str, float], concentration: float, seed: int = 20260716) -> list[dict[str, float]]:
    """Seeded random weights around a centre; each adds up to 1."""
    draws = np.random.default_rng(seed).dirichlet([concentration * v for v in center.values()], n)
    return [dict(zip(center, map(float, d))) for d in draws]


#: How much a component is emphasised and the reverse, and the cloud of random weights around the baseline.
EMPHASIS, DEEMPHASIS, DRAWS, CONCENTRATION = 2.0, 0.5, 24, 200.0
#: Columns of a table of scenarios by component.
WEIGHT_COLUMNS = {"zone": "w_zone", "water": "w_water", "terrain_absolute": "w_abs", "terrain_relative": "w_rel"}


def scaled(weights: dict[str, float], names: list[str], factor: float) -> dict[str, float]:
    """Some weights multiplied by a factor, all made to add up to 1 again."""
    new = {k: v * factor if k in names else v for k, v in weights.items()}
    total = sum(new.values())
    if set(names) - set(weights) or total <= 0:
        raise ValueError(f"{names} times {factor} of {weights}")
    return {k: v / total for k, v in new.items()}


def scenarios(baseline: dict[str, float], draws: int = DRAWS, concentration: float = CONCENTRATION, up: float = EMPHASIS, down: float = DEEMPHASIS, seed: int = 20260716) -> list[tuple]:
    """(scenario, family, weight...) of the baseline, equal weights, each component and the terrain pair up and down, random draws and single components."""
    names = list(baseline)
    check_weights(baseline, set(names))
    terrain = [n for n in names if n.startswith("terrain_")]
    each = [(n, [n]) for n in names] + ([("terrain_family", terrain)] if terrain else [])
    rows = [("baseline", "baseline", baseline), ("equal", "structured", dict.fromkeys(names, 1 / len(names)))]
    rows += [(f"{n}_{word}", "structured", scaled(baseline, which, by)) for n, which in each for word, by in (("emphasized", up), ("deemphasized", down))]
    rows += [(f"perturbation_{k:03d}", "perturbation", w) for k, w in enumerate(dirichlet_weights(draws, baseline, concentration, seed))]
    rows += [(f"{n}_only", "reference_corner", {k: float(k == n) for k in names}) for n in names]
    return [(name, family, *(w[n] for n in names)) for name, family, w in rows]


def rescale(weights: dict[str, float], name: str, value: float) -> dict[str, float]:
    """One weight set, the others scaled so that all add up to 1."""
    rest = sum(v for k, v in weights.items() if k != name)
    return {k: value if k == name else (v * (1 - value) / rest if rest else (1 - value) / (len(weights) - 1)) for k, v in weights.items()}


def check_weights(weights: dict[str, float], names: set[str]) -> dict[str, float]:
    if set(weights) != names:
        raise ValueError(f"weights {sorted(weights)}, expected {sorted(names)}")
    if any(not v >= 0 for v in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights must be 0 or more and add up to 1: {weights}")
    return weights


def cluster_bootstrap(df: DataFrame, cluster: str, group: str, value: str, resamples: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(group, mean, low, high): percentile intervals over resampled clusters.

    Clusters are summed first, so a resample joins sums, never rows; draws are seeded on the driver by rank of the cluster.
    """
    spark = df.sparkSession
    sums = df.groupBy(cluster, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    names = [r[0] for r in sums.select(cluster).distinct().orderBy(cluster).collect()]
    draws = np.random.default_rng(seed).integers(0, len(names), (resamples, len(names)))
    rows = [(int(r), names[int(c)], int(k)) for r, d in enumerate(draws) for c, k in zip(*np.unique(d, return_counts=True))]
    plan = spark.createDataFrame(rows, f"resample int, {cluster} {df.schema[cluster].dataType.simpleString()}, times int")
    means = plan.join(sums, cluster).groupBy("resample", group).agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    ci = means.groupBy(group).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    whole = sums.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(ci, group)


@dataclass
class Normalizer:
    """Both axes by one scale, from the bounds' centre."""

    cx: float
    cy: float
    scale: float

    @classmethod
    def of(cls, points: DataFrame, x: str = "px", y: str = "py") -> Normalizer:
        b = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        return cls((b[0] + b[1]) / 2, (b[2] + b[3]) / 2, max(b[1] - b[0], b[3] - b[2], 1e-12) / 2)

    def __call__(self, x, y):
        return (x - self.cx) / self.scale, (y - self.cy) / self.scale


class Network:
    """A small multilayer perceptron with ReLU, on Fourier features, trained by Adam."""

    def __init__(self, inputs: int, hidden: list[int], seed: int, frequencies: int = 16, spread: float = 2.0):
        r = np.random.default_rng(seed)
        self.b = r.normal(0, spread, (frequencies, inputs))
        sizes = [inputs + 2 * frequencies, *hidden, 1]
        self.w = [r.normal(0, np.sqrt(2 / a), (a, c)) for a, c in zip(sizes, sizes[1:])]
        self.c = [np.zeros(c) for c in sizes[1:]]

    def features(self, x: np.ndarray) -> np.ndarray:
        t = 2 * np.pi * x @ self.b.T
        return np.concatenate([x, np.cos(t), np.sin(t)], axis=1)

    def forward(self, z: np.ndarray) -> list[np.ndarray]:
        out = [z]
        for k, (w, c) in enumerate(zip(self.w, self.c)):
            z = z @ w + c
            z = np.maximum(z, 0) if k + 1 < len(self.w) else z
            out.append(z)
        return out

    def gradient(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean squared error, weights and constants layer by layer."""
        a = self.forward(z)
        delta, grads = 2 * (a[-1] - y[:, None]) / len(y), []
        for k in range(len(self.w) - 1, -1, -1):
            grads = [a[k].T @ delta, delta.sum(axis=0), *grads]
            delta = (delta @ self.w[k].T) * (a[k] > 0)
        return grads

    def fit(self, x, y, vx, vy, epochs: int = 60, batch: int = 256, rate: float = 3e-3, patience: int = 8, seed: int = 0) -> Network:
        z, vz, r = self.features(x), self.features(vx), np.random.default_rng(seed)
        params = [p for pair in zip(self.w, self.c) for p in pair]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        best, kept, waited = np.inf, [p.copy() for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(z))
            for at in range(0, len(z), batch):
                rows = order[at : at + batch]
                t += 1
                for k, g in enumerate(self.gradient(z[rows], y[rows])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            loss = float(((self.forward(vz)[-1][:, 0] - vy) ** 2).mean()) if len(vy) else 0.0
            if loss < best - 1e-12:
                best, kept, waited = loss, [p.copy() for p in params], 0
            elif (waited := waited + 1) >= patience:
                break
        for p, k in zip(params, kept):
            p[...] = k
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.features(x))[-1][:, 0]

    def to_arrays(self) -> dict[str, np.ndarray]:
        return {"b": self.b} | {f"w{k}": w for k, w in enumerate(self.w)} | {f"c{k}": c for k, c in enumerate(self.c)}

    @classmethod
    def from_arrays(cls, a: dict[str, np.ndarray]) -> Network:
        net = cls.__new__(cls)
        net.b, net.w, net.c = a["b"], [a[f"w{k}"] for k in range(len(a) // 2)], [a[f"c{k}"] for k in range(len(a) // 2)]
        return net


def train_surrogate(roles: DataFrame, normalizer: Normalizer, hidden: list[int], max_rows: int = 200_000) -> DataFrame:
    """(seed, fold, n_train, rmse, mae, constant_rmse) from (seed, fold, role, px, py, label): a network a (seed, fold), one task each.

    A network learns from at most max_rows training rows and stops by as many validation rows, those with the least md5 of
    their coordinates; the errors are those of all test rows, to which the network goes as a broadcast.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("seed", "fold", "role").orderBy(F.md5(F.concat_ws(":", "px", "py")))
    bounded = roles.where("role <> 'test'").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max_rows).drop("__k")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y = normalizer(group.px.to_numpy(), group.py.to_numpy())
        points, label, role = np.stack([x, y], axis=1), group.label.to_numpy(dtype=float), group.role.to_numpy()
        train, val = (role == r for r in ("train", "validation"))
        seed, fold = int(group.seed.iloc[0]), int(group.fold.iloc[0])
        if not train.any():
            return pd.DataFrame(columns=["seed", "fold", "n_train", "mean", "std", "net"])
        mean, std = label[train].mean(), label[train].std() or 1.0
        net = Network(2, hidden, seed).fit(points[train], (label[train] - mean) / std, points[val], (label[val] - mean) / std, seed=seed)
        return pd.DataFrame([(seed, fold, int(train.sum()), float(mean), float(std), pickle.dumps(net))], columns=["seed", "fold", "n_train", "mean", "std", "net"])

    nets = round_table(bounded.groupBy("seed", "fold").applyInPandas(fit, "seed int, fold int, n_train int, mean double, std double, net binary"), "nets")
    known: dict[bytes, Network] = {}

    @F.pandas_udf("double")
    def predicted(px: pd.Series, py: pd.Series, raw: pd.Series) -> pd.Series:
        x, y = normalizer(px.to_numpy(), py.to_numpy())
        points, out = np.stack([x, y], axis=1), np.empty(len(px))
        for blob in raw.unique():
            if blob not in known:
                known[blob] = pickle.loads(blob)
            on = (raw == blob).to_numpy()
            out[on] = known[blob].predict(points[on])
        return pd.Series(out)

    # A network a (seed, fold), of some kilobytes each.
    test = roles.where("role = 'test'").join(F.broadcast(nets), ["seed", "fold"])
    e = F.col("pred") * F.col("std") + F.col("mean") - F.col("label")
    c = F.col("mean") - F.col("label")
    errors = test.withColumn("pred", predicted("px", "py", "net")).groupBy("seed", "fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(c * c)).alias("constant_rmse"))
    every = roles.groupBy("seed", "fold").agg(F.count_if(F.col("role") == "train").alias("trained"))
    return every.join(nets.select("seed", "fold", "n_train"), ["seed", "fold"], "left").join(errors, ["seed", "fold"], "left").select("seed", "fold", F.coalesce("n_train", F.lit(0)).alias("n_train"), "rmse", "mae", "constant_rmse")


def predict_surrogate(points: DataFrame, net: Network, normalizer: Normalizer, shift: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Points with ``pred``: the broadcast weights applied to Arrow batches."""
    shared = points.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for px, py in batches:
            x, y = normalizer(px.to_numpy(), py.to_numpy())
            yield pd.Series(shared.value.predict(np.stack([x, y], axis=1)) * scale + shift)

    return points.withColumn("pred", predict("px", "py"))
