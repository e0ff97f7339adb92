"""Mixtures of normal distributions, fitted to many groups at once, and texture classes by them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.joins import if_small
from loomspark.operators.embedding import _matrix, _sum_lists, group_k_means
from loomspark.sources.materialise import materialise

#: Added to each variance, rounds at most, and the rise of the mean log-likelihood at which a fit ends.
RIDGE, ROUNDS, LEAST_RISE = 1e-6, 100, 1e-4


@dataclass
class Mixture:
    """Parts of one group, in order of their first mean, and the mean log-likelihood after each round."""

    weight: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    history: list[float]

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """log of each part's weight times density, a row a point."""
        out = np.empty((len(x), len(self.weight)))
        for j, (w, m, s) in enumerate(zip(self.weight, self.mean, self.spread, strict=True)):
            root = np.linalg.cholesky(s)
            z = np.linalg.solve(root, (x - m).T)
            out[:, j] = np.log(max(w, 1e-300)) - 0.5 * ((z**2).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out


def _responsibilities(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each part, and the log-likelihood, of each point."""
    most = parts.max(axis=1, keepdims=True)
    total = most + np.log(np.exp(parts - most).sum(axis=1, keepdims=True))
    return np.exp(parts - total), total[:, 0]


def _ids(vectors: DataFrame, key: str) -> list[str]:
    return [c for c in vectors.columns if c not in (key, "vector")]


def fit_mixtures(vectors: DataFrame, key: str, k: dict[str, int], seeds: int = 3) -> dict[str, Mixture]:
    """A mixture of ``k`` normal distributions for each group named in ``k``, by expectation and maximisation.

    ``vectors(key, ..., vector)``; other columns tell rows apart. Fits start from k-means. In each round tasks
    sum up shares, points and their products by group, and the driver gets one row of these a group. A group
    ends with its log-likelihood, which never falls; a group with fewer rows than parts is an error.
    """
    own = vectors.select(F.col(key).cast("string").alias("key"), F.xxhash64(*_ids(vectors, key)).alias("obs_id"), "vector").where(F.col("key").isin(list(k)))
    rows = materialise(own)
    several = {name: n for name, n in k.items() if n > 1}
    start = rows.join(group_k_means(rows, "key", several, "vector", seeds), ["key", "obs_id"], "left") if several else rows.withColumn("cluster", F.lit(0))
    start = start.select("key", "vector", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    models: dict[str, Mixture] = {}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("key").to_pylist(), dtype=object)
            for name in dict.fromkeys(names):
                here = pa.array(names == name)
                x = _matrix(batch.column("vector").filter(here))
                if name in models:
                    r, fit = _responsibilities(models[name].log_parts(x))
                else:
                    r, fit = np.eye(k[name])[batch.column("cluster").filter(here).to_numpy()], np.zeros(len(x))
                one = np.concatenate((np.ones((len(x), 1)), x), axis=1)
                sums = np.einsum("ij,ia,ib->jab", r, one, one).ravel()
                part = np.append(sums, fit.sum())
                held[name] = held[name] + part if name in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["key", "sums"])

    table, open_ = start, set(k)
    for _ in range(ROUNDS + 1):
        found = _sum_lists(table.where(F.col("key").isin(sorted(open_))).mapInArrow(moments, "key string, sums array<double>"), ["key"], sums="array<double>").collect()  # a row a group
        for row in found:
            sums, fit = np.array(row.sums[:-1]), row.sums[-1]
            width = int(round((len(sums) / k[row.key]) ** 0.5))
            m = sums.reshape(k[row.key], width, width)
            n = np.maximum(m[:, 0, 0], 1e-12)
            total = m[:, 0, 0].sum()
            history = models[row.key].history if row.key in models else []
            if row.key in models:
                history = [*history, float(fit / total)]
                if len(history) > 1 and history[-1] - history[-2] < LEAST_RISE:
                    models[row.key].history = history
                    open_.discard(row.key)
                    continue
            mean = m[:, 0, 1:] / n[:, None]
            spread = m[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + RIDGE * np.eye(width - 1)
            models[row.key] = Mixture(m[:, 0, 0] / total, mean, spread, history)
        if not open_ or not found:
            break
        table = rows
    for name, model in models.items():
        order = np.lexsort(model.mean.T[::-1])
        models[name] = Mixture(model.weight[order], model.mean[order], model.spread[order], model.history)
    missing = set(k) - set(models)
    if missing:
        raise ValueError(f"no rows to fit a mixture to: {sorted(missing)}")
    return models


def classify(vectors: DataFrame, key: str, models: dict[str, Mixture]) -> DataFrame:
    """Every row with the likeliest part of its group's mixture, ``part``, and its log-likelihood, ``fit``."""
    ids = _ids(vectors, key)
    rows = vectors.select(key, *ids, "vector").where(F.col(key).cast("string").isin(list(models)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([str(v) for v in batch.column(0).to_pylist()], dtype=object)
            part, fit = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for name in dict.fromkeys(names):
                here = names == name
                logs = models[name].log_parts(_matrix(batch.column("vector").filter(pa.array(here))))
                part[here], fit[here] = logs.argmax(axis=1), _responsibilities(logs)[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *ids)), pa.array(part), pa.array(fit)], [key, *ids, "part", "fit"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(scan, ", ".join([*(f"{c} {kinds[c]}" for c in (key, *ids)), "part int, fit double"]))


def tissue_textures(textures: DataFrame, parts: int = 4, tissue: int = 2, seeds: int = 3) -> DataFrame:
    """Tiles by texture class, ``(section, tx, ty, part, score, tissue)``.

    ``textures(section, tx, ty, energy, homogeneity, entropy)``. Classes are the parts of a section's mixture; a
    class scores the mean of energy plus homogeneity less entropy, and the ``tissue`` lowest are tissue. Sections
    of fewer tiles than parts are left out.
    """
    measures = ["energy", "homogeneity", "entropy"]
    vectors = textures.select("section", "tx", "ty", F.array(*measures).alias("vector"))
    n = {r.section: parts for r in vectors.groupBy("section").count().where(F.col("count") >= parts).collect()}  # a row a section
    classes = classify(vectors, "section", fit_mixtures(vectors, "section", n, seeds)).join(textures, ["section", "tx", "ty"])
    score = classes.groupBy("section", "part").agg(F.round(F.avg(F.col("energy") + F.col("homogeneity") - F.col("entropy")), 9).alias("score"))
    ranked = score.withColumn("tissue", F.row_number().over(Window.partitionBy("section").orderBy("score", "part")) <= tissue)  # a row a class
    return classes.join(if_small(ranked), ["section", "part"]).select("section", "tx", "ty", "part", "score", "tissue")
