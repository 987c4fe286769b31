"""Conduit sizes along a network's branches, by sequential Gaussian simulation.

In one dimension with an exponential covariance the simple-kriging mean and
variance at a place depend on the last simulated place alone: with a
correlation of r over the distance between them, the mean is r times its value
and the variance 1 - r^2. So a branch is simulated from its beginning to its
end in linear time. A share of the variance is common to a whole branch (the
part between branches), the rest varies along it; normal scores become sizes by
the quantiles of a given distribution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(at: np.ndarray, reach: float, between: float, rng: np.random.Generator) -> np.ndarray:
    """Normal scores at ascending places along a branch; 95 % of the correlation is gone at a distance of reach."""
    common, steps = rng.standard_normal(), rng.standard_normal(len(at))
    out = np.empty(len(at))
    r = np.exp(-3 * np.diff(at) / reach)
    for k in range(len(at)):
        out[k] = steps[k] if k == 0 else r[k - 1] * out[k - 1] + math.sqrt(max(0.0, 1 - r[k - 1] ** 2)) * steps[k]
    return math.sqrt(between) * common + math.sqrt(1 - between) * out


def conduit_sizes(nodes: DataFrame, distribution: Sequence[float], reach: float, between: float = 0.5, seed: int = 1) -> DataFrame:
    """branch_id, node_id and size of nodes(branch_id, node_id, along), along being the distance from the branch's beginning.

    distribution are quantiles of sizes, such as the values that
    read_distribution reads. Nodes with null along have no size. The same seed
    gives the same sizes, each branch having its own stream.
    """
    if not 0 <= between <= 1 or reach <= 0 or not len(distribution):
        raise ValueError("between must be 0 to 1, reach above 0, and there must be a distribution")
    values = np.sort(np.array(distribution, float))
    places = (np.arange(len(values)) + 0.5) / len(values)

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("along", "ascending"), ("node_id", "ascending")])
        branch = t.column("branch_id")[0].as_py()
        rng = np.random.default_rng([seed, branch & (2**63 - 1)])
        z = scores(t.column("along").to_numpy(), reach, between, rng)
        share = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
        return pa.table({"branch_id": t.column("branch_id"), "node_id": t.column("node_id"), "size": np.interp(share, places, values)})

    slim = nodes.select(F.col("branch_id").cast("long").alias("branch_id"), F.col("node_id").cast("long").alias("node_id"), F.col("along").cast("double").alias("along"))
    return slim.filter("branch_id is not null and along is not null").groupBy("branch_id").applyInArrow(one, "branch_id long, node_id long, size double")
