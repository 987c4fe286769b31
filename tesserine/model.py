"""Schemas and parameters of the spatial-graph engine."""

from __future__ import annotations

from dataclasses import dataclass, field

SAMPLES = "node_id bigint, x double, y double, z double"
EDGES = "src bigint, dst bigint, rank int, d2 double"
KEYPOINTS = "kp_id bigint, type string, x double, y double, z double, wt_idx int"
CONNECTIVITY = "sink_id bigint, spring_id bigint, flag int"


@dataclass(frozen=True)
class CostWeights:
    """Weights of the parts of an edge's cost; None leaves a part out."""

    horizon: float | None = None
    karstification: float | None = None
    fracture: float | None = None
    vadose: float | None = 1.0
    phreatic: float | None = 1.0
    max_distance: float = 50.0
    multiply: bool = False
    fracture_families: tuple[tuple[float, float], ...] = ()


@dataclass(frozen=True)
class Parameters:
    """A run's settings."""

    neighbours: int = 10
    radius: float | None = None
    old_cohesion: float = 0.9
    waypoint_weight: float = 0.9
    noise_weight: float = 0.0
    vadose_cohesion: bool = True
    single_outlet: bool = True
    seed: int = 1
    cost: CostWeights = field(default_factory=CostWeights)

    def __post_init__(self) -> None:
        if self.neighbours < 1:
            raise ValueError("neighbours must be 1 or more")
        if not 0 < self.old_cohesion <= 1:
            raise ValueError("old_cohesion must be in (0, 1]")
