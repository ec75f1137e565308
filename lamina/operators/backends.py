"""Segmentation back ends by name, and sweeps that outlive a point's failure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import cut

from . import graph, kernels

#: Back ends that look at the same parameters, as sets for ``sweep.sweep_grid``.
FAMILIES = {"components": {"graph_cc", "cc3d_mean", "cupy_mean", "cupy_graph_cc"}, "watershed": {"mahotas_watershed", "scipy_watershed"}, "agglomeration": {"mahotas_agglomeration", "scipy_agglomeration", "seeded_rag"}, "hierarchical": {"waterz"}}
#: Back ends whose fragments come from the second library; all others use the first.
SCIPY = {"scipy_watershed", "scipy_agglomeration"}
NAMES = frozenset().union(*FAMILIES.values())


@dataclass
class Point:
    """Parameters of one run; thresholds of z and of y, x default to ``threshold``."""

    backend: str
    threshold: float = 0.5
    min_size: int = 0
    seed_method: str = "maxima_distance"
    seed_distance: int = 10
    boundary_threshold: float = 0.5
    min_boundary: int = 1
    score_mode: str = "mean"
    quantile: float = 0.25
    z_threshold: float | None = None
    xy_threshold: float | None = None
    scoring: str = "hist_quantile"


@dataclass
class Backends:
    """Runs points over one volume; fragments are made once for each way of seeding."""

    vox: DataFrame
    fragments: dict[tuple, DataFrame] = field(default_factory=dict)

    def _fragments(self, p: Point) -> DataFrame:
        key = "scipy" if p.backend in SCIPY else "mahotas", p.seed_method, p.seed_distance, p.boundary_threshold
        if key not in self.fragments:
            self.fragments[key] = cut(kernels.watershed_fragments(self.vox, *key[1:], library=key[0]))
        return self.fragments[key]

    def _sized(self, parts: DataFrame, p: Point) -> DataFrame:
        """Components as 1, 2, ...; those that are too small, and what is in none, as 0."""
        numbered = parts.withColumn("component", F.col("component") + 1)
        return graph.relabel(graph.drop_small(numbered, "component", p.min_size, "__big"), "__big", "segment").drop("__big", "component")

    def run(self, p: Point) -> DataFrame:
        """The voxels with ``segment``."""
        z, xy = (p.threshold if t is None else t for t in (p.z_threshold, p.xy_threshold))
        if p.backend in ("graph_cc", "cupy_graph_cc"):
            return self._sized(graph.affinity_components(self.vox, (z, xy, xy)), p)
        if p.backend in ("cc3d_mean", "cupy_mean"):
            return self._sized(graph.mask_components(self.vox, (F.col("az") + F.col("ay") + F.col("ax")) / 3 >= p.threshold), p)
        if p.backend in FAMILIES["watershed"]:
            return self._fragments(p).withColumnRenamed("fragment", "segment")
        if p.backend in FAMILIES["agglomeration"]:
            return graph.agglomerate(self._fragments(p), "fragment", p.threshold, "segment", z, xy, p.min_boundary, p.score_mode, p.quantile).drop("fragment")
        if p.backend in FAMILIES["hierarchical"]:
            return kernels.hierarchical_agglomeration(self._fragments(p), "fragment", p.threshold, p.scoring).drop("fragment")
        raise ValueError(f"unknown backend {p.backend!r}")


def run_sweep(vox: DataFrame, points: list[Point], measure: Callable[[DataFrame], DataFrame], stop: bool = False) -> tuple[list[dict], list[dict]]:
    """(records, failures): what ``measure`` gives for each point's segments.

    ``measure`` returns a row a sample, so the driver gets few rows a point.  A
    point that fails is noted with its error and the others go on; with ``stop``
    its error is raised.
    """
    backends, records, failures = Backends(vox), [], []
    for p in points:
        try:
            records += [vars(p) | r.asDict() for r in measure(backends.run(p)).collect()]
        except Exception as e:  # noqa: BLE001  whatever a back end raises is its point's result
            if stop:
                raise
            failures.append(vars(p) | {"error": f"{type(e).__name__}: {e}"})
    return records, failures


def capabilities(spark: SparkSession, packages: tuple[str, ...] = ("h5py", "PIL", "scipy", "numpy", "pyarrow")) -> DataFrame:
    """(package, installed): optional packages that readers and kernels may use."""
    from importlib.util import find_spec

    return spark.createDataFrame([(p, find_spec(p) is not None) for p in packages], "package string, installed boolean")
