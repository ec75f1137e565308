"""Connected components of an edge table, by contraction.

Each round every vertex hooks onto its least neighbour, pointer jumps bring all
vertices of a tree to its root, and the edges are rewritten between the roots.  Edges
inside a root vanish, so a round works on what is left.  A root that still has an edge
has others hooked onto it, so a round leaves half the vertices at most, and a tree of
depth d takes log2(d) jumps: long chains take few rounds, whatever the order of their ids.
Vertices are aggregated with map-side partial results and joined by shuffles that AQE
may split; no vertex's edges are gathered in one row, however many it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import cut, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., id, component): each vertex with the least id it reaches.

    ``keys`` name columns that keep separate graphs apart.  Loops and repeated
    edges do no harm; edges with a null end are ignored; vertices without edges
    are not listed (join with ``coalesce(component, id)``).
    """
    k = list(keys)
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*k, F.col(src).alias("src"), F.col(dst).alias("dst"))
    todo = cut(ends.select(*k, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    hooks: list[DataFrame] = []
    while not hooks or not todo.isEmpty():
        both = todo.select(*k, F.col("dst").alias("id"), F.col("src").alias("to")).union(todo.select(*k, F.col("src").alias("id"), F.col("dst").alias("to")))
        hook = _to_roots(cut(both.groupBy(*k, "id").agg(F.min("to").alias("to")).select(*k, "id", F.least("id", "to").alias("root"))), k)
        hooks.append(hook)
        a = hook.select(*k, F.col("id").alias("src"), F.col("root").alias("a"))
        b = hook.select(*k, F.col("id").alias("dst"), F.col("root").alias("b"))
        moved = todo.join(a, [*k, "src"]).join(b, [*k, "dst"]).where("a <> b")
        left = cut(moved.select(*k, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        release(todo)
        todo = left
    done = hooks[-1].select(*k, "id", "root")
    for hook in reversed(hooks[:-1]):  # later rounds are smaller
        up = done.select(*k, F.col("id").alias("root"), F.col("root").alias("up"))
        done = hook.join(up, [*k, "root"], "left").select(*k, "id", F.coalesce("up", "root").alias("root"))
    out = cut(done.withColumnRenamed("root", "component"))
    release(todo, *hooks)
    return out


def _to_roots(hook: DataFrame, k: list[str]) -> DataFrame:
    """Pointers (keys, id, root) led on until each root is its own; every jump doubles their reach."""
    while True:
        up = hook.select(*k, F.col("id").alias("root"), F.col("root").alias("up"))
        further = cut(hook.join(up, [*k, "root"]).select(*k, "id", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
        release(hook)
        hook = further
        if hook.where("moved").isEmpty():
            return hook
