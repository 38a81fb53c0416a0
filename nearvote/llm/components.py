"""Connected components of an edge table, by alternating stars.

Each round lets every node point at the smallest id it knows: the large star
moves a node's larger neighbours to its smallest one, the small star moves its
smaller ones. All steps are joins and aggregates over edges, so neither links
nor components of a large table ever meet in one place, and edges first shrink
to a spanning forest within each task. A forest of at most ``SMALL`` edges
(counted; some tens of MB) is finished by union-find in a single task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import discard, gives_back, materialize

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
CHUNK = SMALL = 250_000


@gives_back
def _forest(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Per task: edges to the smallest id of their component, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def flush() -> Iterator[pa.RecordBatch]:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        for i in range(0, len(pairs), 50_000):
            a, b = zip(*pairs[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > chunk:
            yield from flush()
            parent.clear()
    yield from flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = near.where("b > a" if large else "b < a").join(least, F.col("a") == F.col("u"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): each id in an edge, and the smallest id it is linked to; a
    written table (see :func:`~nearvote.llm.common.materialize`)."""
    now = materialize(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct())
    state = _state(now)
    if 0 < state[0] <= SMALL:
        single = materialize(now.coalesce(1).mapInArrow(lambda it: _forest(it, 2 * SMALL), "a long, b long"))
        discard(now)
        now, state = single, (0,)
    while state[0]:
        step = materialize(_star(_star(now, True), False))
        discard(now)
        now, before = step, state
        state = _state(now)
        if state == before:
            break
    # Every edge points at the smallest id of its component.
    roots = now.select(F.col("b").alias("id")).distinct()
    found = materialize(now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots.select("id", F.col("id").alias("comp"))))
    discard(now)
    return found
