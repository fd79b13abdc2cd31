"""A table of specifications carried as one job: which elements, what scaling, what centring, how many components, which rows, how many bins.

Each of these steps but the choice of rows is linear, so a specification is a matrix: the scaled, centred and reduced vector is
W' (x - group mean - m), with one W and m for each. What all specifications need of the rows is then little: location and spread of
each element, once; the covariance about group means, once for each way of centring; and one pass that writes the reduced vectors of
all specifications side by side, with NaN where a specification leaves the row out. The test takes them as arms of one fit.

Edge cases: an element without spread is scaled by 1; more components than elements are as many as there are; a row without a group is
of a group of its own. A specification that leaves out all rows of a generator leaves that generator out of its statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attribution, vectors


@dataclass(frozen=True)
class Spec:
    """block: elements [from, to); scaling: robust, standard or none; centring: columns; g: components; bins; rows: SQL predicate."""

    name: str
    block: tuple[int, int]
    scaling: str = "robust"
    centring: tuple[str, ...] = ()
    g: int = 4
    bins: int = 2
    rows: str = "true"


def _spread(df: DataFrame, how: str, d: int) -> np.ndarray:
    out = np.ones(d)
    if how != "none":
        for r in vectors.scaling(df, how).select("i", "spread").collect():  # as long as a vector
            out[r.i] = r.spread
    return out


def maps(df: DataFrame, specs: list[Spec]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, axes) of each specification, for vectors less their group's mean."""
    d = len(df.select("x").first()[0])
    spread = {how: _spread(df, how, d) for how in sorted({s.scaling for s in specs})}
    moments = {c: vectors.covariance(vectors.centre(df, list(c)) if c else df) for c in sorted({s.centring for s in specs})}
    out = []
    for s in specs:
        mean, cov = moments[s.centring]
        own = np.arange(*s.block)
        scale = 1 / spread[s.scaling][own]
        values, axes = np.linalg.eigh(cov[np.ix_(own, own)] * scale * scale[:, None])
        axes = axes[:, np.argsort(values)[::-1][: s.g]]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        whole = np.zeros((d, axes.shape[1]))
        whole[own] = scale[:, None] * axes
        out.append((mean, whole))
    return out


def reduced(df: DataFrame, specs: list[Spec], keep: list[str]) -> tuple[DataFrame, list[int]]:
    """(`keep` and x: the vectors of all specifications side by side, each as wide as the widest; their widths), in one pass over the rows."""
    found, ways = maps(df, specs), sorted({s.centring for s in specs})
    wide = max(a.shape[1] for _, a in found)
    rows = df.withColumn("x", F.col("x").cast("array<double>"))
    for k, c in enumerate(ways):
        if c:
            means = vectors.group_means(rows, list(c)).select(*[F.col(n).alias(f"c_{n}") for n in c], F.col("mean").alias(f"mean_{k}"))
            on = [F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in c]
            rows = rows.join(F.broadcast(means) if means.count() <= 100_000 else means, on, "left").drop(*[f"c_{n}" for n in c])
    with_mean = [k for k, c in enumerate(ways) if c]
    rows = rows.select(*keep, "x", *[f"mean_{k}" for k in with_mean], F.array(*[F.coalesce(F.expr(s.rows), F.lit(False)) for s in specs]).alias("in_"))
    kinds = dict(rows.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            matrix = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)  # noqa: B023, E731
            x, inside = matrix("x"), matrix("in_").astype(bool)
            centred = {c: x - matrix(f"mean_{k}") if c else x for k, c in enumerate(ways)}
            out = np.zeros((n, len(specs), wide))
            for j, (s, (mean, axes)) in enumerate(zip(specs, found, strict=True)):
                out[:, j, : axes.shape[1]] = (centred[s.centring] - mean) @ axes
            out[~inside] = np.nan
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * len(specs) * wide), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], names=[*keep, "x"])

    return rows.mapInArrow(each, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "x array<double>"])), [a.shape[1] for _, a in found]


def time_tests(df: DataFrame, registry: dict[object, list[tuple]], specs: list[Spec], perms: int = 200, seed: int = 0) -> list[dict]:
    """attribution.time_test() of every specification, in the passes of one; each result carries its `spec`."""
    rows, widths = reduced(df, specs, ["generator"])
    found = attribution.time_test(rows, registry, [s.bins for s in specs], perms, seed, arms=len(specs), widths=widths)
    return [r | {"spec": specs[r["variant"]].name} for r in found]
