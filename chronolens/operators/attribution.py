"""Leave-one-release-group-out tests with mixture models: every model that any permutation asks for, fitted in the same passes.

A class model is a diagonal normal mixture of the rows of some generators, with the number of components chosen by BIC. Which
generators those are is all that distinguishes models: permutations, held-out groups and classes ask for the same sets again and
again, so each set is one model. Rows are read once for all of them: a row carries the number of its generator, and a step of
expectation-maximisation is one pass that returns sums for each (variant, set, number of components, component), added up by key;
what reaches the driver is parameters. A fit begins at its set's moments, which are sums of its generators', with the components
spread along the widest element. One more pass gives each generator's mean log likelihood under each model, a table of registries,
from which statistics of all permutations follow without touching rows.

Variants move each generator's rows by a vector of its own (planted drift) without copying them.

Edge cases: rows with a null or non-finite element are left out. A set whose generators have no rows has no model, and a generator
without rows no likelihood: NaN, and statistics leave them out. A family with fewer than 2 x n_bins release groups isn't testable.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import dealt

RIDGE = 1e-3
PER_COMPONENT = 5


class Sets:
    """Distinct sets of generators, by number."""

    def __init__(self):
        self.number: dict[frozenset, int] = {}

    def of(self, members) -> int:
        return self.number.setdefault(frozenset(members), len(self.number))

    def keep(self, generators: int) -> np.ndarray:
        out = np.zeros((len(self.number), generators), bool)
        for s, k in self.number.items():
            out[k, list(s)] = True
        return out


def _rows(batch: pa.RecordBatch, arms: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x arms x elements, and the generators' numbers."""
    d = len(batch.column("x")[0]) if batch.num_rows else arms
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, arms, d // arms), batch.column("g").to_numpy(zero_copy_only=False)


def _of(x: np.ndarray, g: np.ndarray, arm: int) -> tuple[np.ndarray, np.ndarray]:
    """An arm's rows, those whose elements are all finite."""
    ok = np.isfinite(x[:, arm]).all(1)
    return x[ok, arm], g[ok]


def _input(df: DataFrame, generators: list, generator: str, x: str) -> DataFrame:
    number = df.sparkSession.createDataFrame([(g, k) for k, g in enumerate(generators)], f"name_ {dict(df.dtypes)[generator]}, g int")
    rows = df.join(F.broadcast(number), F.col(generator) == F.col("name_")).select("g", F.col(x).cast("array<double>").alias("x"))
    return rows.where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL)")


def moments(data: DataFrame, generators: int, d: int, arms: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, sums and sums of squares of each arm and generator."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((arms, generators, 1 + 2 * d))
        for b in batches:
            x0, g0 = _rows(b, arms)
            for arm in range(arms):
                x, g = _of(x0, g0, arm)
                np.add.at(rows[arm], g, np.hstack([np.ones((len(x), 1)), x, x * x]))
        flat = rows.reshape(arms * generators, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype="int32")), *[pa.array(c) for c in flat.T]], names=names)

    names = ["g", *[f"c{i}" for i in range(1 + 2 * d)]]
    total = np.zeros((arms * generators, 1 + 2 * d))
    for r in data.mapInArrow(each, ", ".join(["g int", *[f"{c} double" for c in names[1:]]])).groupBy("g").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():
        total[r.g] = r[1:]
    total = total.reshape(arms, generators, -1)
    return total[:, :, 0], total[:, :, 1 : 1 + d], total[:, :, 1 + d :]


def _log_density(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """rows x components: log weight + log density."""
    with np.errstate(divide="ignore"):
        constant = np.log(weight) - 0.5 * np.log(2 * np.pi * var).sum(1) - 0.5 * (mean * mean / var).sum(1)
    return constant - 0.5 * (x * x) @ (1 / var).T + x @ (mean / var).T


def _log_sum(joint: np.ndarray) -> np.ndarray:
    top = joint.max(1)
    return top + np.log(np.exp(joint - top[:, None]).sum(1))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(float(v)) for v in p])


class Mixtures:
    """All fits: for each (variant, set) those of 1 to `most` components, at most one for PER_COMPONENT rows, as flat arrays of components."""

    def __init__(self, keep: np.ndarray, shifts: np.ndarray, arms: int, n: np.ndarray, s: np.ndarray, q: np.ndarray, most: int):
        self.keep, self.shifts, self.arms = keep, shifts, arms
        fits, weight, mean, var = [], [], [], []
        for v, shift in enumerate(shifts):
            of = self.arm(v)
            sv, qv = s[of] + n[of][:, None] * shift, q[of] + 2 * shift * s[of] + n[of][:, None] * shift * shift
            for m, k in enumerate(keep):
                rows = n[of][k].sum()
                if not rows:
                    continue
                mu = sv[k].sum(0) / rows
                sigma = np.maximum(qv[k].sum(0) / rows - mu * mu, 0) + RIDGE
                widest = int(sigma.argmax())
                for c in range(1, max(1, min(most, int(rows // PER_COMPONENT))) + 1):
                    places = np.tile(mu, (c, 1))
                    places[:, widest] += np.sqrt(sigma[widest]) * _normal_quantile((np.arange(c) + 0.5) / c)
                    fits.append((v, m, c, rows))
                    weight.append(np.full(c, 1 / c))
                    mean.append(places)
                    var.append(np.tile(sigma, (c, 1)))
        self.fits = fits
        self.ends = np.cumsum([0, *[len(w) for w in weight]])
        self.weight, self.mean, self.var = (np.concatenate(a) if a else np.zeros(0) for a in (weight, mean, var))

    def arm(self, variant: int) -> int:
        return variant if self.arms > 1 else 0

    def places(self, only: np.ndarray) -> Iterator[tuple[int, slice]]:
        for f in only.tolist():
            yield f, slice(self.ends[f], self.ends[f + 1])


def _pass(data: DataFrame, m: Mixtures, only: np.ndarray, d: int) -> np.ndarray:
    """components x (responsibility, sums, sums of squares, log likelihood of the fit) over the rows of each fit's set."""
    names = ["c", *[f"s{i}" for i in range(2 + 2 * d)]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((int(m.ends[-1]), 2 + 2 * d))
        for b in batches:
            x0, g0 = _rows(b, m.arms)
            for v in np.unique([m.fits[f][0] for f in only.tolist()]).tolist():
                x, g = _of(x0, g0, m.arm(v))
                x = x + m.shifts[v][g]
                for f, at in m.places(only):
                    if m.fits[f][0] != v:
                        continue
                    mine = x[m.keep[m.fits[f][1]][g]]
                    if not len(mine):
                        continue
                    joint = _log_density(mine, m.weight[at], m.mean[at], m.var[at])
                    total = _log_sum(joint)
                    r = np.exp(joint - total[:, None])
                    out[at, 0] += r.sum(0)
                    out[at, 1 : 1 + d] += r.T @ mine
                    out[at, 1 + d : 1 + 2 * d] += r.T @ (mine * mine)
                    out[at.start, -1] += total.sum()
        some = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), *[pa.array(c) for c in out[some].T]], names=names)

    total = np.zeros((int(m.ends[-1]), 2 + 2 * d))
    for r in data.mapInArrow(each, ", ".join(["c int", *[f"{c} double" for c in names[1:]]])).groupBy("c").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():
        total[r.c] = r[1:]
    return total


def fit(data: DataFrame, keep: np.ndarray, shifts: np.ndarray, d: int, most: int, steps: int, tol: float = 1e-4, arms: int = 1, widths: list[int] | None = None) -> tuple[Mixtures, np.ndarray]:
    """(fits, the number of the best by BIC for each variant x set, -1 for none)."""
    m = Mixtures(keep, shifts, arms, *moments(data, keep.shape[1], d, arms), most)
    likelihood = np.full(len(m.fits), -np.inf)
    only = np.arange(len(m.fits))
    for step in range(steps + 1):
        sums = _pass(data, m, only, d)
        now = np.array([sums[at.start, -1] for _, at in m.places(only)])
        moved = (now - likelihood[only] > tol * np.array([m.fits[f][3] for f in only.tolist()])) & (np.array([m.fits[f][2] for f in only.tolist()]) > 1)
        likelihood[only] = now
        if step == steps or not moved.any():
            break
        only = only[moved]
        for f, at in m.places(only):
            r = np.maximum(sums[at, 0], 1e-12)[:, None]
            m.weight[at] = np.maximum(sums[at, 0] / m.fits[f][3], 1e-12)
            m.mean[at] = sums[at, 1 : 1 + d] / r
            m.var[at] = np.maximum(sums[at, 1 + d : 1 + 2 * d] / r - m.mean[at] ** 2, 0) + RIDGE
    best = np.full((len(shifts), len(keep)), -1)
    cost: dict = {}
    for f, (v, k, c, rows) in enumerate(m.fits):
        wide = widths[m.arm(v)] if widths else d
        bic = -2 * likelihood[f] + (c * (2 * wide + 1) - 1) * np.log(rows)
        if (v, k) not in cost or bic < cost[v, k]:
            cost[v, k], best[v, k] = bic, f
    return m, best


def likelihoods(df: DataFrame, generators: list, sets: Sets, generator: str = "generator", x: str = "x", shifts: np.ndarray | None = None, most: int = 4, steps: int = 20, arms: int = 1, widths: list[int] | None = None) -> np.ndarray:
    """variants x sets x generators: the mean log likelihood of each generator's rows under the mixture of each set.

    With several arms, x holds the vectors of all of them one after the other, as wide as the widest (`widths`: how many elements of each
    count, the others being 0 throughout), an arm is a variant, and rows with an element of an arm that isn't finite aren't in it."""
    data = _input(df, generators, generator, x)
    data = dealt(data, data.count(), max(100, 5_000 // (arms if shifts is None else len(shifts)))).persist()
    first = data.first()
    d, keep = len(first.x) // arms if first else 1, sets.keep(len(generators))
    shifts = np.zeros((arms, len(generators), d)) if shifts is None else shifts
    m, best = fit(data, keep, shifts, d, most, steps, arms=arms, widths=widths)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(shifts), len(keep), len(generators))), np.zeros((len(shifts), len(generators)))
        for b in batches:
            x0, g0 = _rows(b, arms)
            for v in range(len(shifts)):
                rows, g = _of(x0, g0, m.arm(v))
                moved = rows + shifts[v][g]
                n[v] += np.bincount(g, minlength=len(generators))
                for k, f in enumerate(best[v].tolist()):
                    if f >= 0:
                        at = slice(m.ends[f], m.ends[f + 1])
                        total[v, k] += np.bincount(g, _log_sum(_log_density(moved, m.weight[at], m.mean[at], m.var[at])), len(generators))
        v, k, g = np.nonzero(np.broadcast_to((n > 0)[:, None], total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (v, k, g, total[v, k, g], n[v, g])], names=["v", "s", "g", "ll", "n"])

    out = np.full((len(shifts), len(keep), len(generators)), np.nan)
    for r in data.mapInArrow(each, "v bigint, s bigint, g bigint, ll double, n double").groupBy("v", "s", "g").agg((F.sum("ll") / F.sum("n")).alias("ll")).collect():
        if best[r.v, r.s] >= 0:
            out[r.v, r.s, r.g] = r.ll
    data.unpersist()
    return out


def time_classes(dates: np.ndarray, n_bins: int) -> np.ndarray:
    """The bin of each release group: as many groups in each, in order of date."""
    rank = np.empty(len(dates), int)
    rank[np.argsort(dates, kind="stable")] = np.arange(len(dates))
    return np.minimum(n_bins - 1, rank * n_bins // len(dates))


class Plan:
    """What one order of classes asks for: for each held-out group the sets of all classes without it."""

    def __init__(self, classes: np.ndarray, groups: np.ndarray, sets: Sets, n_classes: int, offset: int):
        self.classes, self.groups = classes, groups  # of each generator
        self.ask = {g: [sets.of(offset + np.flatnonzero((classes == c) & (groups != g))) for c in range(n_classes)] for g in np.unique(groups).tolist()}

    def statistics(self, ll: np.ndarray) -> dict[str, float]:
        """acc, mae, llr: means over release groups of the means of their generators. ll: sets x this family's generators."""
        by_group = []
        for g, ask in self.ask.items():
            rows = []
            for k in np.flatnonzero(self.groups == g).tolist():
                score, true = ll[ask, k], int(self.classes[k])
                if np.isfinite(score).all():
                    found = int(np.argmax(np.round(score, 9)))
                    rows.append((found == true, abs(found - true), score[true] - np.delete(score, true).mean()))
            if rows:
                by_group.append(np.mean(rows, axis=0))
        return dict(zip(("acc", "mae", "llr"), np.mean(by_group, axis=0).tolist() if by_group else [float("nan")] * 3, strict=True))


def tested(observed: dict[str, float], null: list[dict[str, float]]) -> dict[str, float]:
    """Statistics with the mean and 95 % point of the null and one-sided p values (mae: small is good)."""
    out = dict(observed) | {"perms": len(null)}
    for c in ("acc", "llr", "mae"):
        values = np.array([x[c] for x in null])
        beyond = values <= observed[c] + 1e-9 if c == "mae" else values >= observed[c] - 1e-9
        out |= {f"p_{c}": float((1 + beyond.sum()) / (1 + len(values))), f"null_{c}": float(values.mean()) if len(values) else float("nan"), f"q95_{c}": float(np.quantile(values, 0.95)) if len(values) else float("nan")}
    return out


def release_groups(dates: list[datetime.date], window: int) -> np.ndarray:
    """The release group of each generator: a new one after a gap of more than `window` days."""
    order = np.argsort(dates, kind="stable")
    days = np.array([d.toordinal() for d in dates])[order]
    out = np.empty(len(dates), int)
    out[order] = np.cumsum(np.append(0, np.diff(days) > window))
    return out


def time_test(
    df: DataFrame, registry: dict[object, list[tuple]], n_bins: int | list[int] = 3, perms: int = 1000, seed: int = 0, window: int = 7, shifts: np.ndarray | None = None,
    generator: str = "generator", x: str = "x", most: int = 4, arms: int = 1, widths: list[int] | None = None,
) -> list[dict]:
    """Can a generator be dated by those of other release groups? For each family and variant the statistics and their permutation
    null, in which release groups exchange their dates. registry: {family: [(generator, date)]}; shifts: variants x all generators of
    the registry in its order x elements; arms and widths: see likelihoods(); n_bins may be a list, of one number for each arm."""
    sets, plans, names, out = Sets(), {}, [], []
    bins = n_bins if isinstance(n_bins, list) else [n_bins] * max(arms, 1 if shifts is None else len(shifts))
    for family, members in registry.items():
        groups = release_groups([d for _, d in members], window)
        count, offset = int(groups.max()) + 1, len(names)
        names += [g for g, _ in members]
        first = np.array([min(d.toordinal() for (_, d), k in zip(members, groups, strict=True) if k == g) for g in range(count)])
        orders = [first] + [first[np.random.default_rng([seed, p]).permutation(count)] for p in range(1, perms + 1)]
        for b in sorted(set(bins)):
            if count >= 2 * b:
                plans[family, b] = (offset, len(members), count, [Plan(time_classes(o, b)[groups], groups, sets, b, offset) for o in orders])
            else:
                some = {"family": family, "n_groups": count, "n_generators": len(members), "not_testable": f"{2 * b} release groups are needed for {b} bins, {count} are there"}
                out += [some | {"variant": v} for v, x in enumerate(bins) if x == b]
    if not plans:
        return out
    ll = likelihoods(df, names, sets, generator, x, shifts, most, arms=arms, widths=widths)
    for (family, b), (offset, size, count, of) in plans.items():
        for v in [v for v, x in enumerate(bins) if x == b]:
            seen, *null = [p.statistics(ll[v][:, offset : offset + size]) for p in of]
            out.append({"family": family, "variant": v, "n_groups": count, "n_generators": size, **tested(seen, null)})
    return out


def lineage_test(df: DataFrame, registry: dict[object, list[tuple]], perms: int = 200, seed: int = 0, window: int = 7, generator: str = "generator", x: str = "x", most: int = 4, tries: int = 100_000) -> list[dict]:
    """Is a held-out release group's lineage told by its vectors? registry: {family: [(generator, date, lineage or None)]}.

    Lineages that span one group and generators without one are left out. The null deals labels anew to generators; an order under
    which a label doesn't span two groups can't be tested, so orders are drawn on until `perms` are found. `perms` in the result is how
    many there are: fewer only if `tries` draws held no more, which the result then shows."""
    sets, plans, names, out = Sets(), {}, [], []
    for family, members in registry.items():
        groups = release_groups([m[1] for m in members], window)
        spans = {}
        for (_, _, label), g in zip(members, groups.tolist(), strict=True):
            spans.setdefault(label, set()).add(g)
        use = [k for k, m in enumerate(members) if m[2] is not None and len(spans[m[2]]) >= 2]
        labels = sorted({members[k][2] for k in use})
        if len(labels) < 2:
            out.append({"family": family, "n_generators": len(use), "n_classes": len(labels), "not_testable": "two lineages that span two release groups each are needed"})
            continue
        offset, own = len(names), groups[use]
        names += [members[k][0] for k in use]
        true = np.array([labels.index(members[k][2]) for k in use])
        valid = lambda c, own=own, n=len(labels): all(len(set(own[c == j].tolist())) >= 2 for j in range(n))
        orders, rng = [true], np.random.default_rng([seed, len(use)])
        for _ in range(tries):
            if len(orders) > perms:
                break
            c = rng.permutation(true)
            if valid(c):
                orders.append(c)
        plans[family] = (offset, len(use), labels, [Plan(c, own, sets, len(labels), offset) for c in orders])
    if not plans:
        return out
    ll = likelihoods(df, names, sets, generator, x, None, most)[0]
    for family, (offset, size, labels, of) in plans.items():
        seen, *null = [p.statistics(ll[:, offset : offset + size]) for p in of]
        out.append({"family": family, "n_generators": size, "n_classes": len(labels), "chance": 1 / len(labels), **tested(seen, null)})
    return out


def planted_shifts(df: DataFrame, registry: dict[object, list[tuple]], deltas: list[float], reps: int, seed: int = 0, window: int = 7, generator: str = "generator", x: str = "x") -> tuple[np.ndarray, list[tuple[float, int]]]:
    """(shifts, (delta, repetition) of each variant): along a direction drawn for each repetition, each generator moves by delta x its
    time in [0, 1] x the deviation of rows from their generator's mean in that direction, so delta is the whole drift in such units."""
    names = [g for m in registry.values() for g, *_ in m]
    data = _input(df, names, generator, x)
    first = data.first()
    d = len(first.x) if first else 1
    t = np.zeros(len(names))
    at = 0
    for members in registry.values():
        groups = release_groups([m[1] for m in members], window)
        days = np.array([min(m[1].toordinal() for m, k in zip(members, groups, strict=True) if k == g) for g in groups.tolist()], float)
        t[at : at + len(members)] = (days - days.min()) / max(1.0, np.ptp(days))
        at += len(members)
    means_n, means_s, _ = (m[0] for m in moments(data, len(names), d))
    mean = means_s / np.maximum(means_n, 1)[:, None]
    directions = np.array([u / np.linalg.norm(u) for u in (np.random.default_rng([seed, 7, r]).normal(size=d) for r in range(reps))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, n = np.zeros((len(names), reps)), np.zeros(len(names))
        for b in batches:
            rows, g = _of(*_rows(b, 1), 0)
            np.add.at(q, g, ((rows - mean[g]) @ directions.T) ** 2)
            n += np.bincount(g, minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(n), *[pa.array(c) for c in q.T]], names=columns)

    columns = ["g", "n", *[f"q{r}" for r in range(reps)]]
    found = {r.g: r for r in data.mapInArrow(each, ", ".join(["g bigint", *[f"{c} double" for c in columns[1:]]])).groupBy("g").agg(*[F.sum(c).alias(c) for c in columns[1:]]).collect()}
    unit, at = np.zeros((len(names), reps)), 0
    for members in registry.values():  # the spread is that of the family's rows about their generators' means
        of = [found[k] for k in range(at, at + len(members)) if k in found]
        n = max(1.0, sum(r.n for r in of))
        unit[at : at + len(members)] = np.sqrt([sum(r[f"q{j}"] for r in of) / n for j in range(reps)])
        at += len(members)
    variants = [(delta, r) for r in range(reps) for delta in deltas]
    return np.array([(delta * t * unit[:, r])[:, None] * directions[r] for delta, r in variants]), variants
