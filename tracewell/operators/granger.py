"""Multivariate lagged LASSO regression (Granger relations) on one-hot template series.

The regression needs only second moments. A sample of a one-hot series is the tuple of templates at
lags 0..maxlag, so Spark counts distinct tuples per fold and the moments follow from those counts;
no variable matrix is ever built. Targets are dealt to groups. A group gets its targets' own moments
and the sparse moments among the predictors, which every regression needs whole, and solves one
regression per target; nothing passes the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.order import with_halo
from tracewell.operators.windows import CHUNK
from tracewell.session import materialize, small_side

FOLDS = 5
GAP = 1e-4
#: Targets that share one copy of the predictors' moments.
GROUP_TARGETS = 8


def fold_of(i: Column, n: Column, folds: int = FOLDS) -> Column:
    """Contiguous fold of sample ``i`` out of ``n``; the first n mod folds have one more."""
    q, r = F.floor(n / folds), n % folds
    head = (q + 1) * r
    late = r + F.floor((i - head) / F.greatest(q, F.lit(1)))
    return F.when(i < head, F.floor(i / (q + 1))).otherwise(late).cast("int")


def lag_tuples(
    slots: DataFrame,
    maxlag: int = 3,
    folds: int = FOLDS,
    chunk: int = CHUNK,
    unordered: DataFrame | None = None,
) -> DataFrame:
    """(fold, t0..t<maxlag>, weight): counted template tuples; t0 is the target line, tk lag k.

    ``slots`` keeps every line position; rare templates are null and act as all-zero rows.
    """
    sizes = (slots if unordered is None else unordered).groupBy("source").agg((F.count(F.lit(1)) - maxlag).alias("_n"))
    cut = with_halo(slots, "line_no", chunk, before=maxlag)
    near = Window.partitionBy("source", "_chunk").orderBy("line_no")
    earlier = [F.lag("template", k).over(near).alias(f"t{k}") for k in range(1, maxlag + 1)]
    tuples = (
        cut.select("source", "line_no", "_own", F.col("template").alias("t0"), *earlier)
        .filter(F.col("_own") & (F.col("line_no") >= maxlag))
        .join(small_side(sizes), "source")
    )
    fold = fold_of(F.col("line_no") - maxlag, F.col("_n"), folds).alias("fold")
    names = [f"t{k}" for k in range(maxlag + 1)]
    return tuples.groupBy(fold, *names).agg(F.count(F.lit(1)).alias("weight"))


def moments(tuples: DataFrame, maxlag: int = 3) -> DataFrame:
    """(fold, la, va, lb, vb, cnt): joint counts of (lag, template) pairs; lag -1 is the intercept."""
    cells = [F.struct(F.lit(-1).alias("lag"), F.lit("").alias("v"))]
    cells += [F.struct(F.lit(k).alias("lag"), F.col(f"t{k}").alias("v")) for k in range(maxlag + 1)]
    pairs = [
        F.struct(
            a["lag"].alias("la"), a["v"].alias("va"), b["lag"].alias("lb"), b["v"].alias("vb")
        )
        for i, a in enumerate(cells)
        for b in cells[i:]
    ]
    return (
        tuples.select("fold", "weight", F.inline(F.array(*pairs)))
        .filter(F.col("va").isNotNull() & F.col("vb").isNotNull())
        .groupBy("fold", "la", "va", "lb", "vb")
        .agg(F.sum("weight").alias("cnt"))
    )


class Moments:
    """Sparse raw moments of the predictors per fold; the last row of all is their sum over the folds."""

    def __init__(self, i: np.ndarray, j: np.ndarray, fold: np.ndarray, cnt: np.ndarray, p: int, folds: int) -> None:
        self.p, self.folds = p, folds
        whole = np.full(len(i), folds)
        i, j, fold, cnt = (np.concatenate([x, y]) for x, y in ((i, i), (j, j), (fold, whole), (cnt, cnt)))
        self.n, self.sums = np.zeros(folds + 1), np.zeros((folds + 1, p))
        one, first = (i < 0) & (j < 0), (i < 0) & (j >= 0)
        np.add.at(self.n, fold[one], cnt[one])
        np.add.at(self.sums, (fold[first], j[first]), cnt[first])
        both = i >= 0
        i, j, fold, cnt = i[both], j[both], fold[both], cnt[both]
        off = i != j
        i, j = np.append(i, j[off]), np.append(j, i[off])
        at, cnt = np.append(fold, fold[off]) * p + i, np.append(cnt, cnt[off])
        order = np.argsort(at, kind="stable")
        self.column, self.value = j[order], cnt[order]
        self.start = np.searchsorted(at[order], np.arange((folds + 1) * p + 1))

    def row(self, fold: int, j: int) -> np.ndarray:
        at = slice(self.start[fold * self.p + j], self.start[fold * self.p + j + 1])
        out = np.zeros(self.p)
        np.add.at(out, self.column[at], self.value[at])
        return out


class Centred:
    """Centred moments per sample of all folds but ``held``; rows are built when they are asked for."""

    def __init__(self, raw: Moments, held: int | None) -> None:
        self.raw, self.held = raw, held
        self.n = self._left(raw.n)
        self.means = self._left(raw.sums) / self.n
        self.known: dict[int, np.ndarray] = {}

    def _left(self, values: np.ndarray) -> np.ndarray:
        return values[self.raw.folds] - (0 if self.held is None else values[self.held])

    def __getitem__(self, j: int) -> np.ndarray:
        if j not in self.known:
            row = self.raw.row(self.raw.folds, j)
            if self.held is not None:
                row -= self.raw.row(self.held, j)
            self.known[j] = row / self.n - self.means[j] * self.means
        return self.known[j]

    def diagonal(self) -> np.ndarray:
        # a predictor is 0 or 1, so its square has the same mean
        return self.means - self.means**2

    def target(self, sums: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Covariances with the predictors, variance and mean of a 0/1 target."""
        mean = self._left(sums) / self.n
        return self._left(cross) / self.n - self.means * mean, mean - mean * mean, mean


def _solve_path(gram, xy: np.ndarray, yy: float, grid: np.ndarray) -> np.ndarray:
    """Minimisers of 1/2 (yy - 2 b'xy + b'Gb) + alpha |b|_1, one row per alpha of the grid.

    Coordinate descent on all penalties at once; a row is done when its duality gap is closed or a
    whole sweep moves nothing. ``gram`` gives rows by index and its ``diagonal()``.
    """
    b = np.zeros((len(grid), len(xy)))
    residual = np.tile(xy, (len(grid), 1))
    scale = gram.diagonal()
    usable = np.nonzero(scale > 1e-12)[0]
    open_rows = np.arange(len(grid))
    while len(open_rows):
        w, res, alpha = b[open_rows], residual[open_rows], grid[open_rows]
        moved = np.zeros(len(open_rows), bool)
        for j in usable:
            rho = res[:, j] + scale[j] * w[:, j]
            step = np.sign(rho) * np.maximum(np.abs(rho) - alpha, 0.0) / scale[j] - w[:, j]
            if step.any():
                res -= np.outer(step, gram[j])
                moved |= np.abs(step) > 1e-12 * (1 + np.abs(w[:, j]))
                w[:, j] += step
        b[open_rows], residual[open_rows] = w, res
        fit = yy - w @ xy
        rr = fit - (w * res).sum(axis=1)
        shrink = np.minimum(1.0, alpha / np.maximum(np.abs(res).max(axis=1), 1e-300))
        gap = 0.5 * rr * (1 + shrink**2) + alpha * np.abs(w).sum(axis=1) - shrink * fit
        open_rows = open_rows[(gap > GAP * yy + 1e-12) & moved]
    return b


def _held_out_error(path: np.ndarray, a: np.ndarray, raw: Moments, fold: int, y: float, cross: np.ndarray) -> np.ndarray:
    """Squared errors of the fold's samples for each row of coefficients ``path`` with intercepts ``a``."""
    used = np.nonzero(path.any(axis=0))[0]
    some = path[:, used]
    inner = np.stack([raw.row(fold, j)[used] for j in used]) if len(used) else np.zeros((0, 0))
    return (
        y
        - 2 * (some @ cross[used])
        - 2 * a * y
        + np.einsum("ki,ij,kj->k", some, inner, some)
        + 2 * a * (some @ raw.sums[fold][used])
        + a * a * raw.n[fold]
    )


def cross_validated_lasso(
    raw: Moments, train: list[Centred], sums: np.ndarray, cross: np.ndarray, alphas: int = 100, eps: float = 1e-3
) -> np.ndarray:
    """Coefficients at the penalty with the least mean held-out error over the folds.

    ``train`` leaves out one fold each and none at last; ``sums`` and ``cross`` are the target's
    moments per fold and, in the last row, over all.
    """
    xy, yy, _ = train[-1].target(sums, cross)
    top = np.abs(xy).max(initial=0.0)
    if top <= 1e-12:
        return np.zeros(raw.p)
    grid = np.geomspace(top, top * eps, alphas)
    errors = np.zeros(alphas)
    for fold, left in enumerate(train[:-1]):
        if raw.n[fold] == 0 or left.n == 0:
            continue
        c, cc, mean = left.target(sums, cross)
        path = _solve_path(left, c, cc, grid)
        a = mean - path @ left.means
        errors += _held_out_error(path, a, raw, fold, sums[fold], cross[fold]) / raw.n[fold]
    return _solve_path(train[-1], xy, yy, grid)[int(np.argmin(errors))]


def _solver(v: int, maxlag: int, folds: int, threshold: float):
    """The regressions of one group: its targets' moments and those among the predictors."""
    schema = pa.schema([("s", pa.int32()), ("t", pa.int32()), ("lag", pa.int32()), ("coefficient", pa.float64())])

    def solve(own: pa.Table, shared: pa.Table) -> pa.Table:
        part = {c: shared.column(f"_{c}").to_numpy() for c in ("i", "j", "fold", "cnt")}
        p = v * maxlag
        raw = Moments(part["i"], part["j"], part["fold"], part["cnt"].astype(float), p, folds)
        train = [Centred(raw, f) for f in range(folds)] + [Centred(raw, None)]
        target, j, fold, cnt = (own.column(c).to_numpy() for c in ("t", "j", "fold", "cnt"))
        rows = []
        for t in np.unique(target):
            mine = target == t
            sums, cross = np.zeros(folds + 1), np.zeros((folds + 1, p))
            for f, k, n in zip(fold[mine], j[mine], cnt[mine], strict=True):
                if k < 0:
                    sums[f] += n
                else:
                    cross[f, k] += n
            sums[folds], cross[folds] = sums.sum(), cross.sum(axis=0)
            b = cross_validated_lasso(raw, train, sums, cross)
            rows += [(k % v, t, k // v + 1, b[k]) for k in np.nonzero(np.abs(b) > threshold)[0] if k % v != t]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return solve


def granger_lasso(
    slots: DataFrame, variables: DataFrame, maxlag: int = 3, threshold: float = 1e-6, folds: int = FOLDS
) -> DataFrame:
    """(source, target, lag, coefficient) with a coefficient above ``threshold``, self-pairs left out.

    ``variables`` (v, name) numbers the templates. One regression per target.
    """
    names = small_side(variables.select("v", "name"))
    v = variables.count()
    counted = moments(lag_tuples(slots, maxlag, folds), maxlag)
    for end, name in (("a", "va"), ("b", "vb")):
        counted = counted.join(names.withColumnsRenamed({"v": f"_{end}", "name": name}), name, "left")
    place = lambda end: F.when(F.col(f"l{end}") < 0, -1).otherwise((F.col(f"l{end}") - 1) * v + F.col(f"_{end}")).cast("int")
    known = "(la < 0 OR _a IS NOT NULL) AND (lb < 0 OR _b IS NOT NULL)"
    placed = materialize(counted.where(known).select("la", "lb", "_a", "_b", place("a").alias("i"), place("b").alias("j"), "fold", "cnt"), "lag_moments")
    groups = (v + GROUP_TARGETS - 1) // GROUP_TARGETS
    # columns of their own, as both sides come from one table
    fresh = [F.col(c).alias(f"_{c}") for c in ("i", "j", "fold", "cnt")]
    among = placed.where("la <> 0 AND lb <> 0").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *fresh)
    # la is the lesser lag: a target stands first with a predictor, second with the intercept
    target = F.when(F.col("la") == 0, F.col("_a")).otherwise(F.col("_b")).alias("t")
    own = placed.where("(la = 0 AND lb > 0) OR (la < 0 AND lb = 0)")
    own = own.select(target, F.when(F.col("la") < 0, -1).otherwise(F.col("j")).alias("j"), "fold", "cnt")
    own = own.withColumn("g", F.floor(F.col("t") / GROUP_TARGETS).cast("int"))
    solved = own.groupBy("g").cogroup(among.groupBy("g")).applyInArrow(
        _solver(v, maxlag, folds, threshold), "s int, t int, lag int, coefficient double"
    )
    for end, name in (("s", "source"), ("t", "target")):
        solved = solved.join(names.withColumnsRenamed({"v": end, "name": name}), end)
    return solved.select("source", "target", "lag", "coefficient")


def first_block(edges: DataFrame) -> DataFrame:
    """The lag-1 square block, the part a plain (source, target, coefficient) export shows."""
    return edges.filter(F.col("lag") == 1).select("source", "target", "coefficient")
