"""Chained-equation imputation (F-5) from the cross products of each missingness pattern.

Every value that chained regressions fill in is an affine function of the
observed values of its row, and rows that miss the same columns share that
function.  So the data is read once, for the cross products of the observed
values by pattern.  All sweeps then run on these matrices: a regression of
column c sums, over the patterns that observe c, ``B G B^T`` (G: cross products
of the observed values, B: what the pattern's rows were completed to so far),
and its coefficients become row c of B in the patterns that miss c.  The number
of Spark jobs depends neither on the columns nor on the sweeps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6  # on standardised columns, over the deviation of the label
HELD_PATTERNS = 512  # patterns a task adds up before it hands them on


def cross_products(df: DataFrame, cols: list[str], means: list[float], scales: list[float]) -> DataFrame:
    """(pattern, cell, v): sums of products of [1, standardised columns], missing values as 0, by pattern.

    ``pattern`` has one character per column, 1 where it is missing; ``cell`` is
    i * (d + 1) + j with i <= j.  Tasks add up their rows first; a task holds at
    most ``HELD_PATTERNS`` matrices.
    """
    d, held = len(cols), HELD_PATTERNS
    values = F.array(*[((F.col(f"`{c}`") - F.lit(m)) / F.lit(s)).cast("double") for c, m, s in zip(cols, means, scales)])

    def partial(batches):
        import numpy as np
        import pandas as pd

        upper = np.triu_indices(d + 1)
        cells = upper[0] * (d + 1) + upper[1]
        sums = {}

        def drain():
            for p, g in sums.items():
                yield pd.DataFrame({"pattern": p, "cell": cells, "v": g[upper]})
            sums.clear()

        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in row] for row in batch["x"]], dtype=float).reshape(len(batch), d)
            gone = np.isnan(x)
            x = np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, x)])
            kinds, which = np.unique(gone, axis=0, return_inverse=True)
            which = which.reshape(-1)
            for k, kind in enumerate(kinds):
                rows = x[which == k]
                p = "".join("1" if g else "0" for g in kind)
                g = rows.T @ rows
                sums[p] = sums[p] + g if p in sums else g
                if len(sums) >= held:
                    yield from drain()
        yield from drain()

    parts = df.select(values.alias("x")).mapInPandas(partial, "pattern string, cell int, v double")
    return parts.groupBy("pattern", "cell").agg(F.sum("v").alias("v"))


def solve(patterns: list[str], products: np.ndarray, order: list[int], means, scales, sweeps: int, tol: float) -> dict:
    """{column index: (weights of the other columns in index order, intercept)} in the units of the data.

    ``products[p]`` is the symmetric matrix of pattern p.  Stops after ``sweeps``
    or when no imputed mean moved by ``tol``.
    """
    d = products.shape[1] - 1
    means, scales = np.asarray(means, float), np.asarray(scales, float)
    gone = np.array([[ch == "1" for ch in p] for p in patterns])
    done = np.tile(np.eye(d + 1), (len(patterns), 1, 1))  # B: completed row = B @ [1, observed values]
    coefs, prev = {}, None
    for _ in range(sweeps):
        for c in order:
            seen = ~gone[:, c]
            total = np.einsum("pij,pjk,plk->il", done[seen], products[seen], done[seen], optimize=True)
            others = [o for o in range(d) if o != c]
            w, b = _regress(total, others, c, scales[c])
            at = [o + 1 for o in others]
            row = np.einsum("o,poj->pj", w, done[np.ix_(~seen, at)])
            row[:, 0] += b
            done[~seen, c + 1] = row
            raw = w * scales[c] / scales[others]
            coefs[c] = ([float(v) for v in raw], float(means[c] + scales[c] * b - raw @ means[others]))
        now = []
        for c in order:
            miss = gone[:, c]
            filled = np.einsum("pj,pj->", done[miss, c + 1], products[miss][:, :, 0])
            now.append(means[c] + scales[c] * filled / products[miss][:, 0, 0].sum())
        if prev is not None and max(abs(a - b) for a, b in zip(now, prev)) < tol:
            break
        prev = now
    return coefs


def _regress(total: np.ndarray, others: list[int], c: int, unit: float):
    """Weights and intercept of column c on the others, from summed cross products; columns without spread weigh 0."""
    n = total[0, 0]
    at, y = [o + 1 for o in others], c + 1
    mx, my = total[0, at] / n, total[0, y] / n
    cov = total[np.ix_(at, at)] / n - np.outer(mx, mx)
    cxy = total[at, y] / n - mx * my
    sy = np.sqrt(max(total[y, y] / n - my * my, 0.0))
    sx = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    w = np.zeros(len(others))
    use = sx > 1e-12
    if sy > 1e-12 and use.any():
        corr = cov[np.ix_(use, use)] / np.outer(sx[use], sx[use])
        corr[np.diag_indices_from(corr)] += RIDGE / (sy * unit)
        w[use] = np.linalg.lstsq(corr, cxy[use] / (sx[use] * sy), rcond=None)[0] * sy / sx[use]
    return w, my - w @ mx
