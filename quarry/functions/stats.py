"""Statistical aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_exprs(x: Column, probs: list[float], approx: bool = False, accuracy: int = 100_000) -> Column:
    """Quantiles of ``x`` as ``array<double>``.

    Exact (default) uses ``percentile`` = linear interpolation between order
    statistics, the same definition as pandas ``quantile`` and DuckDB
    ``quantile_cont``.  ``approx=True`` switches to ``percentile_approx`` (a
    bounded sketch, no interpolation) for columns with very many distinct
    values, where the exact aggregate's value->count map would not fit a task.
    """
    if approx:
        return F.percentile_approx(x, probs, accuracy).cast("array<double>")
    return F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))


def median_expr(x: Column, approx: bool = False) -> Column:
    return quantile_exprs(x, [0.5], approx=approx)[0]


def pearson_expr(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r, NULL (not an error) when either side is constant.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI mode for constant inputs, so
    the ratio is written out with a guarded denominator.
    """
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    den = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.covar_pop(xx, yy) / F.when(den != 0, den)


# Exact quantiles from a value-count table ----------------------------------------------

HIST_BUCKETS = 1024
RESOLVE_ROWS = 100_000  # a target is settled once its bucket holds at most this many distinct values


def exact_quantiles(counts: DataFrame, specs: list[tuple], probs: list[float]) -> dict:
    """Exact linearly interpolated quantiles from ``counts`` = (ordinal, v double, n bigint).

    ``specs``: (ordinal, N, min, max) per numeric column (non-null count and
    range from the scalar pass).  For p = q (N - 1) the values at ranks
    floor(p) and floor(p) + 1 are located by histogram descent: each step is
    one aggregation over the count table into ``HIST_BUCKETS`` equal-width
    buckets of the current range per target; the bucket holding the target
    rank becomes the next range.  When a bucket holds at most
    ``RESOLVE_ROWS`` distinct values they are fetched (bounded) and ranked on
    the driver.  Works for any distribution: each descent divides the range by
    the bucket count, and a single repeated value ends it at once.
    Returns {(ordinal, q): value}.
    """
    spark = counts.sparkSession
    targets = {}  # tid -> dict(ordinal, rank, lo, hi, offset)
    tid = 0
    plan = []
    for ordinal, total, lo, hi in specs:
        for q in probs:
            pos = q * (total - 1)
            f = int(pos // 1)
            ranks = [f] + ([f + 1] if pos > f and f + 1 < total else [])
            ids = []
            for r in ranks:
                targets[tid] = dict(ordinal=ordinal, rank=r, lo=lo, hi=hi, offset=0)
                ids.append(tid)
                tid += 1
            plan.append((ordinal, q, pos - f, ids))
    values = {}
    pending = set(targets)
    endless = {o for o, _, lo, hi in specs if abs(lo) == float("inf") or abs(hi) == float("inf")}
    if endless:  # infinities stay outside the histogram, in buckets of their own
        finite = counts.where(F.abs("v") < float("inf")).groupBy("ordinal").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        ranges = {r["ordinal"]: (r["lo"], r["hi"]) for r in finite}
        for st in targets.values():
            if st["ordinal"] in endless:
                st["lo"], st["hi"] = ranges.get(st["ordinal"], (0.0, 0.0))
                st["wide"] = True
    # each round separates the ends of every open range, so it ends for any distribution
    while pending:
        # targets of one range share its histogram
        ranges = {}
        for t in sorted(pending):
            st = targets[t]
            ranges.setdefault((st["ordinal"], float(st["lo"]), float(st["hi"]), st.pop("wide", False)), []).append(t)
        spec = spark.createDataFrame([(of[0], *r) for r, of in ranges.items()], "tid int, ordinal int, lo double, hi double, wide boolean")
        # targets are schema-sized (4 per numeric column): a bounded broadcast
        j = counts.join(F.broadcast(spec), "ordinal").where(((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))) | (F.col("wide") & (F.abs("v") == float("inf"))))
        # halves, so that the range of any two doubles is finite
        width = F.col("hi") / 2 - F.col("lo") / 2
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * HIST_BUCKETS), F.lit(HIST_BUCKETS - 1))
        b = (
            F.when(F.col("v") == float("inf"), HIST_BUCKETS)
            .when(F.col("v") == float("-inf"), -1)
            .when(width > 0, part)
            .otherwise(F.when(F.col("v") > F.col("lo"), 1).otherwise(0))
        )
        hist = j.groupBy("tid", b.cast("int").alias("b")).agg(
            F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("bmin"), F.max("v").alias("bmax")
        ).collect()
        by_t, own = {}, {}
        for r in hist:
            own.setdefault(r["tid"], []).append(r)
        for of in ranges.values():
            by_t.update({t: own.get(of[0], []) for t in of})
        fetch = []
        for t in list(pending):
            st = targets[t]
            acc = st["offset"]
            for r in sorted(by_t.get(t, []), key=lambda r: r["b"]):
                if acc + r["cnt"] > st["rank"]:
                    if r["rows"] <= RESOLVE_ROWS or r["bmin"] == r["bmax"]:
                        if r["bmin"] == r["bmax"]:
                            values[t] = r["bmin"]
                            pending.discard(t)
                        else:
                            fetch.append((t, r["bmin"], r["bmax"], acc))
                    else:
                        st["lo"], st["hi"], st["offset"] = r["bmin"], r["bmax"], acc
                    break
                acc += r["cnt"]
        if fetch:
            spans = {}
            for t, a, z, _ in fetch:
                spans.setdefault((targets[t]["ordinal"], float(a), float(z)), []).append(t)
            fspec = spark.createDataFrame([(of[0], *s) for s, of in spans.items()], "tid int, ordinal int, lo double, hi double")
            rows = counts.join(F.broadcast(fspec), "ordinal").where(
                (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select("tid", "v", "n").collect()
            got = {}
            for r in rows:
                got.setdefault(r["tid"], []).append((r["v"], r["n"]))
            first = {t: of[0] for of in spans.values() for t in of}
            for t, _, _, acc in fetch:
                for v, n in sorted(got.get(first[t], [])):
                    if acc + n > targets[t]["rank"]:
                        values[t] = v
                        break
                    acc += n
                pending.discard(t)
    out = {}
    for ordinal, q, frac, ids in plan:
        if len(ids) == 1:
            out[(ordinal, q)] = values[ids[0]]
        else:
            a, b = values[ids[0]], values[ids[1]]
            out[(ordinal, q)] = a if a == b else a + frac * (b - a)
    return out


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """Exact interpolated quantiles of several numeric columns, from scans of the raw columns.

    Nothing is unpivoted and no value is shuffled: every round is one
    aggregation into one row (:func:`quarry.functions.sketches.order_statistics`).
    Returns {column: [value per prob]} (None for empty columns).
    """
    from quarry.functions.sketches import order_statistics

    return order_statistics(df, {c: probs for c in cols})
