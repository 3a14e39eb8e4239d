"""Mergeable column sketches: distinct counts, quantiles and frequent values (A-2, A-5, A-6).

:func:`column_sketches` reads a table once and leaves one row per column with
two binary sketches, an HLL of its values and a KLL of its numbers.  Rows of
several files, days or tables are merged by :func:`merge_sketches` without
reading the data again; :func:`sketch_estimates` reads the numbers off.

The same KLL sketches steer :func:`raw_quantiles`, which is exact: the sketch
proposes an interval, the next scan counts what lies below, on and inside its
ends, and only counts decide.

Partial sketches are merged in two steps (task -> one of ``MERGE_GROUPS``
groups -> one row), so that no task receives one sketch per input split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.dtypes import is_nested, logical_dtype
from quarry.functions.nulls import FLOATING, is_missing, nan_to_null

HLL_LG = 14  # 2^14 registers: relative standard error 0.65 %
KLL_K = 2048  # normalised rank error below KLL_ERROR in 99 of 100 sketches
KLL_ERROR = 3.0 / KLL_K**0.97
TOP_TRACKED = 1000  # values an approximate top list keeps per column
MERGE_GROUPS = 64

SKETCH_SCHEMA = "column string, dtype string, n_rows bigint, n_missing bigint, hll binary, kll binary"


def _number(c: str, dt: T.DataType) -> Column:
    """The column as a double: NaN is NULL, -0.0 is 0.0."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def _identity(c: str, dt: T.DataType) -> Column:
    """64 bits that are equal for equal values; NULL stays out of the sketch."""
    v = F.col(f"`{c}`")
    v = nan_to_null(v) + F.lit(0.0) if isinstance(dt, FLOATING) else v
    return F.when(v.isNotNull(), F.xxhash64(v))


def _grouped(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """First merge step: one partial row per group of tasks."""
    return df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("__g")).agg(*aggs)


def column_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, an HLL of the values, a KLL of the numbers (``SKETCH_SCHEMA``).

    A single scan; the shuffle carries ``MERGE_GROUPS`` rows a task at most.
    Columns that are nested have no HLL, columns that are not numeric no KLL.
    A table without rows gives empty sketches and zero counts.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        return df.sparkSession.createDataFrame([], SKETCH_SCHEMA)
    first, last, rows = [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], []
    for i, f in enumerate(fields):
        kind = logical_dtype(f.dataType)
        hll = kll = F.lit(None).cast("binary")
        first.append(F.sum(is_missing(F.col(f"`{f.name}`"), f.dataType).cast("long")).alias(f"m{i}"))
        last.append(F.sum(f"m{i}").alias(f"m{i}"))
        if not is_nested(f.dataType):
            first.append(F.hll_sketch_agg(_identity(f.name, f.dataType), HLL_LG).alias(f"h{i}"))
            last.append(F.hll_union_agg(f"h{i}").alias(f"h{i}"))
            hll = F.col(f"h{i}")
        if kind == "numeric":
            first.append(F.kll_sketch_agg_double(_number(f.name, f.dataType), KLL_K).alias(f"k{i}"))
            last.append(F.kll_merge_agg_double(f"k{i}", KLL_K).alias(f"k{i}"))
            kll = F.col(f"k{i}")
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("dtype"), F.coalesce("n", F.lit(0)).alias("n_rows"),
                             F.coalesce(f"m{i}", F.lit(0)).alias("n_missing"), hll.alias("hll"), kll.alias("kll")))
    wide = _grouped(df, first).agg(*last)
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of the union of the tables behind ``sketches`` (several rows per column in, one out)."""
    return sketches.groupBy("column", "dtype").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"))


def sketch_estimates(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """column, dtype, n_rows, n_missing, n_unique (about 0.65 %), quantiles (rank error below ``KLL_ERROR``).

    ``quantiles`` is NULL for columns without numbers.
    """
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    some = F.col("kll").isNotNull() & (F.kll_sketch_get_n_double("kll") > 0)
    return sketches.select("column", "dtype", "n_rows", "n_missing",
                           F.when(F.col("hll").isNotNull(), F.hll_sketch_estimate("hll")).alias("n_unique"),
                           F.when(some, F.kll_sketch_get_quantile_double("kll", ranks)).alias("quantiles"))


def frequent_values(df: DataFrame, columns: list[str], k: int) -> dict[str, list[tuple]]:
    """{column: [(value, estimated count), ...]} by count, at most ``k`` a column; one scan, no value is shuffled.

    Every value more frequent than rows / ``TOP_TRACKED`` is found.
    """
    if not columns:
        return {}
    first = [F.expr(f"approx_top_k_accumulate(`{c}`, {TOP_TRACKED})").alias(f"t{i}") for i, c in enumerate(columns)]
    last = [F.expr(f"approx_top_k_combine(t{i}, {TOP_TRACKED})").alias(f"t{i}") for i in range(len(columns))]
    read = [F.expr(f"approx_top_k_estimate(t{i}, {k + 1})").alias(f"t{i}") for i in range(len(columns))]
    if not df.take(1):
        return {c: [] for c in columns}
    row = _grouped(df, first).agg(*last).select(*read).first()
    return {c: [(r["item"], r["count"]) for r in row[i] if r["item"] is not None][:k] for i, c in enumerate(columns)}


# Exact order statistics, steered by sketches -------------------------------------------------


class _Open:
    """Ranks of one column whose values lie strictly between ``lo`` and ``hi`` (None: no end)."""

    def __init__(self, col, lo, hi, ranks):
        self.col, self.lo, self.hi, self.ranks = col, lo, hi, sorted(ranks)


def order_statistics(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list]:
    """{column: [interpolated quantile per probability]}, exact; None where a column has no number.

    Each round is one scan with one small row out of it.  For every interval
    still open it counts the numbers below it, on its two ends and inside, and
    sketches the inside.  A rank that falls on an end is settled; the others go
    on in the interval that the sketch proposes around them.  Where a proposal
    misses (a sketch errs with small probability), the counts show it and the
    search goes on beside it.  An inside of at most KLL_K / 2 numbers is held
    whole by its sketch, whose quantiles are then the order statistics.  Every
    round cuts an interval to about 2 * KLL_ERROR of its rows: 10^12 rows take
    six.  NaN and NULL are left out, infinities are ordinary values.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(wanted)
    if not cols:
        return {}
    data = df.select(*[_number(c, types[c]).alias(f"x{i}") for i, c in enumerate(cols)])
    at = {c: i for i, c in enumerate(cols)}
    start = _scan(data, [_Open(c, None, None, []) for c in cols], at, lambda o, n: _quantile_ranks(wanted[o.col], n))
    sizes, found = {}, {c: {} for c in cols}
    jobs = []
    for o, got in start:
        sizes[o.col] = got["mid"] or 0
        jobs += _settle(o, got, found)
    while jobs:
        following = []
        for o, got in _scan(data, jobs, at, None):
            following += _settle(o, got, found)
        jobs = following
    out = {}
    for c in cols:
        if not sizes[c]:
            out[c] = None
            continue
        vals = []
        for p in wanted[c]:
            pos = p * (sizes[c] - 1)
            f = int(pos // 1)
            a = found[c][f]
            b = found[c][f + 1] if pos > f and f + 1 < sizes[c] else a
            vals.append(a if a == b else a + (pos - f) * (b - a))
        out[c] = vals
    return out


def _quantile_ranks(probs, n):
    ranks = set()
    for p in probs:
        pos = p * (n - 1)
        f = int(pos // 1)
        ranks.add(f)
        if pos > f and f + 1 < n:
            ranks.add(f + 1)
    return sorted(ranks)


def _scan(data: DataFrame, jobs: list[_Open], at: dict, first_ranks):
    """[(interval, counts with the sketch's proposals per rank)] of one pass over the data."""
    first, last = [], []
    for i, o in enumerate(jobs):
        x = F.col(f"x{at[o.col]}")
        inside = x.isNotNull()
        counts = {}
        if o.lo is not None:
            counts["below"], counts["on_lo"] = x < o.lo, x == o.lo
            inside = inside & (x > o.lo)
        if o.hi is not None:
            if o.hi != o.lo:  # one value at both ends is counted once
                counts["on_hi"] = x == o.hi
            inside = inside & (x < o.hi)
        counts["mid"] = inside
        for name, cond in counts.items():
            first.append(F.count(F.when(cond, 1)).alias(f"{name}{i}"))
            last.append(F.sum(f"{name}{i}").alias(f"{name}{i}"))
        first.append(F.kll_sketch_agg_double(F.when(inside, x), KLL_K).alias(f"s{i}"))
        last.append(F.kll_merge_agg_double(f"s{i}", KLL_K).alias(f"s{i}"))
    row = _grouped(data, first).agg(*last).first()
    spark = data.sparkSession
    asked, out = [], []
    for i, o in enumerate(jobs):
        got = {name: (row[f"{name}{i}"] if f"{name}{i}" in row else 0) or 0 for name in ("below", "on_lo", "mid", "on_hi")}
        if first_ranks is not None:
            o.ranks = first_ranks(o, got["mid"]) if got["mid"] else []
        before, n = got["below"] + got["on_lo"], got["mid"]
        inner = [r for r in o.ranks if before <= r < before + n]
        if inner:
            err = 0.0 if n <= KLL_K // 2 else KLL_ERROR
            mids = [(r - before + 0.5) / n for r in inner]
            asked.append((i, bytes(row[f"s{i}"]), [max(0.0, m - err) for m in mids] + [min(1.0, m + err) for m in mids]))
        got["inner"] = inner
        out.append((o, got))
    if asked:  # schema-sized: one sketch for each interval still open
        frame = spark.createDataFrame([tuple(s for _, s, _ in asked)], ", ".join(f"s{i} binary" for i, _, _ in asked))
        reads = [F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(r) for r in ranks])) for i, _, ranks in asked]
        for (i, _, _), q in zip(asked, frame.select(*reads).first()):
            k = len(q) // 2
            out[i][1]["proposal"] = list(zip(q[:k], q[k:]))
    return out


def _settle(o: _Open, got: dict, found: dict) -> list[_Open]:
    """Store the ranks that the counts settle; the intervals in which the others go on."""
    below, before, n = got["below"], got["below"] + got["on_lo"], got["mid"]
    low = [r for r in o.ranks if r < below]
    high = [r for r in o.ranks if r >= before + n + got["on_hi"]]
    for r in o.ranks:
        if below <= r < before:
            found[o.col][r] = o.lo
        elif before + n <= r < before + n + got["on_hi"]:
            found[o.col][r] = o.hi
    following = []
    if low:
        following.append(_Open(o.col, None, o.lo, low))
    if high:
        following.append(_Open(o.col, o.hi, None, high))
    shared = {}
    for r, (a, b) in zip(got["inner"], got.get("proposal", [])):
        if n <= KLL_K // 2:
            found[o.col][r] = a
        else:
            shared.setdefault(round((r - before) / n / KLL_ERROR), []).append((r, a, b))
    for part in shared.values():  # neighbouring ranks descend together
        following.append(_Open(o.col, min(a for _, a, _ in part), max(b for _, _, b in part), [r for r, _, _ in part]))
    return following
