"""Deterministic hold-out split and cross-validation folds (E-1 .. E-3).

Row identity comes from explicit key columns (there is no row index).  Every
assignment is a function of ``md5(seed | key)``, so it is stable under
re-partitioning and re-evaluation and can be restated in SQL.

Stratified folds need a per-class rank.  A window partitioned only by class
would place a whole class (possibly a third of the table) into one task, so
the rank is computed in two levels: rows are bucketed by a hash prefix
(ordering by prefix first is consistent with ordering by the full hash), a
small ``(class, bucket) -> count`` table gives each bucket's offset, and the
row number inside ``(class, bucket)`` is added to it.  The result is exactly
``row_number() over (partition by class order by hash, key)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Split share and seed used by every runner.
TEST_SIZE = 0.2
SEED = 42
MAX_BUCKET_HEX_DIGITS = 5  # at most 2**20 hash-prefix buckets per class for the two-level rank
ROWS_PER_BUCKET = 1000


def bucket_digits(n_rows: int) -> int:
    """Hex digits of the hash prefix: about ``ROWS_PER_BUCKET`` rows per bucket, 1..5 digits."""
    import math

    need = max(n_rows / ROWS_PER_BUCKET, 1.0)
    return int(min(MAX_BUCKET_HEX_DIGITS, max(1, math.ceil(math.log(need, 16)))))


def key_string(key: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("␀")) for k in key])


def row_hash(key: list[str], seed: int = SEED, salt: str = "") -> Column:
    """md5 hex of ``seed|salt|key`` (32 hex chars)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key_string(key)))


def hash_unit(key: list[str], seed: int = SEED, salt: str = "") -> Column:
    """First 32 bits of the hash as an integer in [0, 2**32)."""
    return F.conv(F.substring(row_hash(key, seed, salt), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, key: list[str], test_size: float = TEST_SIZE, seed: int = SEED):
    """E-1: (train, test); a row is in test when its hash bucket (of 1000) < 1000·test_size.

    Not stratified.  The share is approximate; the assignment is exact and stable.
    """
    b = hash_unit(key, seed, "split") % 1000
    cut = int(round(1000 * test_size))
    tagged = df.withColumn("__test", b < cut)
    return tagged.where(~F.col("__test")).drop("__test"), tagged.where(F.col("__test")).drop("__test")


def assign_kfold(df: DataFrame, key: list[str], k: int = 5, seed: int = SEED, col: str = "fold") -> DataFrame:
    """E-2: shuffled k-fold for regression: fold = hash mod k."""
    return df.withColumn(col, (hash_unit(key, seed, "fold") % k).cast("int"))


def assign_stratified(df: DataFrame, key: list[str], label: str, k: int = 5, seed: int = SEED,
                      col: str = "fold", n_rows: int | None = None) -> DataFrame:
    """E-3: stratified k-fold; per class, fold sizes differ by at most one.

    fold = (rank of the row inside its class by (hash, key) - 1) mod k,
    computed with the two-level rank described in the module docstring.
    """
    h = row_hash(key, seed, "fold")
    ks = key_string(key)
    digits = bucket_digits(n_rows if n_rows is not None else df.count())
    base = df.withColumn("__h", h).withColumn("__ks", ks).withColumn("__b", F.substring("__h", 1, digits))
    lab = F.col(f"`{label}`")
    counts = base.groupBy(lab.alias("__lab"), F.col("__b")).agg(F.count(F.lit(1)).alias("__cnt"))
    # bounded per class by the bucket count (at most 2**20), not by the row count
    w_off = Window.partitionBy("__lab").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(w_off), F.lit(0))).drop("__cnt")
    w_in = Window.partitionBy(lab, F.col("__b")).orderBy("__h", "__ks")
    ranked = base.withColumn("__rn", F.row_number().over(w_in))
    joined = ranked.join(
        offsets,
        (lab.eqNullSafe(offsets["__lab"])) & (ranked["__b"] == offsets["__b"]),
    ).drop(offsets["__b"])
    return joined.withColumn(col, ((F.col("__off") + F.col("__rn") - 1) % k).cast("int")).drop(
        "__h", "__ks", "__b", "__lab", "__off", "__rn"
    )


def assign_folds(df: DataFrame, key: list[str], label: str, task: str, k: int = 5, seed: int = SEED,
                 col: str = "fold") -> DataFrame:
    """Stratified for classification targets, plain shuffled k-fold for regression."""
    if task == "regression":
        return assign_kfold(df, key, k, seed, col)
    return assign_stratified(df, key, label, k, seed, col)


#: Column that tells the inner folds of training rows to stages whose training transform differs (F-13).
CROSS_COLUMN, CROSS_FOLDS = "__cross", 5


def cross_folds(df: DataFrame, key: list[str], k: int = CROSS_FOLDS, seed: int = SEED) -> DataFrame:
    """Tag training rows with inner folds: hash mod k, independent of the outer folds."""
    return df.withColumn(CROSS_COLUMN, (hash_unit(key, seed, "cross") % k).cast("int"))
