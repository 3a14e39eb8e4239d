"""k-NN imputation (F-4) and SMOTE (F-17) over the exact neighbours of ``nearest.py``."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.nearest import nearest
from quarry.operators.persist import Saved

# Fixed values.
KNN_NEIGHBOURS = 5
SMOTE_NEIGHBOURS = 5
SEED = 42


def vector_id(x: Column) -> Column:
    """128-bit text id of an array of doubles; equal vectors share it."""
    return F.md5(F.array_join(F.transform(x, lambda v: v.cast("string")), ",", "null"))


class _KnnModel(Model, Saved):
    SAVED = ("donors", "cols", "means", "k")

    def __init__(self, donors, cols, means, k):
        super().__init__()
        self.donors, self.cols, self.means, self.k = donors, cols, means, k

    def _transform(self, df):
        cols = [c for c in self.cols if c in df.columns]
        idx = [self.cols.index(c) for c in cols]
        # identical numeric vectors get identical fills: one receiver per distinct vector
        # (a hot duplicated row costs one receiver, and the join back is skew-split by AQE)
        rv = F.array(*[F.col(f"`{c}`").cast("double") if c in cols else F.lit(None).cast("double") for c in self.cols])
        tgt = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(i)) for i, c in zip(idx, cols)]), lambda x: x.isNotNull())
        base = df.withColumn("rv", rv).withColumn("tgt", tgt).withColumn("rid", F.unhex(vector_id(F.col("rv"))))
        receivers = base.where(F.size("tgt") > 0).select("rid", "rv", "tgt").dropDuplicates(["rid"])
        nn = nearest(receivers, self.donors, len(self.cols), self.k)
        fills = nn.groupBy("rid", "j").agg(F.avg(F.col("dv")[F.col("j")]).alias("v"))
        wide = fills.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("__fill"))
        out = base.join(wide, "rid", "left")
        proj = []
        for c in df.columns:
            if c in cols:
                i = self.cols.index(c)
                proj.append(F.coalesce(F.col(f"`{c}`"), F.element_at("__fill", F.lit(i)), F.lit(self.means[c])).alias(c))
            else:
                proj.append(F.col(f"`{c}`"))
        return out.select(*proj)


class KnnImpute(Estimator):
    """F-4: k-NN imputation (5 neighbours, uniform mean, nan-Euclidean distance).

    Donors for a missing coordinate j are training rows with j observed; when
    no donor shares a coordinate with the receiver, the training mean is used.
    """

    def __init__(self, cols, k: int = KNN_NEIGHBOURS):
        super().__init__()
        self.cols, self.k = list(cols), k

    def _fit(self, df):
        cols = [c for c in self.cols if c in df.columns]
        stats = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m::{c}") for c in cols]).first()
        dv = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
        # identical donor vectors share an id; ties among them are interchangeable (same values)
        donors = df.select(F.unhex(vector_id(dv)).alias("did"), dv.alias("dv"))
        means = {c: stats[f"m::{c}"] for c in cols}
        return _KnnModel(donors, cols, means, self.k)


def smote(df: DataFrame, label: str = "label", features: str = "features", k: int = SMOTE_NEIGHBOURS,
          seed: int = SEED) -> DataFrame:
    """F-17: raise every minority class to the majority count with synthetic rows.

    For class c with n_c rows and need = n_max - n_c: member m (rank b in a
    hash order) seeds floor(need / n_c) (+1 if b < need mod n_c) synthetic
    rows; each picks one of m's k nearest same-class neighbours (exact
    search) and a gap u in [0, 1) from hashes of (m, t, seed):
    x_new = x + u * (nn - x).  Original rows are kept unchanged.
    """
    arr = df.select("*", vector_to_array(features).alias("__x"))
    counts = {r[label]: r["count"] for r in arr.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df
    n_max = max(counts.values())
    syn_parts = []
    for cls, n_c in counts.items():
        need = n_max - n_c
        if need <= 0:
            continue
        members = arr.where(F.col(label) == cls).select(
            vector_id(F.col("__x")).alias("rid"), F.col("__x").alias("rv")
        ).groupBy("rid").agg(F.first("rv").alias("rv"), F.count(F.lit(1)).alias("__m"))
        dim = len(members.first()["rv"])
        donors = members.select(F.col("rid").alias("did"), F.col("rv").alias("dv"))
        recv = members.withColumn("tgt", F.array(F.lit(-1)))
        if members.count() > 1:
            nn = nearest(recv.drop("__m"), donors, dim, k)
        else:
            nn = donors.limit(0).select(F.col("did").alias("rid"), F.lit(1).alias("rank"), "dv")
        nn_arr = nn.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "dv"))).alias("nns"))
        per, extra = divmod(need, n_c)
        # every row seeds, repeated vectors once for each of their rows
        ranked = members.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
        ranked = ranked.withColumn("__h", F.struct(F.xxhash64("rid", "__copy", F.lit(seed)), "rid", "__copy"))
        from quarry.functions.ranking import dense_codes

        order = dense_codes(ranked.select("__h"), "__h", "__b")
        ranked = ranked.join(order, "__h")
        reps = ranked.withColumn("__n", F.lit(per) + F.when(F.col("__b") < extra, 1).otherwise(0)).where(F.col("__n") > 0)
        alone = F.array(F.struct(F.lit(1).alias("rank"), F.col("rv").alias("dv")))
        gen = reps.join(nn_arr, "rid", "left").withColumn("nns", F.coalesce(F.col("nns").cast("array<struct<rank:int,dv:array<double>>>"), alone)).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        pick = (F.abs(F.xxhash64("rid", "__copy", "t", F.lit("nn"), F.lit(seed))) % F.size("nns")).cast("int")
        u = (F.abs(F.xxhash64("rid", "__copy", "t", F.lit("u"), F.lit(seed))) % F.lit(1 << 30)) / float(1 << 30)
        gen = gen.withColumn("__nn", F.col("nns")[pick]["dv"]).withColumn("__u", u)
        new = gen.select(F.zip_with("rv", "__nn", lambda a, b: a + F.col("__u") * (b - a)).alias("__x"))
        syn_parts.append(new.withColumn(label, F.lit(cls)))
    if not syn_parts:
        return df
    syn = syn_parts[0]
    for p in syn_parts[1:]:
        syn = syn.unionByName(p)
    syn = syn.select(array_to_vector("__x").alias(features), F.col(label).cast(df.schema[label].dataType).alias(label))
    keep = [c for c in df.columns if c not in (features, label)]
    for c in keep:
        syn = syn.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return df.unionByName(syn.select(*df.columns))
