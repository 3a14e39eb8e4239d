"""Exact k nearest donors under the nan-Euclidean distance, over leaves of k-d trees.

A donor pattern is the set of its present coordinates.  A request and the donors of
one pattern share the same coordinates, and for each set of shared coordinates that
occurs the donors of a pattern with many rows are dealt to the leaves of a tree that
splits only on these.  Cuts come from a bounded sample of donors; they decide where
a donor lies, not whether it is compared.  Of donors that lie on one point of the
shared coordinates, only those that win its ties are kept.

A request first meets the donors of its own leaf, which bounds its k-th distance.
It then meets the leaves whose box, the range of their donors in the arithmetic of
the distance, is no further away than that.  Pairs are compared inside tasks, a
leaf at a time, and leave them as at most k donors a request.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import parquet_checkpoint as checkpoint

#: Distinct donors per leaf, on average; patterns of fewer are one leaf.
LEAF_ROWS = 1024
#: At most about so many donors are read for the cuts, and at least LEAF_SAMPLE of them lie in a leaf that is split.
SAMPLE_ROWS, LEAF_SAMPLE = 1 << 18, 8
#: Requests of one leaf that one task compares.
DEAL_ROWS = 1 << 16
#: Distances that a task holds at once.
BLOCK = 1 << 21


def _present(x: str) -> Column:
    return F.array_join(F.transform(x, lambda v: F.when(v.isNull(), "0").otherwise("1")), "")


def _finite(x: str) -> Column:
    return F.transform(x, lambda v: F.when(F.abs(v) < F.lit(float("inf")), v))


def _has(pattern: str, i: Column) -> Column:
    return F.substring(pattern, i + 1, F.lit(1)) == "1"


def _tree(x: np.ndarray, dims: list[int], weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension or -1 at a leaf, cut, the two children) of each node; a sample row stands for ``weight`` donors."""
    dim, cut, kids = [], [], []
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        at, parent, side = todo.pop()
        node = len(dim)
        dim.append(-1)
        cut.append(0.0)
        kids.append([0, 0])
        if parent >= 0:
            kids[parent][side] = node
        if len(at) * weight <= LEAF_ROWS or len(at) < LEAF_SAMPLE:
            continue
        part = x[at]
        with np.errstate(all="ignore"):
            spread = part[:, dims].std(axis=0)
        for d in (dims[i] for i in np.argsort(-spread, kind="stable")):
            v = part[:, d]
            c = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if c == v.max():  # the lower half lies below the repeated greatest value
                below = v[v < c]
                if not len(below):
                    continue
                c = below.max()
            dim[node], cut[node] = d, float(c)
            todo += [(at[v <= c], node, 0), (at[v > c], node, 1)]
            break
    return np.array(dim), np.array(cut), np.array(kids)


def _placer(trees, vector: str, n_dims: int):
    """A function for ``mapInArrow`` that adds each row's leaf (0 without a tree); made here to travel by value."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)
            groups = batch.column("grp").dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            leaf = np.zeros(batch.num_rows, np.int32)
            for code, name in enumerate(groups.dictionary.to_pylist()):
                if name not in trees.value:
                    continue
                dim, cut, kids = trees.value[name]
                rows = np.flatnonzero(codes == code)
                node = np.zeros(len(rows), np.int64)
                going = np.arange(len(rows))
                while len(going := going[dim[node[going]] >= 0]):
                    here = node[going]
                    node[going] = kids[here, (x[rows[going], dim[here]] > cut[here]).astype(int)]
                leaf[rows] = node
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


def _comparer(n_dims: int, k: int, index, names: list[str], block: int):
    """A function for cogrouped requests and donors of a leaf; with ``index`` it also lists the leaves still to meet."""

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)

    def spread(total, shared):
        return np.sqrt(total * float(n_dims) / shared)

    def low(a_low, a_high, box, dims, shared):
        """Least distance of each request (or of their common box) to each leaf's box."""
        total = 0.0
        for d in dims:
            total = total + np.maximum(0.0, np.maximum(box["lo"][None, :, d] - a_high[:, d, None], a_low[:, d, None] - box["hi"][None, :, d])) ** 2
        return spread(total, shared)

    def lists(of, values, n):
        import pyarrow as pa

        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)

    def further(a, home, box, dims, shared, bound):
        """(request, leaf) of the leaves other than its own within reach; ``bound`` is lowered where boxes know better."""
        for i in np.flatnonzero(~np.isfinite(bound)):
            total = 0.0
            for d in dims:
                total = total + np.maximum(np.abs(a[i, d] - box["lo"][:, d]), np.abs(box["hi"][:, d] - a[i, d])) ** 2
            high = spread(total, shared[i])
            order = np.argsort(high, kind="stable")
            covered = np.searchsorted(np.cumsum(box["rows"][order]), k + 1)
            if covered < len(order):
                bound[i] = high[order[covered]]
        common = low(a.min(axis=0, keepdims=True), a.max(axis=0, keepdims=True), box, dims, shared[:1, None])[0]
        near = np.flatnonzero((common <= bound.max()) & (box["leaf"] != home))
        of, to = [], []
        if len(near):
            some = {"lo": box["lo"][near], "hi": box["hi"][near]}
            step = max(1, block // len(near))
            for at in range(0, len(a), step):
                part = a[at : at + step]
                i, j = np.nonzero(low(part, part, some, dims, shared[at : at + step, None]) <= bound[at : at + step, None])
                of.append(i + at)
                to.append(box["leaf"][near[j]])
        return (np.concatenate(of), np.concatenate(to)) if of else (np.zeros(0, int), np.zeros(0, int))

    def run(key, left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not left.num_rows or not right.num_rows:
            left = left.slice(0, 0)
        right = right.take(pc.sort_indices(right, sort_keys=[("did", "ascending")]))  # ties go to the smaller did
        a, b = matrix(left.column("rv")), matrix(right.column("dv"))
        group = left.column("grp")[0].as_py() if left.num_rows else ""
        box = index.value.get(group) if index is not None else None
        shape = left.column("dims")[0].as_py() if left.num_rows else ""
        dims = [d for d in range(n_dims) if shape[d : d + 1] == "1"]
        shared = (~np.isnan(a[:, dims])).sum(axis=1)
        bound = left.column("bound").to_numpy(zero_copy_only=False).astype(float).copy()
        itself = pc.index_in(left.column("rid").cast(pa.binary()), value_set=right.column("did").combine_chunks().cast(pa.binary()))
        itself = itself.fill_null(-1).to_numpy()
        of, donor, dist = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        step = max(1, block // max(1, len(b)))
        with np.errstate(all="ignore"):
            for at in range(0, len(a), step):
                part = a[at : at + step]
                total = np.zeros((len(part), len(b)))
                for d in dims:
                    gap = part[:, d, None] - b[None, :, d]
                    gap[np.isnan(part[:, d])] = 0.0
                    total += gap * gap
                far = spread(total, shared[at : at + step, None])
                own = itself[at : at + step]
                far[np.flatnonzero(own >= 0), own[own >= 0]] = np.nan
                if len(b) >= k:
                    kth = np.partition(far, k - 1, axis=1)[:, k - 1]
                    bound[at : at + step] = np.fmin(bound[at : at + step], np.where(np.isnan(kth), np.inf, kth))
                i, j = np.nonzero(far <= bound[at : at + step, None])
                order = np.lexsort((j, far[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                of.append(i[first] + at)
                donor.append(j[first])
                dist.append(far[i[first], j[first]])
            of, donor, dist = np.concatenate(of), np.concatenate(donor), np.concatenate(dist)
            to = (np.zeros(0, int), np.zeros(0, int))
            if box is not None and len(a):
                to = further(a, key[1].as_py(), box, dims, shared, bound)
        chosen = right.take(pa.array(donor, pa.int64()))
        met = pa.StructArray.from_arrays([pa.array(dist, pa.float64()), *[chosen.column(c).combine_chunks() for c in ("did", "copies", "dv")]], names=["dist", "did", "copies", "dv"])
        out = {c: left.column(c) for c in ("rid", "tgt", "grp", "dims", "alone")}
        out["met"] = lists(of, met, left.num_rows)
        if index is not None:
            out["leaves"] = lists(to[0], pa.array(to[1], pa.int32()), left.num_rows)
            out["rv"], out["bound"] = left.column("rv"), pa.array(bound, pa.float64())
        return pa.table({c: out[c] for c in names})

    return run


def _compared(requests: DataFrame, donors: DataFrame, n_dims: int, k: int, index, schema: T.StructType) -> DataFrame:
    """Requests with their donors of the leaf; a leaf of many requests is dealt to several tasks."""
    hot = requests.groupBy("grp", "leaf").count().where(F.col("count") > DEAL_ROWS)
    hot = F.broadcast(hot.select("grp", "leaf", F.ceil(F.col("count") / DEAL_ROWS).cast("int").alias("deals")))
    deals = F.coalesce("deals", F.lit(1))
    asked = requests.join(hot, ["grp", "leaf"], "left").withColumn("deal", F.pmod(F.xxhash64("rid"), deals).cast("int")).drop("deals")
    there = donors.join(hot, ["grp", "leaf"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    key = ["grp", "leaf", "deal"]
    return asked.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_comparer(n_dims, k, index, schema.names, BLOCK), schema)


def _boxes(placed: DataFrame, n_dims: int) -> dict:
    """{group with a tree: leaf numbers, rows and box of each leaf}; the leaves are bounded by the sample of the cuts."""
    ends = [f(F.col("dv")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(n_dims)]
    got = placed.where("big").groupBy("grp", "leaf").agg(F.count(F.lit(1)).alias("rows"), *ends).toArrow()
    names = np.array(got.column("grp").to_pylist(), dtype=object)
    column = lambda c: got.column(c).to_numpy()
    out = {}
    for g in set(names.tolist()):
        own = names == g
        box = {n: np.stack([column(f"{n}{i}").astype(float)[own] for i in range(n_dims)], axis=1) for n in ("lo", "hi")}
        out[g] = {**box, "leaf": column("leaf")[own], "rows": column("rows")[own]}
    return out


def nearest(receivers: DataFrame, donors: DataFrame, n_dims: int, k: int) -> DataFrame:
    """The k nearest donors per (receiver, target): (rid, j, did, dist, dv, rank).

    ``receivers``: (rid, rv array<double>, tgt array<int>), ``rid`` distinct;
    ``tgt`` lists the coordinates to impute, or is ``[-1]`` for plain neighbours.
    ``donors``: (did, dv array<double>), rows of one ``did`` having one vector.  Ids
    are strings or binary.  A donor serves target j when ``dv[j]`` is present; one
    whose ``did`` is the ``rid`` does not count, nor does one without a shared
    coordinate.  Ties go to the smaller ``did``.  NaN and infinite coordinates count
    as missing.  Without donors or receivers the result is empty.
    """
    context = donors.sparkSession.sparkContext
    pool = donors.select("did", _finite("dv").alias("dv")).groupBy("did").agg(F.first("dv").alias("dv"), F.count(F.lit(1)).alias("copies"))
    pool = checkpoint(pool.withColumn("pat", _present("dv")))
    asked = receivers.select("rid", _finite("rv").alias("rv"), F.col("tgt").cast("array<int>").alias("tgt")).withColumn("own", _present("rv"))

    spots = lambda pat: F.explode(F.filter(F.sequence(F.lit(1), F.lit(n_dims)), lambda i: F.substring(pat, i, F.lit(1)) == "1"))
    serves = lambda j: (j < 0) | _has("pat", j)
    ours = asked.select("own", F.explode("tgt").alias("j")).distinct().select("own", "j", spots(F.col("own")).alias("at"))
    sizes = pool.groupBy("pat").agg(F.count(F.lit(1)).alias("n"))
    meet = ours.join(sizes.select("pat", "n", spots(F.col("pat")).alias("at")), "at").where(serves(F.col("j"))).select("own", "pat", "n").distinct()
    both = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_dims - 1)), lambda i: F.when(_has("own", i) & _has("pat", i), "1").otherwise("0")), "")
    meet = meet.withColumn("big", F.col("n") > LEAF_ROWS).withColumn("dims", F.when(F.col("big"), both).otherwise(F.col("pat")))
    meet = meet.withColumn("grp", F.when(F.col("big"), F.concat_ws(":", "pat", "dims")).otherwise(F.col("pat")))
    meet = checkpoint(meet.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("own")) == 1))

    groups = meet.select("pat", "grp", "dims", "big", "n").distinct()
    spread = pool.join(groups.drop("n"), "pat").drop("pat")
    shapes = {r["grp"]: r for r in groups.where("big").collect()}  # at most donors / LEAF_ROWS patterns
    trees, weight = {}, max(1, math.ceil(sum(r["n"] for r in shapes.values()) / SAMPLE_ROWS))
    if shapes:
        some = spread.where("big").where(F.pmod(F.xxhash64("did", F.lit("cuts")), F.lit(weight)) == 0).select("grp", "dv").toArrow()
        names = some.column("grp").combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy()
        x = some.column("dv").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)
        for code, g in enumerate(names.dictionary.to_pylist()):
            trees[g] = _tree(x[codes == code], [d for d in range(n_dims) if shapes[g]["dims"][d] == "1"], weight)
    sent = context.broadcast(trees)
    leafed = lambda df, v: df.mapInArrow(_placer(sent, v, n_dims), T.StructType([*df.schema.fields, T.StructField("leaf", T.IntegerType())]))

    point = F.transform("dv", lambda v, i: F.when(_has("dims", i), v))
    ties = F.row_number().over(Window.partitionBy("grp", "leaf", point).orderBy("did"))
    placed = leafed(spread, "dv").withColumn("tie", ties).where(F.col("tie") <= k + 1).select("grp", "leaf", "big", "did", "dv", "copies")
    placed = checkpoint(placed)
    index = context.broadcast(_boxes(placed, n_dims) if trees else {})
    there = placed.drop("big")

    wanted = asked.join(meet.select("own", "pat", "grp", "dims", "alone"), "own").where(F.exists("tgt", serves)).drop("own", "pat")
    wanted = checkpoint(leafed(wanted.withColumn("bound", F.lit(float("inf"))), "rv"))
    struct = T.StructType([T.StructField("dist", T.DoubleType()), pool.schema["did"], pool.schema["copies"], pool.schema["dv"]])
    fields = [wanted.schema[c] for c in ("rid", "tgt", "grp", "dims", "alone")]
    fields.append(T.StructField("met", T.ArrayType(struct)))
    more = [T.StructField("leaves", T.ArrayType(T.IntegerType())), wanted.schema["rv"], T.StructField("bound", T.DoubleType())]
    at_home = checkpoint(_compared(wanted, there, n_dims, k, index, T.StructType(fields + more)))
    visits = at_home.where(F.size("leaves") > 0).select("rid", "tgt", "grp", "dims", "alone", "rv", "bound", F.explode("leaves").alias("leaf"))
    away = _compared(visits, there, n_dims, k, None, T.StructType(fields))

    single = F.col("alone") & (F.size("leaves") == 0)
    by_target = lambda df: df.select("rid", F.substring_index("grp", ":", 1).alias("pat"), F.explode("tgt").alias("j"), "met").where(serves(F.col("j")))
    done = by_target(at_home.where(single)).select("rid", "j", "met")
    rest = by_target(at_home.where(~single).select("rid", "grp", "tgt", "met").unionByName(away.where(F.size("met") > 0).select("rid", "grp", "tgt", "met")))
    rest = rest.groupBy("rid", "j").agg(F.sort_array(F.flatten(F.collect_list("met"))).alias("met"))
    each = F.flatten(F.transform("met", lambda m: F.array_repeat(m, F.least(m["copies"], F.lit(k).cast("long")).cast("int"))))
    out = done.unionByName(rest).select("rid", "j", F.posexplode(F.slice(each, 1, k)).alias("at", "m"))
    return out.select("rid", "j", "m.did", "m.dist", "m.dv", (F.col("at") + 1).alias("rank"))
