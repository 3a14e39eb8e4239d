"""Preprocessing of all cross-validation folds fitted at once (E-4, E-13).

The training set of fold i is everything but fold i, so every statistic of it
is a total minus fold i's part.  One grouped pass counts the values of every
column by fold; medians, fences, means, spreads, modes, category codes and
target means of all training sets, and of the whole frame for the refit, are
read off these counts.  The number of Spark jobs depends neither on the number
of folds nor on the number of plans: plans of equal preprocessing share their
statistics.

Stages that are no function of single columns (k-NN and iterative imputation)
do not decompose this way; :meth:`FoldFits.handles` tells plans that use them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import positions
from quarry.functions.stats import exact_quantiles
from quarry.operators import features as FE
from quarry.operators.folds import CROSS_COLUMN, CROSS_FOLDS
from quarry.session import checkpoint


class FoldFits:
    """Fitted preprocessing stages of ``k`` training sets and of all rows (set number ``k``).

    ``folded`` carries ``fold`` (0..k-1), a double ``label`` and ``CROSS_COLUMN``.
    Use as a context manager, or call :meth:`close`: the count tables are
    persisted.  Fitted category tables are checkpointed and outlive it.
    """

    def __init__(self, folded: DataFrame, column_types: dict, task: str, n_classes: int, k: int):
        self.df, self.k, self.spark = folded, k, folded.sparkSession
        self.numeric = [c for c, t in column_types.items() if t == "numeric"]
        self.categorical = [c for c, t in column_types.items() if t == "categorical"]
        y = F.col("label")
        self.classes = list(range(n_classes)) if task != "regression" else None
        self.targets = [y] if not self.classes or n_classes <= 2 else [(y == float(i)).cast("double") for i in self.classes]
        self._held: list[DataFrame] = []
        self._memo: dict = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()
        self._memo.clear()

    @staticmethod
    def handles(plan: dict) -> bool:
        return plan["imputation"] in ("mean", "median")

    def _once(self, key, make):
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(df)
        return df

    def _sets(self, part, total: Column):
        """Array of (i, n) for every training set: the total less ``part(i)``, and the total itself."""
        return F.array(*[F.struct(F.lit(i).alias("i"), (total - part(i)).alias("n")) for i in range(self.k)], F.struct(F.lit(self.k).alias("i"), total.alias("n")))

    # -- rows -------------------------------------------------------------------------

    def label_facts(self) -> dict[int, tuple[int, float]]:
        """(rows, population standard deviation of the label) of each set."""

        def make():
            y = F.col("label")
            got = self.df.groupBy("fold").agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")).collect()
            out = {}
            for i in range(self.k + 1):
                own = [r for r in got if r["fold"] != i]
                n = sum(r["n"] for r in own)
                mean = sum(r["n"] * r["m"] for r in own) / n if n else 0.0
                out[i] = n, (sum(r["n"] * (r["v"] + (r["m"] - mean) ** 2) for r in own) / n) ** 0.5 if n else 0.0
            return out

        return self._once("labels", make)

    def rows(self) -> dict[int, int]:
        """Training rows of each set."""
        return {i: n for i, (n, _) in self.label_facts().items()}

    def class_weights(self) -> dict[int, dict[float, float]]:
        """F-16 for each set: n / (classes * n_class)."""

        def make():
            cells = self.df.groupBy("label", "fold").count().collect()  # classes x folds
            out = {}
            for i in range(self.k + 1):
                n: dict[float, int] = {}
                for r in cells:
                    if r["fold"] != i:
                        n[r["label"]] = n.get(r["label"], 0) + r["count"]
                out[i] = {c: sum(n.values()) / (len(n) * x) for c, x in n.items()}
            return out

        return self._once("weights", make)

    # -- numeric columns --------------------------------------------------------------

    def _ordinal(self, c: int, i: int) -> int:
        return c * (self.k + 1) + i

    def _cells(self) -> DataFrame:
        """(ordinal, v, n): how often each value of a column occurs in each training set."""

        def make():
            kv = F.explode(F.array(*[F.struct(F.lit(a).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for a, c in enumerate(self.numeric)]))
            rows = self.df.select("fold", kv.alias("kv")).select("fold", "kv.c", (F.col("kv.v") + F.lit(0.0)).alias("v"))
            rows = rows.where(F.abs("v") < float("inf"))
            counts = rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("fold") == i, 1)).alias(f"n{i}") for i in range(self.k)])
            counts = self._keep(counts)
            sets = counts.select("c", "v", F.explode(self._sets(lambda i: F.col(f"n{i}"), F.col("n"))).alias("s"))
            return sets.select((F.col("c") * (self.k + 1) + F.col("s.i")).alias("ordinal"), "v", F.col("s.n").alias("n")).where("n > 0")

        return self._once("cells", make)

    def _facts(self, cells: DataFrame, centre: dict[int, float]) -> dict:
        """{ordinal: row of n, lo, hi, sums of distance and squared distance to ``centre``}; columns x sets rows."""
        at = self.spark.createDataFrame([(o, float(x)) for o, x in centre.items()], "ordinal int, centre double")
        d = F.col("v") - F.col("centre")
        got = cells.join(F.broadcast(at), "ordinal").groupBy("ordinal").agg(
            F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("n") * d).alias("s1"), F.sum(F.col("n") * d * d).alias("s2"))
        return {r["ordinal"]: r for r in got.collect()}

    def _base(self) -> dict:
        zero = {self._ordinal(c, i): 0.0 for c in range(len(self.numeric)) for i in range(self.k + 1)}
        return self._once("base", lambda: self._facts(self._cells(), zero))

    def _fills(self, strategy: str) -> dict[int, float]:
        """The imputed value of each column and set; columns without a value in a set are missing."""

        def make():
            base = self._base()
            if strategy == "mean":
                return {o: r["s1"] / r["n"] for o, r in base.items()}
            specs = [(o, int(r["n"]), r["lo"], r["hi"]) for o, r in base.items()]
            return {o: x for (o, _), x in exact_quantiles(self._cells(), specs, [0.5]).items()} if specs else {}

        return self._once(("fill", strategy), make)

    def _filled(self, strategy: str) -> DataFrame:
        """The cells with the imputed rows."""

        def make():
            base, rows = self._base(), self.rows()
            extra = []
            for o, x in self._fills(strategy).items():
                missing = rows[o % (self.k + 1)] - int(base[o]["n"])
                if missing:
                    extra.append((o, float(x), missing))
            more = self.spark.createDataFrame(extra, "ordinal int, v double, n long")  # columns x sets
            return self._cells().unionByName(more)

        return self._once(("filled", strategy), make)

    def _quartiles(self, cells: DataFrame, ends: dict, probs: list[float]) -> dict:
        rows = self.rows()
        specs = [(o, rows[o % (self.k + 1)], lo, hi) for o, (lo, hi) in ends.items()]
        got = exact_quantiles(cells, specs, probs) if specs else {}
        return {o: [got[(o, q)] for q in probs] for o in ends}

    def _bounds(self, strategy: str) -> dict[int, tuple[float, float]]:
        """F-7 fences of each column and set, after imputation (an imputed value lies between the extremes)."""

        def make():
            base = self._base()
            q = self._quartiles(self._filled(strategy), {o: (base[o]["lo"], base[o]["hi"]) for o in self._fills(strategy)}, [0.25, 0.75])
            return {o: (a - FE.WINSOR_FACTOR * (b - a), b + FE.WINSOR_FACTOR * (b - a)) for o, (a, b) in q.items()}

        return self._once(("bounds", strategy), make)

    def _clipped(self, strategy: str, outliers: str) -> DataFrame:
        cells = self._filled(strategy)
        if outliers != "winsorize":
            return cells
        table = self.spark.createDataFrame([(o, float(a), float(b)) for o, (a, b) in self._bounds(strategy).items()], "ordinal int, a double, b double")
        return cells.join(F.broadcast(table), "ordinal").select("ordinal", F.least(F.greatest("v", "a"), F.col("b")).alias("v"), "n")

    def _spread(self, strategy: str, outliers: str) -> dict:
        return self._once(("spread", strategy, outliers), lambda: self._facts(self._clipped(strategy, outliers), self._fills(strategy)))

    def _scales(self, strategy: str, outliers: str, kind: str) -> dict[int, tuple[float, float]]:
        """(shift, divisor) of each column and set."""

        def make():
            facts, fill = self._spread(strategy, outliers), self._fills(strategy)
            if kind == "robust":
                q = self._quartiles(self._clipped(strategy, outliers), {o: (r["lo"], r["hi"]) for o, r in facts.items()}, [0.25, 0.5, 0.75])
                raw = {o: (m, b - a) for o, (a, m, b) in q.items()}
            elif kind == "minmax":
                raw = {o: (r["lo"], r["hi"] - r["lo"]) for o, r in facts.items()}
            else:
                raw = {o: (fill[o] + r["s1"] / r["n"], (max(r["s2"] - r["s1"] ** 2 / r["n"], 0.0) / r["n"]) ** 0.5) for o, r in facts.items()}
            return {o: (a, b or 1.0) for o, (a, b) in raw.items()}

        return self._once(("scale", strategy, outliers, kind), make)

    def _numeric_stages(self, plan: dict, i: int) -> list:
        how, outliers, kind = plan["imputation"], plan["outlier_handling"], plan["scaling"]
        fills = self._fills(how)
        at = {c: self._ordinal(a, i) for a, c in enumerate(self.numeric)}
        kept = {c: o for c, o in at.items() if o in fills}
        out = [FE.InfToNull(self.numeric), FE._DropModel([c for c in self.numeric if c not in kept]), FE._FillModel({c: fills[o] for c, o in kept.items()})]
        if outliers == "winsorize":
            bounds = self._bounds(how)
            out.append(FE._ClipModel({c: bounds[o] for c, o in kept.items()}))
        spread = self._spread(how, outliers)
        constant = [c for c, o in kept.items() if spread[o]["lo"] == spread[o]["hi"]]
        out.append(FE._DropModel(constant))
        if kind != "none":
            scales = self._scales(how, outliers, kind)
            out.append(FE._AffineModel({c: scales[o] for c, o in kept.items() if c not in constant}))
        return out

    # -- categorical columns ----------------------------------------------------------

    def _category_cells(self) -> DataFrame:
        """(c, v, fold, inner fold) -> n and label sums; a missing value is a row of its own."""

        def make():
            kv = F.explode(F.array(*[F.struct(F.lit(a).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for a, c in enumerate(self.categorical)]))
            rows = self.df.select("fold", F.col(CROSS_COLUMN).alias("j"), *[t.alias(f"t{k}") for k, t in enumerate(self.targets)], kv.alias("kv"))
            sums = [F.sum(f"t{k}").alias(f"s{k}") for k in range(len(self.targets))]
            return self._keep(rows.groupBy("kv.c", "kv.v", "fold", "j").agg(F.count(F.lit(1)).alias("n"), *sums))

        return self._once("category cells", make)

    def _modes(self) -> dict[tuple[int, int], str]:
        """F-6 for each column and set: most frequent value, ties to the smaller."""

        def make():
            known = self._category_cells().where(F.col("v").isNotNull())
            n = known.groupBy("c", "v").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("fold") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(self.k)])
            sets = n.select("c", "v", F.explode(self._sets(lambda i: F.col(f"n{i}"), F.col("n"))).alias("s")).where("s.n > 0")
            top = sets.groupBy("c", "s.i").agg(F.min(F.struct(-F.col("s.n"), "v"))["v"].alias("v"))
            return {(r["c"], r["i"]): r["v"] for r in top.collect()}  # columns x sets

        return self._once("modes", make)

    def _dictionary(self) -> DataFrame:
        """(i, c, __v, __code, n, np, s, sp): the categories of each set after imputation, numbered in value order."""

        def make():
            modes = self.spark.createDataFrame([(c, i, v) for (c, i), v in self._modes().items()], "c int, i int, mode string")
            cells = self._category_cells().select("*", F.explode(F.sequence(F.lit(0), F.lit(self.k))).alias("i")).where("i <> fold")
            cells = cells.join(F.broadcast(modes), ["c", "i"]).withColumn("__v", F.coalesce("v", "mode"))
            part = lambda x: F.array(*[F.coalesce(F.sum(F.when(F.col("j") == j, F.col(x))), F.lit(0)).alias(str(j)) for j in range(CROSS_FOLDS)])
            sums = [a for k in range(len(self.targets)) for a in (F.sum(f"s{k}").alias(f"s{k}"), part(f"s{k}").cast("array<double>").alias(f"sp{k}"))]
            rows = cells.groupBy("i", "c", "__v").agg(F.sum("n").alias("n"), part("n").alias("np"), *sums)
            placed = checkpoint(positions(rows, ["i", "c", "__v"], "at"))
            first = placed.groupBy("i", "c").agg(F.min("at").alias("first"))  # columns x sets
            return checkpoint(placed.join(F.broadcast(first), ["i", "c"]).withColumn("__code", F.col("at") - F.col("first")).drop("at", "first"))

        return self._once("dictionary", make)

    def _sizes(self) -> dict[tuple[int, int], int]:
        return self._once("sizes", lambda: {(r["c"], r["i"]): r["count"] for r in self._dictionary().groupBy("c", "i").count().collect()})

    def _priors(self) -> dict[int, tuple[list[float], list[list[float]]]]:
        """Per set: mean of each target, and without each inner fold."""

        def make():
            cells = self.df.groupBy("fold", F.col(CROSS_COLUMN).alias("j")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(f"s{k}") for k, t in enumerate(self.targets)]).collect()
            out = {}
            for i in range(self.k + 1):
                own = [r for r in cells if r["fold"] != i]

                def mean(k, rows, rest):
                    n = sum(r["n"] for r in rows)
                    return sum(r[f"s{k}"] for r in rows) / n if n else rest

                whole = [mean(k, own, None) for k in range(len(self.targets))]
                out[i] = whole, [[mean(k, [r for r in own if r["j"] != j], whole[k]) for j in range(CROSS_FOLDS)] for k in range(len(self.targets))]
            return out

        return self._once("priors", make)

    def _target_tables(self, i: int) -> FE._TargetEncModel:
        prior, left_out = self._priors()[i]
        m = FE.TARGET_SMOOTHING
        exprs = []
        for k, p in enumerate(prior):
            s, sp, n, np_ = F.col(f"s{k}"), F.col(f"sp{k}"), F.col("n"), F.col("np")
            exprs.append(((s + m * p) / (n + m)).alias(f"__te{k}"))
            exprs.append(F.array(*[FE.left_out_mean(s, sp[j], n, np_[j], F.lit(left_out[k][j]), m) for j in range(CROSS_FOLDS)]).alias(f"__lo{k}"))
        tables = {c: self._dictionary().where((F.col("i") == i) & (F.col("c") == a)).select("__v", *exprs) for a, c in enumerate(self.categorical)}
        return FE._TargetEncModel(tables, prior, self.categorical, self.classes, left_out)

    def _categorical_stages(self, plan: dict, i: int) -> list:
        modes = self._modes()
        out = [FE._FillModel({c: modes.get((a, i)) for a, c in enumerate(self.categorical)})]
        if plan["encoding"] == "target":
            return [*out, self._target_tables(i)]
        sizes = {c: self._sizes().get((a, i), 0) for a, c in enumerate(self.categorical)}
        tables = {c: self._dictionary().where((F.col("i") == i) & (F.col("c") == a)).select("__v", "__code") for a, c in enumerate(self.categorical)}
        return [*out, FE._OneHotModel(tables, sizes, self.categorical) if plan["encoding"] == "onehot" else FE._OrdinalModel(tables, self.categorical)]

    # -- stages -----------------------------------------------------------------------

    def preprocessing(self, plan: dict, i: int) -> PipelineModel:
        """The fitted stages of ``plan`` for training set ``i``, up to the feature vector."""
        if not self.numeric and not self.categorical:
            raise ValueError("the table has neither numeric nor categorical features")
        stages = self._numeric_stages(plan, i) if self.numeric else []
        if self.categorical:
            stages += self._categorical_stages(plan, i)
        left = PipelineModel(stages).transform(self.df.limit(0))
        return PipelineModel([*stages, FE.AssembleFeatures(self.numeric, self.categorical).fit(left)])
