"""quarry — Spark-native table profiling, data-quality checks and model selection.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects; work runs as
DataFrame aggregations, joins, windows and ``pyspark.ml`` pipelines.

Sub-packages
------------
functions   column-expression helpers (null model, dtypes, text, vectors)
sources     readers, append-only attempt log, plan memory, CSV export
operators   profile, dedup, prep, issues, vocabulary, goals, folds, metrics,
            features (ml Estimators), models, clustering, chart data
plans       search space, rule plans, proposals, evaluation loop, pipelines,
            run comparison tables
streaming   (intentionally thin: the modelled tool has no streaming operators)
"""

__version__ = "0.1.0"
