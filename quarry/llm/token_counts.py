"""Token-count rollups kept up to date by signed deltas in idempotent batches.

A change has a before-image and an after-image of a document: an insert has
only the second, a delete only the first, a revision both.  The before-image
counts negatively, the after-image positively, so totals by source, language
and tokenizer version are plain sums over all committed deltas.  A batch is
aggregated before anything is written and committed as one folder under its
id; a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.stage import read_table, shared_folder, staged

KEYS = ["source", "lang", "version"]
MEASURES = ["docs", "tokens", "chars"]
#: Tokenizer versions of the query: runs without white space; then words and single marks apart.
VERSIONS = {"space-1": "[^\\x20\\x09-\\x0D]+", "marks-2": "[A-Za-z0-9\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]"}
IMAGE = "source string, lang string, version string, tokens long, chars long"


def image(version: str, tokens: Column, text: Column) -> Column:
    """A document's image under a tokenizer version, from its count column; a null text has no tokens and characters."""
    zero = F.lit(0).cast("long")
    return F.struct(
        F.col("source"),
        F.col("lang"),
        F.lit(version).alias("version"),
        F.coalesce(tokens.cast("long"), zero).alias("tokens"),
        F.coalesce(F.length(text).cast("long"), zero).alias("chars"),
    )


def pattern_count(version: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(VERSIONS[version]))


def tokenizer_count(path: str):
    """An Arrow function that counts the ids of a text under a tokenizer file, for use as the count of a version."""
    import pandas as pd

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from quarry.llm.textops import worker_cache

        def load():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(path)

        t = worker_cache(f"tokenizer-{path}", load)
        return pd.Series([len(e.ids) for e in t.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)])

    return count


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (before, after) by KEYS.

    A change without images counts nothing, one whose images are equal cancels
    out; equal changes count each.  Null sources and languages are groups of
    their own.  Groups are summed map-side, so a hot source is one row a task.
    """
    signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("doc")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("doc")))).alias("x")).where("x.doc is not null")
    rows = signed.select(*[F.col(f"x.doc.{k}").alias(k) for k in KEYS], F.col("x.sign").cast("long").alias("docs"), *[(F.col("x.sign") * F.coalesce(F.col(f"x.doc.{m}"), F.lit(0))).cast("long").alias(m) for m in ("tokens", "chars")])
    return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


class TokenLedger:
    """Committed batches below one folder, which any number of sessions may share.

    A batch is committed when its folder holds Spark's _SUCCESS file.  A run
    that dies earlier leaves none, and the same batch id can be written again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def committed(self) -> list[str]:
        """Ids of the committed batches, sorted."""
        top = self._path("batches")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(n.removeprefix("id=") for n in names if self._fs.exists(self._path(f"batches/{n}/_SUCCESS")))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch once; False, without running it, if it is committed already."""
        if not batch_id or not all(c.isalnum() or c in "._-" for c in batch_id):
            raise ValueError(f"batch id {batch_id!r} must be letters, digits, dots, dashes")
        if batch_id in self.committed():
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.folder}/batches/id={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """KEYS and MEASURES summed over committed batches; groups that came to nothing are left out."""
        ids = self.committed()
        schema = "source string, lang string, version string, docs long, tokens long, chars long"
        if not ids:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/batches/id={i}" for i in ids])
        total = rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return total.where("docs <> 0 or tokens <> 0 or chars <> 0")


def rollup(totals: DataFrame) -> DataFrame:
    """Totals by every leading part of KEYS; ``level`` counts the keys that are summed away."""
    cube = totals.rollup(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES], F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).when(F.col("g") == 3, 2).otherwise(3)
    return cube.select(*KEYS, *MEASURES, level.alias("level"))


def query(spark, sf_dir: str) -> DataFrame:
    """The documents' history: all arrive under the first tokenizer version, all
    are counted anew under the second, and exact copies of a document with a
    smaller id are deleted.  The second batch is delivered twice."""
    docs = read_table(spark, sf_dir, "documents")
    none = F.lit(None).cast(f"struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>")
    first, second = VERSIONS
    both = docs.select(
        "doc_id",
        F.xxhash64("text").alias("h1"),
        F.md5("text").alias("h2"),
        image(first, pattern_count(first, F.col("text")), F.col("text")).alias("old"),
        image(second, pattern_count(second, F.col("text")), F.col("text")).alias("new"),
    )
    both = staged(both, "counted")
    ledger = TokenLedger(spark, shared_folder(spark, "token-ledger"))
    ledger.commit("1-arrivals", both.select(none.alias("before"), F.col("old").alias("after")))
    revised = both.select(F.col("old").alias("before"), F.col("new").alias("after"))
    ledger.commit("2-revised", revised)
    ledger.commit("2-revised", revised)
    keeper = both.where("h2 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"))
    copies = both.join(keeper, ["h1", "h2"]).where("doc_id > keeper")
    ledger.commit("3-copies-deleted", copies.select(F.col("new").alias("before"), none.alias("after")))
    return rollup(ledger.totals())


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, lang, text,
           CAST(len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) AS BIGINT) AS n,
           min(doc_id) OVER (PARTITION BY md5(text)) AS keeper
    FROM documents
), kept AS (
    SELECT source, lang, 'marks-2' AS version, count(*) AS docs, sum(coalesce(n, 0)) AS tokens, sum(coalesce(length(text), 0)) AS chars
    FROM d WHERE text IS NULL OR doc_id = keeper GROUP BY source, lang
), r AS (
    SELECT source, lang, version, sum(docs) AS docs, sum(tokens) AS tokens, sum(chars) AS chars,
           grouping(source, lang, version) AS g
    FROM kept GROUP BY ROLLUP (source, lang, version)
)
SELECT source, lang, version, CAST(docs AS BIGINT) AS docs, CAST(tokens AS BIGINT) AS tokens, CAST(chars AS BIGINT) AS chars,
       CAST(CASE g WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS INTEGER) AS level
FROM r
"""
