"""String helpers: name normalisation and the fuzzy-ratio Arrow UDF."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_name(c: Column) -> Column:
    """V-1: split lower->Upper boundaries, lower-case, '_'/'-' runs -> space, collapse, trim."""
    s = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    s = F.lower(s)
    s = F.regexp_replace(s, r"[_\-]+", " ")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def expand_tokens(c: Column, mapping: dict[str, str]) -> Column:
    """V-2: replace whole tokens found in ``mapping`` (split on single spaces)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    toks = F.split(c, " ")
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t)), " ")


def ratcliff_obershelp(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def best_fuzzy_udf(candidates: list[tuple[str, str, str]]):
    """Arrow UDF: best (ratio, category, canonical) of a string against fixed candidates.

    ``candidates`` is a fixed list of (alias, category, canonical); the first
    best ratio wins (strictly greater replaces), as a left-to-right scan.
    """
    rtype = T.StructType([
        T.StructField("ratio", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("canonical", T.StringType()),
    ])

    @F.pandas_udf(rtype)
    def best(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            br, bc, bk = 0.0, None, None
            if v is not None:
                sm = difflib.SequenceMatcher(None, v, "")
                sm.set_seq1(v)
                for alias, cat, canon in candidates:
                    sm.set_seq2(alias)
                    r = sm.ratio()
                    if r > br:
                        br, bc, bk = r, cat, canon
            out.append((br, bc, bk))
        return pd.DataFrame(out, columns=["ratio", "category", "canonical"])

    return best


def ratio_against_udf(targets: list[str]):
    """Arrow UDF: array of difflib ratios of each string against a fixed list of targets."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ratios(s: pd.Series) -> pd.Series:
        res = []
        for v in s:
            if v is None:
                res.append([None] * len(targets))
            else:
                res.append([difflib.SequenceMatcher(None, t, v).ratio() for t in targets])
        return pd.Series(res)

    return ratios


def pair_ratio_udf():
    """Arrow UDF: difflib ratio of two string columns, row by row."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
                          for x, y in zip(a, b)])

    return ratio
