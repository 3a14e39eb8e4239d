from quarry.operators.prep import PrepConfig, parse_number, prepare


def _strings(n_ok, n=100):
    return [(str(i) if i < n_ok else "n/a", i % 2) for i in range(n)]


def test_coercion_threshold(spark):
    for n_ok, expect in ((79, []), (80, ["s"]), (81, ["s"])):
        df = spark.createDataFrame(_strings(n_ok), "s string, target int")
        _, rep = prepare(df, "target", PrepConfig(drop_duplicates=False))
        assert rep.coerced_columns == expect, n_ok


def test_parse_guard(spark):
    vals = [" 7 ", ".5", "5.", "1e3", "inf", "-Infinity", "5d", "1_000", "", "1,000", "NaN", "True"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(parse_number(df["v"])).collect()]
    assert got[:6] == [7.0, 0.5, 5.0, 1000.0, float("inf"), float("-inf")]
    assert got[6:] == [None] * 6


def test_drops_and_rare_classes(spark):
    rows = []
    for i in range(200):
        rows.append((float(i), "k", None, "c" if i % 2 else None, "A" if i < 4 else ("B" if i < 9 else "C")))
    df = spark.createDataFrame(rows, "x double, const string, empty double, sparse string, target string")
    out, rep = prepare(df, "target")
    assert rep.dropped_all_nan == ["empty"]
    assert sorted(rep.dropped_constant) == ["const", "sparse"]
    assert rep.rare_classes == ["A"]
    assert out.columns == ["x", "target"]


def test_missing_rate_threshold_is_strict(spark):
    rows = [(None if i < 99 else 1.0, float(i), i % 2) for i in range(100)]  # exactly .99 missing
    df = spark.createDataFrame(rows, "m double, x double, target int")
    _, rep = prepare(df, "target")
    assert "m" not in rep.dropped_all_nan


def test_nan_equals_null_duplicates_and_target_survives(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 1), (2.0, 1)], "a double, target int")
    out, rep = prepare(df, "target")
    assert rep.dropped_duplicate_rows == 1
    assert "target" in out.columns
