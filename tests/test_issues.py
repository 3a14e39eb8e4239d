from quarry.operators.issues import clarification_questions, detect_issues, issue_counts


def kinds(df):
    return [(r["issue_type"], r["severity"], r["affected_column"]) for r in df.orderBy("position").collect()]


def test_high_missingness(spark):
    rows = [(None if i < 40 else float(i), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, target int")
    assert ("high_missingness", "high", "a") in kinds(detect_issues(df, "target"))


def test_clean_has_no_issues(spark):
    df = spark.createDataFrame([(25, 30000, 0), (32, 45000, 1), (47, 80000, 0), (51, 62000, 1), (38, 51000, 0)],
                               "age int, income int, target int")
    assert kinds(detect_issues(df, "target")) == []


def test_imbalance_high(spark):
    df = spark.createDataFrame([(i, 1 if i < 5 else 0) for i in range(100)], "x int, target int")
    assert ("class_imbalance", "high", "target") in kinds(detect_issues(df, "target"))


def test_duplicates_high(spark):
    df = spark.createDataFrame([(i % 11, i % 2) for i in range(110)], "a int, target int")
    assert ("duplicates", "high", None) in kinds(detect_issues(df, "target"))


def test_outliers(spark):
    rows = [(float(i % 20), i % 2) for i in range(200)] + [(1000.0 * (1 if i % 2 else -1), 0) for i in range(6)]
    df = spark.createDataFrame(rows, "x double, target int")
    got = [k for k in kinds(detect_issues(df, "target")) if k[0] == "outliers"]
    assert got and got[0][1] in ("high", "medium")


def test_identifier_is_noisy_medium(spark):
    df = spark.createDataFrame([(f"id{i}", i % 2) for i in range(100)], "id_col string, target int")
    assert ("noisy_categories", "medium", "id_col") in kinds(detect_issues(df, "target"))


def test_severity_sorted(spark):
    rows = [(None if i < 40 else float(i), 1 if i < 5 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, target int")
    ranks = [r["severity_rank"] for r in detect_issues(df, "target").orderBy("position").collect()]
    assert ranks == sorted(ranks)


def test_leakage(spark):
    rows = [(1.001 * i, float((i * 7919) % 13), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "leak_col double, noise double, target double")
    assert ("leakage_candidate", "high", "leak_col") in kinds(detect_issues(df, "target"))


def test_constant_column_correlation_is_not_an_error(spark):
    rows = [(1.0, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "const double, target double")
    assert [k for k in kinds(detect_issues(df, "target")) if k[0] == "leakage_candidate"] == []


def test_questions_and_counts(spark):
    rows = [(None if i < 45 else float(i), 1.001 * i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, leak double, target double")
    iss = detect_issues(df, "target")
    q = clarification_questions(iss, "target", domain_question="Is this sports data?")
    types = [r["issue_type"] for r in q.orderBy("position").collect()]
    assert types[0] == "domain_confirmation" and "high_missingness" in types and "leakage_candidate" in types
    assert len(types) <= 4
    c = {r["severity"]: r["n_issues"] for r in issue_counts(iss).collect()}
    assert c["high"] >= 2 and set(c) == {"high", "medium", "low"}
