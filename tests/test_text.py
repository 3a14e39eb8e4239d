from pyspark.sql import functions as F

from quarry.operators.goals import route_goals
from quarry.operators.vocab import table_domain, tag_columns


def _cat(spark, names, table="t"):
    return spark.createDataFrame([(table, n, i) for i, n in enumerate(names)], "table_name string, column_name string, ordinal int")


def test_normalisation_and_exact_tags(spark):
    tags = {r["column_name"]: r for r in tag_columns(_cat(spark, ["teamName", "minutes-played", "PTS", "ordQty", "gradeless"]), fuzzy=False).collect()}
    assert tags["teamName"]["normalised"] == "team name" and tags["teamName"]["category"] == "entity"
    assert tags["minutes-played"]["category"] == "playing_time"
    assert tags["PTS"]["canonical"] == "points"
    assert tags["ordQty"]["normalised"] == "order quantity" and tags["ordQty"]["canonical"] == "quantity"
    assert tags["gradeless"]["match_kind"] is None  # 'grade' must not match inside a word


def test_fuzzy_threshold(spark):
    tags = {r["column_name"]: r for r in tag_columns(_cat(spark, ["throughputs", "xyzzy"])).collect()}
    assert tags["xyzzy"]["match_kind"] is None and tags["throughputs"]["match_kind"] == "fuzzy"


def test_value_scan_and_domain_thresholds(spark):
    names = [f"col{i}" for i in range(25)]
    vals = spark.createDataFrame([("t", "col3", "Machinery")], "table_name string, column_name string, value string")
    tags = tag_columns(_cat(spark, names), vals)
    d = table_domain(tags).first()
    assert abs(d["confidence"] - 0.5 / 25) < 1e-12 and d["detected_domain"] == "possible_sports"
    names60 = [f"c{i}" for i in range(59)] + ["goals"]
    d2 = table_domain(tag_columns(_cat(spark, names60), fuzzy=False)).first()
    assert d2["detected_domain"] == "general_tabular"


def test_goal_routing(spark):
    goals = spark.createDataFrame([
        (1, "Predict player position based on match stats"),
        (2, "Explore natural groups of players"),
        (3, "cluster the data and predict churn"),
        (4, "describe this table"),
        (5, "what revenue can we count on"),
    ], "goal_id int, text string")
    cols = ["player_positions", "nation_position", "total_paid", "age"]
    r = {x["goal_id"]: x for x in route_goals(goals, cols, {"total_paid": "numeric", "age": "numeric"},
                                               {"total_paid": 16, "age": 15}).collect()}
    assert r[1]["mode"] == "predictive" and r[1]["target"] == "player_positions"
    assert r[1]["target_phrase"] == "player position" and r[1]["task_type"] == "classification"
    assert r[2]["mode"] == "exploratory"
    assert r[3]["mode"] == "predictive"
    assert r[4]["target"] is None and r[4]["confidence"] == "low"
    assert r[5]["target"] == "total_paid" and r[5]["task_type"] == "regression"


def test_domain_wording_in_questions(spark):
    from quarry.operators.issues import detect_issues
    from quarry.plans.runs import domain_questions

    rows = [(i, None if i < 50 else float(i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, minutes_played double, target double")
    iss = detect_issues(df, "target")
    q = {(r["issue_type"], r["affected_column"]): r["question"] for r in domain_questions(df, iss, "target").collect()}
    assert "take part" in q[("high_missingness", "minutes_played")]  # playing-time wording, not the generic one
    assert "before the outcome" in q[("leakage_candidate", "minutes_played")]  # no leakage template for this category
