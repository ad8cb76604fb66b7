from tabwork.operators import profile as P
from tabwork.plans import cleaning as CP
from tabwork.plans import features as FP


def _frame(spark):
    rows = []
    for i in range(100):
        rows.append((
            i,                                              # id-like numeric
            None if i < 60 else float(i),                   # 60 % missing -> drop column
            None if i < 10 else float(i % 7),               # 10 % missing numeric -> median impute
            None if i < 10 else ["x", "y", "z"][i % 3],      # 10 % missing string -> mode impute
            1.0 + (0.001 if i == 0 else 0.0),               # near-zero variance -> drop
            f"u{i}",                                         # unique strings -> high cardinality
            1e6 if i >= 97 else float(i % 5),               # heavy outliers -> clip
        ))
    rows.append(rows[-1])                                   # one exact duplicate
    return spark.createDataFrame(rows, "id long, sparse double, num double, cat string, flat double, code string, spiky double")


def test_clean_plan_rules(spark):
    df = _frame(spark)
    plan = {(r.issue_type, r.column_name): r for r in CP.clean_plan(P.profile_columns(df), P.profile_dataset(df)).collect()}
    assert plan[("duplicates", "__all__")].strategy == "drop_rows"
    assert plan[("missing_values", "sparse")].strategy == "drop_column"
    assert plan[("missing_values", "num")].strategy == "median_impute"
    assert plan[("missing_values", "cat")].strategy == "mode_impute"
    assert plan[("low_variance", "flat")].strategy == "drop_column"
    assert plan[("high_cardinality", "code")].strategy == "drop_column"
    assert plan[("outliers", "spiky")].strategy == "clip_outliers"
    assert ("outliers", "num") not in plan


def test_feature_plan_rules(spark):
    df = _frame(spark)
    specs = {r.source_column: r for r in FP.feature_plan(P.profile_columns(df), target="num").collect()}
    assert "num" not in specs                                  # target skipped
    assert specs["code"].transform == "none" and not specs["code"].enabled   # ID-like string
    assert specs["cat"].transform == "one_hot_encode"
    assert specs["spiky"].transform == "log" and specs["spiky"].output_name == "spiky_log"
    assert specs["id"].transform == "standard_scale"
    excl = {r.source_column for r in FP.feature_plan(P.profile_columns(df), target="num", exclude=["cat"]).collect()}
    assert "cat" not in excl                                   # quirk Q9: excluded PII columns get no spec
