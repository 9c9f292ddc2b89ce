"""CSV tables and settings files."""

import json

import pytest

from riskloom.sources.settings import read_settings, trainer_params
from riskloom.sources.sinks import write_table
from riskloom.sources.tables import load_table


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text', 0.1), (2, None, -1.5), (3, "ü", None), (4, "line", 1e300)]
    df = spark.createDataFrame(rows, "id long, s string, x double")
    write_table(df, f"{tmp_path}/t.csv", "csv")
    with_schema = load_table(spark, str(tmp_path), "t", "csv", df.schema)
    assert sorted(map(tuple, with_schema.collect())) == rows and with_schema.schema["x"].dataType.simpleString() == "double"
    inferred = load_table(spark, str(tmp_path), "t", "csv")
    assert inferred.columns == ["id", "s", "x"] and inferred.count() == 4
    write_table(df, f"{tmp_path}/bare.csv", "csv", header=False)
    assert load_table(spark, str(tmp_path), "bare", "csv", df.schema, header=False).count() == 4


def test_settings_of_a_json_file(spark, tmp_path):
    best = {"scale_pos_weight": 12.5, "reg_lambda": 10, "num_leaves": 15, "n_estimators": 10000, "learning_rate": 0.05, "colsample_bytree": 0.95, "bagging_fraction": 0.3}
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"most_important_features": ["b", "a"], "best_params": best}, indent=2))
    got = read_settings(spark, str(path), max_trees=100)
    assert got.features == ["b", "a"] and got.pos_weight == 12.5
    assert got.params == {"stepSize": 0.05, "maxDepth": 4, "maxIter": 100, "featureSubsetStrategy": "0.95"}
    assert got.unused == ("bagging_fraction", "reg_lambda")
    path.write_text("{}")
    assert read_settings(spark, str(path)).features is None
    assert trainer_params({"bagging_fraction": 0.5, "bagging_freq": 1, "num_leaves": 31})[0] == {"subsamplingRate": 0.5, "maxDepth": 5}
    path.write_text("{")
    with pytest.raises(ValueError, match="Expecting"):
        read_settings(spark, str(path))
