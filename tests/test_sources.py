import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.operators.contracts import ContractError
from cohortloom.sources import sinks, stats_text, tables


def test_strict_json(spark, tmp_path):
    assert tables.parse_json('﻿{"a": [1, null]}') == {"a": [1, None]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}'):
        with pytest.raises(ContractError):
            tables.parse_json(bad)
    (tmp_path / "a.json").write_text('{"schema_version": 1, "rows": [{"x": 1}]}')
    doc = tables.json_documents(spark, str(tmp_path / "a.json"), "schema_version int, rows array<struct<x:int>>").first().document
    assert tables.manifest_rows(doc.asDict(True)) == [{"x": 1}]
    with pytest.raises(ContractError):
        tables.manifest_rows({"schema_version": True, "rows": [{}]})
    faults = spark.createDataFrame([('{"k": 1}',), ('{"k": 1, "k": 2}',), ("[1]",)], "j string").select(tables.json_objects(F.col("j")).alias("e")).collect()
    assert [f.e is None for f in faults] == [True, False, False]


def test_keyed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("study_id,v\nA1,1.5\nB2,\n")
    df = tables.with_file_order(tables.keyed_csv(spark, str(tmp_path / "a.csv"), "study_id string, v double"))
    assert [tuple(r) for r in df.orderBy("row_pos").collect()] == [("A1", 1.5, 0), ("B2", None, 1)]
    (tmp_path / "b.tsv").write_text("study_id\tv\nA1\t1\nA1\t2\n")
    with pytest.raises(ContractError):
        tables.keyed_csv(spark, str(tmp_path / "b.tsv"), "study_id string, v double")


def test_reviews_and_selection(spark):
    df = spark.createDataFrame([("s1", "pass"), ("s2", "FAIL"), ("s3", "PASS"), ("s3", "PASS")], "study_id string, qc string")
    assert tables.review_decisions(df, "s1", "qc") == "PASS"
    for s in ("s2", "s3", "s4"):
        with pytest.raises(ContractError):
            tables.review_decisions(df, s, "qc")
    cols = "source_nii string, target_nii string, review_pass string, pet_metadata_patch_json string, metadata_patch_reviewed string"
    assert tables.selection_manifest(spark.createDataFrame([("a", "b", "PASS", "", "")], cols)).count() == 1
    with pytest.raises(ContractError):
        tables.selection_manifest(spark.createDataFrame([("a", "b", "PASS", "{}", "")], cols))


def test_stats_texts(spark):
    lines = ["# Measure EstimatedTotalIntraCranialVol, eTIV, Estimated Total Intracranial Volume, 1500000.5, mm^3", "# comment", "  1  10  100  1000.5  Left-Thalamus  0", "short line"]
    df = spark.createDataFrame([("s", v) for v in lines], "subject string, line string")
    assert [r.v for r in df.select(stats_text.intracranial_volume(F.col("line")).alias("v")).collect()] == [1500000.5, None, None, None]
    assert [tuple(r) for r in stats_text.structure_volumes(df).collect()] == [("s", "Left-Thalamus", 1000.5)]
    p = spark.createDataFrame([("s", "lh", "insula 100 250 900 2.5 0.4"), ("s", "lh", "x y z")], "subject string, hemi string, line string")
    assert [tuple(r) for r in stats_text.parcel_thickness(p).collect()] == [("s", "lh", "insula", 250.0, 2.5)]
    g = spark.createDataFrame([("s", "1 10 Thal sub 100 0.5 1.25 0"), ("s", "")], "subject string, line string")
    assert [tuple(r) for r in stats_text.gtm_table(g).collect()] == [("s", 10, 1.25)]
    with pytest.raises(PySparkException):
        stats_text.gtm_table(spark.createDataFrame([("s", "1 2 3")], "subject string, line string")).collect()
    lta = "type      = 1\nnxforms   = 1\n1 4 4\n1 0 0 5\n0 1 0 0\n0 0 1 0\n0 0 0 1\nsrc volume info\n"
    kind, m = stats_text.transform_matrix(F.col("t"))
    r = spark.createDataFrame([(lta,)], "t string").select(kind.alias("k"), m.alias("m")).first()
    assert r.k == 1 and r.m[0] == [1.0, 0.0, 0.0, 5.0] and len(r.m) == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, v double")
    sinks.write_json(df, str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.schema("k int, v double").json(str(tmp_path / "j")).orderBy("k").collect()] == [(1, None), (2, 0.5)]
    with pytest.raises(PySparkException):
        sinks.write_json(df, str(tmp_path / "j"))
    with pytest.raises(ContractError):
        sinks.write_json(df, str(tmp_path / "k"), finite="raise")
    with pytest.raises(ContractError):
        sinks.fresh_target("/data/in/x", ["/data/in"])
    assert sinks.digest({"b": 1, "a": 2}) == sinks.digest({"a": 2, "b": 1})
    (tmp_path / "f").write_text("x")
    m = sinks.freeze([str(tmp_path / "f")], {"a": 1})
    sinks.verify(m, {"a": 1})
    (tmp_path / "f").write_text("y")
    with pytest.raises(ContractError):
        sinks.verify(m, {"a": 1})


def test_more_sources(spark, tmp_path, capsys):
    import numpy as np

    from cohortloom.__main__ import main

    (tmp_path / "m.csv").write_text("study_id,scanner,extra\nA,NA,1\nB,,2\n")
    got = tables.scanner_metadata(spark, str(tmp_path / "m.csv"))
    assert got.columns == ["study_id", "scanner"] and got.where("scanner = 'NA'").count() == 1
    with pytest.raises(ContractError):
        tables.scanner_metadata(spark, str(tmp_path / "m.csv"), ("study_id", "site"))
    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(2, 3))
    assert [tuple(r) for r in tables.array_bundle(spark, str(tmp_path / "a.npz"), "x").orderBy("row_pos").collect()] == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    fine = {"participant_ids": ["a", "b"], "rows": [{"x": 1}, {"x": 2}], "outcome": [0, 1]}
    assert tables.model_input(fine, ["x"]) is fine
    for bad in ({**fine, "outcome": [0, 0.5]}, {**fine, "participant_ids": ["a", "a"]}, {**fine, "rows": [{"x": 1}, {"y": 2}]}):
        with pytest.raises(ContractError):
            tables.model_input(bad, ["x"])
    assert main(["environment"]) == 0 and "pyspark" in capsys.readouterr().out
    assert main(["queries"]) == 0 and "q_brier" in capsys.readouterr().out


def test_arrays_payloads_and_status(spark, tmp_path):
    import numpy as np

    arrays = {"a": np.arange(6).reshape(2, 3), "b": np.array(1.5)}
    sinks.write_arrays(spark, str(tmp_path / "arrays"), arrays)
    back = sinks.read_arrays(spark, str(tmp_path / "arrays"))
    assert all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in arrays.items())
    for bad in (np.array([np.nan]), np.array(["x"]), np.array([None])):
        with pytest.raises(ContractError):
            sinks.write_arrays(spark, str(tmp_path / "bad"), {"a": bad})
    assert sinks.payload({1: np.float64(2), "x": (1, float("inf"))}) == {"1": 2.0, "x": [1, None]}
    with pytest.raises(ContractError):
        sinks.payload([1])
    assert sinks.status_document(str(tmp_path / "ok"), spark, lambda: None)["status"] == "PASS"
    with pytest.raises(ZeroDivisionError):
        sinks.status_document(str(tmp_path / "failed"), spark, lambda: 1 / 0)
    assert '"status": "FAILED"' in spark.read.text(str(tmp_path / "failed")).first()[0]


def test_feature_config(spark, tmp_path):
    good = '{"composites": {"c": ["n", "m"]}, "nodes": {"n": {"left": 1, "right": 2}, "m": {"left": 3, "right": 4}}, "references": {"r": [7, 8]}}'
    (tmp_path / "a.json").write_text(good)
    got = tables.feature_config(spark, str(tmp_path / "a.json"))
    assert sorted(map(tuple, got["regions"].collect())) == [(1, "L", "n", "c"), (2, "R", "n", "c"), (3, "L", "m", "c"), (4, "R", "m", "c")] and got["references"].count() == 2
    for bad in (good.replace('"m"]', '"n"]'), good.replace('"left": 3', '"left": 1'), good.replace('"references"', '"refs"')):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ContractError):
            tables.feature_config(spark, str(tmp_path / "b.json"))


def test_model_input_checks_its_plan():
    y = [0, 1] * 6
    rest = lambda test: [k for k in range(12) if k not in test]

    def split(test):
        train = rest(test)
        return {"repeat": 0, "fold": test[0] // 4, "train": train, "test": test, "inner_seed": 1, "inner": [{"train": train[4:], "validation": train[:4]}, {"train": train[:4], "validation": train[4:]}]}

    document = {"participant_ids": [f"p{k}" for k in range(12)], "rows": [{"a": 1}] * 12, "outcome": y, "plan": [split([0, 1, 2, 3]), split([4, 5, 6, 7]), split([8, 9, 10, 11])]}
    assert tables.model_input(document, ["a"]) is document

    def broken(change):
        import copy

        d = copy.deepcopy(document)
        change(d["plan"])
        with pytest.raises(ContractError):
            tables.model_input(d, ["a"])

    broken(lambda p: p.pop())
    broken(lambda p: p[0]["test"].append(4))
    broken(lambda p: p[0]["train"].pop())
    broken(lambda p: p[0]["inner"][0]["validation"].append(p[0]["inner"][0]["train"][0]))
    broken(lambda p: p[0]["inner"].pop())
    broken(lambda p: p[0].update(test=[0, 1, 2, 3.0]))
    broken(lambda p: p[1].update(fold=0))  # a fold twice
    broken(lambda p: p[2].update(fold=5))  # a gap
    broken(lambda p: p[0]["inner"].append({"train": p[0]["train"], "validation": []}))
    broken(lambda p: p.extend({**x, "repeat": 2} for x in list(p)))  # no repeat 1
    broken(lambda p: p[1].update(test=[0, 1, 2, 3], train=rest([0, 1, 2, 3])))
