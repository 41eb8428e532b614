"""Both jobs on copies of tables: growing input, reruns, repeats after a failure, contracts and the command line."""

import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import jobs
from cohortloom.operators import regional
from jobs import cohort_report, region_intake

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables aren't there")


def same(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def hierarchy(d=DIR):
    return [f"{d}/{t}.parquet" for t in ("supplier", "nation", "region")]


def nodes(spark, output):
    return spark.read.schema(region_intake.NODES).parquet(f"{output}/nodes")


def test_intake_takes_only_what_is_new(spark, tmp_path, caplog):
    source, output = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_returnflag", "l_suppkey", "l_extendedprice", "l_orderkey")
    first, second = rows.where("l_orderkey % 3 > 0"), rows.where("l_orderkey % 3 = 0")
    config = region_intake.Config(files_per_batch=1)
    (tmp_path / "in").mkdir()
    with caplog.at_level(logging.INFO, "jobs"):
        region_intake.run(spark, source, *hierarchy(), output, config)
        assert nodes(spark, output).count() == 0  # nothing has come yet
        first.repartition(2).write.mode("append").parquet(source)
        region_intake.run(spark, source, *hierarchy(), output, config)
        half = same(nodes(spark, output))
        second.repartition(1).write.mode("append").parquet(source)
        region_intake.run(spark, source, *hierarchy(), output, config)
        whole = same(nodes(spark, output))
        region_intake.run(spark, source, *hierarchy(), output, config)
    told = [r.getMessage() for r in caplog.records if "new measurements" in r.getMessage()]
    assert [int(m.split()[1]) for m in told] == [0, first.count(), second.count(), 0]
    sums = spark.read.schema(region_intake.SUMS).parquet(f"{output}/sums")
    assert sums.select("batch").distinct().count() == 3 and sums.agg(F.sum("measured")).first()[0] == rows.count()
    assert half != whole == same(nodes(spark, output))
    # at once, in one batch: the same
    region_intake.run(spark, f"{DIR}/lineitem.parquet", *hierarchy(), f"{output}-once")
    assert same(nodes(spark, f"{output}-once")) == whole


def test_a_batch_that_is_repeated_counts_once(spark, tmp_path):
    """The run dies after it wrote a batch's sums and before the checkpoint says so."""
    output = f"{tmp_path}/out"
    run = lambda: region_intake.run(spark, f"{DIR}/lineitem.parquet", *hierarchy(), f"file://{output}")
    run()
    before = same(nodes(spark, f"file://{output}"))
    for f in (tmp_path / "out" / "checkpoint" / "commits").iterdir():
        f.unlink()
    run()
    assert same(nodes(spark, f"file://{output}")) == before
    assert spark.read.schema(region_intake.SUMS).parquet(f"file://{output}/sums").agg(F.sum("measured")).first()[0] == spark.read.parquet(f"{DIR}/lineitem.parquet").count()


def test_sums_of_parts_are_sums(spark):
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), ("a", 1, 0.3), ("a", 1, 0.0), ("a", 1, float("nan")), ("a", 1, None), ("a", 2, -5.0)], "subject string, label long, pet double")
    whole = regional.label_sums(rows, ["subject"], kind="decimal(38,6)")
    assert sorted(map(tuple, whole.select("label", "measured", "valid", F.col("total").cast("double")).collect())) == [(1, 6, 3, 0.6), (2, 1, 0, None)]


def test_a_file_s_pattern_matches_it_alone():
    assert region_intake.pattern("s3a://b/x.parquet") == "s3a://b/x.parque[t]"
    assert region_intake.pattern("/a/b/") == "/a/[b]" and region_intake.pattern("/a/*.parquet") == "/a/*.parquet"


def test_report_is_the_same_after_a_rerun(spark, tmp_path):
    output = f"file://{tmp_path}/report"
    run = lambda: cohort_report.run(spark, f"{DIR}/documents.parquet", f"{DIR}/labels.parquet", output)
    read = lambda: spark.read.schema(cohort_report.SCHEMA).parquet(f"{output}/report")
    run()
    first = same(read())
    run()
    assert first and same(read()) == first
    assert {p.name.split("=")[0] for p in (tmp_path / "report" / "report").iterdir() if p.is_dir()} == {"group"}
    n = {r.group: r.value for r in read().where("section = 'performance' and statistic = 'n'").collect()}
    assert sum(n.values()) == spark.read.parquet(f"{DIR}/labels.parquet").count()


def test_report_of_awkward_texts(spark, tmp_path):
    texts = [(1, None, None), (2, "", "en"), (3, "one 2 three", "en"), (4, "é 中文\n\n x", "en"), (5, "a b", "de")]
    spark.createDataFrame([(i, t, g, "s", "more") for i, t, g in texts], "doc_id long, text string, lang string, source string, y string").write.parquet(f"{tmp_path}/d")
    labels = lambda rows, name: spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}")
    labels([(i, i % 2) for i in range(1, 6)], "l")
    out = f"file://{tmp_path}/o"
    cohort_report.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", out)
    got = {(r.group, r.section, r.item, r.statistic): r.value for r in spark.read.schema(cohort_report.SCHEMA).parquet(f"{out}/report").collect()}
    assert got["unknown", "performance", "all", "n"] == 1 and ("unknown", "performance", "all", "auc") not in got
    assert got["en", "description", "n_words", "max"] == 3 and got["en", "description", "n_lines", "max"] == 3
    assert got["en", "description", "mean_word", "n"] == 2 and got["en", "description", "digit_share", "max"] == round(1 / 9, 6)
    for name, rows in (("missing", [(99, 1)]), ("half", [(1, 2)])):
        labels(rows, name)
        with pytest.raises(Exception, match="missing|must be 0 or 1"):
            cohort_report.run(spark, f"{tmp_path}/d", f"{tmp_path}/{name}", f"{out}-{name}")
    labels([], "none")
    cohort_report.run(spark, f"{tmp_path}/d", f"{tmp_path}/none", f"{out}-none")
    assert not spark.read.schema(cohort_report.SCHEMA).parquet(f"{out}-none/report").count()


def test_settings_are_read_and_restored(spark, tmp_path):
    assert cohort_report.Config.read(spark, (ROOT / "jobs" / "cohort_report.json").as_uri()) == cohort_report.Config()
    assert region_intake.Config.read(spark, (ROOT / "jobs" / "region_intake.json").as_uri()) == region_intake.Config()
    names = ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")
    before = [spark.conf.get(n, None) for n in names]
    assert jobs.job2_region_intake(spark, DIR).count() > 0
    assert [spark.conf.get(n, None) for n in names] == before and not spark.streams.active


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    got = jobs.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    columns = sorted(got.columns)
    want = con.sql(jobs.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.mark.parametrize("job", ["cohort_report", "region_intake"])
def test_command_line(job, tmp_path):
    inputs = [f"{DIR}/documents.parquet", f"{DIR}/labels.parquet"] if job == "cohort_report" else [f"{DIR}/lineitem.parquet", *hierarchy()]
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *inputs, f"{tmp_path}/out"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr and "wrote " in done.stderr
