"""Readers and sinks by round trip."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldwright.constants import METRIC_COLUMNS
from foldwright.session import materialize, scratch_path, scratch_run
from foldwright.sources.attributes import attribute_names, load_checked, load_ternary, write_ternary
from foldwright.sources.publication import is_whole, manifests, publish, published
from foldwright.sources.tables import (load_clean, read_report, read_variant, six_decimals, write_clean, write_report,
                                       write_summary)

HEADER = """% a comment
@relation sites

@attribute URL_Length { 1,0,-1 }
@ATTRIBUTE 'port number'  { -1,1 }
@attribute Result  { -1,1 }

@data
"""


def test_attribute_file_keeps_file_order(spark, tmp_path):
    rows = [(i % 3 - 1, 1 - 2 * (i % 2), 1 if i % 5 else -1) for i in range(5000)]
    text = "\n".join(", ".join(map(str, r)) for r in rows)
    (tmp_path / "data.arff").write_text(HEADER + "% inside\n" + text + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = load_ternary(spark, str(tmp_path / "data.arff"))
        assert attribute_names(spark, str(tmp_path / "data.arff")) == ["URL_Length", "port number", "Result"]
        assert df.dtypes == [("row_index", "bigint"), ("URL_Length", "tinyint"), ("port number", "tinyint"),
                             ("Result", "tinyint")]
        got = df.orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r)[1:] for r in got] == rows
    assert [r.row_index for r in got] == list(range(5000))


def test_attribute_folder_numbers_files_in_name_order(spark, tmp_path):
    for name, size, value in (("a", 3, 1), ("b", 50, 0), ("c", 7, -1)):
        (tmp_path / f"{name}.arff").write_text(HEADER + f"{value},1,1\n" * size)
    got = [r.URL_Length for r in load_ternary(spark, str(tmp_path)).orderBy("row_index").collect()]
    assert got == [1] * 3 + [0] * 50 + [-1] * 7


def test_malformed_value_is_an_error(spark, tmp_path):
    (tmp_path / "bad.arff").write_text(HEADER + "1,x,1\n")
    with pytest.raises(PySparkException):
        load_ternary(spark, str(tmp_path / "bad.arff")).collect()


def test_bad_lines_are_set_aside_with_file_and_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [(i % 3 - 1, 1 - 2 * (i % 2), 1) for i in range(3000)]
    lines = [",".join(map(str, r)) for r in good]
    for at, text in ((2500, "1,1"), (1200, "1,x,1"), (7, "1,1,1,1"), (0, "400,1,1")):
        lines.insert(at, text)
    (tmp_path / "in" / "a.arff").write_text(HEADER + "% inside\n" + "\n".join(lines) + "\n")
    (tmp_path / "in" / "b.arff").write_text(HEADER + "1,1,\n0,1,1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = load_checked(spark, str(tmp_path / "in"))
        rows, bad = got.rows.orderBy("row_index").collect(), got.bad.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (got.n_rows, got.n_bad) == (len(rows), len(bad)) == (3001, 5)
    assert [tuple(r)[1:] for r in rows] == [*good, (0, 1, 1)] and len({r.row_index for r in rows}) == 3001
    shift = HEADER.count("\n") + 2
    want = {("a.arff", lines.index(t) + shift, t) for t in ("1,1", "1,x,1", "1,1,1,1", "400,1,1")} | {("b.arff", shift - 1, "1,1,")}
    assert {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in bad} == want


def test_a_file_without_bad_lines_has_an_empty_side_table(spark, tmp_path):
    (tmp_path / "data.arff").write_text(HEADER + "1,1,1\n0,-1,1\n")
    got = load_checked(spark, str(tmp_path / "data.arff"))
    assert (got.n_rows, got.n_bad, got.bad.count()) == (2, 0, 0)
    assert sorted(got.rows.collect()) == sorted(load_ternary(spark, str(tmp_path / "data.arff")).collect())


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_clean_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(0, 1, 1, 77, "train"), (1, -1, 0, 2 ** 47, "test")],
                               "row_index long, f byte, is_phishing int, group_id long, split string")
    path = str(tmp_path / "deep" / "clean")
    write_clean(df, path, fmt)
    back = load_clean(spark, path, df.schema, fmt).select(*df.columns)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect()) == sorted(df.collect())
    assert load_clean(spark, path).dtypes == df.dtypes  # the manifest knows the types
    plain = str(tmp_path / "plain")
    df.write.format(fmt).option("header", True).save(plain)
    assert load_clean(spark, plain, fmt=fmt).agg(F.max("group_id")).first()[0] == 2 ** 47


def test_report_round_trip_creates_parents_and_surfaces_errors(spark, tmp_path):
    df = spark.createDataFrame([(0.5, None, {"x": [1.5]})], "score double, gap double, m map<string,array<double>>")
    path = str(tmp_path / "nested" / "report")
    write_report(df, path)
    back = read_report(spark, path).first()
    assert back.score == 0.5 and back.gap is None and back.m.x == [1.5]
    assert read_report(spark, path, df.schema).schema == df.schema
    assert read_report(spark, path, df.schema).first() == df.first()
    (tmp_path / "file").write_text("in the way")
    with pytest.raises(Exception):
        write_report(df, str(tmp_path / "file" / "report"))


def test_summary_text_has_six_decimals(spark, tmp_path):
    df = spark.createDataFrame([("e", *[0.5] * (len(METRIC_COLUMNS) - 1), None)],
                               "evaluation string, " + ", ".join(f"{m} double" for m in METRIC_COLUMNS))
    row = six_decimals(df).first()
    assert row.accuracy == "0.500000" and row.fn is None
    write_summary(df, str(tmp_path / "summary"))
    back = published(spark, str(tmp_path / "summary"))
    assert manifests(spark, str(tmp_path / "summary"))[-1].files == 1
    assert back.columns == ["evaluation", *METRIC_COLUMNS] and back.first().mcc == "0.500000"


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_a_manifest_counts_what_was_written(spark, tmp_path, fmt):
    path = str(tmp_path / "table")
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) AS text", "if(id % 3 = 0, null, id / 4.0D) AS value").repartition(3)
    record = publish(df, path, fmt)
    assert (record.version, record.rows, record.files) == (1, 1000, 3) and record.bytes > 0
    assert sorted(published(spark, path).collect(), key=str) == sorted(df.collect(), key=str) and is_whole(spark, path)
    assert publish(df.limit(0), path, fmt).rows == 0
    assert published(spark, path).dtypes == df.dtypes and published(spark, path).count() == 0
    assert published(spark, path, version=1).count() == 1000
    publish(df.limit(5), path, fmt)
    assert [m.version for m in manifests(spark, path)] == [2, 3] and len(list((tmp_path / "table" / "data").iterdir())) == 2
    with pytest.raises(FileNotFoundError):
        published(spark, path, version=1)


def test_a_run_that_is_cut_off_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    publish(spark.range(10), path)
    broken = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        publish(broken, path)
    assert published(spark, path).count() == 10 and is_whole(spark, path)
    # Files without a manifest, as a run leaves that ends between the two, are not seen either.
    spark.range(50).write.parquet(f"{path}/data/2-half")
    assert published(spark, path).count() == 10
    assert publish(spark.range(20), path).version == 2 and published(spark, path).count() == 20


def test_damaged_files_are_told_by_the_checksum(spark, tmp_path):
    path = str(tmp_path / "table")
    record = publish(spark.range(10), path, "json")
    spark.range(1, 11).write.mode("overwrite").json(f"{path}/{record.folder}")
    assert published(spark, path).count() == 10 and not is_whole(spark, path)


def test_scratch_of_a_run_is_empty_afterwards(spark, tmp_path):
    with scratch_run(spark) as folder:
        outer = materialize(spark.range(5), "outer")
        with pytest.raises(RuntimeError):
            with scratch_run(spark, "inner") as inner:
                assert inner.startswith(folder) and materialize(spark.range(3), "x").count() == 3
                raise RuntimeError("lost")
        assert outer.count() == 5
        publish(outer, str(tmp_path / "kept"))
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        assert store.exists(where) and [f.getPath().getName()[:5] for f in store.listStatus(where)] == ["outer"]
    assert not store.exists(where) and published(spark, str(tmp_path / "kept")).count() == 5
    assert not scratch_path(spark, "later").startswith(folder)


def test_attribute_files_round_trip(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS row_index", "cast(id % 3 - 1 as tinyint) AS a", "cast(id * id % 3 - 1 as tinyint) AS `b c`")
    write_ternary(df.repartition(5), str(tmp_path / "out"), "sites", files=4)
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert load_ternary(spark, str(tmp_path / "out")).orderBy("row_index").collect() == df.collect()


def test_variant_report_keeps_types_without_a_schema(spark, tmp_path):
    df = spark.createDataFrame([(0.5, None, {"x": 7})], "score double, gap double, m map<string,long>")
    write_report(df, str(tmp_path / "r"))
    got = read_variant(spark, str(tmp_path / "r")).select(
        F.variant_get("report", "$.score", "double"), F.variant_get("report", "$.gap", "double"),
        F.variant_get("report", "$.m.x", "long"), F.schema_of_variant("report")).first()
    assert tuple(got)[:3] == (0.5, None, 7) and "gap: VOID" in got[3]
