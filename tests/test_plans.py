"""What the plans must look like to hold at scale."""

import re
import threading

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry
from foldwright.operators.vectors import count_rows
from foldwright.plans import audit, catalog
from foldwright.plans import evaluate as E
from foldwright.operators.vectors import vector_table
from foldwright.plans.rates import reference_names
from foldwright.session import materialize
from foldwright.sources.orders import FEATURES, labelled
from tests.conftest import SMALL


@pytest.fixture()
def static(spark):
    """Plans before any runtime change: what is shared is visible."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture()
def stored(monkeypatch):
    """The plans of all tables that are written while a query is built."""
    plans, write = [], DataFrameWriter.parquet

    def recorded(self, path, *args, **more):
        plans.append(plan(self._df))
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["group_folds", "contingency_cube", "single_feature_auc", "leakage_diagnostics",
                                  "kept_features", "dup_stats", "mutual_information"])
def test_each_table_is_scanned_once(static, stored, name):
    text = "\n".join([plan(entry.queries()[name](static, SMALL)), *stored])
    assert [text.count(f"{SMALL}/{table}.parquet]") for table in ("orders", "lineitem")] == [1, 1]


@pytest.mark.parametrize("name", ["ternary_features", "dup_stats", "leakage_diagnostics", "clean_dataset",
                                  "stratified_random_split", "roc_auc", "metrics_summary", "feature_ranking"])
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas", text)


def test_only_needed_columns_are_read(spark):
    text = plan(catalog.label_encode(spark, SMALL))
    assert "l_tax" not in text and "l_shipdate" not in text and "l_quantity" not in text
    assert "o_totalprice" not in text and "o_orderstatus" not in text


def test_train_side_prunes_the_test_partition(spark):
    clean = materialize(catalog.clean_dataset(spark, SMALL), "clean", ["split"])
    text = plan(count_rows(clean.where("split = 'train'"), FEATURES[:3]))
    assert re.search(r"PartitionFilters: \[[^\]]*split[^\]]*= train", text)
    assert "f_prio" not in text


def test_rows_are_hashed_once(spark, stored):
    """The never-null group key adds no null check, which would hash every row again in a filter."""
    rows = materialize(labelled(spark, SMALL), "rows")
    text = "\n".join([plan(audit.tag_folds(vector_table(rows, FEATURES))), *stored])
    assert not re.search(r"Filter [^\n]*md5", text)


def test_the_comparison_fits_run_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, i % 2, int(i % 3 == 0)) for i in range(60)], "row_index long, a int, b int, is_phishing int")
    met = threading.Barrier(3, timeout=60)

    def reference(vectors, features, trial, name, copies):
        met.wait()
        return vectors.sparkSession.createDataFrame([(name, len(features))], "evaluation string, features int")

    monkeypatch.setattr(E, "reference_run", reference)
    got = E.leakage_runs(rows, rows, ["a", "b"], ["a"], {}, prefix="").collect()
    names = reference_names(2)
    assert [tuple(r) for r in got] == [(names["all_random"], 2), (names["all_group"], 2), (names["selected_random"], 1)]
