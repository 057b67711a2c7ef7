"""Every registered election query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from psephos.operators import threshold
from psephos.plans import views
from psephos.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(name, spark, sf, con):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def exchanges(df) -> int:
    """Shuffles of a plan before adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name,most", [("d11_final_tally", 10), ("d13_tally_precinct_mode", 10), ("d14_tally_by_batch", 10), ("d9_contest_status", 6)])
def test_marks_are_moved_once(name, most, spark, sf):
    """Status needs no shuffle beside the one that numbers a ballot's marks."""
    assert exchanges(QUERIES[name](spark, sf)) <= most


CUT = ["b10_classify", "d9_contest_status", "d11_final_tally", "d13_tally_precinct_mode", "d14_tally_by_batch", "a8_cvr_lines", "e10_threshold_errors", "e10_best_line"]


@pytest.mark.parametrize("name", CUT)
def test_with_marks_on_both_sides_of_the_threshold(name, spark):
    """On the larger table, where some marks lie beyond the threshold's rank."""
    larger = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    got, want = QUERIES[name](spark, larger).toPandas(), c.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)


def test_threshold_of_the_whole_histogram(spark):
    """A figure worked out beforehand from the definition, for quantities under 20 or over 38."""
    marks = views.marks(spark, "/root/testdata/sf0.01").where("intensity < 100 or intensity > 190")
    (row,) = threshold.best_line(threshold.threshold_errors(threshold.histogram(marks))).collect()
    assert (row.line, round(row.error, 9)) == (5, 1.664412923)
