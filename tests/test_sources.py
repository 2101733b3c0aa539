import datetime as dt

import pytest
from pyspark.sql import functions as F
from tallyhouse.functions.dates import on_day
from tallyhouse.operators import reshape
from tallyhouse.sources import headers, schemas, sheets


def test_headers(frame):
    df = frame("`Client Id` long, `...9` string, `Basic Needs` int", (1, "x", 2))
    assert headers.without_spaces(df).columns == ["ClientId", "...9", "BasicNeeds"]
    assert headers.name_position(df, 2, "NewlyHomeless").columns[1] == "NewlyHomeless"
    assert headers.syntactic(df).columns == ["Client.Id", "...9", "Basic.Needs"]


def test_syntactic_headers_are_unique(frame):
    df = frame("`a b` int, `a.b` int, `1x` int", (1, 2, 3))
    assert headers.syntactic(df).columns == ["a.b", "a.b.1", "X1x"]


def test_sheet_round_trip(spark, frame, tmp_path):
    raw = frame("`Client Uid` long, `Event Date` timestamp_ntz", (1, dt.datetime(2022, 12, 31, 23, 59)), (26860, dt.datetime(2022, 1, 1)), (None, None))
    raw.write.parquet(str(tmp_path / "situations"))
    sheet = sheets.read_sheet(spark, str(tmp_path), "situations")
    clean = sheets.cleaned_sheet(sheet, schemas.SITUATIONS, dates=["event_date"], key="client_id", exclude=schemas.TEST_CLIENTS)
    assert [tuple(r) for r in clean.collect()] == [(1, dt.date(2022, 12, 31))]


def test_csv_sheet_with_schema(spark, tmp_path):
    (tmp_path / "programs").mkdir()
    (tmp_path / "programs" / "part.csv").write_text("Agency,Provider\nA,1\nNA,2\n")
    df = sheets.read_sheet(spark, str(tmp_path), "programs", "Agency string, Provider long", format="csv")
    assert [tuple(r) for r in df.orderBy("Provider").collect()] == [("A", 1), (None, 2)]


def test_reader_follows_the_file_name(spark, frame, tmp_path):
    path = tmp_path / "Scores.CSV"
    path.write_text("Race,Basic Needs,Empty,Note\nWhite (HUD),3,NA,\nNA,NA,NA,x\nNA,NA,NA,NA\n")
    df = sheets.read_table(spark, str(path))
    assert df.columns == ["Race", "Basic.Needs", "Empty", "Note"]
    table = sheets.assessment_table(df)
    assert table.columns == ["Race", "Basic.Needs", "Note"]
    assert [tuple(r) for r in table.collect()] == [("White (HUD)", 3, "null"), ("null", None, "x")]
    frame("x int", (1,)).write.parquet(str(tmp_path / "t.parquet"))
    assert sheets.read_table(spark, str(tmp_path / "t.parquet")).count() == 1


def test_report_sink(spark, frame, tmp_path):
    report = frame("report string, population string, metric string, value long", ("a", "All", "m", 1), ("b", "All", "m", 2))
    sheets.write_report(report, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.report, r.value) for r in back.collect()} == {("a", 1), ("b", 2)}


def test_column_choice(frame):
    df = frame("id int, d date, `Primary Race` string, score double", (1, None, "x", 2.0))
    assert reshape.numeric_columns(df) == ["id", "score"]
    assert reshape.other_columns(df) == ["d", "Primary Race"]
    assert reshape.default_grouping(df) == "Primary Race"
    assert reshape.default_grouping(df.drop("Primary Race")) == "d"
    assert reshape.key_first(df, "score").columns == ["score", "Primary Race", "d", "id"]


def test_day_of_timestamp(frame):
    df = frame("t timestamp_ntz", (dt.datetime(2022, 12, 31, 23, 59),))
    assert df.select(on_day("t")).first()[0] == dt.date(2022, 12, 31)


def test_the_file_name_chooses_the_reader(spark, tmp_path):
    path = f"{tmp_path}/csv_exports/scores.parquet"
    spark.range(3).write.parquet(path)
    assert sheets.read_table(spark, path).columns == ["id"]


def test_client_list_with_a_blank_header(spark, tmp_path):
    (tmp_path / "clients").mkdir()
    (tmp_path / "clients" / "part.csv").write_text(
        "Client Id,Date of Birth,Gender,Census Race,Ethnicity,Client Status,Status Date,Veteran?,\n"
        "7,1990-02-03,Male,NA,NA,Active,2022-05-06 23:10:00,No,Newly Homeless\n"
    )
    clients = sheets.client_sheet(sheets.read_sheet(spark, str(tmp_path), "clients", format="csv"))
    assert set(clients.columns) == set(schemas.CLIENTS.values())
    row = clients.first()
    assert (row.newly_homeless, row.status_date, row.veteran) == ("Newly Homeless", dt.date(2022, 5, 6), "No")


def test_a_failed_report_leaves_the_old_one(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    rows = frame("report string, population string, metric string, value long", ("r", "All", "m", 1))
    sheets.write_report(rows, path)
    sheets.write_report(rows.withColumn("value", F.lit(2)), path)
    assert [r.value for r in spark.read.parquet(path).collect()] == [2]
    with pytest.raises(Exception, match="no value"):
        sheets.write_report(rows.withColumn("value", F.raise_error(F.lit("no value")).cast("long")), path)
    assert [r.value for r in spark.read.parquet(path).collect()] == [2]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def _rows_of_scans(plan):
    own = [int(plan.metrics().apply("numOutputRows").value())] if "Scan" in plan.nodeName() else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in _rows_of_scans(children.apply(i))]


def test_columns_without_values_are_known_from_footers(spark, tmp_path):
    path = str(tmp_path / "wide")
    late = F.when(F.col("id") == 29_999, F.col("id"))
    spark.range(0, 30_000, 1, 6).select(
        "id", late.alias("a.late"), F.lit(None).cast("string").alias("none"), F.lit(None).cast("double").alias("b c")
    ).write.parquet(path)
    table = spark.read.parquet(path)
    assert sheets.columns_with_values(table) == ["id", "a.late"]
    assert sheets.columns_with_values(table, probe=1) == ["id", "a.late"]
    assert sheets.without_empty(table).columns == ["id", "a.late"]

    empty = sheets.known_values(table, ["none", "b c"])
    plan = empty._jdf.queryExecution().executedPlan()
    assert plan.executeCollect() is not None
    assert _rows_of_scans(plan) == [0]
    assert "Or(IsNotNull(none),IsNotNull(`b c`))" in empty._jdf.queryExecution().toString()


@pytest.mark.parametrize("schema", ["a int, b string", ""])
def test_a_table_without_values_keeps_no_column(frame, schema):
    rows = [(None, None), (None, None)] if schema else []
    table = sheets.without_empty(frame(schema or "a int", *rows))
    assert (table.columns, table.count()) == ([], 0)
