import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.sources import landing as L
from conftest import rows


def test_change_pages_explode_and_shape(spark):
    d = tempfile.mkdtemp(prefix="al-pages-")
    os.makedirs(f"{d}/Company=CO_X")
    page = {"value": [
        {"Entry_No": 10, "Date_and_Time": "2024-01-01T10:00:00", "User_ID": "ADMIN", "Table_No": 18,
         "Table_Caption": "Customer", "Field_No": None, "Field_Caption": None, "Type_of_Change": "Insertion",
         "Primary_Key": "No.='C1'", "Old_Value": None, "New_Value": "x" * 5},
        {"Entry_No": 11, "Date_and_Time": "2024-01-01T10:00:01", "User_ID": "U" * 200, "Table_No": "",
         "Table_Caption": "T", "Field_No": 3, "Field_Caption": "F", "Type_of_Change": "Modification",
         "Primary_Key": "k", "Old_Value": "a", "New_Value": "b"}]}
    with open(f"{d}/Company=CO_X/p1.json", "w") as fh:
        fh.write(json.dumps(page))
    shaped = L.shape_change_log(L.read_change_pages(spark, d))
    r = {x.EntryNo: x for x in shaped.collect()}
    assert r[10].CompanyName == "CO_X" and r[10].FieldNo == 0 and r[10].FieldName == "" and r[10].OldValue == ""
    assert r[11].TableNo == 0 and r[11].UserId == "U" * 200      # stored in full
    assert r[10].ChangedAt == dt.datetime(2024, 1, 1, 10, 0, 0)


def test_user_field_detection_and_missing_field(spark):
    f = L.detect_user_fields(["Security ID", "Telemetry_User_ID", "User_Name", "Full Name", "Auth Email", "State"])
    assert f == {"UserSecurityId": "Security ID", "TelemetryUserId": "Telemetry_User_ID", "UserName": "User_Name",
                 "FullName": "Full Name", "AuthEmail": "Auth Email", "State": "State"}
    with pytest.raises(ValueError, match="TelemetryUserId"):
        L.detect_user_fields(["Security ID", "User_Name"])


def test_user_directory_rows(spark):
    df = spark.createDataFrame([("{S1}", "{G1} ", "A", "Alice", None, "Enabled"), ("  ", "G2", "B", "Bob", None, None),
                                ("S3", "", "C", None, None, None)],
                               "userSecurityID string, telemetryUserID string, userName string, "
                               "fullName string, authenticationEmail string, state string")
    out = L.read_user_directory(df)
    assert rows(out, "UserSecurityId", "TelemetryUserId") == [("S1", "G1"), ("S3", None)]
    assert rows(out, "UserSecurityId", "FullName", "State") == [("S1", "Alice", "Enabled"), ("S3", "", "")]
    no_state = L.read_user_directory(df.drop("state"))
    assert {r.State for r in no_state.collect()} == {None}


def test_page_map_parse_js_rules(spark):
    lines = spark.createDataFrame([
        (1, "ID\tSourceTable\tName"), (2, "21;18;Customer Card"), (3, " 22 , 27 , Item Card "),
        (4, "-1\t0\tSystem"), (5, "21,36,Sales Header"), (6, "abc;1;x"), (7, "30"), (8, ""),
        (9, "31x;5;"), (10, "\t40\t41\tWide " + "n" * 300)], "LineNo long, value string")
    out = L.parse_page_map(lines)
    got = {r.PageId: (r.TableNo, r.TableName) for r in out.collect()}
    assert got["21"] == (36, "Sales Header")          # last duplicate wins
    assert got["22"] == (27, "Item Card")
    assert got["-1"] == (0, "System")                 # -1 stays distinct from 1
    assert got["31"] == (5, "")                       # numeric prefix, empty name
    assert got["40"][0] == 41 and len(got["40"][1]) == 200
    assert set(got) == {"21", "22", "-1", "31", "40"}


def test_page_map_from_text_file(spark):
    d = tempfile.mkdtemp(prefix="al-pm-")
    with open(f"{d}/map.txt", "w") as fh:
        fh.write("PageID;SourceTable;Name\n21;18;A\n21;19;B\n")
    out = L.parse_page_map(L.read_text_lines(spark, f"{d}/map.txt"))
    assert rows(out) == [("21", 19, "B")]
    empty = spark.createDataFrame([(1, "header only")], "LineNo long, value string")
    with pytest.raises(ValueError):
        L.require_rows(L.parse_page_map(empty), "page map")


def test_run_log_steps(spark):
    lines = spark.createDataFrame([(1, "08:00 modul A exit=0"), (2, "08:01 modul B exit=3"),
                                   (3, "08:02 Import ROLLBACK"), (4, "08:03 modul B exit=0")],
                                  "LineNo long, value string")
    parsed = L.parse_run_log(lines)
    assert rows(parsed.filter(F.col("Step").isNotNull()), "Step", "ExitCode") == [
        ("modul A", 0), ("modul B", 0), ("modul B", 3)]
    assert parsed.filter("Rollback").count() == 1


def test_telemetry_flatten_and_scan(spark):
    df = spark.createDataFrame([
        (dt.datetime(2024, 1, 1, 1), "g1", "WebClient",
         json.dumps({"alObjectId": "21", "alObjectName": "Customer Card", "companyName": "CO"})),
        (dt.datetime(2024, 1, 1, 2), "g2", None, json.dumps({"clientType": "Background", "alObjectId": "22"}))],
        "TimeGenerated timestamp_ntz, UserId string, ClientType string, Properties string")
    views = L.scan_page_views(L.page_view_rows(df), since=dt.datetime(2024, 1, 1, 0, 30))
    assert rows(views, "UserId", "PageId", "PageName") == [("g1", "21", "Customer Card")]
    traces = spark.createDataFrame([
        (dt.datetime(2024, 1, 1, 1), "g1", None,
         json.dumps({"eventId": "RT0031", "permissionType": "Execute", "alObjectType": "TableData",
                     "alObjectId": "18", "companyName": "CO", "errorMessage": "Missing permission"})),
        (dt.datetime(2024, 1, 1, 1), "g1", None, json.dumps({"eventId": "RT0030"}))],
        "TimeGenerated timestamp_ntz, UserId string, ClientType string, Properties string")
    out = L.scan_auth_failures(L.trace_rows(traces))
    assert rows(out, "ObjectId", "ObjectName") == [("Execute · TableData 18", "CO · Missing permission")]


def test_clean_user_map_entries(spark):
    df = spark.createDataFrame([(" g1 ", " Name "), ("g2", "  "), ("g3", "x" * 150)], "UserId string, Name string")
    out = L.clean_user_map(df)
    assert rows(out, "UserId") == [("g1",), ("g3",)]
    assert max(len(r.Name) for r in out.collect()) == 120


def test_failing_rename_keeps_the_stored_partition(spark, tmp_path, monkeypatch):
    from auditlake.sources import sinks as SK
    table, staged = f"{tmp_path}/t", f"{tmp_path}/s"
    spark.range(5).selectExpr("id", "1 as p").write.partitionBy("p").parquet(table)
    spark.range(9).selectExpr("id", "1 as p").write.partitionBy("p").parquet(staged)
    real, calls = SK._rename, []

    def second_fails(fs, a, b):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("rename failed")
        real(fs, a, b)
    monkeypatch.setattr(SK, "_rename", second_fails)
    with pytest.raises(OSError):
        SK.swap_partitions(spark, table, staged, ["p=1"])
    monkeypatch.undo()
    SK.recover_table(spark, table)
    assert spark.read.parquet(table).count() == 5
