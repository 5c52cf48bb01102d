import datetime as dt

from pyspark.sql import functions as F

from auditlake.functions import columns as C
from conftest import rows


def test_auth_labels_follow_kql_coalesce(spark):
    df = spark.createDataFrame([
        ("Execute", "TableData", "18", "Customer", "CO_1", "You do not have permission"),
        ("", "", "0", "", "", ""),
        (None, "System", "", "Item", None, None),
    ], "p string, o string, i string, n string, c string, e string")
    out = df.select(C.auth_object_id("p", "o", "i", "n").alias("oid"),
                    C.auth_object_name("c", "e", "n").alias("oname"))
    assert rows(out) == sorted([
        ("Execute · TableData 18 Customer", "CO_1 · You do not have permission"),
        ("? · ?", None),
        ("? · System Item", "Item"),
    ], key=repr)


def test_labels_are_kept_in_full(spark):
    df = spark.createDataFrame([("x" * 80, "y" * 300)], "n string, e string")
    r = df.select(C.auth_object_id(F.lit("Read"), F.lit("Page"), F.lit("7"), "n").alias("a"),
                  C.auth_object_name(F.lit("CO"), "e", "n").alias("b")).first()
    assert r.a == "Read · Page 7 " + "x" * 80 and r.b == "CO · " + "y" * 300


def test_errors_that_differ_late_in_the_label_stay_apart(spark):
    from auditlake.operators import dedup as D
    from auditlake.operators import views as V
    t = dt.datetime(2024, 1, 5)
    labels = [(t, "u", "L" * 60 + end, "text") for end in "ab"]
    df = spark.createDataFrame(labels, "Timestamp timestamp_ntz, UserId string, ObjectId string, ObjectName string")
    assert D.dedup_batch(df, D.auth_key()).count() == 2
    daily = df.select(F.to_date("Timestamp").alias("DateKey"), F.col("UserId").alias("UserName"), "ObjectId",
                      "ObjectName", F.lit(1).alias("Failures"))
    assert rows(V.top_auth_failures(daily), "ObjectId") == [("L" * 50,)] * 2     # cut in the display only


def test_display_name_and_guid_cleaning(spark):
    df = spark.createDataFrame([(" {ABC} ", "  ", " login ", "g1"), ("x", "Full", "u", "g2"),
                                ("y", None, "", "g3")], "guid string, full string, user string, tel string")
    out = df.select(C.clean_guid("guid").alias("g"), C.display_name("full", "user", "tel").alias("n"))
    assert rows(out) == sorted([("ABC", "login"), ("x", "Full"), ("y", "g3")], key=repr)


def test_name_or_key_keeps_untrimmed_blank_name(spark):
    df = spark.createDataFrame([("  ", "k1"), ("", "k2"), (None, "k3")], "n string, k string")
    assert rows(df.select(C.name_or_key("n", "k").alias("x"))) == [("  ",), ("k2",), ("k3",)]


def test_error_class_and_table_number(spark):
    df = spark.createDataFrame([("CO · The licence does not include TableData 5404718",),
                                ("CO · Nemáte následující práva: Spustit tabulku",),
                                ("Something else, Table 18",), (None,)], "m string")
    out = df.select(C.error_class("m").alias("c"), C.error_table_no("m").alias("t"))
    assert rows(out) == sorted([("LICENCE", 5404718), ("MISSING_ROLE", None), ("OTHER", 18),
                                ("OTHER", None)], key=repr)


def test_pct_half_even_and_zero_cloud(spark):
    df = spark.createDataFrame([(1, 8), (5, 0), (0, 0), (3, 600)], "l long, c long")
    out = df.select(C.pct_half_even("l", "c").alias("p"))
    # 12.5 -> 12 (half to even), 0/0 -> 0, local>0 with cloud 0 -> 100, 0.5 -> 0
    assert [r.p for r in out.collect()] == [12, 100, 0, 0]


def test_text_formats(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678000), dt.date(2024, 1, 2))],
                               "t timestamp_ntz, d date")
    r = df.select(C.ts_text("t").alias("a"), C.date_text("d").alias("b")).first()
    assert (r.a, r.b) == ("2024-01-02 03:04:05", "2024-01-02")
