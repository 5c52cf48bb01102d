import datetime as dt

from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.operators import rollup as R
from auditlake.sources import landing as L
from conftest import rows

T0 = dt.datetime(2024, 1, 5, 10, 0, 0)
T1 = dt.datetime(2024, 1, 5, 11, 0, 0)
FEED = "Id long, Timestamp timestamp_ntz, UserId string, UserName string, PageId string, PageName string, " \
       "CompanyName string, ClientType string"


def feed(spark, data):
    return spark.createDataFrame(data, FEED)


def test_in_batch_duplicates_with_different_companies_keep_one(spark):
    # CompanyName is not part of the key: two deliveries of one view collapse
    f = feed(spark, [(1, T0, "u", "u", "21", "Customer", "CO_A", "WebClient"),
                     (2, T0, "u", "u", "21", "Customer", "CO_B", "WebClient")])
    out = D.dedup_batch(L.scan_page_views(f), D.page_key(), order=["Id"])
    assert rows(out, "Id", "CompanyName") == [(1, "CO_A")]


def test_null_and_empty_page_id_collide_and_roll_up_as_question_mark(spark):
    f = feed(spark, [(1, T0, "u", "u", None, "x", "CO", "Desktop"),
                     (2, T0, "u", "u", "", "x", "CO", "Desktop"),
                     (3, T1, "u", "u", "", "y", "CO", "Phone")])
    raw = D.dedup_batch(L.scan_page_views(f), D.page_key(), order=["Id"])
    assert raw.count() == 2
    daily = R.daily_page_rollup(raw)
    assert rows(daily, "PageId", "Hits", "PageName") == [("?", 2, "y")]


def test_background_clients_are_dropped_case_sensitively(spark):
    f = feed(spark, [(1, T0, "u", "u", "1", "a", "CO", "Background"),
                     (2, T0, "u", "u", "2", "a", "CO", "webclient"),
                     (3, T0, "u", "u", "3", "a", "CO", "Web")])
    assert rows(L.scan_page_views(f), "Id") == [(3,)]


def test_empty_user_id_goes_to_quarantine(spark):
    f = feed(spark, [(1, T0, "", "u", "1", "a", "CO", "Web"), (2, T0, None, "u", "1", "a", "CO", "Web"),
                     (3, T0, "ok", "u", "1", "a", "CO", "Web")])
    good, bad = L.split_quarantine(L.scan_page_views(f), ["UserId"])
    assert rows(good, "Id") == [(3,)]
    assert rows(bad, "Id") == [(1,), (2,)]


def test_two_names_for_one_page_use_max_not_group_key(spark):
    f = feed(spark, [(1, T0, "u", "u", "-1", "Sys A", "CO", "Web"),
                     (2, T1, "u", "u", "-1", "Sys B", "CO", "Web")])
    daily = R.daily_page_rollup(L.scan_page_views(f))
    assert rows(daily, "PageId", "PageName", "Hits") == [("-1", "Sys B", 2)]


def test_additive_merge_takes_newest_batch_name_even_null(spark):
    raw1 = L.scan_page_views(feed(spark, [(1, T0, "u", "u", "7", "Old", "CO", "Web")]))
    raw2 = L.scan_page_views(feed(spark, [(2, T1, "u", "u", "7", None, "CO", "Web")]))
    merged = R.merge_daily(R.daily_delta(raw1, 10).unionByName(R.daily_delta(raw2, 11)))
    assert rows(merged, "Hits", "PageName") == [(2, None)]


def test_rerun_of_a_batch_does_not_double_count(spark):
    # the delta ledger replaces a batch's delta instead of adding to Hits
    raw = L.scan_page_views(feed(spark, [(1, T0, "u", "u", "7", "P", "CO", "Web")]))
    d = R.daily_delta(raw, 5)
    ledger = d.unionByName(d).dropDuplicates(["BatchId", "DateKey", "UserName", "PageId", "CompanyName"])
    assert rows(R.merge_daily(ledger), "Hits") == [(1,)]


def test_insert_if_absent_against_history(spark):
    hist = L.scan_page_views(feed(spark, [(1, T0, "u", "u", None, "a", "CO", "Web")]))
    batch = L.scan_page_views(feed(spark, [(5, T0, "u", "u", "", "a", "CO", "Web"),
                                           (6, T1, "u", "u", "9", "b", "CO", "Web")]))
    new = D.insert_if_absent(batch, hist, D.page_key(), order=["Id"], prune_col="Timestamp")
    assert rows(new, "Id") == [(6,)]


def test_auth_upsert_refreshes_name_last_delivery_wins(spark):
    cols = "Id long, Timestamp timestamp_ntz, UserId string, ObjectId string, ObjectName string"
    target = spark.createDataFrame([(0, T0, "g", "Read · Page", "old"), (0, T0, "g", None, "keep")], cols).drop("Id")
    batch = spark.createDataFrame([(1, T0, "g", "Read · Page", "first"), (2, T0, "g", "Read · Page", "second"),
                                   (3, T1, "g", "X", "new")], cols)
    out = D.upsert_auth_failures(target, batch, order=["Id"])
    assert rows(out, "ObjectId", "ObjectName") == sorted(
        [(None, "keep"), ("Read · Page", "second"), ("X", "new")], key=repr)


def test_user_upsert_overwrites_including_nulls_and_keeps_absent(spark):
    cols = "UserSecurityId string, TelemetryUserId string, UserName string, FullName string, " \
           "AuthEmail string, State string, UpdatedAt timestamp_ntz"
    target = spark.createDataFrame([("s1", "g1", "A", "Alice", None, "Enabled", T0),
                                    ("s2", "g2", "B", "Bob", None, "Enabled", T0)], cols)
    batch = spark.createDataFrame([("s1", "g1", "A", None, None, "Disabled"), ("s3", None, "C", "Cy", None, None)],
                                  "UserSecurityId string, TelemetryUserId string, UserName string, "
                                  "FullName string, AuthEmail string, State string")
    out = D.upsert_users(target, batch, T1)
    assert rows(out, "UserSecurityId", "FullName", "State", "UpdatedAt") == [
        ("s1", None, "Disabled", T1), ("s2", "Bob", "Enabled", T0), ("s3", "Cy", None, T1)]


def test_auth_daily_merge_never_removes_rows(spark):
    cols = "DateKey date, UserName string, ObjectId string, ObjectName string, Failures long"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    existing = spark.createDataFrame([(d1, "g", "o", "n", 3), (d2, "g", "o", "n", 1)], cols)
    recomputed = spark.createDataFrame([(d2, "g", "o", "n2", 4)], cols)
    out = R.merge_auth_daily(existing, recomputed)
    assert rows(out, "DateKey", "Failures", "ObjectName") == [(d1, 3, "n"), (d2, 4, "n2")]


def test_daily_hits_equal_deduplicated_raw_rows(spark):
    from auditlake.plans import tables as TB
    sf = "/root/testdata/sf0.001"
    raw = TB.page_log(spark, sf)
    total = TB.page_daily(spark, sf).agg(F.sum("Hits")).first()[0]
    assert total == raw.filter(F.col("UserName").isNotNull()).count()


def test_split_in_batches_equals_one_batch(spark):
    from auditlake.plans import tables as TB
    sf = "/root/testdata/sf0.001"
    raw = TB.page_log(spark, sf)
    one = R.merge_daily(R.daily_delta(raw, 1))
    cut = dt.datetime(2024, 1, 15)
    # one name per page and day in both splits: compare counts only
    two = R.merge_daily(R.daily_delta(raw.filter(F.col("Timestamp") < cut), 1)
                        .unionByName(R.daily_delta(raw.filter(F.col("Timestamp") >= cut), 2)))
    keys = ["DateKey", "UserName", "PageId", "CompanyName", "Hits"]
    assert rows(one, *keys) == rows(two, *keys)
