"""Module A queries: page-view feed, raw log, daily rollup and dashboard views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.operators import increments as I
from auditlake.operators import rollup as R
from auditlake.operators import views as V
from auditlake.plans import tables as TB
from auditlake.plans.oracle_ctes import extra
from auditlake.plans.registry import query, sql
from auditlake.sources import fixtures as X
from auditlake.sources import landing as L

# Fixed scenario parameters (whole tables are always read; these only split
# them into "already stored" and "newly delivered" parts).
HISTORY_END = dt.datetime(2024, 1, 15)          # stored part of the raw log
REDELIVERY_FROM = dt.datetime(2024, 1, 10)      # a re-pull overlapping stored data
INSERT_HISTORY_END = dt.datetime(2024, 1, 20)
BATCH_SPLIT = dt.datetime(2024, 1, 15, 12, 0, 0)  # two ingest batches meeting mid-day

RAW_COLS = '"Timestamp", UserId, UserName, PageId, PageName, CompanyName'


@query("interactive_page_views", "S1 P1 P2 P5 I1", sql(f"""
SELECT Id, {RAW_COLS} FROM interactive
WHERE "Timestamp" > (SELECT COALESCE(MAX("Timestamp"), TIMESTAMP '2000-01-01')
                     FROM page_log WHERE "Timestamp" < TIMESTAMP '2024-01-15 00:00:00')
""", "interactive", "page_log"))
def interactive_page_views(spark, sf_dir):
    """New interactive page views after the stored high watermark: the largest stored time, which is that
    of the rows before deduplication, as the time is part of the key."""
    feed = X.page_views(spark, sf_dir).filter(F.col("Timestamp") < F.lit(HISTORY_END))
    wm = I.high_watermark(L.split_quarantine(L.scan_page_views(feed), L.PAGE_REQUIRED)[0], "Timestamp")
    return L.scan_page_views(X.page_views(spark, sf_dir, after=wm), since=wm)


extra("redelivered_log", ("page_views",), f"""
SELECT Id, {RAW_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, COALESCE(PageId, '') ORDER BY Id) AS rn
  FROM (SELECT Id, "Timestamp", UserId, NULLIF(UserName, '') AS UserName, NULLIF(PageId, '') AS PageId,
               NULLIF(PageName, '') AS PageName, NULLIF(CompanyName, '') AS CompanyName
        FROM (SELECT * FROM page_views UNION ALL SELECT * FROM page_views) u
        WHERE ClientType IN ('WebClient', 'Web', 'Desktop', 'Tablet', 'Phone')) c
  WHERE UserId IS NOT NULL AND trim(UserId) <> '') t
WHERE rn = 1""")


@query("page_views_dedup", "D1 W1 P5", sql("SELECT * FROM redelivered_log", "redelivered_log"))
def page_views_dedup(spark, sf_dir):
    """A feed delivered twice collapses to one row per (Timestamp, UserId, PageId)."""
    feed = X.page_views(spark, sf_dir)
    batch = L.scan_page_views(feed.unionByName(feed))
    good, _ = L.split_quarantine(batch, L.PAGE_REQUIRED)
    return D.dedup_batch(good, D.page_key(), order=["Id"])


@query("page_views_insert_if_absent", "D2 J2", sql(f"""
SELECT Id, {RAW_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, COALESCE(PageId, '') ORDER BY Id) AS rn
  FROM interactive WHERE "Timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
    AND UserId IS NOT NULL AND trim(UserId) <> '') b
WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM page_log h
  WHERE h."Timestamp" < TIMESTAMP '2024-01-20 00:00:00' AND h."Timestamp" = b."Timestamp"
    AND h.UserId = b.UserId AND COALESCE(h.PageId, '') = COALESCE(b.PageId, ''))
""", "interactive", "page_log"))
def page_views_insert_if_absent(spark, sf_dir):
    """A re-pull overlapping stored rows inserts only the rows not stored yet."""
    history = TB.page_log(spark, sf_dir).filter(F.col("Timestamp") < F.lit(INSERT_HISTORY_END))
    batch = TB.interactive_views(spark, sf_dir).filter(F.col("Timestamp") >= F.lit(REDELIVERY_FROM))
    good, _ = L.split_quarantine(batch, L.PAGE_REQUIRED)
    return D.insert_if_absent(good, history, D.page_key(), order=["Id"], prune_col="Timestamp")


@query("page_activity", "A1", sql("""
SELECT UserName, PageId, PageName, CompanyName, COUNT(*) AS Opens,
       MIN("Timestamp") AS FirstOpen, MAX("Timestamp") AS LastOpen
FROM page_log GROUP BY UserName, PageId, PageName, CompanyName""", "page_log"))
def page_activity(spark, sf_dir):
    return V.page_activity(TB.page_log(spark, sf_dir))


@query("daily_page_rollup", "A2 P8 I3", sql("SELECT * FROM page_daily", "page_daily"))
def daily_page_rollup(spark, sf_dir):
    return TB.page_daily(spark, sf_dir)


extra("daily_deltas", ("page_log",), """
SELECT DISTINCT BatchId, DateKey, UserName, PageId, MAX(PageName) OVER cell AS PageName, CompanyName, COUNT(*) OVER cell AS Hits
FROM (SELECT 1 + ("Timestamp" >= TIMESTAMP '2024-01-15 12:00:00')::INT AS BatchId, date_trunc('day', "Timestamp")::DATE AS DateKey,
             UserName, ifnull(PageId, '?') AS PageId, PageName, ifnull(CompanyName, '?') AS CompanyName
      FROM page_log WHERE UserName IS NOT NULL) r
WINDOW cell AS (PARTITION BY BatchId, DateKey, UserName, PageId, CompanyName)""")


@query("daily_rollup_merge", "D6 I10", sql("""
SELECT m.DateKey, m.UserName, m.PageId, d.PageName, m.CompanyName, CAST(m.Hits AS BIGINT) AS Hits
FROM (SELECT DateKey, UserName, PageId, CompanyName, SUM(Hits) AS Hits, MAX(BatchId) AS NewestBatch
      FROM daily_deltas GROUP BY DateKey, UserName, PageId, CompanyName) m
JOIN daily_deltas d ON d.DateKey = m.DateKey AND d.UserName = m.UserName AND d.PageId = m.PageId
 AND d.CompanyName = m.CompanyName AND d.BatchId = m.NewestBatch""", "daily_deltas"))
def daily_rollup_merge(spark, sf_dir):
    """Two ingest batches meeting mid-day: hits add up, the newest batch names the page."""
    raw = TB.page_log(spark, sf_dir)
    first = R.daily_delta(raw.filter(F.col("Timestamp") < F.lit(BATCH_SPLIT)), 1)
    second = R.daily_delta(raw.filter(F.col("Timestamp") >= F.lit(BATCH_SPLIT)), 2)
    return R.merge_daily(first.unionByName(second))


@query("kpi", "A4 P10", sql("SELECT * FROM kpi_row", "kpi_row"))
def kpi(spark, sf_dir):
    return V.kpi(TB.page_daily(spark, sf_dir), TB.auth_fail_daily(spark, sf_dir), TB.AS_OF_PAGES)


ACTIVITY_SQL = """
SELECT UserName, PageId, PageName, CompanyName, CAST(SUM(Hits) AS BIGINT) AS TotalHits, MAX(DateKey) AS LastUsed
FROM page_daily GROUP BY UserName, PageId, PageName, CompanyName"""


@query("user_activity", "A5", sql(ACTIVITY_SQL, "page_daily"))
def user_activity(spark, sf_dir):
    return V.user_activity(TB.page_daily(spark, sf_dir))


@query("trim_candidates", "A6 M5", sql(ACTIVITY_SQL + " HAVING SUM(Hits) <= 2", "page_daily"))
def trim_candidates(spark, sf_dir):
    return V.trim_candidates(TB.page_daily(spark, sf_dir))


@query("trend", "A7 T8", sql("""
SELECT DateKey, CAST(SUM(Hits) AS BIGINT) AS Hits, COUNT(DISTINCT UserName) AS Users
FROM page_daily GROUP BY DateKey""", "page_daily"))
def trend(spark, sf_dir):
    return V.trend(TB.page_daily(spark, sf_dir)).orderBy("DateKey")


@query("trend_by_company", "A8 T8", sql("""
SELECT DateKey, CompanyName, CAST(SUM(Hits) AS BIGINT) AS Hits, COUNT(DISTINCT UserName) AS Users
FROM page_daily GROUP BY DateKey, CompanyName""", "page_daily"))
def trend_by_company(spark, sf_dir):
    return V.trend_by_company(TB.page_daily(spark, sf_dir)).orderBy("DateKey", "CompanyName")


extra("trend_cum", ("page_daily",), """
SELECT DateKey, Hits, Users, CAST(SUM(Hits) OVER (ORDER BY DateKey ROWS BETWEEN UNBOUNDED PRECEDING
       AND CURRENT ROW) AS BIGINT) AS CumHits
FROM (SELECT DateKey, CAST(SUM(Hits) AS BIGINT) AS Hits, COUNT(DISTINCT UserName) AS Users
      FROM page_daily GROUP BY DateKey) t""")


@query("trend_cumulative", "W3", sql("SELECT * FROM trend_cum", "trend_cum"))
def trend_cumulative(spark, sf_dir):
    return V.trend_cumulative(TB.page_daily(spark, sf_dir))


@query("trend_cumulative_by_company", "W3 A8", sql("""
SELECT DateKey, CompanyName, Hits, Users,
       CAST(SUM(Hits) OVER (PARTITION BY CompanyName ORDER BY DateKey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS CumHits
FROM (SELECT DateKey, CompanyName, CAST(SUM(Hits) AS BIGINT) AS Hits, COUNT(DISTINCT UserName) AS Users
      FROM page_daily GROUP BY DateKey, CompanyName) t""", "page_daily"))
def trend_cumulative_by_company(spark, sf_dir):
    return V.trend_cumulative(TB.page_daily(spark, sf_dir), by_company=True)


@query("trend_last_10", "T6 W3", sql("SELECT * FROM trend_cum ORDER BY DateKey DESC LIMIT 10", "trend_cum"))
def trend_last_10(spark, sf_dir):
    return V.trend_last(TB.page_daily(spark, sf_dir), 10)


@query("user_activity_last_seen", "J1 A13 T1 P16", sql("""
SELECT UserName, PageId, PageName, CompanyName, CAST(SUM(Hits) AS BIGINT) AS TotalHits,
       strftime(COALESCE(any_value(seen), MAX(DateKey)::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS LastUsed
FROM (SELECT *, MAX(opened) OVER (PARTITION BY UserName, PageId, CompanyName) AS seen
      FROM (SELECT UserName, PageId, CompanyName, PageName, Hits, DateKey, NULL::TIMESTAMP AS opened FROM page_daily
            UNION ALL SELECT UserName, ifnull(PageId, '?'), ifnull(CompanyName, '?'), NULL, NULL, NULL, "Timestamp"
                      FROM page_log) facts) w
WHERE opened IS NULL
GROUP BY ALL
ORDER BY TotalHits DESC, UserName NULLS FIRST, PageId NULLS FIRST, PageName NULLS FIRST, CompanyName NULLS FIRST
LIMIT 5000""", "page_daily", "page_log"))
def user_activity_last_seen(spark, sf_dir):
    return V.top_activity(TB.page_daily(spark, sf_dir), TB.page_log(spark, sf_dir), V.TOP_ROWS_DEFAULT)
