"""Permission mining: table access (writes + reads), role proposal, error classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions.joins import bounded_broadcast, materialized
from auditlake.operators.identity import by_guid, by_login, resolve_names
from auditlake.operators.views import top_n

ACCESS_COLS = ["UserName", "TableNo", "TableName", "CompanyName", "Changes", "Ins", "Mod", "Del",
               "Reads", "Pages", "Access", "LastUsed"]


def table_writes(change_log: DataFrame) -> DataFrame:
    """Writes per login x table x company with per-type counts (a
    conditional pivot done as ``count_if`` in one aggregate)."""
    t = F.col("ChangeType")
    return change_log.groupBy("UserId", "TableNo", "CompanyName").agg(
        F.max("TableName").alias("TableName"),
        F.count(F.lit(1)).alias("Changes"),
        F.count_if(t == "Insertion").alias("Ins"),
        F.count_if(t == "Modification").alias("Mod"),
        F.count_if(t == "Deletion").alias("Del"),
        C.ts_text(F.max("ChangedAt")).alias("LastAt"))


def page_reads(daily: DataFrame, pages: DataFrame) -> DataFrame:
    """A12 step 1 + J3: per GUID x page x company hits, mapped to the page's
    source table. Exact match on the trimmed page id (``-1`` must not match
    ``1``); unmapped pages drop out. The page map is broadcast after a size
    check."""
    return mapped_pages(daily.groupBy("UserName", "PageId", "CompanyName").agg(
        F.sum("Hits").cast("long").alias("Hits"), F.max("DateKey").alias("LastDay")), pages)


def mapped_pages(per_page: DataFrame, pages: DataFrame) -> DataFrame:
    """Per-page rows with their source table."""
    pm = bounded_broadcast(pages.select(F.col("PageId").alias("_pid"), "TableNo",
                                        F.col("TableName").alias("MapName")))
    return (per_page.filter(F.trim("PageId") != "")
            .join(pm, F.trim(per_page["PageId"]) == F.col("_pid"), "inner").drop("_pid"))


def table_reads(daily: DataFrame, pages: DataFrame, users: DataFrame) -> DataFrame:
    """Reads per person x table x company: hits, contributing
    (user, page) rows, last day."""
    return person_reads(resolve_names(page_reads(daily, pages), "UserName", by_guid(users), "GuidKey"))


def person_reads(named: DataFrame) -> DataFrame:
    return named.groupBy(F.col("Person").alias("UserName"), "TableNo", "CompanyName").agg(
        F.max("MapName").alias("TableName"),
        F.sum("Hits").cast("long").alias("Reads"),
        F.count(F.lit(1)).alias("Pages"),
        C.date_text(F.max("LastDay")).alias("LastRead"))


def table_access(change_log: DataFrame, daily: DataFrame, pages: DataFrame,
                 users: DataFrame) -> DataFrame:
    """M1 (J6): writes and reads merged per person x table x company.

    The "full outer merge" is ``unionByName`` of both sides followed by one
    ``groupBy`` -- one shuffle, partial aggregation on both inputs. Writes use
    the login -> name lookup, reads the GUID -> name lookup, so one person is
    one row. ``Access`` = RW / W / R; ``LastUsed`` = the later of the last
    write (with time) and the last read (date), compared as text like the
    reference (a same-day write sorts after the read's bare date).
    """
    return merge_access(resolve_names(table_writes(change_log), "UserId", by_login(users), "LoginKey"),
                        table_reads(daily, pages, users))


def merge_access(w: DataFrame, r: DataFrame) -> DataFrame:
    """Writes (``table_writes`` with ``Person``) and reads (``table_reads``) as one row per person x table x company."""
    writes = w.select(F.col("Person").alias("UserName"), "TableNo", "CompanyName",
                      F.col("TableName").alias("WName"), F.lit(None).cast("string").alias("RName"),
                      "Changes", "Ins", "Mod", "Del",
                      F.lit(0).cast("long").alias("Reads"), F.lit(0).cast("long").alias("Pages"),
                      F.col("LastAt").alias("LastW"), F.lit(None).cast("string").alias("LastR"))
    reads = r.select("UserName", "TableNo", "CompanyName",
                     F.lit(None).cast("string").alias("WName"), F.col("TableName").alias("RName"),
                     *[F.lit(0).cast("long").alias(c) for c in ("Changes", "Ins", "Mod", "Del")],
                     "Reads", "Pages", F.lit(None).cast("string").alias("LastW"),
                     F.col("LastRead").alias("LastR"))
    merged = writes.unionByName(reads).groupBy("UserName", "TableNo", "CompanyName").agg(
        F.max("WName").alias("WName"), F.max("RName").alias("RName"),
        *[F.sum(c).cast("long").alias(c) for c in ("Changes", "Ins", "Mod", "Del", "Reads", "Pages")],
        F.max("LastW").alias("LastW"), F.max("LastR").alias("LastR"))
    access = (F.when((F.col("Changes") > 0) & (F.col("Reads") > 0), "RW")
              .when(F.col("Changes") > 0, "W").otherwise("R"))
    return merged.select(
        "UserName", "TableNo",
        F.coalesce(F.nullif(F.col("WName"), F.lit("")), F.col("RName"), F.col("WName")).alias("TableName"),
        "CompanyName", "Changes", "Ins", "Mod", "Del", "Reads", "Pages", access.alias("Access"),
        F.greatest(F.coalesce("LastW", F.lit("")), F.coalesce("LastR", F.lit(""))).alias("LastUsed"))


def top_table_access(access: DataFrame, n: int) -> DataFrame:
    """T4: busiest rows by ``Changes + Reads`` (key columns break ties)."""
    return top_n(access, [(F.col("Changes") + F.col("Reads")).desc(), F.col("UserName").asc_nulls_first(),
                          F.col("TableNo").asc_nulls_first(), F.col("CompanyName").asc_nulls_first()], n)


# Fixed value: the system page that never becomes a permission.
EXCLUDED_PAGE = "-1"


def people_keys(people: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen people as (Key, Person) of their logins and of their GUIDs.

    This turns J4 round: a key belongs to a chosen person if the directory names it so, or if the
    person is the key itself, one that the directory has no name for. Facts joined with these keys are
    filtered and named at once, before anything is aggregated.
    """
    directory = materialized(users.select("UserSecurityId", "UserName", "TelemetryUserId", "FullName"))
    chosen = bounded_broadcast(people.select("Person").distinct(), materialize=True)

    def keys(lookup: DataFrame, key: str) -> DataFrame:
        named = lookup.filter(F.col("FullName") != "")
        by_name = named.join(chosen, named["FullName"] == chosen["Person"]).select(F.col(key).alias("Key"), "Person")
        own = chosen.join(named, chosen["Person"] == named[key], "left_anti").select(F.col("Person").alias("Key"), "Person")
        return bounded_broadcast(by_name.unionByName(own), materialize=True)

    return keys(by_login(directory), "LoginKey"), keys(by_guid(directory), "GuidKey")


def role_proposal(change_log: DataFrame, daily: DataFrame, pages: DataFrame, people: DataFrame, users: DataFrame,
                  company: str | None = None, min_ops: int = 0) -> DataFrame:
    """M2 + P14: least-privilege permission set for the chosen people (one ``Person`` column).

    Tables: ``R`` when read or written, plus ``I``/``M``/``D`` when the audit
    saw insertions / modifications / deletions. Pages: ``X`` (execute) for
    every page the people opened, except page ``-1``. ``company`` limits the
    source to one company; objects touched fewer than ``min_ops`` times drop.
    The people's keys (a directory's rows, size-checked broadcasts) filter both fact tables right after the
    scan; the opened pages are aggregated once, for the tables behind them and for themselves.
    """
    logins, guids = people_keys(people, users)
    if company is not None:
        change_log, daily = (d.filter(F.col("CompanyName") == company) for d in (change_log, daily))
    writes = table_writes(change_log.join(logins.select("Key"), F.col("UserId") == F.col("Key"), "left_semi")) \
        .join(logins, F.col("UserId") == F.col("Key")).drop("Key")
    opened = materialized(daily.join(guids.select("Key"), F.col("UserName") == F.col("Key"), "left_semi")
                          .groupBy("UserName", "PageId", "CompanyName").agg(
        F.sum("Hits").cast("long").alias("Hits"), F.max("DateKey").alias("LastDay"), F.max("PageName").alias("PageName")))
    named = mapped_pages(opened.drop("PageName"), pages).join(guids, F.col("UserName") == F.col("Key")).drop("Key")
    tables = merge_access(writes, person_reads(named)).groupBy("TableNo").agg(
        F.max("TableName").alias("ObjectName"),
        *[F.sum(c).cast("long").alias(c) for c in ("Changes", "Ins", "Mod", "Del", "Reads")])
    tables = tables.filter(F.col("Changes") + F.col("Reads") >= min_ops)
    rights = F.concat(F.when((F.col("Reads") > 0) | (F.col("Changes") > 0), "R").otherwise(""),
                      F.when(F.col("Ins") > 0, "I").otherwise(""),
                      F.when(F.col("Mod") > 0, "M").otherwise(""),
                      F.when(F.col("Del") > 0, "D").otherwise(""))
    table_rows = tables.select(F.lit("TableData").alias("ObjectType"),
                               F.col("TableNo").cast("string").alias("ObjectId"), "ObjectName",
                               rights.alias("Rights"),
                               (F.col("Changes") + F.col("Reads")).alias("Operations"))
    page_rows = (opened.filter(F.col("PageId") != EXCLUDED_PAGE)
                 .groupBy("PageId").agg(F.max("PageName").alias("ObjectName"), F.sum("Hits").cast("long").alias("Operations"))
                 .filter(F.col("Operations") >= min_ops)
                 .select(F.lit("Page").alias("ObjectType"), F.col("PageId").alias("ObjectId"),
                         "ObjectName", F.lit("X").alias("Rights"), "Operations"))
    return table_rows.unionByName(page_rows)


# Object numbers whose lines are put together in one group of ``role_text``.
TEXT_RANGE = 1000


def role_text(role: DataFrame, role_name: str) -> DataFrame:
    """M3: the permission set rendered as text, one row per role.

    Lines are ``<ObjectType> <ObjectId> = <Rights>`` sorted by type and id
    (numeric ids sort numerically, others before them by text). The lines of a range of objects are sorted and joined
    in a group of their own; the last step only strings the ranges' texts together in order.
    """
    number = F.col("ObjectId").try_cast("long")
    span = F.struct(F.col("ObjectType").alias("t"), F.floor(number / F.lit(TEXT_RANGE)).alias("n"),
                    F.when(number.isNull(), F.left("ObjectId", F.lit(2))).alias("p"))
    key = F.struct(number.alias("n"), F.col("ObjectId").alias("i"))
    line = F.concat_ws(" ", F.col("ObjectType"), F.col("ObjectId"), F.lit("="), F.col("Rights"))

    def joined(of: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["text"]), "\n")

    ranges = role.select(span.alias("span"), F.struct(key.alias("key"), line.alias("text")).alias("line")) \
        .groupBy("span").agg(joined("line").alias("text"), F.count(F.lit(1)).alias("n")) \
        .select(F.struct("span", "text").alias("part"), "n")
    return ranges.agg(F.lit(role_name).alias("RoleName"), F.coalesce(F.sum("n"), F.lit(0)).alias("Objects"),
                      joined("part").alias("PermissionSet"))


def table_names(change_log: DataFrame, pages: DataFrame) -> DataFrame:
    """J9 source: one name per table number from the audit and the page map."""
    return (change_log.select("TableNo", "TableName")
            .unionByName(pages.select("TableNo", "TableName"))
            .groupBy("TableNo").agg(F.max("TableName").alias("TableName")))


def merge_table_names(known: DataFrame, new: DataFrame) -> DataFrame:
    """J9, kept up to date: the names stored so far and those of newly stored rows, one per table."""
    return known.select("TableNo", "TableName").unionByName(new.select("TableNo", "TableName")) \
        .groupBy("TableNo").agg(F.max("TableName").alias("TableName"))


def classify_errors(auth_daily: DataFrame, names: DataFrame) -> DataFrame:
    """M4 + J9: error class and the table quoted in the message, named from
    known tables; a quoted but unknown table reads ``(?)``."""
    cls = auth_daily.select("*", C.error_class("ObjectName").alias("ErrorClass"),
                            C.error_table_no("ObjectName").alias("TableNo"))
    nm = bounded_broadcast(names.withColumnRenamed("TableNo", "_tno").withColumnRenamed("TableName", "_tname"),
                           materialize=True)
    j = cls.join(nm, cls["TableNo"] == F.col("_tno"), "left")
    return j.withColumn("TableName", F.when(F.col("TableNo").isNull(), F.lit(None).cast("string"))
                        .otherwise(F.coalesce(F.col("_tname"), F.lit(C.UNKNOWN_TABLE_NAME)))) \
        .drop("_tno", "_tname")
