"""Identity: user map (GUID -> name), name lookups, overlays, user cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions.joins import bounded_broadcast, keep_one


def user_map(users: DataFrame) -> DataFrame:
    """Telemetry GUID -> best display name.

    Users without a telemetry id, with a blank one or with the all-zero GUID
    are excluded.
    """
    tel = F.col("TelemetryUserId")
    return (users.filter(tel.isNotNull() & (F.trim(tel) != "") & (tel != C.ZERO_GUID))
            .select(tel.alias("UserId"),
                    C.display_name("FullName", "UserName", "TelemetryUserId").alias("Name")))


def _lookup(users: DataFrame, key_col: str, key_name: str) -> DataFrame:
    """One ``FullName`` per key; duplicate keys: the last user (greatest
    ``UserSecurityId``) wins. FullName is untrimmed, NULL renders as ''."""
    rows = (users.filter(F.coalesce(F.col(key_col), F.lit("")) != "")
            .select(F.col(key_col).alias(key_name), F.coalesce("FullName", F.lit("")).alias("FullName"),
                    "UserSecurityId"))
    return keep_one(rows, [F.col(key_name)], [F.col("UserSecurityId")], last=True) \
        .select(key_name, "FullName")


def by_login(users: DataFrame) -> DataFrame:
    """Login -> FullName (audit identities)."""
    return _lookup(users, "UserName", "LoginKey")


def by_guid(users: DataFrame) -> DataFrame:
    """Telemetry GUID -> FullName (page-view / error identities)."""
    return _lookup(users, "TelemetryUserId", "GuidKey")


def resolve_names(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str,
                  out: str = "Person") -> DataFrame:
    """Add ``out`` = the key's full name when non-empty, else the key.

    The lookup holds one row per user (a directory, size-checked before it
    is broadcast), so the fact side is never shuffled for this join.
    """
    lk = bounded_broadcast(lookup.withColumnRenamed(lookup_key, "_lk"))
    j = df.join(lk, df[key] == lk["_lk"], "left")
    return j.withColumn(out, C.name_or_key(F.col("FullName"), F.col(key))).drop("_lk", "FullName")


def enrich_with_user_map(df: DataFrame, key: str, umap: DataFrame, out: str = "Name") -> DataFrame:
    """GUID -> display name from the user map, falling back to the GUID.

    The map is deduplicated per GUID first so a duplicated identity cannot
    fan the fact rows out.
    """
    one = keep_one(umap, [F.col("UserId")], [F.col("Name")], last=True) \
        .withColumnRenamed("UserId", "_uid").withColumnRenamed("Name", "_name")
    j = df.join(bounded_broadcast(one), df[key] == F.col("_uid"), "left")
    return j.withColumn(out, F.coalesce(F.col("_name"), F.col(key))).drop("_uid", "_name")


def overlay_user_map(manual: DataFrame, db: DataFrame) -> DataFrame:
    """Manual map entries overlaid by the DB map; the DB wins.

    ``unionByName`` + one aggregation (priority DB=1 over manual=0) rather
    than a full outer join: one shuffle, and a GUID present many times in
    either input is combined map-side.
    """
    both = (manual.select("UserId", "Name", F.lit(0).alias("_prio"))
            .unionByName(db.select("UserId", "Name", F.lit(1).alias("_prio"))))
    return keep_one(both, [F.col("UserId")], [F.col("_prio"), F.col("Name")], last=True) \
        .select("UserId", "Name")


def user_cards(daily: DataFrame) -> DataFrame:
    """Per GUID -- companies, top page, opens, last used.

    Two-step aggregation: first per user x page (hits), then per user with
    ``min_by(page, (-hits, page))`` for the top page (ties: smallest id). The
    company list is a sorted distinct array joined to text; companies per
    user are bounded by the tenant's companies.
    """
    per_page = daily.groupBy("UserName", "PageId").agg(F.sum("Hits").alias("PageHits"))
    top = per_page.groupBy("UserName").agg(
        F.min_by("PageId", F.struct((-F.col("PageHits")).alias("h"), F.col("PageId"))).alias("TopPage"))
    per_user = daily.groupBy("UserName").agg(
        F.array_join(F.array_sort(F.collect_set("CompanyName")), ", ").alias("Companies"),
        F.sum("Hits").cast("long").alias("Opens"),
        F.max("DateKey").alias("LastUsed"))
    return per_user.join(top, "UserName")
