"""The stored users with their history, and the user map written from them.

A row is a state of one user: ``ValidFrom`` when it was first delivered, ``ValidTo`` when another replaced it (NULL:
it is the newest), ``UpdatedAt`` when it was last delivered, ``DepartedAt`` since when the directory no longer lists the user
(NULL: it does). Users who left stay with their last state; one who returns starts a new state, so the time
away stays on record. Every load is a new version of the store.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.operators import identity as ID
from auditlake.streaming.versions import Versions

STATES = ["ValidFrom", "ValidTo", "UpdatedAt", "DepartedAt"]
ATTRIBUTES = [c for c in D.USER_COLUMNS if c != "UserSecurityId"]


def merge_users(history: DataFrame, directory: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The history after a delivery of the whole directory at ``as_of``.

    The newest states and the delivery meet in one aggregate by user (a user is at most one row of each), which
    says what happened to every user; closed states pass untouched.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    new = D.dedup_batch(directory.select(*D.USER_COLUMNS), [F.col("UserSecurityId")], last=True)
    open_rows = history.filter(F.col("ValidTo").isNull())
    state = F.struct(*ATTRIBUTES)
    old_side = open_rows.select("UserSecurityId", F.struct(*ATTRIBUTES, *STATES).alias("was"))
    new_side = new.select("UserSecurityId", state.alias("is"))
    both = old_side.unionByName(new_side, allowMissingColumns=True).groupBy("UserSecurityId") \
        .agg(F.max("was").alias("was"), F.max("is").alias("is"))
    was, is_ = F.col("was"), F.col("is")
    same = F.lit(True)
    for c in ATTRIBUTES:
        same = same & was[c].eqNullSafe(is_[c])
    same = same & was["DepartedAt"].isNull()
    nothing = F.lit(None).cast("timestamp_ntz")

    def row(of, valid_from, valid_to, updated, departed):
        return F.struct(*[of[c].alias(c) for c in ATTRIBUTES], valid_from.alias("ValidFrom"), valid_to.alias("ValidTo"),
                        updated.alias("UpdatedAt"), departed.alias("DepartedAt"))

    arrives = row(is_, now, nothing, now, nothing)
    closed = row(was, was["ValidFrom"], now, was["UpdatedAt"], was["DepartedAt"])
    states = (F.when(is_.isNull(), F.array(row(was, was["ValidFrom"], nothing, was["UpdatedAt"],
                                               F.coalesce(was["DepartedAt"], now))))
              .when(was.isNull(), F.array(arrives))
              .when(same, F.array(row(was, was["ValidFrom"], nothing, now, nothing)))
              .otherwise(F.array(closed, arrives)))
    merged = both.select("UserSecurityId", F.explode(states).alias("s")).select("UserSecurityId", "s.*")
    return merged.unionByName(history.filter(F.col("ValidTo").isNotNull()).select(*merged.columns))


class UserStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.versions = Versions(spark, f"{path.rstrip('/')}/users")
        self.maps = Versions(spark, f"{path.rstrip('/')}/user_map")

    def history(self) -> DataFrame:
        version = self.versions.newest()
        if version is None:
            columns = [*[f"{c} string" for c in D.USER_COLUMNS], *[f"{c} timestamp_ntz" for c in STATES]]
            return self.spark.createDataFrame([], ", ".join(columns))
        return self.spark.read.parquet(self.versions.folder(version) + "/data")

    def users(self) -> DataFrame:
        """The newest state of every user ever listed."""
        return self.history().filter(F.col("ValidTo").isNull()).select(*D.USER_COLUMNS, "UpdatedAt")

    def load(self, directory: DataFrame, as_of: dt.datetime, manual: DataFrame | None = None) -> int:
        """Merge a delivered directory, then write the user map from the result (``manual`` entries
        underneath, the stored users win). Returns the users stored."""
        version = self.versions.next()
        merge_users(self.history(), directory, as_of).write.mode("overwrite").parquet(self.versions.folder(version) + "/data")
        self.versions.commit(version)
        entries = ID.user_map(self.users())
        if manual is not None:
            entries = ID.overlay_user_map(manual, entries)
        number = self.maps.next()
        entries.write.mode("overwrite").parquet(self.maps.folder(number) + "/data")
        self.maps.commit(number)
        return self.users().count()

    def user_map(self) -> DataFrame | None:
        """The written map (``UserId, Name``); None before the first load."""
        version = self.maps.newest()
        return None if version is None else self.spark.read.parquet(self.maps.folder(version) + "/data")

    def vacuum(self) -> None:
        self.versions.vacuum()
        self.maps.vacuum()
