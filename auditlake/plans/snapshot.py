"""Settings (S7) and the dashboard snapshot (S10) assembled from stored tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators import health as H
from auditlake.operators import increments as I
from auditlake.operators import mining as M
from auditlake.operators import retention as RT
from auditlake.operators import views as V


def _whole(value, what: str, least: int = 0) -> int:
    text = "" if isinstance(value, bool) else str(value).strip()
    if not text.isdecimal() or int(text) < least:
        raise ValueError(f"{what} {value!r} is not a whole number of at least {least}")
    return int(text)


@dataclass
class Settings:
    """Run settings. ``validated`` raises on a value that is not allowed and never replaces one.

    Retention in months (1..1200), the snapshot's row cap (100..1,000,000), the selected companies
    (None: all), whether deselecting a company purges it, alert limits, the cursor's caps per company
    and run, and how late a page view may come (None: any time).
    """
    page_retention_months: int = RT.PAGE_RETENTION_MONTHS
    audit_retention_months: int = RT.AUDIT_RETENTION_MONTHS
    top_rows: int = V.TOP_ROWS_DEFAULT
    enabled_companies: list[str] | None = None
    auto_purge_on_remove: bool = False
    stale_hours: float = H.STALE_HOURS
    secret_warn_days: int = 30
    secret_expires: dt.datetime | None = None
    forward_cap: int = I.FORWARD_CAP
    backfill_cap: int = I.BACKFILL_CAP
    seed_rows: int = I.SEED_ROWS
    lookback: dt.timedelta | None = None
    extra: dict = field(default_factory=dict)

    def validated(self) -> Settings:
        comps = None if self.enabled_companies is None else \
            sorted({c.strip() for c in self.enabled_companies if c and c.strip()})
        if not float(self.stale_hours) > 0:
            raise ValueError(f"stale hours {self.stale_hours!r} are not positive")
        return replace(
            self, page_retention_months=RT.retention_months(self.page_retention_months, RT.PAGE_RETENTION_MONTHS),
            audit_retention_months=RT.retention_months(self.audit_retention_months, RT.AUDIT_RETENTION_MONTHS),
            top_rows=V.top_rows(self.top_rows), enabled_companies=comps,
            auto_purge_on_remove=bool(self.auto_purge_on_remove), stale_hours=float(self.stale_hours),
            secret_warn_days=_whole(self.secret_warn_days, "secret warning days", 1),
            forward_cap=_whole(self.forward_cap, "forward cap"), backfill_cap=_whole(self.backfill_cap, "backfill cap"),
            seed_rows=_whole(self.seed_rows, "seed rows"), extra=dict(self.extra))

    @property
    def caps(self) -> I.Caps:
        return I.Caps(self.forward_cap, self.backfill_cap, self.seed_rows)


def snapshot_sections(daily: DataFrame, raw: DataFrame, auth_daily: DataFrame, change_log: DataFrame,
                      users: DataFrame, page_map: DataFrame, as_of: dt.date, settings: Settings,
                      status: DataFrame | None = None, inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every snapshot section as a DataFrame (written section by section), in the order it shows.

    The capped sections use the validated row cap; reports elsewhere group the
    full tables (SURVEY §5 #11). Facts about a database server have no counterpart here.
    """
    n = settings.validated().top_rows
    ranges = V.data_ranges(daily, change_log)
    sections = {
        "kpi": V.kpi(daily, auth_daily, as_of),
        "changeLogByCompany": V.changes_by_company(change_log).orderBy(F.desc("Rows"), "CompanyName"),
        "pageRange": ranges.filter(F.col("Section") == "pages").drop("Section"),
        "auditRange": ranges.filter(F.col("Section") == "audit").drop("Section"),
        "userActivity": V.top_activity(daily, raw, n),
        "trend": V.trend(daily).orderBy("DateKey"),
        "trendByCompany": V.trend_by_company(daily).orderBy("DateKey", "CompanyName"),
        "authFails": V.top_auth_failures(auth_daily, n),
        "changeLog": V.latest_changes(change_log, n),
        "tableAccess": M.top_table_access(M.table_access(change_log, daily, page_map, users), n),
        "pageMapCount": page_map.agg(F.count(F.lit(1)).alias("PageMapCount")),
    }
    if status is not None:
        sections["sync"] = status.select("Module", "CloudCount", "LocalCount", C.ts_text("UpdatedAt").alias("UpdatedAt")) \
            .orderBy("Module")
    if inventory is not None:
        sections["dbTables"] = inventory
        sections["dbSize"] = inventory.agg(F.sum("SizeMB").alias("DataUsedMB"))
    return sections
