"""Column expressions (the reference's per-row helpers) as built-in functions.

Everything here returns a ``Column`` made of JVM built-ins, so it stays
inside whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference):
# interactive client types kept from the page-view feed (KQL `in`, case-sensitive)
INTERACTIVE_CLIENTS = ["WebClient", "Web", "Desktop", "Tablet", "Phone"]
# substitute for a NULL key in daily aggregates
MISSING_KEY = "?"
# event id of "Authorization Failed" traces (module C feed filter)
AUTH_FAILED_EVENT = "RT0031"
# the all-zero GUID a user without telemetry carries
ZERO_GUID = "00000000-0000-0000-0000-000000000000"
# separator between parts of a permission-error label (U+00B7 middle dot)
LABEL_SEP = " · "
# widths of the displayed permission-error label and text (stored in full: the label is a key)
OBJECT_ID_LEN = 50
OBJECT_NAME_LEN = 200
# change types of the change log
CHANGE_TYPES = ["Insertion", "Modification", "Deletion"]
# error classes: licence text, missing-right phrases (Czech and English), table number
LICENCE_PATTERN = r"(?i)licenc"
MISSING_RIGHT_PATTERN = r"(?i)(nemáte|oprávnění|práva|missing permission|do not have)"
TABLE_NO_PATTERN = r"Table(?:Data)?\s+(\d+)"
UNKNOWN_TABLE_NAME = "(?)"
# text formats of the snapshot (CONVERT(varchar(19), x, 120) and dates)
TS_TEXT = "yyyy-MM-dd HH:mm:ss"
DATE_TEXT = "yyyy-MM-dd"
# user-map text cleaning: max length of a name
USER_MAP_NAME_LEN = 120


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: str | Column) -> Column:
    """P5: '' becomes NULL."""
    return F.nullif(col(c), F.lit(""))


def kql_coalesce(*cols: str | Column) -> Column:
    """KQL ``coalesce`` on strings: the first value that is neither NULL nor ''."""
    return F.coalesce(*[empty_to_null(c) for c in cols])


def fill_missing(c: str | Column, marker: str = MISSING_KEY) -> Column:
    """``ISNULL(col, '?')``."""
    return F.coalesce(col(c), F.lit(marker))


def blank_key(c: str | Column) -> Column:
    """D1/D2/D4 key form of an optional id: NULL and '' collide (``ISNULL(x,'')``)."""
    return F.coalesce(col(c), F.lit(""))


def is_interactive(client_type: str | Column = "ClientType") -> Column:
    """Interactive-client whitelist."""
    return col(client_type).isin(INTERACTIVE_CLIENTS)


def auth_object_id(ptype: str | Column, otype: str | Column, oid: str | Column,
                   oname: str | Column) -> Column:
    """``<perm> · <objtype>[ <id>][ <name>]``, in full: it is part of the error key."""
    oid_part = F.when(F.coalesce(col(oid), F.lit("")).isin("0", ""), F.lit("")) \
                .otherwise(F.concat(F.lit(" "), col(oid)))
    name_part = F.when(F.coalesce(col(oname), F.lit("")) == "", F.lit("")) \
                 .otherwise(F.concat(F.lit(" "), col(oname)))
    label = F.concat(F.coalesce(empty_to_null(ptype), F.lit(MISSING_KEY)), F.lit(LABEL_SEP),
                     F.coalesce(empty_to_null(otype), F.lit(MISSING_KEY)), oid_part, name_part)
    return empty_to_null(label)


def auth_object_name(company: str | Column, err: str | Column, oname: str | Column) -> Column:
    """``[<company> · ]coalesce(errorMessage, objectName)``, in full; '' stored as NULL."""
    prefix = F.when(F.coalesce(col(company), F.lit("")) == "", F.lit("")) \
              .otherwise(F.concat(col(company), F.lit(LABEL_SEP)))
    text = F.concat(prefix, F.coalesce(kql_coalesce(err, oname), F.lit("")))
    return empty_to_null(text)


def text_or_empty(c: str | Column) -> Column:
    """PowerShell ``"$x"`` -- NULL renders as ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def int_or_zero(c: str | Column) -> Column:
    """Missing TableNo/FieldNo -> 0 (bad text -> 0 as well, via try_cast)."""
    return F.coalesce(col(c).try_cast("int"), F.lit(0))


def clean_guid(c: str | Column) -> Column:
    """Strip braces and blanks from a GUID; NULL stays NULL."""
    return F.trim(F.regexp_replace(col(c), r"[{}]", ""))


def display_name(full: str | Column, user: str | Column, fallback: str | Column) -> Column:
    """Trimmed full name, else trimmed login, else the telemetry id."""
    return F.coalesce(F.nullif(F.trim(col(full)), F.lit("")),
                      F.nullif(F.trim(col(user)), F.lit("")), col(fallback))


def name_or_key(name: str | Column, key: str | Column) -> Column:
    """The (untrimmed) full name when it is non-empty, else the key itself."""
    return F.coalesce(F.nullif(col(name), F.lit("")), col(key))


def ts_text(c: str | Column) -> Column:
    """``CONVERT(varchar(19), x, 120)``."""
    return F.date_format(col(c), TS_TEXT)


def date_text(c: str | Column) -> Column:
    return F.date_format(col(c), DATE_TEXT)


def error_class(msg: str | Column) -> Column:
    """M4: LICENCE / MISSING_ROLE / OTHER from the error text."""
    m = F.coalesce(col(msg), F.lit(""))
    return (F.when(m.rlike(LICENCE_PATTERN), "LICENCE")
            .when(m.rlike(MISSING_RIGHT_PATTERN), "MISSING_ROLE")
            .otherwise("OTHER"))


def error_table_no(msg: str | Column) -> Column:
    """M4: table number quoted in the error text, NULL when absent."""
    return F.nullif(F.regexp_extract(F.coalesce(col(msg), F.lit("")), TABLE_NO_PATTERN, 1), F.lit("")) \
            .try_cast("int")


def pct_half_even(num: str | Column, den: str | Column) -> Column:
    """``[Math]::Round(100*local/cloud)`` (.NET rounds half to even).

    ``cloud = 0`` with ``local > 0`` reads as 100 %, ``0/0`` as 0; an unknown count is 0.
    """
    n, d = F.coalesce(col(num), F.lit(0)), F.coalesce(col(den), F.lit(0))
    ratio = F.bround(F.lit(100.0) * n / d, 0)
    return (F.when(d > 0, ratio)
            .when((d == 0) & (n > 0), F.lit(100.0)).otherwise(F.lit(0.0))).cast("long")


def clean_text(c: str | Column, max_len: int = USER_MAP_NAME_LEN) -> Column:
    """Trim, cut to ``max_len``, blank -> NULL."""
    return F.nullif(F.left(F.trim(col(c)), F.lit(max_len)), F.lit(""))
