import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from auditlake.session import build_session

    extra = {"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"}
    # tests own their shared folder only when the environment names none
    active = SparkSession.getActiveSession()
    if not (active and active.conf.get("spark.checkpoint.dir", None)):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="auditlake-test-ckpt-")
    s = build_session("local[4]", 4, app_name="auditlake-tests", extra=extra)
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples for order-insensitive comparison."""
    cols = cols or df.columns
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
