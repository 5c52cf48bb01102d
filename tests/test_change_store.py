"""The stored change log: files met by a batch, deletions, compaction, interrupted writers, pinned readers."""

import datetime as dt
import tempfile
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from auditlake.streaming import change_store as CS
from auditlake.streaming import ingest as ST
from conftest import rows

T0 = dt.datetime(2024, 1, 1, 8)


def entries(spark, spec):
    """(company, lo, hi, step in hours) runs of entry numbers; the time follows the number."""
    data = [(n, T0 + dt.timedelta(hours=n * h), "u", c, 18, "Customer", 1, "Name", "Insertion", f"k{n}", "", "x")
            for c, lo, hi, h in spec for n in range(lo, hi)]
    return spark.createDataFrame(data, CS.COLUMNS)


def store(spark):
    return CS.ChangeStore(spark, tempfile.mkdtemp(prefix="al-store-") + "/change_log")


def keys(s, version=None):
    return sorted((r.CompanyName, r.EntryNo) for r in s.rows(version).select("CompanyName", "EntryNo").collect())


def names_of(files):
    return sorted(unquote(r.File) for r in files.collect())


def test_batch_reads_only_files_whose_ranges_it_meets(spark):
    s = store(spark)
    s.add(entries(spark, [("A", 1, 50, 1), ("B/[x] é", 1, 50, 1)]), 1)
    s.add(entries(spark, [("A", 100, 150, 1)]), 2)
    s.add(entries(spark, [("A", 3_000_000, 3_000_010, 0)]), 3)
    met = names_of(s.met_files(entries(spark, [("A", 120, 160, 1)])))
    assert len(met) == 1 and met[0].startswith("Unit=2-") and "/Month=2024-01/Company=cA/" in met[0]
    assert names_of(s.met_files(entries(spark, [("A", 60, 90, 1), ("C", 1, 9, 1)]))) == []
    # numbers far apart in one batch (forward and backfill) don't meet what lies between them
    far = names_of(s.met_files(entries(spark, [("A", 40, 45, 1), ("A", 3_000_009, 3_000_020, 0)])))
    assert [f.split("-")[0] for f in far] == ["Unit=1", "Unit=3"]
    met_b = names_of(s.met_files(entries(spark, [("B/[x] é", 10, 12, 1)])))
    assert len(met_b) == 1 and "Company=cB" in met_b[0]
    before = keys(s)
    # overlapping re-delivery, twice over: exact
    again = entries(spark, [("A", 140, 170, 1), ("B/[x] é", 40, 60, 1), ("A", 140, 142, 1)])
    s.add(again, 4)
    assert keys(s) == sorted(before + [("A", n) for n in range(150, 170)] + [("B/[x] é", n) for n in range(50, 60)])
    assert s.add(again, 4) is None and s.add(again, 5) is None      # a replayed batch, and one with nothing new
    assert s.count() == len(keys(s)) == 49 + 49 + 50 + 10 + 20 + 10


def test_attempt_that_died_leaves_nothing_a_reader_sees(spark, monkeypatch):
    s = store(spark)
    s.add(entries(spark, [("A", 1, 10, 1)]), 1)
    monkeypatch.setattr(CS.Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        s.add(entries(spark, [("A", 10, 20, 1)]), 2)
    with pytest.raises(OSError):
        s.compact() if s.purge(["A"]) else None
    monkeypatch.undo()
    assert keys(s) == [("A", n) for n in range(1, 10)]
    s.add(entries(spark, [("A", 10, 20, 1)]), 2)
    assert keys(s) == [("A", n) for n in range(1, 20)]
    live = {r.Unit for r in s.files().collect()}
    assert len(ST.names(spark, f"{s.path}/entries")) == 3 and s.vacuum(grace=1) >= 1
    assert {n.split("=", 1)[1] for n in ST.names(spark, f"{s.path}/entries")} == live
    assert keys(s) == [("A", n) for n in range(1, 20)]


def test_purge_writes_no_entry_and_counts_live_rows_only(spark, monkeypatch):
    s = store(spark)
    s.add(entries(spark, [("A", 1, 40, 24), ("B", 1, 30, 24)]), 1)
    s.add(entries(spark, [("A", 40, 60, 24), ("B", 30, 40, 24)]), 2)
    # a compaction stopped before its commit: its files are there, nobody counts them
    with monkeypatch.context() as m:
        m.setattr(CS.Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            s.compact()
    units = ST.names(spark, f"{s.path}/entries")
    a_files = names_of(s.files().where("CompanyName = 'A'"))
    assert s.purge(["B", "nobody"]) == 39
    assert ST.names(spark, f"{s.path}/entries") == units                   # no unit was written
    assert names_of(s.files()) == a_files and s.purge(["B"]) == 0
    s.add(entries(spark, [("B", 5, 8, 24)]), 3)                            # purged entries may come back
    assert s.count() == 59 + 3


def test_retention_drops_months_and_marks_rows_of_the_cutoffs_month(spark):
    s = store(spark)
    s.add(entries(spark, [("A", 1, 100, 24), ("B", 1, 100, 12)]), 1)
    units = ST.names(spark, f"{s.path}/entries")
    cutoff = dt.datetime(2024, 2, 10, 20)
    all_rows = {(r.CompanyName, r.EntryNo): r.ChangedAt for r in s.rows().collect()}
    old = {k for k, at in all_rows.items() if at < cutoff}
    assert s.retain(cutoff) == len(old)
    assert ST.names(spark, f"{s.path}/entries") == units
    assert keys(s) == sorted(set(all_rows) - old) and s.count() == len(all_rows) - len(old)
    assert {r.Month for r in s.files().collect()} == {"2024-02", "2024-03", "2024-04"}
    assert s.retain(cutoff) == 0
    later = dt.datetime(2024, 2, 20)
    more = {k for k, at in all_rows.items() if cutoff <= at < later}
    assert s.retain(later) == len(more)                                   # rows deleted before count once
    # edges are those of the live rows; a deleted entry delivered again is stored again
    want = {}
    for (c, n), at in all_rows.items():
        if at >= later:
            want.setdefault(c, []).append(n)
    assert {(r.CompanyName, r.MaxEntryNo, r.MinEntryNo, r.StoredRows) for r in s.edges().collect()} == \
        {(c, max(v), min(v), len(v)) for c, v in want.items()}
    live = keys(s)
    back = sorted(more)[:2]
    s.add(entries(spark, [(c, n, n + 1, 24 if c == "A" else 12) for c, n in back]), 2)
    assert keys(s) == sorted(live + back)
    assert s.compact() >= 1 and keys(s) == sorted(live + back)
    assert s.files().agg(F.sum("Deleted")).first()[0] == 0
    assert s.purge(["A"]) + s.purge(["B"]) == len(live) + 2


def test_compaction_touches_only_what_lies_in_several_units(spark):
    s = store(spark)
    s.add(entries(spark, [("A", 1, 20, 1), ("B", 1, 20, 1)]), 1)
    s.add(entries(spark, [("A", 20, 30, 1)]), 2)
    b_file = names_of(s.files().where("CompanyName = 'B'"))
    before = rows(s.rows())
    assert s.compact() == 1 and s.compact() == 0
    assert rows(s.rows()) == before and names_of(s.files().where("CompanyName = 'B'")) == b_file
    assert s.files().where("CompanyName = 'A'").count() == 1
    s.add(entries(spark, [("A", 1, 35, 1)]), 3)
    assert s.count() == 34 + 19


def test_fifty_runs_keep_the_file_count_flat_and_a_slow_reader_finishes(spark):
    s = store(spark)
    counts = []
    s.add(entries(spark, [("A", 0, 5, 1)]), 1)
    with s.pinned() as old:
        for k in range(1, 51):
            s.add(entries(spark, [("A", 5 * k, 5 * k + 5, 1)]), k + 1)
            if k % 5 == 0:
                s.compact()
                s.vacuum()
                counts.append(len(ST.names(spark, f"{s.path}/entries")) + len(ST.names(spark, f"{s.path}/manifest")))
        assert old.count() == 5                                            # as of its version
    assert s.count() == 255 and max(counts[2:]) <= counts[1] + 1
    s.vacuum()
    assert len(ST.names(spark, f"{s.path}/manifest")) <= 4                 # two versions, the leases' folder
