import datetime as dt

from auditlake.operators import identity as ID
from auditlake.operators import mining as M
from conftest import rows

USERS = "UserSecurityId string, TelemetryUserId string, UserName string, FullName string, AuthEmail string, " \
        "State string, UpdatedAt timestamp_ntz"
DAILY = "DateKey date, UserName string, PageId string, PageName string, CompanyName string, Hits long"
CL = "EntryNo long, ChangedAt timestamp_ntz, UserId string, CompanyName string, TableNo int, TableName string, " \
     "FieldNo int, FieldName string, ChangeType string, PrimaryKey string, OldValue string, NewValue string"
T = dt.datetime(2024, 1, 5, 9, 30, 0)
D1, D2 = dt.date(2024, 1, 5), dt.date(2024, 1, 6)


def setup(spark):
    users = spark.createDataFrame([
        ("s1", "g1", "LOGIN1", "Ann", None, None, T), ("s2", "g2", "LOGIN2", "Ann", None, None, T),
        ("s3", "g3", "LOGIN3", "  ", None, None, T), ("s4", None, "LOGIN4", None, None, None, T)], USERS)
    pages = spark.createDataFrame([("21", 18, "Customer"), ("1", 27, "Item"), ("-1", 99, "Sys")],
                                  "PageId string, TableNo int, TableName string")
    daily = spark.createDataFrame([
        (D1, "g1", "21", "Customer Card", "CO", 3), (D2, "g2", "21", "Customer Card", "CO", 2),
        (D1, "g3", "1", "Item Card", "CO", 1), (D1, "g9", "-1", "Sys", "CO", 4), (D1, "g1", "77", "X", "CO", 1)], DAILY)
    cl = spark.createDataFrame([
        (1, T, "LOGIN1", "CO", 18, "Customer", 0, "", "Insertion", "k", "", ""),
        (2, T, "LOGIN1", "CO", 18, "Customer", 0, "", "Deletion", "k", "", ""),
        (3, T, "LOGIN4", "CO", 36, "Sales Header", 0, "", "Modification", "k", "", "")], CL)
    return users, pages, daily, cl


def test_two_guids_one_name_merge_and_pages_count_twice(spark):
    users, pages, daily, cl = setup(spark)
    acc = {(r.UserName, r.TableNo): r for r in M.table_access(cl, daily, pages, users).collect()}
    ann = acc[("Ann", 18)]
    assert (ann.Changes, ann.Ins, ann.Del, ann.Reads, ann.Pages, ann.Access) == (2, 1, 1, 5, 2, "RW")
    # same-day write (with time) sorts after the read's bare date
    assert ann.LastUsed == "2024-01-06"
    assert acc[("LOGIN4", 36)].Access == "W"           # no full name -> login
    assert acc[("  ", 27)].Access == "R"               # untrimmed blank name stays a name
    assert ("g9", 99) in acc and acc[("g9", 99)].TableName == "Sys"   # -1 maps exactly, not to page 1
    assert not any(k[1] is None for k in acc)          # unmapped page 77 dropped


def test_role_proposal_rights_and_text(spark):
    users, pages, daily, cl = setup(spark)
    people = spark.createDataFrame([("Ann",)], "Person string")
    role = M.role_proposal(cl, daily, pages, people, users, company="CO", min_ops=0)
    got = {(r.ObjectType, r.ObjectId): r.Rights for r in role.collect()}
    assert got == {("TableData", "18"): "RID", ("Page", "21"): "X", ("Page", "77"): "X"}
    text = M.role_text(role, "R1").first()
    assert text.Objects == 3
    assert text.PermissionSet.split("\n") == ["Page 21 = X", "Page 77 = X", "TableData 18 = RID"]


def test_role_threshold_and_excluded_page(spark):
    users, pages, daily, cl = setup(spark)
    people = spark.createDataFrame([("Ann",), ("g9",)], "Person string")
    role = M.role_proposal(cl, daily, pages, people, users, company="CO", min_ops=3)
    got = {(r.ObjectType, r.ObjectId) for r in role.collect()}
    assert got == {("TableData", "18"), ("Page", "21"), ("TableData", "99")}   # page -1 never becomes a right


def test_user_map_and_overlay(spark):
    users, *_ = setup(spark)
    extra = spark.createDataFrame([("s5", "00000000-0000-0000-0000-000000000000", "Z", "Zed", None, None, T),
                                   ("s6", " ", "Y", "Yo", None, None, T)], USERS)
    umap = ID.user_map(users.unionByName(extra))
    assert rows(umap) == [("g1", "Ann"), ("g2", "Ann"), ("g3", "LOGIN3")]
    manual = spark.createDataFrame([("g1", "Manual Ann"), ("gx", "Only Manual")], "UserId string, Name string")
    assert rows(ID.overlay_user_map(manual, umap)) == [
        ("g1", "Ann"), ("g2", "Ann"), ("g3", "LOGIN3"), ("gx", "Only Manual")]


def test_user_cards_top_page_ties(spark):
    daily = spark.createDataFrame([(D1, "g", "5", "a", "CO_B", 2), (D1, "g", "3", "b", "CO_A", 2),
                                   (D2, "g", "9", "c", "CO_A", 1)], DAILY)
    card = ID.user_cards(daily).first()
    assert (card.Companies, card.TopPage, card.Opens, card.LastUsed) == ("CO_A, CO_B", "3", 5, D2)


def test_error_classes_with_unknown_table(spark):
    ad = spark.createDataFrame([(D1, "g", "o", "CO · licence TableData 18", 1),
                                (D1, "g", "o2", "CO · Missing permission: TableData 5404718", 1),
                                (D1, "g", "o3", "CO · Nemáte oprávnění", 1)],
                               "DateKey date, UserName string, ObjectId string, ObjectName string, Failures long")
    names = spark.createDataFrame([(18, "Customer")], "TableNo int, TableName string")
    out = rows(M.classify_errors(ad, names), "ErrorClass", "TableNo", "TableName")
    assert out == sorted([("LICENCE", 18, "Customer"), ("MISSING_ROLE", 5404718, "(?)"),
                          ("MISSING_ROLE", None, None)], key=repr)


def test_renamed_page_splits_activity_rows_sharing_last_seen(spark):
    from auditlake.operators import views as V
    raw = spark.createDataFrame([
        (dt.datetime(2024, 1, 5, 8), "g", "21", "Old name", "CO"),
        (dt.datetime(2024, 1, 6, 9, 15, 30, 250000), "g", "21", "New name", "CO")],
        "Timestamp timestamp_ntz, UserName string, PageId string, PageName string, CompanyName string")
    from auditlake.operators import rollup as R
    daily = R.daily_page_rollup(raw)
    out = rows(V.activity_with_last_seen(daily, raw), "PageName", "TotalHits", "LastUsed")
    assert out == [("New name", 1, "2024-01-06 09:15:30"), ("Old name", 1, "2024-01-06 09:15:30")]


def test_kpi_exact_and_approximate(spark):
    from auditlake.operators import views as V
    daily = spark.createDataFrame([(D1, f"u{i % 7}", str(i % 5), "n", "CO", 1) for i in range(40)], DAILY)
    fails = spark.createDataFrame([(D1, "g", "o", "n", 3)],
                                  "DateKey date, UserName string, ObjectId string, ObjectName string, Failures long")
    exact = V.kpi(daily, fails, dt.date(2024, 1, 15)).first()
    assert (exact.ActiveUsers30d, exact.DistinctPages30d, exact.Hits30d, exact.AuthFails14d) == (7, 5, 40, 3)
    approx = V.kpi(daily, fails, dt.date(2024, 1, 15), approx_rsd=0.01).first()
    assert (approx.ActiveUsers30d, approx.DistinctPages30d) == (7, 5)
    empty = V.kpi(daily, fails, dt.date(2025, 1, 1)).first()
    assert (empty.ActiveUsers30d, empty.Hits30d, empty.AuthFails14d) == (0, 0, 0)


def test_reads_with_question_mark_company_and_writes_with_empty_company_stay_apart(spark):
    users, pages, _, _ = setup(spark)
    daily = spark.createDataFrame([(D1, "g1", "21", "Customer Card", "?", 2)], DAILY)
    cl = spark.createDataFrame([(1, T, "LOGIN1", "", 18, "Customer", 0, "", "Insertion", "k", "", "")], CL)
    acc = rows(M.table_access(cl, daily, pages, users), "UserName", "TableNo", "CompanyName", "Access")
    assert acc == [("Ann", 18, "", "W"), ("Ann", 18, "?", "R")]


def test_role_of_people_equals_the_role_of_their_access_rows(spark):
    """Keys filter before the aggregates; the result is that of naming everyone and then choosing."""
    users, pages, daily, cl = setup(spark)
    acc = M.table_access(cl, daily, pages, users).collect()
    for chosen in (["Ann"], ["LOGIN4", "g9"], ["  "], ["LOGIN1"], ["nobody"], ["Ann", "g9", "LOGIN4", "  ", "g1"]):
        people = spark.createDataFrame([(c,) for c in chosen], "Person string")
        role = M.role_proposal(cl, daily, pages, people, users)
        got = {(r.ObjectId, r.Operations, r.ObjectName) for r in role.filter("ObjectType = 'TableData'").collect()}
        want = {}
        for r in acc:
            if r.UserName in chosen:
                n, name = want.get(r.TableNo, (0, ""))
                want[r.TableNo] = (n + r.Changes + r.Reads, max(name, r.TableName or ""))
        assert got == {(str(t), n, name) for t, (n, name) in want.items()}, chosen


def test_role_text_joins_ranges_in_order(spark):
    objects = [("Page", str(n)) for n in (5, 30, 999, 1000, 21_000, -4)] + [("Page", "x9"), ("Page", "ab1"), ("Page", "ab")] \
        + [("TableData", str(n)) for n in range(0, 5000, 7)]
    role = spark.createDataFrame([(t, i, "R") for t, i in objects], "ObjectType string, ObjectId string, Rights string").repartition(5)

    def order(o):
        number = int(o[1]) if o[1].lstrip("-").isdigit() else None
        return (o[0], number is not None, number or 0, o[1])
    got = M.role_text(role, "R").first()
    assert got.Objects == len(objects)
    assert got.PermissionSet.split("\n") == [f"{t} {i} = R" for t, i in sorted(objects, key=order)]
    none = M.role_text(role.limit(0), "R").first()
    assert (none.Objects, none.PermissionSet) == (0, "")
