"""Audits find exactly the defects that were planted, and agree with plain joins."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import suite
from tests.conftest import spec

# A lending library: members, the books they have out, and the fines that follow from that.
SHELVES = ("atlas", "drama", "poetry", "science")
BARCODE = "^[A-Z]{2}-[0-9]+$"
TODAY = "2031-03-01"

# Audit, table, rows, what could catch it. Every defect has rows of its own.
PLANTED = [
    ("book without shelf", "books", 17, "single column"),
    ("shelf that is none", "books", 8, "single column"),
    ("barcode that is none", "books", 21, "single column"),
    ("barcode on two books", "books", 10, "single column"),
    ("loan of no book", "loans", 13, "several tables"),
    ("back before it went out", "loans", 29, "several columns"),
    ("out since tomorrow", "loans", 4, "single column"),
    ("returned and not dated", "loans", 11, "row condition"),
    ("fine of another amount", "fines", 7, "several tables"),
]


def rows_from(start, n):
    return F.col("id").between(start, start + n - 1)


def one_of(values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))


@pytest.fixture(scope="module")
def tables(spark):
    n = F.col("id")
    day = lambda d: F.lit(d).cast("date")
    books = spark.range(3000).select(
        n.alias("book"),
        F.when(rows_from(40, 17), F.lit(None)).when(rows_from(90, 8), F.concat(one_of(SHELVES), F.lit("s"))).otherwise(one_of(SHELVES)).alias("shelf"),
        F.when(rows_from(200, 21), F.concat(F.lit("xy"), n))
        .when(rows_from(400, 10), F.concat(F.lit("TW-"), F.floor(n / 2)))
        .otherwise(F.concat(F.lit("BK-"), n)).alias("barcode"),
    )
    loans = spark.range(9000).select(
        n.alias("loan"),
        F.when(rows_from(60, 13), n + 50_000).when(n % 3 == 1, F.lit(5)).otherwise(n % 3000).alias("book"),
        F.when(rows_from(700, 4), day("2031-03-02")).otherwise(day("2030-11-20")).alias("out"),
        F.when(rows_from(1500, 29), day("2030-11-19")).when(rows_from(2500, 11) | (n % 5 == 0), F.lit(None)).otherwise(day("2031-03-05")).alias("back"),
        F.when(rows_from(2500, 11) | ((n % 5 != 0) & ~rows_from(1500, 29)), "returned").otherwise("open").alias("state"),
        (n % 40).cast("decimal(6,2)").alias("due"),
    )
    fines = spark.range(0, 9000, 3).select(
        n.alias("loan"), (n % 40 + F.when(rows_from(3000, 19), 2).otherwise(0)).cast("decimal(6,2)").alias("paid")
    )
    return {"books": books, "loans": loans, "fines": fines}


def test_the_planted_defects_are_found_exactly(spark, tables):
    books, loans, fines = tables["books"], tables["loans"], tables["fines"]
    shelf, barcode = F.col("shelf"), F.col("barcode")
    observed = A.named(
        {
            "barcode on two books": A.duplicate_rows(books, ["barcode"]),
            "loan of no book": A.orphans(loans, "book", books, "book"),
            "back before it went out": A.out_of_order(loans, "out", "back"),
            "out since tomorrow": A.later_than(loans, "out", F.lit(TODAY).cast("date")),
            "returned and not dated": A.incomplete_when(loans, F.col("state") == "returned", "back"),
            "fine of another amount": A.mismatched(fines, loans, ("loan", "loan"), ("paid", "due")),
        }
    ).unionByName(
        A.count_each(
            books,
            {
                "book without shelf": shelf.isNull(),
                "shelf that is none": shelf.isNotNull() & ~shelf.isin(*SHELVES),
                "barcode that is none": ~barcode.rlike(BARCODE),
            },
        )
    )
    manifest = A.manifest(spark, PLANTED)
    checked = A.verify(manifest, observed).collect()
    assert {r.audit: r.observed for r in checked} == {a: n for a, _, n, _ in PLANTED}
    assert all(r.match for r in checked)
    reach = {r.reach: (r.classes, r.rows) for r in A.by_reach(manifest).collect()}
    assert reach["single column"] == (5, sum(n for _, _, n, r in PLANTED if r == "single column"))


def test_single_column_defects_are_found_by_rules_too(tables):
    rules = {
        "books": [
            (spec("column_values_to_not_be_null", column="shelf"), 17),
            (spec("column_values_to_be_in_set", column="shelf", value_set=list(SHELVES)), 8),
            (spec("column_values_to_match_regex", column="barcode", regex=BARCODE), 21),
            (spec("column_values_to_be_unique", column="barcode"), 10),
        ],
        "loans": [(spec("column_values_to_be_between", column="out", max_value=TODAY), 4)],
    }
    for table, expected in rules.items():
        got = suite.run_suite(tables[table], [r for r, _ in expected]).orderBy("position").collect()
        assert [r.unexpected_count for r in got] == [n for _, n in expected]


def test_a_manifest_entry_nobody_counted_does_not_match(spark):
    counted = A.count_rows(spark.range(3), F.col("id") > 1).selectExpr("'b' as audit", "observed")
    assert not A.verify(A.manifest(spark, [("a", "t", 0, "x")]), counted).first().match


pairs = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 3))), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=pairs, right=pairs)
def test_counts_agree_with_the_joins_they_replace(frame, left, right):
    a, b = frame(left, "k int, v int"), frame(right, "k int, w int")
    expected = sum(
        1 for k, v in left for j, w in right if k is not None and k == j and v is not None and w is not None and v != w
    )
    for many in (False, True):
        assert A.mismatched(a, b, ("k", "k"), ("v", "w"), many).first().observed == expected
    known = {k for k, _ in right if k is not None}
    assert A.orphans(a, "k", b, "k").first().observed == sum(1 for k, _ in left if k not in known)


def test_fingerprints_see_content_and_not_order(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"))
    first = A.fingerprint(df, "t").first()
    assert first == A.fingerprint(df.orderBy(F.rand(1)).repartition(7), "t").first()
    twice = A.fingerprint(df.unionByName(df.limit(1)).unionByName(df.limit(1)), "t").first()
    assert (twice.xor_a, twice.xor_b) == (first.xor_a, first.xor_b) and twice != first
    for changed in (F.when(F.col("id") == 5, F.lit("")).otherwise(F.col("s")), F.coalesce("s", F.lit(""))):
        assert A.fingerprint(df.withColumn("s", changed), "t").first().xor_a != first.xor_a


def test_values_that_hold_marks_do_not_run_into_each_other(frame):
    tables = [frame([row], "a string, b string") for row in (("x|", "y"), ("x", "|y"), ("x|1:y", None), ("~", ""), (None, "0:"), ("", "~"))]
    prints = [A.fingerprint(df, "t").first() for df in tables]
    assert len({(r.xor_a, r.xor_b) for r in prints}) == len(tables)


def test_sizes(spark):
    sizes = {r.table: r.rows for r in A.table_sizes({"a": spark.range(3), "b": spark.range(0)}).collect()}
    assert sizes == {"a": 3, "b": 0}
