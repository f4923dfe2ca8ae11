"""Audits over several columns and tables, the manifest, fingerprints and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.sources.layout import bucketed
from workload.derived import TABLES, from_sql, table


# Buckets of the tables laid out by key; more for larger tables.
BUCKETS = 16


def tables(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


def audit_row_predicates(spark, sf_dir):
    """Four row predicates of one table in one pass."""
    (customer,) = tables(spark, sf_dir, "customer")
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return A.count_each(
        customer,
        {
            "negative balance": F.col("c_acctbal") < 0,
            "no segment": segment.isNull(),
            "malformed name": segment.isNotNull() & ~F.col("c_name").rlike("^Customer#[0-9]{9}$"),
            "segment outside the vocabulary": ~F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE", "FURNITURE"),
        },
    )


def ship_and_order_dates(spark, sf_dir):
    """Lines with the date of their order; a line's dates are counted before the join."""
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    shipped = lineitem.groupBy("l_orderkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return shipped.join(orders, shipped.l_orderkey == orders.o_orderkey)


def audit_out_of_order(spark, sf_dir):
    pairs = ship_and_order_dates(spark, sf_dir)
    late = pairs.filter(F.col("l_shipdate") < F.col("o_orderdate"))
    return late.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed"))


def audit_column_pair(spark, sf_dir):
    """Two columns of one row: a tax above its discount counts as out of order."""
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    return A.out_of_order(lineitem, "l_tax", "l_discount")


def audit_orphans(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    return A.orphans(orders, "o_custkey", customer.filter("c_acctbal >= 0"), "c_custkey")


def audit_orphan_lines(spark, sf_dir):
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    keyed = lineitem.withColumn("key", F.nullif("l_orderkey", F.lit(7)))
    return A.orphans(keyed, "key", orders.filter("o_orderstatus <> 'P'"), "o_orderkey")


def audit_reconciliation(spark, sf_dir):
    """Order totals against the sum of their lines, in cents."""
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sums = lineitem.groupBy("l_orderkey").agg(F.sum(cents).alias("lines"))
    totals = orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    return A.mismatched(totals, sums, ("o_orderkey", "l_orderkey"), ("total", "lines"))


def audit_mismatched_pairs(spark, sf_dir):
    """Many rows on both sides of a key: suppliers of a part against sizes of its brand."""
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    left = lineitem.select("l_suppkey", F.nullif("l_linenumber", F.lit(7)).alias("number"))
    right = part.select((F.col("p_partkey") % 100).alias("key"), F.nullif("p_size", F.lit(3)).alias("size"))
    return A.mismatched(left, right, ("l_suppkey", "key"), ("number", "size"), many=True)


def audits_by_key(spark, sf_dir):
    """Four audits on the key of an order, over two tables laid out by it once."""
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    lines = bucketed(lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"), "l_orderkey", BUCKETS)
    heads = bucketed(orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"), "o_orderkey", BUCKETS)
    return A.named(audits_of_orders(lines, heads))


def audits_of_orders(lines, heads):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sums = lines.groupBy("l_orderkey").agg(F.sum(cents).alias("lines"))
    totals = heads.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    pairs = lines.join(heads, lines.l_orderkey == heads.o_orderkey)
    return {
        "orphans": A.orphans(lines, "l_orderkey", heads.filter("o_orderstatus <> 'P'"), "o_orderkey"),
        "totals": A.mismatched(totals, sums, ("o_orderkey", "l_orderkey"), ("total", "lines")),
        "duplicate keys": A.duplicate_rows(lines, ["l_orderkey", "l_linenumber"]),
        "out of order": A.out_of_order(pairs, "o_orderdate", "l_shipdate"),
    }


def audit_incomplete(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    paid = orders.withColumn("paid_at", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")))
    return A.incomplete_when(paid, F.col("o_orderstatus") == "F", "paid_at")


def audit_duplicates(spark, sf_dir):
    (documents,) = tables(spark, sf_dir, "documents")
    return A.duplicate_rows(documents, ["text"])


def audit_duplicate_keys(spark, sf_dir):
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    return A.duplicate_rows(lineitem, ["l_orderkey", "l_linenumber"])


def audit_future(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    return A.later_than(orders, "o_orderdate", F.lit("2000-06-01").cast("timestamp_ntz"))


SINGLE, MULTI, COND = "single column", "several columns or tables", "with a row condition"
PLAIN = {
    "negative": "select count(*) as observed from {customer} where c_acctbal < 0",
    "out of order": "select count(*) as observed from {lineitem} join {orders} on l_orderkey = o_orderkey where l_shipdate < o_orderdate",
    "orphans": "select count(*) as observed from {orders} where not exists (select 1 from {customer} where c_custkey = o_custkey and c_acctbal >= 0)",
    "duplicate text": "select count(*) as observed from {documents} where text in (select text from {documents} group by text having count(*) > 1)",
    "duplicate keys": "select coalesce(sum(n), 0) as observed from (select count(*) as n from {lineitem} group by l_orderkey, l_linenumber having count(*) > 1) d",
    "unpaid": "select count(*) as observed from {orders} where o_orderstatus = 'F' and o_orderkey % 10 = 0",
}
MANIFEST = (
    ("negative", "customer", SINGLE),
    ("out of order", "lineitem", MULTI),
    ("orphans", "orders", MULTI),
    ("duplicate text", "documents", SINGLE),
    ("duplicate keys", "lineitem", SINGLE),
    ("unpaid", "orders", COND),
)


def expected_counts(spark, sf_dir):
    """The manifest, its counts taken from the tables by plain SQL."""
    rows = " union all ".join(
        f"""select '{a}' as audit, '{t}' as tab, cast(observed as bigint) as expected, '{r}' as reach from ({PLAIN[a]}) o"""
        for a, t, r in MANIFEST
    )
    return from_sql(spark, sf_dir, rows)


def manifest_check(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    observed = A.named(
        {
            "negative": A.count_rows(customer, F.col("c_acctbal") < 0),
            "out of order": audit_out_of_order(spark, sf_dir),
            "orphans": audit_orphans(spark, sf_dir),
            "duplicate text": audit_duplicates(spark, sf_dir),
            "duplicate keys": audit_duplicate_keys(spark, sf_dir),
            "unpaid": audit_incomplete(spark, sf_dir),
        }
    )
    return A.verify(expected_counts(spark, sf_dir), observed)


def reach_summary(spark, sf_dir):
    """Every part as a defect class: classes and rows by what could catch them."""
    (part,) = tables(spark, sf_dir, "part")
    classes = part.select(F.col("p_type").alias("reach"), F.col("p_size").cast("bigint").alias("expected"))
    return A.by_reach(classes)


def fingerprint(spark, sf_dir):
    """Fingerprints of three tables; doubles go in as cents so that both sides print them alike."""
    lineitem, orders, documents = tables(spark, sf_dir, "lineitem", "orders", "documents")
    cents = lineitem.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    doubled = orders.unionByName(orders.filter("o_orderkey % 2 = 0"))
    return (
        A.fingerprint(cents, "lineitem", ["l_orderkey", "l_linenumber", "cents", "l_returnflag", "l_shipdate"])
        .unionByName(A.fingerprint(doubled, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"]))
        .unionByName(A.fingerprint(documents, "documents", ["doc_id", "text", "lang"]))
    )


def fingerprint_of_separators(spark, sf_dir):
    """Two tables whose values would be one text if they were put side by side unmarked."""
    (part,) = tables(spark, sf_dir, "part")
    left = part.select(F.concat("p_name", F.lit("|")).alias("a"), F.concat(F.lit("5:"), "p_brand").alias("b"))
    right = part.select(F.col("p_name").alias("a"), F.concat(F.lit("|5:"), "p_brand").alias("b"))
    return A.fingerprint(left, "left").unionByName(A.fingerprint(right, "right"))


def table_sizes(spark, sf_dir):
    return A.table_sizes({n: table(spark, sf_dir, n) for n in TABLES})


QUERIES = {
    f.__name__: f
    for f in (
        audit_row_predicates, audit_out_of_order, audit_column_pair, audit_orphans,
        audit_orphan_lines, audit_reconciliation, audit_mismatched_pairs, audits_by_key, audit_incomplete,
        audit_duplicates, audit_duplicate_keys, audit_future, manifest_check, reach_summary,
        fingerprint, fingerprint_of_separators, table_sizes,
    )
}

def hash_sql(name: str, source: str, columns: list[str]) -> str:
    parts = " || ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '~')" for c in columns)
    half = "cast(cast('0x' || substr(d, {at}, 16) as ubigint) as hugeint)"
    signed = "cast(case when {h} >= 9223372036854775808 then {h} - 18446744073709551616 else {h} end as bigint)"
    a, b = (signed.format(h=half.format(at=at)) for at in (1, 17))
    return f"""
    select '{name}' as "table", count(*) as rows, bit_xor(a) as xor_a, cast(sum(a) as varchar) as sum_a,
           bit_xor(b) as xor_b, cast(sum(b) as varchar) as sum_b
    from (select {a} as a, {b} as b from (select md5({parts}) as d from {source}) m) t"""


ORACLES = {
    "audit_row_predicates": """
        select unnest(['negative balance', 'no segment', 'malformed name', 'segment outside the vocabulary']) as audit,
               unnest([a, b, c, d]) as observed
        from (select count(*) filter (where c_acctbal < 0) as a,
                     count(*) filter (where c_mktsegment = 'BUILDING') as b,
                     count(*) filter (where c_mktsegment <> 'BUILDING' and not regexp_full_match(c_name, 'Customer#[0-9]{9}')) as c,
                     count(*) filter (where c_mktsegment not in ('MACHINERY', 'AUTOMOBILE', 'FURNITURE')) as d
              from customer) t""",
    "audit_out_of_order": """
        select count(*) as observed from lineitem join orders on l_orderkey = o_orderkey
        where l_shipdate < o_orderdate""",
    "audit_column_pair": "select count(*) as observed from lineitem where l_discount < l_tax",
    "audit_orphans": """
        select count(*) as observed from orders
        left join (select * from customer where c_acctbal >= 0) c on o_custkey = c_custkey
        where c_custkey is null""",
    "audit_orphan_lines": """
        select count(*) as observed from lineitem
        left join (select * from orders where o_orderstatus <> 'P') o on nullif(l_orderkey, 7) = o_orderkey
        where o_orderkey is null""",
    "audit_reconciliation": """
        select count(*) as observed
        from orders join (select l_orderkey, sum(cast(round(l_extendedprice * 100) as bigint)) as lines
                          from lineitem group by 1) l on o_orderkey = l_orderkey
        where cast(round(o_totalprice * 100) as bigint) <> lines""",
    "audit_mismatched_pairs": """
        select count(*) as observed
        from (select l_suppkey, nullif(l_linenumber, 7) as number from lineitem) l
        join (select p_partkey % 100 as key, nullif(p_size, 3) as size from part) p on l_suppkey = key
        where number <> size""",
    "audit_incomplete": """
        select count(*) as observed from orders
        where o_orderstatus = 'F' and case when o_orderkey % 10 <> 0 then o_orderdate end is null""",
    "audit_duplicates": """
        select cast(coalesce(sum(n), 0) as bigint) as observed
        from (select count(*) as n from documents group by text having count(*) > 1) d""",
    "audit_duplicate_keys": """
        select cast(coalesce(sum(n), 0) as bigint) as observed
        from (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1) d""",
    "audit_future": "select count(*) as observed from orders where o_orderdate > timestamp '2000-06-01'",
    "reach_summary": """
        select p_type as reach, count(*) as classes, cast(sum(p_size) as bigint) as rows from part group by 1""",
    "fingerprint": " union all ".join(
        [
            hash_sql("lineitem", "(select *, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem)",
                     ["l_orderkey", "l_linenumber", "cents", "l_returnflag", "l_shipdate"]),
            hash_sql("orders", "(select * from orders union all select * from orders where o_orderkey % 2 = 0)",
                     ["o_orderkey", "o_orderstatus", "o_orderdate"]),
            hash_sql("documents", "documents", ["doc_id", "text", "lang"]),
        ]
    ),
    "fingerprint_of_separators": " union all ".join(
        [
            hash_sql("left", "(select p_name || '|' as a, '5:' || p_brand as b from part)", ["a", "b"]),
            hash_sql("right", "(select p_name as a, '|5:' || p_brand as b from part)", ["a", "b"]),
        ]
    ),
    "table_sizes": " union all ".join(f"select '{n}' as \"table\", count(*) as rows from {n}" for n in TABLES),
}
OBSERVED = {
    "negative": "select count(*) as observed from customer where c_acctbal < 0",
    "out of order": ORACLES["audit_out_of_order"],
    "orphans": ORACLES["audit_orphans"],
    "duplicate text": ORACLES["audit_duplicates"],
    "duplicate keys": ORACLES["audit_duplicate_keys"],
    "unpaid": ORACLES["audit_incomplete"],
}
ORACLES["manifest_check"] = " union all ".join(
    f"""select '{a}' as audit, '{t}' as "table", observed as expected, '{r}' as reach,
        observed, true as match from ({OBSERVED[a]}) o"""
    for a, t, r in MANIFEST
)
ORACLES["audits_by_key"] = """
    select 'orphans' as audit, count(*) as observed from lineitem
        where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')
    union all select 'totals', count(*) from orders join (
        select l_orderkey, sum(cast(round(l_extendedprice * 100) as bigint)) as lines from lineitem group by 1) s
        on l_orderkey = o_orderkey where cast(round(o_totalprice * 100) as bigint) <> lines
    union all select 'duplicate keys', cast(coalesce(sum(n), 0) as bigint) from (
        select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1) d
    union all select 'out of order', count(*) from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate"""
