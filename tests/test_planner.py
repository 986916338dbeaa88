import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowlake import queries as registered
from flowlake.functions import exprs
from flowlake.operators import export
from flowlake.operators.filters import Fields, compile_filter
from flowlake.operators.histogram import bucket_width, histogram, page
from flowlake.operators.planner import plan, steps
from flowlake.plans.fql import parse
from flowlake.sources.flows import flows

from .conftest import SF

ROWS = [
    (1000, 1, 167772161, 3232235777, 80, 6, 100, "web", None), (2000, 2, 167772162, 3232235778, 53, 17, 200, None, bytes(15) + b"\x01"), (3000, 3, None, 3232235779, 443, 6, 300, "tls", None),
    (4000, 4, 167837697, 3232235777, None, 6, None, "web", bytes.fromhex("20010db8") + bytes(12)),
]
SCHEMA = "sysExportTime long, sysRowId long, sourceIPv4Address long, destinationIPv4Address long, destinationTransportPort int, protocolIdentifier int, octetDeltaCount long, applicationName string, sourceIPv6Address binary"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df, text):
    return sorted(r.sysRowId for r in df.where(compile_filter(parse(f"last 1h | {text}").stages[0], Fields(df))).collect())


@pytest.mark.parametrize("text,want", [
    ("src 10.0.0.1", [1]), ("src not 10.0.0.1", [2, 4]), ("not src 10.0.0.1", [2, 3, 4]), ("src 10.0.0.0/24", [1, 2]), ("src 0.0.0.0/0", [1, 2, 4]), ("src 10.0.*.1", [1]), ("src 10.0-1.*.1-2", [1, 2, 4]),
    ("src 2001:db8::/32", [4]), ("src ::1", [2]), ("src in (10.0.0.1, ::1)", [1, 2]), ("vlan = 5", []), ("not vlan = 5", [1, 2, 3, 4]), ("vlan != 5", []), ("app = \"web\"", [1, 4]),
    ("not app = \"web\"", [2, 3]), ("app !~ \"^w\"", [3]), ("not app ~ \"^w\"", [2, 3]), ("not (dport 80 or dport 53)", [3, 4]), ("bytes in (100, 300)", [1, 3]), ("bytes not in (100, 300)", [2]),
    ("ip 192.168.1.1", [1, 4]), ("not ip 192.168.1.1", [2, 3]), ("dst = 192.168.1.1", [1, 4]), ("dport nosuch", []),
])
def test_filters(table, text, want):
    assert ids(table, text) == want


def test_random_filters_match_rows(table):
    rnd = random.Random(5)
    leaves = [("dport 80", lambda r: r[4] == 80), ("proto tcp", lambda r: r[5] == 6), ("bytes >= 200", lambda r: r[6] is not None and r[6] >= 200), ('app = "web"', lambda r: r[7] == "web"), ("src 10.0.0.0/24", lambda r: r[2] is not None and r[2] >> 8 == 167772160 >> 8)]

    def tree(depth):
        if depth == 0:
            return rnd.choice(leaves)
        kind = rnd.choice(("and", "or", "not"))
        a, fa = tree(depth - 1)
        if kind == "not":
            return f"not ({a})", lambda r: not fa(r)
        b, fb = tree(depth - 1)
        return (f"({a}) {kind} ({b})", (lambda r: fa(r) and fb(r)) if kind == "and" else (lambda r: fa(r) or fb(r)))

    for _ in range(12):
        text, f = tree(3)
        assert ids(table, text) == [r[1] for r in ROWS if f(r)], text


def test_pushdown(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    out = plan("1970-01-01 | src 10.0.0.0/8 and not dport 80 | select bytes", spark.read.parquet(str(tmp_path / "t")))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sourceIPv4Address,167772160)" in text and "GreaterThanOrEqual(sysExportTime" in text
    assert "applicationName" not in text.split("ReadSchema")[1]


def test_group_nulls_and_order(table):
    rows = plan("1970-01-01 | group by app | sum(bytes), avg(bytes), uniq(src), first(bytes), last(bytes)", table).collect()
    assert [(r["applicationName"], r["sum(bytes)"]) for r in rows] == [("tls", 300), (None, 200), ("web", 100)]
    web = rows[2]
    assert web["uniq(src)"] == 2 and web["first(bytes)"] == 100
    assert plan("1970-01-01 | group by src /0 | count()", table).count() == 2


def test_paging_loses_nothing(spark):
    df, seen, cursor = flows(spark, SF).where("sysRowId < 95"), [], None
    df = df.withColumn("sysExportTime", F.col("sysRowId") * 10 + 1704067200000)
    while True:
        p = page("2024-01-01..2024-02-01", df, size=10, cursor=cursor)
        seen += [r.sysRowId for r in p.rows.collect()]
        if not p.has_more:
            break
        cursor = p.cursor
    assert seen == list(range(94, -1, -1))


def test_histogram_edges(table):
    assert bucket_width(0, 600_000) == 10_000 and bucket_width(0, 10**12) == 86_400_000
    got = {r.bucket: r["count"] for r in histogram(table, 0, 60_000).collect()}
    assert len(got) == 60 and sum(got.values()) == 4 and got[0] == 0
    assert histogram(table, 5, 5).count() == 0


def test_expressions(spark):
    row = spark.range(1).select(
        exprs.dotted(F.lit(3232235777)).alias("ip"), exprs.subnet(F.lit(3232235777), 16).alias("net"), exprs.subnet6(F.lit(bytearray(bytes.fromhex("20010db8ffff") + bytes(10))), 34).alias("net6"), exprs.tcp_flags(F.lit(18)).alias("flags"),
        exprs.format_bytes(F.lit(1536)).alias("b"), exprs.format_duration(F.lit(90_061_000)).alias("d"), exprs.format_mac(F.lit("AABB-CCDD-EEFF")).alias("mac"), exprs.flow_duration(F.lit(5), F.lit(3)).alias("neg"),
        exprs.bits_per_second(F.lit(10), F.lit(0)).alias("none"), exprs.row_id(F.lit(1_700_000_000_123), F.lit("x")).alias("id"), exprs.icmp_type_code(F.lit(2049)).alias("icmp"), exprs.forwarding_status(F.lit(64)).alias("fwd"),
    ).first()
    assert (row.ip, row.net, row.net6) == ("192.168.1.1", "192.168.0.0/16", "2001:0db8:c000:0000:0000:0000:0000:0000/34")
    assert (row.flags, row.b, row.d, row.mac, row.neg, row.none, row.icmp, row.fwd) == ("SYN,ACK", "1.5 KB", "1d 1h 1m 1s", "aa:bb:cc:dd:ee:ff", 0, None, "Echo Request (8/1)", "Unknown")
    assert spark.range(1).select(exprs.row_id_time(F.lit(row.id)).alias("t")).first().t == 1_700_000_000_123 and row.id[14] == "7"


def test_export(spark):
    df = spark.createDataFrame([(1, 'a"b,c'), (2, None), (3, "x\ty")], "n int, s string")
    assert [r.line for r in export.lines(df, "csv").collect()] == ['1,"a""b,c"', "2,", "3,x\ty"]
    assert [r.line for r in export.lines(df, "ltsv").collect()] == ['n:1\ts:a"b,c', "n:2", "n:3\ts:x y"]
    assert [r.line for r in export.lines(df, "ndjson").collect()][1] == '{"n":2,"s":null}'


def test_steps():
    assert steps("last 1h | dport 80 | limit 5")[2]["step"] == "limit"


@pytest.mark.parametrize("name", ["flagship", "agg_p95", "top_groups", "page_cursor", "select_except", "fmt_bytes", "netflow_v9_decode", "netflow_v5_decode", "ipfix_decode"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = registered.QUERIES[name](spark, SF).toPandas(), con.execute(registered.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    tidy = lambda d: sorted(tuple(round(float(v), 6) if not isinstance(v, str) else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert tidy(got) == tidy(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_ipv6_text_and_units(spark):
    import ipaddress

    texts = ["::", "::1", "2001:db8::1", "fe80::", "2001:db8:0:1:1:1:1:1", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "a:b:c:d:e:f:10:200", "0:0:1::", "10::a0:0:0:1"]
    rows = [(t, bytearray(ipaddress.IPv6Address(t).packed)) for t in texts]
    got = {r.t: r.x for r in spark.createDataFrame(rows, "t string, ip binary").select("t", exprs.ipv6_text(F.col("ip")).alias("x")).collect()}
    # One zero group stays as it is; of equal runs the first is shortened.
    assert got == {t: ipaddress.IPv6Address(t).compressed for t in texts}
    r = spark.range(1).select(
        exprs.format_duration(F.lit(500)).alias("a"), exprs.format_duration(F.lit(0)).alias("b"), exprs.format_uptime(F.lit(3661)).alias("c"), exprs.format_bytes(F.lit(3 << 30)).alias("d"), exprs.format_packets(F.lit(9999)).alias("e"),
        exprs.format_number(F.lit(1234567.891)).alias("f"), exprs.icmp_type_code(F.lit(0x0301), True).alias("g"), exprs.service_class(F.lit(0xB8)).alias("h"), exprs.format_pps(F.lit(12)).alias("i"), exprs.relative_time(F.lit(0), 90_000).alias("j"),
    ).first()
    assert tuple(r) == ("0.5s", "0s", "1h 1m 1s", "3.00 GB", "9,999", "1,234,567.89", "Host Unreachable (3/1)", "EF (184)", "12 pps", "1m ago")


def test_approximate_aggregates_and_pages(spark):
    from flowlake.operators.histogram import page
    from flowlake.sources.flows import flows

    df = flows(spark, "/root/testdata/sf0.001")
    q = "2024-01-01..2024-02-01 | group by app | uniq(bytes), p95(bytes)"
    exact, near = ({r[0]: r for r in plan(q, df, approximate=a).collect()} for a in (False, True))
    assert all(abs(near[k][i] - exact[k][i]) <= 0.05 * exact[k][i] for k in exact for i in (1, 2))
    p = page("2024-01-01..2024-02-01 | select sysRowId, bytes", df, 10, count=True, columns=("sysRowId", "octetDeltaCount", "vlanId"))
    assert p.total == df.where("sysExportTime < 1706745600001").count() and p.rows.columns == ["sysRowId", "octetDeltaCount", "vlanId"] and p.has_more
    assert plan("2024-01-01..2024-02-01 | sort sum(bytes)", df).count() == p.total
