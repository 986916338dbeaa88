import pytest

from flowlake.plans.ast import Agg, And, Group, Key, Not, Or, QueryError, Select, Sort, Test as Leaf, Top
from flowlake.plans.fql import lex, parse
from flowlake.plans.structured import from_json


@pytest.mark.parametrize("text,bounds", [
    ("", (6_400_000, 10_000_000)), ("last 1h", (6_400_000, 10_000_000)), ("last 1h offset 1h", (2_800_000, 6_400_000)), ("last 1h30m", (4_600_000, 10_000_000)),
    ("1970-01-02", (86_400_000, 172_799_999)), ("1970-01-02..1970-01-03", (86_400_000, 172_800_000)), ("at 1970-01-02T00:00 +-5m", (86_100_000, 86_700_000)),
    ("at 1970-01-02T00:00 +10m", (86_400_000, 87_000_000)), ("at 1970-01-02T00:00 -1m", (86_340_000, 86_400_000)), ("at 1970-01-02 00:00", (86_100_000, 86_700_000)),
    ("1970-01-02T00:00:00Z..1970-01-02T00:00:01.500Z", (86_400_000, 86_401_500)),
])
def test_time(text, bounds):
    assert parse(text).time.bounds(10_000_000) == [bounds]


def test_combined_and_recurring():
    assert len(parse("(last 1h, last 1h offset 1d)").time.bounds(0)) == 2
    t = parse("last 7d weekly mon 08:00..17:00").time
    assert (t.daily, t.weekday) == ((480, 1020), 0)


def stage(text):
    return parse(f"last 1h | {text}").stages[0]


def test_precedence_and_leaves():
    assert isinstance(stage("dport 1 or dport 2 and not proto tcp"), Or)
    assert isinstance(stage("(dport 1 or dport 2) AND NOT proto tcp"), And)
    assert stage("src not 10.0.0.0/8") == Leaf(("src",), "ip", ("10.0.0.0/8",), True)
    assert stage("not src 1.1.1.1") == Not(Leaf(("src",), "ip", ("1.1.1.1",)))
    assert stage("dport 80-90,443,1024-,dns").values == ((80, 90), (443, 443), (1024, 65535), (53, 53))
    assert stage("proto tcp, udp, 47").values == (6, 17, 47)
    assert stage("bytes > 1M").values == (1_000_000,)
    assert stage("bytes > 2Ki").values == (2048,)
    assert stage('app !~ "a|b"') == Leaf(("app",), "~", ("a|b",), True)
    assert stage("vlan not in (10, 20)") == Leaf(("vlan",), "in", ("10", "20"), True)


def test_stages():
    assert stage("group by src /24, 5m, dport | sum(bytes), count()") == Group((Key("src", 24), Key(seconds=300), Key("dport")), (Agg("sum", "bytes"), Agg("count")))
    assert stage("group by dst/24") == Group((Key("dst", 24),))
    assert stage("top 10 by sum(bytes)") == Top(10, Agg("sum", "bytes"))
    assert stage("bottom 3 by count()") == Top(3, Agg("count"), True)
    assert not stage("sort sum(bytes)").descending and stage("sort sum(bytes) desc").descending
    assert stage("select * except (src, dst)") == Select(star=True, without=("src", "dst"))
    item = stage("select bytes / packets as bpp").items[0]
    assert (item.left, item.op, item.right, item.alias) == ("bytes", "/", "packets", "bpp")


@pytest.mark.parametrize("text", ["src 1.1.1.1", "last 1h | group by src | limit 10", "last 1h | bytes > 1.5M", "last 1h | bytes > 3q", "last 1h | top x by sum(bytes)", "last 1h | dport", 'last 1h | app = "x', "last 1h |", "last q"])
def test_errors_have_positions(text):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert 0 <= e.value.position <= len(text)


def test_lexer():
    assert [t for _, t, _ in lex('a# note\n "x\\n\\"y" >= 1..2')] == ["a", 'x\n"y', ">=", "1", "..", "2"]


def test_json():
    q = from_json({"time_range": {"type": "relative", "duration": "2h"}, "logic": "or", "filters": [{"field": "src", "op": "cidr", "value": "10.0.0.0/8"}, {"field": "bytes", "op": "between", "value": [1, 2], "negated": True}], "aggregate": {"type": "sort", "function": "sum", "field": "bytes"}})
    assert q.time.seconds == 7200 and isinstance(q.stages[0], Or) and q.stages[1] == Sort(Agg("sum", "bytes"), True)
    with pytest.raises(QueryError):
        from_json({"filters": [{"field": "dport", "op": "contains", "value": "8"}]})
    with pytest.raises(QueryError):
        from_json({"filters": [{"field": "x", "op": "nope", "value": 1}]})
