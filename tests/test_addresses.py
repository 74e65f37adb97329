"""Countries of addresses against a plain search, and ranks against a sort."""

import ipaddress
import random

from pyspark.sql import functions as F

from veilcount.functions.ranks import ranked
from veilcount.operators import addresses, settle


def plain(ip, ranges):
    def number(x):
        try:
            own = ipaddress.ip_address(int(x) if x.isdigit() else x)
        except ValueError:
            return None
        own = getattr(own, "ipv4_mapped", None) or own
        return own.version, int(own)

    own, best = number(ip) if ip and not ip.isdigit() else None, None
    for first, last, country in ranges:
        a, b = number(first), number(last)
        if own and a and b and a[0] == b[0] == own[0] and a[1] <= own[1] <= b[1]:
            key = (a[1], -b[1], [-ord(c) for c in country])
            best = max(best, (key, country)) if best else (key, country)
    return best and best[1]


def test_cells_cover_a_range_once():
    random.seed(2)
    for size in (1, 2, 3):
        top = 256**size
        for _ in range(60):
            a, b = sorted(random.randrange(top) for _ in range(2))
            a, b = random.choice(((a, b), (0, b), (a, top - 1), (a, a), (a // 256 * 256, b | 255)))
            found = []
            for depth, prefix, low, high in addresses.cells(a, b, size):
                unit = 256 ** (size - depth - 1)
                assert 0 <= low <= high <= 255
                found.append(((prefix * 256 + low) * unit, (prefix * 256 + high + 1) * unit))
            assert found[0][0] == a and found[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(found, found[1:], strict=False))


def test_nested_ranges_of_both_families(spark):
    random.seed(3)
    four = lambda n: str(ipaddress.IPv4Address(n))
    six = lambda n: str(ipaddress.IPv6Address(n))
    base = (0x20010DB8 << 96) + 5
    ranges = [("0.0.0.0", "255.255.255.255", "all"), (four(2**31), four(2**31), "one"), ("::", six(2**128 - 1), "six"), ("9.9.9.9", "1.1.1.1", "backwards"), ("bad", "1.1.1.1", "bad"), ("1.1.1.1", "::5", "mixed"), (str(2**24), str(2**24 + 300), "number")]
    for i in range(300):
        a = random.randrange(2**32)
        ranges.append((four(a), four(min(2**32 - 1, a + 2 ** random.randint(0, 28))), f"c{i % 9}"))
        a = base + random.randrange(2**40)
        ranges.append((six(a), six(a + 2 ** random.randint(0, 70)), f"d{i % 9}"))
    ranges += [(r[0], r[1], "a same") for r in ranges[10:20]]
    asked = [x for r in ranges for x in r[:2]] + [four(random.randrange(2**32)) for _ in range(200)] + [six(base + random.randrange(2**41)) for _ in range(200)]
    asked += ["::ffff:128.0.0.0", "::FFFF:8000:0", "2001:DB8::5", "2001:db8:0:0:0:0:0:5", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "12345::", "256.1.1.1", "1.2.3", " 1.2.3.4 ", "", "g::1", "0:0:0:0:0:ffff:1.2.3.4", "::", "1::", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(asked)], "i int, ip string")
    table = spark.createDataFrame(ranges, "first string, last string, country string")
    nodes = addresses.address_nodes(table)
    got = {r["i"]: r["country"] for r in addresses.country_of_ip(df, nodes).collect()}
    for i, ip in enumerate(asked):
        assert got[i] == plain(ip.strip() if ip else ip, ranges), ip
    assert addresses.country_of_ip(df, table.where("false")).where("country is null").count() == len(asked)
    # one row for each event, however many ranges it lies in, and no generator or list search on the way
    plan = addresses.country_of_ip(df, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan


def test_ranks_of_large_groups(spark):
    random.seed(4)
    rows = [(random.choice(("hot", "hot", "hot", "b", None)), random.choice((1, 1, 2, 3, None)), f"w{i:04}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, w string").repartition(5)
    got = ranked(df, ["g"], [F.desc("x"), F.col("w")], "k").collect()
    for g in ("hot", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (-(r["x"] if r["x"] is not None else -9), r["w"]))
        assert [r["k"] for r in own] == list(range(1, len(own) + 1))


def test_cents_of_a_large_deal(spark):
    n = 5000
    given = spark.createDataFrame([(f"w{i:05}", "c", 1 + i % 3) for i in range(n)], "workspace_id string, cohort_key string, subject_count long")
    deals = spark.createDataFrame([("d", 3_333_337, 0, ["c"])], "deal_id string, gross_cents long, direct_cost_cents long, cohort_keys array<string>")
    paid, done = settle.settle(deals, given)
    got = {r["workspace_id"]: r["amount_cents"] for r in paid.collect()}
    pool, total = int(3_333_337 * 0.3), sum(1 + i % 3 for i in range(n))
    base = {f"w{i:05}": divmod(pool * (1 + i % 3), total) for i in range(n)}
    lucky = sorted(base, key=lambda w: (-base[w][1], w))[: pool - sum(q for q, _ in base.values())]
    assert got == {w: q + (w in set(lucky)) for w, (q, _) in base.items()}
    assert done.first()["pool_cents"] == pool == sum(got.values())


def test_blocks_of_cells_are_few():
    for low in range(0, 256, 3):
        for high in range(low, 256):
            own = addresses.blocks(low, high)
            covered = [i for b in own for k in [9 - b.bit_length()] for i in range((b << k) - 256, (b + 1 << k) - 256)]
            assert len(own) <= 14 and sorted(covered) == list(range(low, high + 1))


def test_both_families_in_one_join_for_each_depth(spark):
    """Addresses of the other family and none at all have keys of their own, so that they aren't one task's."""
    table = spark.createDataFrame([("1.2.3.4", "1.2.3.9", "a"), ("1.0.0.0", "1.255.255.255", "b"), ("::5", "::9", "c")], "first string, last string, country string")
    asked = spark.createDataFrame([(i, ip) for i, ip in enumerate(["1.2.3.4", "1.9.9.9", "::6", "::10", None, "bad", "2.2.2.2"])], "i int, ip string")
    out = addresses.country_of_ip(asked, addresses.address_nodes(table))
    assert [r["country"] for r in out.orderBy("i").collect()] == ["a", "b", "c", None, None, None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
