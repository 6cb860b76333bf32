"""Click-to-sale attribution against brute force, with clients of one cell and clients dealt by the hour."""

import datetime as dt
import random
import zlib
from collections import Counter

import pytest

from fathom.llm import attribution
from fathom.llm.attribution import DAY, END, HOUR, Rules

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, batch int, part string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, cell string, n long"
START = dt.datetime(2024, 1, 1)


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def expected(clicks, sales, number):
    """What the contract says, a row at a time."""
    late_by = lambda key: 240 if key is not None and zlib.crc32(str(key).encode()) % 4 == 0 else 0
    once = {}
    for c in clicks:
        if c[1] is not None and c[3] is not None:
            once.setdefault(c[0], (us(c[1]), us(c[2]) // HOUR + late_by(c[0]), c[3]))
    kept = [(s[0], s[1], us(s[2]), us(s[3]) // HOUR + late_by(s[0])) for s in sales if s[1] is not None and s[2] is not None]
    hours = [h for _, h, _ in once.values()] or [0]
    lo, hi = min(hours), max(hours)
    cut = lambda h: max(0, min(number - 1, number * (h - lo) // (hi - lo + 1))) if once else 0
    in_clicks = [[(at, i, client) for i, (at, h, client) in once.items() if cut(h) == k] for k in range(number)]
    in_sales = [[s for s in kept if cut(s[3]) == k] for k in range(number)]
    seen_c, seen_s, held_c, held_s, out = [], [], [], [], []
    for k in range(number + 1):
        w = END if k == number else min(max(seen_c), max(seen_s)) - DAY if seen_c and seen_s else None
        new_c, new_s = (in_clicks[k], in_sales[k]) if k < number else ([], [])
        held_c += [c for c in new_c if w is None or c[0] >= w]
        out += [(s[0], k, True, None, 0) for s in new_s if w is not None and s[2] < w]
        held_s += [s for s in new_s if w is None or s[2] >= w]
        if w is not None:
            for s in held_s:
                if s[2] < w:
                    own = [(at, -1 if i is None else i) for at, i, client in held_c if client == s[1] and s[2] - 7 * DAY <= at <= s[2]]
                    last = max(own)[1] if own else None
                    out.append((s[0], k, False, None if last == -1 else last, len(own)))
            held_s = [s for s in held_s if s[2] >= w]
            held_c = [c for c in held_c if c[0] >= w - 7 * DAY]
        seen_c += [c[0] for c in new_c]
        seen_s += [s[2] for s in new_s]
    return Counter(out)


def made(seed, n, days, clients):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.03 else x
    at = lambda: START + dt.timedelta(days=r.random() * days) if r.random() < 0.7 else START + dt.timedelta(hours=r.randrange(24 * days))
    late = lambda t: t + dt.timedelta(seconds=r.choice([1, 5, 4000, 200_000, 900_000]))
    clicks, sales = [], []
    for i in range(n):
        t, client = at(), 0 if r.random() < 0.4 else r.randrange(1, clients)
        clicks.append((i + 2**60, some(t), late(t), some(client), "x", 1, "y"))
        if i % 2 == 0:
            t = at()
            sales.append((i, some(client), some(t), late(t), "z", 3))
    clicks += [*clicks[:20], (None, START + dt.timedelta(days=1), START + dt.timedelta(days=1), 0, "x", 1, "y")]
    sales += [*sales[:10], (None, 0, START + dt.timedelta(days=1, hours=1), START + dt.timedelta(days=1, hours=1), "z", 3)]
    r.shuffle(clicks)
    return clicks, sales


def run(spark, clicks, sales, number, rules=Rules()):
    found = attribution.attributed(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), number, rules)
    return Counter((r.sale_id, r.batch, r.late, r.click_id, r.n_clicks) for r in found.collect())


@pytest.mark.parametrize("rules", [Rules(), Rules(cell_rows=60, hot_share=1 / 1000)])
def test_against_brute_force(spark, rules):
    clicks, sales = made(3, 1200, 40, 30)
    wanted = expected(clicks, sales, 4)
    assert len({k[1] for k in wanted}) == 4 and any(k[2] for k in wanted)
    assert run(spark, clicks, sales, 4, rules) == wanted


def test_empty_batches_and_one_input(spark):
    clicks, sales = made(5, 60, 1, 3)
    far = START + dt.timedelta(days=90)
    clicks.append((7, far, far, 1, "x", 1, "y"))
    assert run(spark, clicks, sales, 3) == expected(clicks, sales, 3)
    assert run(spark, [], sales, 2) == expected([], sales, 2)
    assert not run(spark, clicks, [], 2)


def test_watermark_counts_microseconds(spark):
    """A sale one microsecond before the watermark closes, one at it doesn't; both lie in one millisecond."""
    mark = START + dt.timedelta(days=10, microseconds=501)
    top = mark + dt.timedelta(days=1)
    old = lambda i: START + dt.timedelta(hours=i)
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4]
    clicks = [(ids[0], top, old(0), 1, "x", 1, "y"), (ids[1], mark, old(100), 1, "x", 1, "y"), (ids[2], mark, old(101), 2, "x", 1, "y")]
    sales = [(ids[0], 1, top, old(0), "z", 3), (ids[1], 1, mark - dt.timedelta(microseconds=1), old(0), "z", 3), (ids[2], 1, mark, old(0), "z", 3), (ids[3], 2, mark - dt.timedelta(microseconds=1), old(100), "z", 3)]
    wanted = expected(clicks, sales, 2)
    assert wanted[ids[1], 1, False, None, 0] and wanted[ids[2], 2, False, ids[1], 1] and wanted[ids[3], 1, True, None, 0]
    assert run(spark, clicks, sales, 2) == wanted
