"""Series for tests and plain Python versions of the operators."""

import datetime as dt
import math
import random

START = dt.datetime(2006, 10, 2)


def series_rows(sizes, seed=1, locations=("a", "b", "c"), minutes=15, top=50):
    """(site_id, location, ts, flow) with the given number of rows per site; several approaches share a timestamp."""
    random.seed(seed)
    rows = []
    for site, size in sizes.items():
        slots = [(t, loc) for t in range(math.ceil(size / len(locations)) * 2) for loc in locations]
        for t, loc in sorted(random.sample(slots, size)):
            rows.append((site, loc, START + dt.timedelta(minutes=minutes * t), float(random.randint(0, top))))
    random.shuffle(rows)
    return rows


SERIES = "site_id string, location string, ts timestamp_ntz, flow double"


def brute_windows(rows, length, share=0.7, margin=10):
    """{(site, location, ts): (idx, split, lags oldest first, y)} with scaled values, one site at a time."""
    out = {}
    for site in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == site), key=lambda r: (r[2], r[1]))
        n = len(own)
        if n < length + margin:
            continue
        flows = [r[3] for r in own]
        lo, span = min(flows), (max(flows) - min(flows)) or 1.0
        scaled = [(x - lo) / span for x in flows]
        cut = min(max(int((n - length) * share), 1), n - length - 1)
        for i in range(length, n):
            idx = i - length + 1
            split = "train" if idx <= cut else "test"
            out[(site, own[i][1], own[i][2])] = (idx, split, scaled[i - length : i], scaled[i])
    return out
