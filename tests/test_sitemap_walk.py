import random
from datetime import datetime, timedelta

import pytest

from newsloom.operators import crawl


def walk(roots, children, urls, max_pages, limit):
    """The same with a list, one map after the other."""
    queue, seen, got = list(roots), [], 0
    while queue and len(seen) < limit and got < max(3 * max_pages, 100):
        at = queue.pop(0)
        if at in seen:
            continue
        seen.append(at)
        got += urls.get(at, 0)
        found = sorted(children.get(at, []), key=lambda c: ("news" not in c[0].lower(), -(c[1].timestamp() if c[1] else 0)))
        queue[:0] = [c[0] for c in found]
    return seen


@pytest.mark.parametrize("limit", [25, 6])
def test_walk_equals_a_sequential_one(spark, limit):
    rng = random.Random(limit)
    roots, edges, sizes, want = [], [], [], {}
    for run in range(30):
        names = [rng.choice(["map", "News"]) + str(i) for i in range(rng.choice([1, 5, 40]))]
        first = rng.sample(names, min(2, len(names)))
        kids = {}
        for name in names:
            # cycles and maps with several parents
            kids[name] = [(c, rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(4))])) for c in rng.sample(names, rng.randrange(min(4, len(names) + 1)))]
        urls = {n: rng.choice([0, 10, 60]) for n in names if rng.random() < 0.9}
        roots += [(run, n, i) for i, n in enumerate(first)]
        edges += [(run, p, c, t, i) for p, found in kids.items() for i, (c, t) in enumerate(found)]
        sizes += [(run, n, k) for n, k in urls.items()]
        want[run] = walk(first, kids, urls, 40, limit)
    got = crawl.sitemap_walk(
        spark.createDataFrame(roots, "run long, map string, pos int"),
        spark.createDataFrame(edges, "run long, parent string, map string, lastmod timestamp, pos int"),
        spark.createDataFrame(sizes, "run long, map string, urls long"),
        40,
        limit,
    )
    by_run = {}
    for r in sorted(got.collect()):
        by_run.setdefault(r.run, []).append((r.visit, r.map))
    assert {run: [m for _, m in sorted(v)] for run, v in by_run.items()} == want
    assert all([n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in by_run.values())
