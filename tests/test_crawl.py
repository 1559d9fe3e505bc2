"""Crawling in order and pages below roots, against plain walks."""

import random
from collections import deque

import pytest

from deskwise.operators import ingest


def walk(links, seeds, most, per_page):
    """One page after the other, each adding its first links that are new to the queue."""
    queue, known, visited = deque(sorted(seeds)), set(seeds), []
    while queue and len(visited) < most:
        url = queue.popleft()
        visited.append(url)
        added = 0
        for link in links.get(url, []):
            if added < per_page and link not in known and "skip" not in link:
                known.add(link)
                queue.append(link)
                added += 1
    return visited


@pytest.mark.parametrize(("per_page", "most"), [(2, 10**6), (3, 25), (100, 10**6)])
def test_frontier_is_that_of_a_queue(spark, per_page, most):
    draw = random.Random(per_page * most)
    pages = [f"https://a.org/{i}" for i in range(60)] + ["https://a.org/skip"]
    links = {p: draw.sample(pages, draw.randrange(9)) for p in pages}
    links[pages[0]] = pages[1:40]  # one page, and others of its level, want the same
    links[pages[1]] = pages[1:40]
    links[pages[2]] = list(reversed(pages[1:40]))
    rows = [(p, n, x + draw.choice(["", "#top", "?q=1"])) for p, several in links.items() for n, x in enumerate(several)]
    rows += [(pages[0], 100, "https://b.org/1"), (pages[0], 101, None), (None, 0, pages[5])]
    seeds = [pages[0], pages[1]]
    found = ingest.crawl_frontier(spark.createDataFrame(rows, "url string, pos int, link string"), spark.createDataFrame([(s,) for s in [*seeds, None]], "url string"), most, exclude="skip", per_page=per_page)
    assert [r["url"] for r in found.orderBy("place").collect()] == walk(links, seeds, most, per_page)


def test_frontier_without_seeds(spark):
    links = spark.createDataFrame([("https://a.org/1", 0, "https://a.org/2")], "url string, pos int, link string")
    assert ingest.crawl_frontier(links, spark.createDataFrame([], "url string"), 10).collect() == []


def below(edges, roots):
    seen, waiting = {r for r, _ in roots}, [r for r, children in roots if children]
    met = set()
    while waiting:
        page = waiting.pop()
        if page not in met:
            met.add(page)
            waiting += [c for p, c in edges if p == page]
    return seen | met


@pytest.mark.parametrize("kind", ["forest", "cycles", "graph"])
def test_pages_below(spark, kind):
    draw = random.Random(kind)
    n = 60
    if kind == "graph":
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(80)]
    else:
        edges = [(draw.randrange(c) if kind == "forest" else draw.randrange(n), c) for c in range(1, n) if draw.random() < 0.9]
    edges += [(None, 5), (3, None)]
    roots = [(draw.randrange(n), True), (draw.randrange(n), True), (draw.randrange(n), False), (1000, True)]
    found = ingest.descendants(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame(roots, "page_id long, with_children boolean"))
    assert sorted(r[0] for r in found.collect()) == sorted(below([(p, c) for p, c in edges if p is not None and c is not None], roots))


def test_a_chain_takes_few_rounds(spark):
    chain = spark.range(5000).selectExpr("id as parent", "id + 1 as child").unionByName(spark.createDataFrame([(6001, 6000), (6000, 6001)], "parent long, child long"))
    roots = spark.createDataFrame([(0, True)], "page_id long, with_children boolean")
    rounds = []

    def written(rows):
        rounds.append(1)
        return ingest.written(rows)

    assert ingest.descendants(chain, roots, written).count() == 5001
    assert len(rounds) - 2 <= 14
