"""Items under shared caps, against one candidate after the other."""

import random
from collections import Counter

from pyspark.sql import functions as F

from deskwise.operators import mining


def in_turn(candidates, capacity):
    left, out = dict(capacity), []
    for place, resources in sorted(candidates):
        if all(left.get(r, 0) > 0 for r in set(resources)):
            for r in set(resources):
                left[r] -= 1
            out.append(place)
    return out


def test_accepted_is_the_sequence(spark):
    draw = random.Random(7)
    for trial in range(4):
        resources = [f"r{i}" for i in range(6)]
        candidates = [(f"p{i:03d}", draw.sample(resources, draw.choice((1, 2, 2, 3)))) for i in range(40)]
        capacity = [(r, draw.randrange(0, 6 + 4 * trial)) for r in resources[: 6 - trial % 2]]
        found = mining.accepted(spark.createDataFrame(candidates, "place string, resources array<string>"), spark.createDataFrame(capacity, "resource string, units int"))
        assert sorted(r["place"] for r in found.collect()) == in_turn(candidates, capacity)


def test_caps_and_targets(spark):
    draw = random.Random(3)
    chunks = spark.createDataFrame([(f"c{i}", i % 6 if i != 11 else None, f"text {i}" if i != 4 else None) for i in range(14)], "id string, full_doc_id long, content string")
    names = spark.createDataFrame([(f"e{draw.randrange(12)}", f"c{draw.randrange(14)}") for _ in range(60)] + [("noise", f"c{i}") for i in range(14)], "entity string, chunk_id string")
    noise, disciplines = spark.createDataFrame([("noise",)], "entity string"), spark.createDataFrame([(0,), (1,), (1,)], "full_doc_id long")
    for targets in ({"cross_document": 50, "discipline": 50, "conditional": 5, "direct": 50}, {"cross_document": 3, "direct": 2}):
        found = mining.mine_dataset(chunks, names, noise, disciplines, targets).collect()
        of = {c: [r for r in found if r["category"] == c] for c in mining.CATEGORIES}
        assert all(len(of[c]) <= targets.get(c, 0) for c in of)
        uses = Counter(i for r in found for i in r["chunk_ids"])
        assert max(uses.values()) <= 3 and "c11" not in uses
        assert max(Counter(e for r in of["cross_document"] for e in r["entities"]).values()) <= 2
        assert all(r["doc_ids"][0] != r["doc_ids"][1] and "noise" not in r["entities"] for r in of["cross_document"])
        assert all(n <= 3 for n in Counter(r["doc_ids"][0] for r in of["discipline"]).values()) and {r["doc_ids"][0] for r in of["discipline"]} <= {0, 1}
        assert len({r["id"] for r in found}) == len(found)
        whose = {r["id"]: r["full_doc_id"] for r in chunks.collect()}
        assert all([whose[i] for i in r["chunk_ids"]] == list(r["doc_ids"]) for r in found)
        if targets["direct"] == 50:
            # Whatever could still be used was used: each chunk three times, or once as a direct item.
            direct = {r["chunk_ids"][0] for r in of["direct"]}
            assert all(c in direct or uses[c] == 3 for c, doc in whose.items() if doc is not None)


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    found = mining.mine_dataset(none("id string, full_doc_id long, content string"), none("entity string, chunk_id string"), none("entity string"), none("full_doc_id long"), dict.fromkeys(mining.CATEGORIES, 5))
    assert found.where(F.col("id").isNotNull()).count() == 0
