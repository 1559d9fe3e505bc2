"""The operators where a part of the job was once left out."""

import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskwise.llm import groups, licenses, personal
from tests.llm import plain


@pytest.mark.parametrize("mark", ["", "# ", " * ", "dnl "])
def test_wrapped_notices(spark, mark):
    told = [(label, t) for label, several in licenses.TEMPLATES.items() for t in several]
    wrapped = ["Some text before it.\n" + textwrap.indent(textwrap.fill(t.capitalize() + ".", width), mark) + "\nSome text after it." for width in (30, 72) for _, t in told]
    rows = [*enumerate(wrapped), (900, "Text.\nAll rights reserved.\nText."), (901, "All of the rights\nare reserved for you."), (902, "One two.\nThree.")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(len(wrapped)):
        assert told[i % len(told)][0] in out[i]["labels"].split(",") and out[i]["score"] == 1
    assert [out[i]["labels"] for i in (900, 901, 902)] == ["all-rights-reserved", "", ""]


def test_every_run_is_searched():
    rng = np.random.default_rng(4)
    index = licenses.Index(licenses.TEMPLATES, {}, 0.7)
    vocabulary = [*sorted(index.rank), *(b"x%d" % i for i in range(20))]
    seen = 0
    for n in range(600):
        words = list(rng.choice(vocabulary, rng.integers(1, 80)))
        for _ in range(n % 3):
            at, chosen = rng.integers(0, len(words)), index.sets[rng.integers(0, len(index.sets))][1]
            words[at:at] = [t for t in sorted(chosen) if rng.random() < 0.9]
        every = {}
        for (label, own), width in zip(index.sets, index.widths, strict=True):
            most = max(len(own.intersection(words[i : i + width])) for i in range(len(words)))
            if most >= 0.7 * len(own) - 1e-9:
                every.setdefault(label, set()).add(most / len(own))
        found = {}
        for label, share in index.runs(words):
            found.setdefault(label, set()).add(share)
        assert found == every
        seen += len(every)
    assert seen > 300


def test_pair_at_the_threshold(spark):
    """36 shingles shared by sets of 37 and 44, of which one is in both prefixes, in groups that others lead."""
    run = lambda name, n: [f"{name}{i}" for i in range(n)]
    shared, u, v = run("s", 40), run("u", 39), run("v", 33)
    texts = [v + shared[:5] + run("f", 3), u + shared[:5] + run("e", 5), ["a", *shared], shared + run("b", 8)]
    for k in range(4):  # makes all shingles of the runs but the first one of shared frequent
        for name, piece in (("p", shared[1:21]), ("q", shared[17:]), ("r", u[:21]), ("t", u[17:]), ("w", v[:19]), ("x", v[15:])):
            texts.append(piece + run(f"{name}{k}-", 80))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert [len(plain.shingles(t)) for _, t in rows[:4]] == [37, 45, 37, 44]
    assert plain.components(rows)[3] == (3, 44, 2)
    found = groups.similar_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, found.collect())) == sorted(plain.components(rows))


def test_bound_of_a_group(spark):
    sizes = spark.range(1, 301).select(F.col("id").alias("n"), F.explode(F.sequence(F.floor((4 * F.col("id") + 4) / 5), F.floor(F.col("id") * 5 / 4))).alias("m"))
    each = sizes.select("n", "m", groups._least(F.col("n"), F.col("m")).alias("least")).collect()
    least = {(r["n"], r["m"]): r["least"] for r in each}
    ranges = sizes.join(sizes.withColumnRenamed("m", "hi"), "n").where("m <= hi")
    for r in ranges.select("n", "m", "hi", groups._group_least(F.col("n"), F.col("m"), F.col("hi")).alias("bound")).collect():
        assert r["bound"] <= min(least[r["n"], m] for m in range(r["m"], r["hi"] + 1))


def test_bound_of_large_groups():
    """The same rule in integers, for sizes up to 1,500 and every range that a step of sizes can hold."""
    needed = lambda n: (4 * n + 4) // 5
    least = lambda n, m: -(-4 * (n + m) // 9) - max(needed(n) - 1, needed(m) - 1)
    for n in range(1, 1501):
        low, high = needed(n), n * 5 // 4
        values = [least(n, m) for m in range(low, high + 1)]
        for a in range(low, high + 1):
            most = values[a - low]
            for b in range(a, min(high, int(a * groups.STEP) + 1) + 1):
                most = min(most, values[b - low])
                assert min(least(n, min(a, n)), least(n, max(b, n)), least(n, max(b - 1, n))) <= most


@pytest.mark.parametrize("before", ["contact=", "contact,", 'x"', "it's ", "id#", "a[b]", "é", "\u8bf7\u8054\u7cfb", "name=ann;" * 30, "x" * 100 + "=", "me@example.org,"])
def test_identifiers_inside_tokens(before):
    text = before + "0612345678" + ";" + "y" * 100
    at = len(before)
    assert personal.candidates(text, personal.base_spans(text)) == [(at, at + 10)]


def test_contexts_are_learnt_inside_tokens(spark):
    rows = [(i, f"Please write to contact mail:\nuser{i}@host{i}.example.org or leave {i}") for i in range(20)]
    rows = [(i, f'{{"kind":"contact","mail":"user{i}@host{i}.example.org"}} {i}') for i in range(20)] + [(30, '{"kind":"contact","mail":"user7(at)host7"}' + ',{"k":"' + "v" * 90 + '"}')]
    out = {r["doc_id"]: r for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[30]["spans"] == "email:26:40" and out[30]["n_added"] == 1
    assert all(out[i]["n_added"] == 0 for i in range(20))
