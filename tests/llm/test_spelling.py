"""Spelling variants and quality rules: brute force, planted cases, odd rows. Whole tables are compared with SQL."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from deskwise.llm import quality, spelling
from tests.llm.conftest import ODD


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1 :] or len(a) == len(b) and a[at + 1 :] == b[at + 1 :]


def words_of(rows):
    """What the definition says, run by run."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def variants_of(words):
    out = []
    for w, n in words.items():
        some = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = some[0][1] if some and -some[0][0] >= 2 * n else None
        out.append((w, form, n, len(some), words[form] if form else None))
    forms = {r[0]: r[1] for r in out}

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, form, root(w), *rest) for w, form, *rest in out)


@pytest.mark.parametrize("most", [1, 4, 64])
def test_near_pairs(spark, most):
    """Words of few letters, so that chunks are crowded and opened down to single letters."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(300)} | {"prefix" + c + d for c in "abcdefgh" for d in "xyzé"} | {"x" * n for n in range(5, 12)}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = sorted((r["a"], r["b"]) for r in spelling.near_pairs(frame, most).collect())
    ordered = sorted(words, key=lambda w: (len(w), w))
    assert pairs == sorted((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if near(a, b))


def test_variants(spark):
    rng = random.Random(1)
    stock = ["receive", "recieve", "receve", "straße", "strase", "stras", "strasse", "WORDS", "words", "wordz", "çaaaa", "çaaab", "×÷×÷×"]
    rows = [(rng.choice([None, *range(400)]), " ".join(rng.choices(stock, [60, 9, 3, 20, 8, 4, 2, 30, 30, 5, 4, 4, 3], k=rng.randrange(0, 40)))) for _ in range(500)] + list(ODD)
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    found = spelling.variants(frame)
    assert sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()) == variants_of(words_of(rows))
    assert spelling.variants(frame.limit(0)).count() == 0


def test_chains_of_forms(spark):
    rows = [(chr(97 + i) * 5, chr(98 + i) * 5 if i < 20 else None) for i in range(21)]
    ways = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert ways == {w: "uuuuu" for w, form in rows if form}


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None), (7, 1, None), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in quality.trusted(labels).collect()) == [1, 10]
    found = quality.judged(odd, quality.weights(odd, labels)).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    for i in (4, 5, 6):
        assert (by_id[i]["n_words"], by_id[i]["n_grams"], by_id[i]["base_failed"], by_id[i]["kept"]) == (0, 0, True, False)
    assert by_id[7]["n_words"] == 30_001 and by_id[7]["n_repeat_words"] == 30_000 and by_id[7]["base_failed"]
    assert by_id[10]["n_dup_lines"] == 1 and by_id[9]["n_symbols"] >= 0
    empty = quality.weights(odd.limit(0), labels)
    assert not empty.any() and quality.judged(odd.limit(0), empty).count() == 0
    assert not quality.weights(odd, labels.limit(0)).any()


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.randrange(5) for _ in range(rng.randrange(0, 30))]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        assert quality._repeated(np.array(words, np.int64)) == len(covered)


def test_noise_goes_and_prose_stays(spark):
    """Unlabelled texts: prose as in trusted documents stays, shouting and strings of symbols go."""
    rng = random.Random(4)
    stock = [f"word{i}" for i in range(300)]
    prose = lambda: " ".join(rng.choices(stock, k=120))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(stock, k=120))
    texts = [prose() for _ in range(400)] + [bad() for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(500) if i % 2], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.judged(docs, quality.weights(docs, labels)).where("kept").collect()}
    assert kept == set(range(400))
