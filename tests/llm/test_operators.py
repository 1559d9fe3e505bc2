"""The operators on whole small tables, against brute force, SQL and exact round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deskwise.llm import bpe, decontaminate, groups, hosts, language, licenses, lines, packing, personal, shingles, spots, token_codes
from deskwise.llm.queries import ORACLES, QUERIES, tokenizer_path
from deskwise.sources.shared import fresh_path
from tests.compare import assert_same, duck
from tests.llm import plain
from tests.llm.conftest import BASE, ODD


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    found = QUERIES[name](spark, small)
    assert_same(found.collect(), found.columns, duck(small).sql(ORACLES[name]))


def test_jaccard_components(results, texts):
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in results("op1_jaccard_groups")) == sorted(plain.components(texts))


def test_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("x" + str(at) + w if i in at else w for i, w in enumerate(words))
    rows = [(i, edited(i)) for i in range(40)] + [(50 + i, edited(i, i + 30, 99 - i)) for i in range(20)] + [(90 + i, " ".join(words[:50]) + f" tail {i} " + " ".join(f"u{i}v{k}" for k in range(60))) for i in range(10)]
    found = groups.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(plain.components(rows))


def test_jaccard_odd(odd):
    key = lambda r: tuple((x is None, x) for x in r)
    found = sorted((tuple(r) for r in groups.similar_components(odd).collect()), key=key)
    assert found == sorted(plain.components(ODD), key=key)
    kept = groups.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 3 not in ids and ids.count(7) == 1 and {4, 5, 6, 8} <= set(ids)


def test_shingle_sets():
    rows = [t for _, t in ODD] + ["A b\x0bC d e", "a\u00a0b c"]
    sizes = [len(s) for s in shingles.sets(rows)]
    assert sizes == [len(plain.shingles(t)) for t in rows]
    a, b, c = shingles.sets(["a b c d", "A  B\tc D", "a b c d e"])
    assert a.tolist() == b.tolist() != c.tolist()


def test_personal_data(results, texts):
    by_id = dict(texts)
    for r in results("op2_personal_data"):
        spans = plain.personal(by_id[r["doc_id"]])
        told = ",".join(f"{plain.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r[f"n_{k}"] for k in plain.KINDS] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("text", ["a@b.c@d.e.f", "@@x@y.z", "a.b+c@-.-.", "1.2.3.4.5 256.1.1.1 0001.2.3.4 0000256.1.1.1", "4111-1111 1111--1111 4111111111111111", "+1 +12345678 9 (+1)(2)345 678-9.", "1" * 50 + "@" + "2" * 40 + ".3", "é+49 30 1234567 x"])
def test_personal_spans(text):
    assert personal.base_spans(text) == plain.personal(text)


def test_contexts_are_learnt(spark):
    rows = [(i, f"Please write to contact mail: user{i}@host{i}.example.org or leave {i}") for i in range(20)] + [(30, "Please write to contact mail: user7(at)host or 12345678 elsewhere"), (31, None)]
    out = {r["doc_id"]: r for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[30]["n_added"] == 1 and out[30]["spans"].startswith("email:30:")
    assert all(out[i]["n_added"] == 0 for i in (*range(20), 31))


def test_second_generation(spark):
    """Planted identifiers that no base pattern knows: the first ones stand after a context of base spans, the others
    only with contexts that hold discovered identifiers. Precision and recall over all that was planted."""
    rng = np.random.default_rng(9)
    name = lambda i: f"user{i}(at)host{i * 7}"
    rows = [f"Please write to contact mail: user{i}@host{i}.example.org or so {i}" for i in range(160)]
    rows += [f"Please write to contact mail: {name(i)} today" for i in range(24)]
    rows += [f"The form says reach-me handle = {name(i)} ;;; end of form" for i in range(24)]
    planted = [f"The form says reach-me handle = {name(i)} ;;; end of form" for i in (100, 101)]
    others = [f"Order {rng.integers(10**7, 10**8)} was sent {' '.join(rng.choice(['to', 'from', 'by', 'with'], 3))} {rng.integers(10**6, 10**7)} items" for _ in range(60)]
    texts = rows + planted + others
    out = {r["doc_id"]: r for r in personal.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rounds=3).collect()}
    added = {d: {s for s in r["spans"].split(",") if s} - {f"{plain.KINDS[k]}:{a}:{b}" for a, k, b in plain.personal(texts[d])} for d, r in out.items()}
    want = {d: {f"email:{t.index('user')}:{t.index('user') + len(t[t.index('user'):].split()[0])}"} if "(at)" in t else set() for d, t in enumerate(texts)}
    right = sum(len(added[d] & want[d]) for d in want)
    assert right / sum(map(len, added.values())) == 1 and right / sum(map(len, want.values())) == 1
    once = {r["doc_id"]: r["n_added"] for r in personal.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rounds=1).collect()}
    assert once[208] == once[209] == 0 and sum(once.values()) == 48


def test_personal_odd(spark, odd):
    out = personal.personal_data(odd).collect()
    assert len(out) == len(ODD) and all(r["n_added"] == 0 for r in out)
    assert sum(r["n_email"] for r in out) == 1
    assert personal.personal_data(odd.limit(0)).count() == 0


def test_token_codes(results, texts):
    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    for r, (doc_id, text) in zip(sorted(results("op3_token_codes")), texts, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_every_token_is_addressed(spark, odd):
    rng = np.random.default_rng(1)
    for ids in ([0], [255, 256, 65535, 65536, 1 << 31], rng.integers(0, 50_257, 5000), np.zeros(1024, int)):
        levels = token_codes.encode(np.array(ids))
        assert token_codes.decode(levels).tolist() == list(ids)
        assert [token_codes.token(levels, i) for i in range(len(ids))] == list(ids)
    path = fresh_path(spark, "codes")
    token_codes.write_codes(odd.where("doc_id in (1, 8)"), tokenizer_path(), path, block=8)
    wanted = spark.createDataFrame([(1, 0), (1, 3), (8, 1), (8, 2), (99, 0)], "doc_id long, position long")
    ids = {i: Tokenizer.from_file(tokenizer_path()).encode(t, add_special_tokens=False).ids + [0] for i, t in ODD if i in (1, 8)}
    found = {(r["doc_id"], r["position"]): r["token_id"] for r in token_codes.read_tokens(wanted, path).collect()}
    assert found == {(1, 0): ids[1][0], (1, 3): ids[1][3], (8, 1): 0, (8, 2): None, (99, 0): None}


def test_codes_of_odd_rows(spark, odd):
    """Null and repeated ids, empty and very long texts: every row is one document, in order of doc_id, null first."""
    tokenizer, path = Tokenizer.from_file(tokenizer_path()), fresh_path(spark, "codes")
    token_codes.write_codes(odd, tokenizer_path(), path)
    out = sorted(token_codes.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))
    crc = lambda t: zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted(map(str, ((r["doc_id"], r["ids_crc32"]) for r in out))) == sorted(map(str, ((d, crc(t)) for d, t in ODD)))
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1]]
    assert token_codes.read_tokens(spark.createDataFrame([(7, 29_999), (7, 10**9), (None, 0), (3, -1)], "doc_id long, position long"), path).where("token_id is not null").count() == 2
    empty = fresh_path(spark, "codes")
    token_codes.write_codes(odd.limit(0), tokenizer_path(), empty)
    assert token_codes.read_documents(spark, empty).count() == 0


def test_pieces_are_the_tokenizers():
    encoder = bpe.Encoder(tokenizer_path(), most=50)
    for text in [t for _, t in ODD] + ["It's  we'll\n\n x's 12ab' 'sé × ÷ ¿qué?", "  lead", "trail  ", "a\r\n\tb", "'s", " 's''ll"]:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids


def test_host_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://bad.example.com/{i}", "x") for i in range(30)] + [(90, None, "x"), (91, "no host", "x"), (92, "HTTP://GOOD.Example.org?q#f", "x"), (93, "a://b://c/d", "x")], "page_id long, url string, host string")
    judged = {r["page_id"]: r for r in hosts.judge(pages, [("example.com", "/", "block")]).collect()}
    assert judged[0]["rule"] == "example.com/" and judged[0]["verdict"] == "block"
    assert (judged[90]["host"], judged[90]["path"], judged[90]["verdict"]) == ("", "", "allow")
    assert (judged[92]["host"], judged[92]["path"]) == ("good.example.org", "")
    assert (judged[93]["host"], judged[93]["path"]) == ("b:", "//c/d")
    assert hosts.judge(pages.limit(0), []).count() == 0
    labelled = spark.createDataFrame([(f"h{i % 9}.bad.com", 1) for i in range(90)] + [(f"h{i % 9}.good.org", 0) for i in range(90)] + [("new.bad.com", 0)], "host string, bad int")
    bounds = {r["host"]: r["bound"] for r in hosts.reputations(labelled).collect()}
    assert bounds["h1.bad.com"] > bounds["new.bad.com"] > bounds["h1.good.org"]


def test_reputation_is_learnt(spark):
    """Labels that are given decide for pages that no rule fits, and for hosts without any label by domain and suffix."""
    rows = [(f"http://h{i % 5}.spam.co.uk/{i}", 1) for i in range(60)] + [(f"http://h{i % 5}.fine.co.uk/{i}", 0) for i in range(60)] + [(f"http://x{i}.bad/", 1) for i in range(30)]
    rows += [("http://new.spam.co.uk/", None), ("http://new.fine.co.uk/", None), ("http://other.bad/", None), ("http://nobody.knows/", None), ("http://h1.spam.co.uk/ok/1", None), (None, 1)]
    pages = spark.createDataFrame([(k, u, x, "y") for k, (u, x) in enumerate(rows)], "page_id long, url string, label int, own string")
    out = {r["url"]: r for r in hosts.judge(pages, [("spam.co.uk", "/ok/", "allow")], labels=F.col("label")).collect()}
    verdict = {u: r["verdict"] for u, r in out.items()}
    assert verdict["http://new.spam.co.uk/"] == verdict["http://other.bad/"] == verdict["http://h2.spam.co.uk/2"] == "block"
    assert verdict["http://new.fine.co.uk/"] == verdict["http://h1.spam.co.uk/ok/1"] == verdict[None] == verdict["http://nobody.knows/"] == "allow"
    without = hosts.judge(pages, [])
    assert without.columns == [*pages.columns, "host", "path", "rule", "verdict"] and without.where("verdict = 'block'").count() == 0


def test_decontamination(spark):
    item = " ".join(f"b{i}" for i in range(20))
    swapped = " ".join("zzz" if i in (4, 12) else f"b{i}" for i in range(20))
    rows = [(1, "before " + item.upper() + ", after"), (2, swapped), (3, " ".join(f"b{i}" for i in range(10))), (4, " ".join(f"b{i}" for i in range(13))), (5, None), (6, ""), (7, "long " * 5000 + item), (7, "long " * 5000 + item), (None, item), (8, " ".join(f"b{i}" if i % 3 else "q" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "not there"), (3, "exactly nine words make one short item here now")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["start"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(1, 0): (20, 1), (2, 0): (18, 0), (4, 0): (13, 0), (7, 0): (20, 5000), (None, 0): (20, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()) == [3, 5, 6, 8]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_short_items(spark):
    """Against brute force: items of 1 to 16 words, copied into texts with up to three words changed."""
    rng = np.random.default_rng(7)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in range(1, 17) for _ in range(4)] + [None, "", "?!"]
    docs = []
    for k in range(400):
        words = (items[k % 64] or "").split()
        for at in rng.integers(0, len(words), k // 64 % 4) if words else ():
            words[at] = "zz"
        docs.append(" ".join([f"x{x}" for x in rng.integers(0, 9, rng.integers(0, 9))] + words + ["w1"] * int(rng.integers(0, 2))))
    docs += [None, "", " \n", "w3 " * 20_000]
    frames = [spark.createDataFrame(list(enumerate(x)), f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id"))]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(*frames).collect()}
    assert found == plain.found_items(docs, items)
    assert len({j for _, j in found}) == 64
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(*frames).collect()}
    assert kept == set(range(len(docs))) - {i for i, j in found if len(items[j].split()) >= 4}


def test_only_the_contaminated_row_goes(spark):
    item = "these six words are the item"
    rows = [(None, f"x {item} y"), (None, "clean"), (1, f"{item}!"), (1, "clean too"), (2, "clean"), (3, None)]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, id long")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_every_changed_word_is_survived():
    fits = lambda n, gone: any(not gone & {o + k for k in m} for m in decontaminate.masks(n).values() for o in range((n if n >= decontaminate.LONG else m[-1] + 1) - m[-1]))
    assert all(fits(13, {i, j}) for i in range(13) for j in range(13))
    assert all(fits(n, {i}) for n in range(7, 13) for i in range(n))
    assert all(fits(n, set()) for n in range(1, 14))


def test_language(spark, results, small):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = results("op6_language")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)


def test_language_odd(spark, odd, small):
    model = language.train(language.training_rows(spark.read.parquet(f"{small}/documents.parquet")))
    out = [r for r in language.predict(odd, model).collect()]
    assert len(out) == len(ODD)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in out)
    noise = spark.createDataFrame([(1, "xqzj kvwq zzxk qjvx wkzq " * 20)], "doc_id long, text string")
    assert not language.predict(noise, model).first()["accepted"]
    numbers = np.arange(model.other + 1, dtype=np.uint64)
    probabilities = np.exp2(-model.bits(numbers | np.uint64(1 << 2 * language.BITS | 2 << language.BITS)))
    assert probabilities.sum(axis=1) == pytest.approx(1, abs=1e-3)
    assert {r["lang_pred"] for r in language.predict(odd, language.train(odd.limit(0))).collect()} == {"und"}


def test_models_are_kneser_ney(spark):
    """The arrays against a plain dictionary model, in letters of several scripts, more than a byte could number."""
    rng = np.random.default_rng(8)
    wide = "".join(chr(0x4E00 + x) for x in rng.zipf(1.3, 3000) % 900)
    rows = [(i, t, lang) for lang, texts in {"aa": ["abba cab, bad acab\n", "dab 12 a"], "zh": [wide[i : i + 300] for i in range(0, 3000, 300)]}.items() for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(3 * k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.alphabet) > 254
    used = {r["doc_id"] for r in docs.selectExpr("doc_id", "abs(xxhash64(doc_id) % 1000003) % 5 as f").where("f > 0").collect()}
    symbols = lambda t: ["\0"] * (language.ORDER - 1) + list(re.sub(r"[\W\d_]+", "\0", t + "\0"))
    for k, lang in enumerate(model.languages):
        p = plain.kneser_ney([symbols(t) for d, t, x in docs.collect() if x == lang and d in used], language.ORDER)
        text = "bad cab! " + wide[:40] + " \u00e9"
        told = symbols(text)
        bits = [-np.log2(p(c, told[:i], model.other + 1)) for i, c in enumerate(told) if i >= language.ORDER - 1]
        h, letters = model.entropies([text])
        assert h[k, 0] == pytest.approx(np.mean(bits), rel=1e-4) and letters[0] == sum(map(str.isalpha, text))


def test_line_dedup(results, texts):
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in results("op7_line_dedup")) == plain.deduped(texts)


def test_line_edits(spark):
    words = [f"w{i}" for i in range(14)]
    changed = [words[:i] + ["x"] + words[i + 1 :] for i in range(14)] + [words[:i] + words[i + 1 :] for i in range(14)] + [words[:i] + ["y"] + words[i:] for i in range(15)] + [words[:2] + ["p", "q"] + words[4:], words[::-1]]
    rows = [(0, " ".join(words))] + [(i + 1, " ".join(w)) for i, w in enumerate(changed)]
    found = lines.without_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found.collect()) == plain.deduped(rows)


@pytest.mark.parametrize(("least", "near"), [(1, 1), (1, 2), (2, 3), (1, 5)])
def test_lines_of_every_length(spark, least, near):
    rng = np.random.default_rng(near)
    line = lambda: "".join(rng.choice(["", " ", "\t"])) + " ".join(rng.choice(list("abc"), rng.integers(0, 8)))
    rows = [(i, "\n".join(line() for _ in range(rng.integers(0, 9)))) for i in range(60)]
    found = lines.without_repeated(spark.createDataFrame(rows, "doc_id long, text string"), least, near)
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found.collect()) == plain.deduped(rows, least, near)


def test_long_lines(spark):
    """Lines of up to 200 words with none, one or two edits anywhere, and other white space."""
    rng = np.random.default_rng(5)
    rows = []
    for n in [*range(5, 40), 47, 48, 49, 63, 64, 65, 66, 95, 96, 97, 127, 128, 129, 200]:
        words, line = [f"{n}w{i}" for i in range(n)], []
        for k in range(8):
            w = words[:]
            for _ in range(k % 3):
                i, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
                w[i : i + int(kind > 0)] = [f"x{k}"] if kind < 2 else []
            line.append(str(rng.choice(["", " ", "\t"])) + str(rng.choice([" ", "  ", " \t", "\r"])).join(w))
        rows.append((len(rows), "\n".join(line[j] for j in rng.permutation(8))))
    found = lines.without_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found.collect()) == plain.deduped(rows)


def test_long_lines_have_few_keys(spark, monkeypatch):
    """Lines of 2,001 words that are near once emitted 4,003 keys each."""
    emitted, written = [], lines.written

    def counted(df, name="step"):
        found = written(df, name)
        if name == "deletions":
            emitted.append(found.count())
        return found

    monkeypatch.setattr(lines, "written", counted)
    words = [f"w{i}" for i in range(2001)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:3] + ["x"] + words[4:]))]
    found = lines.without_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found.collect()) == plain.deduped(rows)
    assert len(emitted) == 1 and 0 < emitted[0] < 1000


def test_lines_of_one_id(spark):
    """100,000 texts without an id, whose numbers may be equal: each loses its own repeats and nothing else."""
    own = "concat_ws(' ', 'a' || {0}, 'b' || {0}, 'c' || {0}, 'd' || {0}, 'e' || {0}, '\n', 'x' || {0})".replace("'\n'", "'\\n'")
    texts = spark.range(100_000).selectExpr("cast(null as long) as doc_id", f"concat('short\n', {own.format('id')}) as text", "id as _document")
    out = lines.without_repeated(texts)
    assert out.columns == ["doc_id", "text", "_document", "n_lines", "n_removed"]
    assert out.where("n_removed = 1").count() == 99_999 and out.where("n_removed = 0").count() == 1
    assert out.where(f"n_removed = 1 and text = {own.format('_document')}").count() == 99_999


def test_lines_odd(odd):
    out = lines.without_repeated(odd.drop("n_lines")).collect()
    assert len(out) == len(ODD)
    texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in out}
    assert texts[None, 9] == BASE and texts[1, 0] == "" and texts[4, 3] is None and texts[5, 4] == "" and texts[6, 5] == " \n\t \n"
    assert texts[10, 13] == "MIT License"  # its first line repeats document 1's, and the second one the first
    assert texts[7, 6] == texts[7, 7] == ODD[6][1]  # the same row twice is one document


def test_licenses(results, texts):
    by_id = dict(texts)
    for r in results("op8_license_scan"):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.licensed(by_id[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_labels(results, texts):
    """Against all lines and all runs of each template's width."""
    sets = [(label, set(licenses.tokens(t)), 3 * len(licenses.tokens(t)) // 2) for label, several in licenses.TEMPLATES.items() for t in several]
    found = {r["doc_id"]: r for r in results("op8_license_scan")}
    for doc_id, text in texts:
        words, labels, score = licenses.tokens(text or ""), set(), 0.0
        for label, own, width in sets:
            if len(own.intersection(words)) < 0.9 * len(own):
                continue
            blocks = [licenses.tokens(line) for line in text.split("\n")] + [words[i : i + width] for i in range(len(words))]
            most = max(len(own.intersection(b)) for b in blocks) / len(own)
            if most >= 0.9 - 1e-9:
                labels.add(label)
                score = max(score, most)
        base = plain.licensed(text)[4]
        r = found[doc_id]
        assert r["labels"] == ",".join(sorted(labels | set(filter(None, base.split(","))))) and r["score"] == (1.0 if base else score)


def test_containment_join_is_exact(odd):
    rng = np.random.default_rng(2)
    index = licenses.Index(licenses.TEMPLATES, {}, 0.7)
    vocabulary = sorted(index.rank)
    for _ in range(2000):
        block = list(rng.choice(vocabulary, rng.integers(1, 30)))
        every = {(label, len(s & set(block)) / len(s)) for label, s in index.sets if len(s & set(block)) >= 0.7 * len(s) - 1e-9}
        assert set(index.matches(block)) == every
    out = licenses.scan(odd).collect()
    assert len(out) == len(ODD) and max(r["n_words"] for r in out) == 30_001
    assert licenses.scan(odd.limit(0)).count() == 0


def signature_sets(texts):
    also = lambda w: w not in spots.ANCHORS and xxhash.xxh3_64_intdigest(w.encode()) & 0b11110 == 0
    return [plain.spots(t, spots.ANCHORS, also) for t in texts]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_fingerprints(spark, results, texts):
    """Against plain sets of words: sizes, likeness, near duplicates, and equal fingerprints for equal sets alone."""
    found = {r["doc_id"]: r for r in results("op9_spot_signatures")}
    whole = [t for _, t in texts]
    order = sorted(range(len(texts)))
    after = [whole[(k + 1) % len(whole)] for k in order]
    edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(whole, after, strict=True)]
    own, changed = signature_sets(whole), signature_sets(edited)
    prints = {}
    for k, (doc_id, text) in enumerate(texts):
        r = found[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited[k].encode()).hexdigest())
        assert len(r["fingerprint"]) == 8 * len(own[k]) == 8 * r["n_signatures"] and len(r["edited_fingerprint"]) == 8 * len(changed[k])
        assert r["near_edited"] == jaccard(own[k], changed[k]) == spots.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == jaccard(own[k], own[(k + 1) % len(own)])
        assert prints.setdefault(r["fingerprint"], own[k]) == own[k]
    assert len(prints) == len(set(map(frozenset, own)))
    near = spots.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), near=True).collect()
    assert {r["doc_id"]: r["near_id"] for r in near} == {d: c for d, _, c in plain.joined([(d, s) for (d, _), s in zip(texts, own, strict=True)])}
    assert all(found[r["doc_id"]].asDict().items() <= r.asDict().items() for r in near)
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.5 > 0.05 > np.mean([r["near_next"] for r in found.values()])


def test_fingerprints_odd(spark, odd):
    out = spots.fingerprints(odd, near=True).collect()
    assert len(out) == len(ODD)
    assert sorted(r["n_chars"] for r in out) == sorted(len(t or "") for _, t in ODD)
    assert {r["near_id"] for r in out if r["doc_id"] in (4, 5)} == {4, 5} and all(r["fingerprint"] == "" for r in out if r["doc_id"] in (4, 5))
    assert spots.fingerprints(odd.limit(0)).count() == 0
    one = spots.fingerprints(odd.where("doc_id = 1")).first()
    assert one["n_chars"] == len(ODD[0][1]) and one["near_next"] == 1
    same = spark.createDataFrame([(None, f"text number {i} of none") for i in range(300)], "doc_id long, text string")
    assert spots.fingerprints(same).count() == 300


def packed_well(rows, tokens=1024):
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= tokens
    return len(at)


def test_packing(results, texts):
    rows, tokenizer, pieces = results("op10_best_fit_packing"), Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        for k, r in enumerate(mine):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    n = packed_well(rows)
    assert n <= 1.06 * sum(r["length"] for r in rows) / 1024 + 4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(3).integers(1, 60, 400)
    capacity = packing.Capacity(tokens=64, documents=4, attention=2500, rule=rule, weights=(1, 1, 1)) if rule == "norm" else packing.Capacity(64, 4, 3600, (1, 0.5, 0.5), "dot")
    lengths = np.minimum(lengths, int(capacity.attention**0.5))
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in set(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 64 and len(mine) <= 4 and (mine**2).sum() <= capacity.attention
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(mine[np.argsort(offsets[bins == b])])[:-1]]
    if rule == "norm":
        assert len(set(bins)) <= len(lengths)


def test_packing_odd(spark, odd):
    rows = packing.packed_documents(odd, tokenizer_path()).collect()
    packed_well(rows)
    assert {r["doc_id"] for r in rows} == {d for d, _ in ODD}
    assert packing.packed_documents(odd.limit(0), tokenizer_path()).count() == 0
