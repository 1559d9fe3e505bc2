"""Worked examples and properties of single operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from deskwise.functions import text as X
from deskwise.functions import urls as U
from deskwise.operators import analytics, evaluate, html, ingest, matching, retrieve, search, state
from deskwise.sources import io
from deskwise.sources.shared import fresh_path, written


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_fold_example():
    assert ingest.fold("Aaaa. Bbbb. Cccc.", 10, 3) == [("Aaaa. Bbbb.", 0, 10), ("Bbbb. Cccc.", 1, 10)]
    assert ingest.fold("", 10) == ingest.fold(None) == []
    assert ingest.fold("x" * 50, 10) == [("x" * 50, 0, 50)]  # a long line stays whole
    assert [c for c, _, _ in ingest.fold("aaaaaaaa\nbbbbbbbb\ncccccccc", 10, 5)] == ["aaaaaaaa", "bbbbbbbb", "cccccccc"]


def test_chunks_keep_order(spark):
    docs = spark.createDataFrame([(1, "One two. Three four. Five six."), (2, None), (3, " ")], "doc_id long, text string")
    rows = ingest.sentence_chunks(docs, 12, 0).orderBy("doc_id", "chunk_order_index").collect()
    assert [r["chunk_order_index"] for r in rows] == list(range(len(rows)))
    assert {r["doc_id"] for r in rows} == {1}


def test_metrics_example(spark):
    got = spark.createDataFrame([(1, k, i) for i, k in enumerate("xaab")], "query_id long, key string, pos int")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id long, key string")
    rows = {r["query_id"]: r for r in evaluate.per_query_metrics(got, truth).collect()}
    r = rows[1]
    assert (r["hit_rate@1"], r["mrr"], r["recall@3"], r["precision@5"]) == (0, 0.5, 1.0, 0.4)
    assert r["ndcg@5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert rows[2]["recall@10"] == 0
    assert r["recall@1"] <= r["recall@3"] <= r["recall@5"] <= r["recall@10"]


def test_bootstrap_is_the_same_again(spark):
    rows = spark.createDataFrame([(i, *([float(i % 2)] * 15)) for i in range(40)], ["query_id", *dict.fromkeys(["hit_rate@3", *evaluate.METRICS])])
    a, b = (sorted(evaluate.bootstrap_ci(rows, 100).collect()) for _ in range(2))
    assert a == b
    assert all(r["low"] <= r["mean"] <= r["high"] and r["high"] - r["low"] < 0.5 for r in a)


def test_fusion_examples(spark):
    kind = "query_id long, id string, pos int, freq long"
    entity = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 1)], kind)
    vector = spark.createDataFrame([(1, "a", 0, 1)], kind)
    relation = spark.createDataFrame([(2, "a", 0, 1)], kind)
    scores = {r["query_id"]: r["score"] for r in retrieve.rank_fusion(vector, entity, relation).collect()}
    assert scores == {1: pytest.approx(1.66), 2: pytest.approx(0.56)}


def test_topk_edges(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["id"], r["pos"]) for r in retrieve.vector_topk(queries, corpus).orderBy("query_id", "pos").collect()] == [(1, "a", 0), (1, "d", 1)]
    assert retrieve.vector_topk(queries.limit(0), corpus).count() == 0


def test_addresses(spark):
    assert one(spark, U.canonical_page("u"), u="https://h/p?pageId=12&x=1") == "page:12"
    assert one(spark, U.canonical_page("u"), u="https://h/download/attachments/12/a.pdf") == "page:12"
    normal = {"HTTP://www.Ex.org/a%20b/?q=1#f": "https://ex.org/a b?q=1", "": "", None: "", "http://a.org": "https://a.org/", "http://a.org/": "https://a.org/", "http://a.org//x//": "https://a.org/x", "http://[a": "http://[a"}
    for url, told in normal.items():
        assert one(spark, U.normalize_url("u"), u=url) == told
    titles = {"https://h/a/My_long-file.PDF?x=1": "My long file", "https://h/a/%D0%9F%D1%80-1.pdf": "Пр 1", "https://h/a/b//": "b", "https://h/50%": "50%", "": "Untitled", None: "Untitled", "https://h/a+b": "a+b"}
    for url, told in titles.items():
        assert one(spark, U.title_from_url("u"), u=url) == told


def test_sentences_and_items_of_lists():
    """Where sentences end, and items of a list, whatever white space stands around the line end."""
    parts = lambda text: [c for c, _, _ in ingest.fold(text, 1, 0)]
    assert parts("Нужно: \n — один;\n — два") == ["Нужно:", "Нужно: — один;", "— один; — два"]
    assert ingest.fold("Нужно: \n — один;\n — два", 500) == [("Нужно: — один; — два", 0, 18)]
    assert ingest.fold("One. Two? three! Four", 500) == [("One. Two? three! Four", 0, 19)]


def test_contexts(spark):
    rows = [(1, 0, " a ", "https://x"), (1, 1, "", "https://y"), (1, 2, "b", "https://z"), (1, 3, "c", "note"), (1, 4, "d", ""), (1, 5, "e", None), (1, 6, "f", "https://x"), (2, 0, None, "https://x")]
    got = spark.createDataFrame(rows, "query_id long, pos long, content string, file_path string")
    told = retrieve.assemble_context(got, 9).collect()
    assert [r["context"] for r in told] == ["Context:\na\n[Source 1]\n---\nb\n[Source 2]\n---\nc\nSource: note\n---\nd\n---\ne\n---\nf\n[Source 1]"]
    assert retrieve.assemble_context(got, 9, 30).first()["context"] == "Context:\na\n[Source 1]\n---\nb"
    formatted = {r["query_id"]: r["context"] for r in retrieve.format_context(got.where("pos > 1"), got.select("query_id").distinct()).collect()}
    assert formatted == {1: "Source 3: b\nURL: https://z\n\n---\n\nSource 4: c\nURL: note\n\n---\n\nSource 5: d\n\n---\n\nSource 6: e\n\n---\n\nSource 7: f\nURL: https://x", 2: "Nothing was found."}


def test_messages_without_content(spark):
    rows = spark.createDataFrame([(1, 1, "user", None), (1, 2, "assistant", "x"), (1, 3, "user", "y")], "session_id long, id long, role string, content string")
    assert {r["id"]: r["context"] for r in state.dialog_context(rows).collect()} == {1: "", 2: "User: ", 3: "User: \nAssistant: x"}


def test_search_of_strings(spark):
    """Against loops: strings of one and two characters, of characters beyond the basic plane, absent ones, nulls and blanks."""
    blocks = [(1, "Contacts", "Ünï 😀😁 office"), (2, None, "OFFICE hours"), (3, "hours", None), (4, "", ""), (5, "aaaa", "a" * 50_000)]
    asked = ["office", " ÜNÏ ", "😀", "😀😁", "h", "aa", "aaaaaaa", "absent", "", "  ", None, "hours", "offices"]
    frame = spark.createDataFrame(blocks, "block_id long, title string, text string")
    found = state.block_search(frame, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    expected = []
    for i, query in enumerate(asked):
        low = (query or "").strip().lower()
        some = [b for b, title, text in blocks if low and (low in (title or "").lower() or low in (text or "").lower())]
        expected += [(i, b) for b in some or [b[0] for b in blocks]]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert "NestedLoop" not in search.containing(frame.select("block_id", "text"), spark.createDataFrame([(1, "x")], "needle_id long, needle string"))._jdf.queryExecution().executedPlan().toString()


def test_approximate_search(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = rows.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in retrieve.vector_topk(queries, rows).collect()}
    found = retrieve.approximate_topk(queries, rows, tables=64).collect()  # few vectors, without neighbours
    assert len(exact & {(r["query_id"], r["id"]) for r in found}) >= 0.9 * len(exact)
    assert len(found) == len({(r["query_id"], r["id"]) for r in found})
    near = queries.unionByName(queries.select((F.col("query_id") + 1000).alias("query_id"), F.transform("embedding", lambda x: x * 1.01).cast("array<float>").alias("embedding")))
    best = {(r["query_id"], r["id"]) for r in retrieve.approximate_topk(near, rows, 1).collect()}
    assert best == {(r["query_id"], str(r["query_id"] % 1000)) for r in near.collect()}


def test_samples_gathered_and_shuffled(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(i, *(rng.random() for _ in evaluate.METRICS)) for i in range(40)], "query_id long, " + ", ".join(f"`{m}` double" for m in evaluate.METRICS))
    told = lambda held: sorted((r["metric"], round(r["mean"], 9), round(r["low"], 9), round(r["high"], 9)) for r in evaluate.bootstrap_ci(rows, 50, held=held).collect())
    assert told(40) == told(39)


def test_status_of_nothing(spark):
    facts = spark.createDataFrame([(1, None, None, None)], "answer_id long, answer string, admin_status_override string, relevance_type string")
    assert analytics.with_status(facts, spark.createDataFrame([], "answer_id long"), "none").first()["status"] == "no_status"


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("# Head\ntext", "Head\ntext"),
        ("**bold** and *it*", "bold and it"),
        ("`code` ```x\ny``` z", "code  z"),
        ("- a\n* b\n+ c", "a\nb\nc"),
        ("1. a\n22. b", "a\nb"),
        ("[t](https://u)", "t (https://u)"),
        ("<entity:7>x【3†src】", "x"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_markdown(spark, raw, plain):
    assert one(spark, X.clean_markdown("t"), t=raw) == plain


def test_links(spark):
    out = one(spark, X.extract_links("t"), t="Text\nПодробнее: <https://a.b/c>.\n[1] https://d.e/f\nReferences\n- [2] https://a.b/c\nsee <https://x.y>")
    assert out["links"] == ["https://a.b/c", "https://d.e/f"]
    assert out["text"] == "Text\nsee https://x.y>"


def test_cut(spark):
    assert one(spark, X.format_answer("t", 20), t="a" * 15 + "\n\n" + "b" * 30) == "a" * 15
    assert one(spark, X.format_answer("t", 20), t="a" * 12 + "\n" + "b" * 30) == "a" * 12
    assert one(spark, X.format_answer("t", 20), t="ab\n" + "b" * 40) == "ab\n" + "b" * 17


@pytest.mark.parametrize(
    ("raw", "kind", "query", "sure"),
    [
        ('{"type": 2, "expanded_query": "q", "confidence": 0.9}', 2, "q", 0.9),
        ('{"type": 9}', 1, "orig", 0.5),
        ('{"type": "2"}', 1, "orig", 0.5),
        ("nothing", 1, "orig", 0.5),
        ('```json\n{"type": 3, "expanded_query": " "}\n```', 3, "orig", 0.5),
        ('{"type": 1, "expanded_query": "' + "x" * 2000 + '"}', 1, "x" * 1500, 0.5),
        ("{broken}", 1, "orig", 0.5),
    ],
)
def test_classification(spark, raw, kind, query, sure):
    out = one(spark, X.parse_classification("r", "o"), r=raw, o="orig")
    assert (out["question_type"], out["expanded_query"], out["confidence"]) == (kind, query, sure)


@pytest.mark.parametrize(
    ("raw", "numbers", "answer", "stage"),
    [
        ('{"relevant_sources": [1, 3], "answer": "yes"}', [1, 3], "yes", "json"),
        ('```json\n{"answer": "a \\"b\\"", "relevant_sources": ["2", "x"]}\n```', [2], 'a "b"', "json"),
        ('relevant_sources: [4, 5]\nanswer: "plain"', [4, 5], "plain", "lines"),
        ('{"relevant_sources": [1], "answer": "cut off', [1], "cut off", "repaired"),
        ("just **text**", [], "just text", "text"),
    ],
)
def test_llm_json(spark, raw, numbers, answer, stage):
    out = one(spark, X.parse_llm_json("r"), r=raw)
    assert (out["relevant_sources"], out["answer"], out["stage"]) == (numbers, answer, stage)


def test_events(spark):
    row = spark.createDataFrame([("kb_qa", None, "bad", "answer", ["s1", "s2"]), (None, None, None, None, None)], "i string, c string, e string, a string, s array<string>")
    out = [[e["event"] for e in r["x"]] for r in row.select(X.answer_events("i", "c", "e", "a", "s").alias("x")).collect()]
    assert out == [["event", "thought", "thought", "error", "token", "source", "source", "done"], ["event", "thought", "done"]]


PAGE = """<html><title>T</title><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b></p><script>x</script><p>home</p></article>
<table><tr><th>#</th><th>Name</th></tr><tr><td>1</td><td>Ann</td></tr></table></body></html>"""


def test_html_profiles(spark):
    pages = spark.createDataFrame([("https://h/", PAGE), ("https://e/", None), ("https://b/", "<p>un<b>closed")], "url string, html string")
    rows = {p: {r["url"]: r for r in html.documents(pages, p).collect()} for p in html.PROFILES}
    assert rows["site"]["https://h/"]["title"] == "Head"
    assert rows["site"]["https://h/"]["text"] == "Head\nOne\ntwo\nhome"
    assert "home" not in rows["readable"]["https://h/"]["text"] and "menu" not in rows["readable"]["https://h/"]["text"]
    assert "Name: Ann" in rows["tables"]["https://h/"]["text"] and "#:" not in rows["tables"]["https://h/"]["text"]
    assert rows["generic"]["https://e/"]["text"] == "" and rows["wiki"] == {}
    assert rows["generic"]["https://b/"]["text"] == "un\nclosed"


def test_incremental_twice_is_once(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, source_type string, text string")
    store, first = ingest.incremental(docs, docs.limit(0))
    again, second = ingest.incremental(docs, store)
    assert sorted(again.collect()) == sorted(store.collect())
    assert first.agg(F.sum("indexed")).first()[0] == 2 and second.agg(F.sum("indexed")).first()[0] == 0


def test_descendants_end_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "parent long, child long")
    roots = spark.createDataFrame([(1, True), (9, False)], "page_id long, with_children boolean")
    assert sorted(r[0] for r in ingest.descendants(edges, roots, written).collect()) == [1, 2, 3, 9]


def test_matching_gives_each_text_once(spark):
    items = spark.createDataFrame([(1, "u", "same text"), (2, "u", "same text"), (3, "u", "no match"), (4, "v", "anything"), (5, "v", "")], "item long, url string, text string")
    docs = spark.createDataFrame([(10, "u", "same text and more"), (11, "u", "same text"), (12, "v", ""), (13, "w", "anything")], "document long, url string, text string")
    assert sorted(tuple(r) for r in matching.match_texts(items, docs).collect()) == [(1, 11, 3), (2, 10, 2), (5, 12, 3)]


def test_feedback_and_intervals(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    feedback = spark.createDataFrame([(1, 7, at[0], "like"), (2, 7, at[1], "like"), (3, 7, at[2], "dislike"), (4, None, at[3], "like")], "event_id long, target long, ts timestamp, value string")
    assert {r["event_id"]: r["result"] for r in state.feedback_results(feedback).collect()} == {1: "ok", 2: "already_rated", 3: "ok", 4: "error"}
    toggles = spark.createDataFrame([(i, 1, t) for i, t in enumerate(at[:3])], "event_id long, user_id long, ts timestamp")
    assert sorted((r["subscribed_at"].day, r["unsubscribed_at"] and r["unsubscribed_at"].day) for r in state.subscription_intervals(toggles).collect()) == [(1, 2), (3, None)]


def test_items_from_an_array_file(spark):
    path = fresh_path(spark, "items")
    spark.createDataFrame([('[{"id": "a", "relevant_urls": ["u"]},\n {"id": "b"}]',)], "value string").coalesce(1).write.text(path)
    assert sorted(r["id"] for r in io.read_items(spark, path).collect()) == ["a", "b"]


def test_reranking_by_a_model_that_fails(spark):
    def lengths():
        return lambda questions, contents: [float(len(c)) for c in contents]

    def failing():
        def score(questions, contents):
            raise RuntimeError("no answer")

        return score

    def missing():
        raise OSError("no model")

    rows = spark.createDataFrame([(1, "a", 0, "q", "x"), (1, "b", 1, "q", "xyz"), (1, "c", 2, "q", None)], "query_id long, id string, pos long, question string, content string")
    order = lambda model: [r["id"] for r in retrieve.rerank(rows, 3, retrieve.model_score(model)).orderBy("pos").collect()]
    assert order(lengths) == ["b", "a", "c"]
    assert order(failing) == order(missing) == ["a", "b", "c"]
