"""Queries where a part of the job was once left out."""

import datetime as dt
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from deskwise.operators import evaluate, matching, html, ingest, retrieve, state
from deskwise.sources import io
from deskwise.sources.shared import fresh_path
from deskwise.sources.versions import Store
from deskwise.streaming import streams as S
from deskwise.plans import streams
from deskwise.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same


def test_sessions_of_all_users(spark, small):
    times, gap = defaultdict(list), dt.timedelta(hours=6)
    for r in spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts").collect():
        times[r["user_id"]].append(r["ts"].replace(tzinfo=None))
    until = max(map(max, times.values())) - dt.timedelta(days=1)
    every = []
    for user, several in times.items():
        several.sort()
        runs = [[several[0]]]
        for ts in several[1:]:
            if ts - runs[-1][-1] <= gap:
                runs[-1].append(ts)
            else:
                runs.append([ts])
        every += [(user, r[0], r[-1] + gap, len(r)) for r in runs if r[-1] + gap <= until]
    found = QUERIES["x2_user_sessions"](spark, small).selectExpr("user_id", "cast(started_at as timestamp_ntz)", "cast(ended_at as timestamp_ntz)", "events").collect()
    assert sorted(map(tuple, found)) == sorted(every)
    assert len({r["user_id"] % 5 for r in found}) == 5


def test_replay_is_written_by_many_tasks(spark):
    path = streams.replay_files(spark.range(1000).coalesce(1), "replay", "id")
    assert len(spark.read.parquet(path).inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty_context(spark):
    got = spark.createDataFrame([(1, 0, "text", "https://a")], "query_id long, pos long, content string, file_path string")
    told = retrieve.format_context(got, spark.range(1, 3).withColumnRenamed("id", "query_id"))
    assert {r["query_id"]: r["context"] for r in told.collect()} == {1: "Source 1: text\nURL: https://a", 2: "Nothing was found."}


def test_context_cut_at_a_line_end(spark):
    """A context whose last character within the limit ends a line loses that line end alone."""
    got = spark.createDataFrame([(1, 0, "first", ""), (1, 1, "second", "")], "query_id long, pos long, content string, file_path string")
    whole = "Context:\nfirst\n---\nsecond"
    cuts = {n: retrieve.assemble_context(got, max_chars=n).first()["context"] for n in (len(whole), 19, 18, 17)}
    assert cuts == {len(whole): whole, 19: "Context:\nfirst\n---", 18: "Context:\nfirst", 17: "Context:\nfirst"}


def test_blocks_of_search_agree(spark, small, monkeypatch):
    """Several blocks of queries and of the corpus give what one of each does; rows without length and nulls match nothing."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = rows.unionByName(spark.createDataFrame([(10**6, [0.0] * 64), (10**6 + 1, None)], rows.schema))
    queries = rows.where("id < 40").withColumnRenamed("id", "query_id")
    one = sorted(map(tuple, retrieve.vector_topk(queries, rows, 5).collect()))
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "PIECE", 30)
    assert sorted(map(tuple, retrieve.vector_topk(queries, rows, 5).collect())) == one
    assert retrieve.vector_topk(queries.limit(0), rows).count() == retrieve.vector_topk(queries, rows.limit(0)).count() == 0


def test_numbers_of_ranges(spark):
    rows = evaluate.numbered(spark.range(1000, 0, -3).repartition(5), "id").collect()
    assert sorted((r["id"], r["i"]) for r in rows) == [(x, i) for i, x in enumerate(sorted(r["id"] for r in rows))]


def test_rolling_context_of_many_messages(spark):
    lines = [(i // 200, i, "user", "abc"[: i % 4] * (1 + i % 7) if i % 50 else "z" * 3000) for i in range(1000)]
    found = state.rolling_context(spark.createDataFrame(lines, "session_id long, id long, role string, content string"), 100)
    so_far = {}
    for r in sorted(found.collect()):
        session, _, role, content = lines[r["id"]]
        so_far[session] = (f"{so_far[session]}\n" if session in so_far else "") + f"{role}: {content}"
        assert r["context"] == so_far[session][-100:]


def test_last_row_of_a_document(spark):
    docs = spark.createDataFrame([(1, "a", "old", 1), (1, "a", "new", 2), (2, "b", "x", 1), (3, "c", "stored", 1)], "doc_id long, source_type string, text string, v int")
    store, _ = ingest.incremental(docs, docs.where("doc_id = 3"), order="v")
    assert sorted((r["doc_id"], r["text"]) for r in store.collect()) == [(1, "new"), (2, "x"), (3, "stored")]


def test_batches_that_run_again(spark):
    """A batch that is there already is replaced, not added."""
    docs = spark.createDataFrame([(1, "One sentence. Another one."), (2, "Text.")], "doc_id long, text string")
    path, store = fresh_path(spark, "docs"), Store(spark, fresh_path(spark, "store"))
    docs.write.parquet(path)
    ingest.add_documents(store, docs.where("doc_id = 1"), "documents-0")
    out = S.ingest_stream(spark.readStream.schema(docs.schema).parquet(path), store).read("chunks")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_stored_documents(spark):
    docs = spark.createDataFrame([(1, "u", "t", "page", "A sentence. B."), (2, "u", "t", "page", " "), (3, "u", "t", "faq", None)], "doc_id long, url string, title string, source_type string, text_content string")
    path = fresh_path(spark, "store")
    found = {r["doc_id"]: (r["status"], r["reason"], r["chunks"]) for r in ingest.store_documents(docs, path).collect()}
    assert found == {1: ("ok", None, 1), 2: ("skipped", "empty text", 0), 3: ("skipped", "empty text", 0)}
    assert spark.read.parquet(path).count() == 1
    assert set(io.read_tables(spark, "/none", {})) == set()


def test_stored_documents_without_words(spark, tmp_path):
    """Blank texts and nulls among the documents that the SQL counts as stored."""
    texts = ["A text.", "", " ", None, "\n", "b", "", "c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["s6_store_documents"](spark, str(tmp_path))
    told = duckdb.connect()
    told.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(found.collect(), found.columns, told.sql(ORACLES["s6_store_documents"]))


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<div role=main><p>Inside it</p></div><p>outside</p>", "Inside it"),
        ("<main><div class=related-links>gone</div><label>gone</label><p>Kept line</p><p>ab</p><p>О нас</p></main>", "Kept line"),
        ("<p>" + "long " * 200 + "</p>", ("long " * 200).strip()[:500] + "\n\n... (truncated)"),
    ],
)
def test_readable(body, text):
    page = html.parse(f"<html><head><title>T</title></head><body>{body}</body></html>")
    assert html.readable("https://u", page, 10)["text"] == f"# T\n\n*Source:* [https://u](https://u)\n\n{text}"


def test_errors_of_routes(spark):
    from deskwise.functions import urls

    pages = spark.createDataFrame([("https://a/x.pdf",), ("https://a/y",), (None,)], "url string")
    found = urls.route_errors(pages, [(r"\.pdf$", "file", "pdf")]).collect()
    assert {r["url"]: r["reason"] for r in found} == {"https://a/y": "no rule for https://a/y", None: "no address"}


def test_matches_of_whole_texts(spark, small):
    """Copies, cut, extended, inner and edited texts, against loops over all pairs of an address; nulls match nothing."""
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = [(i, "src0" if i % 2 else url, text) for i, url, text in rows]  # half of the rows have one address
    rows += [(10_000, None, "no address"), (10_001, rows[0][1], None), (10_002, rows[1][1], rows[1][2]), (10_003, "src0", ""), (10_004, "src0", ""), (10_005, "src1", "ab")]
    rows += [(20_000 + i, "copies", "a text of many copies and of many words, long enough to begin as others do" + "!" * (i % 3)) for i in range(40)]
    change = (lambda x: x, lambda x: x[: len(x) // 2], lambda x: x + " and more", lambda x: x[5:-5], lambda x: x[:60] + "?" + x[60:], lambda x: "", lambda x: x[:2])
    items = [(i, url, None if text is None else change[i % 7](text)) for i, url, text in rows]
    expected, taken = [], set()
    for item, url, text in sorted(items, key=lambda r: r[0]):
        best = None
        for document, other_url, other in sorted(rows, key=lambda r: r[0]):
            if None in (url, text, other) or other_url != url or document in taken:
                continue
            common = next((i for i, (a, b) in enumerate(zip(text, other)) if a != b), min(len(text), len(other)))
            rank = 3 if text == other else 2 if other.startswith(text) else 1 if text in other else 0
            length = len(text) if rank else common
            if (rank or length >= 40) and (best is None or (rank, length) > best[:2]):
                best = (rank, length, document)
        if best:
            taken.add(best[2])
            expected.append((item, best[2], best[0]))
    columns = "long, url string, text string"
    found = matching.match_texts(spark.createDataFrame(items, f"item {columns}"), spark.createDataFrame(rows, f"document {columns}"))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert {r[2] for r in expected} == {0, 1, 2, 3}


def rows_shuffled(spark, run):
    """What ``run`` gives, and how many rows its stages wrote to be shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    none, quantiles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(none, False, False, quantiles, none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("several", [1, 5])
def test_candidates_of_common_entities(spark, several):
    """Entities that many queries and chunks share, links that stand twice, places that tie: by brute force, and no row for each query and chunk."""
    links = [(f"e{i % several}", f"c{i * 7 % 1500:04}") for i in range(1500)] + [("e0", f"c{i:04}") for i in range(0, 60, 3)] + [("e9", "c0000"), (None, "c0001")]
    asks = [(q, f"e{(q + j) % several}", j // 2) for q in range(150) for j in range(min(3, several))] + [(3, "e9", 0), (4, "none", 0), (5, None, 0)]
    want = []
    for query in range(150):
        seen = defaultdict(list)
        for q, e, pos in asks:
            for entity, chunk in links if q == query and e is not None else []:
                if entity == e:
                    seen[chunk].append(pos)
        best = sorted((min(places), chunk, len(places)) for chunk, places in seen.items())[:4]
        want += [(query, chunk, n, i) for i, (_, chunk, n) in enumerate(best)]
    of = spark.createDataFrame(links, "entity string, chunk_id string")
    found, shuffled = rows_shuffled(spark, lambda: retrieve.graph_candidates(spark.createDataFrame(asks, "query_id long, entity string, pos int"), of, 4).collect())
    assert sorted((r["query_id"], r["id"], r["freq"], r["pos"]) for r in found) == sorted(want)
    assert shuffled < 20_000


def test_truth_by_groups(spark):
    """Truth that a common label tells gives what its pairs give, and no row for each query and key: keys given twice, own keys, groups without others."""
    label = lambda i: "alone" if i == 0 else None if i == 5 else f"l{i % 2}"
    members = [(label(i), f"k{i:04}", i) for i in range(1000)] + [("l0", "k0002", 2), ("l1", "k0003", 9999), ("l0", "none", None)]
    asked = [(q, label(q)) for q in range(120)] + [(7, "l1")]
    got = [(q, f"k{(q + j * j) % 1000:04}", j) for q in range(110) for j in range(6)]
    pairs = sorted({(q, k) for q, group in asked if group for g, k, own in members if g == group and own is not None and own != q})
    retrieved = spark.createDataFrame(got, "query_id long, key string, pos long")
    queries, of = spark.createDataFrame(asked, "query_id long, group string"), spark.createDataFrame(members, "group string, key string, own long")
    want = evaluate.per_query_metrics(retrieved, spark.createDataFrame(pairs, "query_id long, key string")).collect()

    def run():
        ranked = evaluate.unique_ranks(retrieved)
        return evaluate.hit_metrics(evaluate.group_hits(ranked, queries, of), evaluate.group_sizes(queries, of)).collect()

    found, shuffled = rows_shuffled(spark, run)
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) == 118
    assert shuffled < 20_000


def test_metrics_without_pairs(spark, tmp_path):
    """The registered queries on many vectors of one label: rows shuffled grow with queries and chunks, not with both."""
    rows = [(i, [float(i % 7 + 1), float(i % 11)], 3) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("u2_intersection", "g11_mean_metrics", "j13_retrieved_truth", "e7_per_query_metrics", "j15_known_baselines", "e6_ndcg", "e11_comparison", "e1_unique_ranks", "r7_rerank", "e5_precision"):
        found, shuffled = rows_shuffled(spark, QUERIES[name](spark, str(tmp_path)).collect)
        assert found and shuffled < 60_000, name
