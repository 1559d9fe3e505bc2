"""The stages of the pipeline, each on what the one before kept, and on odd rows."""

import corpus_pipeline
import pytest

from deskwise.llm import packing
from deskwise.llm.common import written
from deskwise.llm.queries import tokenizer_path
from tests.llm import plain
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, small, stages):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert all(s.columns == docs.columns for s in stages[:-1])
    language, lines, distinct, clean, packed = stages
    assert language.count() >= 0.99 * docs.count()
    deduped = [(d, t) for d, t, n in plain.deduped(rows(language)) if not n or t.strip()]
    assert rows(lines) == deduped
    assert [d for d, _ in rows(distinct)] == [d for d, n, c in plain.components(deduped) if d == c]
    assert {d for d, _ in rows(clean)} <= {d for d, _ in rows(distinct)}
    assert clean.count() >= 0.9 * distinct.count()
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in rows(clean)}
    assert sum(r["length"] for r in packed.collect()) == packing.pieces(clean, tokenizer_path()).groupBy().sum("length").first()[0]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, small, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, small)
    assert out.count() > 0
    if k < 4:
        assert out.columns == odd.columns
        kept = {r["n_chars"] for r in out.collect()} if name != "line dedup" else None
        assert kept is None or kept <= set(range(len(ODD)))
    assert stage(spark, odd.limit(0), small).count() == 0


def test_clashing_columns_stay(spark, small, odd):
    """Names that stages and operators use themselves, in other case too, keep the caller's values."""
    names = {"score": "Score", "lang_pred": "Lang_Pred", "accepted": "ID", "n_lines": "N_Lines"}
    docs = odd.withColumnsRenamed(names).selectExpr("*", "7.5D as _id", "'t' as th", "'g' as _gone", "3 as _all", "n_chars as own", "n_chars as k")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        for r in out.collect():
            assert (r["Score"], r["Lang_Pred"], r["ID"], r["N_Lines"], r["_id"], r["th"], r["_gone"], r["_all"]) == (1.5, "x", True, 0, 7.5, "t", "g", 3) and r["own"] == r["k"]
