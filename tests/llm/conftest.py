import pytest

from deskwise.llm.queries import QUERIES

BASE = "The quick brown fox jumps over the lazy dog while seventeen other animals watch from behind the old wooden fence near the river"
LONG = "word " * 30_000 + "end"
#: Null ids and texts, empty, blank and very long texts, ties and repeated rows, marks that look like other things.
ODD = [
    (1, BASE + " today"), (2, BASE + " today"), (3, BASE + " tonight"), (4, None), (5, ""), (6, " \n\t \n"), (7, LONG), (7, LONG), (8, "a"),
    (None, BASE), (None, None), (9, "1.2.3.4 a@b.co +1 (234) 555-7890 4111 1111 1111 1111 <|endoftext|> \u2028 \U0001f600 İ"), (9, "other text of the same id"), (10, BASE + " today\n" + BASE + " today\nMIT License"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names clash with what operators add."""
    rows = [(i, t, None if k % 4 == 0 else "en", f"s{k % 2}", k, "x", 1.5, True, 0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, accepted boolean, n_lines int")


@pytest.fixture(scope="session")
def results(spark, small):
    """Every query's rows on the small tables, each computed once."""
    held = {}

    def of(name):
        if name not in held:
            held[name] = QUERIES[name](spark, small).collect()
        return held[name]

    return of


@pytest.fixture(scope="session")
def texts(spark, small):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
