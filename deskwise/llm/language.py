"""Language identification by interpolated Kneser-Ney character models.

Each language has, for every order up to ``ORDER``, a sorted array of n-gram hashes (the symbols' numbers, 16 bits
each) with the discounted probability of the last symbol, and one of contexts with the weight left to the next lower
order. The prediction is the language of lowest cross-entropy per symbol. Thresholds calibrated on labelled documents
that the models haven't seen reject texts that no model explains.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

ORDER = 4
#: Bits of a symbol's number in an n-gram's 64.
BITS = 16
#: Characters scored at once in a task.
LOT = 100_000
#: Documents whose texts a task holds as strings at once.
ROWS = 128
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, letters in lower case and each run of anything else as one 0; the number of the
    text that each belongs to; whether it's to be predicted, not padding. Every text begins after ORDER - 1 zeros."""
    pad = "\0" * (ORDER - 1)
    joined = [pad + t.lower() + "\0" for t in texts]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    sizes = np.array([len(j) for j in joined])
    doc = np.repeat(np.arange(len(texts)), sizes)
    start = np.cumsum(sizes) - sizes
    points[~_is_letter(points)] = 0
    padding = np.zeros(len(points), bool)
    for k in range(ORDER - 1):
        padding[start + k] = True
    keep = padding | (points > 0)
    keep[1:] |= points[:-1] > 0
    return points[keep], doc[keep], ~padding[keep]


def _codes(symbols: np.ndarray) -> np.ndarray:
    """The hash of the n-gram of ORDER symbols that ends at each place."""
    out = np.zeros(len(symbols), np.uint64)
    for k in range(ORDER):
        out[k:] |= symbols[: len(symbols) - k].astype(np.uint64) << np.uint64(BITS * k)
    return out


class Model:
    """The models of all languages. ``alphabet``: the letters that were seen in training, numbered from 1; all others
    share the number ``other``, and what isn't a letter is 0. The lowest order is interpolated with equal shares of all
    ``other + 1`` numbers."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        letters: dict[str, int] = defaultdict(int)
        for grams in counts.values():
            for gram, n in grams.items():
                letters[gram[-1]] += n
        self.alphabet = sorted(sorted((c for c in letters if c != "\0"), key=lambda c: (-letters[c], c))[: (1 << BITS) - 2])
        self.other = len(self.alphabet) + 1
        self.languages = sorted(counts)
        self.orders = [self._fit(counts[x]) for x in self.languages]
        self.limits = dict.fromkeys(self.languages, np.inf)

    def _fit(self, grams: dict[str, int]) -> list[tuple[np.ndarray, ...]]:
        number = {c: i + 1 for i, c in enumerate(self.alphabet)} | {"\0": 0}
        code = np.array([sum(number.get(c, self.other) << BITS * (ORDER - 1 - i) for i, c in enumerate(g)) for g in grams], np.uint64)
        count = np.array(list(grams.values()), float)
        code, back = np.unique(code, return_inverse=True)
        count = np.bincount(back, count)
        orders = []
        for n in range(ORDER, 0, -1):
            context, of = np.unique(code >> np.uint64(BITS), return_inverse=True)
            # An n-gram's last symbol is its low bits here, so the context is what stands above it.
            total, kinds = np.bincount(of, count), np.bincount(of)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            orders.append((code, (np.maximum(count - d, 0) / total[of]).astype(np.float32), context, (d * kinds / total).astype(np.float32)))
            lower = code & np.uint64((1 << BITS * (n - 1)) - 1)  # its continuation count: the n-grams that end in it
            code, count = np.unique(lower, return_counts=True)
            count = count.astype(float)
        return orders[::-1]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of each model's probability of the last symbol; a row for each language."""

        def found(keys: np.ndarray, values: np.ndarray, at: np.ndarray, other: float) -> np.ndarray:
            i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
            return np.where(keys[i] == at, values[i], np.float32(other))

        out = np.empty((len(self.languages), len(codes)), np.float32)
        for k, orders in enumerate(self.orders):
            p = np.full(len(codes), 1 / (self.other + 1), np.float32)
            for n, (grams, own, contexts, rest) in enumerate(orders, 1):
                gram = codes & np.uint64((1 << BITS * n) - 1)
                p = found(grams, own, gram, 0) + found(contexts, rest, gram >> np.uint64(BITS), 1) * p
            out[k] = -np.log2(p)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (language x text) and the number of letters of each text."""
        points, doc, told = _symbols(texts)
        letters = np.array(sorted(map(ord, self.alphabet)) or [0], np.uint32)
        numbers = np.array([n for _, n in sorted((ord(c), n) for n, c in enumerate(self.alphabet, 1))] or [0], np.uint32)
        at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
        symbols = np.where(points == 0, 0, np.where(letters[at] == points, numbers[at], self.other))
        codes, doc = _codes(symbols)[told], doc[told]
        letters = np.bincount(doc, points[told] > 0, len(texts))
        n = np.maximum(1, np.bincount(doc, minlength=len(texts)))
        codes, back = np.unique(codes, return_inverse=True)
        bits = self.bits(codes)
        return np.stack([np.bincount(doc, row[back], len(texts)) for row in bits]) / n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[int], list[bool]]:
        """Language, score, bits per symbol, number of letters and acceptance of each text."""
        pred, score, cost, count, good = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [0] * len(texts), [False] * len(texts)
        lots: list[list[int]] = [[]]
        size = 0
        for i, text in enumerate(texts):
            if text:
                if size and size + len(text) > LOT:
                    lots, size = [*lots, []], 0
                lots[-1].append(i)
                size += len(text)
        for lot in lots:
            if not lot or not self.languages:
                continue
            h, letters = self.entropies([texts[i] for i in lot])
            best = h.argmin(axis=0)
            least = h.min(axis=0)
            sure = 1 / np.exp2(-(h - least) * np.minimum(letters, 64)).sum(axis=0)
            for k, i in enumerate(lot):
                if letters[k]:
                    pred[i], score[i], cost[i], count[i] = self.languages[best[k]], float(sure[k]), float(least[k]), int(letters[k])
                    good[i] = bool(least[k] <= self.limits[pred[i]] + 6 / np.sqrt(letters[k]))
        return pred, score, cost, count, good


def train(labelled: DataFrame, per_language: int = 2000, calibrated: float = 0.999, margin: float = 1.0) -> Model:
    """Models from labelled documents (doc_id, text, lang); rows without text or lang are passed over.

    About ``per_language`` whole documents of each language, those of the least hashes of their ids, are the sample
    that everything learnt is bounded by. Four fifths give the n-gram counts, which Spark gathers; for the others the
    ``calibrated`` quantile of the bits per symbol, plus ``margin``, is the language's limit.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.abs(F.xxhash64("doc_id") % 1_000_003).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    spark = labelled.sparkSession
    if not sizes:
        return Model({})
    share = spark.createDataFrame([(x, float(per_language) / n) for x, n in sizes.items()], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where("h < share * 1000003")
    used = sample.where("h % 5 > 0")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch["lang"].to_pylist()):
                texts = batch.filter(pa.compute.equal(batch["lang"], lang))["text"].to_pylist()
                points, _, told = _symbols(texts)
                windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(ORDER - 1, points.dtype), points]), ORDER)[told]
                kinds, n = np.unique(np.ascontiguousarray(windows).view(f"V{4 * ORDER}").ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([k.tobytes().decode("utf-32-le") for k in kinds], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts: dict[str, dict[str, int]] = {}
    for r in used.select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = Model(counts)
    apart = predict(sample.where("h % 5 = 0"), model).where("lang_pred = lang and n_letters >= 100")
    for r in apart.groupBy("lang").agg(F.percentile("bits_per_symbol", calibrated).alias("q")).collect():
        model.limits[r["lang"]] = r["q"] + margin
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred, score, bits_per_symbol, n_letters, accepted``; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0 and isn't accepted.
    """
    added = {"lang_pred": pa.string(), "score": pa.float64(), "bits_per_symbol": pa.float64(), "n_letters": pa.int64(), "accepted": pa.bool_()}
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = sent.value.predict(batch["text"].to_pylist())
                arrays = [pa.array(x, t) for x, t in zip(found, added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, from_arrow_type(kind)) for name, kind in added.items())])
    return docs.mapInArrow(predicted, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from: crc32(doc_id) mod 5 isn't 0 and lang is known."""
    return docs.where(~held_out() & F.col("lang").isNotNull())


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(False))
