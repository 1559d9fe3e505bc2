"""Personal data: exact patterns, and contexts learnt from what they find.

Seeds are the base spans. The words before each seed and those after it, as those before and after every other token
that looks like an identifier, are lexical patterns. Spark scores the graph of patterns and instances in rounds:

* A pattern's score for a kind is the mean belief in its distinct instances. It is accepted when the score is high and
  enough of its instances are seeds.
* Instances of accepted patterns are seeds of the next round, wherever they stand, so that patterns which only surround
  discovered identifiers are learnt too.

Occurrences of accepted patterns, and of the identifiers that they discovered, become spans of the pattern's kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import salted, written

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9@._%+()/:-]+")
_CORE = re.compile(r"[A-Za-z0-9+(][A-Za-z0-9@._%+()/:-]*[A-Za-z0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the pattern, found from each ``@`` on: a local part never holds one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        elif start < at:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base match, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def context(text: str, start: int, words: int = 2, chars: int = 40) -> str:
    """The last words before a place, in lower case with digits as 0, and the marks right before it."""
    before = text[max(0, start - chars) : start].lower().split(" ")
    joined = " ".join(before[-words - 1 :]).strip("\n\r\t")
    return re.sub(r"[0-9]", "0", joined.rsplit("\n", 1)[-1])


def context_after(text: str, end: int, words: int = 2, chars: int = 40) -> str:
    """The marks right after a place and the next words, in lower case with digits as 0, up to the end of the line."""
    after = text[end : end + chars].split("\n", 1)[0].lower().split(" ")
    return re.sub(r"[0-9]", "0", " ".join(after[: words + 1]).strip("\r\t"))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of identifier characters with a digit and at least six characters, as far as they are outside the base spans."""
    out, k = [], 0
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 6 or not _DIGIT.search(text, m.start(), m.end()):
            continue
        while k < len(taken) and taken[k][2] <= m.start():
            k += 1
        pieces, at, j = [], m.start(), k
        while j < len(taken) and taken[j][0] < m.end():
            pieces.append((at, taken[j][0]))
            at, j = max(at, taken[j][2]), j + 1
        for a, b in (*pieces, (at, m.end())):
            if b - a >= 6 and _DIGIT.search(text, a, b) and (core := _CORE.search(text, a, b)) and len(core[0]) >= 6:
                out.append(core.span())
    return out


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("instance", pa.string())])


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, row`` and ``found``, the base spans (kind 0 to 3) and candidates (kind null) with context and instance."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch["text"]:
                text = cell.as_py() or ""
                base = base_spans(text) if "@" in text or re.search(r"[0-9]", text) else []
                rest = candidates(text, base) if re.search(r"[0-9]", text) else []
                both = [(a, b, k) for a, k, b in base] + [(a, b, None) for a, b in rest]
                out.append([{"start": a, "end": b, "kind": k, "before": f"{context(text, a)}<", "after": f">{context_after(text, b)}", "instance": hashlib.md5(text[a:b].lower().encode("utf-8", "surrogatepass")).hexdigest()[:16]} for a, b, k in both])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(out, pa.list_(_FOUND))], names=["doc_id", "row", "found"])

    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return rows.select("doc_id", "row", "text").mapInArrow(spans, "doc_id long, row long, found array<struct<start: long, `end`: long, kind: int, before: string, after: string, instance: string>>")


def patterns(found: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``pattern, kind, score`` of the accepted patterns, and ``instance, kind, score`` of what they discovered.

    ``found``: before, after, instance, and the base span's kind or null. In each round a pattern's score for a kind is
    the sum of its distinct instances' beliefs over their number and two more. A base span's belief in its own kind is
    1, and so is that in what an accepted pattern discovered, as the kind of the best such pattern, from the next round
    on. Patterns of ``support`` seeds and ``confidence`` are accepted. A pattern or instance of several kinds takes
    that of the best score, then the first. The rounds end early when one accepts nothing new.

    Counts are combined before each shuffle and frequent patterns and instances are dealt by salt. Patterns of blanks
    alone say nothing and aren't used.
    """
    every = found.select(F.explode(F.array("before", "after")).alias("pattern"), "instance", "kind").where("pattern rlike '[^<> ]'")
    edges = written(every.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "pattern-edges")
    often = edges.groupBy("pattern").agg(F.count("*").alias("degree")).where(F.col("degree") >= support)
    edges = written(salted(edges, often, "pattern", "instance"), "pattern-graph")
    base = written(edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct(), "base-beliefs")

    def best(rows: DataFrame, by: str) -> DataFrame:
        top = rows.groupBy(by).agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        return top.select(by, (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))

    belief, accepted, discovered, was = base, None, None, -1
    for _ in range(rounds):
        known = salted(edges, belief.groupBy("instance").agg(F.collect_list(F.struct("kind", "belief")).alias("b")), "instance", "pattern")
        known = known.select("pattern", "degree", F.explode("b").alias("b")).select("pattern", "degree", "b.*")
        scores = known.groupBy("pattern", "degree", "kind").agg(F.sum("belief").alias("sum"), F.count("*").alias("seeds"))
        scores = scores.select("pattern", "kind", "seeds", (F.col("sum") / (F.col("degree") + 2)).alias("score"))
        accepted = written(best(scores.where((F.col("score") >= confidence) & (F.col("seeds") >= support)), "pattern"), "accepted-patterns")
        discovered = written(best(salted(edges.where("seed is null").select("pattern", "instance"), accepted, "pattern", "instance"), "instance"), "discovered")
        belief = base.unionByName(discovered.select("instance", "kind", F.lit(1.0).alias("belief")))
        if (now := discovered.count() + accepted.count()) == was:
            break
        was = now
    return accepted, discovered


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of docs.

    Equal doc_ids stay rows of their own. A null text is an empty one: no spans, and the hash of the empty string. An
    empty table has no rows.
    """
    rows = written(extract(docs), "personal-spans")
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    _, discovered = patterns(each, rounds, support, confidence)
    new = salted(each.where("kind is null").select("row", "start", "end", "instance"), discovered.select("instance", "kind"), "instance", "row")
    new = new.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    named = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.transform(F.filter("found", lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    joined = rows.select("doc_id", "row", base.alias("base")).join(new, "row", "left").withColumn("new", F.coalesce("new", F.slice("base", 1, 0)))
    return joined.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.concat("base", "new")).alias("spans"), F.size("new").cast("long").alias("n_added"))
