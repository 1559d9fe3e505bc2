"""Repair of the structure of conversations by the cheapest edits, found row by row.

A repaired conversation's role initials are ``(s?(ua)+)?``: nothing, or turns of user and assistant after at most one
system row. Four states tell where a prefix of the rows has led: at the start, after the system row, after a user, after an
assistant. For each state the cheapest edits so far are known, and of equally cheap ones those whose initials come first.

The edits of a state are a linked node that shares its prefix with the others. A node has the hash of all edits up to it and
its ancestors at distances 1, 2, 4, ...: two equally cheap ways are compared at their first difference, found by a
search for the longest common prefix, and what has equal hashes is verified. (Of ways of equal cost to one state none is a
prefix of the other, as it would lack insertions, which cost.) Ways too dear to be part of the answer are dropped, and what
all others share is put out at once, to the hash of the repaired text too: a conversation streams through its task, so
its length isn't bounded by memory, though it is by one task's time, as the hash asks for its rows one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import partitions, salted, written

DELETE, INSERT, KEEP, REROLE = "DIKR"
#: Fixed costs.
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state: the initial of a role and the state after it.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
#: What an end from the first state costs more at most than the same from the second: a system row is deleted, an assistant's put in.
_DEARER = {(ASSISTANT, START): 2, (ASSISTANT, SYSTEM): 0, (USER, START): 7, (USER, SYSTEM): 5}
_BASE, _MOD = 911382323, (1 << 61) - 1
#: Nodes that are shared by all ways are put out once there are so many rows.
FLUSH = 256


class Node:
    """The last of a row of edits. ``ups[k]`` is the node 2**k edits before it."""

    __slots__ = ("depth", "hash", "line", "mark", "ups")

    def __init__(self, mark: str, line: tuple[str, str] | None, before: Node | None) -> None:
        self.mark, self.line = mark, line
        self.ups: list[Node] = []
        if before is None:
            self.depth, self.hash = 0, 7
            return
        self.depth, self.hash = before.depth + 1, (before.hash * _BASE + ord(mark)) % _MOD
        up, k = before, 0
        while True:
            self.ups.append(up)
            if k >= len(up.ups):
                break
            up, k = up.ups[k], k + 1

    def at(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.ups[min((node.depth - depth).bit_length() - 1, len(node.ups) - 1)]
        return node


def _marks(node: Node, depth: int) -> str:
    """The edits after the first ``depth``."""
    out = []
    while node.depth > depth:
        out.append(node.mark)
        node = node.ups[0]
    return "".join(reversed(out))


def first_difference(a: Node, b: Node) -> tuple[Node, Node]:
    """The nodes of the two ways at their first difference; both at the shorter one's end if that is a prefix."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x.hash == y.hash and _same(x, y):
        return x, y
    k = len(x.ups) - 1
    while k >= 0:
        if k < len(x.ups) and k < len(y.ups) and x.ups[k].hash != y.ups[k].hash:
            x, y = x.ups[k], y.ups[k]
        k -= 1
    if x.ups and not _same(x.ups[0], y.ups[0]):  # hashes met by chance: go by the edits themselves
        x, y = x.ups[0], y.ups[0]
        differ = None
        while x is not y:
            if x.mark != y.mark:
                differ = x, y
            x, y = x.ups[0], y.ups[0]
        return differ or (x, y)
    return x, y


def _same(x: Node, y: Node) -> bool:
    """Whether ways of equal length have the same edits; shared nodes end the walk."""
    while x is not y:
        if x.mark != y.mark:
            return False
        x, y = x.ups[0], y.ups[0]
    return True


def before(a: Node, b: Node) -> bool:
    """Whether the edits of ``a`` come before those of ``b``."""
    x, y = first_difference(a, b)
    return x.mark < y.mark if x.mark != y.mark else a.depth < b.depth


class Repair:
    """The cheapest edits of one conversation, whose rows are given one by one."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, Node]] = {START: (0, Node("", None, None))}
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.first = True
        self.waiting = 0
        self.told = 0  # depth up to which edits have been put out
        self._insert()

    def _offer(self, ways: dict[int, tuple[int, Node]], state: int, cost: int, mark: str, line: tuple[str, str] | None, node: Node) -> bool:
        """Takes a way to a state if it's better than the one that is known. Nodes are made only for those."""
        known = ways.get(state)
        if known and known[0] < cost:
            return False
        new = Node(mark, line, node)
        if known and known[0] == cost and not before(new, known[1]):
            return False
        ways[state] = cost, new
        return True

    def _insert(self) -> None:
        """Rows put in here: as many as still improve a way."""
        changed = True
        while changed:
            changed = False
            for state, (cost, node) in list(self.ways.items()):
                for initial, role in ROLES.items():
                    if initial in NEXT[state]:
                        changed |= self._offer(self.ways, NEXT[state][initial], cost + COST[INSERT], INSERT, (role, ""), node)

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        ways: dict[int, tuple[int, Node]] = {}
        stays = TRUNCATED if truncated else 0
        for state, (cost, node) in self.ways.items():
            self._offer(ways, state, cost + COST[DELETE], DELETE, None, node)
            if must_go:
                continue
            for initial, after in NEXT[state].items():
                if role[:1] == initial:
                    self._offer(ways, after, cost + COST[KEEP] + stays, KEEP, (role, text), node)
                if initial in ROLES:
                    self._offer(ways, after, cost + COST[REROLE] + stays, REROLE, (ROLES[initial], text), node)
        self.ways = ways
        self._insert()
        for (state, other), more in _DEARER.items():
            if state in self.ways and other in self.ways and self.ways[other][0] > self.ways[state][0] + more:
                del self.ways[other]
        self.waiting += 1
        if self.waiting >= FLUSH:
            self._flush()

    def _flush(self) -> None:
        """Puts out what all ways share, and forgets it."""
        self.waiting = 0
        nodes = [node for _, node in self.ways.values()]
        shared = nodes[0]
        for node in nodes[1:]:
            depth = min(shared.depth, node.depth)
            x, y = shared.at(depth), node.at(depth)
            while x is not y:
                k = max((k for k in range(len(x.ups)) if k < len(y.ups) and x.ups[k] is not y.ups[k]), default=-1)
                x, y = (x.ups[k], y.ups[k]) if k >= 0 else (x.ups[0], y.ups[0])
            shared = x
        if shared.depth > self.told:
            self._put(shared)
            self._forget(shared, nodes)

    def _forget(self, shared: Node, nodes: list[Node]) -> None:
        """Makes the shared node the first one, so that nothing before it is held."""
        seen: set[int] = set()
        for node in nodes:
            chain = []
            while node is not shared and id(node) not in seen:
                seen.add(id(node))
                chain.append(node)
                node = node.ups[0]
            for node in chain:
                node.ups = [up for up in node.ups if up.depth >= shared.depth]
        shared.ups = []

    def _put(self, last: Node) -> None:
        path = []
        node = last
        while node.depth > self.told:
            path.append(node)
            node = node.ups[0]
        self.told = last.depth
        for node in reversed(path):
            self.audit.append(node.mark)
            if node.line is not None:
                self.sha.update((("" if self.first else "\n") + f"{node.line[0]}:{node.line[1]}").encode("utf-8", "surrogatepass"))
                self.first = False

    def end(self) -> tuple[int, str, str]:
        """The cost, the initials of the edits, and the hash of the repaired text."""
        ends = [self.ways[s] for s in (START, ASSISTANT) if s in self.ways]
        cost, node = ends[0]
        for other, way in ends[1:]:
            if other < cost or other == cost and before(way, node):
                cost, node = other, way
        self._put(node)
        return cost, "".join(self.audit), self.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone, place`` of the rows of conversations after damage; nulls in role and text are one space.

    Damage is by the crc32 of ``conv_id:turn`` (a null is one space there too). A dropped row stays, as ``gone``, so that
    its conversation isn't lost. ``place`` is the order of rows in a conversation: turn (null first), then role and text as
    they were, then the copy's number; rows with equal places are equal.
    """
    space = F.lit(" ")
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("was_role"), F.coalesce("text", space).alias("was"))
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    r = r.withColumn("fault", fault).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("was_role")))
    r = r.withColumn("text", F.expr("case fault when 0 then '' when 1 then '' when 2 then translate(was, '.!?', '') else was end"))
    r = r.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", F.col("was_role").alias("r"), F.sha2("was", 256).alias("t"), "copy")
    return r.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), place.alias("place"))


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation after damage.

    A null conv_id is a conversation of its own. Rows of equal turn stand in the order of role and text. A role without a
    first letter fits nowhere: its row is reroled or deleted, and stands in no legal pair. Other columns don't matter, and an
    empty table has no conversations.

    Which rows repeat an earlier one is found by joining the first place of each role and text that a conversation has twice,
    combined before the shuffle; then the rows of a conversation stream in order through one task.
    """
    all_rows = written(damaged(rows).withColumn("said", F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)), "damaged")
    first = all_rows.where("not gone").groupBy("said").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    marked = salted(all_rows, first.where("n > 1").select("said", "first"), "said", "place", how="left")
    letter = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    shown = marked.select("conv_id", "turn", "role", "text", "gone", "place", (F.col("first") < F.col("place")).alias("later"), letter.alias("letter"))
    dealt = shown.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    key = dealt.schema["conv_id"].dataType
    same = F.sha2(F.to_json("place"), 256).alias("same")
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {key.simpleString()}, {', '.join(f'{c} long' for c in fields)}, audit string, repaired_sha256 string"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, talk, arrow_key = None, None, None
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [arrow_key] + [pa.int64()] * len(fields) + [pa.string()] * 2
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", *fields, "audit", "repaired_sha256"])
            out.clear()
            return found

        for batch in batches:
            arrow_key = batch["conv_id"].type
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "later", "letter", "same")]
            for conv_id, *row in zip(*columns, strict=True):
                if talk is None or conv_id != own:
                    if talk is not None:
                        out.append((own, *talk.end()))
                    own, talk = conv_id, Talk()
                    if len(out) >= 1000:
                        yield made()
                talk.add(*row)
        if talk is not None:
            out.append((own, *talk.end()))
            yield made()

    return dealt.select("conv_id", "turn", "role", "text", "gone", "later", "letter", same).mapInArrow(told, schema)


class Talk:
    """What is counted of one conversation, and its repair."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.low = self.high = self.turn = self.role = self.same = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, gone: bool, later: bool | None, letter: str, same: str) -> None:
        if gone:
            return
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        again = bool(later) or same == self.same  # of rows with equal places, the first one only isn't a repeat
        self.role, self.same = role, same
        blank, cut = letter == "", letter not in (".", "!", "?")
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not again and not blank
        self.repair.add(role, text, blank or again, cut)

    def end(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())
