"""The cheapest repair of a conversation's turns, by bidirectional Dijkstra over the lattice of its edits.

A place in the lattice is (rows read, last role's state); edges are the edits. From the start a heap goes
forward, from the ends one goes backward; when their least costs together exceed the best crossing, all
crossings of that cost are known, and of these the one with the least audit is taken. Of equally cheap ways
between two places none is the beginning of another, so least beginnings and least endings make a least whole.

Rows are laid out in ranges of (conversation, turn), so a conversation may be cut; only facts about rows go
there, no texts. A piece that is cut, or longer than `block` rows, is told as the cheapest way from each state
to each state, block by block, and the same search then runs over blocks. Texts are read once more, in order
and one at a time, when audits are known.

Odd rows. Null roles and texts count as one space. Rows of one turn (null turns first) go by role, then by a
hash of role and text; equal rows of a turn are later copies of the first. A null conv_id is a conversation of
its own. A role whose first letter isn't s, u or a, or that has none, can't be kept. A conversation without rows
left is given with zeros, an empty audit and no turns. An empty table gives an empty one. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import SPACES, partitions

#: The states: nothing read, after s, after u, after a; what an initial makes of each; the role that is put in; where that leads.
STEPS: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
PUT, NEXT, ACCEPT = ["user", "user", "assistant", "user"], [2, 2, 3, 2], (0, 3)
RULES = ("su", "ua", "au")
#: Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
INFINITE = float("inf")


def cheapest(start: tuple[int, int], goals: list[tuple[int, int]], after, before) -> tuple[int, str] | None:
    """Cost and audit of the cheapest way from start to one of goals, the least audit of equally cheap ones; None if there is no way.

    after(place) and before(place) give (place, cost, letters) of the edges that leave and reach a place.
    """
    # Edges that cost nothing lead one row on, so among equal costs earlier places (backward: later ones) go first.
    sides = [({start: (0, "")}, [(0, start[0], "", start)]), ({g: (0, "") for g in goals}, [(0, -g[0], "", g) for g in goals])]
    heapq.heapify(sides[1][1])
    best = min((0 for g in goals if g == start), default=INFINITE)
    while True:
        tops = [heap[0][0] if heap else INFINITE for _, heap in sides]
        if sum(tops) > best or sum(tops) == INFINITE:
            break
        back = tops[1] < tops[0]
        (known, heap), (other, _) = sides[back], sides[not back]
        cost, _, letters, place = heapq.heappop(heap)
        if known[place] != (cost, letters):
            continue
        for to, more, letter in before(place) if back else after(place):
            label = (cost + more, letter + letters if back else letters + letter)
            if to not in known or label < known[to]:
                known[to] = label
                heapq.heappush(heap, (label[0], -to[0] if back else to[0], label[1], to))
                if to in other:
                    best = min(best, label[0] + other[to][0])
    if best == INFINITE:
        return None
    ahead, behind = sides[0][0], sides[1][0]
    return best, min(way[1] + behind[p][1] for p, way in ahead.items() if p in behind and way[0] + behind[p][0] == best)


class Rows:
    """The lattice of some rows, each (initial, must it go, is it cut off)."""

    def __init__(self, rows: list[tuple[str, bool, bool]]):
        self.rows = rows

    def after(self, place):
        i, state = place
        yield (i, NEXT[state]), INSERT, "I"
        if i < len(self.rows):
            initial, gone, cut = self.rows[i]
            yield (i + 1, state), DELETE, "D"
            if not gone:
                yield (i + 1, NEXT[state]), REROLE + cut * CUT_OFF, "R"
                if initial in STEPS[state]:
                    yield (i + 1, STEPS[state][initial]), cut * CUT_OFF, "K"

    def before(self, place):
        i, to = place
        for state in range(4):
            if NEXT[state] == to:
                yield (i, state), INSERT, "I"
        if i:
            initial, gone, cut = self.rows[i - 1]
            yield (i - 1, to), DELETE, "D"
            if not gone:
                for state in range(4):
                    if NEXT[state] == to:
                        yield (i - 1, state), REROLE + cut * CUT_OFF, "R"
                    if STEPS[state].get(initial) == to:
                        yield (i - 1, state), cut * CUT_OFF, "K"

    def ways(self) -> list[list]:
        """(from state, to state, cost, letters) of the cheapest ways through all rows."""
        out = []
        for state in range(4):
            for to in range(4):
                way = cheapest((0, state), [(len(self.rows), to)], self.after, self.before)
                if way:
                    out.append([state, to, *way])
        return out


class Blocks:
    """The lattice of blocks of rows, each with its ways."""

    def __init__(self, blocks: list[list[list]]):
        self.out = [[[w for w in block if w[0] == s] for s in range(4)] for block in blocks]
        self.back = [[[w for w in block if w[1] == s] for s in range(4)] for block in blocks]

    def after(self, place):
        if place[0] < len(self.out):
            for _, to, cost, letters in self.out[place[0]][place[1]]:
                yield (place[0] + 1, to), cost, letters

    def before(self, place):
        if place[0]:
            for state, _, cost, letters in self.back[place[0] - 1][place[1]]:
                yield (place[0] - 1, state), cost, letters


def repair(rows: list[tuple[str, bool, bool]], block: int = 256) -> tuple[int, str]:
    """Cost and audit for the rows of a conversation."""
    if len(rows) <= block:
        lattice, n = Rows(rows), len(rows)
    else:
        lattice = Blocks([Rows(rows[k : k + block]).ways() for k in range(0, len(rows), block)])
        n = -(-len(rows) // block)
    return cheapest((0, 0), [(n, s) for s in ACCEPT], lattice.after, lattice.before)


class Piece:
    """What is known of consecutive rows of a conversation."""

    def __init__(self):
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.ends: list[str] = []  # first and last initial
        self.turns: list[int] = []  # least, largest, how many
        self.rows: list[tuple[str, bool, bool]] = []
        self.ways: list[list[list]] = []

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut: bool, copies: int) -> None:
        for k in range(copies):
            fault = 0 if blank else 1 if again or k else 2 if cut else None
            if fault is not None:
                self.counts[fault] += 1
            self.rows.append((initial, fault in (0, 1), fault == 2))
            self._follow(initial, initial)
        if copies and turn is not None:
            self._count([turn, turn, 1])

    def _follow(self, first: str, last: str) -> None:
        if self.ends:
            self.counts[3] += self.ends[1] + first not in RULES
        self.ends = [self.ends[0] if self.ends else first, last]

    def _count(self, turns: list[int]) -> None:
        if self.turns:
            low, high, n = self.turns
            self.turns = [low, turns[1], n + turns[2] - (high == turns[0])]
        else:
            self.turns = turns

    def fold(self, block: int) -> None:
        """Rows to ways."""
        self.ways += [Rows(self.rows[k : k + block]).ways() for k in range(0, len(self.rows), block)]
        self.rows = []

    def told(self) -> str:
        return json.dumps([self.counts, self.ends, self.turns, self.ways])

    def append(self, told: str) -> None:
        counts, ends, turns, ways = json.loads(told)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if ends:
            self._follow(*ends)
        if turns:
            self._count(turns)
        self.ways += ways

    def result(self, block: int) -> list:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        if self.ways:
            self.fold(block)
            lattice = Blocks(self.ways)
            cost, audit = cheapest((0, 0), [(len(self.ways), s) for s in ACCEPT], lattice.after, lattice.before)
        else:
            cost, audit = repair(self.rows, block)
        return [self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0, *self.counts, cost, audit]


FACTS = ["conv_id", "turn", "initial", "blank", "again", "cut", "copies"]
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def keyed(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, maybe copies) with nulls as spaces and two hashes of role and text."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(11), role, text).alias("b"))


def facts(rows: DataFrame) -> DataFrame:
    """A row for each different turn of keyed rows, with its first initial and its faults; again: an earlier turn says the same."""
    end = F.rtrim("text", F.lit(SPACES))
    one = rows.select("conv_id", "turn", "role", "a", "b", "copies", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    one = one.groupBy("conv_id", "turn", "role", "a", "b").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    said = one.where("copies > 0").groupBy("conv_id", "a", "b").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    o, s = one.alias("o"), said.alias("s")
    both = o.join(s, F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("o.a") == F.col("s.a")) & (F.col("o.b") == F.col("s.b")), "left")
    again = F.col("s.first").isNotNull() & ~F.col("o.turn").eqNullSafe(F.col("s.first.turn"))
    return both.select("o.conv_id", "o.turn", "o.role", "o.a", "o.b", "o.copies", "o.blank", "o.cut", again.alias("again"), F.substring("o.role", 1, 1).alias("initial"))


def pieces(rows: DataFrame, block: int = 256) -> DataFrame:
    """The conversations of facts, or their pieces where partitions or blocks end: conv_id, part (their order), told."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "a", "b"]
    laid = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select(*FACTS, F.spark_partition_id().alias("part"))

    def pieces_of(batches):
        conv, piece, part, first = None, None, None, True
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), ("part", pa.int64()), ("told", pa.string()), ("result", pa.string())])
            out = []
            for c, *fact, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if piece is None or c != conv:
                    if piece is not None:
                        out.append(_written(conv, piece, part, first, block))
                        first = False
                    conv, piece = c, Piece()
                piece.add(*fact)
                if len(piece.rows) >= 16 * block:  # a long conversation goes on in ways
                    piece.fold(block)
            if out:
                yield _rows(out, schema)
        if piece is not None:
            piece.fold(block)
            yield _rows([(conv, part, piece.told(), None)], schema)

    return laid.mapInArrow(pieces_of, f"conv_id {kind}, part long, told string, result string")


def _written(conv, piece: Piece, part: int, first: bool, block: int) -> tuple:
    """A conversation that ends here: with its result, unless it may have begun in an earlier partition."""
    if first:
        piece.fold(block)
        return conv, part, piece.told(), None
    return conv, part, None, json.dumps(piece.result(block))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Reader:
    """Applies an audit to a conversation's rows, which come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield PUT[self.state], "", "I"
            self.at, self.state = self.at + 1, NEXT[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEPS[self.state][role[0]]
            yield role, text, "K"
        elif letter == "R":
            yield PUT[self.state], text, "R"
            self.state = NEXT[self.state]

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _read(rows: DataFrame, block: int, output, schema: str) -> DataFrame:
    """Rows of keyed texts behind the pieces of their conversation, handed to output (a function from conversations as (conv_id, result, turns) to batches)."""
    n = partitions(rows.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    heads = pieces(facts(rows), block).select("conv_id", F.lit(0).alias("kind"), F.col("part").alias("turn"), F.col("told").alias("role"), F.col("result").alias("text"), none("long").alias("a"), none("long").alias("b"), F.lit(0).alias("copies"))
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "a", "b", "copies")
    both = heads.unionByName(texts).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "a", "b").select("conv_id", "kind", "role", "text", "copies")

    def read(batches):
        def conversations():
            conv, piece, result, reader = None, None, None, None
            for batch in batches:
                for c, kind, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if kind == 0:
                        if conv is None or conv[0] != c:
                            if conv:
                                yield from ended(conv, piece, result, reader)
                            conv, piece, result, reader = (c,), None, None, None
                        if text is not None:
                            result = json.loads(text)
                        else:
                            piece = piece or Piece()
                            piece.append(role)
                        continue
                    if reader is None:
                        result = result or piece.result(block)
                        reader = Reader(result[-1])
                    for _ in range(copies):
                        for turn in reader.row(role, text):
                            yield c, None, turn
            if conv:
                yield from ended(conv, piece, result, reader)

        def ended(conv, piece, result, reader):
            result = result or piece.result(block)
            for turn in (reader or Reader(result[-1])).end():
                yield conv[0], None, turn
            yield conv[0], result, None

        yield from output(conversations())

    return both.mapInArrow(read, schema)


def _ids(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repaired_turns(turns: DataFrame, block: int = 256) -> DataFrame:
    """The turns of turns (conv_id, turn, role, text) after their repair: conv_id, place (from 0), role, text, edit (K, R or I)."""
    rows = keyed(turns)
    kind, arrow = _ids(rows)
    schema = pa.schema([("conv_id", arrow), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def output(conversations):
        out, place, size = [], 0, 0
        for conv, result, turn in conversations:
            if result is not None:
                place = 0
                continue
            out.append((conv, place, *turn))
            place, size = place + 1, size + len(turn[1])
            if len(out) == 10_000 or size > 16_000_000:
                yield _rows(out, schema)
                out, size = [], 0
        if out:
            yield _rows(out, schema)

    return _read(rows, block, output, f"conv_id {kind}, place long, role string, text string, edit string")


def repairs(turns: DataFrame, block: int = 256) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text, maybe copies): its faults, the cost and audit of its repair, and the digest of its repaired turns.

    copies says how often a row occurs; a conversation all of whose rows have none is given too.
    """
    rows = keyed(turns)
    kind, arrow = _ids(rows)
    schema = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in RESULT[:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def output(conversations):
        out, digest, begun = [], hashlib.sha256(), False
        for conv, result, turn in conversations:
            if result is None:
                digest.update(f"{chr(10) if begun else ''}{turn[0]}:{turn[1]}".encode())
                begun = True
                continue
            out.append((conv, *result, digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
            if len(out) == 10_000:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)

    return _read(rows, block, output, f"conv_id {kind}, {', '.join(f'{c} long' for c in RESULT[:-1])}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn: rows dropped (copies 0), emptied, without sentence ends, repeated (copies 2), or all the user's."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(place) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
