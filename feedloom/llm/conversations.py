"""Repair of the order of speakers in conversations, by lazy weighted determinisation.

A conversation is legal when its roles' initials read ``(s?(ua)+)?``.  Edits
keep, rerole, delete or insert a row at a cost; the cheapest sequence of edits
is wanted, of equal ones the ASCII-least.  The edits are a weighted
nondeterministic automaton over the conversation's rows.  It is determinised as
far as the rows need it: the costs of reaching each of its states, less the
smallest of them, are one deterministic state, and a table remembers where a
state and a row's code lead and what that adds to the cost.  A conversation's
cost is a scan of that table; a second, backward pass over the tight arcs (those
on a cheapest path) ranks what remains to be written from each state, and also
remembers its steps; the audit follows them forward.

Costs more than ``SLACK`` above the least are never on a cheapest path, as any
state reaches acceptance, or acts like any other, within 5; so the table is finite.

Rows of one conversation are counted by equal content before they are shuffled
and sorted by range, so a conversation that holds most rows is sorted by many
tasks; they emit one byte a row.  Those bytes, the rows' texts in order and the
running digest meet in one task a conversation, as a stream: SHA-256 has an order,
and the audit has a letter a row.

Defined results: null roles and texts are one space; null turns sort first, rows
of one turn by role and digest; a null conversation is one of its own; roles
without initial s, u or a can't be kept.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_partitions, table, tidy

#: Legal moves by a role's initial from each state (0: nothing yet), accepting states, and roles that edits may give.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
MADE = {"u": "user", "a": "assistant"}
INITIALS = "sua"  # any other has the code 3
LEGAL_PAIRS = ("su", "ua", "au")
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
SLACK, FAR, INSERTS = 8, 1 << 20, 2
#: Faults of a row, the first that holds.
SOUND, CUT, BLANK, DUPLICATE = range(4)


def made(state: int) -> tuple[str, int] | None:
    """The initial that an edit may give in a state, and the state after it."""
    return next(((c, to) for c, to in MOVES[state].items() if c in MADE), None)


def filled(state: int) -> list[tuple[int, int]]:
    """(number of inserted rows, state after them) from a state."""
    out = [(0, state)]
    while len(out) <= INSERTS and (step := made(out[-1][1])):
        out.append((len(out), step[1]))
    return out


def arcs(state: int, code: int) -> list[tuple[str, int, int]]:
    """(edits' letters, cost, state after them) of what may be done up to and with one row."""
    initial, fault = INITIALS[code >> 2 : (code >> 2) + 1], code & 3
    out = []
    for n, at in filled(state):
        out.append(("I" * n + "D", n * INSERT + DELETE, at))
        if fault in (SOUND, CUT):
            more = n * INSERT + (TRUNCATED if fault == CUT else 0)
            if initial in MOVES[at]:
                out.append(("I" * n + "K", more, MOVES[at][initial]))
            if step := made(at):
                out.append(("I" * n + "R", more + REROLE, step[1]))
    return out


class Repairer:
    """The deterministic automaton's states, as found so far, and both transition tables."""

    def __init__(self) -> None:
        self.arcs = [[arcs(q, code) for q in range(len(MOVES))] for code in range(16)]
        self.vectors, self.number = [], {}
        self.forward: dict[tuple[int, int], tuple[int, int]] = {}
        self.ranks, self.rank_number = [], {}
        self.backward: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.steps, self.step_number = [], {}
        self.ends: dict[int, tuple[int, int, tuple]] = {}
        self.first = self._known((0, *[FAR] * (len(MOVES) - 1)), self.vectors, self.number)

    @staticmethod
    def _known(value: tuple, values: list, number: dict) -> int:
        at = number.setdefault(value, len(values))
        if at == len(values):
            values.append(value)
        return at

    def _forward(self, state: int, code: int) -> tuple[int, int]:
        reached = [FAR] * len(MOVES)
        for cost, out in zip(self.vectors[state], self.arcs[code], strict=True):
            if cost < FAR:
                for _, more, to in out:
                    reached[to] = min(reached[to], cost + more)
        least = min(reached)
        vector = tuple(c - least if c - least <= SLACK else FAR for c in reached)
        return self._known(vector, self.vectors, self.number), least

    def _end(self, state: int) -> tuple[int, int, tuple]:
        """Cost of the cheapest ending, the ranks of the endings on cheapest paths, and those endings' letters by state."""
        endings = [(cost + n * INSERT, "I" * n, q) for q, cost in enumerate(self.vectors[state]) if cost < FAR for n, to in filled(q) if to in ACCEPTING]
        least = min(endings)[0]
        letters = tuple(min((w for c, w, at in endings if at == q and c == least), default=None) for q in range(len(MOVES)))
        return least, self._ranked(letters), letters

    def _ranked(self, keys: tuple) -> int:
        order = sorted({k for k in keys if k is not None})
        return self._known(tuple(None if k is None else order.index(k) for k in keys), self.ranks, self.rank_number)

    def _backward(self, state: int, code: int, after: int) -> tuple[int, int]:
        to, least = self.forward[state, code]
        vector, ranks = self.vectors[to], self.ranks[after]
        best = []
        for cost, out in zip(self.vectors[state], self.arcs[code], strict=True):
            tight = [(w, ranks[q], q) for w, more, q in out if ranks[q] is not None and cost + more == least + vector[q]]
            best.append(min(tight, default=None))
        steps = tuple(b and (b[0], b[2]) for b in best)
        return self._ranked(tuple(b and b[:2] for b in best)), self._known(steps, self.steps, self.step_number)

    def repair(self, codes: bytes) -> tuple[int, str]:
        """The least cost and the ASCII-least letters of edits with that cost."""
        forward, backward = self.forward, self.backward
        states, state, cost = array("I", [self.first]), self.first, 0
        for code in codes:
            step = forward.get((state, code))
            if step is None:
                step = forward[state, code] = self._forward(state, code)
            state = step[0]
            cost += step[1]
            states.append(state)
        if state not in self.ends:
            self.ends[state] = self._end(state)
        more, ranks, letters = self.ends[state]
        taken = array("I", bytes(4 * len(codes)))
        for i in range(len(codes) - 1, -1, -1):
            key = states[i], codes[i], ranks
            step = backward.get(key)
            if step is None:
                step = backward[key] = self._backward(*key)
            ranks, taken[i] = step
        at, out = 0, []
        for k in taken:
            word, at = self.steps[k][at]
            out.append(word)
        return cost + more, "".join(out) + letters[at]


_repairer: list[Repairer] = []


def repairer() -> Repairer:
    """This worker's automaton, which lives as long as the worker."""
    if not _repairer:
        _repairer.append(Repairer())
    return _repairer[0]


def illegal_pairs(codes: bytes) -> int:
    initial = np.frombuffer(codes, np.uint8) >> 2
    legal = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in LEGAL_PAIRS]
    return int((~np.isin(initial[:-1] * 4 + initial[1:], legal)).sum())


PIECE = 1 << 20
CODES = "part long, piece long, codes binary, first_turn long, last_turn long, turns long"
SORTED = ("turn", "role", "digest")


def _codes(size: int):
    """Sorted units (conversation, turn, initial, fault, whether its content came at an earlier turn, copies) to pieces of ``size`` codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, kind = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            columns = [[key], [part], [number], [bytes(codes)], [first], [last], [turns]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3], strict=True)], names=["conv", *(f.split()[0] for f in CODES.split(", "))])

        key, codes, opened = None, bytearray(), False
        first = last = None
        turns = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, initial, fault, again, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened and (conv != key or len(codes) >= size):
                    yield closed()
                    number += 1
                    opened = False
                if not opened:
                    key, codes, opened, first, last, turns = conv, bytearray(), True, None, None, 0
                if not copies:
                    continue
                if turn is not None and turn != last:
                    turns, last = turns + 1, turn
                    first = turn if first is None else first
                codes.append(initial * 4 + (DUPLICATE if again and fault != BLANK else fault))
                more = copies - 1
                repeat = initial * 4 + (BLANK if fault == BLANK else DUPLICATE)
                while more > 0:
                    codes.extend(bytes([repeat]) * min(more, size))
                    more -= size
                    if more > 0:
                        yield closed()
                        number, codes, first, turns = number + 1, bytearray(), turn, int(turn is not None)
        if opened:
            yield closed()

    return run


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = f"at long, role string, text string, {SUMMARY}"


class _Conversation:
    """What is known of the conversation that streams by."""

    def __init__(self, key) -> None:
        self.key, self.codes, self.span, self.turns = key, [], [], 0
        self.state, self.place, self.at, self.audit = 0, 0, 0, None

    def add(self, codes: bytes, first: int | None, last: int | None, turns: int) -> None:
        self.codes.append(codes)
        if first is not None:
            self.turns += turns - (1 if self.span and self.span[-1] == first else 0)
            self.span += [first, last]

    def decide(self) -> tuple:
        codes = b"".join(self.codes)
        self.codes = []
        cost, self.audit = repairer().repair(codes) if codes else (0, "")
        faults = np.bincount(np.frombuffer(codes, np.uint8) & 3, minlength=4)
        gaps = max(self.span) - min(self.span) + 1 - self.turns if self.span else 0
        return gaps, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), illegal_pairs(codes) if codes else 0, cost, self.audit

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.place : self.place + 1] == "I":
            initial, self.state = made(self.state)
            self.place += 1
            yield MADE[initial], ""

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The rows that come of the next row."""
        yield from self.inserted()
        letter = self.audit[self.place]
        self.place += 1
        if letter == "R":
            initial, self.state = made(self.state)
            yield MADE[initial], text
        elif letter == "K":
            self.state = MOVES[self.state][role[:1]]
            yield role, text


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of codes, then rows, of each conversation to its summary (``at`` is -1), then its repaired rows."""
    now, rows, held, kind = None, [], 0, None
    types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
    names = ["conv", *(f.split()[0] for f in REPAIRED.split(", "))]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, *types], strict=True)], names=names)

    def put(changed: Iterator[tuple[str, str]]) -> int:
        size = 0
        for role, text in changed:
            rows.append((now.key, now.at, role, text, *[None] * 7))
            now.at += 1
            size += len(text) + 100
        return size

    def head() -> int:
        summary = now.decide()
        rows.append((now.key, -1, None, None, *summary))
        return len(summary[-1]) + 100

    def end() -> int:
        size = head() if now.audit is None else 0
        return size + put(now.inserted())

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*batch.columns, strict=True):
            conv, codes, first, last, turns, role, text, copies = (c.as_py() for c in row)
            if now is None or conv != now.key:
                held += end() if now else 0
                now = _Conversation(conv)
            if codes is not None:
                now.add(codes, first, last, turns)
                continue
            if now.audit is None:
                held += head()
            for _ in range(copies):
                held += put(now.edited(role, text))
            held += len(text)
            if held > 4 << 20:
                yield out()
                rows, held = [], 0
    if now is not None:
        end()
        yield out()


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: str | None) -> DataFrame:
    """conv, turn, role, text, copies, digest, initial, fault of each row."""
    n = F.col(f"`{copies}`").cast("long") if copies else F.lit(1).cast("long")
    out = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"), n.alias("copies"))
    initial = F.substring("role", 1, 1)
    code = F.lit(len(INITIALS))
    for k, c in enumerate(INITIALS):
        code = F.when(initial == c, k).otherwise(code)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), SOUND).otherwise(CUT)
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return out.withColumn("digest", digest).withColumn("initial", code).withColumn("fault", fault)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: str | None = None, piece: int = PIECE) -> DataFrame:
    """The repaired rows (``at`` 0, 1, ...: role, text) of each conversation after a row with ``at`` -1 that counts its faults.

    Rows stand together and in order within partitions.  ``copies`` names a column of how often a row stands there;
    0 keeps nothing of it but its conversation.
    """
    one = prepared(rows, conv_col, turn_col, role_col, text_col, copies)
    there = F.col("copies") > 0
    keyed = one.select("conv", *[F.when(there, F.col(c)).alias(c) for c in SORTED], "copies", F.when(there, F.col("initial")).alias("initial"), F.when(there, F.col("fault")).alias("fault"))
    units = keyed.groupBy("conv", *SORTED, "initial", "fault").agg(F.sum("copies").alias("copies"))
    more = units.filter("copies > 0").groupBy(F.col("conv").alias("c_conv"), F.col("digest").alias("c_digest")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = units.join(more, units["conv"].eqNullSafe(more["c_conv"]) & (F.col("digest") == F.col("c_digest")), "left")
    again = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False)) & F.col("first").isNotNull()
    parts = input_partitions(rows)
    ordered = met.select("conv", *SORTED, "initial", "fault", again.alias("again"), "copies").repartitionByRange(parts, "conv", *SORTED).sortWithinPartitions("conv", *SORTED)
    kind = one.schema["conv"].dataType.simpleString()
    pieces = ordered.select("conv", "turn", "initial", "fault", "again", "copies").mapInArrow(tidy(_codes(piece)), f"conv {kind}, {CODES}")
    stream = pieces.unionByName(one.filter(there).select("conv", *SORTED, "text", "copies"), allowMissingColumns=True)
    stream = stream.repartition(parts, "conv").sortWithinPartitions("conv", F.col("codes").isNull(), "part", "piece", *SORTED)
    stream = stream.select("conv", "codes", "first_turn", "last_turn", "turns", "role", "text", "copies")
    return stream.mapInArrow(tidy(_repaired), f"conv {kind}, {REPAIRED}").withColumnRenamed("conv", conv_col)


def repaired_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of all repaired conversations, numbered anew."""
    out = repaired(rows, conv_col, turn_col, role_col, text_col).filter("at >= 0")
    return out.select(F.col(f"`{conv_col}`"), F.col("at").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, sha = None, None
    for batch in batches:
        done = []
        for at, role, text, row in zip(*(batch.column(k) for k in (1, 2, 3)), range(batch.num_rows), strict=True):
            at = at.as_py()
            if at < 0:
                if head is not None:
                    done.append((*head, sha.hexdigest()))
                head, sha = [batch.column(k)[row].as_py() for k in (0, *range(4, batch.num_columns))], hashlib.sha256()
            else:
                sha.update(f"{chr(10) if at else ''}{role.as_py()}:{text.as_py()}".encode("utf-8", "surrogatepass"))
        if done:
            yield _summaries(done, batch.schema)
        kept = batch.schema
    if head is not None:
        yield _summaries([(*head, sha.hexdigest())], kept)


def _summaries(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    fields = [schema.field(k) for k in (0, *range(4, len(schema)))]
    types, names = [f.type for f in fields] + [pa.string()], [f.name for f in fields] + ["repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def summarised(repaired_rows: DataFrame) -> DataFrame:
    """One row a conversation, from ``repaired``: counts of faults, cost, audit and a digest of the repaired rows, in the stream's order."""
    conv = repaired_rows.schema[0]
    return repaired_rows.mapInArrow(tidy(_digests), f"`{conv.name}` {conv.dataType.simpleString()}, {SUMMARY}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row in four dropped, emptied, cut, repeated or given to the user, by its key's crc32."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    changed = F.when(h == 1, "").when(h == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(text("role")).alias("role"), changed.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(repaired(damaged(table(spark, sf_dir, "conversations")), copies="copies"))


#: The least of (cost, letters, rows) over edits, from the last row back, for each state of the automaton.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda j: ord(s[j])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, crc),
rows AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
faulty AS (SELECT conv_id, i, turn, role, text, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
best(conv_id, i, f0, f1, f2, f3) AS (
  SELECT conv_id, n, {'c': 0, 'a': '', 'r': ''}, {'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}, {'c': 2, 'a': 'I', 'r': 'assistant:'}, {'c': 0, 'a': '', 'r': ''} FROM counts
  UNION ALL
  SELECT conv_id, i, least(g0, u0, ua0), least(g1, u0, ua0), least(g2, a2, au2), least(g3, u0, ua0) FROM (
    SELECT *, {'c': g2.c + 2, 'a': 'I' || g2.a, 'r': 'user:' || CASE g2.r WHEN '' THEN '' ELSE chr(10) || g2.r END} AS u0,
      {'c': g3.c + 4, 'a': 'II' || g3.a, 'r': 'user:' || chr(10) || 'assistant:' || CASE g3.r WHEN '' THEN '' ELSE chr(10) || g3.r END} AS ua0,
      {'c': g3.c + 2, 'a': 'I' || g3.a, 'r': 'assistant:' || CASE g3.r WHEN '' THEN '' ELSE chr(10) || g3.r END} AS a2,
      {'c': g2.c + 4, 'a': 'II' || g2.a, 'r': 'assistant:' || chr(10) || 'user:' || CASE g2.r WHEN '' THEN '' ELSE chr(10) || g2.r END} AS au2
    FROM (
      SELECT b.conv_id, b.i - 1 AS i,
        least({'c': f0.c + 3, 'a': 'D' || f0.a, 'r': f0.r}, CASE WHEN free AND role[1] = 's' THEN {'c': f1.c + cut, 'a': 'K' || f1.a, 'r': line || CASE f1.r WHEN '' THEN '' ELSE chr(10) || f1.r END} END, k2, r2) AS g0,
        least({'c': f1.c + 3, 'a': 'D' || f1.a, 'r': f1.r}, k2, r2) AS g1,
        least({'c': f2.c + 3, 'a': 'D' || f2.a, 'r': f2.r}, CASE WHEN free AND role[1] = 'a' THEN {'c': f3.c + cut, 'a': 'K' || f3.a, 'r': line || CASE f3.r WHEN '' THEN '' ELSE chr(10) || f3.r END} END,
          CASE WHEN free THEN {'c': f3.c + cut + 2, 'a': 'R' || f3.a, 'r': 'assistant:' || text || CASE f3.r WHEN '' THEN '' ELSE chr(10) || f3.r END} END) AS g2,
        least({'c': f3.c + 3, 'a': 'D' || f3.a, 'r': f3.r}, k2, r2) AS g3
      FROM (SELECT b.*, x.role, x.text, x.role || ':' || x.text AS line, x.fault IN ('', 'truncated') AS free, (x.fault = 'truncated')::INT AS cut,
          CASE WHEN x.fault IN ('', 'truncated') AND x.role[1] = 'u' THEN {'c': f2.c + (x.fault = 'truncated')::INT, 'a': 'K' || f2.a, 'r': x.role || ':' || x.text || CASE f2.r WHEN '' THEN '' ELSE chr(10) || f2.r END} END AS k2,
          CASE WHEN x.fault IN ('', 'truncated') THEN {'c': f2.c + (x.fault = 'truncated')::INT + 2, 'a': 'R' || f2.a, 'r': 'user:' || x.text || CASE f2.r WHEN '' THEN '' ELSE chr(10) || f2.r END} END AS r2
        FROM best b JOIN faulty x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i) b)))
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(f0.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM k.conv_id AND b.i = 0
"""
