"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?``.

The edits of a conversation are found by depth-first branch-and-bound over its rows. A node
is (rows consumed, grammar state); an explicit stack holds prefixes of edits, a suffix lower
bound for each node says what the rest costs at least, the incumbent is the best (cost,
audit) so far, and a dominance table keeps the best prefix of each node: of two prefixes
that reach a node, one with the larger (cost, audit) can't end better, as prefixes of equal
cost at one node differ in a letter before either ends. The search ends when no open
prefix can beat the incumbent, which proves it.

Long conversations are cut into runs of ``RUN`` rows. A run is searched from each state it
can begin in to each it can end in, and runs are joined in order by the same comparison, so
a search never holds more than a run.

Spark does the rest. Equal rows (conversation, turn, role, text) are counted before the
shuffle; narrow rows (digests, no texts) are range-sorted by (conversation, turn), which
cuts a large conversation into pieces, one a range, searched apart. Rows whose role and text
stood in an earlier turn come from an aggregate joined by ``join_firsts``. Pieces and texts
then meet, sorted by conversation and place: the pieces give the audit, and the texts stream
through a running hash. That hash and the audit are the only things kept of a
conversation (the audit, one character a row, is part of the result); the hash of one
conversation's repaired text is sequential by its definition.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_sql, join_firsts, read, stored
from tessera.llm.kernels import tidied

RUN = 64
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Grammar states: start, after system, after user, after assistant; start and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after a kept row, by its role's initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state that an inserted or rerole'd row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: What closes a conversation in each state: (cost, audit).
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
FAULTS = ("", "blank", "duplicate", "truncated")
_INF = float("inf")
_WHITE = " \t\n\x0b\x0c\r"

Row = tuple[str, int]  # initial of the role, index of the fault


def moves(row: Row, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows consumed, next state) of the edits at a row, in ASCII order."""
    initial, fault = row
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
    if fault in (0, 3):
        more = TRUNCATED if fault == 3 else 0
        if initial in KEPT[state]:
            out.append(("K", more, 1, KEPT[state][initial]))
        out.append(("R", REROLE + more, 1, NEXT[state]))
    return out


def suffix_bounds(rows: list[Row], goal: int) -> list[list[float]]:
    """Least cost from each node to state ``goal`` after the last row, audits aside."""
    after = [0.0 if s == goal else _INF for s in STATES]
    out = [after]
    for row in reversed(rows):
        here = [min([c + after[t] for _, c, used, t in moves(row, s) if used], default=_INF) for s in STATES]
        here[USER], here[ASSISTANT] = min(here[USER], INSERT + here[ASSISTANT]), min(here[ASSISTANT], INSERT + here[USER])
        for s in (START, SYSTEM):
            here[s] = min(here[s], INSERT + here[USER])
        out.append(here)
        after = here
    return out[::-1]


def search(rows: list[Row], start: int, goal: int) -> tuple[int, str] | None:
    """Least (cost, audit) from ``start`` before the rows to ``goal`` after them; None if there is no way."""
    bounds = suffix_bounds(rows, goal)
    if bounds[0][start] == _INF:
        return None
    incumbent: tuple[float, str] = (_INF, "")
    best: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        low = cost + bounds[at][state]
        if low > incumbent[0] or low == incumbent[0] and audit > incumbent[1][: len(audit)]:
            continue
        held = best.get((at, state))
        if held is not None and held <= (cost, audit):
            continue
        best[at, state] = (cost, audit)
        if at == len(rows):
            if state == goal and (cost, audit) < incumbent:
                incumbent = (cost, audit)
            continue
        # the most promising child is taken first, of equal ones the first in ASCII order
        children = [(at + used, to, cost + c, audit + letter) for letter, c, used, to in moves(rows[at], state)]
        children = [c for c in children if c[2] + bounds[c[0]][c[1]] <= incumbent[0]]
        stack.extend(sorted(children, key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True))
    return (int(incumbent[0]), incumbent[1])


Table = dict[tuple[int, int], tuple[int, str]]  # (state before, state after): least (cost, audit)


def run_table(rows: list[Row], starts: tuple[int, ...]) -> Table:
    found = {(s, g): search(rows, s, g) for s in starts for g in STATES}
    return {k: v for k, v in found.items() if v is not None}


def joined_tables(a: Table, b: Table) -> Table:
    out: Table = {}
    for (s, mid), (cost, audit) in a.items():
        for (also, g), (more, rest) in b.items():
            if mid == also:
                way = (cost + more, audit + rest)
                if (s, g) not in out or way < out[s, g]:
                    out[s, g] = way
    return out


def closed(table: Table) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    return min((c + CLOSING[g][0], audit + CLOSING[g][1]) for (s, g), (c, audit) in table.items() if s == START)


def repair(rows: list[Row]) -> tuple[int, str]:
    """Least (cost, audit) of a conversation in one list."""
    table: Table = {(START, START): (0, "")}
    for i in range(0, len(rows), RUN):
        table = joined_tables(table, run_table(rows[i : i + RUN], tuple({g for _, g in table})))
    return closed(table)


class _Piece:
    """What is known of consecutive rows of a conversation."""

    def __init__(self, starts: tuple[int, ...]) -> None:
        self.table: Table = {(s, s): (0, "") for s in starts}
        self.rows: list[Row] = []
        self.counts = [0, 0, 0, 0, 0]  # by fault, then illegal
        self.ends: list[str] | None = None
        self.turns: list | None = None  # least, greatest, distinct

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        if self.ends is None:
            self.ends = [initial, initial]
        else:
            self.counts[4] += self.ends[1] + initial not in ("su", "ua", "au")
            self.ends[1] = initial
        if turn is not None:
            self.turns = [turn, turn, 1] if self.turns is None else [self.turns[0], turn, self.turns[2] + (turn != self.turns[1])]
        self.counts[fault] += 1
        self.rows.append((initial, fault))
        if len(self.rows) == RUN:
            self._search()

    def _search(self) -> None:
        if self.rows:
            self.table = joined_tables(self.table, run_table(self.rows, tuple(sorted({g for _, g in self.table}))))
            self.rows = []

    def written(self) -> str:
        self._search()
        return json.dumps([[[*k, *v] for k, v in self.table.items()], self.counts, self.ends, self.turns])

    def follow(self, text: str) -> None:
        """Takes on the piece after this one."""
        table, counts, ends, turns = json.loads(text)
        self.table = joined_tables(self.table, {(s, g): (c, audit) for s, g, c, audit in table})
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.ends and ends:
            self.counts[4] += self.ends[1] + ends[0] not in ("su", "ua", "au")
        self.ends = [self.ends[0], ends[1]] if self.ends and ends else ends or self.ends
        if self.turns and turns:
            self.turns = [self.turns[0], turns[1], self.turns[2] + turns[2] - (self.turns[1] == turns[0])]
        else:
            self.turns = turns or self.turns


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (conv, part, body) for each conversation in a sorted range of rows (conv, part, turn, initial, fault, copies)."""
    held, key, part, first = None, None, 0, True

    def done(convs: list, parts: list, bodies: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(parts, pa.int32()), pa.array(bodies, pa.string())],
                                          ["conv", "part", "body"])

    kind = pa.int64()
    for batch in batches:
        kind, out = batch.schema.field(0).type, ([], [], [])
        for conv, part, turn, initial, fault, copies in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if held is None or conv != key:
                if held is not None:
                    for column, value in zip(out, (key, part, held.written())):
                        column.append(value)
                # only the first conversation of a range may have begun before it
                held, key, first = _Piece(STATES if first else (START,)), conv, False
            held.add(initial, fault, turn)
            for _ in range(copies - 1):  # repeats of a row are duplicates unless they are blank
                held.add(initial, fault if fault == 1 else 2, turn)
        if out[0]:
            yield done(*out, kind)
    if held is not None:
        yield done([key], [part], [held.written()], kind)


class _Writer:
    """Runs a conversation's rows through its audit into a hash."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.lines = audit, 0, START, 0
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state][role[:1]]
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


_OUT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its pieces, then its rows (conv, part, body, role, text)."""
    names = ["conv", *(part.split()[0] for part in _OUT.split(", "))]
    key, piece, writer, cost = None, None, None, 0
    kind = pa.int64()

    def opened() -> None:
        nonlocal writer, cost
        if writer is None:
            cost, audit = closed(piece.table)
            writer = _Writer(audit)

    def result() -> tuple:
        opened()
        low, high, distinct = piece.turns or (0, 0, 1)
        _, blank, duplicate, truncated, illegal = piece.counts
        return key, high - low + 1 - distinct, blank, duplicate, truncated, illegal, cost, writer.audit, writer.digest()

    def done(rows: list) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        kind, rows = batch.schema.field(0).type, []
        for conv, body, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if piece is None or conv != key:
                if piece is not None:
                    rows.append(result())
                key, piece, writer = conv, _Piece((START,)), None
            if role is None:
                if body is not None:
                    piece.follow(body)
            else:
                opened()
                writer.row(role, text)
        if rows:
            yield done(rows)
    if piece is not None:
        yield done([result()])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with the faults of a crc32 of ``conv_id:turn``, nulls read as one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    hit = rows.withColumn("_kind", kind).filter("_kind != 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), "_kind")
    return hit.select("conv_id", "turn", "role", "text", F.explode(
        F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _fault(text: Column, early: Column) -> Column:
    bare = F.rtrim(text, F.lit(_WHITE))
    return (F.when(bare == "", 1).when(early, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))


def repaired(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are (conv_id, turn, role, text). A null role or text counts as one space, a
    null id is a conversation of its own, null turns come first and leave no gaps. Rows of
    one turn stand in the order of role and digest of the text; equal rows of a turn are
    duplicates of the first. ``convs`` (conv_id) names conversations that come out even
    without rows, with zeros and empty texts. Texts are hashed whole and streamed; no rows
    and no ``convs`` give no result. Other columns are ignored.
    """
    space = F.lit(" ")
    texts = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    texts = texts.withColumn("sum", F.sha2(F.col("text").cast("binary"), 256))
    narrow = texts.select("conv", "turn", "role", "sum", _fault(F.col("text"), F.lit(False)).alias("fault"))
    counted = stored(narrow.groupBy("conv", "turn", "role", "sum").agg(
        F.max("fault").alias("fault"), F.count(F.lit(1)).cast("int").alias("copies")))
    # the same role and text in an earlier turn: nulls are the earliest
    same = F.concat_ws(":", "sum", F.coalesce(F.col("conv").cast("string"), F.lit("-")), "role")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = counted.withColumn("same", same).withColumn("place", place)
    firsts = (keyed.groupBy("same").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    marked = join_firsts(keyed, firsts, "same", "rows")
    early = F.coalesce(F.col("least") < F.col("place"), F.lit(False))
    fault = F.when((F.col("fault") != 1) & early, 2).otherwise(F.col("fault"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "sum")]
    ranges = (marked.select("conv", "turn", "role", "sum", fault.alias("fault"), "copies").repartitionByRange(*order)
              .sortWithinPartitions(*order)
              .select("conv", F.spark_partition_id().alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies"))
    kind = texts.schema["conv"].dataType
    pieces = ranges.mapInArrow(lambda it: tidied(_pieces(it)), f"conv {kind.simpleString()}, part int, body string")
    none = F.lit(None)
    known = (rows if convs is None else convs).select(F.col("conv_id").alias("conv")).distinct().select(
        "conv", F.lit(-1).alias("part"), none.cast("string").alias("body"))
    heads = known.unionByName(pieces).select("conv", "part", "body", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                                             none.cast("string").alias("sum"), none.cast("string").alias("text"))
    body = texts.select("conv", F.lit(2**31 - 1).alias("part"), none.cast("string").alias("body"), "turn", "role", "sum", "text")
    met = heads.unionByName(body).repartition("conv").sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in ("conv", "part", "turn", "role", "sum")]).select("conv", "body", "role", "text")
    out = met.mapInArrow(lambda it: tidied(_results(it)), f"conv {kind.simpleString()}, {_OUT}")
    return out.withColumnRenamed("conv", "conv_id")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows), rows)


_CRC_SQL = crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
OP11_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_SQL} % 20 AS k FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS c FROM src WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), c) AS pos,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS nth,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2
             WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, max(pos) AS n FROM f GROUP BY conv_id),
bad AS (SELECT conv_id, count(*) AS illegal FROM (
          SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM f) WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
ins(s, t, c, a, r) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
  (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
keep(s, i, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
other(s, t, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
act AS (SELECT conv_id, pos, s, s AS t, 2 AS c, 'D' AS a, '' AS r FROM f, other
  UNION ALL SELECT conv_id, pos, s, t, CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text
    FROM f JOIN keep ON f.i = keep.i WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, pos, s, t, CASE WHEN fault = 3 THEN 6 ELSE 1 END, 'R', chr(10) || other.role || ':' || text
    FROM f, other WHERE fault IN (0, 3)),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS s, {{'c': 0, 'a': '', 'r': ''}} AS w FROM conversations
  UNION ALL
  SELECT dp.conv_id, dp.pos + 1, act.t, min({{'c': w.c + ins.c + act.c, 'a': w.a || ins.a || act.a, 'r': w.r || ins.r || act.r}})
  FROM dp JOIN ins ON dp.s = ins.s
  JOIN act ON act.conv_id IS NOT DISTINCT FROM dp.conv_id AND act.pos = dp.pos + 1 AND act.s = ins.t
  GROUP BY dp.conv_id, dp.pos, act.t),
best AS (SELECT dp.conv_id, min({{'c': w.c + ins.c, 'a': w.a || ins.a, 'r': w.r || ins.r}}) AS w
         FROM dp JOIN ins ON dp.s = ins.s AND ins.t IN (0, 3) LEFT JOIN stat ON dp.conv_id IS NOT DISTINCT FROM stat.conv_id
         WHERE dp.pos = coalesce(n, 0) GROUP BY dp.conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit,
       sha256(substr(w.r, 2)) AS repaired_sha256
FROM best LEFT JOIN stat ON best.conv_id IS NOT DISTINCT FROM stat.conv_id LEFT JOIN bad ON best.conv_id IS NOT DISTINCT FROM bad.conv_id
"""
