"""Repair of conversation structure by alignment to the alternating grammar ``(s?(ua)+)?``.

A conversation's turns, in order, are aligned to the grammar's strings of every feasible length (Wagner and Fischer, 1974). Edits: Keep
costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and repeated turns), Insert an empty user or assistant turn 5; a
truncated turn that isn't deleted adds 5. Strings with one beginning are prefixes of each other, so one table has the cost of every
length in its last row. Cells are limited to Ukkonen's band: those that a path within the incumbent's cost (a greedy repair's) and what
another ending may cost more can reach. Of each length at the least cost the edits are traced back, and the ASCII-least string of edit
initials is the audit.

A conversation of more than ``SEGMENT`` turns is aligned in segments, from every state of the grammar that is still in play to every
state (nothing yet, after s, u, a). Costs add up and audits are strings one after another; two audits of one segment that end in the same
state at the same cost are never prefixes of each other (they hold as many Inserts), so the least of each state is the least in the
whole. A state that costs over ``SLACK`` more than another can't win any more: whatever follows it, the other can follow with edits for
``SLACK`` or less. What all states in play have in common is final and is put out, so a long conversation passes through in bounded memory.

Turns are dealt by conversation and sorted (both on disk where memory doesn't suffice); marks that look at one turn are made before,
repeated turns are numbered by a window over the same dealing. A conversation's repaired text has one digest, which only one task can
make, in order: a very large conversation is streamed by it, never held.

Defined cases: nulls in role and text are one space. Turns come by turn number, nulls first, ties by role and text. A role that begins with none
of s, u, a (an empty one too) can't be kept. The null conv_id is a conversation. One whose turns are all dropped gives zeros and an empty
audit. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from embedlens.llm.shared import remembered, tidy

SPACE = " \t\n\x0b\x0c\r"
#: Turns that one table aligns.
SEGMENT = 64
#: What following another state's edits can cost at most; see the module.
SLACK = 12
#: Alignments that a worker remembers; at this count it starts anew. Only speed depends on it.
MEMORY = 100_000
#: Rows of a batch that are Python objects at a time.
ROWS = 2_000
RUN = "ua" * SEGMENT * 2
#: Ways to go on after each state: nothing yet, after s, after u, after a.
ONWARD = ((RUN, "s" + RUN), (RUN,), (RUN[1:],), (RUN,))
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NEVER = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: turns damaged by crc32(`conv_id:turn`) mod 20 (nulls are one space): 0 drops a turn, 1 empties
    its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user. Dropped turns stay as marked rows without text."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), h.cast("int").alias("h"))
    text = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 0, "").when(F.col("h") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"))


def state_after(state: int, letter: str) -> int:
    return 1 if letter == "s" else 2 if letter == "u" else 3


def _least_path(table: list[dict[int, int]], costs: list, target: str, j: int) -> str:
    """The ASCII-least edits among the cheapest ones to the end of row ``len(costs)`` and column ``j``."""

    def moves(i: int, j: int):
        """Edits from a cell, least initial first: (initial, row, column, cost)."""
        if i < len(costs):
            yield "D", i + 1, j, 2
        if target[j] != "s":
            yield "I", i, j + 1, 5
        if i < len(costs):
            keep, role = costs[i]
            if keep < NEVER:
                if role == target[j]:
                    yield "K", i + 1, j + 1, keep
                elif target[j] != "s":
                    yield "R", i + 1, j + 1, keep + 1

    best, todo = {(len(costs), j)}, [(len(costs), j)]
    while todo:  # cells on cheapest paths, from the end
        i, k = todo.pop()
        for a, b in ((i - 1, k), (i, k - 1), (i - 1, k - 1)):
            if a >= 0 and b in table[a] and (a, b) not in best and any((x, y) == (i, k) and table[a][b] + c == table[i][k] for _, x, y, c in moves(a, b)):
                best.add((a, b))
                todo.append((a, b))
    at, out = (0, 0), []
    while at != (len(costs), j):
        for letter, x, y, c in moves(*at):
            if (x, y) in best and table[at[0]][at[1]] + c == table[x][y]:
                out.append(letter)
                at = (x, y)
                break
    return "".join(out)


def align(turns: str, state: int = 0) -> dict[int, tuple[int, str]]:
    """(cost, audit) by the state in which the grammar's string ends, for states within ``SLACK`` of the least cost. ``turns`` has two
    characters a turn: the role's initial (other than s, u, a: ``o``), and ``-`` sound, ``x`` to delete, ``t`` truncated."""
    # what keeping a turn costs, and its role
    costs = [(NEVER if turns[i + 1] == "x" else 5 if turns[i + 1] == "t" else 0, turns[i]) for i in range(0, len(turns), 2)]
    sound = [0]
    for keep, _ in costs:
        sound.append(sound[-1] + (keep < NEVER))
    # the incumbent: keep or rerole what is sound, delete the rest
    incumbent, at = 0, state
    for keep, role in costs:
        if keep:
            incumbent += 2
        elif at == 0 and role == "s":
            at = 1
        else:
            letter = "a" if at == 2 else "u"
            incumbent += role != letter
            at = state_after(at, letter)
    spare = incumbent + SLACK - 2 * (len(costs) - sound[-1])
    found: dict[int, list] = {}
    for target in ONWARD[state]:
        table: list[dict[int, int]] = []
        for i in range(len(costs) + 1):
            row, above = {}, table[i - 1] if i else {}
            keep, role = costs[i - 1] if i else (NEVER, "")
            for j in range(max(0, sound[i] - spare // 2), sound[i] + spare // 5 + 1):
                letter = target[j - 1] if j else ""
                cost = 0 if i == j == 0 else above.get(j, NEVER) + 2
                if j and letter != "s":
                    cost = min(cost, row.get(j - 1, NEVER) + 5)
                if j and keep < NEVER and (role == letter or letter != "s"):
                    cost = min(cost, above.get(j - 1, NEVER) + keep + (role != letter))
                if cost < NEVER:
                    row[j] = cost
            table.append(row)
        for j, cost in table[-1].items():
            if cost <= incumbent + SLACK:
                found.setdefault(state if j == 0 else state_after(state, target[j - 1]), []).append((cost, j, table, target))
    out, least = {}, min(x[0] for ends in found.values() for x in ends)
    for end, ends in found.items():
        cost = min(x[0] for x in ends)
        if cost <= least + SLACK:
            out[end] = cost, min(_least_path(table, costs, target, j) for c, j, table, target in ends if c == cost)
    return out


def _aligned(turns: str, state: int) -> dict[int, tuple[int, str]]:
    known = remembered("turns")
    if len(known) > MEMORY:
        known.clear()
    if (turns, state) not in known:
        known[turns, state] = align(turns, state)
    return known[turns, state]


class Conversation:
    """Turns one after another; ``put(initial, role, text, turn)`` gets every edit once it is final."""

    def __init__(self, put):
        self.put, self.symbols, self.state = put, [], 0
        #: segments whose edits aren't final, each a list of (role, text, turn)
        self.segments: list[list] = [[]]
        #: cost and unsettled audits of each state in play
        self.alive: dict[int, tuple[int, list[str]]] = {0: (0, [])}

    def add(self, role: str, text: str, turn, fault: str) -> None:
        if len(self.symbols) == SEGMENT:
            self._step()
        self.symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "o") + fault)
        self.segments[-1].append((role, text, turn))

    def _step(self) -> None:
        turns, reached = "".join(self.symbols), {}
        for state, (cost, audits) in self.alive.items():
            for end, (more, audit) in _aligned(turns, state).items():
                new = cost + more, [*audits, audit]
                if end not in reached or (new[0], "".join(new[1])) < (reached[end][0], "".join(reached[end][1])):
                    reached[end] = new
        least = min(cost for cost, _ in reached.values())
        self.alive = {end: x for end, x in reached.items() if x[0] <= least + SLACK}
        self.symbols = []
        while (lists := [audits for _, audits in self.alive.values()]) and lists[0] and all(x[0] == lists[0][0] for x in lists):
            self._settle(lists[0][0])
            for audits in lists:
                audits.pop(0)
        self.segments.append([])

    def _settle(self, audit: str) -> None:
        turns = iter(self.segments.pop(0))
        for letter in audit:
            role, text, turn = ("", "", None) if letter == "I" else next(turns)
            if letter == "D":
                self.put(letter, role, text, turn)
                continue
            if letter != "K":
                role = "assistant" if self.state == 2 else "user"
            self.state = state_after(self.state, role[:1])
            self.put(letter, role, text, turn)

    def end(self) -> int:
        """The cost of the repair; the rest is put out."""
        if self.symbols:
            self._step()
        cost, audits = min(((cost, "".join(audits)), cost, audits) for end, (cost, audits) in self.alive.items() if end in (0, 3))[1:]
        for audit in audits:
            self._settle(audit)
        return cost


class _Report:
    """One conversation's row."""

    def __init__(self, emit_rows: list | None):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.audit, self.digest, self.kept, self.rows = [], hashlib.sha256(), 0, emit_rows
        self.conversation = Conversation(self._put)

    def _put(self, letter: str, role: str, text: str, turn) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.digest.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
            if self.rows is not None:
                self.rows.append((self.kept, turn, role, text, letter))
            self.kept += 1

    def add(self, turn, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.high  # they ascend
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not again and not blank
        self.conversation.add(role, text, turn, "x" if blank or again else "t" if cut else "-")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        cost = self.conversation.end()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def _streamed(id_type: pa.DataType, emit: str):
    columns = ("conv_id", "turn", "role", "text", "dropped", "blank", "again", "cut")
    names = ["conv_id", "position", "turn", "role", "text", "edit"] if emit == "turns" else ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]
    types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if emit == "turns" else [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, report, rows = None, None, [] if emit == "turns" else None

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
            return batch

        def collect() -> None:
            if rows is not None:
                out.extend((now, *r) for r in rows)
                rows.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for conv, turn, role, text, dropped, blank, again, cut in zip(*(part.column(c).to_pylist() for c in columns)):
                    if report is None or conv != now:
                        if report is not None:
                            row = report.row()
                            collect()
                            if rows is None:
                                out.append((now, *row))
                        now, report = conv, _Report(rows)
                    if not dropped:
                        report.add(turn, role, text, blank, again, cut)
                collect()
                if out:
                    yield flushed()
        if report is not None:
            row = report.row()
            collect()
            if rows is None:
                out.append((now, *row))
        yield flushed()

    return run


def ends_sound(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character other than white space isn't one of ``.!?``."""
    trimmed = F.rtrim(text, F.lit(SPACE))
    return trimmed == "", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")


def repair(turns: DataFrame, emit: str = "report") -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with ``emit="turns"`` the repaired turns
    instead: conv_id, position, turn (null if inserted), role, text, edit. Rows that a boolean column ``dropped`` marks only keep their
    conversation in the result."""
    if emit not in ("report", "turns"):
        raise ValueError("emit must be report or turns")
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), dropped.alias("dropped"))
    blank, cut = ends_sound(F.col("text"))
    rows = rows.select("*", blank.alias("blank"), cut.alias("cut")).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(alike) > 1).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ("position long, turn long, role string, text string, edit string" if emit == "turns" else REPORT)
    return rows.mapInArrow(tidy(_streamed(to_arrow_type(turns.schema["conv_id"].dataType), emit), "turns"), schema)


#: The same rows in SQL: CRC32 by bits, then for every turn the least (cost, audit) of each state of the grammar.
SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS h FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM hashed, (VALUES (0), (1)) v(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
turns AS (
  SELECT *, left(role, 1) AS i, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
states AS (
  SELECT conv_id, 0::BIGINT AS pos, s.state, {'cost': s.cost, 'audit': s.audit, 'lines': s.lines} AS least
  FROM counted, (VALUES (0, 0::BIGINT, '', ''), (2, 5::BIGINT, 'I', chr(10) || 'user:'), (3, 10::BIGINT, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) s(state, cost, audit, lines)
  UNION ALL
  SELECT conv_id, pos, CASE WHEN k = 0 THEN state WHEN (state = 2) = (k = 1) THEN 3 ELSE 2 END AS state,
    min({'cost': cost + 5 * k, 'audit': audit || repeat('I', k::INTEGER), 'lines': lines || CASE WHEN k = 0 THEN '' WHEN state = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END || CASE WHEN k < 2 THEN '' WHEN state = 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END}) AS least
  FROM (
    SELECT conv_id, pos, e.state AS state, e.cost AS cost, e.audit AS audit, e.lines AS lines FROM (
      SELECT t.conv_id, t.pos, unnest([
        {'state': s.state, 'cost': least.cost + 2, 'audit': least.audit || 'D', 'lines': least.lines},
        CASE WHEN fault IN ('', 'truncated') AND (i = CASE WHEN s.state = 2 THEN 'a' ELSE 'u' END OR (i = 's' AND s.state = 0)) THEN
          {'state': CASE i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': least.cost + CASE fault WHEN '' THEN 0 ELSE 5 END, 'audit': least.audit || 'K', 'lines': least.lines || chr(10) || role || ':' || text} END,
        CASE WHEN fault IN ('', 'truncated') THEN
          {'state': CASE WHEN s.state = 2 THEN 3 ELSE 2 END, 'cost': least.cost + CASE fault WHEN '' THEN 1 ELSE 6 END, 'audit': least.audit || 'R', 'lines': least.lines || chr(10) || CASE WHEN s.state = 2 THEN 'assistant' ELSE 'user' END || ':' || text} END]) AS e
      FROM states s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.pos = s.pos + 1) WHERE e IS NOT NULL), range(3) r(k)
  GROUP BY 1, 2, 3),
best AS (SELECT s.conv_id, min(least) AS least FROM states s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = c.n WHERE s.state IN (0, 3) GROUP BY s.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(least.cost, 0) AS cost, coalesce(least.audit, '') AS audit, sha256(coalesce(substr(least.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id
"""
