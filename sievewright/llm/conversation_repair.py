"""Structure of conversations: faults of their turns, and the cheapest edits that make roles alternate again.

Roles may be an optional system turn and then pairs of user and assistant. The repair is a dynamic programme over retained
turns (kept, or given another role): the turns between two retained ones are deleted, which a prefix sum of deletions
prices, and what must be inserted between them follows from the pair of their roles. For each role that a retained turn
can have, one running minimum over all turns so far (cost before it without its deletions, and the edits so far) is all
that a later turn needs, so a conversation is read once, in order, and never held.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns' roles by the initial that stands for them; only the last two are ever given to a turn.
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: What stands between the roles of two turns that are retained one after the other; "" is the beginning or the end.
BETWEEN = {
    "": {"s": "", "u": "", "a": "u", "": ""},
    "s": {"u": "", "a": "u", "": "ua"},
    "u": {"u": "a", "a": "", "": "a"},
    "a": {"u": "", "a": "u", "": ""},
}
#: From so many characters on, what all paths' edits have in common is put aside.
SETTLE = 256
#: What it costs at most to go on from one last role as if it were another one (key: as if; value: from, cost): an insertion
#: makes u of a and a of u; after a goes all that goes after s; a kept s still to come is deleted instead; a lone s needs a pair.
INSTEAD = {
    "": [("a", DELETE), ("u", DELETE + INSERT), ("s", 2 * INSERT)],
    "s": [("a", 0), ("u", INSERT)],
    "u": [("a", INSERT)],
    "a": [("u", INSERT)],
}
BLANK, DUPLICATE, CUT = 1, 2, 3
DAMAGE = 20
NOT_SPACE = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage, by the CRC-32 of `conv_id:turn`; a dropped row stays with copy 0, so that
    its conversation is known. Null roles and texts are one space, as are nulls in the hashed name."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % DAMAGE).alias("_d"))
    copies = F.when(F.col("_d") == 0, F.array(F.lit(0))).when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def with_faults(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of damaged() with their fault (0: none), each conversation in order within one partition.

    Conversations are shuffled once; the window that finds earlier turns with the same role and text keeps that partitioning.
    Turns that are equal in conversation and turn are ordered by role, text and copy.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "_h", F.col("copy") == 0).orderBy(F.col("turn").asc_nulls_first(), "copy"))
    fault = (
        F.when(F.col("copy") == 0, 0).when(~F.col("text").rlike(NOT_SPACE), BLANK).when(F.col("_n") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"(?s)[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    )
    marked = dealt.withColumn("_h", digest).withColumn("_n", seen).withColumn("fault", fault).drop("_h", "_n")
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy")


@dataclass
class Path:
    """The best way to a retained turn: its cost less the prefix sum of deletions, edits since what is settled, hash of the output."""

    base: int
    edits: str
    digest: object
    empty: bool = True

    def wrote(self, lines: list[str]) -> tuple[object, bool]:
        """Hash and emptiness of the output with more lines."""
        if not lines:
            return self.digest, self.empty
        digest = self.digest.copy()
        digest.update((("" if self.empty else "\n") + "\n".join(lines)).encode())
        return digest, False


class Repair:
    """The programme's state for one conversation.

    paths holds, for each role of the last retained turn ("": none yet), the running minimum over all turns read. Of equal
    costs the least edits win, byte by byte; deletions stand in front of what is inserted beside them, being the lesser.
    The edits that all paths begin with are put aside, so that a long conversation isn't copied for each of its turns.
    """

    def __init__(self) -> None:
        self.paths, self.rows, self.settled = {"": Path(0, "", hashlib.sha256())}, 0, []

    def step(self, role: str, text: str, fault: int) -> None:
        before, after = DELETE * self.rows, DELETE * (self.rows + 1)
        choices = [("R", r, name, REROLE) for r, name in NAMES.items()]
        if role[:1] in ("s", "u", "a"):
            choices.append(("K", role[:1], role, 0))
        made: dict[str, tuple[int, str, Path, str, str]] = {}
        for letter, r, name, price in () if fault in (BLANK, DUPLICATE) else choices:
            for last, path in self.paths.items():
                if (between := BETWEEN[last].get(r)) is not None:
                    cost = path.base + before + INSERT * len(between) + price + TRUNCATED * (fault == CUT)
                    one = cost - after, f"{path.edits}{'I' * len(between)}{letter}", path, between, name
                    if r not in made or one[:2] < made[r][:2]:
                        made[r] = one
        paths = dict(self.paths)
        for path in paths.values():  # as long as nothing later is retained, this turn is deleted
            path.edits += "D"
        for r, (base, edits, path, between, name) in made.items():
            if r not in paths or (base, edits) < (paths[r].base, paths[r].edits):
                paths[r] = Path(base, edits, *path.wrote([f"{NAMES[x]}:" for x in between] + [f"{name}:{text}"]))
        cheap = lambda last, p: all(p.base <= paths[x].base + cost for x, cost in INSTEAD[last] if x in paths)
        paths = {last: p for last, p in paths.items() if cheap(last, p)}  # the others can't be the best any more
        self.paths, self.rows = paths, self.rows + 1
        if min(len(p.edits) for p in paths.values()) > SETTLE:
            common = os.path.commonprefix([p.edits for p in paths.values()])
            self.settled.append(common)
            for p in paths.values():
                p.edits = p.edits[len(common):]

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and SHA-256 of the repaired conversation."""
        cost, edits, last = min((p.base + DELETE * self.rows + INSERT * len(BETWEEN[last][""]), p.edits + "I" * len(BETWEEN[last][""]), last) for last, p in self.paths.items())
        digest, _ = self.paths[last].wrote([f"{NAMES[x]}:" for x in BETWEEN[last][""]])
        return cost, "".join(self.settled) + edits, digest.hexdigest()


class Conversation:
    """Counts of one conversation's faults and gaps, and its repair, from rows in order."""

    def __init__(self) -> None:
        self.repair, self.faults, self.illegal, self.last = Repair(), [0, 0, 0, 0], 0, None
        self.first_turn = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.turn
            self.turn = turn
        self.repair.step(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.first_turn + 1 - self.turns
        return (gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, *self.repair.end())


OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows from with_faults().

    A task reads its conversations one row after the other and holds one batch of them; of a conversation it keeps sums,
    at most four paths (those that can still be the best) and the edits themselves, whatever its length.
    """
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, ids, out, arrow = None, None, [], [], None

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow), *(pa.array([r[k] for r in out], pa.int64() if k < 6 else pa.string()) for k in range(8))], ["conv_id", *OUT])

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for c, turn, role, text, copy, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copy", "fault")), strict=True):
                if state is None or c != conv:
                    if state:
                        ids.append(conv)
                        out.append(state.row())
                    conv, state = c, Conversation()
                if copy:
                    state.add(turn, role, text, fault)
            if len(ids) >= 4096:
                yield flushed()
                ids, out = [], []
        if state:
            ids.append(conv)
            out.append(state.row())
            yield flushed()

    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copy", "fault").mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Damages conversations(conv_id, turn, role, text) by hash, counts their faults, and returns the cheapest repair of each.

    Every conv_id of the table has a row, null being one of them; one whose rows all went has zeros, no edits and the hash
    of nothing. Null roles and texts are one space. Rows of equal turns are in order of role and text. A conversation is
    read by one task, since its hash and its edits are one string each; an empty table gives no rows.
    """
    return repaired(with_faults(damaged(conversations)))


def repair_sql() -> str:
    """DuckDB SQL: CRC-32 bit by bit, and a recursive walk over rows in which every state of the role automaton keeps its best (cost, audit, text)."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda b: ascii(b)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    blank, cut = "NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]')", "NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$')"
    # e0 to e3: nothing yet, after s, after u, after a. Each is (cost, audit, text) and is compared in this order.
    made = lambda c, a, t: f"{{'c': {c}, 'a': {a}, 't': {t}}}"
    more = lambda s, line: f"CASE WHEN {s}.t = '' THEN '' ELSE {s}.t || chr(10) END || {line}"
    none = made("1000000000::BIGINT", "''", "''")
    inserted = lambda s, name: made(f"{s}.c + {INSERT}", f"{s}.a || 'I'", more(s, f"'{name}:'"))
    gone = lambda s: made(f"{s}.c + {DELETE}", f"{s}.a || 'D'", f"{s}.t")

    def retained(source: str, initial: str, name: str | None) -> list[str]:
        kept = made(f"{source}.c + extra", f"{source}.a || 'K'", more(source, "role || ':' || text"))
        out = [f"CASE WHEN NOT must_go AND i = '{initial}' THEN {kept} ELSE {none} END"]
        if name:
            other = made(f"{source}.c + extra + {REROLE}", f"{source}.a || 'R'", more(source, f"'{name}:' || text"))
            out.append(f"CASE WHEN NOT must_go THEN {other} ELSE {none} END")
        return out

    users = ", ".join(x for s in ("f0", "f1", "f3") for x in retained(s, "u", "user"))
    return f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, {crc} % {DAMAGE} AS d FROM named),
shaped AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM shaped),
seen AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, role, text) AS first_pos, substr(role, 1, 1) AS i FROM placed),
faults AS (SELECT *, CASE WHEN {blank} THEN 1 WHEN pos > first_pos THEN 2 WHEN {cut} THEN 3 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM seen),
turns AS (SELECT conv_id, pos, role, text, i, fault IN (1, 2) AS must_go, CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END AS extra FROM faults),
walk AS (SELECT conv_id, 0::BIGINT AS pos, {made("0::BIGINT", "''", "''")} AS e0, {none} AS e1, {none} AS e2, {none} AS e3 FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL
 SELECT conv_id, pos, {gone("f0")} AS e0, least({gone("f1")}, {retained("f0", "s", None)[0]}) AS e1, least({gone("f2")}, {users}) AS e2, least({gone("f3")}, {", ".join(retained("f2", "a", "assistant"))}) AS e3
 FROM (SELECT *, least(e3, {inserted("f2", "assistant")}) AS f3 FROM
  (SELECT *, least(e2, {inserted("e0", "user")}, {inserted("e1", "user")}, {inserted("e3", "user")}) AS f2 FROM
   (SELECT w.conv_id, t.pos, e0, e0 AS f0, e1, e1 AS f1, e2, e3, t.role, t.text, t.i, t.must_go, t.extra FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1)))),
ends AS (SELECT conv_id, pos, least(e0, e3, {inserted("e2", "assistant")}, {inserted("f2", "assistant")}) AS b FROM (SELECT *, least({inserted("e0", "user")}, {inserted("e1", "user")}) AS f2 FROM walk)),
best AS (SELECT conv_id, max_by(b, pos) AS b FROM ends GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, (b.b).c::BIGINT AS cost, (b.b).a AS audit, sha256((b.b).t) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
