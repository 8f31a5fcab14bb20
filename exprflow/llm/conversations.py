"""Repair of conversations: the cheapest edits that make their turns alternate, as streams over sorted partitions.

Rows go to the partition of their conversation once and are sorted there by turn. A first stream reads each conversation from its
end, carries the costs of the four states of the role automaton across Arrow batches, and adds one byte to each row: the best first edit in
each state. Those bytes are the backpointers; they travel as a column, which Spark's sort spills to disk with its rows,
so a giant conversation takes no more of a worker's memory than a short one. A second stream reads forward and follows them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
#: Costs of an edit: keep, rerole, delete, insert, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: start, after system, after user, after assistant; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role given by an edit leads to, by state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Edits in ASCII order, as two bits of a backpointer.
EDITS = "DIKR"
END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")


def keeps(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role can't stand."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state in (START, SYSTEM, ASSISTANT):
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def step_back(after: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
    """Costs to the end in each state before a row, and its backpointers, from the costs after it.

    Of edits of equal cost the first in ASCII order is taken; as no edit but Keep is free and the rest of the
    way is the cheapest too, that spells the least string of edits.
    """
    more, must_go = TRUNCATED if fault == "truncated" else 0, fault in ("blank", "duplicate")
    by_edit = []
    for s in range(4):
        costs = {"D": DELETE + after[s]}
        if not must_go:
            kept = keeps(s, initial)
            if kept is not None:
                costs["K"] = more + after[kept]
            costs["R"] = REROLE + more + after[NEXT[s]]
        by_edit.append(costs)
    row = [min(c.values()) for c in by_edit]
    cost = tuple(min(row[s], INSERT + row[NEXT[s]], 2 * INSERT + row[NEXT[NEXT[s]]]) for s in range(4))
    pointers = 0
    for s in range(4):
        costs = by_edit[s] | {"I": INSERT + cost[NEXT[s]]}
        pointers |= next(i for i, e in enumerate(EDITS) if costs.get(e) == cost[s]) << 2 * s
    return cost, pointers


def _backwards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``_choice`` and the distance ``_back`` from the end to rows that come from the end of each conversation."""
    memo: dict[tuple, tuple[tuple[int, ...], int]] = {}
    conv, costs, back = object(), END, 0
    for pdf in batches:
        choices, places = [], []
        for c, absent, initial, fault in zip(pdf["conv_id"], pdf["absent"], pdf["initial"], pdf["fault"], strict=True):
            c = None if pd.isna(c) else c
            if c != conv:
                conv, costs, back = c, END, 0
            choice = 0
            if not absent:
                low = min(costs)
                key = tuple(x - low for x in costs), initial, fault
                if key not in memo:  # few: costs of two states differ by some ten at most
                    memo[key] = step_back(*key)
                costs, choice = memo[key]
                costs = tuple(x + low for x in costs)
            choices.append(choice)
            places.append(back)
            back += 1
        yield pdf.assign(_choice=pd.Series(choices, index=pdf.index, dtype="int32"), _back=pd.Series(places, index=pdf.index, dtype="int64"))


OUT = "conv_id string, step long, edit string, turn string, role string, text string, fault string, illegal boolean, cost long"


def _forwards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows the backpointers; rows come in order. A row of edit '' stands for an absent one."""
    conv, state, step, before = object(), START, 0, ""
    out: list[tuple] = []

    def insert() -> None:
        nonlocal state, step
        state = NEXT[state]
        out.append((conv, step, "I", None, ROLES[state], "", None, False, INSERT))
        step += 1

    for pdf in batches:
        for c, absent, turn, role, text, initial, fault, choice in zip(*(pdf[k] for k in ("conv_id", "absent", "turn", "role", "text", "initial", "fault", "_choice")), strict=True):
            c, turn = None if pd.isna(c) else c, None if pd.isna(turn) else turn
            if c != conv:
                while END[state]:
                    insert()
                conv, state, step, before = c, START, 0, ""
            if absent:
                out.append((c, step, "", None, None, None, None, False, 0))
                step += 1
                continue
            while (edit := EDITS[choice >> 2 * state & 3]) == "I":
                insert()
            fault = None if pd.isna(fault) else fault
            cost = DELETE
            if edit != "D":
                state = keeps(state, initial) if edit == "K" else NEXT[state]
                cost = (REROLE if edit == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
            out.append((c, step, edit, turn, ROLES[state] if edit == "R" else role, text, fault, before != "" and before + initial not in LEGAL, cost))
            # a role without a first character still stands next to the following row
            step, before = step + 1, initial or "?"
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
            out = []
    while END[state]:
        insert()
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def _digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    conv, open_, counts, edits, digest, turns = None, False, {}, [], None, None

    def row() -> tuple:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (conv, gaps, *(counts[f] for f in FAULTS), counts["illegal"], counts["cost"], "".join(edits), digest.hexdigest())

    for pdf in batches:
        done = []
        for c, edit, turn, role, text, fault, illegal, cost in zip(*(pdf[k] for k in ("conv_id", "edit", "turn", "role", "text", "fault", "illegal", "cost")), strict=True):
            c = None if pd.isna(c) else c
            if not open_ or c != conv:
                if open_:
                    done.append(row())
                conv, open_, edits, digest, turns, first = c, True, [], hashlib.sha256(), None, True
                counts = dict.fromkeys((*FAULTS, "illegal", "cost"), 0)
            edits.append(edit)
            counts["illegal"] += bool(illegal)
            counts["cost"] += int(cost)
            if not pd.isna(fault):
                counts[fault] += 1
            if not pd.isna(turn):
                t = int(turn)
                turns = (t, t, 1) if turns is None else (turns[0], t, turns[2] + (t != turns[1]))
            if edit in ("K", "R", "I"):
                digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
            if len(edits) >= 4096:
                edits = ["".join(edits)]
        if done:
            yield pd.DataFrame(done, columns=names)
    if open_:
        yield pd.DataFrame([row()], columns=names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each edit of each conversation, in order of ``step``: conv_id, step, edit, turn, role, text, fault, illegal, cost.

    ``rows`` holds conv_id, turn, role and text, and optionally ``absent``, true for rows that only name their conversation; other
    columns are ignored. Edits: K keeps a row, R gives it the role that can stand there, D deletes it, I inserts a row without text; they are
    the cheapest that give role initials ``(s?(ua)+)?``, and of equal ones the least in ASCII order. ``role`` and ``text`` are those after the
    edit (of a deleted row, before it). Faults: blank (no character but white space), duplicate (role and text stood earlier in the
    conversation), truncated (doesn't end in one of ``.!?``). ``illegal``: the initials of the row and the one before aren't su, ua or au.

    Order: turn, nulls first; equal turns by role and text. A null conv_id is a conversation, null roles and texts are one blank. One exchange; a
    conversation's rows pass through one task, as a stream: memory is bounded by a batch, its time is not.
    """
    types = dict(rows.dtypes)
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in types else F.lit(False)
    key = F.col("conv_id").cast("string").alias("conv_id")
    flat = rows.select(key, "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], absent.alias("absent"))
    flat = flat.repartition("conv_id")
    same = Window.partitionBy("conv_id", "absent", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    known = flat.withColumn("fault", F.when(~F.col("absent"), fault)).withColumn("initial", F.left("role", F.lit(1)))
    known = known.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc(F.coalesce(F.col("fault") == "duplicate", F.lit(False))))
    known = known.withColumn("turn", F.col("turn").cast("string"))
    back = known.mapInPandas(_backwards, "conv_id string, turn string, role string, text string, absent boolean, fault string, initial string, _choice int, _back long")
    return back.sortWithinPartitions("conv_id", F.desc("_back")).mapInPandas(_forwards, OUT).withColumns({c: F.col(c).cast(types[c]) for c in ("conv_id", "turn")})


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair_conversations``, whose rows have to stand as it gives them: gaps, faults, illegal, cost, the edits
    as one string, and the SHA-256 of the repaired ``role:text`` lines. All in one stream; an absent row adds nothing."""
    kind = dict(repaired.dtypes)["conv_id"]
    text = repaired.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    out = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return text.mapInPandas(_digests, out).withColumn("conv_id", F.col("conv_id").cast(kind))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays as ``absent``), 1 empties its text, 2 takes
    its ``.!?``, 3 repeats it, 4 makes its role user. Nulls count as one blank."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("absent"), F.explode(copies).alias("_copy")).drop("_copy")


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::BIGINT)),
      lambda c, b: xor(c >> 8, t.tab[(xor(c, b) & 255) + 1]))"""

#: Row by row in a recursive query: of each state of the automaton the cheapest edits so far, and of equal ones the least string.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i AS n, i::BIGINT AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), t AS MATERIALIZED (SELECT list(v ORDER BY n) AS tab FROM bits WHERE k = 8),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
), k AS (SELECT c.*, xor({_CRC.format(s="c.s")}, 4294967295::BIGINT) % 20 AS kind FROM c, t),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE kind <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM o
), g AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
ins(s, k, s2) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
nxt(s, s2) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
kept(s, initial, s2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
mid(s, k, text) AS (SELECT s, k, CASE k WHEN 0 THEN '' WHEN 1 THEN ['user', 'user', 'assistant', 'user'][s + 1] || ':' || chr(10)
    ELSE ['user', 'user', 'assistant', 'user'][s + 1] || ':' || chr(10) || ['assistant', 'assistant', 'user', 'assistant'][s + 1] || ':' || chr(10) END FROM ins),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} AS b FROM g
  UNION ALL
  SELECT conv_id, i, s2, min({{'cost': cost, 'audit': audit, 'out': out}}) FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.s2, w.b.cost + 3 * ins.k + e.cost AS cost, w.b.audit || repeat('I', ins.k) || e.edit AS audit, w.b.out || mid.text || e.line AS out
    FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN ins ON ins.s = w.s JOIN mid ON mid.s = ins.s AND mid.k = ins.k,
    LATERAL (
      SELECT ins.s2 AS s2, 4 AS cost, 'D' AS edit, '' AS line
      UNION ALL SELECT kept.s2, CASE g.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', g.role || ':' || g.text || chr(10) FROM kept
        WHERE kept.s = ins.s2 AND kept.initial = g.initial AND g.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT nxt.s2, 3 + CASE g.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'R', CASE nxt.s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || g.text || chr(10) FROM nxt
        WHERE nxt.s = ins.s2 AND g.fault NOT IN ('blank', 'duplicate')
    ) e
  ) x GROUP BY conv_id, i, s2
), n AS (SELECT conv_id, count(*) AS n FROM g GROUP BY 1),
best AS (
  SELECT w.conv_id, min({{'cost': w.b.cost + 3 * ins.k, 'audit': w.b.audit || repeat('I', ins.k), 'out': w.b.out || mid.text}}) AS b
  FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n JOIN ins ON ins.s = w.s AND ins.s2 IN (0, 3) JOIN mid ON mid.s = ins.s AND mid.k = ins.k
  GROUP BY 1
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.b.cost, 0)::BIGINT AS cost,
  coalesce(best.b.audit, '') AS audit, sha256(coalesce(left(best.b.out, length(best.b.out) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
