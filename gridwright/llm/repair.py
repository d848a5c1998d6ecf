"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`, where s, u and a are role initials.

Edits and costs: K keeps a turn (0), R gives it the role user or assistant (3), D deletes it (4), I inserts an empty turn of user or assistant (3). Blank
and duplicate turns must go; a truncated turn that stays costs 3 more. Of equally cheap edits the ASCII-least sequence of initials is taken.

Costs are found backwards: a state (nothing yet, after s, after u, after a) has at each turn the least cost of what follows. Of these vectors only those
at every sqrt(n)-th turn are stored; walking forward, a block's vectors are made again from the checkpoint at its end, and the least tight edit is
emitted. A turn is one byte to this walk (initial and fault), so n turns take n bytes and 2 sqrt(n) vectors.

Texts aren't needed for that: digests of them go to the first pass, which gives a conversation's edits, and the second pass streams its texts past the
edits. Neither holds a conversation; both sort with spill. One conversation's edits are one string and its digest is a chain, so one task walks it: that is
the unit of the operator. Equal turns are found by windows over (conversation, role, digest), which long conversations share among tasks.

Cases: a null role or text is one space (so a null text is blank, a null role has no lawful initial); turns sort by turn, nulls first, then role, then the
text's digest; rows with a null conv_id are one conversation; of equal rows all but the first are duplicates; a conversation without turns needs no
edits; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import BLANK

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
INITIALS = "sua"
#: State after a keep: by initial (s, u, a, any other) and state (start, after s, after u, after a); None: not allowed.
KEEPS = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: State after an inserted or renamed turn, and its role.
NEXT, ROLES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
FINE, TRUNCATED, GONE = range(3)
END = (0, 2 * INSERT, INSERT, 0)


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The states' costs before a turn, from those after it. code: 3 * initial + fault."""
    initial, fault = divmod(code, 3)
    cost, extra = [DELETE + x for x in after], CUT if fault == TRUNCATED else 0
    if fault != GONE:
        for s in range(4):
            cost[s] = min(cost[s], REROLE + extra + after[NEXT[s]])
            if KEEPS[initial][s] is not None:
                cost[s] = min(cost[s], extra + after[KEEPS[initial][s]])
    cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    cost[0], cost[1] = min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2])
    return tuple(cost)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the turns of a conversation."""
    n = len(codes)
    step = isqrt(n) + 1
    marks, at = {n: END}, END
    for i in range(n - 1, -1, -1):
        at = _before(codes[i], at)
        if i % step == 0:
            marks[i] = at
    total, state, audit = at[0], 0, bytearray()
    for start in range(0, n + 1, step):
        stop = min(start + step, n)
        costs = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            costs.append(_before(codes[i], costs[-1]))
        costs.reverse()
        for i in range(start, stop):
            state = _take(codes[i], costs[i - start], costs[i - start + 1], state, audit)
        if stop == n:
            break
    while END[state]:
        audit += b"I"
        state = NEXT[state]
    return total, audit.decode()


def _take(code: int, now: tuple[int, ...], after: tuple[int, ...], state: int, audit: bytearray) -> int:
    """Emits the ASCII-least tight edits up to the one that uses up the turn; the state after it."""
    initial, fault = divmod(code, 3)
    extra = CUT if fault == TRUNCATED else 0
    while True:
        if now[state] == DELETE + after[state]:
            audit += b"D"
            return state
        if now[state] == INSERT + now[NEXT[state]]:
            audit += b"I"
            state = NEXT[state]
            continue
        kept = KEEPS[initial][state]
        if fault != GONE and kept is not None and now[state] == extra + after[kept]:
            audit += b"K"
            return kept
        audit += b"R"
        return NEXT[state]


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, none null but turn and conv_id) with fault: blank, duplicate, truncated or null, and digest, nth."""
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANK)), -1, 1)
    blank = F.length(F.translate("text", BLANK, "")) == 0
    seen = turns.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    seen = seen.withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("blank"), "blank").when(F.col("nth") > 1, "duplicate").when(F.col("cut"), "truncated")
    return seen.withColumn("fault", fault).drop("blank", "cut")


FINDINGS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LAWFUL = ((0, 1), (1, 2), (2, 1))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, a row of findings for each conversation out. A row without `there` only says that its conversation exists."""
    schema, found = None, []
    key, codes, fault_n, turns, illegal, before = (), bytearray(), {}, None, 0, None

    def close() -> None:
        cost, audit = cheapest_edits(bytes(codes))
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        found.append((*key, gaps, *(fault_n.get(x, 0) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        if schema is None:
            longs = [(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            schema = pa.schema([batch.schema.field("conv_id"), *[pa.field(*x) for x in longs], pa.field("audit", pa.string())])
        for conv, turn, first, fault, there in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "there")), strict=True):
            if key != (conv,):
                if key:
                    close()
                key, codes, fault_n, turns, illegal, before = (conv,), bytearray(), {}, None, 0, None
            if not there:
                continue
            initial = INITIALS.find(first) if first else 3
            initial = 3 if initial < 0 else initial
            codes.append(3 * initial + (GONE if fault in ("blank", "duplicate") else TRUNCATED if fault else FINE))
            fault_n[fault] = fault_n.get(fault, 0) + 1
            if before is not None and (before, initial) not in LAWFUL:
                illegal += 1
            before = initial
            if turn is not None:
                if turns is None:
                    turns = [turn, turn, 1]
                elif turn != turns[1]:
                    turns = [turns[0], turn, turns[2] + 1]
        if found:
            yield flush()
            found.clear()
    if key:
        close()
        yield flush()


def find_edits(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For each conversation the columns of FINDINGS. known: conv_ids that may have no turns left."""
    rows = faults(_clean(turns)).select("conv_id", "turn", "role", "digest", "nth", F.substring("role", 1, 1).alias("initial"), "fault", F.lit(True).alias("there"))
    if known is not None:
        rows = rows.unionByName(known.select("conv_id", F.lit(False).alias("there")), allowMissingColumns=True)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "nth").drop("role", "digest", "nth")
    return ordered.mapInArrow(_find, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {FINDINGS}")


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict, tuple]]:
    """A conversation's row of findings, then its turns in order, in; ("open", findings, ()), then ("line", findings, (edit, role, text)) for each turn
    of the repaired conversation, then ("close", findings, ()) out."""
    head, at, state = None, 0, 0

    def inserted():
        nonlocal at, state
        while at < len(head["audit"]) and head["audit"][at] == "I":
            yield "line", head, ("I", ROLES[state], "")
            at, state = at + 1, NEXT[state]

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if head is not None:
                    yield from inserted()
                    yield "close", head, ()
                head, at, state = row, 0, 0
                yield "open", head, ()
                continue
            yield from inserted()
            edit, role = head["audit"][at], row["role"]
            at += 1
            if edit == "K":
                state = KEEPS[INITIALS.index(role[0])][state]
            elif edit == "R":
                role, state = ROLES[state], NEXT[state]
            if edit != "D":
                yield "line", head, (edit, role, row["text"])
    if head is not None:
        yield from inserted()
        yield "close", head, ()


def _replayed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Findings and turns in one order, a conversation's findings first."""
    texts = _clean(turns).withColumn("digest", _digest(F.col("text"))).withColumn("_late", F.lit(1))
    both = texts.unionByName(found.withColumn("_late", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_late", "turn", "role", "digest").drop("_late", "turn", "digest")


SEND = 1 << 20


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of every turn of the repaired conversations."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, size, place = None, [], 0, 0

        def seen(source):
            nonlocal schema
            for b in source:
                schema = schema or pa.schema([b.schema.field("conv_id"), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
                yield b

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for what, head, line in _replay(seen(batches)):
            if what != "line":
                place = 0
                continue
            held.append((head["conv_id"], place, *line))
            place, size = place + 1, size + len(line[2]) + 64
            if size > SEND:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return _replayed(turns, find_edits(turns)).mapInArrow(rows, f"conv_id {kind}, place long, edit string, role string, text string")


def repair_digests(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """conv_id, the columns of FINDINGS, and repaired_sha256 of the repaired `role:text`, newline-joined. Texts are hashed as they stream past."""
    names = ["conv_id", *[x.split()[0] for x in FINDINGS.split(", ")]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, sha, some = None, [], None, False

        def seen(source):
            nonlocal schema
            for b in source:
                schema = schema or pa.schema([*[b.schema.field(n) for n in names], ("repaired_sha256", pa.string())])
                yield b

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for what, head, line in _replay(seen(batches)):
            if what == "open":
                sha, some = hashlib.sha256(), False
            elif what == "line":
                sha.update(f"{chr(10) if some else ''}{line[1]}:{line[2]}".encode())
                some = True
            else:
                held.append((*(head[n] for n in names), sha.hexdigest()))
                if len(held) >= 4096:
                    yield flush()
                    held = []
        if held:
            yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _replayed(turns, find_edits(turns, known)).mapInArrow(rows, f"conv_id {kind}, {FINDINGS}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets
    the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _clean(turns).withColumn("_kind", F.crc32(key.cast("binary")) % 20).where("_kind <> 0")
    rows = rows.withColumns({
        "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
    })
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_digests(damage(turns), turns.select("conv_id").distinct())


# The same in SQL: costs by a recursion from the last turn, edits by one from the first.
_W = "CASE {s} WHEN 2 THEN b3 ELSE b2 END"
_EXTRA = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_BIG = 1_000_000_000


def _sql_cost(s: int) -> str:
    kept = " ".join(f"WHEN init = '{i}' THEN b{KEEPS[k][s]}" for k, i in enumerate(INITIALS) if KEEPS[k][s] is not None)
    stay = f"least({REROLE} + b{NEXT[s]}, CASE {kept} ELSE {_BIG} END) + {_EXTRA}"
    return f"least({DELETE} + b{s}, CASE WHEN fault IN ('blank', 'duplicate') THEN {_BIG} ELSE {stay} END)"


def _sql_state(kept: bool) -> str:
    if not kept:
        return "CASE s WHEN 2 THEN 3 ELSE 2 END"
    cells = " ".join(f"WHEN init = '{i}' AND s = {s} THEN {to}" for k, i in enumerate(INITIALS) for s, to in enumerate(KEEPS[k]) if to is not None)
    return f"CASE {cells} END"


OP13_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(k, ''), lambda c: list_transform(range(8),
    lambda b: CAST((ascii(c) >> CAST(b AS INT)) & 1 AS BIGINT))))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 20 AS kind FROM raw),
rows_ AS (
  SELECT conv_id, cid, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE kind WHEN 3 THEN [1, 2] WHEN 0 THEN [] ELSE [1] END) AS copies(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS init FROM rows_),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1
    THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
    init || lead(init) OVER (PARTITION BY cid ORDER BY i) AS pair FROM placed),
counts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY cid),
back AS (
  SELECT cid, n + 1 AS i, 0 AS b0, 6 AS b1, 3 AS b2, 0 AS b3 FROM counts
  UNION ALL
  SELECT cid, i, least(c0, 3 + least(c2, 3 + c3)), least(c1, 3 + least(c2, 3 + c3)), least(c2, 3 + c3), least(c3, 3 + c2) FROM (
    SELECT f.cid, f.i, {", ".join(f"{_sql_cost(s)} AS c{s}" for s in range(4))} FROM back JOIN faulty f ON f.cid = back.cid AND f.i = back.i - 1)),
walk AS (
  SELECT cid, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counts
  UNION ALL
  SELECT cid, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN {_sql_state(True)} ELSE {_sql_state(False)} END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, f.role, f.text, f.init, CASE
      WHEN f.i IS NOT NULL AND [n.b0, n.b1, n.b2, n.b3][w.s + 1] = {DELETE} + [a.b0, a.b1, a.b2, a.b3][w.s + 1] THEN 'D'
      WHEN [n.b0, n.b1, n.b2, n.b3][w.s + 1] = {INSERT} + CASE w.s WHEN 2 THEN n.b3 ELSE n.b2 END THEN 'I'
      WHEN f.i IS NULL THEN NULL
      WHEN coalesce(f.fault, '') NOT IN ('blank', 'duplicate') AND [n.b0, n.b1, n.b2, n.b3][w.s + 1] = {_EXTRA.replace("fault", "f.fault")}
        + coalesce([a.b0, a.b1, a.b2, a.b3][1 + {_sql_state(True).replace("init", "f.init").replace(" s =", " w.s =")}], {_BIG}) THEN 'K'
      ELSE 'R' END AS e
    FROM walk w JOIN back n ON n.cid = w.cid AND n.i = w.i LEFT JOIN faulty f ON f.cid = w.cid AND f.i = w.i
      LEFT JOIN back a ON a.cid = w.cid AND a.i = w.i + 1)
  WHERE e IS NOT NULL),
done AS (SELECT DISTINCT ON (cid) * FROM walk ORDER BY cid, length(audit) DESC),
ids AS (SELECT DISTINCT conv_id, cid FROM raw)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(first.b0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (cid) LEFT JOIN done USING (cid) LEFT JOIN back first ON first.cid = ids.cid AND first.i = 1
"""
