"""Conversation repair as a lightest derivation: Knuth's agenda over weighted deductions, long conversations in segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.store import materialize
from foldwise.llm.columns import id_type, quoted

#: Rows of a conversation that one task solves at once; a longer one is cut into segments of so many.
SEGMENT = 1024
#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, CUT = range(4)

#: The language (s?(ua)+)? by states: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVES = {
    START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U},
}
ACCEPTED = (START, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

Row = tuple[str, str, int]
Value = tuple[int, str]


def fault(role: str, text: str, repeated: bool) -> int:
    """A row's first fault: blank, duplicate, truncated, in this order."""
    body = text.rstrip(WHITE)
    if not body:
        return BLANK
    if repeated:
        return DUPLICATE
    return SOUND if body[-1] in ".!?" else CUT


def lightest(rows: list[tuple[str, int]], start: int, goals: Iterable[int]) -> dict[int, Value]:
    """``(cost, audit)`` of the lightest derivation of each reachable goal state from ``start``, over ``(initial, fault)`` rows.

    Items are ``row i`` (an axiom of the least value) and ``prefix (i, state)``: rows before ``i`` are edited and the roles
    so far are in ``state``. Deductions: ``prefix (i, q), row i`` give ``prefix (i + 1, q')`` by Keep, Rerole or Delete, and
    ``prefix (i, q)`` gives ``prefix (i, q')`` by Insert. A deduction adds its cost and appends its initial, which never gives
    a smaller value than its premises (superior), and keeps the order of two values of one item: of equal cost, neither audit
    begins the other, since what follows it would be Inserts, which cost. So the agenda may pop the least value and finalise
    it; it ends with the last goal. Inserts make the deductions cyclic, which the agenda bears.
    """
    wanted, found = {(len(rows), q) for q in goals}, {}
    final: set[tuple[int, int]] = set()
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while agenda and wanted:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if (i, q) in wanted:
            wanted.discard((i, q))
            found[q] = (cost, audit)
        moves = MOVES[q]
        for letter in ROLES:
            if letter in moves and (i, moves[letter]) not in final:
                heappush(agenda, (cost + INSERT, audit + "I", i, moves[letter]))
        if i == len(rows):
            continue
        initial, kind = rows[i]
        heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if kind in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if kind == CUT else 0
        if initial in moves:
            heappush(agenda, (cost + extra, audit + "K", i + 1, moves[initial]))
        for letter in ROLES:
            if letter in moves:
                heappush(agenda, (cost + extra + REROLE, audit + "R", i + 1, moves[letter]))
    return found


def replay(rows: list[tuple[str, str]], audit: str, state: int) -> str:
    """The repaired ``role:text`` lines that an audit stands for; a state allows one role only where an edit sets it."""
    lines, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit in "IR":
            letter = next(x for x in ROLES if x in MOVES[state])
            role = ROLES[letter]
        else:
            letter = role[:1]
        state = MOVES[state][letter]
        lines.append(f"{role}:{text}")
    return "\n".join(lines)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _capped(value: int) -> int:
    return min(value, 2**63 - 1)


def _gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return _capped(max(known) - min(known) + 1 - len(known)) if known else 0


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired string"


def solve(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The ``RESULT`` columns of one conversation of ``(turn, role, text)`` rows in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        kinds.append(fault(role, text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    best = lightest(list(zip(initials, kinds)), START, ACCEPTED)
    cost, audit = min(best.values())
    repaired = replay([(role, text) for _, role, text in rows], audit, START)
    counts = [kinds.count(k) for k in (BLANK, DUPLICATE, CUT)]
    return (_gaps(t for t, _, _ in rows), *counts, illegal_pairs(initials), cost, audit, repaired)


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conversation, turn, role, text)`` with faults set by a hash of conversation and turn, one row in four, of known kinds:
    for measuring a repair. NULLs read as one space; a dropped row is absent, a repeated one stands twice."""
    space = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(" "))
    key = F.crc32(F.concat_ws(":", space(conversation), space(turn))) % 20
    body = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = turns.select(
        quoted(conversation).alias("conversation"), quoted(turn).cast("bigint").alias("turn"), space(role).alias("role"),
        space(text).alias("text"), key.alias("fault"),
    )
    kept = marked.filter(F.col("fault") != 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))))
    return kept.select("conversation", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"))


def _ordinary(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of at most a segment: one shuffle, solved as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conversation", *[c.split()[0] for c in RESULT.split(", ")]]
        held: list[tuple[int | None, str, str]] = []
        last, out = None, []

        def flush(type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(names)
            kinds = [type, *[pa.int64()] * 6, pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        type = None
        for batch in batches:
            type, size = batch.column(0).type, 0
            for conversation, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conversation != last:
                    out.append((last, *solve(held)))
                    size += len(out[-1][-1])
                    held = []
                    if size > 4 << 20:
                        yield flush(type)
                        size = 0
                last = conversation
                held.append(tuple(row))
            if out:
                yield flush(type)
        if held:
            out.append((last, *solve(held)))
            yield flush(type)

    ordered = rows.repartition("conversation").sortWithinPartitions("conversation", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(run, f"conversation {kind}, {RESULT}")


SEGMENTS = {
    "part": "int", "chunk": "int", "counts": "array<bigint>", "illegal": "bigint", "first": "string", "last": "string",
    "least": "bigint", "most": "bigint", "spans": "array<struct<q:int,r:int,cost:bigint,audit:string>>",
    "roles": "array<string>", "texts": "array<string>",
}


def _segments(rows: DataFrame, kind: str, segment: int) -> DataFrame:
    """Segments of long conversations, in the order ``(part, chunk)``, with the lightest derivation between any two states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        last = None
        type = None

        def cut() -> pa.RecordBatch:
            turns, roles, texts, repeated = (list(c) for c in zip(*held))
            kinds = [fault(*row) for row in zip(roles, texts, repeated)]
            initials = [r[:1] for r in roles]
            pairs = list(zip(initials, kinds))
            spans = [
                {"q": q, "r": r, "cost": cost, "audit": audit}
                for q in MOVES for r, (cost, audit) in lightest(pairs, q, MOVES).items()
            ]
            known = [t for t in turns if t is not None]
            columns = [
                pa.array([last], type), pa.array([part], pa.int32()), pa.array([chunk], pa.int32()),
                pa.array([[kinds.count(k) for k in (BLANK, DUPLICATE, CUT)]], pa.list_(pa.int64())),
                pa.array([illegal_pairs(initials)], pa.int64()), pa.array([initials[0]]), pa.array([initials[-1]]),
                pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()),
                pa.array([spans], pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
                pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string())),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["conversation", *SEGMENTS])

        for batch in batches:
            type = batch.column(0).type
            for conversation, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (conversation != last or len(held) == segment):
                    yield cut()
                    chunk += 1
                last = conversation
                held.append(tuple(row))
        if held:
            yield cut()

    order = ["conversation", F.asc_nulls_first("turn"), "role", "text", "repeated"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conversation", "turn", "role", "text", "repeated").mapInArrow(
        run, f"conversation {kind}, " + ", ".join(f"{c} {t}" for c, t in SEGMENTS.items())
    )


def joined_spans(spans: list[dict[tuple[int, int], Value]]) -> tuple[Value, list[int]]:
    """Lightest way through segments in order, and the state before each of them.

    Each segment's spans are final before they are used, so the deductions ``prefix k, span k`` give ``prefix k + 1`` are
    evaluated layer by layer.
    """
    layer: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
    for k, table in enumerate(spans):
        following: dict[int, tuple[int, str, tuple]] = {}
        for (q, r), (cost, audit) in table.items():
            if q in layer:
                before = layer[q]
                new = (before[0] + cost, before[1] + audit, (before[2], q))
                if r not in following or new[:2] < following[r][:2]:
                    following[r] = new
        layer = following
    cost, audit, path = min((layer[q] for q in ACCEPTED if q in layer), key=lambda v: v[:2])
    states = []
    while path:
        path, q = path
        states.append(q)
    return (cost, audit), states[::-1]


def _long(rows: DataFrame, kind: str, segment: int) -> DataFrame:
    """Conversations of more than a segment. Rows are counted and compared by shuffles on their content, cut by a range
    exchange, solved segment by segment; what meets in one task per conversation is a line per segment."""
    named = rows.withColumn("content", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    named = materialize(named)
    counted = named.groupBy("conversation", "turn", "content").agg(F.count(F.lit(1)).alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = named.groupBy("conversation", "content").agg(F.min(order).alias("first"))
    first = first.select(F.col("conversation").alias("of"), F.col("content").alias("what"), "first")
    same = F.col("conversation").eqNullSafe(F.col("of")) & (F.col("content") == F.col("what"))
    met = counted.join(materialize(first), same)
    is_first = (F.col("first.known") == F.col("turn").isNotNull()) & F.col("first.turn").eqNullSafe(F.col("turn"))
    copies = met.select("conversation", "turn", "role", "text", is_first.alias("is_first"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    marked = copies.withColumn("repeated", ~F.col("is_first") | (F.col("copy") > 1)).drop("is_first", "copy")
    cut = materialize(_segments(materialize(marked), kind, segment))
    distinct = named.filter(F.col("turn").isNotNull()).select("conversation", "turn").distinct().groupBy("conversation").count()
    distinct = materialize(distinct.select(F.col("conversation").alias("of"), F.col("count").alias("turns")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        names = ["conversation", "parts", "counts", "illegal", "least", "most", "cost", "audit"]
        part = pa.list_(pa.struct([("part", pa.int32()), ("chunk", pa.int32()), ("q", pa.int32()), ("audit", pa.string())]))
        kinds = [part, pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string()]
        type = None

        def result() -> pa.RecordBatch:
            tables = [{(s["q"], s["r"]): (s["cost"], s["audit"]) for s in h["spans"]} for h in held]
            (cost, audit), states = joined_spans(tables)
            ends = [*states[1:], None]
            least = [h["least"] for h in held if h["least"] is not None]
            most = [h["most"] for h in held if h["most"] is not None]
            between = (a["last"] + b["first"] not in LEGAL for a, b in zip(held, held[1:]))
            illegal = sum(h["illegal"] for h in held) + sum(between)
            parts = []
            for h, q, r, table in zip(held, states, ends, tables):
                own = table[q, r] if r is not None else min(table[q, g] for g in ACCEPTED if (q, g) in table)
                parts.append({"part": h["part"], "chunk": h["chunk"], "q": q, "audit": own[1]})
            values = [parts, [sum(c) for c in zip(*(h["counts"] for h in held))], illegal, min(least, default=None), max(most, default=None), cost, audit]
            batch = pa.RecordBatch.from_arrays([pa.array([held[0]["conversation"]], type), *[pa.array([v], k) for v, k in zip(values, kinds)]], names)
            held.clear()
            return batch

        for batch in batches:
            type = batch.column(0).type
            for row in batch.to_pylist():
                if held and row["conversation"] != held[-1]["conversation"]:
                    yield result()
                held.append(row)
        if held:
            yield result()

    slim = cut.drop("roles", "texts").repartition("conversation").sortWithinPartitions("conversation", "part", "chunk")
    schema = (
        f"conversation {kind}, parts array<struct<part:int,chunk:int,q:int,audit:string>>, counts array<bigint>, illegal bigint, "
        "least bigint, most bigint, cost bigint, audit string"
    )
    chosen = materialize(slim.mapInArrow(choose, schema))
    place = chosen.select(F.explode("parts").alias("p")).select("p.*")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = replay(list(zip(row["roles"], row["texts"])), row["audit"], row["q"])
                values = zip((row["conversation"], row["part"], row["chunk"], lines or None), (batch.column(0).type, pa.int32(), pa.int32(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], ["conversation", "part", "chunk", "lines"])

    lines = cut.select("conversation", "part", "chunk", "roles", "texts").join(place, ["part", "chunk"])
    lines = lines.select("conversation", "part", "chunk", "roles", "texts", "q", "audit")
    lines = lines.mapInArrow(text, f"conversation {kind}, part int, chunk int, lines string")
    whole = lines.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("part", "chunk", "lines"))).alias("all"))
    whole = whole.select(F.col("conversation").alias("whose"), F.array_join(F.transform("all", lambda s: s["lines"]), "\n").alias("repaired"))
    out = chosen.join(whole, F.col("conversation").eqNullSafe(F.col("whose"))).join(distinct, F.col("conversation").eqNullSafe(F.col("of")), "left")
    span = F.col("most").cast("decimal(20,0)") - F.col("least") + 1 - F.col("turns")
    gaps = F.coalesce(F.least(span, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint"), F.lit(0).cast("bigint"))
    count = lambda k: F.element_at("counts", k)
    return out.select(
        "conversation", gaps.alias("gaps"), count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"),
        "illegal", "cost", "audit", "repaired",
    )


def repair(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> DataFrame:
    """``(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)`` per conversation.

    General: the project keeps no conversations, so columns are named by parameters. Rows stand in the order of ``turn`` (NULL
    first), rows of one turn by role and text. Each is kept, given another role, or deleted, and empty rows are inserted, so
    that the role initials follow ``(s?(ua)+)?``; ``lightest`` says how the cheapest edits are found, ``audit`` has their
    initials in order and ``repaired`` the resulting ``role:text`` lines. NULL roles and texts read as one space; an empty role
    has no initial and cannot be kept; NULL conversations are one conversation; a conversation whose turns are all NULL has
    no gaps, and gaps end at the largest 64-bit number. Equal rows are duplicates of the first. Further columns are ignored; no
    rows give no rows.

    Conversations of at most ``segment`` rows are dealt out by their id. Longer ones, which may hold any share of all rows, are
    cut into segments that are solved for every pair of states, and the segments' results are joined in order. Only
    ``repaired`` and ``audit`` of one conversation, which are one value each, meet whole (at most 2 GB).
    """
    space = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(" "))
    rows = turns.select(quoted(conversation).alias("conversation"), quoted(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    kind = id_type(rows, "conversation")
    counts = rows.groupBy("conversation").count().filter(F.col("count") > segment)
    hot = materialize(counts.select(F.col("conversation").alias("hot")))
    if hot.isEmpty():
        return _ordinary(rows, kind)
    match = F.col("conversation").eqNullSafe(F.col("hot"))
    short, long = rows.join(hot, match, "left_anti"), rows.join(hot, match, "left_semi")
    return _ordinary(short, kind).unionByName(_long(long, kind, segment))
