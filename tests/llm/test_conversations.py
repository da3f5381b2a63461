import hashlib
import random
import zlib
from itertools import product

import pytest

from foldwise.llm import conversations as c, registry

FOLDER = "/root/testdata/sf0.001"


def plain_fault(role, text, before):
    body = text.rstrip(" \t\n\x0b\x0c\r")
    if not body:
        return "blank"
    if (role, text) in before:
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def plain_repair(rows):
    """Cheapest edits by trying every choice per row with up to two insertions anywhere; ``(cost, audit, lines)``."""
    faults = [plain_fault(r, t, rows[:i]) for i, (r, t) in enumerate(rows)]
    gap = [()] + [(x,) for x in "ua"] + list(product("ua", repeat=2))
    choices = []
    for (role, _), f in zip(rows, faults):
        own = [("D", "")] if f in ("blank", "duplicate") else [("D", ""), ("K", role[:1]), ("R", "u"), ("R", "a")]
        choices.append([x for x in own if x[0] == "D" or x[1]])
    best = None
    for picks in product(*choices):
        for gaps in product(gap, repeat=len(rows) + 1):
            initials, audit, cost, lines = "", "", 0, []
            for i in range(len(rows) + 1):
                for letter in gaps[i]:
                    initials, audit, cost = initials + letter, audit + "I", cost + 3
                    lines.append({"u": "user", "a": "assistant"}[letter] + ":")
                if i < len(rows):
                    edit, letter = picks[i]
                    audit += edit
                    cost += {"K": 0, "R": 3, "D": 4}[edit] + (3 if edit != "D" and faults[i] == "truncated" else 0)
                    if edit != "D":
                        initials += letter
                        lines.append(f"{rows[i][0] if edit == 'K' else {'u': 'user', 'a': 'assistant'}[letter]}:{rows[i][1]}")
            if legal(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


ROLES, TEXTS = ["user", "assistant", "system", "tool", " "], ["Hi.", "Yes!", "cut off", "", " \t", "Hi.", "Why?\n", " "]


def test_agenda_equals_trying_everything():
    rng = random.Random(5)
    for n in [0, 1, 2, 3] * 12 + [4]:
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]
        found = c.solve([(i, *r) for i, r in enumerate(rows)])
        assert found[5:] == plain_repair(rows), rows


def plain_counts(rows):
    turns = [t for t, *_ in rows if t is not None]
    faults = [plain_fault(r, x, [y[1:] for y in rows[:i]]) for i, (_, r, x) in enumerate(rows)]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return [gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs)]


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def spread(rng):
    """Conversations of 0 to 40 rows, one of 400 with few texts, equal rows, NULL ids, turns, roles and texts."""
    rows = []
    for conv in [*range(12), None]:
        for _ in range(rng.randrange(1, 41)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice([None, "", *ROLES]), rng.choice([None, *TEXTS])))
    rows += [(77, rng.choice([None, 1, 5, 2**62, -(2**62)]), rng.choice(ROLES[:3]), f"{rng.choice(TEXTS)}{rng.randrange(40)}.") for _ in range(400)]
    return rows + [(88, 3, "user", "same.")] * 50


@pytest.mark.parametrize("segment", [1024, 7, 1])
def test_segments_give_what_whole_conversations_give(spark, segment):
    rows = spread(random.Random(2))
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], "conv_id bigint, turn bigint, role string, text string, conversation string, spans string")
    got = {r.conversation: r for r in c.repair(frame.repartition(3), segment=segment).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == groups.keys()
    for conv, own in groups.items():
        own = plain_order(own)
        assert list(got[conv])[1:6] == plain_counts(own)
        assert tuple(got[conv])[6:] == c.solve(own)[5:]
        assert c.replay([r[1:] for r in own], got[conv].audit, c.START) == got[conv].repaired
        kept = [line.split(":")[0][:1] for line in got[conv].repaired.split("\n")] if got[conv].repaired and all("\n" not in r[2] for r in own) else None
        assert kept is None or legal("".join(kept))


def test_no_rows_and_text_ids(spark):
    empty = spark.createDataFrame([], "conv_id string, turn bigint, role string, text string")
    assert c.repair(empty).count() == 0 and c.repair(c.damage(empty), "conversation").count() == 0
    one = c.repair(spark.createDataFrame([("a", None, "user", "x" * 100_000)], empty.schema)).collect()
    assert [(r.gaps, r.truncated, r.cost, r.audit) for r in one] == [(0, 1, 4, "D")]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query(spark):
    import duckdb

    rows = duckdb.sql(f"select conv_id, turn, role, text from '{FOLDER}/conversations.parquet'").fetchall()
    groups = {r[0]: [] for r in rows}
    for conv, *r in plain_damage(rows):
        groups[conv].append(tuple(r))
    got = {r.conv_id: r for r in registry.op11_conversation_repair(spark, FOLDER).collect()}
    assert got.keys() == groups.keys()
    for conv, own in groups.items():
        own = plain_order(own)
        r = got[conv]
        expected = c.solve(own)[5:]
        if len(own) <= 3:
            assert expected == plain_repair([x[1:] for x in own])
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal] == plain_counts(own)
        assert (r.cost, r.audit, r.repaired_sha256) == (*expected[:2], hashlib.sha256(expected[2].encode()).hexdigest())


def test_query_on_awkward_rows(spark, tmp_path):
    rows = [(None, None, None, None), (1, None, "user", None), (2, 1, None, "x."), (2, 1, None, "x."), (3, 0, "user", "a" * 50_000), (3, 0, "user", "a" * 50_000)]
    for n, data in enumerate((rows, [])):
        spark.createDataFrame([(*r, 1) for r in data], "conv_id bigint, turn bigint, role string, text string, hot int").write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        out = registry.op11_conversation_repair(spark, f"{tmp_path}/{n}").collect()
        assert {r.conv_id for r in out} == {r[0] for r in data}
        assert all(v is not None for r in out for v in tuple(r)[1:])
