import hashlib
import itertools
import random
import re

from gridwright.llm import repair

LAW = re.compile(r"(s?(ua)+)?")
GAPS = [x for n in range(3) for x in itertools.product("ua", repeat=n)]


def every_edit(codes):
    """Cost and audit by trying all edits, with two insertions in a row at most."""
    choices = []
    for c in codes:
        initial, fault = divmod(c, 3)
        extra = 3 if fault == repair.TRUNCATED else 0
        stay = [] if fault == repair.GONE else [("K", "suax"[initial], extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        choices.append([("D", "", 4), *stay])
    best = None
    for gaps in itertools.product(GAPS, repeat=len(codes) + 1):
        for edits in itertools.product(*choices):
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            roles = "".join(gaps[0]) + "".join(e[1] + "".join(g) for e, g in zip(edits, gaps[1:], strict=True))
            if LAW.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_edits_equal_the_best_of_all():
    rng = random.Random(3)
    for _ in range(40):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(4)))
        assert repair.cheapest_edits(codes) == every_edit(codes)


def whole_table(codes):
    """The same walk with every vector stored."""
    costs = [repair.END]
    for c in reversed(codes):
        costs.append(repair._before(c, costs[-1]))
    costs.reverse()
    audit, state = bytearray(), 0
    for i, c in enumerate(codes):
        state = repair._take(c, costs[i], costs[i + 1], state, audit)
    while repair.END[state]:
        audit += b"I"
        state = repair.NEXT[state]
    return costs[0][0], audit.decode()


def test_checkpoints_change_nothing():
    rng = random.Random(4)
    for n in (1, 2, 3, 8, 9, 15, 16, 17, 99, 100, 101, 5000):
        codes = bytes(rng.choices(range(12), [1, 1, 1, 6, 1, 1, 6, 1, 1, 1, 1, 1], k=n))
        assert repair.cheapest_edits(codes) == whole_table(codes)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, _late string")


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi"), (1, 1, "assistant", "Hi"), (1, None, "system", "Be good!"), (1, 5, None, "Who?"), (1, 6, "", "x."), (1, 7, "user", None),
    (None, 0, "assistant", "Yes. \t\n"), (None, 0, "assistant", "Yes. \t\n"), (None, None, None, None), (3, 2, "umpire", "Out! é😀."), (4, 0, "user", " \x0b"),
]


def test_odd_rows(spark):
    got = {r.conv_id: r for r in repair.repair_digests(rows_of(spark, ODD)).collect()}
    text = {}
    for r in repair.repair(rows_of(spark, ODD)).orderBy("conv_id", "place").collect():
        text.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(text[r.conv_id]) - 1
    assert {c: r.repaired_sha256 for c, r in got.items()} == {c: hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest() for c in (1, None, 3, 4)}
    a = got[1]
    assert (a.gaps, a.blank, a.duplicate, a.truncated, a.illegal) == (3, 1, 1, 1, 4)
    assert text[1][:3] == ["system:Be good!", "user:Hello.", "assistant:Hi"]
    assert (got[None].gaps, got[None].blank, got[None].duplicate, got[None].audit) == (0, 1, 1, "DIKD") and text[None] == ["user:", "assistant:Yes. \t\n"]
    assert text[3] == ["umpire:Out! é😀.", "assistant:"] and got[3].audit == "KI" and got[3].cost == 3
    assert (got[4].audit, got[4].gaps, got[4].cost) == ("D", 0, 4)


def test_long_and_empty_tables(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}. " + "x" * (i % 50 * 40) + ".") for i in range(6000)]
    r = repair.repair_digests(rows_of(spark, rows)).collect()
    assert len(r) == 1 and r[0].audit == "K" * 6000 and r[0].cost == 0 and r[0].repaired_sha256 == hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in rows).encode()).hexdigest()
    assert repair.repair_digests(rows_of(spark, rows).limit(0)).count() == 0 and repair.repair(rows_of(spark, rows).limit(0)).count() == 0
    gone = repair.repair_digests(rows_of(spark, rows).limit(0), spark.createDataFrame([(5,)], "conv_id long")).collect()
    assert [(x.conv_id, x.cost, x.audit, x.repaired_sha256) for x in gone] == [(5, 0, "", hashlib.sha256(b"").hexdigest())]
