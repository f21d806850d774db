import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from packetlake.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, state string, level int, slice bigint"
TEXTS = ["Yes.", "No", "Why?", "", " \t", "a b. ", "Fine! ", "x" * 50, "\x1c", None]
GRAMMAR = re.compile("(s?(ua)+)?")


def conversations(spark, seed=5, n=60, most=9):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(draw.randint(1, most)):
            turn = draw.choice([turn, turn, turn, turn + 3, None])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            rows.append((conv, turn, role, draw.choice(TEXTS)))
            rows += [rows[-1]] * (draw.random() < 0.1)
    return rows, spark.createDataFrame(
        [(*row, "clash", 1, 2) for row in rows], SCHEMA
    )


def damaged(rows):
    """Rows by conversation in order, as plain Python."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        here = found.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        here += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for here in found.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return found


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append(
            "blank" if not ink else "duplicate" if (role, text) in seen
            else "truncated" if ink[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    return out


def edits_of(rows, faults, inserts):
    """Every (cost, audit, repaired) with at most ``inserts`` between two rows."""
    gaps = [
        [(5 * k, "I" * k, [(r, "") for r in roles]) for k in range(inserts + 1)
         for roles in itertools.product(("user", "assistant"), repeat=k)]
    ]
    parts = list(gaps)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        ways = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            ways.append((extra, "K", [(role, text)]))
            ways += [(1 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        parts += [ways, *gaps]
    for way in itertools.product(*parts):
        lines = [line for _, _, found in way for line in found]
        # An empty role has no initial that the grammar knows.
        if GRAMMAR.fullmatch("".join(role[:1] or "-" for role, _ in lines)):
            yield sum(x[0] for x in way), "".join(x[1] for x in way), lines


def best_by_states(rows, faults):
    """The cheapest repair by whole strings for each state of the role pattern."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}
    level = {"": (0, "", ())}

    def inserted(level):
        for _ in range(4):
            for state, (cost, audit, lines) in list(level.items()):
                for x in "ua":
                    to = after.get((state, x))
                    way = (cost + 5, audit + "I", (*lines, (full[x], "")))
                    if to and (to not in level or way < level[to]):
                        level[to] = way
        return level

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in inserted(dict(level)).items():
            ways = [(state, 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                ways.append((after.get((state, role[:1])), extra, "K", ((role, text),)))
                ways += [(after.get((state, x)), 1 + extra, "R", ((full[x], text),)) for x in "ua"]
            for to, more, letter, line in ways:
                way = (cost + more, audit + letter, (*lines, *line))
                if to is not None and (to not in new or way < new[to]):
                    new[to] = way
        level = new
    ends = inserted(dict(level))
    return min(ends[state] for state in ("", "a") if state in ends)


def expected(rows):
    want = {}
    for conv, here in damaged(rows).items():
        faults = faults_of(here)
        cost, audit, lines = best_by_states(here, faults)
        turns = [t for t, _, _ in here if t is not None]
        initials = [role[:1] or "-" for _, role, _ in here]
        want[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return want


def found_by(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_tables_accept_the_role_pattern():
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stack = (0,)
            for x in word:
                stack = stack and repair.PARSER.shift(stack, x)
            good = bool(stack) and repair.PARSER.accepts(stack)
            assert good == bool(GRAMMAR.fullmatch("".join(word))), word


def test_state_search_finds_the_best_of_all_edits():
    draw = random.Random(2)
    for _ in range(120):
        rows = [
            (k, draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["A.", "b", "", "C."]))
            for k in range(draw.randint(0, 3))
        ]
        faults = faults_of(rows)
        want = min(edits_of(rows, faults, 2), key=lambda x: x[:2])
        assert best_by_states(rows, faults)[:2] == want[:2]
        assert list(best_by_states(rows, faults)[2]) == want[2]


def test_repair_against_brute_force(spark):
    rows, df = conversations(spark)
    assert found_by(repair.repair(repair.damage(df))) == expected(rows)


def test_slices_give_the_same_repair(spark):
    draw = random.Random(8)
    rows, _ = conversations(spark, 9, 5, 400)
    # One conversation holds most rows, one many copies of one row.
    rows += [
        (77, k, draw.choice(["user", "user", "assistant", "system"]), draw.choice(["a.", "b", "c.", f"{k}."]))
        for k in range(3000)
    ]
    rows += [(78, 3, "user", "Same.")] * 500
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    want = expected(rows)
    assert found_by(repair.repair(repair.damage(df), 37)) == want
    lines = {}
    for r in repair.repaired_rows(repair.damage(df), 37).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == found[-1]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair(repair.damage(empty)).collect() == []
    # Dropped by the damage: the conversation stays.
    lost = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], empty.schema)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found_by(repair.repair(repair.damage(df))) == {lost: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_undamaged_rows_and_long_texts(spark):
    long = "word " * 200_000
    rows = [("c", 1, "user", long), ("c", 2, "assistant", long + "."), ("d", None, "system", "Be good.")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    found = found_by(repair.repair(repair.as_rows(df)))
    assert found["c"][:7] == (0, 0, 0, 1, 0, 4, "DD")
    assert found["d"][5:7] == (2, "D")
    shown = repair.repaired_rows(repair.as_rows(df.where("turn = 2 OR turn IS NULL"))).select(F.count("*")).first()
    assert shown[0] == 0
