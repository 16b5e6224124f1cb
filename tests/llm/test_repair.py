import hashlib
import itertools
import random
import re
import zlib

from foliant.llm import repair as R

SHAPE = "conv_id long, turn long, role string, text string, copy string, fault string, place string"
SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Whole strings in a table over rows and states: the least (cost, audit, roles) of each."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    held = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):  # inserts before this row
            for state, (cost, audit, made) in list(held.items()):
                new = (cost + 5, audit + "I", made + ((full[due[state]], ""),))
                held[due[state]] = min(held.get(due[state], new), new)
        if i == len(rows):
            break
        (_, _, role, text), fault, after = rows[i], faults[i], {}
        for state, (cost, audit, made) in held.items():
            ways = [(state, cost + 2, "D", made)]
            if fault in (None, "truncated"):
                more = 5 * (fault == "truncated")
                if role[:1] == due[state] or role[:1] == "s" and state == "":
                    ways.append((role[:1], cost + more, "K", made + ((role, text),)))
                ways.append((due[state], cost + 1 + more, "R", made + ((full[due[state]], text),)))
            for to, price, letter, written in ways:
                new = (price, audit + letter, written)
                after[to] = min(after.get(to, new), new)
        held = after
    cost, audit, made = min(held[s] for s in ("", "a") if s in held)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in harmed(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(own)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] or " " for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal,
                     *cheapest(own, faults))
    return out


def fixture():
    rng = random.Random(21)
    said = ["Yes.", "no", "", " \n", None, "Why?", "well... ", "é!", "\u0085", "a. ", "Fine!\x0b", "More. Or less"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(220):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]) if conv % 3 == 0 else turn,
                         rng.choice(roles) if conv % 2 else ("user", "assistant")[turn % 2], rng.choice(said) if conv % 5 else f"Turn {turn} of it."))
    rows += [(None, t, rng.choice(["user", "assistant", "system"]), rng.choice(said)) for t in range(150)]  # one long conversation
    rows += rows[:40] + [(500, 7, "user", "Same.")] * 30
    return rows


def test_conversations_equal_a_plain_table(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SHAPE).repartition(3)
    want = plain(rows)
    for parts in (3, 60):  # the long conversation in one piece and in many
        got = {r["conv_id"]: tuple(r)[1:] for r in R.repair_conversations(frame, parts=parts).collect()}
        assert got == want
    assert any(v[-2] == "" for v in want.values()) and len(want[None][-2]) > 100
    assert R.repair_conversations(frame.limit(0)).count() == 0


def test_search_equals_the_table_between_all_states():
    rng = random.Random(5)
    for n in range(7):
        for _ in range(150):
            initials = "".join(rng.choice("suaat") for _ in range(n))
            faults = [rng.choice([R.SOUND, R.SOUND, R.TRUNCATED, R.REMOVED]) for _ in range(n)]
            lattice = R.Lattice(initials, faults)
            for a in R.STATES:
                held = {a: (0, "")}
                for i in range(n + 1):
                    for _ in range(4):
                        for state, (cost, audit) in list(held.items()):
                            new = (cost + R.INSERT, audit + "I")
                            held[R.DUE[state]] = min(held.get(R.DUE[state], new), new)
                    if i < n:
                        after = {}
                        for state, (cost, audit) in held.items():
                            for letter, to, more in R.edits(state, initials[i], faults[i]):
                                after[to] = min(after.get(to, (cost + more, audit + letter)), (cost + more, audit + letter))
                        held = after
                for b in R.STATES:
                    assert lattice.cheapest(a, (b,)) == held.get(b), (initials, faults, a, b)
                assert lattice.cheapest(a, R.ENDS) == min((held[b] for b in R.ENDS if b in held), default=None)


def test_long_conversations_take_no_recursion():
    lattice = R.Lattice("ua" * 20000, [R.SOUND] * 40000)
    assert lattice.cheapest("-", R.ENDS) == (0, "K" * 40000)
