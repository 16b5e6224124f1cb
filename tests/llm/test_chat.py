import hashlib
import random

from foliant.llm.chat import CONTROLS, format_conversations, read_back


def plain_escaped(text):
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


SHAPE = "conv_id long, turn long, role string, text string, node string"


def fixture():
    rng = random.Random(13)
    parts = [*CONTROLS, "\\", "\\\\", "ok", " ", "\n", "é", "😀", "<", "|", ">", "<|end|>\n"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 3, None, None), (None, 1, "assistant", None)]
    openings = ["".join(rng.choice(parts) for _ in range(6)) for _ in range(3)]
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            text = openings[c % 3] if t == 0 else f"{rng.randint(0, 2)}" if t < 3 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
            rows.append((c, t, "system" if t == 0 else rng.choice(["user", "assistant", "od|>d\\"]) if t > 2 else ("user", "assistant")[t % 2], text))
    rows += [r for r in rows if r[0] in (5, 6)]  # repeated rows are turns
    rows += [(100 + i, *r[1:]) for i in range(4) for r in rows if r[0] == 7]  # copies of a conversation
    return rows


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        places = [0]
        for _, role, t in turns:
            places.append(places[-1] + len(plain_escaped(role) + plain_escaped(t)) + len("<||>\n<|end|>\n"))
        out[conv] += (places[-1], hashlib.sha256("".join(f"{p}," for p in places[:-1]).encode()).hexdigest(), sum(places[:-1]))
    return out


def test_round_trip_and_layout(spark):
    rows = fixture()
    trees = format_conversations(spark.createDataFrame([(*r, "x") for r in rows], SHAPE).repartition(4))
    got = {r["conv_id"]: tuple(r)[1:] for r in read_back(trees).collect()}
    assert got == plain(rows)

    nodes = {bytes(r["node"]): r for r in trees.nodes.collect()}
    for tree in {bytes(r["tree"]) for r in nodes.values()}:
        own = sorted((r for r in nodes.values() if bytes(r["tree"]) == tree), key=lambda r: r["start"])
        at, stack = 0, []
        for r in own:  # every node once, without gaps, depth first
            assert r["start"] == at and r["stop"] - r["start"] == len(r["text"])
            at = r["stop"]
            while stack and stack[-1] != (bytes(r["parent"]) if r["parent"] else None):
                stack.pop()
            assert bool(stack) == bool(r["parent"])
            stack.append(bytes(r["node"]))
            line, up = [], r["parent"]
            while up:
                line.append(nodes[bytes(up)])
                up = line[-1]["parent"]
            attended = {i for a in r["ancestors"] for i in range(a["start"], a["stop"])}
            assert attended == {i for a in line for i in range(a["start"], a["stop"])}
            assert r["position"] == len(attended) and r["depth"] == len(line)
    turns = len({tuple(sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)[: d + 1])
                 for c in {r[0] for r in rows} for d in range(sum(r[0] == c for r in rows))})
    assert len(nodes) == turns


def test_no_control_string_survives(spark):
    nodes = format_conversations(spark.createDataFrame([(*r, "x") for r in fixture()], SHAPE)).nodes.collect()
    for r in nodes:
        inner = r["text"].split("\n", 1)[1][: -len("<|end|>\n")]
        assert not any(c in inner for c in CONTROLS)


def test_empty_table(spark):
    trees = format_conversations(spark.createDataFrame([], SHAPE))
    assert trees.nodes.count() == 0 and read_back(trees).count() == 0
