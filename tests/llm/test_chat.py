import collections
import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beamloom.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|", "a", "\n", "é", "😀", "/s>", "INST]", "<\\/s>"])


@settings(max_examples=800, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_escaping(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_round_trip(spark):
    rows = [(-7, i, r, "</s>[INST] ok [/INST]", 0) for i, r in enumerate(("user", "assistant"))]
    rows += [(c, t, ("user", "assistant", "a<|text|>\nb\\", None)[(c + t) % 4], ["", None, "hé\\", "<|/turn|>😀"][t % 4], 0) for c in range(6) for t in range(5)]
    rows += [(None, None, "user", "x", 0), (9, 1, "user", "b", 0), (9, 1, "user", "a", 0), (9, 1, "assistant", "z", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.write_formatted(chat.canonical_turns(table))).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        size = sum(len(chat.TURN + chat.TEXT + chat.END) + len(chat.escape(r)) + len(chat.escape(x)) for _, r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c] == (len(turns), sha(whole), len(loss), sha(loss), size)
    assert chat.digests(chat.write_formatted(chat.canonical_turns(table.limit(0)))).collect() == []


def test_records_of_mixed_layouts(spark):
    known = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}], "id": 3},
        {"prompt": "q", "response": "a"},
        {"output": "a", "instruction": "q"},
        {"instruction": "q", "input": "", "output": "a", "source": "x"},
        {"question": "q", "answer": "a"},
        {"prompt": "q", "completion": "a"},
    ]
    odd = ["{", None, "[1]", '{"prompt": "q"}', '{"prompt": {"x": 1}, "response": "a"}', "{}"]
    rows = [(i, json.dumps(r)) for i, r in enumerate(known)] + [(100 + i, r) for i, r in enumerate(odd)]
    rows.append((50, json.dumps({"system": "s", "messages": [{"role": "user", "content": None}]})))
    table = spark.createDataFrame(rows, "conv_id long, record string")
    got = collections.defaultdict(list)
    for r in chat.record_table_turns(table).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {i: [("user", "q"), ("assistant", "a")] for i in range(len(known))} | {50: [("system", "s"), ("user", "")]}
    assert {r.conv_id for r in chat.unknown_records(table).collect()} == {100 + i for i in range(len(odd))}


def test_records_of_every_layout_give_the_turns_back(spark):
    rows = [(c, t, ("user", "assistant", "system", "user", "assistant", "assistant", None)[(c + t) % 7], ["q", None, "hé\n", '"\\', "x" * 3000000][(c * t) % 5]) for c in range(20) for t in range(9)]
    rows += [(c, 20 + t, role, f"{role} says") for c in range(20) for t, role in enumerate(("human", "gpt", "tool", "User", "", "GPT", "human"))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 1, "user", "again"), (3, 1, "user", "again"), (4, None, "user", "a"), (4, None, "assistant", "b"), (5, 100, "user", "a"), (5, 105, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    names = [x.name for x in chat.LAYOUTS if x.name in ("messages", "from and value", "prompt and response", "instruction", "question and answer")]
    layout = F.element_at(F.array(*map(F.lit, names)), F.coalesce(F.pmod("conv_id", F.lit(len(names))), F.lit(0)).cast("int") + 1)
    records = chat.mixed_records(turns, layout).persist()
    kinds = collections.Counter(chat.record_layout(json.loads(r.record)).name for r in records.collect())
    assert set(kinds) == set(names) and records.count() < len(rows)
    got = collections.Counter(tuple(r) for r in chat.record_table_turns(records).collect())
    assert got == collections.Counter((c, t, r or "", x or "") for c, t, r, x in rows)
    assert chat.record_table_turns(records.limit(0)).collect() == []


def test_layouts_are_found_by_fingerprint():
    for layout in chat.LAYOUTS:
        assert chat.layout_of(frozenset(layout.paths)) is chat.BY_FINGERPRINT[chat.fingerprint(layout.paths)] is layout
        assert chat.layout_of(frozenset((*layout.paths, "source", "x.y"))) is layout
    assert chat.layout_of(frozenset(("conv_id", "turn", "role", "text", "response"))).name == "turn rows"
    assert chat.layout_of(frozenset(("prompt", "response", "question", "answer"))).name == "prompt and response"
    assert chat.layout_of(frozenset(("prompt", "text"))) is None
