"""Tool-call linking against a plain linker over a whole table, and JSON that must not stop a job."""

import json
from collections import defaultdict

from mopup.llm import chat
from mopup.llm.queries import TOOLS, tool_view

SCHEMAS = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}, "x": {"type": "number"}}}}


def call(i, **arguments):
    return {"id": i, "name": "f", "arguments": arguments}


def calls(*made):
    return json.dumps({"tool_calls": list(made)})


def linked_by_hand(messages, schemas):
    """(conv, turn, place, kind, call_id, linked, errors, json) of (conv, turn, role, text) rows."""
    parts = defaultdict(list)
    out = []
    for conv, turn, role, text in messages:
        for place, kind, call_id, line, errors, refs in chat.message_parts(role, text, schemas):
            if kind == "message":
                out.append((conv, turn, place, kind, call_id, None, errors, line))
            else:
                parts[conv].append((turn, place, kind, call_id, line, errors, refs))
    early = lambda t: (t is not None, t or 0)
    for conv, mine in parts.items():
        named = defaultdict(list)
        for turn, _, kind, call_id, *_ in mine:
            if kind == "call" and call_id is not None:
                named[call_id].append(turn)
        made, results = defaultdict(list), defaultdict(list)
        for turn, place, kind, call_id, line, errors, refs in mine:
            if kind == "result":
                results[call_id].append((early(turn), place, line, turn, errors))
                continue
            found = [errors] if errors else []
            for r in refs:
                if r not in named:
                    found.append(f"unknown reference {r}")
                elif not min(map(early, named[r])) < early(turn):
                    found.append(f"later reference {r}")
            if call_id is None:
                out.append((conv, turn, place, "call", None, False, ",".join([*found, "no result"]), line))
            else:
                made[call_id].append((early(turn), place, line, turn, ",".join(found) or None))
        for call_id in set(made) | set(results):
            cs, rs = sorted(made[call_id], key=lambda x: x[:3]), sorted(results[call_id], key=lambda x: x[:3])
            late = [r for r in rs if cs and not r[0] < cs[0][0]]
            for k, (_, place, line, turn, errors) in enumerate(cs):
                ok = k < len(late)
                out.append((conv, turn, place, "call", call_id, ok, ",".join(filter(None, [errors, None if ok else "no result"])) or None, line))
            for r in rs:
                k = late.index(r) if r in late else len(cs)
                ok = k < len(cs)
                out.append((conv, cs[k][3] if ok else r[3], cs[k][1] if ok else r[1], "result", call_id, ok,
                            None if ok else "no call", r[2]))
    return out


def order(rows):
    return sorted(map(repr, rows))


def test_whole_table_against_a_plain_linker(spark):
    view = tool_view(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    got = [tuple(r) for r in chat.format_chats(view, TOOLS).collect()]
    want = linked_by_hand([tuple(r) for r in view.select("conv_id", "turn", "role", "text").collect()], TOOLS)
    assert len(got) == len(want) and order(got) == order(want)


def test_references_to_other_messages(spark):
    ref = {"$ref": "a"}
    rows = [(1, 0, "assistant", calls(call("a", n=1))), (1, 1, "assistant", calls(call("b", x=ref), call("c", x={"$ref": "zz"}))),
            (2, 0, "assistant", calls(call("b", x=ref))), (2, 5, "assistant", calls(call("a"))),
            (2, 6, "assistant", calls(call(None, x=ref), call("s", x={"$ref": "s"}))), (2, 6, "tool", '{"tool_call_id":"a","content":1}'),
            (None, None, "assistant", calls(call("b", x=ref))), (None, 3, "assistant", calls(call("q"), call("q"))),
            (None, 3, "assistant", calls(call("q"), call("q")))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in chat.format_chats(df, SCHEMAS).collect()]
    assert order(got) == order(linked_by_hand(rows, SCHEMAS))
    errors = {(r[0], r[1], r[4]): r[6] for r in got}
    assert errors[1, 1, "b"] == "no result" and errors[1, 1, "c"] == "unknown reference zz,no result"
    assert errors[2, 0, "b"] == "later reference a,no result" and errors[2, 6, "s"].startswith("cycle")
    assert errors[None, None, "b"] == "unknown reference a,no result"


def test_legal_and_broken_json_stops_no_job(spark):
    deep = '{"tool_calls":[{"id":"d","name":"f","arguments":{"x":%s1%s}}]}' % ("[" * 3000, "]" * 3000)
    nested = '{"tool_calls":[{"id":"d","name":"f","arguments":{"x":%s1%s}}]}' % ("[" * 150, "]" * 150)
    texts = [r'{"tool_calls":[{"id":"\ud800","name":"f","arguments":{"\udfff":"😀"}}]}',
             '{"tool_calls":[{"id":"h","name":"f","arguments":{"n":%s}}]}' % ("9" * 400),
             '{"tool_calls":[{"id":"h","name":"f","arguments":{"n":%s}}]}' % ("9" * 5000),
             '{"tool_calls":[{"id":"n","name":"f","arguments":{"x":NaN}}]}',
             '{"tool_calls":[{"id":"n","name":"f","arguments":{"x":1e400}}]}', deep, nested,
             '{"tool_calls":[1,null,{"id":7,"name":["f"]}]}', '{"tool_call_id":null,"tool_calls":3}', '{"tool_calls":[]}',
             "{" * 100_000, "", None, '{"tool_calls" ' + "x" * 300_000]
    rows = [(1, i, role, t) for i, t in enumerate(texts) for role in ("assistant", "tool", None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    for r in out:
        json.loads(r["json"], parse_constant=lambda c: 1 / 0)
    made = {(r["turn"], r["kind"]): r for r in out if r["kind"] == "call"}
    assert json.loads(made[0, "call"]["json"])["id"] == "\ud800" and made[0, "call"]["call_id"] == "\\ud800"
    assert json.loads(made[1, "call"]["json"])["arguments"]["n"] == int("9" * 400) and made[1, "call"]["errors"] == "no result"
    assert {t for t, _ in made} == {0, 1, 6, 7}
    whole = [json.loads(r["json"])["content"] for r in out if r["kind"] == "message"]
    assert deep in whole and "{" * 100_000 in whole


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "assistant", calls(call("a")), "x", "y", "z")],
                               "conv_id long, turn long, role string, text string, json string, place string, linked string")
    assert [(r["kind"], r["errors"]) for r in chat.format_chats(df, SCHEMAS).collect()] == [("call", "no result")]
    assert chat.format_chats(df.limit(0), SCHEMAS).collect() == []
