"""Turns that only look like calls keep their text; malformed calls are reported."""

import json

from pairlytics.llm import tool_calls


def test_text_is_kept(spark):
    texts = ['{broken "tool_calls"', '{"tool_calls": [{"id": "a", "na', json.dumps({"note": {"tool_calls": []}}), json.dumps({"tool_calls": "search"}), json.dumps({"tool_calls": ["search"], "content": "c"}), json.dumps({"tool_calls": [], "content": "said"}), json.dumps({"tool_calls": None, "content": "x"})]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)]
    got = {r["turn"]: r for r in tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    content = {i: json.loads(r["json"])["content"] for i, r in got.items()}
    assert len(got) == len(texts) and all(content[i] == texts[i] for i in (0, 1, 2, 3, 4, 6)) and content[5] == "said"
    assert [got[i]["errors"] for i in range(7)] == [[], [], [], ["malformed tool_calls"], ["malformed tool_calls"], [], []]
