"""URL filter, language-model scores, surrogates and tool calls on small fixtures."""

import json
import math
from collections import Counter

import pytest

from pairlytics.llm import lm_score, pii, tool_calls, url_filter


def test_url_rules(spark):
    rows = [(1, "http://A.example.com/en/1", None), (2, "https://www.example.com/en/x?y", ""), (3, "http://x.net/es/1", None), (4, "http://x.net/en/", None), (5, "http://z.net/en/", None),
            (6, None, None), (7, "nothing", None), (8, "http://example.com/de#f", None), (9, "http://com", None), (10, "http://notexample.com/en/", None), (11, "http://x.net/en/", None)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    rule = {i: (got[i]["rule"], got[i]["verdict"]) for i in got}
    assert rule[1] == ("example.com/en/", "block") and rule[2] == ("www.example.com/en/", "allow") and rule[3] == ("net/es/", "block")
    assert rule[4] == (None, "block") and rule[5] == (None, "allow") and rule[6] == rule[7] == (None, "allow")
    assert rule[8] == ("com/", "allow") and rule[9] == (None, "allow") and rule[10] == ("com/", "allow")
    assert (got[1]["host"], got[1]["path"], got[6]["host"], got[7]["path"]) == ("a.example.com", "/en/1", "", "")


def test_url_propagation(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "ROUNDS", 6)
    link = '<a class=x href="https://{}/p">t</a>'
    pages = [(1, "http://good.com/", link.format("friend.org")), (2, "http://friend.org/", link.format("far.org")), (3, "http://far.org/", ""), (4, "http://spam.org/", link.format("bad.net")), (5, "http://bad.net/es/", "")]
    got = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got["far.org"]["trust"] > 0 and got["far.org"]["verdict"] == "allow"
    assert got["spam.org"]["distrust"] > 0 and got["spam.org"]["verdict"] == "block"
    edges = {"good.com": ["friend.org"], "friend.org": ["far.org"]}
    rank = {"good.com": 1.0}
    for _ in range(6):
        new = Counter()
        for h, to in edges.items():
            for t in to:
                new[t] += 0.85 * rank.get(h, 0) / len(to)
        new["good.com"] += 1 - sum(new.values())
        rank = new
    assert all(abs(got[h]["trust"] - rank[h]) < 1e-5 for h in ("good.com", "friend.org", "far.org"))


def brute_scores(texts):
    docs = [["<s>", "<s>", *(t or "").encode().lower().split()] for t in texts]
    c = [Counter(tuple(d[i : i + n]) for d in docs if len(d) > 2 for i in range(n == 1, len(d) - n + 1)) for n in (1, 2, 3)]
    total = sum(v for k, v in c[0].items() if k != ("<s>",))
    out = []
    for d in docs:
        own = [Counter(tuple(d[i : i + n]) for i in range(len(d) - n + 1)) for n in (1, 2, 3)]
        own[0][("<s>",)] -= 1
        rest = lambda *g: c[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        s = 0.0
        for i in range(2, len(d)):
            x, y, z = d[i - 2 : i + 1]
            if rest(x, y, z) > 0:
                s += math.log10(rest(x, y, z) / rest(x, y))
            elif rest(y, z) > 0:
                s += math.log10(0.4 * rest(y, z) / rest(y))
            else:
                s += math.log10(0.16 * max(rest(z), 0.5) / max(1, total - len(d) + 2))
        out.append(s / (len(d) - 2) if len(d) > 2 else None)
    return out


def test_lm(spark, docs, odd):
    for given in (docs, odd, odd.limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect()]
        want = Counter((i, None if s is None else round(s, 3)) for (i, _), s in zip(rows, brute_scores([t for _, t in rows]), strict=True))
        got = [(r["doc_id"], r["score"]) for r in lm_score.score(given).collect()]
        assert len(got) == len(rows)
        for i, s in got:
            assert any(j == i and ((s is None and t is None) or (s is not None and t is not None and abs(s - t) < 2e-3)) for j, t in want), (i, s)


def test_pii(spark):
    texts = [(1, "Write to Ann.Lee@mail.example.com or ann.lee@mail.example.com, IP 10.1.2.3."), (2, "ann.lee@mail.example.com again"), (3, "card 4111 1111 1111 1111, not 4111 1111 1111 1112"),
             (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3"'), (5, "Frau Müller and Mr. Smith, Госпожа Иванова"), (6, "clean 12:30 text 3.14 1.2.3"), (7, None), (8, ""), (9, "+49 (30) 1234-5678 x"), (2, "ann.lee@mail.example.com again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, PII_MAP string")
    rows = pii.replaced(df).collect()
    got = {r["doc_id"]: r["pii_text"] for r in rows}
    assert len(rows) == len(texts) and got[6] == "clean 12:30 text 3.14 1.2.3" and got[7] is None and got[8] == ""
    assert "ann.lee" not in got[2] and got[2].endswith(".com again") and got[2].split()[0] in got[1] and got[2].split()[0] in got[1].lower()
    assert "10.1.2.3" not in got[1] and got[3].endswith("not 4111 1111 1111 1112") and "4111 1111 1111 1111" not in got[3]
    digits = [int(c) for c in got[3].split(",")[0] if c.isdigit()]
    assert len(digits) == 16 and sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    assert got[4].startswith('token = "') and got[4].endswith('"') and "24be" not in got[4] and len(got[4]) == len(texts[3][1])
    assert got[5].startswith("Frau ") and "na and Mr. " in got[5] and got[5].endswith("на") and "Müller" not in got[5]
    assert got[9].startswith("+") and got[9].endswith(" x") and "1234" not in got[9]
    assert pii.replace_pii(df).columns == df.columns


def test_pii_distinct(spark):
    n = 1000  # few octets: many first draws collide
    df = spark.createDataFrame([(i, f"see 10.0.{i // 250}.{i % 250} now") for i in range(n)], "doc_id long, text string")
    got = [r["pii_text"] for r in pii.replaced(df).collect()]
    assert len(set(got)) == n
    names = spark.createDataFrame([(i, f"Mr. {chr(65 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'abcdefghij'[i // 260]}x") for i in range(2000)], "doc_id long, text string")
    out = [r["pii_text"] for r in pii.replaced(names).collect()]
    assert len(set(out)) == 2000


def test_tool_calls(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("a", "search", {"query": "${b}", "limit": 3}), call("b", "calculator", {"expression": "1"})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r1"})), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "r2"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": ""})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("c", "search", {"limit": "x"}), call("d", "nope", {})]})), (2, 1, None, None), (3, 0, "user", "{broken \"tool_calls\""),
    ]
    got = tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"]): r for r in got if r["kind"]}
    assert by[1, 1, "a"]["level"] == 1 and by[1, 1, "b"]["level"] == 0 and by[1, 1, "a"]["errors"] == [] and by[1, 2, "a"]["status"] == "linked"
    assert by[1, 2, "zz"]["status"] == "no call" and by[2, 1, "c"]["status"] == "no result"
    assert by[2, 1, "c"]["errors"] == ["missing query", "wrong type of limit"] and by[2, 1, "d"]["errors"] == ["unknown tool nope"]
    assert by[1, 1, "b"]["json"] == '{"arguments":"{\\"expression\\":\\"1\\"}","id":"b","name":"calculator"}'
    assert sum(r["kind"] == 0 for r in got) == 5
