"""Cards among other numbers, whole secrets, and one surrogate per card or phone whatever its format."""

import re

from pairlytics.llm import pii


def test_nothing_left_in_clear(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.c2lnbmF0dXJlc2lnbmF0dXJl"
    long = "k9" * 500
    texts = ["pay 4111 1111 1111 1111 12/26 x", "order 12 4111111111111111 x", "on 2024-01-06 4111111111111111 x", "n 1234 5678 4012 8888 8888 1881 5555 5555 5555 4444 x", f"token = {jwt}. End",
             f"password: {long} end", "call +49 (30) 1234-5678 x", "call +49 30 12345678 x", "4111 1111 1111 1112 is none", "4111 1111 1111 1111 10.1.2.3 x", "7 " * 5000, "see 4111-1111-1111-1111 x", "on 2024-01-06 4111-1111-1111-1111 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.replaced(df).collect()}
    got = {i: r["pii_text"] for i, r in rows.items()}
    digits = lambda t: re.sub("[^0-9]", "", t)
    for i in (0, 1, 2, 9, 11, 12):
        assert "4111111111111111" not in digits(got[i]), got[i]
    assert got[0].endswith(" 12/26 x") and got[1].startswith("order 12 ") and got[2].startswith("on 2024-01-06 ")
    cards = {digits(got[0])[:16], digits(got[1])[2:], digits(got[2])[8:], digits(got[11])}
    assert len(cards) == 1 and re.search(r"\d{4}-\d{4}-\d{4}-\d{4} x", got[11])
    assert got[3].startswith("n 1234 5678 ") and "4012888888881881" not in digits(got[3]) and "5555555555554444" not in digits(got[3]) and rows[3]["pii_count"] == 2
    assert not any(p in got[4] for p in jwt.split(".")) and got[4].endswith(". End") and len(got[4]) == len(texts[4])
    assert "k9k9k9k9k9k9" not in got[5] and got[5].endswith(" end")
    assert digits(got[6]) == digits(got[7]) != digits(texts[6]) and re.fullmatch(r"call \+\d\d \(\d\d\) \d{4}-\d{4} x", got[6])
    assert got[8] == texts[8] and got[10] == texts[10] and "10.1.2.3" not in got[9] and rows[9]["pii_count"] == 2
