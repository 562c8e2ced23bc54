import time

import pytest

from duewise.llm import personal_data as pd_

ADDRESSES = [
    "john [at] example dot com", "john at example [dot] com", "john @ example.com", "john [at] mail.example dot com",
    "jane dot doe at example dot com", "jane [dot] doe at mail dot example (dot) com", "jane.doe (at) example . com",
    "jane dot doe [at] example.com", "john AT mail dot example DOT com", "john at example . com", "a_b+c [at] x-y dot org",
]
CLEAN = [
    "The meeting is at noon.", "is at noon. Dot the i", "shop at example.com today", "look (at) this", "meet me @ 5.30 pm", "we met @ noon. Then left",
    "at the dot at the end", "connect dot to dot at home",
]


@pytest.mark.parametrize("address", ADDRESSES)
def test_mixed_forms(address):
    for text in (f"write {address} now", f"look at {address}, please", f"写信{address}", f"x@y.org or a@b.com . {address}"):
        if text.startswith("look at") and " at " not in address.lower():
            continue
        found = [s["value"] for s in pd_.spans_of(text) if not s["plain"] and s["kind"] == "email"]
        assert found == [address], text


@pytest.mark.parametrize("text", CLEAN)
def test_prose_is_clean(text):
    assert pd_.spans_of(text) == []


def test_time_stays_linear():
    start = time.monotonic()
    for text in ("a dot " * 40_000, "a at " * 40_000, "a at b dot " * 20_000, "dot " + "+" * 200_000, "a . " * 50_000, "a @ " * 50_000):
        pd_.spans_of(text)
    assert time.monotonic() - start < 20
