"""Personal data: odd letters, long runs, and disguises."""

import time

import pyarrow as pa
import pytest

from lectern.llm import pii


def spans(text):
    plain = pii.plain_spans(text)
    return [(text[a:b], k) for a, b, k in pii.hidden_spans(text, plain)]


def test_no_letter_beside_a_name_breaks_it():
    for lo in range(0, 0x30000, 0x400):
        text = " ".join(f"{chr(c)}ix {chr(c)}even nin{chr(c)} one{chr(c)}two f{chr(c)}ve one {chr(c)} two" for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        for a, b, _ in pii.hidden_spans(text, pii.plain_spans(text)):
            assert 0 <= a < b <= len(text)


@pytest.mark.parametrize(
    "text, found",
    [
        ("plus one ſix ſeven one two three four five six nİne one", [("plus one ſix ſeven one two three four five six nİne one", "phone")]),
        ("jane @ example.com", [("jane @ example.com", "email")]),
        ("jane at corp.example dot com", [("jane at corp.example dot com", "email")]),
        ("jane     at      example    dot     com", [("jane     at      example    dot     com", "email")]),
        ("a dot b dot c at x dot com", [("a dot b dot c at x dot com", "email")]),
        ("mail x@y dot co dot uk now", [("x@y dot co dot uk", "email")]),
        ("192 dot 168 dot 10 dot 5", [("192 dot 168 dot 10 dot 5", "ip")]),
        ("look at example.com and mail @ noon", []),
    ],
)
def test_disguises(text, found):
    assert spans(text) == found
    assert not found or pii.may_hide(pa.array([text]))[0]


@pytest.mark.parametrize("part", ["a@b ", "x dot ", "x at ", "a at b dot c ", " ", "one ", "+ ", "1 dot ", "@ ", "a@", "1", "1.", "(", "+(", "x.", "one dot "])
def test_long_runs_take_linear_time(part):
    text = "a@b " + part * (1_000_000 // len(part))
    began = time.process_time()
    spans(text)
    assert time.process_time() - began < 6


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_email int")
    assert pii.detect(none).count() == 0 and pii.redact(none).columns == none.columns and pii.redact(none).count() == 0
