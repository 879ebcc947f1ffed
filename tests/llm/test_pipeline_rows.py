"""Stages on odd tables: nulls, empty and very long texts, repeated rows, no rows, columns with clashing names."""

import corpus_pipeline as P
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, `_row` string, _jaccard_keep string, runs int, `a b` string"
LONG = "many plain words go here and there " * 30_000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "write to jane@example.com soon"), (4, "write to jane@example.com soon"), (5, LONG), (None, "a row of no id"), (None, None), (6, "ſix é 中 \U0001f600 \x00")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 0.5, "r", "k", 7, "c") for i, t in rows], SCHEMA).repartition(3)


def by_id(frame):
    return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_odd_rows(spark, sf_dir, name):
    out = dict(P.STAGES)[name](spark, frame(spark, TEXTS), sf_dir)
    assert out.columns == frame(spark, []).columns and out.dtypes == frame(spark, TEXTS).dtypes
    want = list(TEXTS)
    if name == "ngram_jaccard_join":
        want.remove(TEXTS[4])
    if name == "pii":
        want = [(i, t and t.replace("jane@example.com", "<EMAIL>")) for i, t in want]
        assert {r.n_chars for r in out.where("doc_id = 4").collect()} == {len("write to <EMAIL> soon")}
    assert by_id(out) == sorted(want, key=str)
    assert {(r.ids, r.runs) for r in out.select("ids", "runs").collect()} == {("x", 7)}


def test_last_stage_on_odd_rows(spark, sf_dir):
    from lectern.llm.queries import vocabulary
    from lectern.llm.byte_bpe import Tokenizer

    t = Tokenizer(*vocabulary())
    out = P.encode_ids(spark, frame(spark, TEXTS), sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted(((r.doc_id, r.n_tokens, t.decode(r.ids).decode()) for r in out.collect()), key=str)
    assert got == sorted(((i, len(t.encode(x or "")) // 4, x or "") for i, x in TEXTS), key=str)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_no_rows(spark, sf_dir, name):
    out = dict(P.STAGES)[name](spark, frame(spark, TEXTS).limit(0), sf_dir)
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == frame(spark, []).columns)
