"""Toxicity and quality: sentences, scores by definition, held-out recall, odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality, toxicity
from lectern.llm import queries as Q

SMALL = "/root/testdata/sf0.01"


def sentences(text):
    codes = toxicity.text_codes([text])[0].tolist()
    out, held = [], []
    for c in codes:
        if c:
            held.append(c)
        elif held:
            out.append("".join(" " if x == 1 else toxicity._LETTERS[x - 2] for x in held))
            held = []
    return out


def test_texts_are_cut_into_sentences():
    long = "the first sentence is quite long. and the second one is long as well! is there really a third one too?\n\nand one after an empty line"
    assert sentences(long) == [" the first sentence is quite long ", " and the second one is long as well ", " is there really a third one too ", " and one after an empty line "]
    assert sentences("an i. d. i. o. t. goes on and on and on") == [" an i d i o t goes on and on and on "]
    assert sentences("shout!! these!! few!! words!!") == [" shout these few words "]
    assert sentences("") == [" "]


def test_no_window_reaches_over_a_sentence():
    rng = np.random.default_rng(1)
    weights = np.zeros(toxicity.ALPHABET**toxicity.LENGTH, dtype=np.float32)
    used = rng.integers(0, len(weights), 200_000)
    used = used[[all(f // toxicity.ALPHABET**k % toxicity.ALPHABET for k in range(4)) for f in used.tolist()]]
    weights[used] = 1
    first, second = "some words of a first long sentence here.", "other words of another long sentence."
    both, _ = toxicity._top(*toxicity.text_codes([f"{first} {second}"]), weights)
    apart, _ = toxicity._top(*toxicity.text_codes([first, second]), weights)
    assert sorted(apart.ravel().tolist())[-1] == pytest.approx(both.max())


def by_definition(machine, text):
    """Score of one text: every window of every sentence, every gapped subsequence, in plain loops."""
    weight = dict(zip(machine.features.tolist(), machine.values.tolist(), strict=True))
    codes = toxicity.text_codes([text])[0].tolist()
    n, size = len(codes), toxicity.ALPHABET
    response = [0.0] * n
    for i in range(n):
        for a, b, c in toxicity._GAPS:
            if i + c < n:
                four = [codes[i], codes[i + a], codes[i + b], codes[i + c]]
                if all(four):
                    response[i] += weight.get(((four[0] * size + four[1]) * size + four[2]) * size + four[3], 0.0) * toxicity.DECAY ** (c + 1)
    windows = []
    for i in range(n - toxicity.WINDOW):
        stop = next(j for j in range(i, n) if codes[j] == 0)
        windows.append(sum(response[i : min(i + toxicity.WINDOW - toxicity.SPAN + 1, stop)]))
    total = machine.shift
    for k in range(toxicity.TOP):
        j = max(range(len(windows)), key=lambda x: windows[x], default=None)
        if j is None or windows[j] <= 1e-9:
            break
        total += machine.slopes[k] * windows[j]
        for x in range(max(0, j - toxicity.WINDOW), min(len(windows), j + toxicity.WINDOW)):
            windows[x] = 0.0
    return 1 / (1 + np.exp(-total))


def test_op1_scores_by_definition(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(docs, labels, toxicity.fold_of(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in Q.op1_toxicity(spark, SMALL).collect()}
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    for doc_id, text in list(zip(table.doc_id, table.text, strict=True))[::9]:
        if len(text or "") < 4000:
            assert got[doc_id] == pytest.approx(by_definition(machine, text or ""), abs=2e-3)


def test_op7_scores_by_definition(spark):
    """All pairs of features instead of the linear-time identity."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels, toxicity.fold_of(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.score for r in Q.op7_quality(spark, SMALL).collect()}
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    for r in list(table.itertuples())[::25]:
        for _, borders, f, v in quality.featurise(pa.array([r.text or ""]), np.array([float(r.n_chars)])):
            f, v = f[: borders[1]], v[: borders[1]]
            x = m.factors[f] * v[:, None]
            g = x @ x.T
            want = m.bias + (m.linear[f] * v).sum() + (g.sum() - np.trace(g)) / 2
            assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-6)


@pytest.mark.parametrize("query, label, folds, held, recall, area", [(Q.op1_toxicity, "toxic", 5, 0, 0.6, 0.9), (Q.op7_quality, "quality", 3, 1, 0.9, 0.95)])
def test_held_out_recall(spark, query, label, folds, held, recall, area):
    rows = query(spark, SMALL).toPandas()
    both = rows[[zlib.crc32(str(i).encode()) % folds == held for i in rows.doc_id]].merge(pq.read_table(f"{SMALL}/labels.parquet").to_pandas(), on="doc_id")
    good, bad = both.score[both[label] == 1], both.score[both[label] == 0]
    assert (good >= 0.5).mean() >= recall and (bad < 0.5).mean() >= 0.9
    assert np.mean([g > b for g in good for b in bad]) >= area


def test_metadata_is_learnt():
    """Texts that differ in nothing but the stated length."""
    texts, stated = ["some calm words here"] * 80, np.array([20.0] * 40 + [2000.0] * 40)
    m = quality.train(pa.array(texts), stated, [1] * 40 + [0] * 40)
    good, bad = quality.score_rows(m, pa.array(texts[:2]), np.array([20.0, 2000.0]))
    assert good > 0.7 and bad < 0.3


def test_unseen_features_count_nothing():
    m = quality.train(pa.array(["some calm words here", "BUY NOW $$$"] * 20), np.full(40, np.nan), [1, 0] * 20)
    same = quality.score_rows(m, pa.array(["some calm words here"] * 2), np.array([60.0, 200.0]))
    assert same[0] == same[1]


def test_empty_tables(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0), spark.read.parquet(f"{SMALL}/labels.parquet").limit(0)
    for fit, score in ((toxicity.fit, toxicity.score_documents), (quality.fit, quality.score_documents)):
        machine = fit(docs, labels, F.lit(True))
        assert machine.constant == 0.0 and score(docs, machine).count() == 0
    assert toxicity.keep_clean(docs, toxicity.train([], [])).columns == docs.columns
