"""Registered queries against DuckDB or brute force on the small tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import check, connect

from lectern.llm import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, con, sf_dir, name):
    check(spark, con, sf_dir, Q.QUERIES[name], Q.ORACLES[name])


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_by_regex(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_op3_base_spans(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q.op3_pii(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        want = plain_by_regex(text or "")
        r = got[doc_id]
        kinds = [k for *_, k in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in ("email", "ip", "card", "phone"))
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def jaccard_by_force(texts, width=3, percent=90):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w)} if 0 < len(w) < width else set(zip(*(w[k:] for k in range(width)), strict=False)))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(sets))]


def test_op4_against_all_pairs(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q.op4_ngram_jaccard_join(spark, sf_dir).collect()}
    ids = docs.doc_id.tolist()
    sets, roots = jaccard_by_force(docs.text.tolist())
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    assert {i: got[i].component_id for i in ids} == {i: least[r] for i, r in zip(ids, roots, strict=True)}
    assert [got[i].n_shingles for i in ids] == [len(s) for s in sets]


def test_op5_against_tiktoken(spark, sf_dir, docs):
    import base64

    import tiktoken

    content, pattern = Q.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in Q.op5_byte_bpe(spark, sf_dir).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = theirs.encode_ordinary(text or "")
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("query, label, folds, held, least", [(Q.op1_toxicity, "toxic", 5, 0, 0.92), (Q.op7_quality, "quality", 3, 1, 0.97)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).toPandas()
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % folds == held for i in rows.doc_id]
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both[label]).mean() >= least
    good, bad = both.score[both[label] == 1], both.score[both[label] == 0]
    assert np.mean([g > b for g in good for b in bad]) >= least - 0.05


def test_op2_shards(spark, sf_dir, docs):
    rows = Q.op2_training_order(spark, sf_dir).toPandas()
    assert sorted(rows.slot) == list(range(len(rows))) == sorted(rows.number)
    assert (rows.slot != rows.number).mean() > 0.9
    assert (rows.byte_offset == rows.slot % 8192 * 2048).all()


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "byte_bpe"]
    out = P.run(spark, sf_dir).toPandas()
    assert out.doc_id.is_unique and set(out.doc_id) <= set(docs.doc_id)
    by_id = dict(zip(docs.doc_id, docs.text, strict=True))
    toxic = {r.doc_id for r in Q.op1_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    leaked = {r.doc_id for r in Q.op9_decontaminate(spark, sf_dir).where("contaminated").collect()}
    kept = [i for i in docs.doc_id if i not in toxic]
    _, roots = jaccard_by_force([by_id[i] for i in kept], 5, 80)  # the stage's own width and similarity, not op4's
    first = {}
    for i, r in sorted(zip(kept, roots, strict=True)):
        first.setdefault(r, i)
    want = {i for i in first.values() if i not in leaked}
    assert set(out.doc_id) == want
    from lectern.llm.byte_bpe import Tokenizer
    from lectern.llm.pii import hidden_spans, mask, plain_spans

    t = Tokenizer(*Q.vocabulary())
    for r in out.itertuples():
        text = by_id[r.doc_id]
        plain = plain_spans(text)
        assert t.decode(r.ids).decode() == mask(text, plain + hidden_spans(text, plain))
        assert r.n_tokens * 4 == len(r.ids)
