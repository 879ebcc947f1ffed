"""The pipeline's near-copy stage against all pairs at five words and 0.8."""

import random

import corpus_pipeline as P


def five_word_sets(texts):
    words = [t.split() for t in texts]
    return [{tuple(w)} if len(w) < 5 else set(zip(*(w[i:] for i in range(5)), strict=False)) for w in words]


def kept_by_force(rows):
    sets = five_word_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return set(least.values())


def edited(rng, words, changes):
    """With that many words replaced, far enough apart that no shingle holds two."""
    out = list(words)
    for i in range(changes):
        out[(2 * i + 1) * len(words) // (2 * changes)] = f"new{rng.randrange(10**9)}"
    return out


def test_stage_against_all_pairs(spark, sf_dir):
    rng = random.Random(5)
    texts = []
    for n, changes in ((100, (2, 3)), (200, (4, 6)), (500, (9, 14))):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [base, *(edited(rng, base, c) for c in changes)]
    whole = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts += [whole, whole[:88], whole[:60], ["only", "four", "words", "here"], ["only", "four", "words", "here"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = kept_by_force(rows)
    assert want == {0, 2, 3, 5, 6, 8, 9, 11, 12}  # the first edit of each base, the short cut and the exact copy go
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, sf_dir).collect()} == want
