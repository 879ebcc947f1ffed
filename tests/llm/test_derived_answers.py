"""Links that only a follower's corrected answers show, and the bounds that answer the rest."""

import random

import pytest

from lectern.llm import jaccard_join
from lectern.llm.workspace import Workspace


def force(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def chains(rng, groups, percent):
    """Groups around centres that lie just too far apart, with sets between them."""
    out = []
    for g in range(groups):
        centre = [f"g{g}w{i}" for i in range(80)]
        step = max(1, (100 - percent) * 80 // 100 // 2)
        for k in range(rng.randint(2, 6)):  # centres drift away from each other
            for _ in range(rng.randint(1, 7)):
                own = list(centre)
                for _ in range(rng.randint(0, step)):
                    own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
                out.append(own[: rng.randint(70, 80)])
            for _ in range(rng.randint(step // 2, 3 * step)):
                centre[rng.randrange(80)] = f"g{g}k{k}{rng.randrange(400)}"
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, percent, width", [(1, 80, 1), (2, 90, 1), (3, 60, 2), (4, 80, 3), (5, 50, 1)])
def test_drifting_groups(spark, seed, percent, width):
    rng = random.Random(seed)
    words = chains(rng, 8, percent)
    sets = [set(zip(*(w[i:] for i in range(width)), strict=False)) for w in words]
    want = force(sets, percent)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, Workspace(spark, "t"), width, percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


def test_one_id_in_many_classes(spark):
    """Rows that share an id tie their classes; rows without id or words stay alone."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(5, a), (5, b), (9, b), (4, a + " more"), (7, c), (None, a), (8, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _jaccard_keep string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs, Workspace(spark, "t"), 3, 90).collect()), key=str)
    assert got == sorted([(5, 4), (5, 4), (9, 4), (4, 4), (7, 7), (None, None), (8, 8), (5, 5)], key=str)
    kept = jaccard_join.keep_one_of_each(docs.where("doc_id <> 5 OR text <> ''"), Workspace(spark, "t"), 3, 90)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [4, 7, 8, None]


@pytest.mark.parametrize("partitions", [2, 60])
def test_leaders_do_not_depend_on_partitions(spark, partitions):
    """One group of near copies whose lists run over many partitions: its sets meet their leaders, so few pairs are left to derive."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        own = list(base)
        own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    left = []

    class Counting(Workspace):
        def table(self, frame, name="t", **options):
            out = super().table(frame, name, **options)
            if name == "rest":
                left.append(out.count())
            return out

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = jaccard_join.jaccard_components(docs, Counting(spark, "t"), 1, 90).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {r.component_id for r in got} == {0} and left == [0]
