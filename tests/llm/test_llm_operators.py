"""Kernels and operators on small fixtures: nulls, empties, repeats, long texts, clashing columns."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, bytekit, chat_format, decontaminate, jaccard_join, pii, quality, topk_search, toxicity, training_order, warc_fixity
from lectern.llm.queries import END_OF_TEXT, vocabulary
from lectern.llm.workspace import Workspace, components

DOCS = "doc_id long, text string, hits string, score string, `_row` string, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "h", "s", "r", "p") for i, t in rows], DOCS).repartition(3)


LONG = "alpha beta gamma delta " * 60_000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, "one two"), (7, "one two"), (None, "one two"), (8, "\x00é中\U0001f600 ok")]


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\t.中") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None]
    seen = {}
    for lo, hi, buf, offsets in bytekit.text_slices(pa.array(texts), 200):
        starts, ends, first = bytekit.word_spans(buf, offsets, bytekit.NONSPACE)
        hashes = bytekit.word_hashes(buf, starts, ends)
        for row in range(hi - lo):
            words = (texts[lo + row] or "").translate({65: "a", 66: "b"}).replace("\t", " ").split(" ")
            words = [w for w in words if w]
            got = hashes[first[row] : first[row + 1]].tolist()
            assert len(got) == len(words)
            for w, h in zip(words, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(5001, 5100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7), Workspace(spark, "t")).collect()}
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            if parent[a] != m or parent[b] != m:
                parent[a] = parent[b] = m
                changed = True
    assert got == {x: m for x, m in parent.items() if x != m}


def test_jaccard_odd_rows(spark):
    rows = frame(spark, ODD)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows, Workspace(spark, "t"), 3, 90).collect()), key=str)
    n = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 4, 7: 1, 8: 1}
    want = [(i, n[i], {7: 5}.get(i, i)) for i in (1, 2, 3, 4, 5, 6, 7, 7, 8)] + [(None, 1, None)]
    assert got == sorted(want, key=str)
    kept = jaccard_join.keep_one_of_each(rows, Workspace(spark, "t"), 3, 90)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, None], key=str)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(frame(spark, []).limit(0), Workspace(spark, "t")).count() == 0


def near_copies(seed, groups=6, copies=40, size=120):
    """Groups of edited copies, with a passage that all documents share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(size)] + shared
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text = text[: rng.randint(len(text) - 12, len(text))]
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_near_copies(spark, seed):
    from test_llm_queries import jaccard_by_force

    texts = near_copies(seed)
    _, roots = jaccard_by_force(texts)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, list(enumerate(texts))), Workspace(spark, "t"), 3, 90).collect()}
    assert got == {i: least[r] for i, r in enumerate(roots)}


BENCH = "item_id long, text string, doc_id string"


def contaminated(spark, docs, items, **more):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    found = decontaminate.find_contamination(frame(spark, docs), bench, Workspace(spark, "t"), **more)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination_digest(found).collect()}


def test_windows_in_documents(spark):
    item = [f"q{i}" for i in range(14)]
    docs = [
        (1, " ".join(["x"] * 5 + item[2:12] + ["y"])), (2, " ".join(item[:9])), (3, "Solo, word!"), (4, None), (5, ""), (6, " ".join(item).upper() + " " + " ".join(item)),
        (7, " ".join(item[:10]) + " é " + " ".join(item[10:])), (8, "ÉX solo"),
    ]
    items = [(10, " ".join(item)), (11, "solo"), (12, None), (13, "..."), (10, " ".join(item)), (None, "y")]
    want = {1: (16, 11, 1, True), 2: (9, 0, 0, False), 3: (2, 1, 1, True), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (28, 28, 1, True), 7: (15, 10, 1, True), 8: (2, 1, 1, True)}
    assert contaminated(spark, docs, items) == want
    kept = decontaminate.keep_uncontaminated(frame(spark, docs), spark.createDataFrame([(i, t, "x") for i, t in items], BENCH), Workspace(spark, "t"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    assert contaminated(spark, docs, []) == {i: (n, 0, 0, False) for i, (n, *_) in want.items()}


def test_windows_by_force(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("a b c d".split()) for _ in range(rng.choice([1, 2, 4, 6, 12])))) for i in range(30)]
    got = contaminated(spark, docs, items)
    for i, text in docs:
        w, hit, some = text.split(), set(), set()
        for item, t in items:
            v = t.split()
            k = min(10, len(v))
            for window in {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}:
                for p in range(len(w) - k + 1):
                    if tuple(w[p : p + k]) == window:
                        hit |= set(range(p, p + k))
                        some.add(item)
        assert got[i] == (len(w), len(hit), len(some), bool(hit))


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_that_meet_modulo_powers_of_two(spark):
    """Different words with equal polynomial hashes modulo 2**64 stay different."""
    for n in (1024, 4096):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        docs = [(1, f"one two {x} three four"), (2, f"one two {y} three four")]
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, docs), Workspace(spark, "t"), 3, 50).collect()}
        assert got == {1: 1, 2: 2}
        assert {k: v[3] for k, v in contaminated(spark, docs, [(5, f"{x} three")]).items()} == {1: True, 2: False}


def test_a_passage_of_many_documents(spark):
    """One window in every document, many items with the same window, and runs that hold no window."""
    item = [f"w{i}" for i in range(12)]
    docs = [(i, f"a{i} b{i} " + " ".join(item[:10]) + f" c{i}") for i in range(300)] + [(1000, " ".join(item[:9])), (1001, " ".join(item[1:6] + item[3:12]))]
    items = [(k, " ".join(item)) for k in range(40)]
    got = contaminated(spark, docs, items)
    assert all(got[i] == (13, 10, 40, True) for i in range(300)) and got[1000] == (9, 0, 0, False) and got[1001] == (14, 0, 0, False)


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([(1, "solo word", "a", "b"), (2, "other", "a", "b"), (3, None, "a", "b")], "doc_id long, text string, `_row` string, runs string")
    bench = spark.createDataFrame([(1, "solo", "x")], BENCH)
    kept = decontaminate.keep_uncontaminated(rows, bench, Workspace(spark, "t"))
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontaminate.keep_uncontaminated(rows.limit(0), bench.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize(
    "text, found",
    [
        ("john.doe [at] example [dot] com", [("john.doe [at] example [dot] com", "email")]),
        ("ask jane at example dot com now", [("jane at example dot com", "email")]),
        ("ｊｏｈｎ＠example.com", [("ｊｏｈｎ＠example.com", "email")]),
        ("jоhn@exаmple.com", [("jоhn@exаmple.com", "email")]),
        ("plus four nine one five one two three four five six", [("plus four nine one five one two three four five six", "phone")]),
        ("one nine two dot one six eight dot one dot one", [("one nine two dot one six eight dot one dot one", "ip")]),
        ("look at example.com, dot and all", []),
        ("one two three", []),
        ("", []),
    ],
)
def test_hidden_spans(text, found):
    plain = pii.plain_spans(text)
    hidden = pii.hidden_spans(text, plain)
    assert [(text[a:b], k) for a, b, k in hidden] == found
    assert not found or pii.may_hide(pa.array([text]))[0]


def test_plain_spans_by_regex():
    from test_llm_queries import plain_by_regex

    rng = random.Random(2)
    parts = ["a", "b", "@", "@", ".", "1", "25", "4111111111111111", "5500 0000-0000 0004", "+", "-", " ", "(", ")", "_", "é", "%", "300.", "1.2.3.4"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert sorted((a, b, k) for a, _, b, k in plain_by_regex(text)) == sorted(pii.plain_spans(text))


def test_pii_odd_rows(spark):
    rows = frame(spark, [*ODD, (9, "a@b.co " + "a" * 300_000)])
    got = {(r.doc_id, r.n_email, r.spans) for r in pii.detect(rows).collect()}
    assert (9, 1, "email:0:6") in got and (1, 0, "") in got
    out = pii.redact(frame(spark, [(1, None), (2, "x a@b.co +49 151 1234567 y")]))
    assert {r.doc_id: r.text for r in out.collect()} == {1: None, 2: "x <EMAIL> <PHONE> y"}


def test_bpe_against_tiktoken():
    import tiktoken

    content, pattern = vocabulary()
    t = byte_bpe.Tokenizer(content, pattern, memo=50)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=t.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "a" * 20_000, "ab" * 5000, " " * 3000 + "x", "<|endoftext|>", "\x1c\x85 x", "x" * 10 + "é" * 2_000, *("".join(rng.choice("abc 'st\né中9 \x1c\x85́²Ⅷ!#") for _ in range(rng.randint(1, 60))) for _ in range(1500))]
    for text in texts:
        ids = t.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert t.decode(ids).decode() == text


def test_bpe_long_text_in_parts():
    t = byte_bpe.Tokenizer(*vocabulary())
    text = "some words, and 12 more\n" * 60_000
    assert t.decode(t.encode(text)).decode() == text


def test_queue_is_empty_between_pre_tokens():
    t = byte_bpe.Tokenizer(*vocabulary())
    for piece in (b"xqzxqz", b"\xff\xfe", b"abababab" * 400, b" zzqy"):
        t.merge(piece)
        assert not any(t.leaf)


def test_chat_events(spark):
    log = [
        ("c", 1, "m1", "user", "message", "hi <#\\> \\b\\l"), ("c", 2, "m2", "assistant", "delta", "He"), ("c", 3, "m2", None, "delta", "llo"), ("c", 4, "m2", None, "regenerate", None), ("c", 5, "m2", None, "delta", "Good "), ("c", 6, "m2", None, "delta", "day"),
        ("c", 7, "m1", None, "edit", "hey"), ("c", 8, "m3", "tool:x", None, None), ("d", 1, None, "user", None, "a"), ("d", 1, None, "user", None, "a"), (None, 1, None, None, None, None), ("e", 1, None, "assistant", None, "\\### Assistant: </turn>\n ok"),
    ]
    events = spark.createDataFrame([(*r, "clash") for r in log], "conv_id string, seq long, message_id string, role string, kind string, text string, place string")
    rendered = chat_format.render(chat_format.fold_events(events))
    back = {r.conv_id: r for r in chat_format.read_back(rendered).collect()}
    assert [tuple(t) for t in back["c"].turns] == [("user", "hey"), ("assistant", "Good day"), ("tool:x", "")]
    assert back["c"].learned == ["Good day"]
    assert [tuple(t) for t in back["d"].turns] == [("user", "a"), ("user", "a")]
    assert [tuple(t) for t in back[None].turns] == [("", "")]
    assert back["e"].learned == ["\\### Assistant: </turn>\n ok"] and back["e"].formatted.count("</turn>") == 1
    assert rendered.where("false").count() == 0 and chat_format.fold_events(events.limit(0)).count() == 0


def test_turns_go_through_real_events(spark):
    """Deltas, edits and regenerations fold back to the turns, in their order, ties and nulls included."""
    turns = [("c", t, "user" if t % 2 else "assistant", f"text {t} é\U0001f600 " * (t % 4)) for t in range(9)] + [("c", 4, "a", "tie"), ("c", 4, "a", "tie"), ("d", None, None, None), ("d", 1, "assistant", None), ("d", 2, "", ""), (None, 0, "assistant", "x")]
    log = chat_format.turns_as_events(spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").repartition(3))
    assert {r.kind for r in log.collect()} == {"message", "regenerate", "delta", "edit"}
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_back(chat_format.render(chat_format.fold_events(log))).collect()}
    want = {}
    for c, t, role, text in sorted(turns, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    plan = chat_format.render(chat_format.fold_events(log))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_chat_is_native(spark):
    events = spark.createDataFrame([("c", 1, None, "user", None, "a")], "conv_id string, seq long, message_id string, role string, kind string, text string")
    plan = chat_format.format_digest(chat_format.read_back(chat_format.render(chat_format.fold_events(events))))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def brute_top(rows, queries, k, scale=1024):
    out = set()
    good = [(i, np.floor(scale * np.array(v, dtype=np.float64))) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, x in ((i, x) for i, x in good if i in queries):
        scored = sorted((-min(int(sum(int(a) * int(b) for a, b in zip(x, y, strict=True))), 2**63 - 1), j) for j, y in good if j != i and len(x) == len(y))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 40) for i in range(40)] + [(2000, None), (2100, [None] + [1.0] * 39), (2200, [float("nan")] * 40), (2300, [1.0, 2.0]), (2301, [1.0, -2.0]), (2400, [1e9] * 40), (2401, [1e9] * 40), (None, [1.0, 1.0]), (2500, [])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, lane int, rank int").repartition(5)
    got = {tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), 5, lanes=3).collect()}
    assert got == brute_top(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 5)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_segment_bound_holds():
    rng = np.random.default_rng(1)
    x, y = np.floor(rng.normal(0, 500, (50, 64))), np.floor(rng.normal(0, 500, (60, 64)))
    exact, last = x @ y.T, None
    for parts in (1, 4, 16, 64):
        bound = topk_search.segment_features(x, parts) @ topk_search.segment_features(y, parts).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or bound.mean() <= last
        last = bound.mean()


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = training_order.Feistel(n, b"k")
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert p.numbers(slots).tolist() == list(range(n))
    assert not np.array_equal(training_order.Feistel(1000, b"a").slots(np.arange(1000)), training_order.Feistel(1000, b"b").slots(np.arange(1000)))


def test_shards_read_back(spark, tmp_path):
    content, pattern = vocabulary()
    rows = [(i, f"document number {i} " + "word " * (i % 50)) for i in range(200)] + [(900, None), (901, "")]
    folder = f"file://{tmp_path}/shards"
    index = training_order.materialise(frame(spark, rows), Workspace(spark, "t"), folder, content, pattern, END_OF_TEXT, b"key", length=32, per_shard=20).orderBy("slot").collect()
    slots = list(training_order.read_slots(folder, 0, 10**9))
    assert len(slots) == len(index) and [zlib.crc32(s.tobytes()) for s in slots] == [r.crc32 for r in index]
    assert all(np.array_equal(a, b) for a, b in zip(training_order.read_slots(folder, 17, 30), slots[17:47], strict=True))
    t = byte_bpe.Tokenizer(content, pattern)
    stream = sorted(((r.number, slots[r.slot][: r.n_ids]) for r in index), key=lambda x: x[0])
    ids = np.concatenate([s for _, s in stream]).tolist()
    texts, held = [], []
    for i in ids:
        if i == END_OF_TEXT:
            texts.append(t.decode(np.array(held, "<u4").tobytes()).decode())
            held = []
        else:
            held.append(i)
    assert sorted(texts) == sorted(x for _, x in rows if x) and not held


def test_shards_of_nothing(spark, tmp_path):
    content, pattern = vocabulary()
    folder = f"file://{tmp_path}/none"
    assert training_order.materialise(frame(spark, [(1, None)]), Workspace(spark, "t"), folder, content, pattern, END_OF_TEXT, b"key").count() == 0
    assert list(training_order.read_slots(folder, 0, 5)) == []


PAGES = "page_id long, url string, html string, digest string"


def audited(spark, pages, theirs):
    sides = [warc_fixity.lay_out(spark.createDataFrame(rows, PAGES)) for rows in (pages, theirs)]
    return warc_fixity.audit(*sides, Workspace(spark, "t")).collect()


def states(rows):
    out = {}
    for r in rows:
        if r.state != "ok":
            out.setdefault(r.state, []).append(r.page_id)
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_fixity(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i} é</p>", "x") for i in range(2500)] + [(None, None, None, "x"), (7, "http://h/7", "twin", "x"), (None, "http://n", "n", "x")]
    pages += [(9, "http://h/9", "<p>9 é</p>", "x")] * 3
    rows = audited(spark, pages, pages)
    assert len(rows) == len(pages) and states(rows) == {}
    for archive in {r.archive for r in rows}:
        some = sorted((r for r in rows if r.archive == archive), key=lambda r: r.place)
        assert [r.place for r in some] == list(range(len(some)))
        assert [r.offset for r in some] == [sum(x.length for x in some[:k]) for k in range(len(some))] or len(some) > 100
    changed = {3: "<p>3 !</p>", 1500: "<p>a longer one</p>", 2000: ""}
    bad = [(i, u, changed.get(i, h), x) for i, u, h, x in pages if i != 1024]
    assert states(audited(spark, pages, bad)) == {"corrupt": [1500, 2000, 3], "missing": [1024]}
    assert states(audited(spark, pages, [*pages, (5000, "u", "more", "x"), (9, "http://h/9", "<p>9 é</p>", "x")])) == {"extra": [5000, 9]}
    assert states(audited(spark, pages, [p for p in pages if p[0] is not None])) == {"missing": [None, None]}
    assert states(audited(spark, pages, [(i, u, "rot" if h == "twin" else h, x) for i, u, h, x in pages])) == {"corrupt": [7]}


@pytest.mark.parametrize("size", [10, 200])
def test_one_damage_is_one_record(spark, size):
    """One longer record, one lost record: whatever lies behind them stays whole."""
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>", "x") for i in range(size)]
    assert states(audited(spark, pages, [(i, u, h + "x" * (i == 3), x) for i, u, h, x in pages])) == {"corrupt": [3]}
    assert states(audited(spark, pages, pages[:3] + pages[4:])) == {"missing": [3]}
    assert states(audited(spark, pages, [])) == {"missing": sorted(range(size), key=str)}
    assert audited(spark, [], []) == []


def test_record_reads_back(spark):
    row = spark.createDataFrame([("http://h/1", "<p>é\r\n\r\n</p>")], "url string, html string")
    record = warc_fixity.record_bytes(F.col("url"), F.col("html"), F.lit("00"))
    got = row.select(warc_fixity.read_record(record).alias("r"), record.alias("t")).first()
    assert (got.r.url, got.r.payload) == ("http://h/1", "<p>é\r\n\r\n</p>") and "Content-Length: 13\r\n" in got.t


def test_string_kernel_by_definition():
    """Explicit weights give the same value as summing over all common gapped subsequences."""
    rng = random.Random(2)

    def phi(text):
        codes = [int(c) for c in toxicity.text_codes([text])[0] if c]
        out = {}
        for a in range(len(codes)):
            for b in range(a + 1, len(codes)):
                for c in range(b + 1, len(codes)):
                    for d in range(c + 1, min(len(codes), a + toxicity.SPAN)):
                        u = tuple(codes[k] for k in (a, b, c, d))
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (d - a + 1)
        return out

    for _ in range(30):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(2))
        x += " " + x[:3] + "."
        weights = toxicity._table(*map(np.array, zip(*toxicity._profile(f" {y} ").items(), strict=True)))
        got = float(toxicity.response(toxicity.text_codes([x])[0], weights).sum())
        p, q = phi(x), phi(y)
        assert got == pytest.approx(sum(v * q.get(u, 0) for u, v in p.items()), rel=1e-4)


def test_signs_between_letters_cost_nothing():
    one = lambda text: toxicity.text_codes([text])[0].tolist()
    assert one("an i.d-i*o.t!") == one("an idiot") == one("  an   i d i o t ?")
    assert one("a b") != one("ab c")


def test_toxicity_odd_rows(spark):
    texts = ["the plain words go here and there"] * 40 + ["you are an idiot and a clown"] * 40
    machine = toxicity.train(texts, [0] * 40 + [1] * 40)
    got = {r.doc_id: r.score for r in toxicity.score_documents(frame(spark, [(1, None), (2, ""), (3, "he is an idiot and a clown"), (4, "he is an i.d.i.o.t and a cl-own"), (5, "plain words"), (6, LONG)]), machine).collect()}
    assert got[1] == got[2] < 0.5 and got[5] < 0.5 and got[6] < 0.5 and got[3] > 0.5 and got[4] > 0.5
    assert toxicity.keep_clean(frame(spark, [(1, None), (3, "he is an idiot and a clown")]), machine).count() == 1
    assert toxicity.score_texts(toxicity.train([], []), pa.array(["x", None])).tolist() == [0.0, 0.0]
    assert toxicity.score_texts(toxicity.train(["a", "b"], [1, 1]), pa.array(["x"])).tolist() == [1.0]


def test_scores_do_not_depend_on_neighbours():
    machine = toxicity.train(["the plain words go here"] * 20 + ["what an idiot he is"] * 20, [0] * 20 + [1] * 20)
    texts = ["an idiot", "plain", "", "x" * 50, "such an idi", "ot then"]
    alone = [float(toxicity.score_texts(machine, pa.array([t]))[0]) for t in texts]
    assert toxicity.score_texts(machine, pa.array(texts)).tolist() == pytest.approx(alone)


def test_machine_identity():
    """Linear-time interactions equal the sum over all pairs."""
    rng = np.random.default_rng(3)
    column = pa.array(["some words, some words", "", "OTHER!! $$$ words\nlines"])
    m = quality.Machine(0.3, rng.normal(size=quality.N_FEATURES), rng.normal(size=(quality.N_FEATURES, quality.RANK)))
    for _, borders, feature, value in quality.featurise(column, np.full(3, np.nan)):
        got = quality.raw_scores(m, borders, feature, value)
        for i in range(3):
            f, v = feature[borders[i] : borders[i + 1]], value[borders[i] : borders[i + 1]]
            pairs = sum(m.factors[f[a]] @ m.factors[f[b]] * v[a] * v[b] for a in range(len(f)) for b in range(a + 1, len(f)))
            assert got[i] == pytest.approx(0.3 + (m.linear[f] * v).sum() + pairs)


def test_quality_odd_rows(spark):
    texts = [f"Some calm sentence number {i}. And one more of them." for i in range(40)] + ["BUY!! NOW!! $$$ $$$"] * 40
    machine = quality.train(pa.array(texts), np.full(80, np.nan), [1] * 40 + [0] * 40)
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "x"), (3, "A calm sentence. And more of them.", 34, "x"), (4, "BUY!! $$$", 9, "x"), (5, LONG, None, "x")], "doc_id long, text string, n_chars long, score string")
    got = {r.doc_id: r.score for r in quality.score_documents(rows, machine).collect()}
    assert got[3] > 0.5 > got[4] and got[1] == got[2] and 0 <= got[5] <= 1


def test_labelled_sample(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)] + [(3, "twin"), (60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(4, 0), (60, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", F.col("doc_id") != 5, 10, 10_000).collect()
    assert 20 <= len(got) <= 21 and sum(r.y for r in got) >= 10 and 5 not in {r.doc_id for r in got}
    got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 100).collect()
    assert 0 < sum(len(r.text) for r in got) <= 100
    none = toxicity.labelled_sample(docs.limit(0), labels, "toxic", F.lit(True), 10, 10)
    assert none.count() == 0 and toxicity.train_in_task(none, toxicity.train).constant == 0.0


def test_vocabulary_table():
    content, _ = vocabulary()
    ranks = byte_bpe.read_ranks(content)
    assert all(base64.b64encode(bytes([b])) in content for b in range(3)) and len(ranks) == 50_256
