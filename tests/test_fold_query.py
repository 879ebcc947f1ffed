"""The fold over whole tables: every transcript of every book has a row."""

import pyarrow as pa
import pyarrow.parquet as pq

from lectern.plans import match_queries as M


def test_rejected_and_short_pages_have_rows(spark, tmp_path):
    long_page = " ".join(f"word{i:04d}" for i in range(300))
    short_page = "part one of the old sea"  # one long token, so its overlap is far below the floor
    docs = [(1, "a", long_page), (2, "a", short_page), (3, "b", long_page)]
    items = [(1, short_page + " " + " ".join(f"other{i}" for i in range(50))), (2, "too few"), (3, "a b c d e f"), (4, "none of these words anywhere"), (5, " ".join(long_page.split()[:100])), (6, "word0001 " + " ".join(f"else{i}" for i in range(50)))]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "source": [d[1] for d in docs], "text": [d[2] for d in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    got = {(r.book, r.chunk): (r.reason, r.html_order) for r in M.ordered_match_fold(spark, str(tmp_path)).collect()}
    rest = {2: ("short", None), 3: ("no probe", None), 4: ("no overlap", None), 6: ("below threshold", None)}
    want = {("a", 1): ("short page", 2), ("a", 5): ("ok", 1), ("b", 1): ("no overlap", None), ("b", 5): ("ok", 3)}
    assert got == want | {(b, c): r for b in "ab" for c, r in rest.items()}
