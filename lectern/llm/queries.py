"""The queries of this subpackage: one function per operator, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, pii, quality, topk_search, toxicity, training_order, warc_fixity
from .decontaminate import contamination_digest, find_contamination
from .jaccard_join import jaccard_components
from .workspace import Workspace

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The free id after the vocabulary.
END_OF_TEXT = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Content and split pattern of a rank file; it is read on the driver and sent along."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels outside the held-out fifth."""
    docs, fold = _table(spark, sf_dir, "documents"), toxicity.fold_of(F.col("doc_id"), 5)
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold != 0)
    return _judged(toxicity.score_documents(docs, machine), fold == 0)


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in permuted fixed-stride shards; one row a sequence."""
    work = Workspace(spark, "op2")
    content, pattern = vocabulary()
    return training_order.materialise(_table(spark, sf_dir, "documents"), work, f"{work.path}/shards", content, pattern, END_OF_TEXT, b"epoch-0")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), Workspace(spark, "op4"), 3, 90)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(_table(spark, sf_dir, "documents"), *vocabulary())


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from labels outside the held-out third."""
    docs, fold = _table(spark, sf_dir, "documents"), toxicity.fold_of(F.col("doc_id"), 3)
    machine = quality.fit(docs, _table(spark, sf_dir, "labels"), fold != 1)
    return _judged(quality.score_documents(docs, machine), fold == 1)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with every 97th page overwritten in place, the next one longer, the next one lost."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = F.col("page_id") % 97
    rotten = F.when(kind == 0, F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))).when(kind == 1, F.concat("html", F.lit("~"))).otherwise(F.col("html"))
    replica = pages.where((kind != 2) | kind.isNull()).withColumn("html", rotten)
    return warc_fixity.audit(warc_fixity.lay_out(pages), warc_fixity.lay_out(replica), Workspace(spark, "op8"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Workspace(spark, "op9")))


PROBE_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts hold the template's control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    events = chat_format.turns_as_events(turns.unionByName(probe))
    return chat_format.format_digest(chat_format.read_back(chat_format.render(chat_format.fold_events(events))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_training_order": op2_training_order,
    "op3_pii": op3_pii,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_topk_search": op6_topk_search,
    "op7_quality": op7_quality,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             q AS (SELECT vec_id, min(c) AS c FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
             s AS (SELECT q.vec_id AS query_id, v.vec_id,
                          CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM q, v WHERE q.vec_id <> v.vec_id AND len(q.c) = len(v.c)),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE
             d AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM d),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
             c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
    """.replace("LOWERED", _LOWER.format("coalesce(text, '')")),
    "op8_warc_fixity": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a,
                          coalesce(CASE page_id % 97 WHEN 0 THEN '~' || substr(html, 2) WHEN 1 THEN html || '~' ELSE html END, '') AS b FROM pages),
             h AS (SELECT *, 'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:' || sha256(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || url)
                            || '>\r\nWARC-Target-URI: ' || url || '\r\nContent-Type: text/html\r\nContent-Length: ' AS head FROM p),
             r AS (SELECT page_id, url, head || strlen(a) || '\r\n\r\n' || a || '\r\n\r\n' AS x, head || strlen(b) || '\r\n\r\n' || b || '\r\n\r\n' AS y FROM h),
             d AS (SELECT CAST(floor(page_id / 1024) AS BIGINT) AS archive, page_id, url, CAST(strlen(x) AS BIGINT) AS length, sha256(x) AS digest,
                          CASE WHEN page_id % 97 = 2 THEN 'missing' WHEN x <> y THEN 'corrupt' ELSE 'ok' END AS state FROM r)
        SELECT archive, CAST(row_number() OVER w - 1 AS BIGINT) AS place, page_id,
               CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, digest, state
        FROM d WINDOW w AS (PARTITION BY archive ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """.replace("\r\n", "' || chr(13) || chr(10) || '"),
    "op9_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_ALNUM_WORDS.format("text")} AS w FROM documents),
             b AS (SELECT item_id, {_ALNUM_WORDS.format("text")} AS w FROM benchmark),
             bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
                    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT n FROM bw),
             dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
             h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, t)),
             words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
             items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
                       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT CAST(-7 AS BIGINT), 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT CAST(-7 AS BIGINT), 1, 'assistant', '\### Assistant: </turn> ok'),
             e AS (SELECT *, len(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) AS body,
                          len(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) AS name FROM t)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(4 + name + 2 + body + 8) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
