"""The operators applied to their whole tables with production parameters, and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm import (
    alignment,
    bitpack,
    bpe,
    embdedup,
    lexical,
    lm,
    merkle,
    packing,
    pii,
    quality,
    simhash,
    topk,
    warc,
)
from starscan.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The file of a public vocabulary, in the folder that TOKENIZERS_DIR names if it is set."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that links of at most 4 bits make."""
    return fingerprint_groups(spark, _table(spark, sf_dir, "documents"))


def fingerprint_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(spark, docs, bits=4, words_per_shingle=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of six sevenths of them."""
    return lm.score_texts(spark, _table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector among all vectors."""
    return nearest(spark, _table(spark, sf_dir, "embeddings"))


def nearest(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    vectors = topk.integer_vectors(embeddings, "vec_id", "embedding", 256)
    return topk.top_k(spark, vectors.where("id % 50 = 0"), vectors, k=5)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by merge replay and decoded again."""
    return encode_and_decode(_table(spark, sf_dir, "documents"))


def encode_and_decode(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    return bpe.decode_documents(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of all documents, and whether they are selected."""
    return quality_grades(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def quality_grades(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = quality.fit_on(spark, docs, labels)
    return quality.with_grades(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.col("__expected").alias("expected_grade"),
        F.col("__top").alias("top_probability"),
        (F.col("__top") >= quality.LEAST).alias("kept"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces packed into sequences of at most 1024 ids."""
    return packing.pack_documents(
        spark,
        _table(spark, sf_dir, "documents"),
        vocabulary("byte_bpe_50k.json"),
        end_id=2,
        memory=700_000,
    )


def op7_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as bit-packed ids, and what the files say when they are read back."""
    return bitpack_round_trip(spark, _table(spark, sf_dir, "documents"))


def bitpack_round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_path(spark, "ids")
    bitpack.write_ids(docs, path, vocabulary("word_bpe_49k.json"), vocabulary_size=49_408, end_id=1)
    return bitpack.read_documents(spark, path, with_ids=False)


def op8_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.9 or more."""
    return embdedup.near_copies(spark, _table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(_table(spark, sf_dir, "documents"))


def personal_data(docs: DataFrame) -> DataFrame:
    def text(spans: Column) -> Column:
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    found = pii.find(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, and what the archives say when they are read back."""
    return warc_round_trip(spark, _table(spark, sf_dir, "pages"))


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    rows = pages.select(
        F.col("page_id").alias("id"),
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.with_revisits(rows, spark), path)
    return warc.read_archive(spark, path).select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        # a revisit has no payload of its own; that of a response is what was read, never what it declares
        F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.col("found_digest")).alias(
            "payload_digest"
        ),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return lexical.rank_documents(
        spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens of two vocabularies, and which cover which."""
    return alignment.align_documents(
        spark,
        _table(spark, sf_dir, "documents"),
        vocabulary("byte_bpe_50k.json"),
        vocabulary("piece_bpe_32k.model"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return merkle.fingerprint_documents(spark, _table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm": op2_lm,
    "op3_topk": op3_topk,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_bitpack": op7_bitpack,
    "op8_embdedup": op8_embdedup,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_lexical": op11_lexical,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

_NODES = """list_aggregate(list_transform(string_split({text}, chr(10) || chr(10)),
  lambda s: sha256(list_aggregate(list_transform(string_split(s, chr(10)), lambda p: sha256(p)),
                                  'string_agg', ''))), 'string_agg', '')"""
_LEAVES = """list_distinct(regexp_extract_all({text}, '(?:[^ \\n]*[^ \\n.!?] ){{0,7}}[^ \\n]+'))"""
_LIKENESS = """CASE WHEN {a} = {b} THEN 1.0::DOUBLE
  WHEN len({x}) + len({y}) = len(list_intersect({x}, {y})) THEN 0.0::DOUBLE
  ELSE len(list_intersect({x}, {y}))
    / (len({x}) + len({y}) - len(list_intersect({x}, {y})))::DOUBLE END"""

ORACLES = {
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([q.vec[i] * c.vec[i] FOR i IN range(1, len(c.vec) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, vec_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_embdedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS vec
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.vec, b.vec) >= 0.9
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
        ), root AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
        )
        SELECT root.vec_id, coalesce(n_links, 0) AS n_links, component_id,
               root.vec_id = component_id AS kept
        FROM root LEFT JOIN n USING (vec_id)
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
                   max(page_id) OVER (PARTITION BY payload) AS keeper
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND keeper <> page_id
                    THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
        FROM d
    """,
    "op11_lexical": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ), asked AS (
            SELECT item_id, t, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
                FROM benchmark) GROUP BY ALL
        ), total AS (
            SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM words WHERE len(ts) > 0
        ), lengths AS (
            SELECT doc_id, 100 - 25 + (25 * len(ts)::BIGINT * n_docs) // n_terms AS m
            FROM words, total WHERE len(ts) > 0
        ), tf AS (
            SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM words)
            GROUP BY ALL
        ), weight AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total
        ), score AS (
            SELECT item_id, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN lengths USING (doc_id)
            GROUP BY ALL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM score WHERE score > 0
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_merkle": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents
        ), o AS (
            SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next
            FROM d WINDOW w AS (ORDER BY doc_id DESC)
        ), e AS (
            SELECT *, substr(text, 1, length(text) - length(text) // 2)
                      || substr(next, 1, length(text) // 2) AS edited
            FROM o
        ), f AS (
            SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
                   sha256({_NODES.format(text="text")}) AS fingerprint,
                   sha256({_NODES.format(text="edited")}) AS edited_fingerprint,
                   sha256({_NODES.format(text="next")}) AS next_fingerprint,
                   {_LEAVES.format(text="text")} AS x,
                   {_LEAVES.format(text="edited")} AS y,
                   {_LEAVES.format(text="next")} AS z
            FROM e
        )
        SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
               {_LIKENESS.format(a="fingerprint", b="edited_fingerprint", x="x", y="y")} AS near_edited,
               {_LIKENESS.format(a="fingerprint", b="next_fingerprint", x="x", y="z")} AS near_next
        FROM f
    """,
}
