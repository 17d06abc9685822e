"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame expressions only.

A text is cut at blank lines into sections, a section at line breaks into paragraphs; joined again they
are the text. A paragraph's node is the SHA-256 of its text, a section's node that of its paragraphs'
nodes, the root that of the sections' nodes. So equal roots mean equal texts, and where two roots
differ, the sections and paragraphs with unequal nodes hold the edits (``locate_edits``).

Below a paragraph lie its leaves: stretches of at most ``LEAF_WORDS`` words that end where a sentence
ends, each as a 64-bit hash. The likeness of two fingerprints is the share of their different leaves that
both have; 1 for equal roots.

Every document meets its successor without a window over the whole table: quantiles of doc_id deal the
rows into buckets of about ``BUCKET_BYTES`` (any split points give the same result), each bucket is a
window of its own, and only the first and last rows of the buckets are matched across them. The text is
shuffled once.

Defined results. Null text: empty. Empty text: one section with one empty paragraph, no leaf. Very long
texts: as any. Null doc_id: after all others. Rows that repeat a doc_id: ordered by their text, so that
equal rows follow each other. A single row is its own successor. Empty table: no row. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starscan.llm.common import stage

SECTION_BREAK = "\n\n"
PARAGRAPH_BREAK = "\n"
LEAF_WORDS = 8
#: A leaf: words of which only the last may end a sentence.
LEAF = r"(?:[^ \n]*[^ \n.!?] ){0,%d}[^ \n]+" % (LEAF_WORDS - 1)
#: Bytes of text in a bucket of neighbours; above so many buckets they grow instead.
BUCKET_BYTES = 2 << 20
MAX_BUCKETS = 1 << 18
#: Buckets that a task takes, several, so that tasks differ less in size.
TASK_BUCKETS = 8


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def sections(text: Column) -> Column:
    """array<struct<node, paragraphs>>: the levels of the tree between the root and the leaves."""
    nodes = F.transform(
        F.split(text, SECTION_BREAK), lambda s: F.transform(F.split(s, PARAGRAPH_BREAK), _digest)
    )
    return F.transform(
        nodes, lambda p: F.struct(_digest(F.array_join(p, "")).alias("node"), p.alias("paragraphs"))
    )


def root(text: Column) -> Column:
    """The fingerprint: 64 hex digits, equal for equal texts only."""
    return _digest(F.array_join(F.transform(sections(text), lambda s: s["node"]), ""))


def leaves(text: Column) -> Column:
    """array<long>: the different leaves."""
    found = F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))
    return F.array_distinct(F.transform(found, lambda leaf: F.xxhash64(leaf)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """Between 0 and 1."""
    both = F.size(F.array_intersect(leaves_a, leaves_b))
    either = F.size(leaves_a) + F.size(leaves_b) - both
    return F.when(root_a == root_b, 1.0).when(either == 0, 0.0).otherwise(both / either)


def locate_edits(pairs: DataFrame) -> DataFrame:
    """Rows (id, section, paragraph): places (from 0) in ``after`` whose paragraphs ``before`` lacks.

    ``pairs`` has a unique ``id`` and two texts, ``before`` and ``after``. Sections that both trees have
    are not descended into.
    """
    trees = pairs.select(
        "id", *[sections(F.coalesce(side, F.lit(""))).alias(side) for side in ("before", "after")]
    ).where(F.transform("before", lambda s: s["node"]) != F.transform("after", lambda s: s["node"]))
    branches = trees.select("id", F.posexplode("after").alias("section", "branch")).select(
        "id", "section", F.col("branch.node").alias("node"), F.col("branch.paragraphs").alias("paragraphs")
    )
    known = trees.select("id", F.explode("before").alias("branch")).select("id", "branch.*")
    open_branches = branches.join(known.select("id", "node"), ["id", "node"], "left_anti")
    leaves_there = known.select("id", F.explode("paragraphs").alias("node"))
    return (
        open_branches.select("id", "section", F.posexplode("paragraphs").alias("paragraph", "node"))
        .join(leaves_there, ["id", "node"], "left_anti")
        .select("id", "section", "paragraph")
    )


def edited(text: Column, follower: Column) -> Column:
    """The last half of the code points replaced by the first as many of the follower."""
    half = F.floor(F.length(text) / 2).cast("int")
    kept = F.substring(text, F.lit(1), F.length(text) - half)
    return F.concat(kept, F.substring(follower, F.lit(1), half))


def bucket_of(rows: DataFrame, least: int = 1) -> tuple[Column, int]:
    """The bucket of each row (doc_id, text, fingerprint), and how many there are, about ``least`` or more.

    Buckets follow each other in the order of descending doc_id, null last, then fingerprint: quantiles
    of doc_id, measured in one pass, cut the ids, and an id that spans several quantiles, or null, is cut
    by its fingerprints, which are evenly spread. A row is compared with some ``2 * sqrt(buckets)`` ids.
    """
    n, known, size = rows.agg(
        F.count("*"), F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    ).first()
    wanted = min(MAX_BUCKETS, max(least, -(-size // BUCKET_BYTES)))
    shares = [i / wanted for i in range(wanted - 1, 0, -1)]
    bounds = []
    if shares and known:
        quantiles = F.percentile_approx("doc_id", shares, max(10_000, 4 * wanted))
        bounds = rows.agg(quantiles).first()[0]
    for_null = -(-wanted * (n - known) // max(n, 1))
    place = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("double") / 2.0**32
    null_bucket = F.lit(len(bounds) + 1) + F.floor(place * for_null).cast("int")
    if not bounds:
        return F.when(F.col("doc_id").isNull(), null_bucket).otherwise(0), 1 + for_null
    width = max(1, int(len(bounds) ** 0.5))

    def array(values: list[int]) -> Column:
        # one constant, however many values there are
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def above(ids: Column) -> Column:
        return F.size(F.filter(ids, lambda b: b > F.col("doc_id")))

    group = above(array(bounds[::width])) - 1
    part = F.slice(array(bounds), F.greatest(group, F.lit(0)) * width + 1, width)
    before = F.when(group < 0, 0).otherwise(group * width + above(part))
    # rows of an id that is several bounds
    repeats = {b: r for b in set(bounds) if (r := bounds.count(b)) > 1} if len(set(bounds)) < len(bounds) else {}
    spread = F.lit(0)
    for bound, times in repeats.items():
        spread = F.when(F.col("doc_id") == bound, F.floor(place * times).cast("int")).otherwise(spread)
    return (
        F.when(F.col("doc_id").isNull(), null_bucket).otherwise(before + spread),
        len(bounds) + 1 + for_null,
    )


def compared(rows: DataFrame) -> DataFrame:
    """Rows with the results that need the successor's ``next`` (fingerprint, text, leaves)."""
    return (
        rows.withColumn("edited", edited(F.col("text"), F.col("next.text")))
        .withColumn("edited_fingerprint", root(F.col("edited")))
        .select(
            "*",
            F.sha2("edited", 256).alias("edited_sha256"),
            likeness(
                F.col("fingerprint"), F.col("leaves"), F.col("edited_fingerprint"), leaves(F.col("edited"))
            ).alias("near_edited"),
            likeness(
                F.col("fingerprint"), F.col("leaves"), F.col("next.fingerprint"), F.col("next.leaves")
            ).alias("near_next"),
        )
        .drop("edited")
    )


RESULT = [
    "doc_id",
    "n_chars",
    "edited_sha256",
    "fingerprint",
    "edited_fingerprint",
    "near_edited",
    "near_next",
]


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, fingerprint, leaves)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.select("*", root(F.col("text")).alias("fingerprint"), leaves(F.col("text")).alias("leaves"))


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts: rows of the columns ``RESULT``.

    In an edited text the last half of the code points is replaced by the first as many (or all) of the
    successor, the document with the next smaller doc_id; after the last one comes the first.
    """
    rows = with_fingerprints(docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket, buckets = bucket_of(rows, least=tasks * TASK_BUCKETS)
    order = [F.desc_nulls_last("doc_id"), F.asc("fingerprint")]
    window = Window.partitionBy("bucket").orderBy(*order)
    follower = F.struct("fingerprint", "text", "leaves")
    neighbours = (
        rows.withColumn("bucket", bucket)
        .repartition(-(-buckets // TASK_BUCKETS), "bucket")
        .withColumns(
            {"next": F.lead(follower).over(window), "is_first": F.row_number().over(window) == 1}
        )
        .withColumn("is_last", F.col("next").isNull())
        .withColumn("n_chars", F.length("text").cast("long"))
    )
    at_edge = F.col("is_first") | F.col("is_last")
    done = stage(
        spark,
        compared(neighbours).select(
            "bucket",
            "is_first",
            "is_last",
            *RESULT,
            F.when(at_edge, F.struct("fingerprint", "text", "leaves")).alias("edge"),
        ),
        "neighbours",
    )
    # two rows of a bucket; its number alone is ordered over all buckets
    firsts = done.where("is_first").select("bucket", "edge")
    lasts = done.where("is_last").select("bucket", "doc_id", "n_chars", "edge.*")
    in_order = Window.orderBy("bucket")
    smallest = firsts.agg(F.min("bucket")).first()[0]
    followed = firsts.select("bucket", F.lead("bucket", 1, smallest).over(in_order).alias("next_bucket"))
    joined = lasts.join(followed, "bucket").join(
        firsts.select(F.col("bucket").alias("next_bucket"), F.col("edge").alias("next")), "next_bucket"
    )
    return done.where("not is_last").select(*RESULT).unionByName(compared(joined).select(*RESULT))
