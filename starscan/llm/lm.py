"""Log-bilinear language model, trained by noise-contrastive estimation, scoring whole texts.

Classes: the end of a text, the most frequent words, and for all other words a bucket by their
last letters. Words with a class, and so vectors, of their own are as many as the square root of the
training tokens, so they grow with the corpus while all pairs of classes grow no faster than it. The
model scores the next class by ``(r_h * c) . q_w + b_w`` with one context class h. Spark counts the
class bigrams of the whole training corpus, and every one of them is trained on, with its count, against
all classes as noise in proportion to theirs: nothing is drawn. With the classes' vectors given each context
is a regression of its own, and the other way round; so tasks improve all contexts, then all classes, a
block at a time, in turn. A step is a gradient in units of the curvature that all share, of limited length.
The sums that normalise the probabilities are computed by tasks, a block of contexts each.
A word inside a bucket has the share ``(count + 1) / (N_b + V_b + 1)``, an unseen word the share of a
count of zero, so that the probabilities of all texts sum to one with the unseen words as one.

Word counts are exact over the whole corpus. The most frequent words, a bounded number of bounded
length, are sent to all tasks; the others meet their counts in a join.

Defined results. Null or wordless text: only the end token. Very long texts: scored whole. Null doc_id:
in training, not held out. Repeated rows: a score each, and counted each. Empty table: no row. Without
training texts all classes are equally likely. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.llm.common import lookup, stage, text_chunks

#: Words that are sent to all tasks: as many, of at most as many characters.
FREQUENT_WORDS = 1 << 16
FREQUENT_CHARS = 64
#: Buckets of the words without a class of their own, by their last letters.
BUCKETS = 256
SUFFIX = 3
#: Fewest words with a class of their own, if there are as many.
LEAST_OWN = 768
#: Bigrams that ``class_bigrams`` shows on the driver: some at any size, and more for each class.
SAMPLE, SAMPLE_PER_CLASS = 1_000_000, 64
#: Training: width of the vectors, noise per bigram, turns of contexts and classes, steps in each.
WIDTH = 32
NOISE = 10.0
ROUNDS, STEPS = 6, 5
#: Part of a step that is taken, its greatest length, and bigrams that speak for the start of a vector.
DAMPING, LONGEST, PRIOR = 0.5, 0.5, 10.0
#: Contexts or classes whose bigrams make a row of work.
BLOCK = 64
#: Contexts that make a row of work, scores that are held at once, and tokens that are scored at once.
CONTEXTS = 256
CELLS = 1 << 20
TOKENS = 1 << 11
#: Tokens whose bigrams a task holds before it counts them.
HELD_TOKENS = 1 << 21


@dataclass
class Words:
    """The words of some texts: ``which[i]`` numbers the i-th word among ``distinct``."""

    distinct: pa.Array
    which: np.ndarray
    per_text: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """Words between ASCII white space, A-Z lower-cased; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(full))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(
        coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(before[ends])
    )


def bucket_of(word: str, buckets: int) -> int:
    return 1 + zlib.crc32(word[-SUFFIX:].encode()) % buckets


def bucket_column(word: str, buckets: int):
    """``bucket_of`` as a Spark expression."""
    return (F.crc32(F.substring(word, -SUFFIX, SUFFIX).cast("binary")) % buckets + 1).cast("int")


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) over the column ``text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words = split_words(chunk.column("text"))
            n = np.bincount(words.which, minlength=len(words.distinct))
            yield pa.RecordBatch.from_arrays([words.distinct, pa.array(n)], ["word", "n"])

    found = texts.select("text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon:
    """The frequent words with their counts, and the class of any word."""

    def __init__(self, words: list[str], counts: list[int], classes: int, buckets: int):
        self.words = pa.array(words, pa.string())
        self.logs = np.log10(np.array(counts, np.float64) + 1)
        self.classes, self.buckets = classes, buckets
        self.own_class = max(0, classes - 1 - buckets)

    def place(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its number among the frequent ones or -1, and its class."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        classes = at + 1 + self.buckets
        rest = np.flatnonzero((at < 0) | (at >= self.own_class))
        # far fewer endings than words
        endings = pc.utf8_slice_codeunits(distinct.take(pa.array(rest)), -SUFFIX).dictionary_encode()
        found = np.array([bucket_of(t, self.buckets) for t in endings.dictionary.to_pylist()], np.int64)
        classes[rest] = found[endings.indices.to_numpy(zero_copy_only=False)]
        return at, classes


def _sequence(words: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens with an end (0) behind each text, of the tokens before, and the texts' starts."""
    lengths = words.per_text + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.zeros(int(lengths.sum()), np.int64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = classes[words.which]
    # before a text's first token stands the end of the one before, or nothing: class 0 as well
    return tokens, np.append(0, tokens)[:-1], ends + 1 - lengths


@dataclass
class Bigrams:
    """Class bigrams (``context * classes + class``) with weights in proportion to their counts, and
    how often each class occurs."""

    pairs: np.ndarray
    weights: np.ndarray
    unigrams: np.ndarray


def count_pairs(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches (pair, n), each over as many of the arrays as make ``HELD_TOKENS`` pairs."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["pair", "n"])

    for some in pairs:
        held.append(some)
        size += len(some)
        if size >= HELD_TOKENS:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def bigram_counts(spark: SparkSession, texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (pair, n): how often which class follows which over the whole column ``text``."""
    n = lexicon.classes

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for chunk in text_chunks(batches):
            words = split_words(chunk.column("text"))
            tokens, before, _ = _sequence(words, lexicon.place(words.distinct)[1])
            yield before * n + tokens

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_pairs(pairs_of(batches))

    found = texts.select("text").mapInArrow(counted, "pair long, n long").groupBy("pair")
    return stage(spark, found.agg(F.sum("n").alias("n")), "bigrams")


def class_bigrams(spark: SparkSession, texts: DataFrame, lexicon: Lexicon, unigrams: np.ndarray) -> Bigrams:
    """A threshold sample of the bigrams for a look on the driver; ``train_all`` does not use it."""
    table = bigram_counts(spark, texts, lexicon)
    share = (table.agg(F.sum("n")).first()[0] or 0) / (SAMPLE + SAMPLE_PER_CLASS * lexicon.classes)
    chance = F.pmod(F.xxhash64("pair"), F.lit(1 << 31)) / float(1 << 31)
    # about SAMPLE + SAMPLE_PER_CLASS * classes rows
    rows = table.where(chance * share < F.col("n")).select("pair", F.greatest("n", F.lit(share)).alias("n"))
    rows = rows.orderBy("pair").toArrow()
    return Bigrams(rows.column("pair").to_numpy(), rows.column("n").to_numpy(), unigrams)


@dataclass
class Model:
    context: np.ndarray
    scale: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def scores(self, contexts: np.ndarray) -> np.ndarray:
        """Contexts x classes, by one matrix product."""
        return (self.context[contexts] * self.scale) @ self.target.T + self.bias

    def log_sums(self, contexts: np.ndarray) -> np.ndarray:
        """What to subtract from the scores of each context to normalise them."""
        out = np.empty(len(contexts))
        at_once = max(1, CELLS // len(self.bias))
        for at in range(0, len(contexts), at_once):
            scores = self.scores(contexts[at : at + at_once])
            top = scores.max(axis=1)
            out[at : at + at_once] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised natural logarithms, contexts x classes."""
        return self.scores(contexts) - self.log_sums(contexts)[:, None]


@dataclass
class Turn:
    """One side of the model, ``own``, to be improved while the other, ``fixed``, stays.

    A score less its logarithm of the noise is ``own . fixed + own_shift + fixed_shift``; the noise of a
    pair counts ``own_share * fixed_share`` times, the bigrams of a row of ``own`` together ``mass`` times.
    """

    own: np.ndarray
    fixed: np.ndarray
    own_shift: np.ndarray
    fixed_shift: np.ndarray
    own_share: np.ndarray
    fixed_share: np.ndarray
    mass: np.ndarray
    start: np.ndarray

    def __post_init__(self):
        weighted = self.fixed * (self.fixed_share / self.fixed_share.sum())[:, None]
        curve = weighted.T @ self.fixed * (NOISE / (NOISE + 1))
        self.curve = curve + np.eye(len(curve)) * (1e-4 * np.trace(curve) / len(curve) + 1e-12)
        self.inverse = np.linalg.inv(self.curve)

    def improved(self, owners: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """New vectors of some rows; ``times[k]`` bigrams lie at the place ``at[k]``, ascending, of the
        scores owners x fixed."""
        n = len(self.fixed)
        out = self.own[owners]
        at_once = max(1, CELLS // n)
        for first in range(0, len(owners), at_once):
            rows = owners[first : first + at_once]
            low, high = np.searchsorted(at, [first * n, (first + len(rows)) * n])
            here, counts = at[low:high] - first * n, times[low:high]
            shift, share = self.own_shift[rows, None], self.own_share[rows, None]
            weight, start, x = self.mass[rows, None] + PRIOR, self.start[rows], out[first : first + at_once]
            for _ in range(STEPS):
                slopes = x @ self.fixed.T
                slopes += self.fixed_shift
                slopes += shift
                slopes = _logistic(slopes)
                real = counts * (slopes.reshape(-1)[here] - 1)
                slopes *= self.fixed_share
                slopes *= share
                slopes.reshape(-1)[here] += real
                step = (slopes @ self.fixed @ self.inverse + PRIOR * (x - start)) / weight
                length = np.sqrt(((step @ self.curve) * step).sum(1, keepdims=True))
                x = x - step * np.minimum(DAMPING, LONGEST / np.maximum(length, 1e-12))
            out[first : first + at_once] = x
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _take_turns(unigrams: np.ndarray, contexts: np.ndarray, improve) -> Model:
    """Noise-contrastive estimation. ``improve(side, turn)`` gives the new vectors of all contexts (side 0)
    or classes (side 1), of which there are ``contexts`` and ``unigrams`` in the bigrams."""
    n, total = len(unigrams), contexts.sum()
    noise = unigrams + 0.1
    noise = noise / noise.sum()
    shift, none = -np.log(NOISE * noise), np.zeros(n)
    context, scale = np.zeros((n, WIDTH)), np.ones(WIDTH)
    # a class is its vector and its bias, which meets a one
    first = np.column_stack([np.zeros((n, WIDTH)), np.log(noise)])
    classes = first.copy()
    if total:
        classes[:, :-1] = np.random.default_rng(7).normal(0, 0.3, (n, WIDTH))
        for _ in range(ROUNDS):
            target, bias = classes[:, :-1], classes[:, -1]
            context = improve(
                0, Turn(context, target, none, bias + shift, contexts, NOISE * noise, contexts, np.zeros((n, WIDTH)))
            )
            ones = np.column_stack([context, np.ones(n)])
            classes = improve(1, Turn(classes, ones, shift, none, NOISE * noise, contexts, noise * total, first))
        scale = np.sqrt((context**2 * (contexts / total)[:, None]).sum(0))
        scale = np.where(scale > 0, scale, 1.0)
    return Model(context / scale, scale, classes[:, :-1].copy(), classes[:, -1].copy())


def train(bigrams: Bigrams) -> Model:
    """The model of bigrams that are held here."""
    n = len(bigrams.unigrams)
    blocks = -(-n // BLOCK)
    sides = np.divmod(bigrams.pairs, n)
    dealt = []
    for own, other in (sides, sides[::-1]):
        at = own // blocks * n + other
        order = np.lexsort((at, own % blocks))
        ends = np.searchsorted(own[order] % blocks, np.arange(blocks + 1))
        dealt.append([(at[o], bigrams.weights[o]) for o in (order[a:b] for a, b in zip(ends, ends[1:]))])

    def improve(side: int, turn: Turn) -> np.ndarray:
        out = turn.own.copy()
        for block, (at, times) in enumerate(dealt[side]):
            owners = np.arange(block, n, blocks)
            out[owners] = turn.improved(owners, at, times)
        return out

    return _take_turns(bigrams.unigrams, np.bincount(sides[0], bigrams.weights, n), improve)


def train_all(spark: SparkSession, bigrams: DataFrame, unigrams: np.ndarray) -> Model:
    """The model of all rows (pair, n) of a staged table; equal to that of ``train``.

    The bigrams are dealt to blocks of contexts once, to blocks of classes once; then only vectors move.
    """
    n = len(unigrams)
    blocks = -(-n // BLOCK)

    def packed(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[:1]
        rows = rows.filter(pc.is_valid(rows.column("at"))).sort_by("at")
        at, times = (rows.column(c).to_numpy().astype(t) for c, t in (("at", "<i4"), ("n", "<i8")))
        return pa.table({"block": block, "at": [at.tobytes()], "times": [times.tobytes()]})

    # a block without bigrams has its row as well
    each = spark.range(blocks).selectExpr("id AS block", "CAST(NULL AS bigint) AS at", "CAST(NULL AS bigint) AS n")
    halves = bigrams.selectExpr(f"pair div {n} AS h", f"pair % {n} AS w", "n")
    dealt = []
    for own, other in ("hw", "wh"):
        rows = halves.selectExpr(f"{own} % {blocks} AS block", f"{own} div {blocks} * {n} + {other} AS at", "n")
        rows = rows.unionByName(each).repartition(min(blocks, 1000), "block").groupBy("block")
        dealt.append(stage(spark, rows.applyInArrow(packed, "block long, at binary, times binary"), "dealt"))

    def improve(side: int, turn: Turn) -> np.ndarray:
        sent = spark.sparkContext.broadcast(turn)

        def improved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, at, times in zip(*batch.columns):
                    owners = np.arange(block.as_py(), n, blocks)
                    places = np.frombuffer(at.as_buffer(), "<i4").astype(np.int64)
                    found = sent.value.improved(owners, places, np.frombuffer(times.as_buffer(), "<i8").astype(float))
                    columns = [pa.array(owners), pa.array(list(found), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["owner", "vector"])

        rows = dealt[side].mapInArrow(improved, "owner long, vector array<double>").toArrow()
        sent.destroy()
        out = np.empty_like(turn.own)
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy()
        out[rows.column("owner").to_numpy()] = vectors.reshape(-1, out.shape[1])
        return out

    return _take_turns(unigrams, unigrams, improve)


def log_sums(spark: SparkSession, model) -> np.ndarray:
    """``Model.log_sums`` of all contexts of the broadcast ``model``, a block of contexts at a time."""
    n = len(model.value.bias)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("id").to_pylist():
                contexts = np.arange(start, min(n, start + CONTEXTS))
                columns = [pa.array(contexts), pa.array(model.value.log_sums(contexts))]
                yield pa.RecordBatch.from_arrays(columns, ["context", "value"])

    starts = spark.range(0, n, CONTEXTS)
    rows = starts.mapInArrow(summed, "context long, value double").toArrow()
    sums = np.zeros(n)
    sums[rows.column("context").to_numpy()] = rows.column("value").to_numpy()
    return sums


def pair_logs(model: Model, sums: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The natural logarithm of the probability of each token behind the one before."""
    out = np.empty(len(tokens))
    scaled = model.context * model.scale
    for at in range(0, len(tokens), TOKENS):
        h, w = before[at : at + TOKENS], tokens[at : at + TOKENS]
        out[at : at + TOKENS] = np.einsum("ij,ij->i", scaled[h], model.target[w]) + model.bias[w] - sums[h]
    return out


SCORED_DDL = (
    "doc_id long, held_out boolean, n_tokens long, known long, base double, score double,"
    " rare array<struct<word: string, n: long>>"
)


def score_texts(
    spark: SparkSession,
    docs: DataFrame,
    held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2",
    frequent_words: int = FREQUENT_WORDS,
    own_words: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per document.

    The model learns from the documents for which the SQL condition ``held_out`` does not hold.
    ``own_words`` sets how many words have a class of their own, else their number follows the corpus.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"),
    )
    training = texts.where("not held_out")
    counts = stage(spark, word_counts(training).withColumn("bucket", bucket_column("word", buckets)), "counts")
    ends = training.count()
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).head()
    tokens, kinds = (size["n"] or 0) + ends, size["v"] + (ends > 0)
    own_words = max(LEAST_OWN, math.isqrt(tokens)) if own_words is None else own_words
    top = (
        counts.where(F.length("word") <= FREQUENT_CHARS)
        .orderBy(F.desc("c"), "word")
        .limit(max(frequent_words, own_words))
        .select("word", "c")
        .toArrow()
    )
    own_words = min(own_words, len(top))
    classes = 1 + buckets + own_words
    lexicon = Lexicon(top.column("word").to_pylist(), top.column("c").to_pylist(), classes, buckets)

    # the words of a bucket, without those that are classes themselves
    own = top.slice(0, own_words)
    in_bucket, occurs = np.ones(buckets + 1), np.zeros(classes)
    masses = counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    for row in masses.collect():
        in_bucket[row["bucket"]] += row["c"] + row["v"]
        occurs[row["bucket"]] += row["c"]
    for word, c in zip(own.column("word").to_pylist(), own.column("c").to_pylist(), strict=True):
        in_bucket[bucket_of(word, buckets)] -= c + 1
        occurs[bucket_of(word, buckets)] -= c
    occurs[0] = ends
    occurs[1 + buckets :] = own.column("c").to_numpy()
    share = np.zeros(classes)
    share[1 : buckets + 1] = -np.log10(in_bucket[1:])

    # every class is a context as often as it occurs: the end stands before a text's first token
    model = spark.sparkContext.broadcast(train_all(spark, bigram_counts(spark, training, lexicon), occurs))
    sums = spark.sparkContext.broadcast(log_sums(spark, model))
    end_log = float(np.log10(ends + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words = split_words(chunk.column("text"))
            at, class_of = lexicon.place(words.distinct)
            sequence, before, starts = _sequence(words, class_of)
            frequent = at >= 0
            logs = np.where(frequent, lexicon.logs[at] if len(lexicon.logs) else 0.0, 0.0)
            # a word of a bucket also has its share in the bucket, but rare ones get it in the join
            inside = np.where(class_of <= buckets, logs, 0.0)
            text = np.repeat(np.arange(len(words.per_text)), words.per_text)
            per_text = lambda values: np.bincount(text, values, len(words.per_text))
            logs_of = pair_logs(model.value, sums.value, before, sequence) / np.log(10) + share[sequence]
            score = np.add.reduceat(logs_of, starts) + per_text(inside[words.which])
            base = per_text(logs[words.which]) + end_log
            known = per_text(frequent[words.which]).astype(np.int64) + (ends > 0)
            rare = ~frequent[words.which]
            pairs, n = np.unique(text[rare] * len(words.distinct) + words.which[rare], return_counts=True)
            owner, word = np.divmod(pairs, max(1, len(words.distinct)))
            offsets = np.searchsorted(owner, np.arange(len(words.per_text) + 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays(
                [words.distinct.take(pa.array(word)), pa.array(n.astype(np.int64))], ["word", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    chunk.column("held_out"),
                    pa.array(words.per_text + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(score),
                    pa.ListArray.from_arrays(pa.array(offsets), cells),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
            )

    found = stage(
        spark,
        texts.mapInArrow(scored, SCORED_DDL).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    met = lookup(rare, counts.select("word", "c", F.col("c").alias("rows")), "word", "rows")
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return (
        found.drop("rare")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + rare_log - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias(
                "base_score"
            ),
            (F.col("score") + rare_log).alias("score"),
        )
    )
