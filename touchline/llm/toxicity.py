"""Toxicity scores from class-conditional Kneser-Ney models over the letters of words.

Words (as in `textbytes.ALNUM`, lower case) are spelled as bytes with an end mark; a symbol's context is the five
bytes before it, cut at the word's start (contexts across words told held-out rows apart less well; the README has
the figures). The six-gram counts are kept per class; the continuation counts
of all shorter orders, five to one, are shared: a rare or unseen spelling backs off, in both classes, to
the same counts, so only evidence moves the comparison:

    P_c(b | ctx) = (max(n_c(ctx b) - D, 0) + D * N1_c(ctx) * P_5(b | ctx')) / n_c(ctx)
    P_k(b | ctx) = (max(N(ctx b) - D, 0) + D * kinds(ctx) * P_(k-1)(b | ctx')) / sum N(ctx .), P_0 = 1/256

N counts the different bytes seen before a string, kinds the different bytes seen after one.

A text's evidence is the difference of its toxic and ordinary log-likelihoods, normalised by
length: over the whole text per word, and over its two most toxic words. A logistic calibration of
these (fitted on labelled rows whose counts were not used) turns them into a score.

Counting covers all labelled rows of folds 1 to 3 and grows with them; it is an aggregation by
n-gram with map-side combining. The finished table has an exact row a six-gram and a context, so it grows
with the input and an unseen six-gram always backs off. A spelling's evidence depends on its word alone: up to
`SHIPPED_GRAMS` six-grams the table is broadcast, above that distinct words (told apart by 64-bit hashes) meet it by
joins, and documents meet their words; both ways give the same evidence. Calibration uses at most
`CALIBRATION_ROWS` labelled rows of fold 4, those with the smallest hash. Fold 0 is never learned from.

Defined results: null or empty texts score like a text without evidence; repeated labels of an id
count once (the larger); null labels or ids are not learned from; without labels of both classes every
score is the smoothed share of toxic labels; repeated document rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm import textbytes as tb

ORDER = 6
DISCOUNT = 0.75
SHIPPED_GRAMS = 1 << 21
CALIBRATION_ROWS = 12_000
COUNT_FOLDS, CALIBRATION_FOLD = (1, 2, 3), 4
_FLUSH = 1 << 20
X = tuple(f"{common.OWN}x{k}" for k in range(4))
WORDS, COUNTS = f"{common.OWN}words", f"{common.OWN}counts"


def spell(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(six-grams as integers, first six-gram of each word, first word of each row)."""
    starts, ends, first = tb.words(buf, offs, tb.ALNUM)
    size = ends - starts + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    total = int(begin[-1])
    at = np.arange(total, dtype=np.int64)
    inside = at - np.repeat(begin[:-1], size)
    source = inside + np.repeat(starts, size)
    letters = np.append(tb.LOWER[buf], np.uint8(32))[source]
    letters[begin[1:] - 1] = 32
    grams = letters.astype(np.int64)
    for j in range(1, ORDER):
        before = np.full(total, 32, np.uint8)
        before[j:] = letters[: total - j] if total > j else letters[:0]
        before[inside < j] = 32
        grams |= before.astype(np.int64) << (8 * j)
    return grams, begin[:-1], first


def _count(batches):
    """(gram, toxic, ordinary) counts, combined in the worker before they are handed on."""
    held: list[list[np.ndarray]] = [[], []]
    waiting = 0

    def flush():
        each = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.int64),) * 2 for x in held]
        grams = np.union1d(each[0][0], each[1][0])
        counts = np.zeros((2, len(grams)), np.int64)
        for k, (g, n) in enumerate(each):
            counts[k][np.searchsorted(grams, g)] = n
        for lo in range(0, len(grams), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (grams, counts[1], counts[0])], names=["gram", "toxic", "plain"])

    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, _, buf, offs in tb.slices(batch.column("text")):
            grams, begin, first = spell(buf, offs)
            bounds = np.append(begin, len(grams))[first]
            for k in (0, 1):
                own = np.repeat(label[lo : lo + len(first) - 1] == k, np.diff(bounds))
                held[k].append(grams[own])
            waiting += len(grams)
            if waiting >= _FLUSH:
                yield from flush()
                held, waiting = [[], []], 0
    yield from flush()


def _shared(grams: DataFrame) -> DataFrame:
    """(g, p): the strings of five bytes and the probability of their last byte under the shared continuation counts."""
    levels = [grams.select(F.col("gram").alias("g"))]
    for order in range(ORDER - 1, 0, -1):  # the strings before hold each longer string once
        own = levels[-1].groupBy(F.expr(f"g & {(1 << 8 * order) - 1}").alias("g")).agg(F.count("*").alias("n"))
        levels.append(common.materialize(own, "kn-continuations"))
    lower = None
    for order, own in enumerate(reversed(levels[1:]), 1):
        ctx = own.groupBy(F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("tot"), F.count("*").alias("kinds"))
        own = own.join(ctx, F.shiftright(own["g"], 8) == ctx["c"])
        below = F.lit(1 / 256)
        if lower is not None:
            own = own.join(lower.toDF("g0", "p0"), F.expr(f"g & {(1 << 8 * (order - 1)) - 1}") == F.col("g0"))
            below = F.col("p0")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * below) / F.col("tot")
        lower = common.materialize(own.select("g", p.alias("p")), "kn-shared")
    return lower


def fit_tables(train: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """(key and llr of every six-gram, of every context of unseen six-grams, symbols of each class).

    train: text and toxic (0 or 1).
    """
    grams = train.select("text", "toxic").mapInArrow(_count, "gram long, toxic long, plain long")
    grams = common.materialize(grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "kn-grams")
    ctx = grams.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(
        *[F.sum(c).alias(f"n_{c}") for c in ("toxic", "plain")], *[F.sum((F.col(c) > 0).cast("long")).alias(f"k_{c}") for c in ("toxic", "plain")]
    )
    ctx = common.materialize(ctx, "kn-contexts")
    sums = ctx.agg(F.sum("n_toxic"), F.sum("n_plain")).first()
    totals = (int(sums[0] or 0), int(sums[1] or 0))

    def back(c):
        return F.when(F.col(f"n_{c}") > 0, DISCOUNT * F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(1.0)

    def p(c):
        seen = F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0)
        return seen + back(c) * F.col("p")

    shared = _shared(grams)
    by_gram = (
        grams.join(ctx, F.shiftright(grams["gram"], 8) == ctx["ctx"])
        .join(shared, F.expr(f"gram & {(1 << 8 * (ORDER - 1)) - 1}") == shared["g"])
        .select(F.col("gram").alias("key"), F.log(p("toxic") / p("plain")).alias("llr"))
    )
    by_ctx = ctx.select(F.col("ctx").alias("key"), F.log(back("toxic") / back("plain")).alias("llr"))
    return common.materialize(by_gram, "kn-table"), by_ctx, totals


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their log ratios) on the driver."""
    got = table.toArrow()
    keys, llr = got.column("key").to_numpy(), got.column("llr").to_numpy()
    order = np.argsort(keys)
    return keys[order], llr[order]


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log ratios, 0 where there is none; whether the key is known)."""
    known, llr = table
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[at] == keys
    return np.where(found, llr[at], 0.0), found


def evidence(buf, offs, by_gram, by_ctx) -> np.ndarray:
    """Per row: mean log ratio per word, those of the two most toxic words, log(1 + words)."""
    cuts, owner = tb.word_stretches(buf, offs, tb.ALNUM)
    if len(owner) == len(offs) - 1:
        part = _evidence(buf, offs, by_gram, by_ctx)
    else:  # a long row is scored stretch by stretch
        part = np.concatenate([_evidence(buf[a:b], np.array([0, b - a]), by_gram, by_ctx) for a, b in zip(cuts, cuts[1:], strict=False)])
    n = len(offs) - 1
    total, words = np.bincount(owner, part[:, 0], n), np.bincount(owner, part[:, 3], n)
    best, rows = np.concatenate([part[:, 1], part[:, 2]]), np.concatenate([owner, owner])
    order = np.lexsort((-best, rows))
    first = np.searchsorted(rows[order], np.arange(n))
    tops = [best[order[first + k]] if n else np.zeros(0) for k in (0, 1)]
    return np.stack([total / np.maximum(words, 1), *(np.where(np.isfinite(x), x, 0.0) for x in tops), np.log1p(words)], 1)


def _evidence(buf, offs, by_gram, by_ctx) -> np.ndarray:
    """Per row: sum of the log ratios, those of the two most toxic words (-inf: there is none), number of words."""
    grams, begin, first = spell(buf, offs)
    out = np.zeros((len(offs) - 1, 4))
    out[:, 1:3] = -np.inf
    if not len(begin):
        return out
    ratio, found = look_up(by_gram, grams)
    unseen = np.flatnonzero(~found)
    ratio[unseen] = look_up(by_ctx, grams[unseen] >> 8)[0]
    word = np.add.reduceat(ratio, begin)
    counts = np.diff(first)
    rows = np.flatnonzero(counts)
    at = first[:-1][rows]
    out[rows, 0] = np.add.reduceat(word, at)
    out[:, 3] = counts
    for k in (1, 2):
        top = np.maximum.reduceat(word, at)
        out[rows, k] = top
        hit = np.flatnonzero(word == np.repeat(top, counts[rows]))
        own = np.searchsorted(first, hit, "right") - 1
        word[hit[np.unique(own, return_index=True)[1]]] = -np.inf
    return out


def _evidence_rows(shipped, names):
    def run(batches):
        by_gram, by_ctx = shipped.value
        for batch in batches:
            parts = [evidence(buf, offs, by_gram, by_ctx) for _, _, buf, offs in tb.slices(batch.column("text"))]
            x = np.concatenate(parts) if parts else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x[:, k]) for k in range(4))], names=[*names, *X])

    return run


def _row_words(names):
    """The named columns with the hashes of each row's distinct words and their counts (8 and 4 bytes each)."""

    def run(batches):
        for batch in batches:
            hashes, counts = [], []
            for lo, hi, buf, offs in tb.slices(batch.column("text")):
                starts, ends, first = tb.words(buf, offs, tb.ALNUM)
                h = tb.word_hashes(buf, starts, ends).view(np.int64)
                for i in range(hi - lo):
                    word, n = np.unique(h[first[i] : first[i + 1]], return_counts=True)
                    hashes.append(word.tolist())
                    counts.append(n.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=[*names, WORDS, COUNTS])

    return run


def _distinct_words(batches):
    """(h, word): the distinct words of each slice of texts."""
    for batch in batches:
        for _, _, buf, offs in tb.slices(batch.column("text")):
            starts, ends, _ = tb.words(buf, offs, tb.ALNUM)
            h, at = np.unique(tb.word_hashes(buf, starts, ends).view(np.int64), return_index=True)
            raw = tb.LOWER[buf].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([raw[starts[i] : ends[i]] for i in at], pa.binary())], names=["h", "word"])


def _word_grams(batches):
    """(h, gram) of every symbol of the words."""
    for batch in batches:
        text = batch.column("word").cast(pa.string())
        for lo, hi, buf, offs in tb.slices(text):
            grams, begin, _ = spell(buf, offs)
            size = np.diff(np.append(begin, len(grams)))
            h = batch.column("h").slice(lo, hi - lo).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, size)), pa.array(grams)], names=["h", "gram"])


def _joined_evidence(docs: DataFrame, names: list[str], by_gram: DataFrame, by_ctx: DataFrame) -> DataFrame:
    """The columns names of docs and X, by joins on distinct words and six-grams."""
    row, llr = f"{common.OWN}row", F.col("llr")
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    made = docs.mapInArrow(_row_words(names), f"{shape}, {WORDS} array<long>, {COUNTS} array<long>".removeprefix(", "))
    made = common.materialize(made.withColumn(row, F.monotonically_increasing_id()), "row-words")
    words = docs.select("text").mapInArrow(_distinct_words, "h long, word binary").groupBy("h").agg(F.min("word").alias("word"))
    grams = words.mapInArrow(_word_grams, "h long, gram long")
    met = grams.join(by_gram.toDF("gram", "own"), "gram", "left")
    met = met.join(by_ctx.toDF("ctx", "back"), F.shiftright("gram", 8) == F.col("ctx"), "left")
    by_word = common.materialize(met.groupBy("h").agg(F.sum(F.coalesce("own", "back", F.lit(0.0))).alias("llr")), "word-evidence")
    each = made.select(row, F.explode(F.arrays_zip(WORDS, COUNTS)).alias("w")).select(row, F.col(f"w.{WORDS}").alias("h"), F.col(f"w.{COUNTS}").alias("n"))
    each = each.join(by_word, "h")
    best = F.slice(F.sort_array(F.collect_list(F.struct("llr", "n")), False), 1, 2)
    top = each.groupBy(row).agg((F.sum(llr * F.col("n")) / F.sum("n")).alias(X[0]), best.alias("best"), F.sum("n").alias("words"))
    second = F.when(F.col("best")[0]["n"] > 1, F.col("best")[0]["llr"]).otherwise(F.try_element_at("best", F.lit(2))["llr"])
    top = top.select(row, X[0], F.col("best")[0]["llr"].alias(X[1]), second.alias(X[2]), F.log1p("words").alias(X[3]))
    return made.select(row, *names).join(top, row, "left").select(*names, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in X])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant last) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    hold = np.append(np.full(x.shape[1], ridge * 10), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9), z.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and score, for every row. labels: doc_id, toxic."""
    spark = docs.sparkSession
    given = labels.select(labels["doc_id"], labels["toxic"]).na.drop().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", common.crc_fold("doc_id"))
    texts = common.only(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    counted = texts.filter(common.crc_fold("doc_id").isin(*COUNT_FOLDS)).join(given.filter(F.col("fold").isin(*COUNT_FOLDS)).hint("merge"), "doc_id")
    by_gram, by_ctx, totals = fit_tables(counted)
    few = given.filter(F.col("fold") == CALIBRATION_FOLD).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    sample = texts.join(F.broadcast(few.select("doc_id", "toxic")), "doc_id").select("toxic", "text")
    asked = docs.select(*[docs[c] for c in dict.fromkeys([*keep, "text"])])
    if by_gram.count() <= SHIPPED_GRAMS:  # contexts are no more than six-grams
        shipped = spark.sparkContext.broadcast((_sorted(by_gram), _sorted(by_ctx)))
        shape = ", ".join(f"{c} double" for c in X)
        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        seen = sample.mapInArrow(_evidence_rows(shipped, ["toxic"]), f"toxic int, {shape}")
        out = asked.mapInArrow(_evidence_rows(shipped, keep), f"{kinds}, {shape}")
    else:
        seen = _joined_evidence(sample, ["toxic"], by_gram, by_ctx)
        out = _joined_evidence(asked, keep, by_gram, by_ctx)
    got = seen.toPandas()
    x, y = got[list(X)].to_numpy(float), got["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max() or not min(totals):
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return out.select(*keep, F.lit(float(share)).alias("score"))
    mean, scale, w = logistic(x, y)
    logit = F.lit(float(w[-1]))
    for k in range(4):
        logit = logit + (F.col(X[k]) - float(mean[k])) / float(scale[k]) * float(w[k])
    return out.select(*keep, (1 / (1 + F.exp(-logit))).alias("score"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", (common.crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
