"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import bpe, decontaminate, jaccard, quality, sharding, suffixes, toxicity
from touchline.llm import textbytes as tb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may bring them.
CLASH = ["rk", "spans", "hits", "items", "n_words", "h", "f", "k", "n", "score", "fold", "toxic", "quality", "sig", "label", "x0", "cv", "a", "b", "place", "token_ids", "kept_text", "depth"]


def docs_of(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def words(rnd, n, v=400):
    return " ".join(f"w{rnd.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    base = [words(rnd, rnd.randint(1, 150)) for _ in range(40)]
    shared = words(rnd, 90)
    out = list(base)
    for t in base[:20]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out += [" ".join(w), t]
    out += [f"{words(rnd, 20)} {shared} {words(rnd, 30)}" for _ in range(6)]
    return [*out, None, "", "  \n", "A b C", "a B c", "a", "é" * 500, "x" * 3000, words(rnd, 6000, 10**6)]


# -- decontamination ----------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, texts):
    from touchline.llm.decontaminate import brute, digest, items_sha256

    items = [("1", " ".join(texts[3].split()[:30]).upper()), ("2", "a"), ("2", "a"), ("10", None), ("11", ""), ("12", "b-C"), ("13", texts[-1][:900]), ("14", "né é")]
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    docs = docs_of(spark, [*texts, "the né É", "B  c!"])
    want = brute([*texts, "the né É", "B  c!"], items)
    for block in (1 << 20, 400):  # in one block, and in several
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.find(docs, bench, ["doc_id"], block_chars=block).selectExpr("doc_id", "n_words", "aggregate(hits, 0, (a, s) -> a + s.last - s.first) AS n_hit", "items").collect()}
        assert [got[i] for i in range(len(want))] == want
    rows = {r.doc_id: r for r in digest(docs, bench).collect()}
    assert all(rows[i].items_sha256 == items_sha256(w[2]) and rows[i].contaminated == (w[1] > 0) for i, w in enumerate(want))


def test_decontamination_removes_spans_and_keeps_clean_rows(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = clashing(docs_of(spark, ["pre one TWO, three post", "one two", None, "pre one two three post"], [1, 2, 3, 1]))
    got = decontaminate.remove(docs, bench)
    assert got.columns == docs.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in got.orderBy("doc_id", "text").collect()] == [(1, "pre  post", 9), (1, "pre  post", 9), (2, "one two", 7), (3, None, None)]
    assert decontaminate.remove(docs, bench, "documents").count() == 2
    assert decontaminate.digest(docs.filter("false"), bench).count() == 0
    assert decontaminate.digest(docs, bench.filter("false")).filter("contaminated").count() == 0


# -- suffixes ---------------------------------------------------------------------------------------------


def check_suffixes(spark, texts, **options):
    got = {r.doc_id: r for r in suffixes.digest(docs_of(spark, texts), **options).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, runs) in enumerate(zip(raw, suffixes.brute(raw), strict=True)):
        kept = b"".join(t[a:b] for a, b in zip([0] + [x[1] for x in runs], [x[0] for x in runs] + [len(t)], strict=True))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()), i
    return got


@pytest.mark.parametrize("group_most", [4096, 2])
def test_suffixes_equal_brute_force(spark, group_most):
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcdefg hij") for _ in range(rnd.randint(150, 900))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(pool)
            parts += [p[rnd.randint(0, len(p) // 3) : rnd.randint(2 * len(p) // 3, len(p))], "".join(rnd.choice("xyzé ") for _ in range(rnd.randint(0, 25)))]
        texts.append("".join(parts))
    got = check_suffixes(spark, [*texts, "a" * 900, "ab" * 600, None, "", "q" * 399, "q" * 400, texts[0], texts[0]], group_most=group_most)
    assert sum(r.n_removed for r in got.values()) > 10_000


def test_suffixes_of_repeated_rows_empty_tables_and_clashing_columns(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(1500))
    docs = clashing(docs_of(spark, [long, long, long[:300], None, ""], [7, 7, 8, 9, None]))
    got = suffixes.remove(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text is None, len(r.text or "")) for r in got.collect()) == [(0, False, 0), (7, False, 0), (7, False, 0), (8, False, 300), (9, True, 0)]
    assert suffixes.digest(docs.filter("false")).count() == 0


def test_long_rows_are_cut_into_segments_without_loss(spark, monkeypatch):
    rnd = random.Random(9)
    one = "".join(rnd.choice("abcdefghij ") for _ in range(5000))
    raw = [(one[:4000] + "#" + one[1000:]).encode(), one[500:2500].encode()]
    whole = [suffixes.anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in raw]
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    for t, full in zip(raw, whole, strict=True):
        row, at, low, high, h, f = suffixes.anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        starts = lambda a, lo, hi: sorted(p for x, y, z in zip(a, lo, hi, strict=True) for p in range(x - z, x - y + 1))
        assert starts(at, low, high) == starts(full[1], full[2], full[3]) == list(range(len(t) - 399))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=8), min_size=1, max_size=6))
def test_loser_tree_merges_and_knows_common_prefixes(runs):
    made = [suffixes.encode_run([(s, b"", (i,)) for s in run]) for i, run in enumerate(runs)]
    got = list(suffixes.LoserTree(made))
    want = sorted(s for run in runs for s in run)
    assert [x[0] for x in got] == want
    assert [x[1] for x in got[1:]] == [suffixes.common_prefix(a, b) for a, b in zip(want, want[1:], strict=False)]


def test_loser_tree_does_not_compare_known_prefixes_again():
    runs = [[(b"p" * 200 + bytes([i, j]), b"", ()) for j in range(40)] for i in range(8)]
    tree = suffixes.LoserTree([suffixes.encode_run(r) for r in runs])
    assert len(list(tree)) == 320 and tree.compared < 320 * 12 + 8 * 220


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=2, max_size=12, unique=True))
def test_extents_equal_all_pairs(pairs):
    items = sorted((r.encode(), left.encode()) for r, left in pairs)
    lcp = [0] + [suffixes.common_prefix(a[0], b[0]) for a, b in zip(items, items[1:], strict=False)]
    got = suffixes.extents(lcp, [x[1] for x in items], 5)
    for i, (r, left) in enumerate(items):
        reach = [(suffixes.common_prefix(left, y), suffixes.common_prefix(r, x)) for j, (x, y) in enumerate(items) if j != i]
        reach = [(a, b) for a, b in reach if a + b >= 5]
        assert got[i] == (max((a for a, _ in reach), default=0), max((b for _, b in reach), default=0))


# -- near copies ------------------------------------------------------------------------------------------------


def test_jaccard_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.Join(docs_of(spark, texts)).result().collect()}
    assert got == dict(enumerate(jaccard.brute(texts)))


def test_jaccard_chains_and_rest_buckets(spark):
    """A chain of near copies: neighbours link, the ends do not, one component."""
    w = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(8):
        w = w[4:] + [f"n{i}{j}" for j in range(4)]
        chain.append(" ".join(w))
    other = " ".join(f"z{i}" for i in range(100))
    got = {r.doc_id: r.component_id for r in jaccard.Join(docs_of(spark, [*chain, other])).result().collect()}
    want = jaccard.brute([*chain, other])
    assert [got[i] for i in range(9)] == [c for _, c in want] and len(set(got.values())) == 2


def test_jaccard_nulls_repeats_empties(spark):
    docs = clashing(docs_of(spark, ["a b c d e f", "a b c d e f", None, "", "A B c d e F", "x"], [5, 5, 2, None, 9, None]))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.Join(docs).result().collect())
    assert got == [(0, 0, 0), (0, 1, 0), (2, 0, 2), (5, 2, 5), (5, 2, 5), (9, 2, 5)]
    assert jaccard.Join(docs.filter("false")).result().count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 5, 5]


def test_one_row_of_each_component_is_kept(spark):
    """Repeated rows, a second text under a kept id, and null ids beside a component of null ids."""
    rnd = random.Random(21)
    one, two, three = (words(rnd, 60, 10**6) for _ in range(3))
    texts = [one, one, one + " end", two, two + " end", three, three + " end", three, None, None, ""]
    ids = [5, 5, 3, 3, 1, None, None, None, None, None, 7]
    docs = clashing(docs_of(spark, texts, ids))
    kept = jaccard.keep_one(docs, repeats=False)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert len(got) == 5 and {(3, one + " end"), (1, two + " end"), (None, None), (7, "")} < set(got)
    assert len([t for _, t in got if t and t.startswith(three)]) == 1
    with_repeats = [(r.doc_id, r.text) for r in jaccard.keep_one(docs_of(spark, [one, one, three, None], [5, 5, 6, None])).collect()]
    assert sorted(with_repeats, key=str) == sorted([(5, one), (5, one), (6, three), (None, None)], key=str)


def test_count_tree_loses_nothing():
    rnd = np.random.default_rng(3)
    points = rnd.poisson(2, (300, jaccard.GROUPS)).astype(np.int64)
    points[150:] = points[:150] + (rnd.random((150, jaccard.GROUPS)) < 0.05)
    sizes = points.sum(1)
    tree = jaccard.CountTree(points, sizes)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(jaccard.enough(bound, sizes, sizes[i]) & (5 * sizes >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes))
        assert set(want) <= set(tree.search(points[i], int(sizes[i]), points, sizes)) <= set(np.flatnonzero(jaccard.enough(bound, sizes, sizes[i])))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), max_size=40), st.integers(1, 7))
def test_buckets_across_batches(rows, size):
    rows = sorted(rows)
    batches = [pa.RecordBatch.from_pydict({"sig": pa.array([r[0] for r in rows[i : i + size]], pa.int64()), "k": pa.array([r[1] for r in rows[i : i + size]], pa.int64())}) for i in range(0, len(rows), size)]
    got = sorted(tuple(x.values()) for b in jaccard._buckets(iter(batches)) for x in b.to_pylist())
    sets = {}
    for s, k in rows:
        sets.setdefault(s, set()).add(k)
    assert got == sorted((s, min(ks), k) for s, ks in sets.items() if len(ks) > 1 for k in ks)


# -- tokens ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("'stredvlmSRE éß \n\t\r1²!-　中𝒳٣\x85\x1c😀 ", max_size=30), min_size=1, max_size=5))
def test_pieces_equal_the_pattern(texts):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for lo, hi, buf, offs in tb.slices(pa.array(texts)):
        starts, ends, first = bpe.cut(buf, offs)
        raw = buf.tobytes()
        for i in range(hi - lo):
            own = slice(first[i], first[i + 1])
            assert [raw[a:b].decode() for a, b in zip(starts[own], ends[own], strict=True)] == pattern.findall(texts[lo + i])


@settings(max_examples=150, deadline=None)
@given(st.text("abcdeilnoprstuéß中", min_size=1, max_size=200))
def test_merges_equal_the_library(encoding, word):
    ranks, library = encoding
    want = library.encode_single_token(word) if word.encode() in ranks else None
    ids = bpe.merge_short(word.encode(), ranks)
    assert ids == bpe.merge_long(word.encode(), ranks)
    assert b"".join(library.decode_single_token_bytes(i) for i in ids).decode() == word
    assert want is None or ids == [want]
    if len(bpe.cut(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0]) == 1:
        assert ids == library.encode_ordinary(word)


def test_fold_equals_the_library(spark, encoding):
    from pyspark.sql import functions as F

    ranks, library = encoding
    words = ["the", " the", "a", "antidisestablishmentarianism", " été", "中文", "😀", "  ", "\n\n", "zqxjk", "aaaaaaaaaaaa"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", bpe.fold(F.col("w").cast("binary"), bpe.rank_map(ranks)).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == {w: bpe.merge_short(w.encode(), ranks) for w in words}


def test_encoding_equals_the_library_and_comes_back(spark, encoding, texts):
    _, library = encoding
    every = [*texts, "don't 'sand we'll '' 's", "a" * 700, " " * 300 + "x"]
    docs = clashing(docs_of(spark, [*every, every[0]], [*range(len(every)), 0]))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.encode(docs, path, ["doc_id"], with_ids=True)
    got = made.collect()
    assert len(got) == len(every) + 1
    for r in got:
        ids = library.encode_ordinary(every[r.doc_id] or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((every[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(made, path, ["doc_id"]).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(every))
    assert bpe.encode(docs.filter("false"), path, ["doc_id"]).count() == 0


# -- shards -----------------------------------------------------------------------------------------------------------


def test_shards_fit_and_split_only_where_needed(spark, texts):
    docs = clashing(docs_of(spark, texts))
    rows = sharding.assign(docs, ["doc_id"], limit=4000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for shard, own in by.items():
        assert sum(r.n_bytes for r in own) <= 4000 or len([r for r in own if r.n_bytes]) == 1
        bits = shard.split("+")[0]
        if bits:  # the bucket this one was split from was too large
            parent = [r for r in rows if r.shard.split("+")[0].startswith(bits[:-1])]
            assert sum(r.n_bytes for r in parent) > 4000
    one = sharding.assign(docs, ["doc_id"]).select("shard", "depth").distinct().collect()
    assert [tuple(r) for r in one] == [("", 0)]


def test_shards_of_a_hot_key_nulls_and_nothing(spark, tmp_path):
    docs = docs_of(spark, ["x" * 100] * 50 + [None, "y" * 30, "z" * 5000], [1] * 50 + [None, 2, 3])
    rows = sharding.assign(docs, ["doc_id"], limit=1000).collect()
    by = {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + r.n_bytes
    assert len(rows) == 53 and sorted(by.values())[-1] == 5000 and sorted(by.values())[-2] <= 1000
    assert sharding.assign(docs.filter("false"), ["doc_id"]).count() == 0
    written = sharding.write(docs.select("doc_id", "text"), str(tmp_path / "shards"), limit=1000)
    assert written.selectExpr("sum(n_rows)").first()[0] == 53 == spark.read.parquet(str(tmp_path / "shards")).count()


# -- classifiers ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        w = words(rnd, rnd.randint(5, 60)).split()
        toxic, good = int(rnd.random() < 0.2), int(rnd.random() < 0.7)
        if toxic:
            for bad in rnd.sample(["scumbag", "morons", "idiotic", "trashy"], 2):
                w.insert(rnd.randrange(len(w) + 1), bad)
        if not good:
            w = [x + rnd.choice(["###", "%%%", "***"]) for x in w]
        rows.append((i, " ".join(w), "en", "s", None))
        labels.append((i, good, toxic))
    rows += [(2000, None, None, None, None), (2001, "", None, None, 0), (None, "w1 w2", None, None, 5), (1, "again w1", None, None, 8)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_tell_held_out_rows_apart(spark, labelled, module, label):
    from touchline.llm import common

    docs, labels = labelled
    got = module.score(clashing(docs), labels, ["doc_id"]).withColumn("held", common.crc_fold("doc_id") == 0)
    rows = got.join(labels, "doc_id").filter(f"held and {label} is not null and doc_id < 900").collect()
    assert auc([(r.score, r[label]) for r in rows]) > 0.97
    every = got.collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_without_labels_or_rows(spark, labelled, module):
    docs, labels = labelled
    assert all(0 <= r.score <= 1 for r in module.score(docs, labels.filter("false"), ["doc_id"]).collect())
    assert all(0 <= r.score <= 1 for r in module.score(docs.limit(5), labels.filter("toxic = 0 and quality = 1"), ["doc_id"]).collect())
    assert module.score(docs.filter("false"), labels, ["doc_id"]).count() == 0


def test_six_grams_are_exact_and_both_ways_agree(spark, labelled, monkeypatch):
    """The table has a row of its own for every six-gram, and scores do not depend on how it is looked up."""
    rnd = random.Random(4)
    train = spark.createDataFrame([(words(rnd, 400, 10**9), i % 2) for i in range(40)], "text string, toxic int")
    raw = [tb.raw_texts(pa.array([r.text])) for r in train.collect()]
    grams = np.unique(np.concatenate([toxicity.spell(*x)[0] for x in raw]))
    by_gram, by_ctx, _ = toxicity.fit_tables(train)
    tables = toxicity._sorted(by_gram), toxicity._sorted(by_ctx)
    assert np.array_equal(tables[0][0], grams) and np.array_equal(tables[1][0], np.unique(grams >> 8))
    unseen = (grams & ~0xFF) | ord("!")
    assert not toxicity.look_up(tables[0], unseen)[1].any() and toxicity.look_up(tables[1], unseen >> 8)[1].all()
    docs, labels = labelled
    docs = docs.union(docs.limit(3)).unionByName(docs.limit(1).selectExpr("9000L AS doc_id", "'Scumbag scumbag É w1' AS text", "lang", "source", "n_chars"))
    made = []
    for most in (toxicity.SHIPPED_GRAMS, 0):
        monkeypatch.setattr(toxicity, "SHIPPED_GRAMS", most)
        made.append(sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, labels, ["doc_id"]).collect()))
    assert len(made[0]) == len(made[1]) == docs.count()
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) for a, b in zip(*made, strict=True))


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=quality.BUCKETS), rng.normal(size=(quality.BUCKETS, quality.RANK))
    col, val = np.array([3, 70, 9000, 65540]), np.array([0.5, -1.0, 2.0, 0.25])
    want = 0.3 + w[col] @ val + sum(v[col[i]] @ v[col[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert quality.raw_scores(np.zeros(4, int), col, val, 1, 0.3, w, v)[0] == pytest.approx(want)


def test_labels_of_held_out_rows_do_not_matter(spark, labelled):
    from touchline.llm import common

    docs, labels = labelled
    held = common.crc_fold("doc_id") == 0
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    for module in (toxicity, quality):
        one, two = ({r.doc_id: r.score for r in module.score(docs.filter("doc_id < 900 and doc_id <> 1"), x, ["doc_id"]).collect()} for x in (labels, turned))
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)
