"""Hot groups, very long texts, numbers of any size, and the pipeline, held against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter
from math import log
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from touchline.llm import bpe, common, decontaminate, jaccard, quality, sharding, suffixes, toxicity, vafile, warc
from touchline.llm import textbytes as tb

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(rnd, n, v=400):
    return " ".join(f"w{rnd.randrange(v)}" for _ in range(n))


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


# -- suffixes ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [240, 400])
def test_a_passage_in_a_third_of_all_rows(spark, length):
    """Shorter than length, just as long, longer, at the same place and not, in more rows than a group may have."""
    rnd = random.Random(length)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (length - 26, length, length + 1, length + 300)]
    noise = lambda: "".join(rnd.choice("xyzé uvw") for _ in range(rnd.randint(0, 300)))
    texts = []
    for p in passages:
        texts += [noise() + p + noise() for _ in range(30)]
    texts += [noise() + noise() + noise() for _ in range(60)] + [passages[3] + noise() + passages[3], passages[3] * 3, "ab" * 700, "ab" * 650, None, ""]
    raw = [(t or "").encode() for t in texts]
    want = {}
    for i, (t, runs) in enumerate(zip(raw, suffixes.brute(raw, length), strict=True)):
        kept = b"".join(t[a:b] for a, b in zip([0] + [x[1] for x in runs], [x[0] for x in runs] + [len(t)], strict=True))
        want[i] = (len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    assert sum(x[1] > 0 for x in want.values()) > 90 and not any(want[i][1] for i in range(30))
    for most in (5, 17, 4096):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs_of(spark, texts), length, group_most=most).collect()}
        assert got == want, most


def test_a_sieve_lets_every_key_through(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    rows = spark.range(0, 30000).select("id", F.xxhash64("id").alias("k"))
    kept = {r.id for r in rows.filter(common.sieve(keys, "k")("k")).collect()}
    assert {x for x in range(0, 3000, 3)} <= kept and len(kept) < 4000
    assert rows.filter(common.sieve(keys, "k", 64)("k")).count() > 20_000  # a full bitmap only saves less
    assert rows.filter(common.sieve(keys.limit(0), "k")("k")).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------------


def kneser_ney(rows):
    """log ratios by six-gram and by context, with dictionaries."""
    six = [Counter(), Counter()]
    for text, label in rows:
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())):
            padded = b" " * 5 + w + b" "
            six[label].update(padded[i : i + 6] for i in range(len(w) + 1))
    seen = [None] * 7
    seen[6] = set(six[0]) | set(six[1])
    counts = {}
    for k in range(5, 0, -1):
        counts[k] = Counter(g[1:] for g in seen[k + 1])
        seen[k] = set(counts[k])
    after = {k: {} for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k].setdefault(g[:-1], []).append(n)

    def p(g):
        if not g:
            return 1 / 256
        ns = after[len(g)][g[:-1]]
        return (max(counts[len(g)][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(ns) * p(g[1:])) / sum(ns)

    own = [{}, {}]
    for label in (0, 1):
        for g, n in six[label].items():
            own[label].setdefault(g[:5], []).append(n)
    back = lambda label, ctx: toxicity.DISCOUNT * len(own[label][ctx]) / sum(own[label][ctx]) if ctx in own[label] else 1.0

    def full(label, g):
        ctx = g[:5]
        first = max(six[label][g] - toxicity.DISCOUNT, 0) / sum(own[label][ctx]) if ctx in own[label] else 0.0
        return first + back(label, ctx) * p(g[1:])

    by_gram = {int.from_bytes(g, "big"): log(full(1, g) / full(0, g)) for g in seen[6]}
    by_ctx = {int.from_bytes(c, "big"): log(back(1, c) / back(0, c)) for c in {g[:5] for g in seen[6]}}
    return by_gram, by_ctx


def test_kneser_ney_equals_dictionaries(spark):
    rnd = random.Random(12)
    rows = [("Der Clown, der clown! é" + words(rnd, rnd.randint(0, 25), 30), i % 3 == 0) for i in range(60)] + [("", True), ("a", False), ("aaaaaaaaa", True)]
    by_gram, by_ctx, _ = toxicity.fit_tables(spark.createDataFrame([(t, int(y)) for t, y in rows], "text string, toxic int"))
    want_gram, want_ctx = kneser_ney([(t, int(y)) for t, y in rows])
    got = {r.key: r.llr for r in by_gram.collect()}
    assert got.keys() == want_gram.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want_gram.items())
    got = {r.key: r.llr for r in by_ctx.collect()}
    assert got.keys() == want_ctx.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want_ctx.items())


# -- search -----------------------------------------------------------------------------------------------


def test_search_over_numbers_of_any_size(spark):
    rnd = random.Random(3)
    rows = [(0, [1.0, 2.0]), (1, [300000.0, 1.0]), (2, [1.0, 1.0]), (100, [-1e300, 1e300]), (3, [1e300, 1e300]), (4, [1e300, 1.0000001e300]), (5, [5e-324, -5e-324]), (200, [0.0, 0.0])]
    rows += [(1000 + i, [rnd.uniform(-1, 1) * 10 ** rnd.randint(-3, 200), rnd.uniform(-1, 1) * 10 ** rnd.randint(-3, 200)]) for i in range(300)]
    rows += [(5000 + i, [0.5, 0.25]) for i in range(300)] + [(5007, [0.5, 0.25])] * 3  # one vector in a third of all rows
    df = spark.createDataFrame([(i, v, i, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<double>, row long, ids string, up double")
    whole = lambda x: int(x) * 1024 if abs(x) > 2**53 else int(np.floor(x * 1024))
    exact = [(i, [whole(x) for x in v]) for i, v in rows]
    got = {}
    for r in vafile.search(vafile.build(df, k_most=10), df.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = {}
    for q, a in exact:
        if q % 100 == 0:
            asked[q] = min(a, asked.get(q, a))
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for q, a in asked.items():
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in exact if i != q)[:10]
        assert got[q] == [(i, clamp(-s)) for s, i in best], q
    assert set(got) == set(asked)


def test_exact_vectors_are_read_for_few(spark):
    rnd = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(0, 0.12, (3000, 32)))], "vec_id long, embedding array<double>")
    index = vafile.build(df, k_most=10)
    chunk = index.cells.first()
    assert "exact" not in index.cells.columns and len(chunk.codes) == chunk.n * chunk.dim
    low, up = vafile.bounds(np.floor(1024 * rnd.normal(0, 0.12, (5, 32))), np.frombuffer(chunk.low), np.frombuffer(chunk.width), np.frombuffer(chunk.codes, np.uint8).reshape(chunk.n, chunk.dim))
    assert ((up - np.sort(low, 1)[:, -10:-9]) >= 0).sum(1).max() < 300


# -- shards -----------------------------------------------------------------------------------------------


def test_levels_of_the_directory_agree_with_one(spark, monkeypatch):
    rnd = random.Random(6)
    texts = ["x" * rnd.randint(0, 400) for _ in range(600)]
    docs = docs_of(spark, texts)
    one = sorted(map(tuple, sharding.assign(docs, ["doc_id"], limit=1000).collect()))
    for levels in ((2, 5, 8, 60), (1, 3, 60), (60,)):
        monkeypatch.setattr(sharding, "LEVELS", levels)
        assert sorted(map(tuple, sharding.assign(docs, ["doc_id"], limit=1000).collect())) == one
    total = sum(map(len, texts))
    assert len({r[1] for r in one}) > total / 1000 and len({r[2] for r in one}) > 2


def test_written_shards_are_counted_as_written_beside_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = docs_of(spark, ["x" * 100] * 30 + [None, "y" * 3000], [1] * 30 + [None, 3]).select("*", F.lit("s").alias("shard"), F.lit(1).alias("depth"), F.lit(2).alias("n_bytes"))
    got = sharding.write(docs, str(tmp_path / "s"), limit=1000).collect()
    assert sum(r.n_rows for r in got) == 32 and sum(r.n_bytes for r in got) == 6000
    assert sorted(r.n_bytes for r in got)[-1] == 3000 and sorted(r.n_bytes for r in got)[-2] <= 1000


# -- archives ---------------------------------------------------------------------------------------------


def test_archives_are_read_in_tasks_by_their_bytes(spark, monkeypatch):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, "u", rnd.randbytes(2000).hex()) for i in range(200)], "page_id long, url string, html string")
    index = warc.write(df, common.shared_path(spark, "warc"), frame_bytes=10_000)
    monkeypatch.setattr(warc, "READ_BYTES", 50_000)
    back = warc.read(index)
    assert back.rdd.getNumPartitions() >= 4 and back.count() == 200


# -- long texts -------------------------------------------------------------------------------------------


def test_long_texts_are_worked_on_in_stretches(spark, monkeypatch):
    rnd = random.Random(9)
    long = [words(rnd, 3000, 50) + " don't 'll  x\n\ny é中 " + words(rnd, 3000, 10**6), "word" * 2000, " " * 9000, "é" * 5000, "a b " * 3000]
    buf, offs = tb.raw_texts(pa.array([*long, "short text", ""]))
    starts, ends, _ = tb.words(buf, offs, tb.ALNUM)
    whole = tb.word_hashes(buf, starts, ends)
    train = spark.createDataFrame([(words(rnd, 50, 50), i % 2) for i in range(20)], "text string, toxic int")
    by_gram, by_ctx, _ = toxicity.fit_tables(train)
    tables = toxicity._sorted(by_gram), toxicity._sorted(by_ctx)
    scored = [toxicity.evidence(*tb.raw_texts(pa.array([t])), *tables) for t in long]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(tb, "STRETCH", 500)
    assert np.array_equal(tb.word_hashes(buf, starts, ends), whole)
    assert len(tb.word_stretches(*tb.raw_texts(pa.array(long[:1])), tb.ALNUM)[1]) > 10
    for t, want in zip(long, scored, strict=True):
        assert toxicity.evidence(*tb.raw_texts(pa.array([t])), *tables) == pytest.approx(want)
    head = bpe.Head(b"", np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), ranks)
    for t in long:
        raw = np.frombuffer(t.encode(), np.uint8)
        points = bpe.split_points(raw)
        ids = []
        for a, b in zip(points, points[1:], strict=False):
            ids += map(int, next(bpe.encode_rows(head, raw[a:b], np.array([0, b - a])))[1].split())
        assert ids == library.encode_ordinary(t)
    assert len(bpe.split_points(np.frombuffer(long[0].encode(), np.uint8))) > 10


def test_pieces_of_one_hash_are_told_apart():
    """A dictionary that gives every piece another piece's ids is found out by spelling the text again."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lie, truth = [b"hello", b" world"], [b" world", b"hello"]
    ids = [bpe.merge_short(w, ranks) for w in truth]
    head = bpe.Head(b"".join(lie), np.array([5, 6]), np.array([x for y in ids for x in y], np.int32), np.array([len(x) for x in ids]), ranks)
    raw = b"hello world"
    n, shown, back = next(bpe.encode_rows(head, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert back == raw and [int(x) for x in shown.split()] == bpe.merge_short(b"hello", ranks) + bpe.merge_short(b" world", ranks) and n == len(shown.split())


# -- executors without the package -------------------------------------------------------------------------


def test_written_tables_leave_no_garbage_on_the_driver(spark, monkeypatch):
    """What nothing holds any more is collected when a table is written, once there is enough of it."""
    monkeypatch.setattr(common, "HEAP_SHARE", 0)
    monkeypatch.setitem(common._collected, "used", 0)
    lang = spark._jvm.java.lang
    thing = lang.Object()
    seen = lang.ref.WeakReference(thing)
    del thing
    common.materialize(spark.range(3), "three")
    assert seen.get() is None and common._collected["used"] > 0


def test_dictionary_is_counted_over_every_text(spark, monkeypatch):
    """Pieces of long texts, and of any number of texts, are counted exactly; a sample saw neither."""
    from collections import defaultdict

    import regex

    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    texts = [" ".join(rng.choices(words, range(1, 301), k=12)) + "\u00e9 don't  7" for _ in range(500)]
    texts += [" ".join(["quagga", *rng.choices(words, k=3)] * 4000), "z" * 200, "", None]
    total = Counter(w for t in texts if t for w in (x.encode() for x in regex.findall(public_tokenizers.PATTERN, t)) if len(w) <= bpe.FOLD_BYTES)
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for stretch, most in ((tb.STRETCH, bpe.COUNTED), (500, 20)):
        monkeypatch.setattr(tb, "STRETCH", stretch)
        monkeypatch.setattr(bpe, "COUNTED", most)
        got = defaultdict(int)
        for part in bpe._pieces([rows, rows.slice(0, 0)]):
            for w, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                got[w] += n
        assert got == total
    monkeypatch.undo()
    kinds = sorted(total.items(), key=lambda x: -x[1])
    k = next(k for k in range(40, 90) if kinds[k - 1][1] > kinds[k][1])
    monkeypatch.setattr(bpe, "HEAD_WORDS", k)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    raw, lengths, *_ = bpe.plain_head(docs, ranks)
    at = np.concatenate(([0], np.cumsum(lengths)))
    assert {raw[a:b] for a, b in zip(at, at[1:])} == {w for w, _ in kinds[:k]}


def test_executors_need_no_copy_of_the_package(tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.showConsoleProgress", "false").getOrCreate()
def there(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("touchline") is not None]}})
assert not spark.range(1).mapInArrow(there, "found boolean").first().found
import __spark_entry__ as entry
for name in ("op3_bpe", "op5_suffix_dedup", "op4_vafile", "pipeline"):
    print(name, entry.queries()[name](spark, {SF!r}).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(public_tokenizers.__file__)}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "pipeline" in done.stdout, done.stderr[-2000:]


# -- the pipeline -------------------------------------------------------------------------------------------


def cut_words(text, items, n=decontaminate.WINDOW):
    """text without the words of windows that an item holds, with what stands between them."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    found = [m.span() for m in word.finditer(low(text))]
    ws, hit = [low(text)[a:b] for a, b in found], set()
    for item in items:
        own = word.findall(low(item or ""))
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1 if size else 0):
            if tuple(ws[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    out, at = [], 0
    for a, z in decontaminate._runs(sorted(hit)):
        out.append(text[at : found[a][0]])
        at = found[z - 1][1]
    return "".join([*out, text[at:]])


def test_pipeline_equals_its_parts_by_brute_force(spark, tmp_path):
    """Nulls, empty texts, repeats, near copies, passages, benchmark text and clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    rnd = random.Random(31)
    bench = [words(rnd, 30, 10**6) for _ in range(3)]
    passage = words(rnd, 55, 10**6)
    base = [words(rnd, rnd.randint(60, 120), 10**6) for _ in range(30)]
    near = [t + " end" for t in base[:6]]
    shared = [f"{words(rnd, 40, 10**6)} {passage} {words(rnd, 40, 10**6)}" for _ in range(8)]
    leaked = [f"{words(rnd, 40, 10**6)} {b.upper()} {words(rnd, 20, 10**6)}" for b in bench]
    junk = [" ".join(f"{x}###" for x in words(rnd, 50).split()) for _ in range(40)]
    texts = [*base, *near, *shared, *leaked, *junk, base[7], base[8], None, "", "a"]
    ids = [*range(len(texts) - 5), 7, 500, None, 501, 502]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, DOCS + ", n_words int, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    n_junk = len(base) + len(near) + len(shared) + len(leaked)
    labels = [(i, int(not n_junk <= i < n_junk + 40), 0) for i in ids if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, b) for i, b in enumerate([*bench, None, ""])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()

    scored = quality.score(docs, common.table(spark, str(tmp_path), "labels"), ["doc_id", "text"]).collect()
    kept = sorted(((r.doc_id, r.text) for r in scored if r.score >= pipeline.KEEP_SCORE), key=lambda r: (r[0] is None, r[0] or 0))
    assert 40 < len(kept) < 70
    groups = {}
    for (i, t), (_, g) in zip(kept, jaccard.brute([t for _, t in kept]), strict=True):
        groups.setdefault(g, []).append((i, t))
    chosen = [own[0] for own in groups.values()]  # every group's rows of its smallest id
    assert all(len({t for i, t in own if i == own[0][0]}) == 1 for own in groups.values())
    raw = [(t or "").encode() for _, t in chosen]
    left = []
    for (i, t), own, runs in zip(chosen, raw, suffixes.brute(raw, pipeline.PASSAGE_BYTES), strict=True):
        left.append((i, None if t is None else b"".join(own[a:b] for a, b in zip([0] + [x[1] for x in runs], [x[0] for x in runs] + [len(own)], strict=True)).decode("utf-8", "ignore")))
    assert not any(t and passage in t for _, t in left) and sum(len(t or "") for _, t in left) < sum(len(t or "") for _, t in chosen)
    clean = [(i, cut_words(t or "", bench)) for i, t in left]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(pipeline.VOCABULARY)), special_tokens={})
    want = []
    for i, t in clean:
        tokens = library.encode_ordinary(t)
        want.append((i, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    empty = docs.filter(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
