"""Search, archives, dialogues, components, and the registered queries against DuckDB."""

import os
import random
import struct

import duckdb
import numpy as np
import pytest
import zstandard

from touchline.llm import chat, common, components, queries, vafile, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_search(rows, queries_of, k):
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if queries_of(q):
            best = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_search_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (500, [None] * 12), (600, [float("nan")] * 12), (700, [float("inf")] * 12), (None, rows[0][1]), (800, [1.0, 2.0]), (900, [0.5, 1.0]), (1000, []), (1001, [])]
    df = vectors(spark, [(i, v, 1) for i, v in rows])
    want = brute_search(rows, lambda q: q % 100 == 0, 10)
    got = {}
    for r in vafile.search(vafile.build(df), df.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: b for q, b in want.items() if b}
    assert vafile.search(vafile.build(df.filter("false")), df.filter("false"), 10).count() == 0


def test_search_reads_few_exact_vectors():
    rng = np.random.default_rng(2)
    m = np.floor(1024 * rng.normal(0, 0.12, (5000, 64))).astype(np.int64)
    low = m.min(0)
    width = (m.max(0) - low) // 256 + 1
    chunk = {"dim": 64, "ids": np.arange(5000).tobytes(), "low": low.tobytes(), "width": width.tobytes(), "codes": ((m - low) // width).astype(np.uint8).tobytes(), "exact": m.astype(np.int32).tobytes()}
    found, read = vafile.search_chunk(chunk, np.arange(20), m[:20], 10)
    assert read < 20 * 500
    for q, (_, ids, scores) in enumerate(found):
        s = m @ m[q]
        s[q] = -(10**15)
        best = np.lexsort((np.arange(5000), -s))[:10]
        assert list(ids) == list(best) and list(scores) == list(s[best])


PAGES = "page_id long, url string, html string, sha1 int, first int"


def test_archives_come_back(spark, tmp_path):
    rows = [(5, "http://a/x\r\ny", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, None, None), (8, "u", ""), (1, "u", "z" * 400_000), (None, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], PAGES)
    index = warc.write(df, common.shared_path(spark, "warc"), frame_bytes=1000, bundle_bytes=5000)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect())
    d = lambda t: warc.digest_text((t or "").encode())
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[d(t)] = min(least.get(d(t), i), i)
    want = sorted((i or 0, len((t or "").encode()), d(t), "response" if least[d(t)] == i else "revisit", None if least[d(t)] == i else least[d(t)]) for i, _, t in rows)
    assert got == want
    for r in index.collect():  # one record by its place, unpacking its frame alone
        head, block = next(warc.parse(warc.read_record(r.bundle, r.frame, r.at, r.length)))
        assert head["WARC-Record-ID"] == f"<{r.record_id}>"
    fs, path = warc.open_fs(index.first().bundle)
    with fs.open_input_file(path) as f:
        raw = f.read()
    assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE_MAGIC
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() for _ in range(1))
    assert plain.startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.write(df.filter("false"), common.shared_path(spark, "warc"))).count() == 0
    none_small = warc.read(warc.write(df, common.shared_path(spark, "warc"), min_bytes=10)).filter("record_type = 'revisit'").count()
    assert none_small == 0


def test_dialogues_rotate(spark):
    talk = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 1, "ann", "hi"), (2, None, None, "first"), (2, 300, "x", "late"), (3, 0, "system", "alone"), (None, 1, "ann", "no id")]
    df = spark.createDataFrame([(*t, "clash") for t in talk], "conv_id long, turn long, role string, text string, said string")
    got = {(r.conv_id, r.perspective, r.segment): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", -1), (2, "x", -1), (2, "unknown", 1), (2, "x", 1), (None, "ann", 0)}
    r = got[(1, "ann", 0)]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\ntie<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [r.text[m["from"] : m["to"]] for m in r.mask] == ["hi<|im_end|>", "tie<|im_end|>"] and (r.n_turns, r.n_trained) == (4, 2)
    assert [m for m in got[(2, "x", -1)].mask] == []
    assert chat.rotate(df.filter("false")).count() == 0


def test_heavy_segments_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "HEAVY", 20)
    monkeypatch.setattr(chat, "PIECE_ROWS", 10)
    df = spark.createDataFrame([(1, 5, "ann" if i % 2 else "bob", f"t{i}") for i in range(100)], "conv_id long, turn long, role string, text string")
    got = chat.rotate(df).collect()
    assert max(r.n_turns for r in got) < 40 and sum(r.n_turns for r in got) == 200 and sum(r.n_trained for r in got) == 100


def test_heavy_segments_of_the_query_equal_sql(spark, tmp_path):
    """5,000 rows of one turn and 5,000 of a null conv_id, whole and in order; parts of rotate follow the same order."""
    from pyspark.sql import functions as F

    rows = [(1, 5, f"s{i % 3}", f"t{i} é") for i in range(5000)] + [(None, None if i % 2 else i % 7, "ann" if i % 3 else None, f"u{i}") for i in range(5000)]
    rows += [(1, 5, "system", "be kind"), (1, 6, "s1", None), (2, 0, "ann", "hi"), (2, 0, "ann", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(chat.OP1_SQL).fetchall()
    got = chat.op1_chat_rotation(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    parts = chat.rotate(df).filter("conv_id = 1").orderBy("perspective", "segment", "part").collect()
    assert len(parts) > 3 and all(r.text[m["from"] : m["to"]].endswith(chat.CLOSE) for r in parts for m in r.mask)
    for r in got:
        if r.conv_id == 1:
            assert "".join(p.text for p in parts if p.perspective == r.perspective) == r.text
    assert chat.rotate(df.withColumn("role", F.lit("system"))).count() == 0


def test_dialogues_use_no_python(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    owner = {}

    def top(i):
        owner.setdefault(i, i)
        while owner[i] != i:
            i = owner[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            owner[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in owner}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    bag = lambda rows: sorted(tuple(repr(x) for x in r) for r in rows)
    assert bag(got.select(*cols).collect()) == bag(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline_runs_over_all_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, SF, "documents")
    n = docs.count()
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= n
    again = docs
    for name, stage in pipeline.STAGES[:-1]:
        again = common.materialize(stage(spark, again, SF), "again")
        assert again.columns == docs.columns, name
    ids = {r.doc_id: r.text for r in again.collect()}
    import hashlib

    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in ids.items()}
