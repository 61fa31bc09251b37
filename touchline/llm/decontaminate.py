"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `n`
consecutive words of an item; an item of fewer words, but not none, is one window. Documents are
scanned in one pass without a shuffle: rolling window hashes are looked up in the sorted hash set
and every hit is verified by comparing the words themselves.

The test set is broadcast only in blocks of at most about `block_chars` characters, as packed arrays (no more than half as
many windows, of some 26 bytes each); a larger test set is scanned block after block, each pass adding to the
spans found so far, so the result is the same at any size and memory stays bounded.

Defined results: null or empty texts have no words; items without words never match; repeated items
count once by their id's text (a null id reads "null"); repeated rows are scanned one by one; an
empty benchmark leaves every document clean. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm import textbytes as tb

WINDOW = 10
BLOCK_CHARS = 8 << 20


def _block(items: pa.Table, n: int) -> tuple:
    """What is broadcast of a block of items (i, t), as arrays: (index, text, starts, ends, first, ids).

    index: by number of words, the sorted hashes of the windows and the first word of each. text: all items in
    lower case; starts, ends: of its words; first: first word of each item. About 26 bytes a window.
    """
    ids = items.column("i").to_pylist()
    buf, offs = tb.raw_texts(items.column("t").combine_chunks())
    starts, ends, first = tb.words(buf, offs, tb.ALNUM)
    h, counts, index = tb.word_hashes(buf, starts, ends), np.diff(first), {}
    for size in np.unique(np.minimum(counts, n)).tolist():
        if size:
            at = tb.window_starts(first, n) if size == n else first[:-1][counts == size]
            got = tb.window_hashes(h, size)[at]
            order = np.argsort(got, kind="stable")
            index[size] = (got[order], at[order].astype(np.int32))
    return index, tb.LOWER[buf].tobytes(), starts.astype(np.int32), ends.astype(np.int32), first, ids


def _scan_slice(buf, offs, block):
    """(words per row, {row: (covered words, items)}, starts, ends, first). Every hit of a hash is verified word by word."""
    index, text, from_, to, items_first, ids = block
    starts, ends, first = tb.words(buf, offs, tb.ALNUM)
    h = tb.word_hashes(buf, starts, ends)
    hits: dict[int, tuple[set[int], set[str]]] = {}
    low = None
    for size, (hashes, words) in index.items():
        at = tb.window_starts(first, size)
        if not len(at):
            continue
        got = tb.window_hashes(h, size)[at]
        slot = np.searchsorted(hashes, got)
        found = np.flatnonzero(hashes[np.minimum(slot, len(hashes) - 1)] == got)
        for i, j in zip(at[found].tolist(), slot[found].tolist(), strict=True):
            if low is None:
                low = tb.LOWER[buf].tobytes()
            own = [low[a:b] for a, b in zip(starts[i : i + size], ends[i : i + size], strict=True)]
            stop = int(np.searchsorted(hashes, hashes[j], "right"))
            same = [w for w in words[j:stop].tolist() if own == [text[a:b] for a, b in zip(from_[w : w + size], to[w : w + size], strict=True)]]
            if same:
                row = int(np.searchsorted(first, i, "right")) - 1
                covered, named = hits.setdefault(row, (set(), set()))
                covered.update(range(i, i + size))
                named.update(ids[k] for k in (np.searchsorted(items_first, same, "right") - 1).tolist())
    return np.diff(first), hits, starts, ends, first


def _runs(covered: list[int]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for i in covered:
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return [tuple(r) for r in runs]


_SPAN = "array<struct<first:int,last:int,from:int,to:int>>"


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = WINDOW, block_chars: int = BLOCK_CHARS, prefix: str = "", then=None) -> DataFrame:
    """The columns `keep` (which may name text), n_words, hits and items of every row of docs.

    hits: maximal runs of hit words, as word numbers [first, last) and byte offsets [from, to) of
    the text. items: ids, as text, of the benchmark items with an occurring window. prefix: put before
    these three names, where the table has such columns of its own. then: (function of batches, schema) that takes the
    result further in the same Python worker.
    """
    made = [f"{prefix}{c}" for c in ("n_words", "hits", "items")]
    spark = docs.sparkSession
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("i"), benchmark["text"].alias("t"))
    rest = list(dict.fromkeys([*keep, "text"]))
    out = docs.select(*[docs[c] for c in rest], F.lit(0).alias(made[0]), F.expr(f"cast(array() as {_SPAN})").alias(made[1]), F.expr("cast(array() as array<string>)").alias(made[2]))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        shipped = spark.sparkContext.broadcast(_block(part.toArrow(), n))  # at most about block_chars characters
        fields = [f for f in out.schema.fields if blocks > b + 1 or f.name in keep or f.name in made]
        schema = type(out.schema)(fields)
        run = _scanner(shipped, [f.name for f in fields], made, b > 0)
        if then and blocks == b + 1:
            run, schema = _chained(run, then[0]), then[1]
        out = out.mapInArrow(run, schema)
    return out


def _chained(first, second):
    def run(batches):
        yield from second(first(batches))

    return run


def _scanner(shipped, names, made, again):
    def scan(batches):
        block = shipped.value
        for batch in batches:
            n_words, hits, items = [], [], []
            old = [(x.as_py(), y.as_py()) for x, y in zip(batch.column(made[1]), batch.column(made[2]), strict=True)] if again else None
            for lo, hi, buf, offs in tb.slices(batch.column("text")):
                counts, found, starts, ends, first = _scan_slice(buf, offs, block)
                n_words.extend(counts.tolist())
                for row in range(hi - lo):
                    covered, ids = found.get(row, (set(), set()))
                    base = int(first[row])
                    if again:
                        for s in old[lo + row][0]:
                            covered = covered | set(range(s["first"] + base, s["last"] + base))
                        ids = ids | set(old[lo + row][1])
                    at = int(offs[row])
                    hits.append([{"first": a - base, "last": z - base, "from": int(starts[a]) - at, "to": int(ends[z - 1]) - at} for a, z in _runs(sorted(covered))])
                    items.append(sorted(ids))
            spans = pa.array(hits, pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "from", "to")])))
            own = dict(zip(made, (pa.array(n_words, pa.int32()), spans, pa.array(items, pa.list_(pa.string()))), strict=True))
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names=names)

    return scan


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: what was hit, in counts and a digest of the items."""
    found = find(docs, benchmark, ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, s: a + (s["last"] - s["first"]))
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _cut(names: list[str]):
    def run(batches):
        for batch in batches:
            out = []
            for text, hits in zip(batch.column("text"), batch.column(f"{common.OWN}hits"), strict=True):
                spans, text = hits.as_py(), text.as_py()
                if spans:
                    raw, kept, at = text.encode(), [], 0
                    for s in spans:
                        kept.append(raw[at : s["from"]])
                        at = s["to"]
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return run


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "spans") -> DataFrame:
    """docs without the hit spans (mode "spans") or without the contaminated rows ("documents")."""
    if mode == "documents":
        found = find(docs, benchmark, docs.columns, prefix=common.OWN)
        return found.filter(F.size(f"{common.OWN}hits") == 0).select(*docs.columns)
    cut = find(docs, benchmark, docs.columns, prefix=common.OWN, then=(_cut(docs.columns), docs.schema))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM d, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY 1),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.rid = d.rid LEFT JOIN found ON found.rid = d.rid
"""


def brute(texts: list[str | None], items: list[tuple[str, str | None]], n: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """The same by plain comparison, for tests: (words, hit words, item ids) of each text."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        ws, hit, ids = cut(t), set(), set()
        for i, s in items:
            own = cut(s)
            size = min(n, len(own))
            wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
            for k in range(len(ws) - size + 1 if size else 0):
                if tuple(ws[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    ids.add(i)
        out.append((len(ws), len(hit), sorted(ids)))
    return out


def items_sha256(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
