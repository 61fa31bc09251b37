"""Byte-level BPE: encoding by a fold of ranked merges, decoding by concatenating pieces.

Texts are cut into pieces by the tokenizer's pattern (in numpy, over character classes). A
dictionary of distinct pieces is encoded by one expression of Spark's higher-order functions: a
piece's bytes, spelled in hexadecimal, are folded, joining at each step the neighbours of the lowest
rank, found in a literal rank map (an array of small maps, chosen by crc32, so that a lookup stays
short). The dictionary is broadcast; it holds at most `HEAD_WORDS` pieces, the most frequent by exact
counts over every whole text, and only saves work: a piece outside it is merged where it
stands, by the same ranks. (Folding those too costs about 80 microseconds a piece in Spark's interpreted
functions, over the limit of CPU time; the README has the figures.) No shuffle touches the texts.

Defined results: null and empty texts have no tokens; repeated rows are encoded one by one. The
vocabulary's path is a parameter. Pieces are found in the dictionary by 64-bit hashes; a text that its pieces do not
spell again is merged piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import common
from touchline.llm import textbytes as tb

HEAD_WORDS = 1 << 17
COUNTED = 1 << 18
MEMO_PIECES = 1 << 15
FOLD_BYTES = 96
RANK_BUCKETS = 1 << 14
SLOTS = 1 << 20
# The white space of Unicode.
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_classes: list[np.ndarray] = []


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of a token and its rank on every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        import regex

        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        table = np.zeros(0x110000, np.uint8)
        for k, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            found = "".join(regex.findall(pattern, every))
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
        table[list(WHITE)] = _SPACE
        _classes.append(table)
    return _classes[0]


def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first piece of each row): the matches of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(at)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    row_at = np.searchsorted(at, offs)
    fresh = np.zeros(n, bool)
    fresh[row_at[:-1][row_at[:-1] < n]] = True
    change = fresh.copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    of = kind[run]
    goes_on = np.append(~fresh[run[1:]], False)
    begins = change
    # The last white space before other text stands alone, or leads that text if it is a blank.
    gap = np.flatnonzero((of == _SPACE) & goes_on)
    begins[end[gap] - 1] = True
    lead = gap[code[end[gap] - 1] == 32]
    begins[end[lead]] = False
    led = np.zeros(len(run), bool)
    led[lead + 1] = True
    # A lone apostrophe takes the letters of a contraction.
    tick = np.flatnonzero((of == _OTHER) & (end - run == 1) & goes_on & ~led)
    tick = tick[code[run[tick]] == 39]
    tick = tick[of[tick + 1] == _LETTER]
    if len(tick):
        a = run[tick + 1]
        size = end[tick + 1] - a
        x, y = code[a], code[np.minimum(a + 1, n - 1)]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = (size > 1) & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        takes = np.where(one, 1, np.where(two, 2, 0))
        ok = takes > 0
        begins[a[ok]] = False
        rest = ok & (size > takes)
        begins[(a + takes)[rest]] = True
    starts = np.flatnonzero(begins)
    begin = at[starts]
    return begin, np.append(begin[1:], len(buf)), np.searchsorted(starts, row_at)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: array of maps from hexadecimal tokens to ranks."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for token, rank in ranks.items():
        name = token.hex().upper()
        buckets[zlib.crc32(name.encode()) % RANK_BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def fold(word: Column, ranks: Column) -> Column:
    """Token ids of a binary piece: the fold of ranked merges."""

    def rank(table, name):
        return F.element_at(F.element_at(table, (F.crc32(name.cast("binary")) % RANK_BUCKETS + 1).cast("int")), name)

    def merges(table, parts):
        # acc: the pieces, and the rank of each piece joined with its right neighbour (the last has none)
        def ranked(p):
            return F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, rank(table, F.concat(x, F.get(p, i + 1)))))

        def step(acc, _):
            return let(
                F.array_min(acc["r"]),
                lambda low: F.when(low.isNull(), acc).otherwise(let(F.array_position(acc["r"], low).cast("int"), lambda k: join(acc, k))),
            )

        def join(acc, k):
            p, r = acc["p"], acc["r"]
            merged = F.concat(F.element_at(p, k), F.element_at(p, k + 1))
            size = F.size(p)

            def rebuilt(m):
                right = F.when(k + 2 <= size, rank(table, F.concat(m, F.get(p, k + 1))))
                left = F.when(k > 1, F.array(rank(table, F.concat(F.get(p, k - 2), m)))).otherwise(F.expr("cast(array() as array<int>)"))
                pieces = F.concat(F.slice(p, F.lit(1), k - 1), F.array(m), F.slice(p, k + 2, size))
                known = F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, F.array(right), F.slice(r, k + 2, size))
                return F.struct(pieces.alias("p"), known.alias("r"))

            return let(merged, rebuilt)

        zero = F.struct(parts.alias("p"), ranked(parts).alias("r"))
        rounds = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
        return F.aggregate(rounds, zero, step, lambda acc: F.transform(acc["p"], lambda x: rank(table, x)))

    return let(ranks, lambda table: let(letters_of(word), lambda parts: merges(table, parts)))


def letters_of(word: Column) -> Column:
    """The bytes of a nonempty binary piece, each in hexadecimal."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.hex(F.substring(word, i, F.lit(1))))


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a short piece: the lowest-ranked neighbours are joined until none are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joins = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
    while joins:
        low = min(joins)
        if low == 1 << 30:
            break
        i = joins.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i:
            joins[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        if i < len(joins):
            joins[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
    return [ranks[x] for x in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by a heap of candidate merges: n log n, for pieces too long to fold."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        live[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def _pieces(batches):
    """(piece, count) of every text, added up in the worker; a full table is handed on and begun anew."""

    def added(parts):
        table = pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return table.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    parts, size = [], 0
    for batch in batches:
        for _, _, whole, offs in tb.slices(batch.column("text")):
            points = split_points(whole) if len(offs) == 2 else [0, len(whole)]
            for lo, hi in zip(points, points[1:], strict=False):
                buf = whole[lo:hi]
                starts, ends, _ = cut(buf, offs if len(points) == 2 else np.array([0, hi - lo]))
                # pieces follow each other without a gap, so their starts are the offsets of a binary column
                at = np.append(starts, ends[-1:]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(buf.tobytes())])
                found = words.filter(pa.array(ends - starts <= FOLD_BYTES)).value_counts()
                parts.append(pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"]))
                size += len(found)
                if size >= 4 * COUNTED:
                    parts = added(parts)
                    size = sum(x.num_rows for x in parts)
                    if size >= COUNTED:
                        yield from parts
                        parts, size = [], 0
    if parts:
        yield from added(parts)


class Head:
    """The dictionary and the ranks as a worker uses them.

    It is broadcast as plain bytes, arrays and a dict (`plain_head`), so executors need no copy of this package,
    and is built once a worker process.
    """

    def __init__(self, words: bytes, lengths: np.ndarray, flat: np.ndarray, sizes: np.ndarray, ranks: dict[bytes, int]):
        at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        raw, h = np.frombuffer(words, np.uint8), np.zeros(len(lengths), np.uint64)
        for lo in range(0, len(h), 1 << 14):  # a hash depends on the piece's bytes alone
            own = at[lo : lo + (1 << 14) + 1]
            h[lo : lo + (1 << 14)] = tb.span_hashes(tb.prefix_sums(raw[own[0] : own[-1]]), own[:-1] - own[0], own[1:] - own[0])
        self.ranks, self.sizes = ranks, sizes.astype(np.int64)
        self.slot = np.full(SLOTS + 8, -1, np.int32)
        left = np.arange(len(h), dtype=np.int32)
        for probe in range(2):  # a piece that finds no slot is merged like any other
            where = (h[left] & np.uint64(SLOTS - 1)).astype(np.int64) + probe
            free = self.slot[where] < 0
            self.slot[where[free]] = left[free]
            left = left[self.slot[where] != left]
        self.hash = np.append(h, np.uint64(0))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        cuts = np.concatenate(([0], np.cumsum(self.sizes))).tolist()
        ids = flat.tolist()
        self.shown = [self.show(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.plain = [self.decode(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.memo: dict[bytes, tuple[str, bytes, int]] = {}

    def show(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece in the dictionary, or -1."""
        where = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.slot[where]
        out[self.hash[out] != h] = -1
        miss = np.flatnonzero(out < 0)
        again = self.slot[where[miss] + 1]
        again[self.hash[again] != h[miss]] = -1
        out[miss] = again
        return out

    def merge(self, piece: bytes) -> tuple[str, bytes, int]:
        """(ids in print, decoded bytes, number of ids) of a piece outside the dictionary."""
        known = self.memo.get(piece)
        if known is None:
            ids = merge_short(piece, self.ranks) if len(piece) <= FOLD_BYTES else merge_long(piece, self.ranks)
            known = (self.show(ids), self.decode(ids), len(ids))
            if len(piece) <= FOLD_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = known
        return known


def split_points(buf: np.ndarray) -> list[int]:
    """Where a long text may be cut between pieces: at a blank between ASCII letters or digits, about every `tb.STRETCH` bytes."""
    out, at, plain = [0], 0, tb.ALNUM & (np.arange(256) < 128)
    while len(buf) - at > 2 * tb.STRETCH:
        lo = at + tb.STRETCH
        found = None
        while found is None and lo < len(buf) - 1:
            own = buf[lo - 1 : lo + tb.STRETCH + 1]
            ok = np.flatnonzero((own[1:-1] == 32) & plain[own[:-2]] & plain[own[2:]])
            found, lo = (lo + int(ok[0]) if len(ok) else None), lo + tb.STRETCH
        if found is None:
            break
        out.append(found)
        at = found
    return [*out, len(buf)]


def encode_rows(head: Head, buf: np.ndarray, offs: np.ndarray):
    """(number of ids, ids in print, decoded bytes) of each row."""
    starts, ends, first = cut(buf, offs)
    got = head.find(tb.span_hashes(tb.prefix_sums(buf), starts, ends))
    miss = np.flatnonzero(got < 0)
    raw = buf.tobytes()
    own = [head.merge(raw[a:b]) for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
    counts = head.sizes[got] if len(head.sizes) else np.zeros(len(got), np.int64)
    counts[miss] = [x[2] for x in own]
    totals = np.diff(np.concatenate(([0], np.cumsum(counts)))[first]).tolist()
    number = got.tolist()
    texts, backs = [head.shown[i] for i in number] if head.shown else [""] * len(number), [head.plain[i] for i in number] if head.plain else [b""] * len(number)
    for i, x in zip(miss.tolist(), own, strict=True):
        texts[i], backs[i] = x[0], x[1]
    for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        text, back, n = " ".join(texts[a:b]), b"".join(backs[a:b]), totals[row]
        if back != raw[offs[row] : offs[row + 1]]:  # a piece was taken for another of the same hash
            each = [head.merge(raw[x:y]) for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            text, back, n = " ".join([x[0] for x in each]), b"".join([x[1] for x in each]), sum(x[2] for x in each)
        yield n, text, back


def _encode(shipped, names, with_ids):
    def run(batches):
        held = shipped.value  # a dict that lives as long as the worker process
        if "head" not in held:
            held["head"] = Head(*held.pop("plain"))
        head = held["head"]
        for batch in batches:
            for lo, hi, buf, offs in tb.slices(batch.column("text")):
                totals, shas, decoded, all_ids = [], [], [], []
                if hi - lo == 1 and len(buf) > 2 * tb.STRETCH:  # a long text, stretch by stretch
                    sha, back_sha, n, ids, gap = hashlib.sha256(), hashlib.sha256(), 0, [], b""
                    points = split_points(buf)
                    for a, b in zip(points, points[1:], strict=False):
                        count, text, back = next(encode_rows(head, buf[a:b], np.array([0, b - a])))
                        sha.update(gap + text.encode())
                        back_sha.update(back)
                        n, gap = n + count, b" "
                        ids += [np.array(text.split(), np.int32)] if with_ids else []
                    totals, shas, decoded, all_ids = [n], [sha.hexdigest()], [back_sha.hexdigest()], [np.concatenate(ids)] if with_ids else []
                else:
                    for n, text, back in encode_rows(head, buf, offs):
                        totals.append(n)
                        shas.append(hashlib.sha256(text.encode()).hexdigest())
                        decoded.append(hashlib.sha256(back).hexdigest())
                        if with_ids:
                            all_ids.append(np.array(text.split(), np.int32))
                made = [pa.array(totals, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                made += [pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []
                kept = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), *made], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if with_ids else [])])

    return run


def _fields(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)


def plain_head(docs: DataFrame, ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, dict[bytes, int]]:
    """The dictionary of frequent pieces, folded: what `Head` is made of."""
    texts = docs.select(docs["text"]).filter(F.length("text") > 0)
    counted = texts.mapInArrow(_pieces, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # counts up to 4096 are levels of their own, larger ones share a level with those of a few thousandths more
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 342))
    counted = common.materialize(counted.select("word", level.alias("level")), "piece-counts")
    least, left = None, HEAD_WORDS  # pieces that occur at least so often fit, whole levels at a time
    for n, kinds in sorted(map(tuple, counted.groupBy("level").agg(F.count("*").alias("kinds")).collect()), reverse=True):
        left -= kinds
        if left < 0:
            break
        least = n
    frequent = counted.filter(F.col("level") >= least).select("word") if least is not None else counted.select("word").limit(0)
    frequent = common.materialize(frequent.repartition(24), "frequent-pieces")
    # a plan without an exchange: its text, with the literal map in it, is made once and not again at every stage
    got = frequent.select("word", fold(F.col("word"), rank_map(ranks)).alias("ids")).toArrow()
    common.discard(counted, frequent)
    words, column = got.column("word").to_pylist(), got.column("ids").combine_chunks()
    return b"".join(words), np.array([len(w) for w in words], np.int64), column.flatten().to_numpy().astype(np.int32), column.value_lengths().to_numpy(), ranks


def encode(docs: DataFrame, vocabulary: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 and decoded_sha256 (and token_ids) of every row."""
    common.small_batches(docs.sparkSession)
    ranks = load_ranks(vocabulary)
    head = docs.sparkSession.sparkContext.broadcast({"plain": plain_head(docs, ranks)})
    rows = docs.select(*[docs[c] for c in dict.fromkeys([*keep, "text"])])
    return rows.mapInArrow(_encode(head, keep, with_ids), _fields(docs, keep) + "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else ""))


def _decode(shipped, names, ids):
    def run(batches):
        tokens = shipped.value
        for batch in batches:
            out = [b"".join([tokens[i] for i in x.as_py() or ()]) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str, keep: list[str], ids: str = "token_ids") -> DataFrame:
    """The columns `keep` and decoded (binary): the tokens' pieces, concatenated."""
    tokens = {rank: token for token, rank in load_ranks(vocabulary).items()}
    shipped = encoded.sparkSession.sparkContext.broadcast(tokens)
    rows = encoded.select(*[encoded[c] for c in dict.fromkeys([*keep, ids])])
    return rows.mapInArrow(_decode(shipped, keep, ids), _fields(encoded, keep) + "decoded binary")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id"])
