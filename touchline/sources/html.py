"""HTML tables as a source: one row a cell, with the header hierarchy of its column.

Files are read by Spark's binaryFile source, so any store works, and parsed where they are read.
The parser is the standard library's; header rows become levels (colspan repeats a name, a blank
over-header is "Unnamed: i_level_k"), body cells keep their text, blanks are null.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The reader travels to executors by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
FLAVOUR = "html.parser"
CELLS = "table_no int, n_rows int, n_cols int, row_no int, col_no int, header array<string>, value string"


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): the first encoding that takes the bytes."""
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1], "replace"), ENCODINGS[-1]


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.open.append({"head": [], "body": [], "in_head": False})
            self.tables.append(self.open[-1])
        elif self.open and tag == "thead":
            self.open[-1]["in_head"] = True
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1]["row"] = []
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            span = lambda k: int(attrs[k]) if re.fullmatch("[0-9]{1,4}", attrs.get(k) or "") and 0 < int(attrs[k]) <= 1000 else 1
            self.cell = {"text": [], "head": tag == "th", "cols": span("colspan"), "rows": span("rowspan")}
        elif tag == "br" and self.cell:
            self.cell["text"].append(" ")

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "thead":
            self._end_row()
            self.open[-1]["in_head"] = False
        elif tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data):
        if self.cell:
            self.cell["text"].append(data)

    def _end_cell(self):
        if self.cell and self.open:
            self.open[-1].setdefault("row", []).append(self.cell)
        self.cell = None

    def _end_row(self):
        self._end_cell()
        t = self.open[-1]
        row = t.pop("row", None)
        if row:
            headers_only = all(c["head"] for c in row) and not t["body"]
            t["head" if t["in_head"] or headers_only else "body"].append(row)


def _grid(rows: list[list[dict]]) -> list[list[str]]:
    """Rows with spans filled in."""
    out: list[dict[int, str]] = [{} for _ in rows]
    for i, row in enumerate(rows):
        j = 0
        for c in row:
            while j in out[i]:
                j += 1
            text = " ".join("".join(c["text"]).split())
            for di in range(min(c["rows"], len(rows) - i)):
                for dj in range(c["cols"]):
                    out[i + di][j + dj] = text
            j += c["cols"]
    width = max((max(r) + 1 for r in out if r), default=0)
    return [[r.get(j, "") for j in range(width)] for r in out]


def parse(text: str) -> Iterator[tuple[int, int, int, list[tuple[int, int, list[str], str | None]]]]:
    """(table, rows, columns, cells) of every table; cells are (row, column, header path, value)."""
    p = _Tables()
    p.feed(text)
    p.close()
    while p.open:
        p._end_row()
        p.open.pop()
    for k, t in enumerate(p.tables):
        head, body = _grid(t["head"]), _grid(t["body"])
        width = max([len(r) for r in [*head, *body]], default=0)
        levels = [r + [""] * (width - len(r)) for r in head] or [[str(j) for j in range(width)]]
        paths = [[level[j] or f"Unnamed: {j}_level_{i}" for i, level in enumerate(levels)] for j in range(width)]
        cells = [(i, j, paths[j], (r[j] if j < len(r) else "") or None) for i, r in enumerate(body) for j in range(width)]
        yield k, len(body), width, cells or [(-1, j, paths[j], None) for j in range(width)]


_ARROW = [pa.int32()] * 5 + [pa.list_(pa.string()), pa.string()]
_NAMES = [c.split()[0] for c in CELLS.split(", ")]


def read(raw: bytes | str | None) -> tuple[list, str | None, str | None]:
    """(tables, encoding, error) of a file's content; a broken file is an error and no tables, never an exception."""
    if raw is None:
        return [], None, "no content"
    try:
        text, encoding = decode(raw) if isinstance(raw, bytes) else (raw, None)
        tables = list(parse(text))
    except Exception as e:  # whatever a damaged file does to the parser
        return [], None, f"{type(e).__name__}: {e}"
    return tables, encoding, None if tables else "no tables found"


def _parse_batches(key: str):
    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(key), batch.column("content"), strict=True):
                for k, rows, cols, cells in read(raw.as_py())[0]:
                    flat = [(k, rows, cols, *c) for c in cells]
                    made = [pa.array([f[i] for f in flat], t) for i, t in enumerate(_ARROW)]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(flat), batch.schema.field(key).type), *made], names=[key, *_NAMES])

    return run


def cells(documents: DataFrame, key: str, content: str) -> DataFrame:
    """All table cells of a column of HTML (text or bytes)."""
    rows = documents.select(documents[key], documents[content].alias("content"))
    return rows.mapInArrow(_parse_batches(key), f"`{key}` {rows.schema[key].dataType.simpleString()}, {CELLS}")


def scan(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n_bytes, encoding, flavour, error, n_tables, shapes): how every file was read, whether it could be or not."""
    rows = documents.select(documents[key], documents[content].alias("content"))

    def run(batches):
        for batch in batches:
            made = [read(x.as_py()) for x in batch.column("content")]
            sizes = [None if x.as_py() is None else len(x.as_py()) for x in batch.column("content").cast(pa.binary())]
            cols = [pa.array(sizes, pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([None if m[2] else FLAVOUR for m in made], pa.string()), pa.array([m[2] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int32()), pa.array([" ".join(f"{r}x{c}" for _, r, c, _ in m[0]) for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(key), *cols], names=[key, "n_bytes", "encoding", "flavour", "error", "n_tables", "shapes"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_bytes long, encoding string, flavour string, error string, n_tables int, shapes string")


def name_pattern(glob: str) -> str:
    """A glob (* and ?) as a regular expression over lower-case names; all other characters stand for themselves."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob.lower()) + "$"


def preferred(found: DataFrame, group: list[str], marker: str = "PL", name: str = "name") -> DataFrame:
    """One file of each group: the first by name of those whose name contains marker, in any case; else the first."""
    order = F.struct((~F.upper(name).contains(marker.upper())).alias("other"), F.col(name).alias("by"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return found.withColumn("_r", rank).filter("_r = 1").drop("_r")


def files(spark: SparkSession, folder: str, pattern: str | tuple[str, ...] = "*.xls") -> DataFrame:
    """(path, name, season, length, content) of every file below folder whose name fits one of the patterns, in any case."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    patterns = "|".join(map(name_pattern, (pattern,) if isinstance(pattern, str) else pattern))
    wanted = raw.withColumn("name", name).filter(F.lower("name").rlike(patterns))
    return wanted.select("path", "name", F.regexp_extract("path", r"(\d{4}-\d{4})", 1).alias("season"), "length", "content")


def stems(found: DataFrame, name: str = "name") -> DataFrame:
    """found with `stem`: the file's name without its extension, trimmed; the name under which a table is known."""
    return found.withColumn("stem", F.trim(F.regexp_replace(name, r"\.[^.]*$", "")))


def register(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Makes every table a temporary view under a name that SQL takes; returns the views' names by stem."""
    views: dict[str, str] = {}
    for stem, table in tables.items():
        view = re.sub(r"\W+", "_", stem.strip().lower()).strip("_") or "table"
        while view in views.values():
            view += "_"
        table.createOrReplaceTempView(view)
        views[stem.strip()] = view
    return views


def final_tables(rows: DataFrame, metrics: list[str], group: str = "season", name: str = "name", kind: str = "kind", team: str = "team", position: str = "row_no") -> DataFrame:
    """(group, name, team, metrics): each group's final table, the first file by name that was classified as Overall.

    rows: the body rows of all files as text. Metrics are whole parts of numbers, null where there is none or rows lack the
    column; rows without a team go; of a team's several rows the last one counts.
    """
    from touchline.functions.parse import tolerant_int

    overall = rows.filter((F.col(kind) == "Overall") & F.col(team).isNotNull())
    first = overall.groupBy(group).agg(F.min(name).alias("_first"))
    chosen = overall.join(first, group).filter(F.col(name) == F.col("_first"))
    values = [(tolerant_int(F.col(m)) if m in rows.columns else F.lit(None).cast("bigint")).alias(m) for m in metrics]
    last = chosen.groupBy(group, name, F.trim(team).alias(team)).agg(F.max_by(F.struct(*values), position).alias("_row"))
    return last.select(group, name, team, *[F.col(f"_row.{m}").alias(m) for m in metrics])


def largest_tables(found: DataFrame, key: str) -> DataFrame:
    """(key, table_no, n_rows, n_cols): the table with most cells, the first of equals."""
    shapes = found.select(key, "table_no", "n_rows", "n_cols").distinct()
    w = Window.partitionBy(key).orderBy((F.col("n_rows") * F.col("n_cols")).desc(), "table_no")
    return shapes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def tables_with(found: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, table_no): the first table with all the named columns; else the longest."""
    leaf = F.lower(F.element_at("header", -1))
    per = found.groupBy(key, "table_no", "n_rows").agg(F.collect_set(leaf).alias("_leaves"))
    has = F.size(F.array_except(F.array(*[F.lit(n.lower()) for n in names]), "_leaves")) == 0
    w = Window.partitionBy(key).orderBy(has.desc(), F.when(has, 0).otherwise(-F.col("n_rows")), "table_no")
    return per.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, "table_no")


def inspect(found: DataFrame, key: str) -> DataFrame:
    """One row a table: shape, header levels, schema signature, content fingerprint, paths and empty cells."""
    from touchline.functions.parse import signature

    body = F.col("row_no") >= 0
    cell = F.concat_ws("\x1f", F.col("row_no").cast("string"), F.col("col_no").cast("string"), F.coalesce("value", F.lit("")))
    half = F.conv(F.substring(F.md5(cell.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    per = found.groupBy(key, "table_no", "n_rows", "n_cols").agg(
        F.count_if(body & F.col("value").isNull()).alias("empty_cells"), F.sum(F.when(body, half)).alias("_sum"), F.collect_set(F.struct("col_no", "header")).alias("_heads")
    )
    heads = F.transform(F.array_sort("_heads"), lambda h: h["header"])
    return per.select(key, "table_no", "n_rows", "n_cols", "empty_cells", heads.alias("paths"), F.size(F.get(heads, F.lit(0))).alias("levels"), signature(heads).alias("schema_signature"), F.md5(F.coalesce(F.col("_sum").cast("string"), F.lit("")).cast("binary")).alias("content_md5"))


def wide(found: DataFrame, key: str, columns: dict[tuple[str, ...], str]) -> DataFrame:
    """One row a body row, with the named header paths as columns."""
    value = lambda p: F.max(F.when(F.col("header") == F.array(*map(F.lit, p)), F.col("value")))
    return found.filter("row_no >= 0").groupBy(key, "table_no", "row_no").agg(*[value(p).alias(n) for p, n in columns.items()])
