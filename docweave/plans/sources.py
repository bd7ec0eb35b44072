"""Reading, parsing and exporting documents, pages and conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.plans.base import query
from docweave.sources import office
from docweave.sources import readers as R
from docweave.sources.relations import ELEMENTS_SQL, elements, table


@query("WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{2,}'), lambda x: trim(x)), lambda x: x <> '') AS b FROM documents), e AS (SELECT doc_id, unnest(range(0, len(b))) AS i, unnest(b) AS content FROM b) SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN starts_with(content, '#') THEN 'title' WHEN len(list_filter(string_split(content, chr(10)), lambda x: contains(x, '|'))) >= 2 THEN 'table' ELSE 'text' END AS type, sha256(content) AS hash FROM e")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "i", "type", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages""")
def page_markup(spark: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), count(r'href="([^"]*)"').alias("links"), count(r"(<p>)").alias("paragraphs"))


@query("SELECT doc_id, '# ' || source || chr(10) || chr(10) || trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS markdown, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS json, 'lang: \"' || lang || '\"' || chr(10) || 'source: \"' || source || '\"' AS yaml FROM documents")
def exports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.as_markdown(F.col("source"), F.col("text")).alias("markdown"), R.as_json(["doc_id", "lang", "n_chars"]).alias("json"), R.as_yaml({"lang": F.col("lang"), "source": F.col("source")}).alias("yaml"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0 UNION ALL SELECT vec_id, CAST(99 AS INTEGER) FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 7 <> 0")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Fifths replaced, sevenths deleted."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    changed = R.upsert(v, v.where("vec_id % 5 = 0").withColumn("label", F.lit(99)), "vec_id")
    return R.delete(changed, v.where("vec_id % 7 = 0"), "vec_id")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(text, turn) AS opening FROM conversations GROUP BY 1")
def conversation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.min_by("text", "turn").alias("opening"))


#: Characters that a task makes files of, about; bounds the files that a worker is handed at once.
TASK = 8 << 20


def characters(rows: DataFrame, text: Column) -> int:
    return rows.agg(F.sum(F.length(text))).first()[0] or 0


def packed(rows: DataFrame, kind: str, make: Callable[[object], bytes], size: int) -> DataFrame:
    """(path, content): an office file for each row (id, body), made where the row is; ``size``: characters of all bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small files go on together: each batch has a price of its own
        names: list[str] = []
        made: list[bytes] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

        for b in batches:
            for i, body in zip(b.column(0).to_pylist(), b.column(1)):
                names.append(f"{i}.{kind}")
                made.append(make(body.as_py()))
                held += len(made[-1])
                if len(made) == 256 or held > 1 << 20:
                    yield batch()
                    names, made, held = [], [], 0
        if made:
            yield batch()

    # few bytes make much work: rows are dealt to all cores, whatever their size
    dealt = rows.select("id", "body").repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))
    return dealt.mapInArrow(run, "path string, content binary")


def read_back(rows: DataFrame, kind: str, make: Callable[[pa.Array], list[bytes]], size: int) -> DataFrame:
    """Blocks of an office file for each row (id, body), made and read where the row is; ``make`` makes files of many bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256))
        return office.blocks_of((f"{i}.{kind}", file) for b in slices for i, file in zip(b.column(0).to_pylist(), make(b.column(1))))

    dealt = rows.select("id", "body").repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))
    return dealt.mapInArrow(run, office.SCHEMA)


def number() -> Column:
    """The id that a file is named by; null for none."""
    return F.regexp_extract("path", r"^(-?\d+)\.", 1).try_cast("long")


@query(r"""WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
t AS (SELECT doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
y AS (SELECT *, coalesce(sum(CASE WHEN line = '' THEN 10 ELSE 20 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS seq, CASE WHEN n = 0 THEN 'title' ELSE 'text' END AS type, sha256(line) AS hash, CAST(y0 AS DOUBLE) AS y0 FROM y WHERE line <> ''""")
def office_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as DOCX, a paragraph for each line, and read back."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    files = packed(rows, "docx", lambda text: office.docx([("text" if i else "title", line) for i, line in enumerate(text.split("\n"))]), characters(rows, F.col("body")))
    return office.parsed(files).where("error IS NULL").select(number().alias("doc_id"), "seq", "type", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "y0")


@query(rf"""WITH {ELEMENTS_SQL}, t AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS line FROM elements)
SELECT doc_id, page - 1 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER) AS seq, CASE WHEN type = 'heading' THEN 'title' ELSE 'text' END AS type, sha256(line) AS hash,
  round(x0 * 720, 2) AS x0, round(y0 * 540, 2) AS y0, round(x1 * 720, 2) AS x1, round(y1 * 540, 2) AS y1 FROM t WHERE line <> ''""")
def office_slides(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as PPTX, a slide for each page and a shape for each element, and read back."""
    shape = F.struct("seq", "page", "type", "content", "x0", "y0", "x1", "y1")
    rows = elements(spark, d).groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(shape)).alias("body"))

    def slides(shapes: list[dict]) -> bytes:
        out: list[list] = [[] for _ in range(max(s["page"] for s in shapes))]
        for s in shapes:
            out[s["page"] - 1].append(("title" if s["type"] == "heading" else "text", s["content"], s["x0"] * 720, s["y0"] * 540, s["x1"] * 720, s["y1"] * 540))
        return office.pptx(out)

    read = office.parsed(packed(rows, "pptx", slides, characters(table(spark, d, "documents"), F.col("text")))).where("error IS NULL")
    return read.select(number().alias("doc_id"), "page", "seq", "type", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), *(F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(r"""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, '| ' || l_linenumber || ' | ' || l_returnflag || ' | ' || CAST(l_extendedprice AS VARCHAR) || ' |' AS line FROM lineitem)
SELECT l_orderkey AS order_id, 'items' AS name, 20.0 * (1 + count(*)) AS used, sha256('| item | flag | price |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, l_returnflag, l_extendedprice)) AS hash FROM r GROUP BY 1""")
def office_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Every order written as XLSX, a row for each of its items, and read back as tables."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("price"))
    lines = table(spark, d, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("body"))
    head = ("item", "flag", "price")

    def books(orders: pa.Array) -> list[bytes]:
        items = orders.flatten()
        cells = list(zip(*(items.field(c).to_pylist() for c in ("n", "flag", "price"))))
        starts = orders.offsets.to_numpy() - orders.offsets[0].as_py()
        return [office.xlsx([("items", [head, *cells[a:b]])]) for a, b in zip(starts.tolist(), starts[1:].tolist())]

    read = read_back(rows, "xlsx", books, 32 * lines.count()).where("error IS NULL")
    height = F.size(F.split("text", "\n")) - 1
    return read.select(number().alias("order_id"), "name", (height * 20.0).alias("used"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
