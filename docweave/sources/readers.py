"""Documents in and out: formats, text blocks, ground truth, exports, a vector store of parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of formats in hexadecimal, and extensions.
MAGIC = {"pdf": "25504446", "png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "zip": "504B0304"}
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image", "html": "html", "htm": "html", "md": "markdown", "txt": "text", "wav": "audio", "mp3": "audio"}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, format, hash, length) of every file that fits the pattern, found recursively."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content", "length", detected(F.col("path"), F.col("content")).alias("format"), F.sha2("content", 256).alias("hash"))


def detected(path: Column, content: Column) -> Column:
    """By first bytes, then (for archives too) by extension; unknown otherwise."""
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.lit("unknown")
    for e, f in EXTENSIONS.items():
        by_ext = F.when(ext == e, f).otherwise(by_ext)
    return F.when(F.startswith(head, F.lit(MAGIC["pdf"])), "pdf").when(F.startswith(head, F.lit(MAGIC["png"])) | F.startswith(head, F.lit(MAGIC["jpeg"])) | F.startswith(head, F.lit(MAGIC["gif"])), "image").otherwise(by_ext)


def plain(text: Column) -> Column:
    """Tags and the commonest character references out."""
    t = F.regexp_replace(text, r"<[^>]+>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return t


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, type, content): pieces between blank lines; # makes a title, two lines with | a table."""
    cut = docs.select(key, F.posexplode(F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: F.trim(x)), lambda x: x != "")).alias("i", "content"))
    lines = F.size(F.filter(F.split("content", "\n"), lambda x: F.contains(x, F.lit("|"))))
    return cut.select(key, "i", F.when(F.startswith("content", F.lit("#")), "title").when(lines >= 2, "table").otherwise("text").alias("type"), "content")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A row for each question of ground-truth files (document_id, category, entries)."""
    entry = "struct<question:string,expected_answer:string,expected_pages:array<int>,difficulty:string>"
    j = spark.read.schema(f"document_id string, category string, entries array<{entry}>").option("multiLine", "true").json(path)
    return j.select("document_id", "category", F.explode("entries").alias("e")).select("document_id", "category", "e.*")


def as_json(columns: list[str]) -> Column:
    """Minified, nulls left out."""
    return F.to_json(F.struct(*columns))


def as_markdown(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.trim(F.regexp_replace(body, r"[ \t]+", " ")))


def as_yaml(fields: dict[str, Column]) -> Column:
    """Strings in double quotes, as JSON strings are valid YAML."""
    quoted = lambda c: F.substring_index(F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'^\{"v":(.*)\}$', 1), "\0", 1)
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), quoted(c)) for k, c in fields.items()))


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with rows of ``new`` in place of those that share a key."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")
