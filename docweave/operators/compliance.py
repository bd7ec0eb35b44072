"""Screening, redaction, versions, audit chains, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from docweave.functions import text as T
from docweave.operators.graphs import written
from docweave.operators.text_stats import meeting_sets

#: What screening looks for.
INJECTION = ["ignore (all )?(previous|prior) instructions", "disregard (the )?(above|system)", "you are now"]
THREATS = {
    "sql_injection": ("high", r"(union\s+select|drop\s+table|or\s+1\s*=\s*1)"),
    "xss": ("high", r"(<script|javascript:|onerror\s*=)"),
    "traversal": ("medium", r"(\.\./|\.\.\\)"),
    "secret": ("low", r"(password\s*=|api[_-]?key\s*=)"),
}
PII = {"ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}


def pii_counts(text: Column) -> dict[str, Column]:
    return {k: F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))) for k, p in PII.items()}


def redacted(text: Column) -> Column:
    for k, p in PII.items():
        text = F.regexp_replace(text, p, f"<{k.upper()}_REDACTED>")
    return text


def threats(docs: DataFrame, by: str, text: str) -> DataFrame:
    """(by, threat, severity, found): the first match of each kind."""
    low = F.lower(F.col(text))
    kinds = F.array(*(F.struct(F.lit(k).alias("threat"), F.lit(s).alias("severity"), F.regexp_extract(low, p, 1).alias("found")) for k, (s, p) in THREATS.items()))
    return docs.select(by, F.explode(F.filter(kinds, lambda x: x["found"] != "")).alias("t")).select(by, "t.*")


def gate(docs: DataFrame, by: str, text: str, most: int) -> DataFrame:
    """(by, verdict): reject on an injection pattern, quarantine if empty or over ``most`` characters, else pass."""
    bad = F.lit(False)
    for p in INJECTION:
        bad = bad | F.lower(F.col(text)).rlike(p)
    n = F.length(F.coalesce(text, F.lit("")))
    return docs.select(by, F.when(bad, "reject").when((n == 0) | (n > most), "quarantine").otherwise("pass").alias("verdict"))


def version_diff(old: DataFrame, new: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., change): insert, delete or update."""
    a, b = old.select(*key, F.col(text).alias("old"), F.lit(True).alias("in_old")), new.select(*key, F.col(text).alias("new"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).where("change IS NOT NULL")


def chained(events: DataFrame, by: str, order: list[str], payload: Column) -> DataFrame:
    """With ``own``, the hash of the previous hash and the payload, and ``previous``, the hash before it in its chain.

    A chain is made in order, so one chain's rows pass through one task, sorted; a task holds one hash, not a chain.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.withColumn("_payload", payload).repartition(n, by).sortWithinPartitions(by, *order)
    at = rows.columns.index(by)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, ""
        for b in batches:
            own, previous = [], []
            for key, text in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if chain is None or key != chain[0]:
                    chain, last = (key,), ""
                previous.append(last)
                last = hashlib.sha256(f"{last}|{text or ''}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.string()), pa.array(previous, pa.string())], [*b.schema.names[:-1], "own", "previous"])

    schema = StructType(rows.schema.fields[:-1]).add("own", StringType()).add("previous", StringType())
    return rows.mapInArrow(link, schema)


def broken_links(chain: DataFrame, by: str, order: list[str], payload: Column) -> DataFrame:
    """Rows whose hash does not follow from their payload and the hash before, or whose link is not their predecessor's hash."""
    before = F.coalesce(F.lag("own").over(Window.partitionBy(by).orderBy(*order)), F.lit(""))
    again = F.sha2(F.concat_ws("|", "previous", F.coalesce(payload, F.lit(""))).cast("binary"), 256)
    return chain.withColumn("before", before).withColumn("again", again).where("own != again OR previous != before").drop("before", "again")


def best_evidence(claims: DataFrame, known: DataFrame, least: float = 0.3, partial: float = 0.4, full: float = 0.75) -> DataFrame:
    """(claim_id, known_id, similarity, status): the known text nearest to each claim by Jaccard of words, at least ``least``.

    Claims of equal words are compared once, and of known texts of equal words the one of smallest id stands for all.  Only texts that
    share several of their rarest words meet (``meeting_sets``).
    """

    def sets(df: DataFrame, key: str, text: str) -> DataFrame:
        w = F.array_sort(F.array_distinct(T.words(F.col(text))))
        return df.select(F.col(key).alias("id"), w.alias("w")).where("size(w) > 0").withColumn("words", F.sha2(F.array_join("w", "\x01").cast("binary"), 256))

    c, k = sets(claims, "claim_id", "claim"), sets(known, "known_id", "known")
    once = lambda df, side: df.groupBy("words").agg(F.min(F.struct("id", "w")).alias("m")).select("words", "m.id", "m.w", F.lit(side).alias("side"))
    both_sides = written(once(c, 0).unionByName(once(k, 1)), "sets")
    met = written(meeting_sets(both_sides.select("id", "side", "w"), least), "met")
    x, y = both_sides.where("side = 0").select(F.col("id").alias("a"), "words", F.col("w").alias("cw")), both_sides.where("side = 1").select(F.col("id").alias("b"), F.col("w").alias("kw"))
    both = F.size(F.array_intersect("cw", "kw"))
    scored = met.join(x, "a").join(y, "b").select("words", F.col("b").alias("known_id"), (both / (F.size("cw") + F.size("kw") - both)).alias("s")).where(F.col("s") >= least)
    best = scored.groupBy("words").agg(F.min_by(F.struct("known_id", "s"), F.struct(-F.round("s", 9), F.col("known_id"))).alias("b"))
    status = F.when(F.col("s") >= full, "supported").when(F.col("s") >= partial, "partially_supported").otherwise("unverified")
    found = c.select(F.col("id").alias("claim_id"), "words").join(best, "words").select("claim_id", "b.known_id", "b.s").select("claim_id", "known_id", F.col("s").alias("similarity"), status.alias("status"))
    return claims.select("claim_id").join(found, "claim_id", "left").select("claim_id", "known_id", F.coalesce("similarity", F.lit(0.5)).alias("similarity"), F.coalesce("status", F.lit("unverified")).alias("status"))


#: Two or more capitalised words in a row.
NAMES = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"


def unknown_names(responses: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name): names in responses that no source has."""
    of = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(NAMES), F.lit(1))).alias("name"))
    known = of(sources).select(F.lower("name").alias("lower")).distinct()
    return of(responses, key).withColumn("lower", F.lower("name")).join(known, "lower", "left_anti").select(key, "name")


def grounded(claims: DataFrame, sources: DataFrame, block: str, text: str, limit: float = 0.5) -> DataFrame:
    """(block, overlap, grounded): share of a claim's distinct long words that its source holds."""
    long_words = lambda c: F.array_distinct(F.filter(T.words(F.col(c)), lambda x: F.length(x) >= 4))
    c, s = claims.select(block, long_words(text).alias("c")), sources.select(block, long_words(text).alias("s"))
    share = F.when(F.size("c") > 0, F.size(F.array_intersect("c", F.coalesce("s", F.array().cast("array<string>")))) / F.size("c")).otherwise(0.0)
    return c.join(s, block, "left").select(block, share.alias("overlap"), (share >= limit).alias("grounded"))


def set_scores(found: Column, expected: Column) -> dict[str, Column]:
    """true and false positives, false negatives of two sets."""
    return {"tp": F.size(F.array_intersect(found, expected)), "fp": F.size(F.array_except(found, expected)), "fn": F.size(F.array_except(expected, found))}


def token_f1(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(T.words(a)), F.array_distinct(T.words(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) + F.size(y) > 0) & (both > 0), 2 * both / (F.size(x) + F.size(y))).otherwise(0.0)


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1)."""
    n = df.groupBy(true, predicted).agg(F.count("*").alias("n"))
    c = n.select(F.explode(F.array(F.struct(F.col(true).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))).alias("e"))
    g = c.groupBy(F.col("e.c").alias("class")).agg(F.sum("e.support").alias("support"), F.sum("e.said").alias("said"), F.sum("e.tp").alias("tp"))
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return g.select("class", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def page_references(question: Column) -> Column:
    """Pages that a question names, singly or in lists, sorted; null if none."""
    lists = F.regexp_extract_all(question, F.lit(r"(?i)\b(pages?\s+\d+(?:\s*[,&and]+\s*\d+)*|pg\.?\s*\d+|p\.\d+)"), F.lit(1))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(lists, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))))))
    return F.when(F.size(found) > 0, found)


def glob(topic: Column, pattern: str) -> Column:
    """Whether a topic fits a pattern in which * stands for anything."""
    import re

    return topic.rlike("^" + ".*".join(map(re.escape, pattern.split("*"))) + "$")


def entities(docs: DataFrame, by: str, text: str, families: dict[str, str]) -> DataFrame:
    """(by, type, entity): every match of each family's pattern, lower case."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("type"), F.lower(x).alias("entity")))

    return docs.select(by, F.explode(F.concat(*(found(k, p) for k, p in families.items()))).alias("e")).select(by, "e.type", "e.entity")


def checked_citations(cited: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, seq, status) of citations (doc_id, seq, page, excerpt): exact on its page, partial elsewhere in its document, none,
    or missing where there is no such page."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "content")))
    pages = elements.groupBy("doc_id", "page").agg(F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("body"))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n").alias("whole"))
    j = cited.join(pages, ["doc_id", "page"], "left").join(whole, "doc_id")
    status = F.when(F.col("body").isNull(), "missing").when(F.contains("body", "excerpt"), "exact_match").when(F.contains("whole", "excerpt"), "partial_match").otherwise("no_match")
    return j.select("doc_id", "seq", status.alias("status"))
