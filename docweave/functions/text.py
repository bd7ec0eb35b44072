"""Text expressions: words, sentences, entropies, token counts, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"
#: Words left out where an operator asks for it; fixed values.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()
#: Words of sentiment; fixed values.
POSITIVE = "good great excellent positive success successful profit growth increase improved best win won achievement outstanding strong high up rise".split()
NEGATIVE = "bad poor negative loss decrease decline failed worst weak low down fall fell drop risk concern issue problem challenge difficult".split()


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def without(tokens: Column, stop: list[str]) -> Column:
    listed = F.array(*map(F.lit, stop))
    return F.filter(tokens, lambda x: ~F.array_contains(listed, x))


def sentences(text: Column) -> Column:
    """Cut after ., ! or ? before white space; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normal_hash(text: Column, digits: int = 16) -> Column:
    """SHA-256 of the lower-case text with white space collapsed."""
    return F.substring(F.sha2(F.lower(collapsed(text)).cast("binary"), 256), 1, digits)


def blank_words(text: Column) -> Column:
    """Words between blanks."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def tokens_by_words(text: Column) -> Column:
    """max(1, int(words / 0.75))"""
    return F.greatest(F.lit(1), F.floor(F.size(blank_words(text)) / F.lit(0.75)).cast("int"))


def tokens_of_block(text: Column) -> Column:
    """max(1, int(words * 1.33))"""
    return F.greatest(F.lit(1), F.floor(F.size(blank_words(text)) * F.lit(1.33)).cast("int"))


def tokens_by_chars(text: Column) -> Column:
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("int")


def truncated(text: Column, most: int) -> Column:
    """Cut to ``most`` characters, back to the last space, with an ellipsis; short texts stay."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("...")))


def compressed(text: Column) -> Column:
    """White space collapsed, immediate repeats of a word dropped."""
    return F.regexp_replace(collapsed(text), r"(?<!\S)(\S+)(?: \1(?!\S))+", "$1")


def cleaned(text: Column) -> Column:
    """Runs of blanks become one, three or more line ends become two."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def digest_summary(text: Column) -> Column:
    """First two sentences, the middle one and the last, where there are over four; all of them otherwise."""
    s = sentences(text)
    n = F.size(s)
    picked = F.concat(F.slice(s, 1, 2), F.array(F.get(s, F.floor(n / 2).cast("int")), F.get(s, n - 1)))
    return F.array_join(F.when(n > 4, picked).otherwise(s), " ")


def entropy_of(counts: Column, base: float = 2.0) -> Column:
    """Shannon entropy of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    sum_ = F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, (c / total) * F.log(float(base), c / total)).otherwise(0.0))
    return F.when(total > 0, sum_).otherwise(0.0)


def try_numeric(raw: Column) -> Column:
    """Numbers as tables write them: currency signs and thousands commas go, % divides by 100, K M B T multiply."""
    s = F.trim(F.regexp_replace(raw, r"[$€£¥,]", ""))
    unit = F.upper(F.right(s, F.lit(1)))
    body = F.when(unit.isin("%", "K", "M", "B", "T"), F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    factor = F.when(unit == "%", 0.01).when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return F.when(body.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), body.try_cast("double") * factor)


def quoted_json(row: Column) -> Column:
    return F.to_json(row)
