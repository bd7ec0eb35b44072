"""Language identification by cross-parsing: suffix automata of labelled text, one for each language.

Text is reduced to lower-case letters, single spaces and a stand-in for letters that no training text has.  The commonest
letters are one symbol each, rarer ones (as in Chinese) two or three, so tables stay narrow and no letter is lost.  A language's
automaton recognises every substring of its training text.  A text is parsed greedily: each phrase is the longest that the
automaton still recognises.  Each language is trained on all of its own sample, so a phrase costs log2(training symbols + symbols
of the alphabet) bits: it names a place of the training text, or a symbol.  The language with the fewest bits for each character
wins.  Languages with under ``LEAST`` training letters win only if no language has as many.

All rows of a batch are parsed together, step by step, over dense transition tables, in cuts of ``CUT`` symbols (a phrase
ends at a cut's end, in every language alike).  Training text is a bounded sample: ``chars`` characters for each language.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.  With no labelled text that has a letter every
text is ``und``, and a language whose labelled texts have none is left out.  Equal costs go to the language first in order.  Repeated rows are judged alike; ids may be null.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from docweave.llm.common import aside, per_step, share_of

UND = "und"
#: Training characters for each language.
CHARS = 40_000
#: Training characters in all, which bounds the tables that are sent to the workers.
ALL_CHARS = 400_000
#: Training letters from which a language is told reliably.
LEAST = 1_000
#: Symbols parsed as a unit.
CUT = 512
#: Bytes of text parsed at once; their symbols and states take some twenty times as much.
STEP = 1 << 20
#: Languages learned at most: those with most labelled text.
LANGUAGES = 200
#: Letters of the shared alphabet that are one symbol each, the commonest; all others are written as ``DIGITS`` of a kind.
ALPHABET = 190
#: Symbols that write a rarer letter, most significant first: two of them for the first 4,096 letters, otherwise three for all.
DIGITS = 64


class SuffixAutomaton:
    """All substrings of a sequence of small integers, as a dense table: next state, or -1."""

    def __init__(self, symbols: np.ndarray, width: int):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = now
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        # a last state without edges: where a parse begins, and what follows a symbol that stands nowhere
        self.table = np.full((len(step) + 1, width), -1, dtype=np.int32)
        for state, edges in enumerate(step):
            for c, to in edges.items():
                self.table[state, c] = to

    def phrases(self, rows: np.ndarray) -> np.ndarray:
        """Greedy phrases of each column, one row for each step; a symbol never seen, such as padding, is one by itself."""
        flat, width = self.table.reshape(-1), self.table.shape[1]
        start = np.where(self.table[0] < 0, len(self.table) - 1, self.table[0])
        state = np.full(rows.shape[1], len(self.table) - 1, dtype=np.int32)
        count = np.zeros(rows.shape[1], dtype=np.int32)
        for c in rows:
            to = flat.take(state * width + c)
            stuck = to < 0
            count += stuck
            state = np.where(stuck, start.take(c), to).astype(np.int32, copy=False)
        return count


class Alphabet:
    """Code points to symbols: 0 padding, 1 white space and all that is no letter, 2 letters that no training text has, then those
    of the training text: the ``ALPHABET`` commonest as a symbol each, the others as two or three digits, so none is lost."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).lower().encode("utf-32-le"), np.uint32)
        seen, n = np.unique(points, return_counts=True)
        by_count = sorted((-int(k), int(p)) for p, k in zip(seen, n) if chr(p).isalpha())
        common, rare = sorted(p for _, p in by_count[:ALPHABET]), [p for _, p in by_count[ALPHABET:]]
        self.letters = common
        places = 2 if len(rare) <= DIGITS**2 else 3
        codes = {p: (3 + i, 0, 0) for i, p in enumerate(common)}
        for i, p in enumerate(rare):
            digits = [3 + len(common) + i // DIGITS**k % DIGITS for k in reversed(range(places))]
            codes[p] = (*digits, *[0] * (3 - places))
        self.points = np.array(sorted(codes), dtype=np.uint32)
        self.codes = np.array([codes[p] for p in sorted(codes)], dtype=np.int32).reshape(-1, 3)
        self.width = 3 + len(common) + (DIGITS if rare else 0)
        # the first code points are looked up in a table, which also tells letters from others
        self.low = np.array([2 if chr(i).isalpha() else 1 for i in range(0x3000)], dtype=np.int32)
        under = self.points < len(self.low)
        self.low[self.points[under]] = self.codes[under, 0]
        self.long = np.zeros(len(self.low), dtype=bool)
        self.long[self.points[under]] = self.codes[under, 1] > 0

    def symbols(self, text: str) -> np.ndarray:
        """Runs of what is no letter become one space; leading and trailing ones go."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        out = self.low.take(points, mode="clip")
        high = np.flatnonzero(points >= len(self.low))
        long = self.long.take(points, mode="clip")
        if len(high):
            kinds, of = np.unique(points[high], return_inverse=True)
            at = np.minimum(np.searchsorted(self.points, kinds), max(0, len(self.points) - 1))
            known = self.points[at] == kinds if len(self.points) else np.zeros(len(kinds), bool)
            first = np.array([2 if chr(p).isalpha() else 1 for p in kinds.tolist()], dtype=np.int32)
            first[known] = self.codes[at[known], 0]
            second = np.zeros(len(kinds), bool)
            second[known] = self.codes[at[known], 1] > 0
            out[high], long[high] = first[of], second[of]
        if long.any():
            spelled = self.codes[np.searchsorted(self.points, points[long])]
            n = np.ones(len(points), np.int64)
            n[long] = (spelled > 0).sum(1)
            begin = np.cumsum(n) - n
            out = np.repeat(out, n)
            for k in (1, 2):
                more = spelled[:, k] > 0
                out[begin[long][more] + k] = spelled[more, k]
        keep = out != 1
        if not keep.any():
            return out[:0]
        keep[1:] |= out[:-1] != 1
        out = out[keep]
        return out[int(out[0] == 1) : len(out) - int(out[-1] == 1)]


class Model:
    def __init__(self, texts: dict[str, list[str]], chars: int = CHARS):
        chars = min(chars, ALL_CHARS // max(1, len(texts)))
        self.alphabet = Alphabet([t for lang in sorted(texts) for t in texts[lang]])
        joined = {lang: np.concatenate([np.append(self.alphabet.symbols(t), 1) for t in texts[lang]])[:chars].astype(np.int32) for lang in sorted(texts) if texts[lang]}
        letters = {lang: int((x != 1).sum()) for lang, x in joined.items()}
        self.languages = [lang for lang in joined if letters[lang]]
        self.automata = [SuffixAutomaton(joined[lang], self.alphabet.width) for lang in self.languages]
        self.phrase_bits = np.log2([len(joined[lang]) + self.alphabet.width for lang in self.languages])
        enough = np.array([letters[lang] >= LEAST for lang in self.languages], dtype=bool)
        self.wins = enough if enough.any() else ~enough

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for each character (text x language), and which texts have a letter."""
        found = [self.alphabet.symbols(t or "") for t in texts]
        n = np.array([len(x) for x in found])
        cuts = -(-n // CUT)
        rows = np.zeros((int(cuts.sum()), CUT), dtype=np.int32)
        at = np.cumsum(cuts) - cuts
        flat = rows.reshape(-1)
        for x, i in zip(found, at):
            flat[i * CUT : i * CUT + len(x)] = x
        # full rows are parsed without padding; the last row of each text ends early, so rows are grouped by length
        owner, size = np.repeat(np.arange(len(texts)), cuts), np.full(len(rows), CUT)
        size[(at + cuts - 1)[n > 0]] = (n - (cuts - 1) * CUT)[n > 0]
        out = np.zeros((len(texts), len(self.automata)))
        order = np.argsort(-size, kind="stable")
        full = int((size == CUT).sum())
        for k, machine in enumerate(self.automata):
            counts = np.zeros(len(rows), dtype=np.int64)
            if full:
                counts[order[:full]] = machine.phrases(np.ascontiguousarray(rows[order[:full]].T))
            rest = order[full:]
            for part in np.array_split(rest, max(1, len(rest) // 64)) if len(rest) else []:
                # a padded end adds phrases that all languages share: each pad is one more
                columns = rows[part, : int(size[part[0]])]
                counts[part] = machine.phrases(np.ascontiguousarray(columns.T)) - (columns.shape[1] - size[part])
            np.add.at(out[:, k], owner, counts)
        return out / np.maximum(n, 1)[:, None], n > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: how far the lowest cost lies below the second lowest (1 if one language can win)."""
        rates, lettered = self.rates(texts)
        rates = np.where(self.wins, rates * self.phrase_bits, np.inf)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        best = rates.argmin(axis=1)
        if len(self.languages) > 1:
            low = np.sort(rates, axis=1)
            score = np.clip(1 - low[:, 0] / np.maximum(low[:, 1], 1e-12), 0, 1)
        else:
            score = np.ones(len(texts))
        return [self.languages[i] if ok else UND for i, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def training_texts(docs: DataFrame, where: Column, lang_column: str = "lang", text_column: str = "text", id_column: str = "doc_id", chars: int = CHARS, most_languages: int = LANGUAGES) -> dict[str, list[str]]:
    """A bounded sample of labelled texts for each language: those of smallest id hash that reach twice ``chars``, the longest text
    cut to as much.

    Two scans, whatever the number of languages: one counts, one takes each language's share.  Languages are learned up to
    ``most_languages``, those with most labelled characters, the others not at all.
    """
    labelled = docs.where(where & F.col(lang_column).isNotNull() & (F.length(text_column) > 0))
    sizes = labelled.groupBy(F.col(lang_column).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length(text_column)).alias("chars")).orderBy(F.desc("chars"), "lang").limit(most_languages)
    rank = share_of(F.col(id_column), F.lit("sample"))
    # hashes are even over 64 bits, so this share of them holds about 3 x chars; the rest is never sorted
    share = F.least(F.lit(1.0), 3 * chars / F.col("chars") + 40 / F.col("n"))
    shares = docs.sparkSession.createDataFrame(sizes.select("lang", share.alias("share")).collect(), "lang string, share double")
    source = labelled.select(F.col(lang_column).alias("lang"), rank.alias("rank"), F.substring(text_column, 1, 2 * chars).alias("text"))
    some = source.join(F.broadcast(shares), "lang").where("rank < share").select("lang", "rank", "text")
    rows: dict[str, list[tuple[float, str]]] = {}
    for row in some.collect():  # about 3 x chars for each language
        rows.setdefault(row.lang, []).append((row.rank, row.text))
    return {lang: sample(rows[lang], 2 * chars) for lang in sorted(rows)}


def sample(some: list[tuple[float, str]], chars: int) -> list[str]:
    """Texts in the order of their ranks until they hold ``chars`` characters; each distinct text once."""
    texts: dict[str, None] = {}
    held = 0
    for _, text in sorted(some):
        if held >= chars:
            break
        if text not in texts:
            texts[text] = None
            held += len(text)
    return list(texts)


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows, with ``lang_pred`` and ``score``, which take the place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried, names = aside(docs, docs.columns, ["lang_pred", "score"])
    source = docs.select(*carried, F.col(text_column).alias("_judged"))

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = shared.value.predict(b.column(b.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    schema = StructType(source.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return source.mapInArrow(per_step(judge, "_judged", STEP), schema).toDF(*names, "lang_pred", "score")
