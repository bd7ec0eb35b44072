"""Main text of web pages by consensus of a host's pages.

Pass one scores each page's containers: the text that stands in them outside boilerplate, less what stands in links, and
notes the best one's generalised path (tags with their classes, digits left out).  Spark adds up these votes for each host.
Pass two extracts every page from the containers on its host's winning path; a page that has none, or clearly less text there,
falls back to its own best container.  That is the article or main element with most text, or else the deepest container of the best
score: it loses no unlinked text.  From there the search goes down into a container inside only if it leaves behind under a tenth of the
score, all of it in other containers of another kind; text beside a container, as a lead, and sections alike stay together.

Boilerplate inside a container is left out, on three grounds.  *Tags and roles* (navigation, headers, footers, asides, forms,
scripts, dialogs).  *Names*: a class or id all of whose parts are boilerplate words or words for parts of a page ("sidebar",
"comment-list", "page-header").  *Hints*: a class or id with such a word among others ("jetpack-related-posts").  A word that a
modifier leads or follows says nothing ("has-sidebar", "no-comments", "menu-open"), and of a single paragraph, heading or list item
only words for adverts and notices count.  An element that holds an article or main element of its own is a wrapper, whatever its
name; one judged by a hint, and a form, is also kept if it holds over half of the page's text, and one judged by its name if it holds
over four fifths (readers' comments may well outweigh an article) and no article or main element has text elsewhere; of a page that would lose all of
its text the largest one stays.  Blocks are the runs of text between block-level tags.

A page is read once from left to right; the work is linear in its length, however deep or broken its tags are.

Edge cases: null and empty pages give empty text.  Unclosed and stray tags are tolerated: an end tag closes to its nearest
open tag, if any; inline tags close nothing.  Text without any tag is one block.  Pages with null urls share the host "".
Repeated pages are extracted each; page ids may repeat or be null.  ``text`` and ``host_path`` take the place of kept columns of
these names.
"""

from __future__ import annotations

import html as entities
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from docweave.llm.common import aside, materialize, per_step
from docweave.llm.url_filter import host_of

#: A comment, declaration, or tag with its name and attributes; the last alternative is a tag that the page's end cuts off.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?=/?[A-Za-z])[^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[^a-z]+")
# fixed values: element names by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in "script style textarea iframe title noembed noframes xmp".split()}
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section td".split())
SKIPPED = frozenset("nav header footer aside button menu dialog label fieldset head noscript template svg object canvas audio video select".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SKIPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header menu menus modal nav navbar navigation newsletter notice notices popup promo promos promotion related respond share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words for parts of a page, which leave a boilerplate word beside them as it is.
PLACES = frozenset("area bar block body bottom box button buttons col column container content entry footer global group holder inner item items left links list main outer page panel post posts primary right row secondary section site slot text thread top unit wrap wrapper".split())
#: Words that turn a boilerplate word into the state of something else.
MODIFIERS = frozenset("has is no not with without open opened closed hide hidden hides show shows shown enabled disabled active inactive sticky fixed layout under below above after before toggle toggled off on".split())
#: Elements that an opening tag of the same kind closes, and those beyond which it doesn't look.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPES = CONTAINER | frozenset("ul ol dl table blockquote".split())
#: Of these names, those that a paragraph of its own may have; elements that hold one paragraph.
SKIPPED_LINES = frozenset("ad ads adv advert adverts advertisement advertising consent cookie cookies gdpr newsletter notice notices popup promo promos signup sponsor sponsored subscribe".split())
LINES = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary".split())
#: Share of a page's best container's text that its host's path must give, or the page's own container is taken.
ENOUGH = 0.8
#: Share of the score that a container inside must have for the search to go on there.
DESCEND = 0.9
#: Why an element is boilerplate: surely; unless it holds an article; unless it also holds over half of the text.
SURE, NAMED, HINTED = 1, 2, 3
#: Shares of the page's text beyond which an element is a wrapper all the same.
WRAPS = {NAMED: 0.8, HINTED: 0.5}


class Container:
    __slots__ = ("path", "depth", "first", "last", "chars", "linked", "inner")

    def __init__(self, path: int, depth: int, first: int):
        self.path, self.depth, self.first, self.last = path, depth, first, -1
        self.chars = self.linked = 0
        self.inner: list[Container] = []

    def score(self) -> float:
        """Text less linked text; deeper containers win ties, as those around them hold no more."""
        return self.chars - 2 * self.linked + 1e-6 * self.depth


class Suspect:
    """An element that may be boilerplate, and the blocks it holds."""

    __slots__ = ("why", "first", "last", "holds")

    def __init__(self, why: int, first: int):
        self.why, self.first, self.last, self.holds = why, first, -1, False


def judged_name(value: str, words: frozenset[str] = SKIPPED_NAMES) -> int:
    """What the tokens of a class or id say: NAMED, HINTED or 0."""
    found = 0
    for token in value.lower().split():
        parts = [p for p in NAME_PARTS.split(token) if p]
        said = [p for p in parts if p in words]
        if said and not any(p in MODIFIERS for p in parts):
            if all(p in SKIPPED_NAMES or p in PLACES for p in parts):
                return NAMED
            found = HINTED
    return found


def boilerplate(tag: str, attributes: str) -> int:
    """SURE, NAMED, HINTED or 0."""
    if tag in SKIPPED:
        return SURE
    found = HINTED if tag == "form" else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            why = judged_name(value, SKIPPED_LINES if tag in LINES else SKIPPED_NAMES)
            # an article is one unless it is a comment or an advert by its whole name
            found = min(found or why, why or found) if tag != "article" or why == NAMED else found
        elif name == "role":
            if value.strip().lower() in SKIPPED_ROLES:
                found = NAMED
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return SURE
    return found


def general(tag: str, attributes: str) -> str:
    """A tag with its sorted classes, digits left out."""
    if "class" not in attributes.lower():
        return tag
    found = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "")
    return ".".join([tag, *sorted(filter(None, (re.sub(r"[\d>]+", "", c) for c in found.lower().split())))])


class Page:
    """Blocks of text in page order, containers with the range of blocks they hold, and which blocks are kept.

    Paths are numbered: ``paths[number]`` is (number of the path above, last step).
    """

    def __init__(self, page: str):
        self.blocks: list[str] = []
        self.linked: list[int] = []
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.numbers: dict[tuple[int, str], int] = {}
        self.containers = [root := Container(0, 0, 0)]
        self.suspects: list[Suspect] = []
        self.read(page)
        root.last = len(self.blocks)
        self.weigh()

    def read(self, page: str) -> None:
        blocks, run, run_linked = self.blocks, [], 0
        open_tags: list[tuple[str, Container | None, Suspect | None, int]] = []  # tag, its container, suspect, 1 if it is skipped
        places: dict[str, list[int]] = {}  # where each tag is open
        scopes: list[int] = []  # where tags are open beyond which none is closed by an opening tag
        path, skipping, link_from = [0], 0, -1  # the depth of a link that is open
        within = [self.containers[0]]
        at = 0
        doubtful: list[Suspect] = []  # open suspects that hold no article yet

        def text(chunk: str) -> None:
            nonlocal run_linked
            if not skipping and chunk:
                run.append(chunk)
                if link_from >= 0:
                    run_linked += len(chunk.strip())

        def end_block() -> None:
            nonlocal run_linked
            if run:
                block = SPACE.sub(" ", entities.unescape("".join(run))).strip()
                run.clear()
                if block:
                    blocks.append(block)
                    self.linked.append(min(run_linked, len(block)))
                run_linked = 0

        def close(n: int) -> None:
            nonlocal skipping, link_from
            while len(open_tags) > n:
                tag, container, suspect, skips = open_tags.pop()
                places[tag].pop()
                if tag in BLOCK:
                    end_block()
                skipping -= skips
                if tag in SCOPES:
                    scopes.pop()
                if container:
                    container.last = len(blocks)
                    path.pop()
                    within.pop()
                if suspect:
                    suspect.last = len(blocks)
                    if doubtful and doubtful[-1] is suspect:
                        doubtful.pop()
            if link_from > len(open_tags):
                link_from = -1

        while m := MARKUP.search(page, at):
            text(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    text(entities.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link_from = -1
                elif places.get(tag):
                    close(places[tag][-1])
                elif tag in BLOCK:
                    end_block()
                continue
            if tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag in VOID:
                if tag == "hr":
                    end_block()
                elif tag == "br":
                    text(" ")
                continue
            if tag == "a":
                link_from = len(open_tags)
                continue
            if tag not in BLOCK and tag not in SKIPPED:
                # inline: it matters only if it is boilerplate by itself
                if skipping or not m[3] or m[3].endswith("/") or not (why := boilerplate(tag, m[3])):
                    if places.get(tag):  # keeps its end tag from closing an outer one of that name
                        places[tag].append(len(open_tags))
                        open_tags.append((tag, None, None, 0))
                    continue
            else:
                if tag in SELF_CLOSING:
                    found = max((places[t][-1] for t in SELF_CLOSING[tag] if places.get(t)), default=-1)
                    if found >= 0 and found >= (scopes[-1] if scopes else 0):
                        close(found)
                if tag in BLOCK:
                    end_block()
                if m[3].endswith("/") and tag in ("svg", "object", "canvas"):
                    continue
                why = 0 if skipping else boilerplate(tag, m[3])
            skips = int(why == SURE)
            suspect = container = None
            if why in (NAMED, HINTED):
                if tag not in BLOCK:
                    end_block()
                suspect = Suspect(why, len(blocks))
                self.suspects.append(suspect)
                doubtful.append(suspect)
            elif not skipping and tag in ("article", "main"):
                for s in doubtful:
                    s.holds = True
                doubtful.clear()
            if tag in CONTAINER and not skips and not skipping:
                step = path[-1], general(tag, m[3])
                if step not in self.numbers:
                    self.numbers[step] = len(self.paths)
                    self.paths.append(step)
                path.append(self.numbers[step])
                container = Container(path[-1], len(open_tags) + 1, len(blocks))
                self.containers.append(container)
                within[-1].inner.append(container)
                within.append(container)
            if tag in SCOPES:
                scopes.append(len(open_tags))
            skipping += skips
            places.setdefault(tag, []).append(len(open_tags))
            open_tags.append((tag, container, suspect, skips))
        text(page[at:])
        close(0)
        end_block()

    def weigh(self) -> None:
        """Which blocks are kept, and how much of them each container holds."""
        n = len(self.blocks)

        def without(suspects: list[Suspect]) -> list[bool]:
            edges = [0] * (n + 1)
            for s in suspects:
                edges[s.first] += 1
                edges[s.last] -= 1
            return [not x for x in accumulate(edges[:n])]

        def sums(kept: list[bool], of: list[int]) -> list[int]:
            return [0, *accumulate(x if k else 0 for k, x in zip(kept, of))]

        sizes = [len(b) for b in self.blocks]
        self.kept = [True] * n
        taken: list[Suspect] = []
        for why in (NAMED, HINTED):
            held, of_kind = sums(self.kept, sizes), [s for s in self.suspects if s.why == why and not s.holds]
            wraps = WRAPS[why]
            if why == NAMED and of_kind:  # where an article stands elsewhere, nothing named wraps it
                left = sums(without(of_kind), sizes)
                if any(left[c.last] > left[c.first] for c in self.containers if self.is_article(c)):
                    wraps = 1.0
            gone = [s for s in of_kind if held[s.last] - held[s.first] <= wraps * held[n]]
            self.kept = without(taken + gone)
            if gone and held[n] and not any(self.kept):  # all of the page is in them: the largest is what it is about
                gone.remove(max(gone, key=lambda s: held[s.last] - held[s.first]))
                self.kept = without(taken + gone)
            taken += gone
        chars, linked = sums(self.kept, sizes), sums(self.kept, self.linked)
        for c in self.containers:
            c.chars, c.linked = chars[c.last] - chars[c.first], linked[c.last] - linked[c.first]

    def is_article(self, c: Container) -> bool:
        return self.paths[c.path][1].partition(".")[0] in ("article", "main")

    def best(self) -> Container:
        """The container of the article: by its tag, or the smallest that loses no unlinked text but odd small neighbours."""
        top = max(self.containers, key=Container.score)
        named = [c for c in self.containers if c.chars and self.is_article(c) and c.score() >= 0.3 * top.score()]
        if named:
            return max(named, key=lambda c: (c.score(), -c.depth))
        now = top
        while now.inner:
            down = max(now.inner, key=Container.score)
            beside = now.chars - now.linked - sum(c.chars - c.linked for c in now.inner)
            if beside > 0 or down.score() < DESCEND * top.score() or any(c.path == down.path and c.chars for c in now.inner if c is not down):
                break
            now = down
        return now

    def path(self, number: int) -> str:
        steps = []
        while number:
            number, step = self.paths[number]
            steps.append(step)
        return "".join(">" + s for s in reversed(steps))

    def number(self, path: str | None) -> int:
        """-1 if the page has no such path."""
        if path is None:
            return -1
        now = 0
        for step in path.split(">")[1:]:
            now = self.numbers.get((now, step), -1)
            if now < 0:
                break
        return now


def vote(page: str | None) -> tuple[str, float]:
    """The path of the page's best container, and the characters it holds."""
    if not page:
        return "", 0.0
    read = Page(page)
    chosen = read.best()
    return read.path(chosen.path), float(max(0.0, chosen.score()))


def extract(page: str | None, path: str | None) -> str:
    """Blocks of all containers on ``path``, or of the page's own best one."""
    if not page:
        return ""
    read = Page(page)
    own, number = read.best(), read.number(path)
    chosen = [c for c in read.containers if c.path == number]
    # containers on one path may stand within one another: their blocks count once
    ranges, done = [], 0
    for c in sorted(chosen, key=lambda c: (c.first, -c.last)):
        if c.last > done:
            ranges.append((max(c.first, done), c.last))
            done = c.last
    found = [i for first, last in ranges for i in range(first, last) if read.kept[i]]
    if sum(len(read.blocks[i]) for i in found) < ENOUGH * own.chars or not chosen:
        found = [i for i in range(own.first, own.last) if read.kept[i]]
    return "\n\n".join(read.blocks[i] for i in found)


def host_votes(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path, pages, chars): how many pages of a host chose a path, and with how much text."""

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [vote(p) for p in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.float64())], ["host", "path", "chars"])

    votes = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).alias("html")).mapInArrow(per_step(judge, "html"), "host string, path string, chars double")
    return votes.where("path != ''").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


#: Hosts whose path may differ from the common one before the table of them is joined rather than broadcast.
BROADCAST_HOSTS = 20_000
#: Characters that the broadcast table may hold.
BROADCAST_CHARS = 16 << 20


def extract_main_text(pages: DataFrame, keep: list[str], url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The ``keep`` columns, text, and host_path: the path that the page's host voted for.

    Only hosts whose winner differs from the commonest winner are listed.  That list is broadcast if it is short, which its
    count and its characters show; otherwise pages are joined with it by host, and Spark splits hosts that many pages share.
    """
    votes = materialize(host_votes(pages, url_column, html_column), "votes")
    winners = votes.groupBy("host").agg(F.max_by("path", F.struct("pages", "chars", "path")).alias("path"))
    common = winners.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").first()
    usual = common.path if common else ""
    others = winners.where(F.col("path") != usual).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    size = others.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_host") + F.length("_path")), F.lit(0)).alias("chars")).first()
    short = size.n <= BROADCAST_HOSTS and size.chars <= BROADCAST_CHARS
    carried, names = aside(pages, keep, ("text", "host_path"))
    source = pages.select(*carried, host_of(F.col(url_column)).alias("_host"), F.col(html_column).alias("_html"))
    ready = source.join(F.broadcast(others) if short else others, "_host", "left").drop("_host").withColumn("_path", F.coalesce("_path", F.lit(usual)))

    def take(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, paths = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        found = [extract(t, p) for p, t in zip(paths.to_pylist(), texts.to_pylist())]
        return pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.string()), paths], [*b.schema.names[:-2], "text", "host_path"])

    schema = StructType(ready.schema.fields[:-2]).add("text", StringType()).add("host_path", StringType())
    return ready.mapInArrow(per_step(take, "_html"), schema).toDF(*names, "text", "host_path")
