"""Main text of web pages: markup out, boilerplate elements out, site templates out.

A page is tokenised into tags and text and held as a tree of elements, with the usual repairs (void
elements, implied ends, stray end tags; each in constant time). What standards define as no content goes first: menus,
headers, footers, asides, forms, scripts, styles, and elements with such a role or hidden. The rest of the
body is content unless it is a template of its site.

Site templates: each element subtree has a skeleton, the hash of its tag, class and id and its child elements'
skeletons, runs of equal ones counting once, so a menu or an advert has one skeleton whatever it says. Spark counts
how many different texts of each host stand on pages with a skeleton, and how many hosts have it on most of theirs,
with partial counts on each side of the shuffle. With n of a host's N texts the share of a skeleton is taken as

    (n + PAGES * q) / (N + PAGES),    q = (other hosts that have it on most texts + prior) / hosts

so a host's own pages decide where there are many, and what holds on other sites where there are few; nothing is
switched by size. Subtrees with a share of SHARE or more are deleted, the outermost first.

* A page's main elements are its longest <article> with the articles beside it, else <main>, else the deepest
  container with more than half of the text. They and what holds them are never deleted.
* Outside of an <article> or <main> every subtree, and loose text, may be a template, and the prior is 1: without other
  evidence, as in a table of one page, it goes.
* Inside, only containers with a class or id may be, and only if their skeleton has less than PART of the text;
  bare paragraphs, headings and lists stay, so copied articles keep theirs.
* On pages without either, other elements are templates by their text as well as containers by skeleton; prior 0.
* Class and id words that name boilerplate (MARKS) are evidence: prior 1, and a share of MARKED is enough.

Block elements cut the content into blocks; a block's character references are decoded and its white space becomes
single spaces; blocks are joined by one line end in page order.

Defined results: null or empty html gives empty text. A null url has an empty host. Cut-off markup at
the end is left out. Repeated rows are separate pages, and count once as evidence, as all pages of a host with one main text do.
Pages of any length and depth take time in proportion to their length. An empty table gives an empty result. Columns
beside url and html pass through `extract` whatever their names.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import staged, table, values
from cadenza.llm.url_filter import host_of

SHARE = 0.6
MARKED = 0.05
PAGES = 5.0
PART = 0.25

# Element names and the words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside button dialog footer form head header menu nav search fieldset".split()) | RAW
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul menu dl".split())
SELF_CLOSING = {"li": "ol ul menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": "select"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S
)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


#: Elements that hold text rather than other elements; what isn't listed and starts a block is a container.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption legend summary center address option hgroup".split())
_DIGITS = re.compile(r"[0-9]+")


def _hash(*parts: object) -> int:
    found = xxhash.xxh3_64_intdigest("\1".join(map(str, parts)))
    return found - (1 << 64) if found >> 63 else found


def _named(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether an element is boilerplate by standards (tag, role, hidden), its class and id, and whether these have a word of MARKS."""
    sure, names, marked = tag in DROPPED, [], False
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in _MARKED.findall(attributes):
            value = (a or b or c).lower()
            words = re.split(r"[^a-z0-9]+", value)
            if name.lower() == "role":
                sure = sure or not ROLES.isdisjoint(words)
            else:
                names.append(name[0].lower() + _DIGITS.sub("#", " ".join(sorted(value.split()))))
                marked = marked or not MARKS.isdisjoint(words)
        sure = sure or "hidden" in attributes.split() or 'aria-hidden="true"' in attributes
    return sure, " ".join(sorted(names)), marked


class _Stack:
    """Open elements, with the places of each name, of blocks and of scopes, so nothing is searched."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, int, bool]] = []  # (tag, nearest element, dropped)
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def last(self, *tags: str) -> int:
        return max((found[-1] for t in tags if (found := self.places.get(t))), default=-1)

    def push(self, tag: str, element: int, dropped: bool) -> None:
        at = len(self.frames)
        self.frames.append((tag, element, dropped))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def cut(self, to: int) -> None:
        while len(self.frames) > to:
            tag = self.frames.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()


class Page:
    """A page's elements outside of standard boilerplate, its runs of text, and the subtrees that may be templates."""

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.names: list[str] = []
        self.marked: list[bool] = []
        self.parents: list[int] = []
        self.parts: list[list] = []  # of each element: its texts and elements, in order
        self.runs: list[tuple[int, str] | None] = []  # (element, source text); None where a block ends
        self._read(html)
        self._place()

    def _read(self, html: str) -> None:
        stack, at, size = _Stack(), 0, len(html)
        while at < size:
            token = _TOKEN.search(html, at)
            _, element, dropped = stack.frames[-1] if stack.frames else ("", -1, False)
            upto = token.start() if token else size
            if upto > at and not dropped:
                self.runs.append((element, html[at:upto]))
                if element >= 0 and not html[at:upto].isspace():
                    self.parts[element].append(html[at:upto])
            if not token:
                break
            at = token.end()
            close, name, attributes = token.groups()
            if not name:
                continue
            tag = name.lower()
            if close:
                place = stack.last(tag)
                if place < 0 or (tag not in BLOCK and stack.scopes and stack.scopes[-1] > place):
                    if tag in BLOCK:
                        self.runs.append(None)
                    continue
                if stack.blocks and stack.blocks[-1] >= place:
                    self.runs.append(None)
                stack.cut(place)
                continue
            if tag in RAW:
                end = _ENDS[tag].search(html, at)
                at = end.end() if end else size
                continue
            if tag in VOID:
                if tag == "hr":
                    self.runs.append(None)
                elif not dropped:
                    self.runs.append((element, " "))
                continue
            if tag in BLOCK:
                self.runs.append(None)
                limit = SELF_CLOSING.get(tag, "").split()
                place = stack.last("p", tag) if limit else stack.last("p")
                barrier = stack.last(*limit, "ol", "ul", "table", "dl") if limit else (stack.scopes[-1] if stack.scopes else -1)
                if place > barrier:
                    stack.cut(place)
                _, element, dropped = stack.frames[-1] if stack.frames else ("", -1, False)
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            sure, names, marked = _named(tag, attributes)
            dropped = dropped or sure
            if not dropped and (tag in BLOCK or names):
                self.tags.append(tag)
                self.names.append(names)
                self.marked.append(marked)
                self.parents.append(element)
                self.parts.append([])
                if element >= 0:
                    self.parts[element].append(len(self.tags) - 1)
                element = len(self.tags) - 1
            stack.push(tag, element, dropped)

    def _place(self) -> None:
        """Finds the main elements and gives each subtree that may be a template its (hash, prior, length)."""
        n = len(self.tags)
        sizes, skeletons, texts = [0] * n, [0] * n, [0] * n
        for e in range(n - 1, -1, -1):  # children follow their parents
            shape, said = [], []
            for part in self.parts[e]:
                if isinstance(part, int):
                    sizes[e] += sizes[part]
                    said.append(texts[part])
                    if not shape or shape[-1] != skeletons[part]:
                        shape.append(skeletons[part])
                else:
                    sizes[e] += len(part.strip())
                    said.append(part.strip())
            skeletons[e], texts[e] = _hash(self.tags[e], self.names[e], *shape), _hash(self.tags[e], *said)
        loose = sum(len(r[1].strip()) for r in self.runs if r and r[0] < 0)
        self.total = loose + sum(s for s, p in zip(sizes, self.parents, strict=True) if p < 0)
        self.rooted, main = False, []
        for root in ("article", "main"):
            if found := [e for e in range(n) if self.tags[e] == root]:
                best = max(found, key=lambda e: (sizes[e], -e))
                self.rooted, main = True, [e for e in found if self.parents[e] == self.parents[best]]
                break
        else:
            main = [e for e in range(n) if 2 * sizes[e] > self.total and self.tags[e] not in TEXTUAL][-1:]
        inside, holds = [False] * n, {-1: True}
        for e in main:
            inside[e] = True
            while e >= 0 and e not in holds:
                holds[e] = True
                e = self.parents[e]
        if not main:
            inside = [True] * n
        self.found: dict[int, tuple[int, int, int]] = {}
        for e in range(n):
            inside[e] = inside[e] or (self.parents[e] >= 0 and inside[self.parents[e]])
            if e in holds:
                continue
            container = self.tags[e] not in TEXTUAL
            marks = bool(self.marked[e]) * 2
            if self.rooted and not inside[e]:
                self.found[e] = (_hash("out", marks, skeletons[e]), marks or 1, 0)
            elif marks or (container and (self.names[e] or not inside[e])):
                self.found[e] = (_hash("in", marks, inside[e], skeletons[e]), marks, 0 if marks or not inside[e] else sizes[e])
            elif not self.rooted and sizes[e]:
                self.found[e] = (_hash("text", texts[e]), 0, 0)
        self.loose = {}
        if self.rooted:  # text that stands beside the main elements in what holds them
            self.loose = {e: (_hash("loose", *((self.tags[e], self.names[e]) if e >= 0 else ())), 1, 0) for e in holds if e not in main}
        self.key = _hash(*(texts[e] for e in main)) if main else _hash(*(r[1] for r in self.runs if r))

    def subtrees(self) -> list[tuple[int, int, int]]:
        """(hash, prior, length) of each different subtree that may be a template."""
        by: dict[tuple[int, int], int] = {}
        standing = {r[0] for r in self.runs if r and not r[1].isspace()}
        for h, prior, size in [*self.found.values(), *(v for e, v in self.loose.items() if e in standing)]:
            by[h, prior] = by.get((h, prior), 0) + size
        return [(h, prior, size) for (h, prior), size in sorted(by.items())]

    def text(self, templates: frozenset[int] | None = None) -> str:
        """The content without `templates`; None stands for no evidence but the priors."""
        goes = lambda v: (v[0] in templates) if templates is not None else v[1] > 0
        gone = [False] * len(self.tags)
        for e, p in enumerate(self.parents):
            gone[e] = (p >= 0 and gone[p]) or (e in self.found and goes(self.found[e]))
        without = {e for e, v in self.loose.items() if goes(v)}
        blocks, buffer = [], []
        for run in [*self.runs, None]:
            if run is None:
                if buffer and (text := " ".join(references.unescape("".join(buffer)).split())):
                    blocks.append(text)
                buffer = []
            elif not (run[0] >= 0 and gone[run[0]]) and run[0] not in without:
                buffer.append(run[1])
        return "\n".join(blocks)


_FOUND = "array<struct<hash:bigint,prior:int,size:bigint>>"
_FOUND_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("prior", pa.int32()), ("size", pa.int64())]))


def templates(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, hashes): the subtrees that are templates on each host."""

    def run(batches):
        for batch in batches:
            keys, totals, found = [], [], []
            for html in values(batch["html"]):
                page = Page(html or "")
                keys.append(page.key)
                totals.append(page.total)
                found.append([dict(zip(("hash", "prior", "size"), s, strict=True)) for s in page.subtrees()])
            arrays = [batch["host"], pa.array(keys, pa.int64()), pa.array(totals, pa.int64()), pa.array(found, _FOUND_ARROW)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "key", "total", "found"])

    hosts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, f"host string, key bigint, total bigint, found {_FOUND}")
    texts = staged(hosts.groupBy("host", "key").agg(F.max(F.struct("found", "total")).alias("page")).select("host", "page.*"))
    counts = staged(texts.groupBy("host").agg(F.count("*").alias("pages")))
    seen = texts.select("host", "total", F.explode("found").alias("f")).groupBy("host", "f.hash", "f.prior").agg(
        F.count("*").alias("n"), F.sum("f.size").alias("size"), F.sum("total").alias("total")
    )
    seen = staged(seen.join(counts, "host").withColumn("most", (F.col("n") >= share * F.col("pages")).cast("long")))
    spread = seen.groupBy("hash").agg(F.sum("most").alias("hosts"))
    q = (F.col("hosts") - F.col("most") + (F.col("prior") > 0).cast("long")) / F.lit(float(max(1, counts.count())))
    rate = (F.col("n") + PAGES * q) / (F.col("pages") + PAGES)
    small = F.col("size") <= PART * F.col("total")
    goes = seen.join(spread, "hash").where(small & (rate >= F.when(F.col("prior") == 2, MARKED).otherwise(share)))
    return staged(goes.groupBy("host").agg(F.collect_set("hash").alias("hashes")))


def extract(pages: DataFrame, columns: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """(row, text): the columns of `pages`, or those named, and the main text of each page."""
    known = templates(pages, share)
    rows = pages.select(F.struct(*(columns or pages.columns)).alias("row"), "html", host_of(F.col("url")).alias("host")).join(known, "host", "left")

    def run(batches):
        for batch in batches:
            texts = [Page(h or "").text(frozenset(t or ())) for h, t in zip(values(batch["html"]), values(batch["hashes"]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "text"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    return rows.select("row", "html", "hashes").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, ["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
