"""Main text of web pages by consensus of each host's pages.

1. Each page is parsed to nodes with generalised tag-class paths, as html>body>div.post-#>article. Containers (div, article, td, ...) are nodes, and so are
   paragraphs, headings and other blocks that have a class, an id or a role. Every block's text counts for the container it stands in, less the text of its
   links; boilerplate counts for none. The page votes for the path of the container that holds its article (see best()).
2. Votes are summed for each host and path in Spark (counts, then characters, decide); ties go to the lesser path. So are the blocks of text: a path whose blocks say the
   same on many pages of the host, `repeated` times as often as those of the winner, is the host's boilerplate, however it is called.
3. Each page is extracted anew: the text of all its containers on the host's winning path, or, where these have none, of its
   own best container; without boilerplate. The winners are broadcast up to BROADCAST_PATHS paths, and joined by shuffle beyond.

Boilerplate by its own marks: tags as nav and form, the attribute hidden, roles as navigation, and classes and ids that are called as BOILER_WORDS. A name made of
several words, as related-posts, counts if one of them does, unless the element is also plainly called as MAIN_WORDS (class="post tag-social"). Where only one of DOUBTFUL_WORDS does, as in share-price, the name
alone doesn't decide: half of the element's text has to be links, or its text has to repeat on the host.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one space. Formulas (math) are text; scripts, styles, drawings and embedded objects are not. Null or empty html, and pages without text, give an empty text. Long pages
are parsed whole, one at a time if need be, in linear time however broken they are. Pages without url share one host. Rows are never merged, repeated ones included; an empty table gives no rows; rows without
page_id are extracted too, and extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import dropped, written
from .kernels import lean, slices

#: Paths (winners and boilerplate) that are broadcast at most: 8 bytes each, and the winner's name.
BROADCAST_PATHS = 200_000

#: A path of more characters begins with a digest of what stands before its last name, so that deep pages take linear space.
LONG_PATH = 2_000


@dataclass(frozen=True)
class Config:
    main_share: float = 0.5  # of the text below a node, for a node that is marked as the article
    nested_share: float = 0.98  # of a marked node's text, for a marked node within it
    plain_share: float = 0.9  # of a node's text, for a child that isn't marked
    repeated: int = 3  # pages on which a block of boilerplate stands, on the average
    host_percent: int = 1  # of the host's pages have a path that can be boilerplate


OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
STOPS = re.compile(r"[\"'>]")
RAW = frozenset("script style noscript template textarea title iframe svg object xmp noembed noframes annotation annotation-xml".split())
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
MARKS = re.compile(r"class|id|role|hidden", re.I)
CONTAINERS = frozenset("html body main article section div td th table tbody tr ul ol dl center figure details blockquote header footer nav aside form menu dialog fieldset button select search address".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption summary legend hgroup".split())
BREAKS = frozenset("br hr thead tfoot colgroup option optgroup video audio canvas frameset frame head".split())
BOILER_TAGS = frozenset("head header footer nav aside form menu dialog fieldset button select search".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright dialog disqus footer footnav gdpr header masthead menu modal nav navbar navigation navi newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe tags toolbar topbar widget widgets".split()
)
#: Words of prose as well: a name with one of these among others, as share-price, is boilerplate only if half of the element's text is links.
DOUBTFUL_WORDS = frozenset("promotion recommended related search share sharing skip social sponsor tags".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
CLOSERS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr"])}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTS = frozenset(["table", "ul", "ol", "dl"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
DIGITS = re.compile(r"\d+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[a-z]+")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tags(text: str):
    """(begin, end, name, whether it ends an element, attributes) of each tag; the name is empty for comments and declarations. The contents of RAW elements belong to
    their tag. A quote that is left open hides nothing: such a tag ends at the next >. Time is linear in the text, whatever is broken in it: the end of a tag is looked
    up where an earlier tag came by the same quote, and past the last > only comments are looked for."""
    last, at, ends, raw_ends = text.rfind(">"), 0, {}, {}

    def end_of(start: int) -> int:
        """The > that ends a tag, outside quotes; -1 if there is none."""
        seen, i = [], start
        while True:
            m = STOPS.search(text, i)
            if m is None:
                found = -1
            elif m[0] == ">":
                found = m.start()
            elif m.start() in ends:
                found = ends[m.start()]
            else:
                seen.append(m.start())
                i = text.find(m[0], m.end()) + 1
                if i:
                    continue
                found = -1
            for q in seen:
                ends[q] = found
            return found

    while True:
        m = OPEN.search(text, at) if at <= last else None
        if m is None or m.start() > last:
            break
        begin, name = m.start(), (m[2] or "").lower()
        if not name:
            if text.startswith("<!--", begin):
                end = text.find("-->", begin + 4)
                at = end + 3 if end >= 0 else len(text)
            else:
                at = text.find(">", m.end()) + 1
            yield begin, at, "", False, ""
            continue
        end = end_of(m.end())
        plain = end < 0
        if plain:
            end = text.find(">", m.end())
        attrs, at = text[m.end() : end], end + 1
        if name in RAW and not m[1] and not plain:
            if name not in raw_ends:
                raw_ends[name] = re.compile(rf"</{name}\s*>", re.I)
            close = raw_ends[name].search(text, at)
            at = close.end() if close else len(text)
            yield begin, at, "", False, ""
        else:
            yield begin, at, name, bool(m[1]), attrs
    begin = text.find("<!--", at)
    if begin >= 0:
        yield begin, len(text), "", False, ""


@functools.lru_cache(maxsize=4096)
def marks(tag: str, attrs: str) -> tuple[str, bool, bool, int]:
    """Name (tag and classes, generalised), whether the element is boilerplate, whether it may be, and how plainly it is the article (0 to 2)."""
    name, boiler, main = tag, tag in BOILER_TAGS, 2 if tag == "article" else int(tag == "main")
    doubtful = False
    if attrs and MARKS.search(attrs):
        exact, part, named = False, False, False
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                boiler = True
            elif key == "role":
                boiler |= value.lower() in ROLES
                main = max(main, {"main": 1, "article": 2}.get(value.lower(), 0))
            elif key in ("class", "id") and value:
                words = value.split()
                if key == "class":
                    name += "".join("." + DIGITS.sub("#", x.lower()) for x in sorted(set(words)))
                for x in words:
                    low = x.lower()
                    exact |= low in BOILER_WORDS
                    named |= low in MAIN_WORDS
                    found = {p.lower() for p in NAME_PARTS.findall(x)}
                    part |= bool(found & (BOILER_WORDS - DOUBTFUL_WORDS))
                    doubtful |= bool(found & DOUBTFUL_WORDS)
                    main = max(main, int(bool(found & MAIN_WORDS)))
        free = tag in ("html", "body", "article", "main")
        boiler |= (exact or part and not named) and not free
        doubtful &= not (boiler or named or free)
    return name, boiler, doubtful, main


class Page:
    """Nodes of a page: path, parent (-1: none), container (itself, or the one it stands in), boiler, main; and its blocks: (node, text, link characters)."""

    __slots__ = ("path", "parent", "container", "boiler", "doubtful", "main", "blocks")

    def __init__(self, text: str):
        self.path, self.parent, self.container, self.boiler, self.main = ["#"], [-1], [0], [False], [0]
        self.doubtful: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("", 0)]  # open elements that are nodes, and their nodes
        standing: Counter = Counter()  # how often each tag is in the stack
        mute: list[str] = []  # open inline elements that are boilerplate, and those within
        muted: Counter = Counter()
        parts: list[str] = []
        links, in_link, formula, listing, at = 0, 0, 0, 0, 0

        def flush():
            nonlocal parts, links
            if parts:
                block = " ".join("".join(parts).split())
                if block:
                    self.blocks.append((stack[-1][1], block, links))
                parts, links = [], 0
            mute.clear()
            muted.clear()

        def words(piece: str):
            nonlocal links
            if piece and not mute:
                piece = html_lib.unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if in_link:
                    links += len(piece)

        def close(names: frozenset[str], until: frozenset[str] = frozenset()):
            """Ends the innermost open element of these, and what is open within it."""
            if not any(standing[x] for x in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    standing.subtract(x for x, _ in stack[i:])
                    del stack[i:]
                    return
                if stack[i][0] in until:
                    return

        for begin, end, tag, ends, attrs in tags(text):
            words(text[at:begin])
            at = end
            if not tag:
                continue
            block = tag in CONTAINERS or tag in LEAVES or tag in BREAKS
            if tag == "math":
                formula = 0 if ends else 1
            if tag in ("pre", "code"):  # the marks of a listing's words are its own
                listing = 0 if ends else 1
            if ends:
                if tag == "a":
                    in_link = 0
                if not block or formula:
                    if muted[tag]:
                        while True:
                            inner = mute.pop()
                            muted[inner] -= 1
                            if inner == tag:
                                break
                    continue
                flush()
                in_link = 0
                close(frozenset([tag]), CONTAINERS if tag in LEAVES else frozenset())
                continue
            if not block or formula:
                if tag == "a":
                    in_link = 1
                if tag not in VOID and not listing and not attrs.endswith("/") and (mute or attrs and MARKS.search(attrs) and self._muted(tag, attrs)):
                    mute.append(tag)
                    muted[tag] += 1
                continue
            flush()
            in_link = 0
            if tag != "br":  # a paragraph or heading that was left open ends here
                close(HEADINGS | {"p"} if tag in HEADINGS else frozenset(["p"]), CONTAINERS)
            if tag in CLOSERS:
                close(CLOSERS[tag], LISTS)
            if tag in CONTAINERS and not attrs.endswith("/") or tag in LEAVES and MARKS.search(attrs):
                stack.append((tag, self._open(tag, attrs, stack[-1][1])))
                standing[tag] += 1
        words(text[at:])
        flush()

        if self.doubtful:
            self._judge()

    @staticmethod
    def _muted(tag: str, attrs: str) -> bool:
        """Whether an inline element is boilerplate."""
        _, boiler, doubtful, _ = marks(tag, attrs)
        return boiler or doubtful and tag == "a"

    def _judge(self):
        """Nodes that may be boilerplate are if half of the text in them is links."""
        size, linked = [0] * len(self.path), [0] * len(self.path)
        for c, text, links in self.blocks:
            size[c] += len(text)
            linked[c] += links
        for c in range(len(size) - 1, 0, -1):
            size[self.parent[c]] += size[c]
            linked[self.parent[c]] += linked[c]
        for c in self.doubtful:
            self.boiler[c] = self.boiler[c] or 2 * linked[c] >= size[c]
        for c in range(1, len(size)):
            self.boiler[c] = self.boiler[c] or self.boiler[self.parent[c]]

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        name, boiler, doubtful, main = marks(tag, attrs)
        node = len(self.path)
        if doubtful:
            self.doubtful.append(node)
        path = f"{self.path[parent]}>{name}" if parent else name
        self.path.append(path if len(path) <= LONG_PATH else f"{digest(path[:-len(name)]):x}>{name[-LONG_PATH // 2:]}")
        self.parent.append(parent)
        self.container.append(node if tag in CONTAINERS else self.container[parent])
        self.boiler.append(boiler or self.boiler[parent])
        self.main.append(main if tag in CONTAINERS else 0)
        return node

    def best(self, cfg: Config, boiler: frozenset[int] = frozenset()) -> tuple[int, int] | None:
        """The container of the article and the characters of text (but for links) in it: an article that holds main_share of the page's text; else of the nodes
        marked as main that do the innermost one with nested_share of the outermost one's; else what is reached by going down while one child has plain_share."""
        below = [0] * len(self.path)
        for c, text, links in self.blocks:
            if not self.boiler[c] and not (boiler and digest(self.path[c]) in boiler):
                below[self.container[c]] += max(0, len(text) - 2 * links)
        own = [c for c in range(len(below)) if self.container[c] == c]
        for c in reversed(own[1:]):
            below[self.container[self.parent[c]]] += below[c]
        if below[0] <= 0:
            return None
        articles = [c for c in own if self.main[c] == 2 and below[c] >= cfg.main_share * below[0]]
        if articles:
            return articles[-1], below[articles[-1]]
        found = [c for c in own if self.main[c] and below[c] >= cfg.main_share * below[0]]
        if found:
            found = [c for c in found if below[c] >= cfg.nested_share * below[found[0]]]
            return found[-1], below[found[-1]]
        at = 0
        for c in own[1:]:  # a parent stands before its children
            if self.container[self.parent[c]] == at and below[c] >= cfg.plain_share * below[at]:
                at = c
        return at, below[at]

    def texts(self, chosen: list[bool], boiler: frozenset[int] = frozenset()) -> str:
        """The text of the chosen nodes and those below them."""
        for i in range(1, len(chosen)):
            chosen[i] = chosen[i] or chosen[self.parent[i]]
        return " ".join(t for c, t, _ in self.blocks if chosen[c] and not self.boiler[c] and not (boiler and digest(self.path[c]) in boiler))

    def text(self, path: str | None, cfg: Config, boiler: frozenset[int] = frozenset()) -> str:
        """The text on the path, or, where there is none, of the best container. boiler: digests of paths."""
        found = self.texts([p == path for p in self.path], boiler)
        if not found:
            top = self.best(cfg, boiler)
            found = self.texts([i == top[0] for i in range(len(self.path))], boiler) if top else ""
        return found


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def ballots(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """host, n (pages), at (the digest of a path) and: the path and its chars, of a vote; or, where path is null, the digest of a block's text that stands there on
    these pages. at 0 stands for the text below the path that the page votes for."""
    schema = pa.schema([("host", pa.string()), ("n", pa.int64()), ("path", pa.string()), ("chars", pa.int64()), ("at", pa.int64()), ("block", pa.int64())])

    def run(batches):
        for batch in batches:
            for rows, _, _ in slices(batch, "html"):
                votes: Counter = Counter()
                chars: Counter = Counter()
                blocks: Counter = Counter()
                known: dict[str, int] = {}
                for host, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    page = Page(text or "")
                    top = page.best(cfg)
                    seen = set()
                    if top is not None:
                        votes[host, page.path[top[0]]] += 1
                        chars[host, page.path[top[0]]] += top[1]
                        seen.add((host, 0, digest(page.texts([i == top[0] for i in range(len(page.path))]))))
                    for c, t, _ in page.blocks:
                        if not page.boiler[c]:
                            path = page.path[c]
                            if path not in known:
                                known[path] = digest(path)
                            seen.add((host, known[path], digest(t)))
                    blocks.update(seen)
                out = [(h, n, p, chars[h, p], digest(p), None) for (h, p), n in votes.items()] + [(h, n, None, None, a, b) for (h, a, b), n in blocks.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, schema.types)], schema=schema)

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(lean(run), "host string, n long, path string, chars long, at long, block long")


def consensus(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """host, path (its winner) and boiler (the digests of its paths of boilerplate; at most 100 / host_percent times the paths of an average page)."""
    cast = written(ballots(pages, cfg), "ballots")
    counted = cast.where("path is not null").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("at").alias("at"))
    top = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("chars")).alias("chars"), "path", "at"))
    winners = counted.groupBy("host").agg(top.alias("top"), F.sum("n").alias("pages")).select("host", "top.path", F.col("top.at").alias("winner"), "pages")
    found = written(cast.where("path is null").groupBy("host", "at", "block").agg(F.sum("n").alias("n")).groupBy("host", "at").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "repeats")
    # how often whole articles repeat: where they do all paths do, and that tells nothing
    winners = written(winners.join(found.where("at = 0").select("host", F.col("n").alias("own_n"), F.col("texts").alias("own_texts")), "host"), "winners")
    often = found.where((F.col("at") != 0) & (F.col("n") >= cfg.repeated * F.col("texts"))).join(winners, "host").where("at <> winner")
    bad = often.where((100 * F.col("n") >= cfg.host_percent * F.col("pages")) & (F.col("n") * F.col("own_texts") >= cfg.repeated * F.col("texts") * F.col("own_n")))
    out = written(winners.select("host", "path").join(bad.groupBy("host").agg(F.array_sort(F.collect_list("at")).alias("boiler")), "host", "left"), "hosts")
    dropped(cast, winners, found)
    return out


def main_text(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars, then path (the winner of its host)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("path", pa.string())])

    def run(batches):
        for batch in batches:
            for rows, _, _ in slices(batch, "html"):
                paths = rows.column("path").to_pylist()
                texts = [Page(h or "").text(p, cfg, frozenset(b or ())) for h, p, b in zip(rows.column("html").to_pylist(), paths, rows.column("boiler").to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], schema=schema)

    hosts = consensus(pages, cfg)
    size = hosts.agg(F.sum(1 + F.coalesce(F.size("boiler"), F.lit(0)))).first()[0] or 0
    small = F.broadcast(hosts) if size <= BROADCAST_PATHS else hosts
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("host", host_of(F.col("url")))
    return own.join(small, "host", "left").select("page_id", "url", "html", "path", "boiler").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long, path string")
