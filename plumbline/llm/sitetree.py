"""Main text of pages by a site style tree.

The pages of a host are merged into one tree: elements with the same chain of tags, classes and ids
are one style node. A node whose children look the same everywhere, and whose text is the same
everywhere, matters little: its importance is the entropy of its presentation styles and of its
contents, as a share of the largest possible. Branches of low importance are removed from every page.
Pages whose articles begin alike count once for contents, so that copies of an article do not make it
look like a notice. What is known of HTML beforehand multiplies the importance, in one rule: menus,
sidebars, footers, forms, headers and what its class, id or role calls boilerplate weigh little, an
article's branches weigh more than others, and its headings are never cut. A name says nothing of an
element that holds the page's largest article and half its words.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import skew_join, written

#: Share of the content entropy in a node's importance, the weighted importance below which a branch goes, the fewest occurrences that tell.
GAMMA, LOW, SEEN = 0.9, 0.3, 4
#: What multiplies the importance of an article's branches, of a header with the page's only title, and of what is boilerplate by element or name; words of a sentence.
INSIDE, TITLED, NAMED, SENTENCE = 3.0, 0.5, 0.25, 8
#: Rows of counts that a task holds before it sends them on.
HELD = 50_000

# Elements by what HTML says of them, and words in classes, ids and roles that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
UNSEEN = frozenset("head script style noscript template button select textarea input label iframe object svg canvas audio video map dialog title".split())
ASIDE = frozenset("nav footer aside menu".split())
FURNITURE = ASIDE | {"form"}
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search".split())
NEUTRAL = frozenset("area bar block box buttons container inner item items left links list main outer page right section site slot thread top unit wrap wrapper".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_BOUND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def host(url: Column) -> Column:
    """The host of a url, lower-cased; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """(1, tag, attributes) for starts, (-1, tag, '') for ends, (0, text, '') for texts; comments, declarations and contents of raw elements are left out."""
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            yield 0, entities.unescape(page[at : m.start()]), ""
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            yield -1, tag, ""
            continue
        attributes = m[3] or m[6] or ""
        yield 1, tag, attributes
        if tag in VOID or attributes.endswith("/"):
            if tag in VOID:
                yield -1, tag, ""
        elif tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = stop.start() if stop else len(page)
    if at < len(page):
        yield 0, entities.unescape(page[at:]), ""


@lru_cache(maxsize=100_000)
def boilerplate_name(word: str) -> bool:
    """Whether a word of a class, id or role names boilerplate: it is such a word, or joins such words by hyphens with ones that say nothing. "no-sidebar" and "search-engines" do not."""
    parts = [x for x in re.split("[-_]+", word) if x and not x.isdigit()]
    return any(x in BOILERPLATE for x in parts) and all(x in BOILERPLATE or x in NEUTRAL for x in parts)


def _style(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The key of a style node, whether it is boilerplate by name, and whether it is hidden."""
    if tag in ("html", "body") or not attributes:
        return tag, False, False
    words, hidden = [], False
    for m in _NAMED.finditer(attributes):
        if m[1].lower() == "hidden":
            hidden = "=" not in m[0]
        else:
            words += [w.lower() for w in (m[2] or m[3] or m[4] or "").split()]
    return " ".join((tag, *sorted(words))), any(map(boilerplate_name, words)), hidden


class Page:
    """A page read once: its elements in the order in which they open, what stands in which, and the style nodes that they belong to."""

    def __init__(self, page: str, counted: bool = False):
        """Elements open and close as HTML has it, whatever is missing. counted: ``counts`` gets the styles and contents of every node that can be seen."""
        from xxhash import xxh64_intdigest

        self.hash, self.page, self.counted = xxh64_intdigest, page, counted
        self.tag: list[str] = []
        self.up: list[int] = []
        self.path: list[int] = []
        self.named: list[bool] = []  # boilerplate by element or name
        self.unseen: list[bool] = []
        self.words: list[int] = []
        self.linked: list[int] = []  # words in links
        self.script: list[tuple[int, str | None]] = []  # texts by element in page order; None ends a block
        self.stack: list[tuple[int, list, list]] = []  # element, styles of children, contents
        self.open: Counter = Counter()
        self.counts: Counter = Counter()
        self._read()
        for k in range(len(self.tag) - 1, 0, -1):
            if self.up[k] >= 0:
                self.words[self.up[k]] += self.words[k]
                self.linked[self.up[k]] += self.linked[k]
        self.lead = self._lead()

    def _close(self) -> None:
        k, styles, contents = self.stack.pop()
        tag = self.tag[k]
        self.open[tag] -= 1
        inline = tag in INLINE
        if self.counted and not self.unseen[k]:
            if not inline:
                self.counts[self.path[k], 0, self.hash("\n".join(styles))] += 1
                if contents:
                    content = self.hash("\n".join(contents))
                    self.counts[self.path[k], 1, content] += 1
                    contents = [str(content)]
            if self.stack:
                self.stack[-1][2].extend(contents)
        if not inline:
            self.script.append((k, None))

    def _within(self, tags: tuple[str, ...], bound: tuple[str, ...] = ()) -> int | None:
        if not any(self.open[t] for t in tags):
            return None
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.tag[self.stack[i][0]]
            if tag in tags:
                return i
            if tag in bound:
                return None
        return None

    def _close_to(self, i: int) -> None:
        while len(self.stack) > i:
            self._close()

    def _text(self, what: str) -> None:
        if not self.stack:
            self._start("html", "")  # text before anything else
        k, _, contents = self.stack[-1]
        if self.unseen[k]:
            return
        self.script.append((k, what))
        if words := what.split():
            self.words[k] += len(words)
            if self.open["a"]:
                self.linked[k] += len(words)
            if self.counted:
                contents.append(" ".join(words))

    def _start(self, what: str, attributes: str) -> None:
        if what in ENDS_P and (i := self._within(("p",), ("table", "td", "button", "object"))) is not None:
            self._close_to(i)
        if what in _ENDS:
            while (i := self._within(_ENDS[what], _BOUND.get(what, ()))) is not None:
                self._close_to(i)
        key, named, hidden = _style(what, attributes)
        up, styles, _ = self.stack[-1] if self.stack else (-1, [], [])
        k = len(self.tag)
        self.tag.append(what)
        self.up.append(up)
        self.path.append(self.hash(key, seed=self.path[up] if up >= 0 else 0))
        self.named.append(named or what in FURNITURE)
        self.unseen.append(hidden or what in UNSEEN or (up >= 0 and self.unseen[up]))
        self.words.append(0)
        self.linked.append(0)
        if what not in INLINE:
            if not styles or styles[-1] != key:
                styles.append(key)
            self.script.append((k, None))
        elif what == "br":
            self.script.append((k, " "))
        self.stack.append((k, [], []))
        self.open[what] += 1

    def _read(self) -> None:
        for kind, what, attributes in events(self.page):
            if kind == 0:
                self._text(what)
            elif kind == 1:
                self._start(what, attributes)
            elif (i := self._within((what,))) is not None and not (what in INLINE and any(self.tag[x[0]] in ("table", "td", "th") for x in self.stack[i + 1 :])):
                self._close_to(i)  # an end tag of an inline element does not reach over an open cell or table
        self._close_to(0)

    def _lead(self) -> int:
        """The article or main with the most words outside menus, sidebars and footers (the first of such); -1 without one."""
        most, found, out = 0, -1, []
        for k, tag in enumerate(self.tag):
            out.append(self.unseen[k] or tag in ASIDE or (self.up[k] >= 0 and out[self.up[k]]))
            if tag in MAIN and not out[k] and self.words[k] > most:
                most, found = self.words[k], k
        return found

    def _holding(self) -> set[int]:
        """The lead and all that it stands in."""
        found, k = set(), self.lead
        while k >= 0:
            found.add(k)
            k = self.up[k]
        return found

    def decided(self, importance: dict[int, float]) -> Page:
        """``gone`` for each element, ``inside`` for those in articles, ``cut``: how many branches were removed, ``by_tree``: those that would have stayed at full importance.

        One rule: a branch goes where its importance (1 if the tree does not tell) times what HTML says beforehand is below LOW.
        """
        holding = self._holding()
        furniture = sum(self.words[k] for k, t in enumerate(self.tag) if t in ASIDE and (self.up[k] < 0 or self.tag[self.up[k]] not in ASIDE))
        half = (sum(self.words[k] for k, u in enumerate(self.up) if u < 0) - furniture) / 2
        titles = [k for k, t in enumerate(self.tag) if t == "h1" and not self.unseen[k]]
        self.gone, self.inside, self.cut, self.by_tree = [], [], 0, 0
        for k, tag in enumerate(self.tag):
            up = self.up[k]
            inside = tag in MAIN or (up >= 0 and self.inside[up])
            self.inside.append(inside)
            if self.unseen[k] or (up >= 0 and self.gone[up]):
                self.gone.append(True)
                continue
            weight = INSIDE if inside else 1.0
            if (self.named[k] or (tag == "header" and not inside)) and tag not in ("html", "body"):
                excused = self.words[k] >= half and (k in holding or tag == "form" or (self.lead < 0 and self.words[k] >= 1.6 * half))
                if tag in ASIDE or not excused:
                    # what holds the page's only title may be more than furniture
                    weight = TITLED if tag not in ASIDE and titles and all(self._in(t, k) for t in titles) else NAMED
            elif tag in ("ul", "ol") and not inside and self.words[k] == self.linked[k] > 1:
                weight = NAMED  # a list of nothing but links
            value = importance.get(self.path[k], 1.0) if not (inside and tag in HEADINGS) else 1.0
            self.gone.append(tag not in INLINE and value * weight < LOW or tag in INLINE and weight < LOW)
            self.cut += self.gone[k]
            self.by_tree += self.gone[k] and weight >= LOW
        return self

    def _in(self, k: int, top: int) -> bool:
        while k > top:
            k = self.up[k]
        return k == top

    def lines(self) -> list[str]:
        """Blocks in page order. Where a page has an article, a block outside it stays if it is a sentence, a title, or stands between the title and the article."""
        found, now, at, titled, met = [], [], None, False, False

        def end() -> None:
            nonlocal titled
            if line := " ".join("".join(now).split()):
                title = any(self.tag[x] == "h1" for x in self._above(at))
                if self.lead < 0 or self.inside[at] or title or (titled and not met) or line.count(" ") + 1 >= SENTENCE:
                    found.append(line)
                titled |= title
            now.clear()

        for k, text in self.script:
            if text is None:
                end()
                met |= self.inside[k]
            elif not self.gone[k]:
                now.append(text)
                at = k
        end()
        return found

    def _above(self, k: int) -> Iterator[int]:
        while k >= 0:
            yield k
            k = self.up[k]

    def text(self) -> str:
        return "\n".join(self.lines())

    def kin(self) -> int:
        """What pages with copies of one article have in common: the article's first line; without an article, all text."""
        found = self.lines()
        if self.lead < 0:
            return self.hash("\n".join(found))
        own = (" ".join(t.split()) for k, t in self.script if t and self.inside[k] and not self.gone[k])
        return self.hash(next((t for t in own if t), ""))


def style_tree(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, path, seen, importance): the style nodes of each host. pages: (host, html).

    A style counts as often as it occurs; a content counts as often as it does in one page of those
    whose articles begin alike. Nodes that occur once are of importance 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), *[pa.array([(k[c] + 2**63) % 2**64 - 2**63 for k in keys], pa.int64()) for c in (1, 2, 3, 4)], pa.array(list(held.values()), pa.int64())], ["host", "path", "kind", "value", "kin", "n"])
            held.clear()
            return out

        for b in batches:
            for at, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                read = Page(page, counted=True)
                kin = read.decided({}).kin()
                for (path, kind, value), n in read.counts.items():
                    if kind:
                        held[at, path, kind, value, kin] = max(n, held[at, path, kind, value, kin])
                    else:
                        held[at, path, kind, value, 0] += n
                if len(held) >= HELD:
                    yield send()
        if held:
            yield send()

    counts = pages.select("host", "html").mapInArrow(run, "host string, path long, kind long, value long, kin long, n long")
    counts = counts.groupBy("host", "path", "kind", "value", "kin").agg(F.when(F.col("kind") == 1, F.max("n")).otherwise(F.sum("n")).alias("n"))
    counts = counts.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    m, spread = F.sum("n"), F.sum(F.col("n") * F.ln("n"))
    each = counts.groupBy("host", "path", "kind").agg(m.alias("m"), F.when(m > 1, (F.ln(m) - spread / m) / F.ln(m)).otherwise(1.0).alias("e"))
    one = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    tree = each.groupBy("host", "path").agg(F.coalesce(one(1, "m"), one(0, "m")).alias("seen"), one(0, "e").alias("style"), one(1, "e").alias("content"))
    return tree.select("host", "path", "seen", F.coalesce((1 - gamma) * F.col("style") + gamma * F.col("content"), F.col("style")).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", use_tree: bool = True) -> DataFrame:
    """(id, url, text, cut, by_tree) per row: the main text, one block a line, '' if there is none; how many branches were removed, and how many of these would have stayed at full importance.

    Null html is empty, a null or odd url is of the host ''. Counts are summed before they are
    shuffled, so a hot host costs one row for each node and content; pages meet their host's list of
    low branches by ``skew_join``. Repeated rows and ids stay, a page of any length is read whole, an
    empty table gives no rows, further columns are ignored. Without ``use_tree`` HTML's weights decide alone.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host(F.col(url_col)).alias("host"))
    tree = style_tree(base) if use_tree else style_tree(base.where(F.lit(False)))
    low = tree.where((F.col("seen") >= SEEN) & (F.col("importance") < LOW / TITLED)).groupBy("host").agg(F.collect_list("path").alias("low"), F.collect_list("importance").alias("importance"))
    sizes = base.groupBy("host").agg(F.count("*").alias("w"))
    low = written(low.join(sizes, "host"), "style-tree")
    met = skew_join(base, low, "host", "w", sizes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0], "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, importance = (b.column(c).to_pylist() for c in (3, 4))
            read = [Page(page).decided({k % 2**64: v for k, v in zip(paths or (), values or (), strict=True)}) for page, paths, values in zip(b.column(2).to_pylist(), low, importance, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.text() for x in read], pa.string()), *[pa.array([getattr(x, c) for x in read], pa.int64()) for c in ("cut", "by_tree")]], ["id", "url", "text", "cut", "by_tree"])

    kind = dict(base.dtypes)
    return met.select("id", "url", "html", "low", "importance").mapInArrow(run, f"id {kind['id']}, url {kind['url']}, text string, cut long, by_tree long")
