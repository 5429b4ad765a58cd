"""HTML main text by consensus of a host's pages on container paths.

First scan: each page is cut into blocks, and every container (element that holds blocks, and the page itself) is
scored by what it would yield: its good text less its link text, with a bonus for content elements and names, as a
share of the page's best; among equals the deeper counts. Each page gives the scores of all its containers to their paths
of tags and classes, with numbers generalised. Spark sums them by host and path and takes each host's best path. Second
scan: a page's text is that of the containers of its host's path; a page without text there, or without a host, uses
its own best container.

Blocks: text between the tags of block elements, with character references decoded, white space as one space,
trimmed; empty ones are dropped. Text in BOILER_TAGS, in elements whose class, id or role names boilerplate, and
in raw elements isn't good text. A name counts by its first and last word. Within an article, ids and the names of
paragraphs and headings count only if they are one STRONG word, and of a header its headings stay. What only a weak
word names is good text after all if it is OVERRULED of the page's text or more, or, for WEAK_LINKS, if it has
OVERRULED_TEXT characters or more and few of them are links.

Time is linear in the page's length: a tag ends at the next '<' outside quotes at the latest, a quote that is never
closed is an ordinary character, and elements deeper than DEPTH belong to the one at that depth (their text stays).

Edge cases: a null or empty page gives an empty text; markup that isn't closed or nested well is read as far as
it goes; a null url has no host; repeated rows each give a row; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

DEPTH = 256
OVERRULED = 0.25
OVERRULED_TEXT = 80
OVERRULED_LINKS = 0.3
BROADCAST_HOSTS = 100_000
SALTS = 32
BOILER_TAGS = frozenset("nav header footer aside form button select option dialog menu noscript template svg math object iframe canvas audio video head label fieldset datalist".split())
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that hold one block; the others hold blocks.
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox advertisment banner sponsor sponsored sponsors promo promoted promotion"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead sidebar sidebars widget widgets"
    " sharing social cookie cookies consent gdpr notices notification popup modal newsletter subscribe subscription signup"
    " login signin paywall comment comments commentlist disqus reply replies respond complementary contentinfo".split()
)
#: Words that mostly stand for links, and for notes.
WEAK_LINKS = frozenset("header footer foot aside rail related recommended recommendations trending popular share search legal tags byline print skip".split())
WEAK_NOTES = frozenset("notice alert overlay dialog feedback copyright disclaimer hidden".split())
GOOD_WORDS = frozenset("article content main post entry story text body page".split())
_STATES = frozenset("has with no without is not".split())

_START = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _named(tag: str, attributes: str, article: bool) -> tuple[str, int, bool]:
    """An element's label in paths, whether its names speak of boilerplate (1, 2: by a weak word, 3: by a strong one), and of content."""
    label, level, good = [], 0, False
    for kind, *values in _NAMES.findall(attributes):
        kind, value = kind.lower(), _html.unescape(next((v for v in values if v), ""))
        if kind == "hidden" or kind == "aria-hidden":
            level = 3 if kind == "hidden" else level
            continue
        for name in value.split():
            words = _TOKEN.findall(_HUMP.sub("-", name).lower())
            if not words or words[0] in _STATES:
                continue
            ends = {words[0], words[-1]}
            good |= not GOOD_WORDS.isdisjoint(ends)
            if article and (kind == "id" or tag in BLOCK_TAGS):
                level = max(level, 3 if len(words) == 1 and words[0] in STRONG else 0)
            else:
                level = max(level, 3 if not STRONG.isdisjoint(ends) else 2 if not WEAK_NOTES.isdisjoint(ends) else int(not WEAK_LINKS.isdisjoint(ends)))
        if kind == "class":
            label = sorted({_DIGITS.sub("#", x) for x in value.split()})
    return ".".join([tag, *label]), 0 if level < 3 and good else level, good


def _tag_end(source: str, at: int, missing: dict[str, bool]) -> tuple[int, int]:
    """(end of the attributes that start at a place, place after the tag)."""
    while True:
        at = _PLAIN.match(source, at).end()
        if at >= len(source) or source[at] == "<":
            return at, at
        if source[at] == ">":
            return at, at + 1
        quote, close = source[at], -1
        if not missing.get(quote) and source[max(0, at - 8) : at].rstrip()[-1:] == "=":
            close = source.find(quote, at + 1)
            missing[quote] = close < 0
        at = close + 1 if close >= 0 else at + 1


class _Open:
    """An open element: what holds for the blocks directly within it."""

    __slots__ = ("article", "block", "boiler", "container", "headings", "tag", "weak")

    def __init__(self, tag: str, container: int, boiler: bool, weak: int, article: bool, headings: bool, block: int):
        self.tag, self.container, self.boiler, self.weak, self.article, self.headings, self.block = tag, container, boiler, weak, article, headings, block


class Page:
    """Blocks: [container's index, text, is good, characters in links, number of the weakly named element around it or 0].
    Containers: (key of the path, label, depth, bonus, parent)."""

    def __init__(self, source: str):
        self.blocks: list[list] = []
        self.containers: list[tuple[int, str, int, float, int]] = [(0, "", 0, -0.2, -1)]  # the page, which all templates of a host have
        stack = [_Open("", 0, False, 0, False, False, 0)]
        opened, skipped = Counter(), Counter()
        held: list[str] = []
        links: list[str] = []
        in_link, weak_names, missing = False, [0], {}

        def flush() -> None:
            if held:
                text = " ".join(_html.unescape("".join(held)).split())
                if text:
                    e = stack[-1]
                    n = len(" ".join("".join(links).split())) if links else 0
                    good = not e.boiler and not (e.headings and not any(x.tag in HEADINGS for x in stack))
                    self.blocks.append([e.container, text, good, n, e.weak])
                held.clear()
            links.clear()

        def say(text: str) -> None:
            held.append(text)
            if in_link:
                links.append(text)

        def push(e: _Open) -> None:
            stack.append(e)
            opened[e.tag] += 1

        def cut(k: int) -> None:
            for e in stack[k:]:
                opened[e.tag] -= 1
            del stack[k:]

        at, end = 0, len(source)
        while at < end:
            begin = source.find("<", at)
            if begin < 0:
                say(source[at:])
                break
            if begin > at:
                say(source[at:begin])
            if source.startswith("<!--", begin):
                close = source.find("-->", begin + 4)
                at = close + 3 if close >= 0 else end
                continue
            m = _START.match(source, begin + 1)
            if m is None:
                if source[begin + 1 : begin + 2] in ("!", "?", "/"):
                    close = source.find(">", begin)
                    at = close + 1 if close >= 0 else end
                else:
                    say("<")
                    at = begin + 1
                continue
            stop, at = _tag_end(source, m.end(), missing)
            closing, tag, attributes = m[1], m[2].lower(), source[m.end() : stop]
            if tag in RAW_TAGS and not closing:
                if not attributes.rstrip().endswith("/") or tag in ("script", "style"):
                    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    close = source.find(">", m.end()) if m else -1
                    at = close + 1 if close >= 0 else end
                continue
            if tag == "br" or tag == "wbr":
                held.append(" " if tag == "br" else "")
                continue
            if tag == "a":
                in_link = not closing
            inline = tag in INLINE_TAGS
            if closing:
                if skipped[tag]:
                    skipped[tag] -= 1
                    if not inline:
                        flush()
                elif inline:
                    # an inline end tag doesn't close blocks
                    k = next((k for k in range(len(stack) - 1, stack[-1].block, -1) if stack[k].tag == tag), 0) if opened[tag] else 0
                    if k:
                        flush()
                        cut(k)
                else:
                    flush()
                    if opened[tag]:
                        cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                continue
            if tag in VOID_TAGS:
                if not inline:
                    flush()
                continue
            label, level, good = _named(tag, attributes, stack[-1].article) if attributes and not attributes.isspace() else (tag, 0, False)
            if inline and level < 3:
                continue
            flush()
            if not inline:
                self._close(stack, tag, opened, cut)
            if len(stack) >= DEPTH:
                skipped[tag] += 1
                continue
            e = stack[-1]
            if inline:
                push(_Open(tag, e.container, True, e.weak, e.article, e.headings, e.block))
                continue
            whole = tag in ("html", "body", "article", "main")
            level, headings, weak = 0 if whole else level, e.headings, e.weak
            if e.article and level < 3 and (tag == "header" or any(c.endswith("header") for c in label.split(".")[1:])):
                headings, level = True, 0
            elif tag in BOILER_TAGS:
                level = 3
            if 0 < level < 3 and not weak:
                weak = len(weak_names)
                weak_names.append(level)
            container = e.container
            if tag not in BLOCK_TAGS and tag not in ("html", "body"):
                key, _, depth, _, _ = self.containers[container]
                bonus = 0.3 if tag in ("article", "main") else 0.2 if good else 0.0
                self.containers.append((xxhash.xxh3_64_intdigest(f"{key}>{label}"), label, depth + 1, bonus, container))
                container = len(self.containers) - 1
            push(_Open(tag, container, e.boiler or level == 3, weak, e.article or tag in ("article", "main"), headings, len(stack)))
        flush()
        self._overrule(weak_names)

    @staticmethod
    def _close(stack: list[_Open], tag: str, opened: Counter, cut) -> None:
        """Ends the elements that the start of tag ends: paragraphs, and items of the same list or table."""
        k = stack[-1].block
        if k and (stack[k].tag == "p" or stack[k].tag in HEADINGS and tag in HEADINGS):
            cut(k)
        elif tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    cut(k)
                    return
                if stack[k].tag in _STOPS[tag]:
                    return

    def _overrule(self, names: list[int]) -> None:
        """Text that only weak words call boilerplate is good if it is much of the page or, of links' words, not links."""
        size, links = [0] * len(names), [0] * len(names)
        for _, text, good, link, weak in self.blocks:
            if good:
                size[weak] += len(text) - link
                links[weak] += link
        total = sum(size)
        fine = [k == 0 or n >= OVERRULED * total or k == 1 and n >= OVERRULED_TEXT and m <= OVERRULED_LINKS * (n + m) for k, n, m in zip(names, size, links, strict=True)]
        for b in self.blocks:
            b[2] = b[2] and fine[b[4]]

    def scores(self) -> dict[int, tuple[float, int, str]]:
        """By path: a share of the page's best, the depth, and the last element's label."""
        net = [0] * len(self.containers)
        for container, text, good, link, _ in self.blocks:
            if good:
                net[container] += len(text) - 2 * link
        for k in range(len(net) - 1, 0, -1):  # parents come first
            net[self.containers[k][4]] += net[k]
        out: dict[int, tuple[float, int, str]] = {}
        for k, (key, label, depth, bonus, _) in enumerate(self.containers):
            if net[k] > 0:
                out[key] = out[key][0] + net[k] * (1 + bonus) if key in out else net[k] * (1 + bonus), depth, label
        best = max((v[0] for v in out.values()), default=1.0)
        return {key: (score / best, depth, label) for key, (score, depth, label) in out.items()}

    def text(self, key: int) -> str:
        """The good blocks of the containers with this path's key (0: the page)."""
        inside = [key == 0] * len(self.containers)
        for k, (of, _, _, _, parent) in enumerate(self.containers):
            inside[k] = inside[k] or of == key or k > 0 and inside[parent]
        return "\n\n".join(b[1] for b in self.blocks if b[2] and inside[b[0]])


def _best(scores: dict[int, tuple[float, int, str]]) -> int:
    return min(scores, key=lambda k: (-scores[k][0], -scores[k][1], k)) if scores else 0


def extract(source: str | None, key: int | None) -> str:
    """The text of one page, given its host's path."""
    if not source:
        return ""
    page = Page(source)
    scores = page.scores()
    return page.text(key if key in scores else _best(scores))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, html) to (host, key, path): each host's path of the largest sum of its pages' scores, and its last label."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, k, depth, label[:200], s) for h, source in zip(pdf["host"], pdf["html"], strict=True) if source for k, (s, depth, label) in Page(source).scores().items()]
            votes = pd.DataFrame(rows, columns=["host", "key", "depth", "path", "score"])
            votes = votes.assign(key=np.array([r[1] for r in rows], np.uint64).view(np.int64), score=(votes["score"].astype(float) * 1e6).round().astype("int64"))
            yield votes.groupby(["host", "key"], as_index=False).agg(depth=("depth", "min"), path=("path", "min"), score=("score", "sum"))

    votes = pages.filter("host is not null").mapInPandas(vote, "host string, key long, depth long, path string, score long")
    votes = votes.groupBy("host", "key").agg(F.sum("score").alias("score"), F.min("depth").alias("depth"), F.min("path").alias("path"))
    return votes.groupBy("host").agg(F.min_by(F.struct("key", "path"), F.struct(-F.col("score"), -F.col("depth"), "key")).alias("best")).select("host", "best.*")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and path (the last element of the host's, null where none).

    Paths are broadcast for up to BROADCAST_HOSTS hosts (three columns a host); with more they are joined by shuffle,
    where the pages of one host are dealt to SALTS keys, to each of which its path is copied.
    """
    ship(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.col(url)), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    rows = pages.select(*keep, F.col(html).alias("html"), F.when(F.length(host) > 0, host).alias("host"))
    paths = table(host_paths(rows.select("host", "html")), "paths")
    on = ["host"]
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    else:
        paths, on = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"]
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))

    @F.pandas_udf("string")
    def text(source: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([extract(s, None if k is pd.NA else int(k) % (1 << 64)) for s, k in zip(source, key.astype("string"), strict=True)], dtype=object)

    # keys go as text: a null among numbers would make them floats
    return rows.join(paths, on, "left").select(*keep, text("html", F.col("key").cast("string")).alias("text"), "path")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
