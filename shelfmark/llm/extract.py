"""Main-text extraction with consensus host paths.

A page is read into containers (div, article, section, table cell ...) with generalised tag-class paths, and blocks
of text that are in no boilerplate element. The page's best container is the deepest one that still holds nearly all
of its text, and none inside an article or main. Pages vote for that path, Spark counts the votes of each host, and
every page of the host is extracted again at the winning path; a page without it, with next to nothing there, or
whose host is unknown, uses its own best container. A form is boilerplate unless most of the page's text is in it.

Cases: a null or empty page has empty text, markup that is never closed is closed at the end or where HTML implies
it, a null or odd URL has no host and no vote, ties between paths go to the one that sorts first, repeated rows vote
and are extracted each, an empty table gives an empty result, pages of any length are read whole, other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, bound_batches, tidy

# Element names of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("nav footer aside button select option dialog menu svg object video audio canvas map".split())
CONTAINERS = frozenset("html body div article main section td th center fieldset details".split())
KEPT = frozenset("html body article main".split())
LINE_BREAKS = frozenset(("br", "hr"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these names, if no element of `until` lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Words in class and id that mark what is not the article, and roles that do.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar sidenav footer header masthead topbar comment comments commentlist respond replies disqus share sharing social related "
    "recommended recommendations newsletter subscribe subscription popup modal overlay pagination pager widget widgets toolbar skip login signup search outbrain taboola alert".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NEGATED = frozenset("with has no without".split())
#: Containers whose text is taken whole.
WHOLE = frozenset(("article", "main"))
#: A container is entered if it holds this share of the text of the one around it.
DOMINANT = 0.95
#: The least text at a host's path, as a share of that in the page's own best container.
LEAST_AT_PATH = 0.05
#: A form that holds more than this share of a page's text is no boilerplate.
FORM_OF_PAGE = 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[A-Za-z]+")
_NUMBERS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Containers as (parent, path, whether taken whole) and blocks as (container, text, characters inside links)."""

    def __init__(self, source: str):
        self.containers: list[tuple[int, str, bool]] = [(-1, "", False)]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        # An open element: name, whether it starts dropped text, container inside, path.
        stack: list[tuple[str, bool, int, str]] = []
        dropped = links = 0
        # Open forms, the number of the outermost one (0 outside), and the form of each block.
        open_forms = n_forms = form = 0
        form_of: list[int] = []
        buffer: list[str] = []
        link_chars = at = 0
        here, path = 0, ""

        def flush() -> None:
            nonlocal buffer, link_chars
            if buffer:
                text = "".join(buffer)
                text = " ".join((html.unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((here, text, link_chars))
                    form_of.append(form)
                buffer, link_chars = [], 0

        def close(n: int) -> None:
            """Leave the innermost elements until n are open."""
            nonlocal dropped, links, here, path, open_forms, form
            while len(stack) > n:
                name, drops, *_ = stack.pop()
                dropped -= drops
                links -= name == "a"
                open_forms -= name == "form"
            form = form if open_forms else 0
            here, path = (stack[-1][2], stack[-1][3]) if stack else (0, "")

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            stop = m.start() if m else end
            if stop > at and not dropped:
                buffer.append(source[at:stop])
                if links:
                    link_chars += stop - at
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "br":
                    buffer.append(" ")
                inline = name in INLINE
                for k in range(len(stack) - 1, -1, -1):
                    other = stack[k][0]
                    if other == name:
                        if not inline:
                            flush()
                        close(k)
                        break
                    if inline and other not in INLINE or other == "td" and name not in ("tr", "table", "tbody", "body", "html"):
                        break
                continue
            if name in VOID:
                if name in LINE_BREAKS:
                    flush() if name == "hr" else buffer.append(" ")
                continue
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = closing.end() if closing else end
                continue
            if name not in INLINE:
                flush()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if name in IMPLIED:
                ends, until = IMPLIED[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in ends:
                        close(k)
                        if name != "tr":
                            break
            attributes = m[3]
            if attributes.endswith("/") and name in ("svg", "path", "use"):
                continue
            drops, classes = name in DROPPED, ""
            if name == "header" and not any(x[0] in WHOLE for x in stack):
                drops = True
            if attributes and not attributes.isspace():
                found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
                classes = ".".join(sorted(_NUMBERS.sub("#", found.get("class", "")).split()))
                if name not in KEPT:
                    for label in f"{found.get('class', '')} {found.get('id', '')}".split():
                        words = {w.lower() for w in _PARTS.findall(label)}
                        drops |= not words.isdisjoint(MARKS) and words.isdisjoint(NEGATED)
                    drops |= found.get("role", "").lower() in ROLES
                drops |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
            if name in CONTAINERS and name != "html":
                path = f"{path}/{name}.{classes}" if classes else f"{path}/{name}"
                self.containers.append((here, path, name in WHOLE))
                here = len(self.containers) - 1
            dropped += drops
            links += name == "a"
            if name == "form":
                open_forms += 1
                if open_forms == 1:
                    n_forms += 1
                    form = n_forms
            stack.append((name, drops, here, path))
        flush()
        if n_forms:
            held = [0] * (n_forms + 1)
            for f, (_, text, _) in zip(form_of, self.blocks):
                held[f] += len(text)
            kept = [f == 0 or x > FORM_OF_PAGE * sum(held) for f, x in enumerate(held)]
            self.blocks = [b for f, b in zip(form_of, self.blocks) if kept[f]]

    def weights(self) -> list[float]:
        """Text of each container with all inside it; text of links counts a fifth."""
        out = [0.0] * len(self.containers)
        for c, text, link in self.blocks:
            out[c] += max(len(text) - 0.8 * link, 0)
        for c in range(len(out) - 1, 0, -1):
            out[self.containers[c][0]] += out[c]
        return out

    def best(self) -> int:
        """The deepest container that holds nearly all of the text; articles are not entered."""
        weight, inside = self.weights(), {}
        for c in range(1, len(self.containers)):
            inside.setdefault(self.containers[c][0], []).append(c)
        at = 0
        while at in inside and not self.containers[at][2]:
            top = max(inside[at], key=weight.__getitem__)
            if weight[top] <= 0 or weight[top] < DOMINANT * weight[at]:
                break
            at = top
        return at

    def vote(self) -> tuple[str, int]:
        """Path of the best container and the characters in it."""
        at = self.best()
        return self.containers[at][1], int(self.weights()[at])

    def text(self, path: str | None) -> str:
        """Blocks at the path, or in the best container if the page has next to no text there, joined by spaces."""
        own = self._inside({self.best()})
        chosen = {c for c, x in enumerate(self.containers) if x[1] == path} if path is not None else set()
        found = self._inside(chosen) if chosen else []
        enough = found and sum(map(len, found)) >= LEAST_AT_PATH * sum(map(len, own))
        return " ".join(found if enough else own)

    def _inside(self, chosen: set[int]) -> list[str]:
        into = [c in chosen for c in range(len(self.containers))]
        for c in range(1, len(into)):
            into[c] |= into[self.containers[c][0]]
        return [text for c, text, _ in self.blocks if into[c]]


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Add `host`: lower case, without user, port and `www.`; null if there is none."""
    found = F.regexp_extract(F.lower(F.col(url).cast("string")), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return df.withColumn("host", F.when(found != "", found))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with most votes of each host; pages has host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [Page(x).vote() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.int64())], ["host", "path", "chars"])

    cast = pages.where("host IS NOT NULL AND html <> ''").select("host", "html").mapInArrow(tidy(run), "host string, path string, chars long")
    counted = cast.where("chars > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    # min_by of the negated counts, so that ties go to the path that sorts first.
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("chars"), "path")).alias("path"))


#: Largest table of winning paths, in characters, that is sent to every executor; beyond, it is joined by shuffle.
BROADCAST_CHARS = 8 << 20


def extract(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, url and text (the main text, empty if there is none) of every row."""
    bound_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "extract")
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("html"))
    rows = with_host(rows)
    paths = scratch.write(host_paths(rows), "paths")
    size = paths.agg(F.sum(F.length("host") + F.length("path") + 32)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(x).text(p) for x, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    joined = rows.join(F.broadcast(paths) if size <= BROADCAST_CHARS else paths, "host", "left")
    kind = df.schema[key].dataType.simpleString()
    return joined.select("key", "url", "html", "path").mapInArrow(tidy(run), f"`{key}` {kind}, `{url}` string, text string")
