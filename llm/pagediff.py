"""Main text of HTML pages: markup that says what is no article, and differences to the nearest page of the host.

A page is read into lines, one for each block of text, each of one of three kinds: of an
element whose tag, role, id or class names it as a menu, header, footer, sidebar,
notice, advert, form or comment (OUT); of a declared article (IN); or of neither (OPEN).
Pages are ordered by host and path, and a page is paired with the one before and the
one after it on its host. The lines outside the declared article are aligned with each of the two
by a longest common subsequence, and lines shared with either are deleted, as are all OUT lines that
nothing shares. If the lines shared with a page hold half the page's OPEN text or more, the two are copies of
one text, and that page deletes nothing. Lines of a declared article stay, also where a
neighbour repeats them: a license line or a copied article is still part of it. OPEN lines
of a page with a declared article go, unless the article holds under a quarter of the text; then
nothing counts as declared.

Only hashes of lines are sorted and sent between pages; the order is a range partitioning, so
a host with a third of all pages is spread over many tasks. Pages on both sides of a range's
edge are paired through a table with the names of each range's first and last page, and their hashes are joined to those names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks_for, written
from .urltree import split_urls

OUT, OPEN, IN = "-", "?", "+"
DECLARED, COPY = 0.25, 0.5
ROWS_KEPT = 1 << 26  # bits of the rows of an alignment that are held at once; longer ones are halved

# Elements and names of HTML.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "!doctype"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
          "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
OUT_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "object", "svg", "canvas", "button", "select", "datalist", "audio", "video", "map", "search"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"}
OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "adbox", "adunit", "banner", "banners", "sponsor", "sponsored", "sponsors",
             "promo", "promos", "promotion", "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "widget", "widgets",
             "footer", "foot", "header", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "cookie", "cookies",
             "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form",
             "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "pagination", "pager", "copyright", "disclaimer", "skip", "outbrain", "taboola",
             "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios", "werbung", "anzeige", "publicite", "publicidad"}
IN_WORDS = {"article", "articlebody", "articletext", "articlecontent"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")  # possessive: no text makes it go back
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNLESS = {"has", "with", "no", "is", "without", "not"}


def _named_out(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and words[0] not in _UNLESS and not OUT_WORDS.isdisjoint(words)


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """OUT, IN or OPEN as an element's start tag says; ``inside`` an article its header belongs to it."""
    if tag in OUT_TAGS or (tag == "header" and not inside):
        return OUT
    if not attributes or tag in ("html", "body"):
        return IN if tag in ("article", "main") else OPEN
    kind = IN if tag in ("article", "main") else OPEN
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return OUT
        if key == "role":
            if value.lower() in OUT_ROLES:
                return OUT
            kind = IN if value.lower() in ("article", "main") else kind
        elif key == "itemprop" and value.lower() == "articlebody":
            kind = IN
        elif key in ("class", "id"):
            for name in entities.unescape(value).split():
                if _named_out(name) and not (inside and name.lower().endswith("header")):
                    return OUT
                if re.sub(r"[^a-z]", "", name.lower()) in IN_WORDS:
                    kind = IN
    return kind


def lines_of(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each block of a page, in order; tags that the page's end cuts off are dropped."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements and what they say
    names: Counter[str] = Counter()
    kinds: Counter[str] = Counter()

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((OUT if kinds[OUT] else IN if kinds[IN] else OPEN, line))
            text.clear()

    def close(upto: int) -> None:
        for name, kind in stack[upto:]:
            names[name] -= 1
            kinds[kind] -= 1
        del stack[upto:]

    def close_open(among: set[str], within: set[str]) -> None:
        """Close the nearest of ``among``, if no element of ``within`` lies between."""
        if any(names[n] for n in among):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in among:
                    close(i)
                    return
                if stack[i][0] in within:
                    return

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text.append(entities.unescape(page[at:start]) if "&" in page[at:start] else page[at:start])
        at = start
        if at == size:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)  # <!--> is a whole comment
            at = size if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
        elif m := _TAG.match(page, at):
            at = m.end()
            closing, tag, attributes = m[1], m[2].lower(), m[3]
            block = tag in BLOCKS
            if block:
                flush()
            if closing:
                if names[tag]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            if kinds[OUT] and any(k == OUT for _, k in stack[i:]):
                                flush()
                            close(i)
                            break
                        if not block and stack[i][0] in BLOCKS:
                            break  # an inline element does not end a block
                continue
            if tag == "br":
                text.append(" ")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = end.start() if end else size
                continue
            if tag in VOID or attributes.endswith("/") and tag in ("path", "circle", "rect", "use"):
                continue
            if block:
                close_open({"p"}, BLOCKS - {"p"})
            if tag in CLOSED_BY:
                close_open(CLOSED_BY[tag], {"ul", "ol", "dl", "table", "select", "menu"})
            kind = _kind(tag, attributes, bool(kinds[IN]))
            if kind == OUT and not block:
                flush()
            stack.append((tag, kind))
            names[tag] += 1
            kinds[kind] += 1
        elif re.match(r"</?[A-Za-z]", page[at : at + 3]):
            break  # cut off inside a tag
        elif page.startswith("</", at):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
        else:
            text.append("<")
            at += 1
    flush()
    n = Counter()
    for kind, line in out:
        n[kind] += len(line)
    if n[IN] <= DECLARED * (n[IN] + n[OPEN]):
        out = [(OPEN if kind == IN else kind, line) for kind, line in out]
    return out


def shared_places(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence of a and b."""
    low, ha, hb = 0, len(a), len(b)
    while low < min(ha, hb) and a[low] == b[low]:
        low += 1
    while min(ha, hb) > low and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    out = set(range(low)) | set(range(ha, len(a)))
    both = set(a[low:ha]) & set(b[low:hb])
    if both:  # all others cannot be in it
        x, y = [i for i in range(low, ha) if a[i] in both], [v for v in b[low:hb] if v in both]
        out.update(_common(x, [a[i] for i in x], y))
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a, bits over b: 0 where its common subsequence with b's prefix grows by one."""
    masks: dict[int, int] = {}
    for j, v in enumerate(b):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        hit = row & masks.get(v, 0)
        row = (row + hit | row - hit) & full
        yield row


def _grown(row: int, n: int) -> list[int]:
    """Lengths of common subsequences with each prefix of b, from a row's bits."""
    out, length = [0], 0
    for bit in reversed(f"{row:0{n}b}" if n else ""):
        length += bit == "0"
        out.append(length)
    return out


def _common(places: list[int], a: list[int], b: list[int]) -> list[int]:
    """Places (of a's values) in a longest common subsequence; halved where rows of all prefixes would be too many."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ROWS_KEPT:
        half = len(a) // 2
        *_, up = _rows(a[:half], b)
        *_, down = _rows(a[half:][::-1], b[::-1])
        one, two = _grown(up, len(b)), _grown(down, len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: one[j] + two[j])
        return _common(places[:half], a[:half], b[:cut]) + _common(places[half:], a[half:], b[cut:])
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(places[i])
            j -= 1
    return out


def _hashes(lines: list[tuple[str, str]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for k, t in lines if k != IN]


def main_text(lines: list[tuple[str, str]], near: list[list[int]]) -> tuple[list[str], int]:
    """Lines that stay, and how many lines were shared with the pages of whose lines ``near`` holds the hashes."""
    outside = [(k, t) for k, t in lines if k != IN]
    own, shared = _hashes(lines), set()
    open_size = sum(len(t) for k, t in outside if k == OPEN)
    for other in near:
        found = shared_places(own, other)
        same = sum(len(outside[i][1]) for i in found if outside[i][0] == OPEN)
        shared |= {i for i in found if outside[i][0] == OUT or same < COPY * open_size}
    declared, k, out = any(kind == IN for kind, _ in lines), 0, []
    for kind, line in lines:
        if kind == IN:
            out.append(line)
            continue
        if kind == OPEN and not declared and k not in shared:
            out.append(line)
        k += 1
    return out, len(shared)


def _parsed(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Pages with their lines, compressed, or only with the hashes of the lines outside an article."""
    for b in batches:
        lines = [lines_of(h or "") for h in b.column("html").to_pylist()]
        if texts:
            more = pa.array([zlib.compress("\n".join(k + t for k, t in page).encode("utf-8", "replace"), 1) for page in lines], pa.binary())
        else:
            more = pa.array([_hashes(page) for page in lines], pa.list_(pa.int64()))
        names = [n for n in b.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), more], [*names, "lines" if texts else "hashes"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for packed, *near in zip(*(b.column(c).to_pylist() for c in ("lines", "before", "after")), strict=True):
            raw = zlib.decompress(packed).decode()
            lines = [(x[0], x[1:]) for x in raw.split("\n")] if raw else []
            kept, shared = main_text(lines, [n for n in near if n])
            text = "\n".join(kept)
            out.append((text, len(text), len(lines), shared))
        text, *numbers = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)],
                                         ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])


def _neighbours(pages: DataFrame) -> DataFrame:
    """key, check, before, after: the hashes of the pages before and after in the order of (host, path, key), where they are of the same host."""
    order = ["host", "path", "key", "check"]
    ranges = written(pages.repartitionByRange(tasks_for(pages), *order).withColumn("range", F.spark_partition_id()), "ranges")
    name, page = F.struct("key", "check"), F.struct("host", "hashes")
    ends = ranges.groupBy("range").agg(F.min_by(name, F.struct(*order)).alias("first"), F.max_by(name, F.struct(*order)).alias("last"))
    edge = Window.orderBy("range")  # a row of numbers for each range
    ends = ends.select("first", "last", F.lag("last").over(edge).alias("left"), F.lead("first").over(edge).alias("right"))
    link = lambda own, other, left: F.struct(F.col(own).alias("own"), F.col(other).alias("other"), F.lit(left).alias("is_left"))
    links = ends.select(F.inline(F.array(link("first", "left", True), link("last", "right", False)))).where("other is not null")
    across = ranges.select(name.alias("other"), page.alias("page")).join(F.broadcast(links), "other")  # pages at the ends of ranges alone
    across = across.groupBy("own.key", "own.check").agg(*[F.any_value(F.when(F.col("is_left") == left, F.col("page")), True).alias(c) for c, left in (("left", True), ("right", False))])
    inside = Window.partitionBy("range").orderBy(*order)
    near = ranges.select("key", "check", "host", F.lag(page).over(inside).alias("before"), F.lead(page).over(inside).alias("after")).join(across.hint("merge"), ["key", "check"], "left")
    same = lambda p: F.when(p["host"] == F.col("host"), p["hashes"])
    return near.select("key", "check", same(F.coalesce("before", "left")).alias("before"), same(F.coalesce("after", "right")).alias("after"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared for each row of ``pages`` (page_id, url, html).

    ``text`` is the main text, one line for each block; n_lines counts the blocks of the page, n_shared those outside
    its article that a page next to it on its host has, too. A null or empty page has no text. Pages whose url is null or has no
    "://" have an empty host in common. Rows equal in all three columns are one page (known by 96 bits of hashes) and get equal results. Other columns are
    ignored, whatever they are called; an empty table gives no rows.

    Pages are parsed twice, once for the hashes and once for the lines, so that only compressed lines are shuffled, once, and no text is written.
    """
    own = [pages[c].alias(c) for c in ("page_id", "url", "html")]
    p = pages.select(*own, F.xxhash64(*(pages[c] for c in ("page_id", "url", "html"))).alias("key"), F.hash(*(pages[c] for c in ("page_id", "url", "html"))).alias("check"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema if f.name in ("page_id", "url"))
    hashed = p.select("key", "check", "url", "html").mapInArrow(lambda b: _parsed(b, False), "key long, check int, url string, hashes array<long>")
    hashed = written(hashed.dropDuplicates(["key", "check"]), "hashes")
    near = _neighbours(split_urls(hashed.withColumnRenamed("key", "page_id"), "check", "hashes").withColumnRenamed("page_id", "key"))
    lines = p.mapInArrow(lambda b: _parsed(b, True), f"{kinds}, key long, check int, lines binary")
    both = lines.join(near.hint("shuffle_merge"), ["key", "check"]).drop("key", "check")
    return both.mapInArrow(_finished, f"{kinds}, text string, n_chars long, n_lines long, n_shared long")
