"""Main text of web pages, by differencing pages that are neighbours by URL.

Pages of a host are ordered by path, each page's text lines are aligned with
those of the page before and after it by a longest common subsequence, and
lines that a neighbour shares are template text, which goes.

Markup that says what a part is comes first: what stands in navigation, headers,
footers, sidebars, forms, notices, adverts, comments and scripts is never main
text, and what stands in ``article`` or ``main`` always is.  Names of classes count as
a whole; where only a part of one says so, the part of the page is open.  There, a shared line is
not deleted: copies of an article stand on neighbouring pages, and plain
differencing would delete them whole.  Differencing decides on all other lines.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from msgflow.llm.neighbours import with_neighbours
from msgflow.llm.words import pieces, text_column

BOILERPLATE, OPEN, MAIN = 0, 1, 2
_CLOSED = -1  # boilerplate in which article and main mean nothing

#: Elements, roles, and words in class and id that say a part is not main text (fixed values).
OTHER_TAGS = frozenset("nav header footer aside form head script style noscript template button select textarea iframe svg "
                       "dialog menu object video audio canvas".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OTHER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
                        "navbar navigation breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent gdpr "
                        "popup modal newsletter subscribe signup share sharing social comment comments reply replies respond "
                        "discussion disqus related recommended widget pagination pager".split())
#: Those of parts that hold articles of their own.
_CARD_WORDS = frozenset("comment comments reply replies respond discussion disqus related recommended".split())
_MAIN_TAGS = frozenset(("article", "main"))
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr".split())
#: An open element of the first name ends where one of the others begins.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"},
             "p": set("p div article section main aside header footer nav form ul ol dl table blockquote pre h1 h2 h3 h4 h5 h6 hr".split())}

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _mark(name: str, attributes: str) -> str:
    """What an element says of itself: "other", "cards" or "class" (by whole names), "doubt" (by parts of names), or nothing."""
    if name in OTHER_TAGS:
        return "other"
    if name in ("html", "body") or not attributes:
        return ""
    mark = ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        for own in "".join(values).split():
            if key.lower() == "role":
                if own.lower() in OTHER_ROLES:
                    return "other"
            elif own.lower() in OTHER_WORDS:
                mark = "cards" if own.lower() in _CARD_WORDS or mark == "cards" else "class"
            elif not mark and any(w in OTHER_WORDS for w in re.findall("[a-z0-9]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", own).lower())):
                mark = "doubt"
    return mark


def _state(outer: int, name: str, attributes: str) -> int:
    """Where the content of an element stands, given where the element does.

    Words of class and id never decide alone on ``article`` and ``main``: those that carry one, or stand
    in a part that does, are open, and so are parts whose names only hold such a word (``has-sidebar``).
    """
    mark = _mark(name, attributes)
    if outer == _CLOSED or mark == "other":
        return _CLOSED
    if name in _MAIN_TAGS:
        return OPEN if outer == BOILERPLATE or mark in ("cards", "class") else MAIN
    if mark in ("cards", "class"):
        return _CLOSED if mark == "cards" else BOILERPLATE
    return OPEN if mark == "doubt" and outer == MAIN and name not in _INLINE else outer


def lines(page: str) -> list[tuple[str, int]]:
    """The text of each block in page order, white space made one space, and where it stands: see OPEN, MAIN, BOILERPLATE."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # name, where the element stands
    where = OPEN

    def close() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append((line, max(where, BOILERPLATE)))

    def pop(to: int) -> None:
        nonlocal where
        while len(stack) > to:
            where = stack.pop()[1]

    place = 0
    while True:
        tag = _TAG.search(page, place)
        parts.append(entities.unescape(page[place:tag.start() if tag else len(page)]))
        if not tag:
            break
        place = tag.end()
        if not tag.group(2):
            continue
        name = tag.group(2).lower()
        if name not in _INLINE:
            close()
        if tag.group(1):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if any(stack[i][0] not in _INLINE for i in range(depth, len(stack))):
                    close()
                pop(depth)
            continue
        for i in range(len(stack) - 1, -1, -1):
            if name in _ENDED_BY.get(stack[i][0], ()):
                pop(i)
            elif stack[i][0] not in _INLINE:
                break
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, place)
            place = end.end() if end else len(page)
        elif name not in _VOID and not tag.group(3).endswith("/"):
            inner = _state(where, name, tag.group(3))
            if name in _INLINE and inner != where:
                close()
            stack.append((name, where))
            where = inner
    close()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``.

    Bit-parallel: each line of ``a`` costs a few operations on integers of as many
    bits as ``b`` has lines in common with ``a``.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    other = [x for x in b if x in both]
    if not at:
        return set()
    masks: dict[str, int] = {}
    for j, x in enumerate(other):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, [full]
    for i in at:
        hit = row & masks[a[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # A zero bit j of a row says that b's first j + 1 lines hold one more common line than its first j.
    found, j = set(), len(other) - 1
    for k in range(len(at), 0, -1):
        while j >= 0 and rows[k] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[k - 1] >> j & 1:
            found.add(at[k - 1])
            j -= 1
    return found


def main_text(own: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]], copy: float = 0.8) -> str:
    """The main lines and the open ones that no neighbour shares, in page order, joined by one space.

    A neighbour that shares more than ``copy`` of the main and open text is a copy of the
    page, not of its template, and decides nothing.  If no neighbour decides, all open lines
    stay, unless the main ones hold at least as much text: then markup decides, and they go.
    """
    texts, gone, decided = [x for x, _ in own], set(), False
    size = {where: sum(len(x) for x, at in own if at == where) for where in (OPEN, MAIN)}
    if size[OPEN]:
        for other in neighbours:
            shared = common_lines(texts, [x for x, _ in other])
            if sum(len(texts[i]) for i in shared if own[i][1] != BOILERPLATE) <= copy * (size[OPEN] + size[MAIN]):
                gone |= shared
                decided = True
    stay = decided or size[OPEN] > size[MAIN]
    return " ".join(x for i, (x, where) in enumerate(own) if where == MAIN or where == OPEN and stay and i not in gone)


def url_key(url: Column, *more: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment, and then ``more``, as a string to order by."""
    pattern = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    path = F.when(F.regexp_like(url, F.lit(pattern)), F.regexp_extract(url, pattern, 2)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1))
    return F.concat_ws("\u0001", host, path, *more)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    Neighbours are the pages before and after in the order of host, path and id, if
    they are of the same host; pages that share a URL are neighbours of each other.
    A null or empty html, or one without main text, gives the empty text; a null url
    counts as the empty one, with no host of its own.  Repeated rows are copies of
    each other and get equal texts.  Other columns are not read; no pages give no rows.
    """
    rows = pages.select(F.col(page_id).alias("own_id"), F.col(url).alias("own_url"), F.coalesce(html, F.lit("")).alias("page"))
    link = F.coalesce("own_url", F.lit(""))
    number = F.lpad(F.coalesce(F.col("own_id").cast("string"), F.lit("")), 20, "0")
    rows = rows.withColumn("key", url_key(link, number, F.xxhash64("page").cast("string")))
    near = with_neighbours(rows, "key", ["page"], rows_per_bucket=500, before=True)
    id_type = pages.schema[page_id].dataType.simpleString()

    def run(batches):
        before, now = None, None  # (bucket, border, id, url, host, lines)

        def text(after):
            return main_text(now[5], [x[5] for x in (before, after) if x and x[0] == now[0] and x[4] == now[4]])

        for batch in batches:
            for start, stop in pieces(text_column(batch.column(5))):
                out = []
                part = batch.slice(start, stop - start)
                for bucket, border, own_id, own_url, key, page in zip(*[part.column(i).to_pylist() for i in range(6)]):
                    new = (bucket, border, own_id, own_url, key.split("\u0001", 1)[0], lines(page or ""))
                    if now and now[1] == 0:
                        out.append((now[2], now[3], text(new)))
                    before, now = now, new
                yield _rows(out, batch.schema)
                last_schema = batch.schema
        if now and now[1] == 0:
            yield _rows([(now[2], now[3], text(None))], last_schema)

    def _rows(out, schema):
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], schema.field(2).type), pa.array([x[1] for x in out], pa.string()),
             pa.array([x[2] for x in out], pa.string()), pa.array([len(x[2]) for x in out], pa.int64())],
            [page_id, url, "text", "n_chars"])

    return near.select("bucket", "border", "own_id", "own_url", "key", "page").mapInArrow(
        run, f"`{page_id}` {id_type}, `{url}` string, text string, n_chars long")
