"""Main-text extraction by nearest-URL page differencing.

Pages are read into text lines (blocks).  What is no text, or marks itself as something else than the
article (menus, footers, forms, adverts, reader comments, ...), is left out while reading; an element that does so
but holds the article is kept without its inner parts.  Pages of a host stand next to each other in the order of
their URL paths; each page is aligned with its neighbours, the nearest pages with other lines, by the longest common
subsequence of lines, and the shared lines, the host's furniture, are deleted.  Lines that the page itself marks as its
article stay; they are all of the text where they make up most of what differencing leaves.  Pages of equal lines that
stand together are copies: they have the same neighbours and the same text.  What a neighbour shares beyond most of the
page goes only where the other neighbour shares it too, as one of them may be a version of the page.

The order is cut into ranges by a slim pass over the URLs and digests of the lines; then each page's lines are
shuffled once, to the task of its range, and the pages that are neighbours across the edge of a range also to that
range.  A host or a group of copies of any size is spread over many ranges.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import arrow_schema, materialize

#: share of a page's characters that a neighbour may delete alone; beyond it both neighbours must share a line
COPY_SHARE = 0.8
#: neighbours of a page: one to either side, or all to one side at the edges of a host
NEIGHBOURS = 2
RANGES_PER_PARTITION = 4

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul""".split())
#: elements a new one of the same family ends
FAMILY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
#: elements that are never article text
LEFT_OUT = frozenset("""head nav aside footer form button select option dialog template svg math object canvas audio video
menu datalist label""".split())
#: names (class, id) of page parts that are not the article
PARTS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar
navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets cookie cookies consent
gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related
recommended recommendations comment comments commentlist disqus reply replies respond pagination pager skip toolbar
copyright""".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: pieces of the names of wrappers, which may name a part that stands in them
HOLDERS = frozenset("""and with layout page pages wrapper wrap container content contents main outer inner body left right col cols
column columns grid row""".split())
#: left out with all in it unless it holds the article: elements, roles and names by how sure they are
HOLDER, NAMED, PART, NEVER = 1, 2, 3, 4
#: share of a page's text that is next to nothing
LITTLE = 0.1
PART_ELEMENTS = {"form": HOLDER, "nav": PART, "aside": PART, "footer": PART, "header": PART, "menu": PART}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MARKS = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_NEGATED = re.compile(r"^(?:no|has|with|without|hide|hidden)[-_]", re.I)


def _name_kind(word: str) -> int:
    """How surely a class or id names another part of the page; 0: it does not."""
    if _NEGATED.match(word):
        return 0
    pieces = [p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", word) if p]
    named = [p for p in pieces if p in PARTS]
    if not named:
        return 0
    if len(named) == len(pieces) or pieces[0] in COMMENTS:
        return PART
    if any(p in HOLDERS for p in pieces):
        return HOLDER
    return PART if any(p in COMMENTS for p in named) else NAMED


def _is_part(attributes: str) -> tuple[int, bool]:
    """(how surely another part of the page, the marked article) by the attributes of an element."""
    kind, mark = 0, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden":
            kind = NEVER
        elif name == "role":
            kind = max(kind, PART if value.lower() in ROLES else 0)
            mark |= value.lower() in MARKS
        elif name == "itemprop":
            mark |= value == "articleBody"
        else:
            kind = max([kind, *map(_name_kind, value.split())])
    return kind, mark


#: text, marked as article, the left-out elements it stands in, in an article inside of these
_Line = tuple[str, bool, tuple[int, ...], bool]


def _kept(lines: list[_Line], kinds: list[int]) -> list[tuple[str, bool]]:
    """The lines outside left-out elements, and those of left-out elements that hold the article.

    A wrapper is kept, without its inner parts, when it holds most of the text that can be the article; one that is
    no wrapper by its name only when next to nothing is kept without it.  So is an article in left-out elements when it
    is most of the articles in such elements and of the text outside; in a certain part (a menu, reader comments) only
    on pages that mark no other article."""
    if not any(chain for _, _, chain, _ in lines):
        return [(line, marked) for line, marked, _, _ in lines]

    def holders(sizes: list[tuple[int, tuple[int, ...]]]) -> set[int]:
        held, total = [0] * len(kinds), sum(n for n, _ in sizes)
        for n, chain in sizes:
            for w in chain:
                held[w] += n
        return {w for w, n in enumerate(held) if 2 * n > total}

    def standing_in(most: int) -> list[tuple[int, tuple[int, ...]]]:
        return [(len(line), chain) for line, _, chain, _ in lines if all(kinds[w] <= most for w in chain)]

    articles = holders([(len(line), chain) for line, _, chain, article in lines if article or not chain])
    if any(marked and not chain for _, marked, chain, _ in lines):
        articles = {w for w in articles if kinds[w] < PART}
    wrappers = {w for w in holders(standing_in(HOLDER)) if kinds[w] == HOLDER} | {w for w in articles if kinds[w] <= NAMED}

    def choose() -> list[tuple[str, bool]]:
        return [(line, marked) for line, marked, chain, article in lines
                if all(w in wrappers or (article and w in articles) for w in chain)]

    found, could = choose(), standing_in(NAMED)
    if sum(len(line) for line, _ in found) < LITTLE * sum(n for n, _ in could):
        wrappers |= {w for w in holders(could) if kinds[w] <= NAMED}
        found = choose()
    return found


def read_lines(page: str) -> list[tuple[str, bool]]:
    """(text, marked as article) of the blocks of a page that may be article text, in page order."""
    lines: list[_Line] = []
    kinds: list[int] = []  # of the left-out elements
    # element, (left-out elements it stands in or None for never, in an article inside of these), marked
    stack: list[tuple[str, tuple[tuple[int, ...] | None, bool], bool]] = []
    text: dict[tuple[tuple[int, ...] | None, bool], list[str]] = {}
    at = 0
    place, marked = ((), False), False

    def add(piece: str) -> None:
        if place[0] is not None:
            text.setdefault(place, []).append(piece)

    def end_block() -> None:
        for (chain, article), pieces in text.items():
            line = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if line:
                lines.append((line, marked, chain, article))
        text.clear()

    def leave(to: int) -> None:
        nonlocal place, marked
        if any(tag in BLOCK for tag, *_ in stack[to:]):
            end_block()
        del stack[to:]
        place, marked = stack[-1][1:] if stack else (((), False), False)

    while at < len(page):
        m = _TOKEN.search(page, at)
        add(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            else:
                if tag in BLOCK:
                    end_block()
            continue
        if tag in BLOCK:
            end_block()
            for k in range(len(stack) - 1, -1, -1):  # implied ends
                open_ = stack[k][0]
                if open_ == "p" or open_ in FAMILY.get(tag, ()):
                    leave(k)
                    break
                if open_ in BLOCK:
                    break
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        kind, mark = _is_part(m[3]) if m[3] else (0, False)
        chain, article = place
        mark |= tag in MARKS
        named, kind = kind, 0 if tag in ("html", "body", "article", "main") or (mark and kind < NEVER) else kind
        if tag in LEFT_OUT or (tag == "header" and not marked):
            kind = max(kind, PART_ELEMENTS.get(tag, NEVER))
        if kind:
            if chain is None or kind == NEVER or article:  # an article's own parts are none of it
                place = None, False
            else:
                kinds.append(kind)
                place = (*chain, len(kinds) - 1), False
        elif chain is None or (chain and named):  # such as the articles of a list of comments
            mark = False
        elif chain and mark:
            place = chain, True
        marked |= mark and not kind
        stack.append((tag, place, marked))
    end_block()
    return _kept(lines, kinds)


# --------------------------------------------------------------------------- differencing

def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other`` (bit-parallel, with all rows kept to walk back)."""
    first = 0
    while first < min(len(own), len(other)) and own[first] == other[first]:
        first += 1
    last = 0
    while last < min(len(own), len(other)) - first and own[-1 - last] == other[-1 - last]:
        last += 1
    shared = set(range(first)) | set(range(len(own) - last, len(own)))
    there = set(other[first:len(other) - last])
    mine = [i for i in range(first, len(own) - last) if own[i] in there]  # others cannot be shared
    if not mine:
        return shared
    where: dict[str, int] = {}
    for bit, i in enumerate(mine):
        where[own[i]] = where.get(own[i], 0) | 1 << bit
    theirs = [line for line in other[first:len(other) - last] if line in where]
    full = (1 << len(mine)) - 1
    state, rows = full, []
    for line in theirs:
        both = state & where[line]
        state = ((state + both) | (state - both)) & full
        rows.append(state)
    column, row = len(mine), len(theirs)
    while row and column:
        bit = 1 << (column - 1)
        if rows[row - 1] & bit:
            column -= 1
            continue
        row -= 1
        if row and not rows[row - 1] & bit:
            continue
        column -= 1
        shared.add(mine[column])
    return shared


def difference(own: list[tuple[str, bool]], neighbours: list[list[tuple[str, bool]]]) -> list[str]:
    """The page's lines without those it shares with its neighbours.

    A line goes where one neighbour shares it that is no version of the page (the page shares at most ``COPY_SHARE`` with
    it), or where all do.  The mark of an article only protects: a marked line stays, as a sentence that articles of a
    host have in common is no furniture.  A line that no neighbour shares always stays, marked or not."""
    lines = [line for line, _ in own]
    article = {i for i, (_, marked) in enumerate(own) if marked}
    if len(article) == len(lines):
        return lines  # nothing that differencing may delete
    size, gone = sum(map(len, lines)), set()
    shared = [shared_lines(lines, [line for line, _ in other]) for other in neighbours]
    for places in shared:
        if sum(len(lines[i]) for i in places) <= COPY_SHARE * size:
            gone |= places
    if len(shared) > 1:
        gone |= set.intersection(*shared)
    return [lines[i] for i in range(len(lines)) if i in article or i not in gone]


# --------------------------------------------------------------------------- operator

def url_key(url: Column, page: Column) -> Column:
    """Host, path, and what else tells pages apart, in one string that sorts by them; null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"(?:/|\.html?)+$", "")
    return F.when(host != "", F.concat_ws("\u0001", host, path, url, F.coalesce(page.cast("string"), F.lit(""))))


def _host(key: str) -> str:
    return key[:key.index("\u0001")]


def page_key(key: str, lines: list[tuple[str, bool]]) -> str:
    """``url_key`` followed by the digest of the page's lines, by which copies are known."""
    return key + "\u0001" + hashlib.blake2b(repr(lines).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _run(key: str) -> tuple[str, str]:
    """(host, digest): equal for copies."""
    return _host(key), key[key.rindex("\u0001"):]


def context_of(ranges: list[tuple[list[str], list[str]]]) -> dict[str, list[int]]:
    """The ranges that need a page of another range as a neighbour, by its key.

    ``ranges`` has a key of each of the first and of the last NEIGHBOURS + 1 runs of copies of every range, in order."""
    needs: dict[str, list[int]] = {}
    for order in (range(len(ranges)), range(len(ranges) - 1, -1, -1)):
        back = order.step > 0
        near: list[str] = []  # keys of the runs beside the range, nearest first
        for k in order:
            firsts, lasts = ranges[k] if back else (ranges[k][1][::-1], ranges[k][0][::-1])
            if near and _run(near[0]) == _run(firsts[0]):
                near = near[1:]
            for key in near[:NEIGHBOURS]:
                needs.setdefault(key, []).append(k)
            # fewer runs than asked for are all of them: what was beside this range is near the next one too
            near = lasts[::-1] + (near if len(lasts) <= NEIGHBOURS else [])
            near = near[:NEIGHBOURS + 1]
    return needs


_LINES = "lines array<struct<line:string,marked:boolean>>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) per page: the main text, blocks joined by two \\n.

    Null and empty pages have an empty text and are nobody's neighbours; pages without a host (null url) have no
    neighbours; repeated rows are copies and delete nothing of each other.  Other columns are not read; an empty table
    gives no rows."""
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        url_key(F.col(url_col), F.col(id_col)).alias("key"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_out, ends_out = arrow_schema("key string"), arrow_schema("firsts array<string>, lasts array<string>")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                found = ((x["key"], read_lines(x["html"])) for x in batch.slice(i, 512).to_pylist())
                yield pa.RecordBatch.from_pylist([{"key": page_key(key, lines)} for key, lines in found if lines], schema=key_out)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: list[str] = []
        lasts: list[str] = []
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if lasts and _run(lasts[-1]) == _run(key):
                    continue
                if len(firsts) <= NEIGHBOURS:
                    firsts.append(key)
                lasts = [*lasts[-NEIGHBOURS:], key]
        if firsts:
            yield pa.RecordBatch.from_pylist([{"firsts": firsts, "lasts": lasts}], schema=ends_out)

    keyed = materialize(slim.select("key", "html").where("key IS NOT NULL").mapInArrow(keys, "key string"), "page-keys")
    found = keyed.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(ends, "firsts array<string>, lasts array<string>")
    edges = sorted(((r["firsts"], r["lasts"]) for r in found.collect()), key=lambda e: e[0][0].encode())  # one row per range, n at most
    lows, needs = [firsts[0].encode() for firsts, _ in edges], context_of(edges)
    kind = slim.schema["id"].dataType.simpleString()
    read_schema = f"range int, key string, context boolean, id {kind}, url string, {_LINES}"
    read_out = arrow_schema(read_schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part, rows = batch.slice(i, 512), []
                for x in part.to_pylist():
                    own = read_lines(x["html"])
                    row = {"key": None, "id": x["id"], "url": x["url"], "lines": [{"line": t, "marked": k} for t, k in own]}
                    if x["key"] is None or not own:
                        by = (x["html"] or x["url"] or "").encode("utf-8", "surrogatepass")
                        rows.append(row | {"range": -1 - zlib.crc32(by) % n, "context": False})  # spread, no neighbours
                        continue
                    row["key"] = key = page_key(x["key"], own)
                    rows.append(row | {"range": bisect_right(lows, key.encode()) - 1, "context": False})
                    rows += [row | {"range": k, "context": True} for k in needs.get(key, ())]
                yield pa.RecordBatch.from_pylist(rows, schema=read_out)

    schema = f"id {kind}, url string, text string"
    out = arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of copies: (range and run, lines, (id, url) of the pages to write); the pages of a run wait for the runs after it
        runs: list[tuple[tuple, list[tuple[str, bool]], list[tuple]]] = []

        def write(at: int) -> Iterator[pa.RecordBatch]:
            (place, run), own, waiting = runs[at]
            near = [[o[1] for o in side if o[0][0] == place and o[0][1][0] == run[0]]  # of this range and host
                    for side in (runs[max(at - NEIGHBOURS, 0):at][::-1], runs[at + 1:at + 1 + NEIGHBOURS])]
            some = [side[0] for side in near if side] if all(near) else near[0] + near[1]
            if waiting:
                text = "\n\n".join(difference(own, some))
                step = max(1, min(512, (1 << 22) // (len(text) + 1)))
                for i in range(0, len(waiting), step):
                    yield pa.RecordBatch.from_pylist([{"id": a, "url": b, "text": text} for a, b in waiting[i:i + step]], schema=out)
            waiting.clear()

        for batch in batches:
            for i in range(0, len(batch), 512):
                alone = []
                for x in batch.slice(i, 512).to_pylist():
                    own = [(v["line"], v["marked"]) for v in x["lines"]]
                    if x["key"] is None:
                        alone.append({"id": x["id"], "url": x["url"], "text": "\n\n".join(difference(own, []))})
                        continue
                    place = x["range"], _run(x["key"])
                    if not runs or runs[-1][0] != place:
                        runs.append((place, own, []))
                        if len(runs) > 2 * NEIGHBOURS + 1:
                            del runs[0]
                        if len(runs) > NEIGHBOURS:
                            yield from write(len(runs) - 1 - NEIGHBOURS)
                    if not x["context"]:
                        runs[-1][2].append((x["id"], x["url"]))
                yield pa.RecordBatch.from_pylist(alone, schema=out)
        for at in range(len(runs)):
            yield from write(at)

    return slim.mapInArrow(read, read_schema).repartition("range").sortWithinPartitions("range", "key") \
        .mapInArrow(compare, schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
