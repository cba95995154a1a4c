"""Main-text extraction: structure first, nearest-URL page differencing for what structure leaves open.

A page is cut into blocks of text; blocks inside containers that are never the article (menus, page
headers, footers, sidebars, adverts, forms, scripts, notices, comments, by element, role or class)
are dropped. A page with an ``article`` or ``main`` element keeps the other blocks inside it. Every
page is paired with its nearest neighbour by URL path on the same host, whatever structure either
has, and all lines of both (menus and the like too) are aligned by longest common subsequence. Where
that neighbour is a copy or shares nothing, the one on the other side is asked. What both share is
template and is deleted where structure is not certain: all remaining blocks of a page without an
article, and on every page containers named by an everyday word beside one of another meaning
(``share-price``, ``related-work``, ``notice-period``), which are compared as containers, since
a template's slots have other words on each page. Such a container stays if no neighbour has it.

Differencing alone cannot give right results: adverts and menus differ from page to page, and copies
of one article on a host would delete each other, so it neither adds to nor takes from a marked
article's own lines, and pages that share most of their text count as copies and stay whole.

Neighbours come from a range-partitioned sort on (host, path, page), streamed with one row of look
ahead, so a host of any size spreads over partitions; the two rows at either end of a partition are
matched across partitions in a second, small step. Only 64-bit hashes of lines travel.

Defined cases: null or empty html gives an empty text; null URLs form one host; repeated rows get
the same text; broken markup is read as far as it goes (an unclosed container ends where an article
begins); nothing is cut from long pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

# fixed values: element and class names with a meaning in HTML or in common page templates
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea noscript template iframe object svg canvas audio video noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form menu dialog button select head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert form".split())
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social comment comments disqus reply replies respond related recommended recommendations pagination pager toolbar widget skip".split()
)
OPEN_ENDED = frozenset("p li td tr th dt dd option".split())
INSIDE = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
EVERYDAY = frozenset(  # of these, words that name parts of an article too where another word stands beside them
    "related recommended recommendations respond menu notice notices alert share sharing social search cookie cookies consent "
    "subscription subscribe promotion promo banner overlay navigation skip header widget toolbar".split()
)
FILLERS = frozenset(  # words that add no meaning
    "a an the and of to in on for by no js id box container wrapper wrap block slot list lists item items section area inner outer main site page pages left right top bottom bar panel link links "
    "button buttons btn content contents group row col column columns unit module body text title head heading label primary secondary global post posts story stories article articles icon icons image "
    "images img form small large big sm md lg xs xl mobile desktop sticky fixed nav home feed stream tools action actions more all other also see view up down".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?i)\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")


def _named(value: str) -> tuple[set[str], set[str]]:
    """(words of the class and id names, those of them that only stand in a name beside a word of another meaning, if everyday ones)."""
    sure, doubtful = set(), set()
    for one in value.split():
        parts = set(_PARTS.split(one)) - {""}
        marks = parts & (MARKS | INSIDE | {"header"})
        plain = marks <= EVERYDAY and any(x not in MARKS and x not in INSIDE and x not in FILLERS and x != "header" and not x[0].isdigit() for x in parts)
        (doubtful if plain else sure).update(parts)
    return sure, doubtful - sure


def _unwanted(name: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """(0: keep; 1: drop until closed or until an article begins; 2: drop with any article in it, whether a container kept so is doubtful)."""
    if name in NEVER:
        return (2 if name in ("aside", "form", "dialog") else 1), False
    if name == "header" and not in_article:
        return 1, False
    if not attrs or name in ("html", "body", "main"):
        return 0, False
    level, doubt = 0, False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2, False
        if key == "role" and value in ROLES:
            level = max(level, 1)
        elif key in ("class", "id"):
            parts, maybe = _named(value)
            if parts & INSIDE:
                return 2, False
            if parts & MARKS or "header" in parts and not in_article and name != "article":
                level = max(level, 1)
            doubt = doubt or bool(maybe & EVERYDAY)
    level = 0 if name == "article" and level == 1 else level
    return level, doubt and not level and name in BLOCKS and name != "article"


def cut(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """(all text blocks in page order, each with whether structure leaves it in; whether structure settles the main text)."""
    found, settled = marked(page)
    return [(text, kept) for text, kept, _ in found], settled


def marked(page: str) -> tuple[list[tuple[str, bool, str]], bool]:
    """``cut`` with the tag of the doubtful container that a block is in, else an empty text."""
    found: list[tuple[str, int, str]] = []  # 0: in a dropped container, 1: in an article, 2: elsewhere
    held: list[str] = []
    lost: list[str] = []
    seen, inside, drop = False, 0, []  # drop: open elements from the outermost dropped one on
    doubt: list = []  # tag, element and depth of the outermost doubtful container
    at = 0

    def flush(kept: bool) -> None:
        pieces = held if kept else lost
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append((text, (1 if inside else 2) if kept else 0, doubt[0] if doubt and kept else ""))

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            (lost if drop else held).append(page[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in BLOCKS:
            flush(not drop)
        elif name == "br":
            (lost if drop else held).append(" ")
        if name in VOID:
            continue
        if closing:
            if drop:
                for i in range(len(drop) - 1, -1, -1):
                    if drop[i][0] == name:
                        del drop[i:]
                        break
                if name in ("article", "main", "body") and inside:
                    drop.clear()
                if not drop:
                    flush(False)
            if name in ("article", "main") and not drop:
                inside = max(0, inside - 1)
            if doubt and not drop:
                doubt[2] -= name == doubt[1]
                if not doubt[2] or name in ("article", "main", "body"):
                    doubt.clear()
            continue
        level, maybe = _unwanted(name, attrs, inside > 0)
        if drop:
            if name in ("article", "main") and level == 0 and all(d[1] < 2 for d in drop) and not inside:
                drop.clear()
                flush(False)
            else:
                if name not in OPEN_ENDED:
                    drop.append((name, level))
                continue
        if doubt and name == doubt[1]:
            if name in OPEN_ENDED:
                doubt.clear()
            else:
                doubt[2] += 1
        if level:
            drop.append((name, level))
        elif maybe and not doubt:
            doubt[:] = [f"<{name} {' '.join(attrs.lower().split())}>", name, 1]
        elif name in ("article", "main"):
            seen = True
            inside += 1
    if not drop:
        flush(True)
    flush(False)
    return [(text, kind == (1 if seen else 2), tag) for text, kind, tag in found], seen


def blocks(page: str) -> tuple[list[str], bool]:
    """(text blocks in page order that structure leaves in, whether structure settles that they are the main text)."""
    found, settled = cut(page)
    return [text for text, kept in found if kept], settled


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt-Szymanski)."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    from bisect import bisect_left

    tails: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _common(a: str, b: str) -> int:
    x, y = a.split("/"), b.split("/")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def _verdict(row: dict, near: list[dict]) -> list[int]:
    """Lines of ``row`` to delete: those asked for that a neighbour shares. Lines that structure drops anyway have no size."""
    near = [x for x in near if x and x["host"] == row["host"] and x["lines"] and x["lines"] != row["lines"]]
    for other in sorted(near, key=lambda x: -_common(row["path"], x["path"])):
        found = [i for i in shared_lines(row["lines"], other["lines"]) if row["sizes"][i]]
        if found and 2 * sum(row["sizes"][i] for i in found) <= sum(row["sizes"]):
            template = {row["lines"][i] for i in found if row["asked"][i] == 2}  # a container goes with all its lines
            return [i for i in range(len(row["lines"])) if row["asked"][i] == 2 and row["lines"][i] in template or row["asked"][i] == 1 and i in found]
    return []


_LIGHT = "key long, host string, path string, lines array<long>, sizes array<int>, asked array<tinyint>"
_EDGE = f"part int, place int, last boolean, known boolean, gone array<int>, {_LIGHT}"
_EDGE_ARROW = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("last", pa.bool_()), ("known", pa.bool_()), ("gone", pa.list_(pa.int32())), ("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("asked", pa.list_(pa.int8()))])


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of every page; asked is 1 where structure leaves a line open, 2 in a doubtful container, which stands for its lines."""
    for batch in batches:
        lines, sizes, asked = [], [], []
        for page in batch.column("html"):
            found, settled = marked(page.as_py() or "")
            lines.append([_hash(tag or x) for x, _, tag in found])
            sizes.append([len(x) if kept else 0 for x, kept, _ in found])
            asked.append([0 if not kept else 2 if tag else 0 if settled else 1 for _, kept, tag in found])
        yield pa.record_batch([batch.column("key"), batch.column("host"), batch.column("path"), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(asked, pa.list_(pa.int8()))], names=["key", "host", "path", "lines", "sizes", "asked"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts for rows with both neighbours in the partition; the outer two rows are passed on."""
    part = TaskContext.get().partitionId()
    rows = (r for b in batches for r in b.to_pylist())
    before, here, place = None, next(rows, None), 0
    out: list[dict] = []
    held = None
    while here is not None:
        after = next(rows, None)
        known = before is not None and after is not None
        gone = _verdict(here, [before, after]) if known else []
        found = {"part": part, "place": place, "last": after is None, "known": known, "gone": gone, **here}
        if after is None and place > 1 and held is not None:
            out.append(held)  # the last but one, for the row after it to look at
        held = found
        if gone or place < 2 or after is None:
            out.append(found)
            held = None
        before, here, place = here, after, place + 1
        if len(out) >= 512:
            yield pa.RecordBatch.from_pylist(out, _EDGE_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _EDGE_ARROW)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows at the ends of partitions in sorted order: look across the border."""
    rows = [r for b in batches for r in b.to_pylist()]
    out = []
    for i, r in enumerate(rows):
        if not r["known"]:
            near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
            out.append({"key": r["key"], "gone": _verdict(r, near)})
    yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("gone", pa.list_(pa.int32()))]))


SMALL = 100_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of page_id, url, html."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    light = rows.select("key", F.lower(F.substring_index(rest, "/", 1)).alias("host"), F.regexp_extract(rest, "/.*$", 0).alias("path"), "html")
    light = materialise(light.mapInArrow(tidy(_light), _LIGHT), "lines")
    n = max(2, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = light.repartitionByRange(n, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    found = materialise(dealt.mapInArrow(tidy(_stream), _EDGE), "neighbours")
    size = found.groupBy("part").agg(F.max("place").alias("top"))
    edges = found.join(size, "part").where("place < 2 or place >= top - 1").drop("top")  # at most four rows a partition
    across = edges.repartition(1).sortWithinPartitions("part", "place").mapInArrow(tidy(_stitch), "key long, gone array<int>")
    gone = found.where("known").select("key", "gone").unionByName(across).where(F.size("gone") > 0).dropDuplicates(["key"])
    gone = materialise(gone, "shared")
    rows = rows.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, drop in zip(batch.column("html"), batch.column("gone"), strict=True):
                lines, _ = cut(page.as_py() or "")
                out = set(drop.as_py() or ())
                texts.append("\n".join(x for i, (x, kept) in enumerate(lines) if kept and i not in out))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "gone").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
