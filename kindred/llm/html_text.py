"""Main text of HTML pages by nearest-URL page differencing.

Pages are put in the order of host and URL path; each is aligned with the neighbour whose URL path is nearer by two longest common
subsequences: one of its lines' texts, one of their places in the template (a hash of the path of tags).  What
the alignments say decides:

* A line whose text the neighbour shares is the site's and is deleted.
* The blocks of a page are followed from the root into the block that holds most of the text that the neighbour does not share: the body.
  A block beside that way, whose place the neighbour shares, is a slot of the template, filled anew on each page; it is
  deleted if it is mostly links or small against the body.  A block without a place in the neighbour is the page's own and stays.
* Inside the body a shared line is deleted only if nothing beside the body was, and the page on the other side shares it too: an article may quote another.

Names of tags and classes settle ties.  A slot that is named as furniture (nav, footer, class "ad") is deleted whatever its size, one that is an article
or main element is kept.  Two exact checks follow: lines of article elements are never deleted for being shared, since an article may stand at two URLs, and
named furniture that the neighbour does not share, or on a page without a neighbour, is still furniture.  Class names do not
count where they would leave a page with no text.  A neighbour that is a near copy of the page says nothing about it, so the one on
the other side is taken.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import table, unused, utf8_bytes

# Elements of the HTML standard by their role.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())  # text up to the end tag, or to the end
HIDDEN_CONTENT = frozenset("noscript template svg math select canvas object audio video".split())  # dropped with their content if they end
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset label head search".split())
ARTICLE = frozenset("article main".split())
WRAPPERS = frozenset("html body div section table tbody tr td center details".split())  # blocks that may hold the body
# Words that name furniture in class, id and role attributes, and words before them that say the opposite.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus dropdown footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promoted promotion related recommended replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets contentinfo complementary".split()
)
STATES = frozenset("has no with without is not show hide show-hide open single one two left right".split())
SLOTS = WRAPPERS | frozenset("ul ol dl menu nav header footer aside form".split())  # blocks that may be a slot of the template
CLOSES_P = BLOCKS - {"option", "legend", "summary"}
# An end tag may be left out: such an element ends where one of these begins (within the same container).
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDS = frozenset(x for names in ENDED_BY.values() for x in names)
CONTAINERS = frozenset("ul ol menu dl table".split())

# Comments, declarations, tags with quotes taken into account, and tags whose quotes do not match.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
LETTERS = re.compile(r"[a-z]+")

TEXT, IN_ARTICLE, BY_CLASS, BY_TAG = 0, 1, 2, 3  # how a line is named: not at all, article, furniture by class, furniture by tag
NEAR_COPY = 0.8  # of the characters outside of named furniture
MOST = 0.7  # of a block's own text: the part in which the body is looked for
SMALL = 0.25  # of the body's own text: slots of the template up to this size are furniture


def _furniture_name(attributes: str) -> bool:
    """A class, id or role that names furniture.  ``has-sidebar`` and ``no-comments`` say something about the block, not what it is."""
    for m in NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = LETTERS.findall(token)
            if FURNITURE_WORDS.intersection(words) and not STATES.intersection(words):
                return True
    return False


@dataclass
class Page:
    """Lines of a page, in order, and the tree of its blocks; a block comes after the one that holds it."""

    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)  # innermost block of each line
    links: list[int] = field(default_factory=list)  # characters of each line inside links
    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    places: list[int] = field(default_factory=lambda: [0])  # of each block: hash of its path of tags and classes

    def seal(self) -> Page:
        """Lists turned into arrays, with the keys by which lines are aligned."""
        self.kind = np.array(self.kinds, np.int8)
        self.block = np.array(self.blocks, np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.prose = np.maximum(0, self.size - np.array(self.links, np.int64))
        self.place = np.array(self.places, np.uint64)[self.block]
        self.key = np.array([xxhash.xxh64_intdigest(t) for t in self.texts], np.uint64)
        self.body = int(self.size[self.kind < BY_CLASS].sum())
        return self


def parse(source: str | None) -> Page:
    """The page's blocks with text, in page order: character references decoded, white space inside turned into one space.
    Scripts, styles and comments have no lines.  Work and memory are in proportion to the source, however deep its tags are nested."""
    page = Page()
    source = source or ""
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, and the kind and the block outside of it
    open_names: Counter = Counter()
    kind, block, linked, at, end = TEXT, 0, 0, 0, len(source)
    last: dict[str, int] = {}
    lower = None

    def closed(name: str, after: int) -> int:
        """Where the end tag of ``name`` after a position begins, or -1; each name's last end tag is looked for once."""
        nonlocal lower
        if lower is None:
            lower = source.lower() if len(source.lower()) == len(source) else source
        if name not in last:
            last[name] = lower.rfind(f"</{name}")
        return lower.find(f"</{name}", after) if last[name] >= after else -1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.texts.append(text)
                page.kinds.append(kind)
                page.blocks.append(block)
                page.links.append(min(linked, len(text)))
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal kind, block
        kind, block = stack[i][1:]
        for name, _, _ in stack[i:]:
            open_names[name] -= 1
        del stack[i:]

    while at < end:
        m = TOKEN.search(source, at)
        begin = m.start() if m else end
        if begin > at:
            piece = source[at:begin]
            parts.append(piece)
            if open_names["a"]:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        ending, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if ending:
            if name == "br":
                parts.append(" ")
            elif name in BLOCKS:
                flush()
            if open_names[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if stack[i][1] != kind:
                            flush()
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCKS and name not in BLOCKS:
                        break  # an inline end tag does not reach out of its block
            continue
        if name in RAW or name in HIDDEN_CONTENT:
            if name in HIDDEN_CONTENT and attributes.rstrip().endswith("/"):
                continue
            close = closed(name, at)
            if close >= 0:
                stop = source.find(">", close)
                at = stop + 1 if stop >= 0 else end
            elif name in RAW:
                at = end
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES_P and open_names["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if name in ENDED_BY or name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if name in ENDED_BY.get(stack[i][0], ()):
                        pop_to(i)
                        break
                    if stack[i][0] in CONTAINERS:
                        break
        elif name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        if name in VOID:
            continue
        new = kind
        if kind != BY_TAG:
            if name in FURNITURE or attributes and HIDDEN.search(attributes):
                new = BY_TAG
            elif kind != BY_CLASS and name in ARTICLE:
                new = IN_ARTICLE
            elif kind != BY_CLASS and name not in ("html", "body") and attributes and _furniture_name(attributes):
                new = BY_CLASS
        if new != kind:
            flush()
        stack.append((name, kind, block))
        open_names[name] += 1
        kind = new
        if name in BLOCKS:
            c = CLASS.search(attributes) if attributes else None
            named = re.sub(r"\d+", "", (c[1] or c[2] or c[3] or "").lower()) if c else ""
            page.parents.append(block)
            page.tags.append(name)
            page.places.append(xxhash.xxh64_intdigest(f"{page.places[block]:x} {name} {named}"))
            block = len(page.tags) - 1
    flush()
    return page.seal()


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of a with every prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(step)
    return row


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of the elements of ``a`` in a longest common subsequence of a and b, in linear memory (halving a)."""
    shared = np.zeros(len(a), bool)
    ia = np.flatnonzero(np.isin(a, b))
    ib = np.flatnonzero(np.isin(b, a))
    open_ = [(ia, b[ib])]
    while open_:
        rows, y = open_.pop()
        x = a[rows]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        head = int(differ[0]) if len(differ) else n
        shared[rows[:head]] = True
        rows, x, y = rows[head:], x[head:], y[head:]
        n = min(len(x), len(y))
        if not n:
            continue
        differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        shared[rows[len(rows) - tail :]] = True
        rows, x, y = rows[: len(rows) - tail], x[: len(x) - tail], y[: len(y) - tail]
        if not len(x) or not len(y):
            continue
        if len(x) == 1:
            shared[rows] = x[0] in y
            continue
        half = len(x) // 2
        cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
        open_ += [(rows[:half], y[:cut]), (rows[half:], y[cut:])]
    return shared


def common_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``common_lines`` over the runs of equal elements: a slot is shared however many lines fill it."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    runs = common_lines(a[starts], b[np.append(True, b[1:] != b[:-1])])
    return np.repeat(runs, np.diff(np.append(starts, len(a))))


def _host(key: str) -> str:
    return key.split("\0", 1)[0].split("/", 1)[0]


def _path_overlap(a: str, b: str) -> tuple[int, int]:
    """How near two sort keys are: shared leading path segments, then shared leading characters."""
    x, y = a.split("/"), b.split("/")
    segments = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    chars = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return segments, chars


def _subtree_sums(page: Page, values: np.ndarray) -> list[int]:
    """Sum of the lines' ``values`` below each block."""
    sums = np.bincount(page.block, values, minlength=len(page.tags)).astype(np.int64).tolist()
    for b in range(len(sums) - 1, 0, -1):
        sums[page.parents[b]] += sums[b]
    return sums


def _body_block(page: Page, own: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The block of the body; for each block, whether it is inside; and the highest block above it (or itself) that is
    neither on the way to the body's block nor that block, -1 for those."""
    best: dict[int, int] = {}  # of each block the child with most own text
    for b in range(1, len(own)):
        p = page.parents[b]
        if p not in best or own[b] > own[best[p]]:
            best[p] = b
    at, way = 0, {0}
    while page.tags[at] not in ARTICLE:
        child = best.get(at)
        if child is None or page.tags[child] not in WRAPPERS | ARTICLE or own[child] < MOST * own[at] or not own[child]:
            break
        at = child
        way.add(at)
    top = np.full(len(own), -1, np.int64)
    inside = np.zeros(len(own), bool)
    inside[at] = True
    for b in range(1, len(own)):
        p = page.parents[b]
        inside[b] |= inside[p]
        if b not in way:
            top[b] = top[p] if top[p] >= 0 else b
    return at, inside, top


def decide(page: Page, sides: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the lines that stay, and of those that go because of the neighbour (see the head of this module).  ``sides`` are the
    pages before and after on the same host, the nearer first."""
    n = len(page.texts)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    kind = page.kind
    if not page.prose[kind < BY_CLASS].sum() and (kind == BY_CLASS).any():
        kind = np.where(kind == BY_CLASS, TEXT, kind)  # class names would leave nothing
    usable = []
    for other in sides:
        common = common_lines(page.key, other.key)
        if page.size[common & (page.kind < BY_CLASS)].sum() < NEAR_COPY * max(page.body, other.body):
            usable.append((other, common))
    article, furniture = kind == IN_ARTICLE, kind >= BY_CLASS
    if not usable:
        return ~furniture, np.zeros(n, bool)
    other, same_text = usable[0]
    same_place = common_places(page.place, other.place)
    sums = lambda flags: np.array(_subtree_sums(page, np.where(flags, page.prose, 0)))
    own = sums(~same_text & ~furniture)
    root, inside, top = _body_block(page, own.tolist())
    inside, top = inside[page.block], top[page.block]
    # Slots of the template: blocks with a place in the neighbour that are mostly links or, beside the body, small.
    total, prose = np.array(_subtree_sums(page, page.size)), np.array(_subtree_sums(page, page.prose))
    slot = np.maximum(top, 0)
    block = np.array([t in SLOTS for t in page.tags])[slot] & (top >= 0)
    filled = block & same_place & ((2 * prose[slot] <= total[slot]) | ~inside & (own[slot] <= SMALL * own[root]))
    beside = ~inside & (same_text | filled | furniture & same_place)
    # A body that stands apart from the site's lines holds none of them.
    quoted = same_text & inside & (not beside.any())
    if len(usable) > 1:
        quoted &= usable[1][1]
    by_neighbour = (beside | quoted | inside & filled) & ~article | furniture & (same_text | same_place)
    return ~by_neighbour & ~furniture, by_neighbour


def main_text(page: Page, sides: list[Page]) -> tuple[str, int]:
    """The page's text and the number of lines that went because of the neighbour."""
    keep, gone = decide(page, sides)
    return "\n".join(t for t, k in zip(page.texts, keep, strict=True) if k), int(gone.sum())


def url_key(url: Column, page_id: Column) -> Column:
    """Host and path of a URL, then the page's id: the order in which neighbours stand."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return F.concat(host, path, F.lit("\0"), F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0"))


def _bounds(keys: DataFrame, rows: int, n: int, oversample: int = 8) -> np.ndarray:
    """Up to n - 1 keys that cut ``keys`` into n ranges of similar size, from a sample of about n * oversample rows."""
    if n < 2:
        return np.empty(0, object)
    column = keys.columns[0]
    sample = keys.filter(F.rand(7) < n * oversample / rows).toPandas()[column].sort_values().to_numpy()
    return np.array(sorted(set(sample[oversample::oversample])), object)


def _range_of(key: Column, bounds: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(object), side="right"), dtype="int32")

    return of(key) if len(bounds) else F.lit(0)


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rows_per_range: int = 500,
    max_ranges: int = 8192,
    task_bytes: int = 8 << 20,
) -> DataFrame:
    """``(page_id, url, text, n_chars, n_shared)`` for every row: the main text, its blocks joined by a newline, its code points, and the
    number of lines deleted because of the neighbour.

    Null and empty pages, and pages without text, give an empty text.  A null URL sorts before all others and is
    compared with its neighbours in that order; null ids keep their rows.  Equal keys (repeated rows) are neighbours
    of each other, and near copies, so they say nothing about each other.  A very long page is parsed whole, in memory in proportion to it.
    Ids may be of any type.  An empty table gives no rows.  Other columns are ignored.

    Pages are dealt to at most ``max_ranges`` ranges of keys, of about ``rows_per_range`` rows until that number is reached, and to one task for each ``task_bytes``.  The
    page on either side of a range is sent along with it and each range is read as a stream, so results do
    not depend on the ranges, nor memory on their length.
    """
    key = unused(pages, "key")
    id_type = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn(key, url_key(F.col("url"), F.col("page_id")))
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(utf8_bytes(F.col("html"))), F.lit(0))).first()
    bounds = _bounds(rows.select(key), n_rows, min(max_ranges, -(-n_rows // rows_per_range)))
    rows = rows.withColumn("range", _range_of(F.col(key), bounds))
    # The pages next to each range: the last key before it and the first key after it.
    ends = rows.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("range").collect()
    halo = [(e["high"], n["range"]) for e, n in zip(ends, ends[1:], strict=False)] + [(n["low"], e["range"]) for e, n in zip(ends, ends[1:], strict=False)]
    dealt = rows.withColumn("real", F.lit(True))
    if halo:
        near = pages.sparkSession.createDataFrame(halo, f"`{key}` string, to int")
        copies = rows.join(F.broadcast(near), key).select("page_id", "url", "html", key, F.col("to").alias("range"), F.lit(False).alias("real"))
        dealt = dealt.unionByName(copies)
    n_tasks = max(1, min(len(ends), -(-n_bytes // task_bytes), max_ranges))
    dealt = dealt.repartition(n_tasks, "range").sortWithinPartitions("range", key)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_shared"])
        return out.astype({"page_id": "Int64" if isinstance(id_type, IntegralType) else object})

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walks the pages in order with the one before and the one after at hand: (range, key, real, id, URL, page)."""
        last = now = None

        def done(before, this, after):
            sides = [s for s in (before, after) if s and s[0] == this[0] and _host(s[1]) == _host(this[1])]
            sides.sort(key=lambda s: _path_overlap(this[1], s[1]), reverse=True)
            text, shared = main_text(this[5], [s[5] for s in sides])
            return this[3], this[4], text, len(text), shared

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                new = (r.range, r.k, r.real, r.page_id, r.url, parse(r.html))
                if now and now[2]:
                    out.append(done(last, now, new))
                last, now = now, new
            if out:
                yield frame(out)
        if now and now[2]:
            yield frame([done(last, now, None)])

    schema = f"page_id {id_type.simpleString()}, url string, text string, n_chars long, n_shared long"
    return dealt.withColumnRenamed(key, "k").mapInPandas(difference, schema)


def op3_nearest_url_differencing(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_nearest_url_differencing": op3_nearest_url_differencing}
