"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host, URL path and page id, and each is paired with the neighbour in its host whose path shares
the longest prefix with its own. The text lines of the two, furniture included, are aligned by their longest common
subsequence; lines that both have are template lines and are deleted. A neighbour that holds nearly all of a page's
lines outside furniture is a copy of it and no template; the next nearest is taken, or none.

Lines come with their place in the markup, which adds two things that two pages can't show:

* Articles of one site quote the same passages. Inside the page's own article or main element a shared line is deleted
  only where it is a frame: at least ``FRAMES`` neighbours that are no copies are at hand, all of them share it, and so
  they do every line between it and the content's start or end. Shared lines amid own ones are quotes and stay.
* Sites rotate menus, adverts and notices, so neighbours seldom have all of them in common. What differencing leaves of
  menus, headers, footers, sidebars, notices, adverts, forms and reader comments goes by their elements, roles and
  class names.

The sort is by ranges whose bounds come from a fixed sample of keys, and a range gets its neighbours' pages next to its
bounds as well, so pairs don't depend on the ranges or the cluster, a host with a third of all pages is spread over many
tasks, and a task holds seven pages at a time.

Defined results: a null or empty html has the empty text; a page alone in its host (or without a host) is paired with
none; repeated rows each get a result; other columns are not read.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quelora.llm.common import blocks, map_batches

#: Pages of a range, about, the most ranges, and the sampled keys that bound them.
RANGE_ROWS = 2048
RANGES = 20_000
SAMPLE = 50_000
#: A neighbour that holds more than this share of a page's lines is a copy.
COPY_SHARE = 0.9

#: Pages before and after a page that are its neighbours, and how many of them must share a frame of the content.
REACH = 3
FRAMES = 3

# HTML elements, and the words by which class names tell furniture or nothing.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "svg"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer",
    "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "paywall", "popup", "promo", "related", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
NEUTRAL_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "form", "global", "inner", "item", "items", "left", "links", "list",
    "main", "outer", "page", "panel", "post", "primary", "right", "secondary", "section", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper",
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

CONTENT, OTHER, FURNITURE = 1, 2, 3


def _names_furniture(value: str, in_content: bool) -> bool:
    """Whether class names or an id tell furniture: a name does that has a furniture word and otherwise neutral words
    alone. Inside the declared content all names must be of such words."""
    told = False
    for name in value.split():
        words = [w for w in re.split(r"[\W_\d]+", name.lower()) if w]
        known = all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS for w in words)
        if known and any(w in FURNITURE_WORDS for w in words):
            told = True
        elif in_content and not known:
            return False
    return told


def _chrome(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the page's declared content."""
    if tag in CHROME or (tag == "header" and not in_content):
        return True, False
    content = tag in ("article", "main")
    if "=" in attributes:
        for kind, *values in _NAMES.findall(attributes):
            value = next((v for v in values if v), "")
            if kind.lower() == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form"):
                return True, False
            if kind.lower() == "role" and value.lower() == "main":
                content = True
            elif kind.lower() != "role" and tag not in ("html", "body", "article", "main") and _names_furniture(value, in_content):
                return True, False
    return False, content


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of the page's blocks, in order; white space is one space, ends trimmed."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    chrome = content = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, FURNITURE if chrome else CONTENT if content else OTHER))
        held.clear()

    def close(to: int) -> None:
        nonlocal chrome, content
        flush()
        for _, a, b in stack[to:]:
            chrome -= a
            content -= b
        del stack[to:]

    page, at = page or "", 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            held.append(page[at:])
            break
        held.append(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if token[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1] or stack[k][2] or tag in BLOCK:
                        close(k)
                    else:
                        del stack[k]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if not token[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in VOID or token[3].rstrip().endswith("/"):
            continue
        if tag in BLOCK:  # an unclosed drawing or paragraph ends where a block begins
            drawing = next((k for k, x in enumerate(stack) if x[0] == "svg"), None)
            if drawing is not None:
                close(drawing)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                if stack[k : k + 1] == [] or stack[k][0] in BLOCK:
                    break
        is_chrome, is_content = _chrome(tag, token[3], content > 0)
        if is_chrome or is_content:
            flush()
        stack.append((tag, is_chrome, is_content))
        chrome += is_chrome
        content += is_content
    flush()
    return out


def shared(a: list[str], b: list[str], cells: int = 40_000_000) -> np.ndarray:
    """Flags of the lines of a that a longest common subsequence with b holds.

    Bit-parallel rows over b; beyond ``cells`` a is halved at the best cut of b, so memory stays bounded."""
    flags = np.zeros(len(a), dtype=bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    flags[:head] = True
    flags[len(a) - tail :] = True
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y or not set(x) & set(y):
        return flags
    if len(x) > 1 and len(x) * len(y) > cells:
        half = len(x) // 2
        cut = int(np.argmax(_prefix_lengths(x[:half], y) + _prefix_lengths(x[half:][::-1], y[::-1])[::-1]))
        flags[head : head + half] = shared(x[:half], y[:cut], cells)
        flags[head + half : len(a) - tail] = shared(x[half:], y[cut:], cells)
        return flags
    rows = _rows(x, y)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # the length doesn't grow at this line of b
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # it grew here without this line of a already
            i -= 1
        else:
            flags[head + i - 1] = True
            i, j = i - 1, j - 1
    return flags


def _rows(x: list[str], y: list[str]) -> list[int]:
    """After each line of x, the bit vector whose zero bits are where the common length grows along y."""
    ones = (1 << len(y)) - 1
    at: dict[str, int] = {}
    for k, line in enumerate(y):
        at[line] = at.get(line, 0) | 1 << k
    rows = [ones]
    for line in x:
        row = rows[-1]
        met = row & at.get(line, 0)
        rows.append(((row + met) | (row - met)) & ones)
    return rows


def _prefix_lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Common subsequence length of x and each prefix of y."""
    row = _rows(x, y)[-1]
    raw = np.frombuffer(row.to_bytes((len(y) + 7) // 8, "little"), np.uint8)
    zero = 1 - np.unpackbits(raw, bitorder="little")[: len(y)].astype(np.int64)
    return np.concatenate(([0], np.cumsum(zero)))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path with its query) of a URL."""
    rest = (url or "").split("//", 1)[-1]
    host, _, path = rest.partition("/")
    return host.lower(), path


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Page:
    def __init__(self, key: tuple, host: str, path: str, page: str | None, context: bool = False):
        self.key, self.host, self.path, self.context = key, host, path, context
        self.lines = lines(page)
        self.texts = [t for t, _ in self.lines]
        self.places = np.array([p for _, p in self.lines], dtype=np.int8)

    def _alignments(self, neighbours: list[Page]) -> list[np.ndarray]:
        """Flags of the lines shared with each neighbour of the host that is no copy, the nearest first."""
        out = []
        body = self.places != FURNITURE
        for other in sorted((p for p in neighbours if p.host == self.host and self.host), key=lambda p: -_common(p.path, self.path)):
            found = shared(self.texts, other.texts)
            if not body.any() or found[body].mean() <= COPY_SHARE:
                out.append(found)
        return out

    def _frame(self, flags: list[np.ndarray]) -> np.ndarray:
        """Flags of the shared lines at the start and end of the content, if there are neighbours enough to tell."""
        frame = np.zeros(len(self.places), dtype=bool)
        at = np.flatnonzero(self.places == CONTENT)
        if len(flags) >= FRAMES and len(at):
            own = np.flatnonzero(~np.logical_and.reduce(flags)[at])
            if len(own):
                frame[at[: own[0]]] = frame[at[own[-1] + 1 :]] = True
        return frame

    def text(self, neighbours: list[Page]) -> tuple[str, int, int, int]:
        """Main text, number of lines shared with the nearest neighbour, of lines that differencing deletes, and of
        further lines that are furniture by their markup."""
        flags = self._alignments(neighbours)
        nearest = flags[0] if flags else np.zeros(len(self.places), dtype=bool)
        template = (nearest & (self.places != CONTENT)) | self._frame(flags)
        furniture = (self.places == FURNITURE) & ~template
        keep = ~(template | furniture)
        return "\n".join(t for t, k in zip(self.texts, keep, strict=True) if k), int(nearest.sum()), int(template.sum()), int(furniture.sum())


FOUND = "id long, url string, text string, n_lines_shared long, n_lines_deleted long, n_lines_furniture long"


def _boundaries(keys: DataFrame) -> dict[str, list[int]]:
    """Ranges beside their own that need the pages of a key: those next to a bound. keys: (key, range); what comes to
    the driver is 2 x REACH keys for each range."""
    up, down = (Window.partitionBy("range").orderBy(order) for order in (F.col("key"), F.col("key").desc()))
    ranked = keys.withColumns({"first": F.row_number().over(up), "last": F.row_number().over(down)})
    out: dict[str, list[int]] = {}
    for r in ranked.where((F.col("first") <= REACH) | (F.col("last") <= REACH)).collect():
        out.setdefault(r.key, []).extend([r.range - 1] * (r.first <= REACH) + [r.range + 1] * (r.last <= REACH))
    return {k: sorted(set(v)) for k, v in out.items()}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_lines_shared (with the nearest neighbour), n_lines_deleted (as template) and
    n_lines_furniture (further lines that go by their markup) of every page."""
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rest = F.substring_index(F.coalesce("url", F.lit("")), "//", -1)
    mark = F.lit("\x01")
    key = F.concat(F.lower(F.substring_index(rest, "/", 1)), mark, rest, mark, F.coalesce(F.lpad(F.col("id").cast("string"), 20, "0"), F.lit("")))
    rows = slim.count()
    ranges = max(1, min(RANGES, -(-rows // RANGE_ROWS)))
    bounds: list[str] = []
    if ranges > 1:
        every = max(1, rows // SAMPLE)
        keys = sorted(r.k for r in slim.where(F.pmod(F.xxhash64("id", "url"), F.lit(every)) == 0).select(key.alias("k")).collect())
        bounds = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
    context = pages.sparkSession.sparkContext

    def numbers(batches: Iterator[pa.RecordBatch], bound=context.broadcast(bounds)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(bound.value, k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(at, pa.int32())], ["key", "range"])

    near = _boundaries(map_batches(slim.select(key.alias("key")), numbers, "key string, range int")) if bounds else {}
    dealing = context.broadcast((bounds, near))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, beside = dealing.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            yield _dealt(batch, [bisect.bisect_right(cuts, k) for k in keys], False)
            more = [(n, r) for n, k in enumerate(keys) for r in beside.get(k, ()) if 0 <= r <= len(cuts)]
            if more:
                yield _dealt(batch.take(pa.array([n for n, _ in more], pa.int64())), [r for _, r in more], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Page] = []
        now = 0  # place in held of the next page to decide
        for batch in blocks(batches, "html", 2 << 20):
            rows = []
            for doc, url, source, extra in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "context")), strict=True):
                held.append(Page((doc, url), *split_url(url), source, extra))
                if len(held) - now > REACH:
                    rows += _decided(held, now)
                    now += 1
                if now > REACH:
                    del held[: now - REACH]
                    now = REACH
            yield _page_rows(rows)
        yield _page_rows([r for k in range(now, len(held)) for r in _decided(held, k)])

    dealt = map_batches(slim.withColumn("key", key), place, "id long, url string, html string, key string, range int, context boolean")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "key", F.xxhash64("html")).select("id", "url", "html", "context")
    return map_batches(dealt, run, FOUND).withColumn("n_chars", F.char_length("text").cast("long"))


def _dealt(batch: pa.RecordBatch, ranges: list[int], context: bool) -> pa.RecordBatch:
    columns = [*batch.columns, pa.array(ranges, pa.int32()), pa.array([context] * batch.num_rows)]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "range", "context"])


def _decided(held: list[Page], k: int) -> list[tuple]:
    page = held[k]
    return [] if page.context else [(*page.key, *page.text(held[max(0, k - REACH) : k] + held[k + 1 : k + 1 + REACH]))]


def _page_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", "url", "text", "n_lines_shared", "n_lines_deleted", "n_lines_furniture"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Every page."""
    from quelora.llm.common import table

    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").select("page_id", "url", "text", "n_chars", "n_lines_shared", "n_lines_deleted", "n_lines_furniture")
