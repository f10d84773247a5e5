"""HTML extraction: text-to-tag ratio of lines from a streaming parser, smoothed and clustered.

The standard library's event parser cuts a page into lines at block elements and counts the tags of
each line. The logarithm of the ratio of text to tags is smoothed with a Gaussian over neighbouring
lines and split in two clusters; the containers that hold lines of the upper cluster are the content
regions. What elements and class names say is a feature of the ratio, not a rule beside it: a line in
page furniture, or outside the article of a page that has one, counts so many tags more. A region is
returned with the lines of the lower cluster that stand inside it, between regions of one parent, or
beside them where they are not lists of links, but for those in furniture.

Markup is cut into tokens in linear time before the parser sees it, one token at a time: declarations,
comments, processing instructions, scripts and styles are passed over, a tag that the page's end cuts
off is dropped, and a ``<`` that begins no tag is text. So no page can raise or take quadratic time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCKS = frozenset("menu address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of page furniture, those that are furniture outside an article only, and those whose content is never text.
FURNITURE = frozenset("nav aside footer form dialog menu".split())
OUTER = frozenset(["header"])
SILENT = frozenset("head title noscript template iframe svg canvas object audio video button select textarea option".split())
CONTAINERS = frozenset("article main section div td body blockquote html".split())
STRONG = frozenset(["article", "main"])
#: What an open paragraph or list item does not reach beyond.
BOUNDS = CONTAINERS | FURNITURE | SILENT | frozenset(["ul", "ol", "table"])
#: Parts of class names, ids and roles of page furniture.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Tags that a line counts more for each piece of furniture around it, and for standing outside the article of a page that has one.
IN_FURNITURE, OUTSIDE = 200, 50
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Up to the > that ends a tag; a quote counts only where it opens and closes a value.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ENDS = {"script": re.compile(r"</script\b[^>]*+>", re.I), "style": re.compile(r"</style\b[^>]*+>", re.I)}


def tokens(page: str):
    """(is a tag, piece) of a page: tags and the text between them; what holds neither is passed over."""
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield False, page[at:]
            return
        if i > at:
            yield False, page[at:i]
        name = _NAME.match(page, i)
        if name:
            end = _REST.match(page, name.end())
            if end is None:
                return
            at = end.end()
            raw = _ENDS.get(name[1].lower()) if page[i + 1] != "/" else None
            if raw is None:
                yield True, page[i:at]
            else:
                close = raw.search(page, at)
                at = close.end() if close else n
        elif page.startswith("<!--", i):
            j = page.find("-->", i + 2)
            at = n if j < 0 else j + 3
        elif page.startswith("<![CDATA[", i):
            j = page.find("]]>", i)
            at = n if j < 0 else j + 3
        elif page.startswith(("<!", "<?", "</"), i):
            j = page.find(">", i)
            at = n if j < 0 else j + 1
        else:
            yield False, "&lt;"
            at = i + 1


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, box, furniture around it, whether in an article, characters in links.

    A box is a container or a piece of furniture; its lines and those of the boxes in it are a run of lines.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, pieces of furniture, box, text dropped
        self.places: dict[str, list[int]] = {}  # of each open tag in the stack
        self.bounds: list[int] = []
        self.text: list[str] = []
        self.n_tags: list[int] = []
        self.box: list[int] = []
        self.marks: list[int] = []
        self.inner: list[bool] = []
        self.links: list[int] = []
        self.parent, self.kind, self.strong = [0, 0], ["", "body"], [0, 0]  # of each box; box 1 is the page
        self.tags, self.buffer, self.state, self.linked = 0, [], (0, 1, False), 0

    def set_cdata_mode(self, *_):  # the tokens are cut already
        pass

    def read(self, page: str):
        for tag, piece in tokens(page):
            self.feed(piece)
            if tag and self.rawdata:
                self.rawdata = ""
        self.close()
        self.cut()

    def top(self):
        return self.stack[-1] if self.stack else ("", 0, 1, False)

    def cut(self):
        text = " ".join("".join(self.buffer).split())
        if text:
            self.text.append(text)
            self.n_tags.append(self.tags)
            marks, box, inner = self.state
            self.box.append(box)
            self.marks.append(marks)
            self.inner.append(inner)
            self.links.append(self.linked)
            self.tags = 0
        self.buffer, self.linked = [], 0

    def inside(self, *tags):
        return any(self.places.get(t) for t in tags)

    def push(self, tag, marks, box, drop):
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append((tag, marks, box, drop))

    def pop_to(self, size):
        while len(self.stack) > size:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()

    def close_open(self, tag):
        """Ends the open element of this name if none that bounds it stands between."""
        at = self.places.get(tag)
        if at and at[-1] > (self.bounds[-1] if self.bounds else -1):
            self.pop_to(at[-1])

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "li":
            self.close_open("li")
        elif tag == "p" or tag in BLOCKS and self.top()[0] == "p":
            self.close_open("p")
        if tag in ("article", "main", "body"):  # furniture that was left open before does not reach in
            while self.stack and (self.top()[1] or self.top()[0] in ("head", "title")) and self.top()[0] not in ("noscript", "template"):
                self.pop_to(len(self.stack) - 1)
        _, marks, box, drop = self.top()
        own = tag in FURNITURE or tag in OUTER and not self.inside("article")
        if not own and tag not in ("html", "body", "article", "main", "h1"):
            a = dict(attrs)
            names = {p.lower() for k in ("class", "id", "role") if a.get(k) for p in _PARTS.findall(a[k])}
            own = bool(names & MARKS) or "hidden" in a or a.get("aria-hidden") == "true" or bool(a.get("style") and _HIDDEN.search(a["style"]))
        if tag in CONTAINERS or own and tag in BLOCKS:
            self.parent.append(box)
            self.kind.append(tag)
            self.strong.append(len(self.kind) - 1 if tag in STRONG else self.strong[box])
            box = len(self.kind) - 1
        # what a marked inline element holds leaves its line
        self.push(tag, marks + own, box, drop or tag in SILENT or own and tag not in BLOCKS)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if self.places.get(tag):
            self.pop_to(self.places[tag][-1])

    def handle_data(self, data):
        _, marks, box, drop = self.top()
        if drop:
            return
        state = (marks, box, self.inside("article", "main"))
        if self.state != state:
            self.cut()
            self.state = state
        self.buffer.append(data)
        if self.inside("a"):
            self.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def ratios(p: Lines) -> np.ndarray:
    """Smoothed logarithm of the text-to-tag ratio of each line; lines in furniture are smoothed among themselves."""
    marks, inner = np.array(p.marks), np.array(p.inner)
    outside = ~inner & inner.any()
    x = np.log1p(np.array([len(t) for t in p.text]) / (np.maximum(p.n_tags, 1) + IN_FURNITURE * marks + OUTSIDE * outside))
    for mine in (marks == 0, marks > 0):
        if mine.any():
            x[mine] = smooth(x[mine])
    return x


def threshold(x: np.ndarray, rounds: int = 20) -> float:
    """Between two clusters of values (two means); the least value if all are alike."""
    a, b = x.min(), x.max()
    for _ in range(rounds):
        cut = (a + b) / 2
        low, high = x[x < cut], x[x >= cut]
        if not len(low) or not len(high):
            return x.min()
        a, b = low.mean(), high.mean()
    return (a + b) / 2


def extract(html: str) -> str:
    """Main text of a page; the empty string if it has none."""
    p = Lines()
    p.read(html)
    if not p.text or min(p.marks) > 0:
        return ""
    x = ratios(p)
    return " ".join(p.text[i] for i in regions(p, x >= threshold(x)))


def regions(p: Lines, high: np.ndarray) -> list[int]:
    """Which lines are content, given those of the upper cluster. Linear in lines and boxes."""
    n, boxes = len(p.text), len(p.kind)
    mass = np.array([len(t) for t in p.text], np.int64)
    marked, inner = np.array(p.marks) > 0, np.array(p.inner)
    led = 2 * mass[high & inner].sum() >= mass[high].sum()
    # the run of lines of each box, children before parents, and sums over runs
    lo, hi, own, children = [n] * boxes, [-1] * boxes, [[] for _ in range(boxes)], [[] for _ in range(boxes)]
    for i, b in enumerate(p.box):
        own[b].append(i)
        lo[b], hi[b] = min(lo[b], i), max(hi[b], i)
    for b in range(boxes - 1, 0, -1):
        up = p.parent[b]
        children[up].append(b)
        lo[up], hi[up] = min(lo[up], lo[b]), max(hi[up], hi[b])
    plain = np.concatenate(([0], np.cumsum(np.where(marked, 0, mass))))
    linked = np.concatenate(([0], np.cumsum(np.where(marked, 0, p.links))))
    listed = lambda a, b: 2 * (linked[b + 1] - linked[a]) > plain[b + 1] - plain[a]  # noqa: E731  mostly links
    # the span of the regions under each parent; inside an article also that under what is around the parent
    span: dict[int, list[int]] = {}
    for b in sorted({p.box[i] for i in np.flatnonzero(high).tolist()}):
        while True:
            up = p.parent[b]
            known = up in span
            s = span.setdefault(up, [n, -1])
            s[0], s[1] = min(s[0], lo[b]), max(s[1], hi[b])
            if known or not p.strong[up] or not up:
                break
            b = up
    cover = np.zeros(n + 1, np.int64)

    def take(a, b):
        cover[a] += 1
        cover[b + 1] -= 1

    for up, (first, last) in span.items():
        take(first, last)
        frame = p.kind[up] in ("", "body", "html")
        for c in children[up]:
            if hi[c] >= 0 and (hi[c] < first or lo[c] > last) and not listed(lo[c], hi[c]) and not (frame and p.kind[c] == "div"):
                take(lo[c], hi[c])
        for i in own[up]:
            if not first <= i <= last and not listed(i, i):
                take(i, i)
    low = ~high & (marked | (led & ~inner & inner.any()))
    return np.flatnonzero((np.cumsum(cover[:n]) > 0) & ~low).tolist()


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row.

    Null and empty pages give the empty text. Repeated rows give repeated results; null ids and urls stay null.
    Other columns are not read. An empty table gives none.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f"{c} {src.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches):
        for b in batches:
            texts = [extract(h) if h else "" for h in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))


def op7_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(C.table(spark, sf_dir, "pages"))
