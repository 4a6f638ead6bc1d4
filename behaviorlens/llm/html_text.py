"""Main text of web pages, with site templates removed.

Every page's element subtrees are hashed bottom-up; Spark counts on how many distinct pages
of a host each subtree stands (pages of equal text before that count once); subtrees that recur on many pages of their host are
deleted.  Elements that HTML itself names as no content, or that a page's author
labels so, go too, and where a page marks its article only that is read.

A page's own hashes that recur travel back to it by its key, so no task ever holds a
host's templates, and a host may hold any share of the pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import materialize, member_filter, table, trimmed

#: A subtree is a template when it stands on at least so many distinct pages of its host and this share of them.
LEAST_PAGES, LEAST_SHARE = 4, 0.1

# The elements' kinds, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br caption head html body legend option optgroup tbody td tfoot th thead tr".split())
#: An opening tag ends open elements of these kinds, up to the nearest of the last kinds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Never content.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg object dialog menu".split())
#: Names of class, id or role that mark what is no content, as a whole or before their first - or _.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist disqus replies respond share sharing social related recommended widget pagination "
    "pager toolbar skip complementary contentinfo search".split()
)
MAIN_LABELS = frozenset("main content main-content article article-body article-content post post-content entry entry-content".split())
#: Inside an article only containers count as templates, so that a sentence that two articles share stays.
CONTAINERS = frozenset("div section ul ol dl table aside details figure header hgroup".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?>[^<>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>|<[!?][^<>]*+>?|[^<]+|<""", re.DOTALL
)
_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)


class Page:
    """The elements of one page in document order, with their parents and hashes, and the texts between."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#page"]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [0]
        self.digest: list[int] = [0]
        self.items: list[tuple[int, str]] = []
        self._inner: list[list[str]] = [[]]
        stack = [0]
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                if not m[0].startswith(("<!", "<?")):
                    self._text(stack[-1], html.unescape(m[0]) if "&" in m[0] else m[0])
                continue
            name = name.lower()
            if m[1]:
                self._end(stack, name)
                continue
            self._imply(stack, name)
            node = self._start(stack[-1], name, m[3] or "")
            if name in VOID:
                self._close(node)
            elif name in RAW:
                found = _RAW_END[name].search(source, at)
                end = found.start() if found else n
                self._inner[node].append(source[at:end])
                self._close(node)
                gt = source.find(">", end)
                at = n if gt < 0 else gt + 1
            else:
                stack.append(node)
        while len(stack) > 1:
            self._close(stack.pop())

    def _start(self, parent: int, name: str, attrs: str) -> int:
        node = len(self.tag)
        self.tag.append(name)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.digest.append(0)
        self._inner.append([])
        if name in BLOCK:
            self.items.append((node, " "))
        return node

    def _text(self, node: int, text: str) -> None:
        self.items.append((node, text))
        self._inner[node].append(" ".join(text.split()))

    def _close(self, node: int) -> None:
        inner = "\0".join([self.tag[node], self.attrs[node].strip(), *self._inner[node]])
        self._inner[node] = []
        self.digest[node] = xxhash.xxh64_intdigest(inner.encode("utf-8", "surrogatepass")) - (1 << 63)
        self._inner[self.parent[node]].append(str(self.digest[node]))
        if self.tag[node] in BLOCK:
            self.items.append((node, " "))

    def _end(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[depth]]
            if open_tag == name:
                while len(stack) > depth:
                    self._close(stack.pop())
                return
            if name not in BLOCK and open_tag in BLOCK:  # an inline end tag does not end a block
                return

    def _imply(self, stack: list[int], name: str) -> None:
        closed, bounds = IMPLIED.get(name, ((), ()))
        for depth in range(len(stack) - 1, 0, -1) if closed else ():
            if self.tag[stack[depth]] in bounds:
                break
            if self.tag[stack[depth]] in closed:
                while len(stack) > depth:
                    self._close(stack.pop())
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[depth]]
                if open_tag == "p":
                    while len(stack) > depth:
                        self._close(stack.pop())
                    return
                if open_tag in BLOCK:
                    return

    def _labels(self, node: int) -> list[str]:
        found = []
        for _, value in _LABEL.findall(self.attrs[node]):
            found += value.strip("\"'").lower().split()
        return found

    def judge(self) -> tuple[list[bool], list[bool]]:
        """Of each element: whether it lies in the page's article, whether it is no content by its name or labels."""
        size = len(self.tag)
        labels = [self._labels(i) if self.attrs[i] else [] for i in range(size)]
        named, labelled = [False] * size, [False] * size
        for i in range(1, size):
            tag = self.tag[i]
            named[i] = named[self.parent[i]] or tag in OUTSIDE or bool(self.attrs[i] and _HIDDEN.search(self.attrs[i]))
            if labels[i] and tag not in ("html", "body", "main"):
                words = {*labels[i], *(re.split(r"[-_]", label, maxsplit=1)[0] for label in labels[i])}
                own = bool(words & LABELS) if tag != "article" else bool(words & {"comment", "comments", "ad", "related"})
                labelled[i] = own or tag != "h1" and bool({"header", "site-header"} & {*labels[i]})
        out = self._below(named, labelled)
        kinds = (
            lambda i: self.tag[i] == "article", lambda i: self.tag[i] == "main" or "main" in labels[i], lambda i: bool(MAIN_LABELS & {*labels[i]}),
        )
        roots, wrapped = set(), set()
        for choose in kinds:
            found = {i for i in range(1, size) if not named[i] and not labelled[i] and choose(i)}
            roots = {i for i in found if not out[i]}
            if roots:
                break
            wrapped = wrapped or found
        if wrapped:  # within labelled elements: where most of the text stands there they hold the page's article, and their labels do not count
            freed = labelled.copy()
            for i in wrapped:
                while i := self.parent[i]:
                    freed[i] = False
            within = self._below(named, freed)
            if self._size(wrapped, within) > self._size(roots, out):
                out, roots = within, roots | wrapped
        inside = [False] * size
        for i in range(1, size):
            inside[i] = i in roots or inside[self.parent[i]]
            if self.tag[i] == "header" and not inside[i]:
                out[i] = True
            out[i] = out[i] or out[self.parent[i]]
        if not roots:
            inside = [True] * size
        self.rooted = bool(roots)
        return inside, out

    def _below(self, named: list[bool], labelled: list[bool]) -> list[bool]:
        """Of each element: whether it or one around it is named or labelled as no content."""
        out = [False] * len(named)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or named[i] or labelled[i]
        return out

    def _size(self, roots: set[int], out: list[bool]) -> int:
        """Letters of the text within the roots, or within the page where there are none, that is not out."""
        inside = [not roots] * len(out)
        for i in range(1, len(out)):
            inside[i] = inside[self.parent[i]] or i in roots
        return sum(len("".join(t.split())) for i, t in self.items if inside[i] and not out[i])

    def candidates(self) -> tuple[set[int], set[int]]:
        """Hashes of the subtrees that may be templates, of what is no content anyway only the whole, and of
        those of them that hold text of this page."""
        inside, out = self.judge()
        found = [i for i in self._deletable(inside) if not out[self.parent[i]]]
        return {self.digest[i] for i in found}, {self.digest[i] for i in found if inside[i] and not out[i]}

    def _deletable(self, inside: list[bool]) -> list[int]:
        fixed = ("html", "body", "main", "article")
        return [
            i for i in range(1, len(self.tag))
            if self.tag[i] not in fixed and (not (self.rooted and inside[i]) or self.tag[i] in CONTAINERS)
        ]

    def text(self, templates: set[int]) -> str:
        inside, out = self.judge()
        for i in self._deletable(inside):
            out[i] = out[i] or self.digest[i] in templates
        for i in range(1, len(self.tag)):
            out[i] = out[i] or out[self.parent[i]]
        shown = [t if inside[i] and not out[i] else " " if self.tag[i] in BLOCK else "" for i, t in self.items]
        return " ".join("".join(shown).split())


def _hash_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each page, and a digest of its text with all of them."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            hashes, shown, digests = [], [], []
            for source in part.column(2).to_pylist():
                page = Page(source or "")
                for have, found in zip((hashes, shown), page.candidates(), strict=True):
                    have.append(sorted(found))
                digests.append(xxhash.xxh64_intdigest(page.text(set()).encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(shown, pa.list_(pa.int64())), pa.array(digests, pa.int64())],
                ["page_id", "host", "hashes", "shown", "digest"],
            )


def _text_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            rows = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
            texts = [Page(source or "").text(set(templates or ())) for source, templates in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """page_id, url, text of every page.

    Character references are decoded, white space within a block becomes one space, and
    blocks are joined by one space in page order.  A null or empty html has the text ''.
    A url without a host, or a null one, counts under the host ''.  Rows that repeat a page_id,
    or a null one, each give a row and share their templates.  An empty table gives no
    rows.  Very long pages are parsed whole.  Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    hashed = materialize(
        pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.col(html_col).alias("html"))
        .mapInArrow(lambda it: trimmed(_hash_task(it)), "page_id long, host string, hashes array<long>, shown array<long>, digest long").withColumn("row", F.monotonically_increasing_id()), "subtrees",
    )
    # Copies of a page under any url count once, or they would make templates of their own text.
    firsts = hashed.groupBy("host", "digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(hashed.select("host", "digest", "row").join(firsts, ["host", "digest"]).where("row != first").select("row"), "page-copies")
    distinct = hashed.join(copies, "row", "left_anti")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    rows = hashed.select("page_id", "host", F.explode("shown").alias("hash"))
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    recurring = counts.join(sizes, "host").where(F.col("n") >= least_share * F.col("pages")).select("host", "hash")
    own = materialize(rows.join(recurring, ["host", "hash"]).groupBy(F.col("page_id").alias("own_id")).agg(F.collect_set("hash").alias("templates")), "page-templates")
    # Only pages that show a template travel to their hashes.
    marked = plain.withColumn("maybe", member_filter(own, "own_id")(F.col("page_id")))
    joined = marked.where("maybe").join(own, F.col("page_id").eqNullSafe(F.col("own_id")), "left").select("page_id", "url", "html", "templates")
    others = marked.where("not maybe").select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("templates"))
    schema = "page_id long, url string, text string"
    return joined.mapInArrow(lambda it: trimmed(_text_task(it)), schema).unionByName(others.mapInArrow(lambda it: trimmed(_text_task(it)), schema))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long")), "page-texts")


QUERIES = {"op6_html_text": op6_html_text}
