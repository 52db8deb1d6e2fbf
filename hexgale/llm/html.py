"""Main text of web pages: structural blocks, and differencing against the page with the nearest URL.

Pages are sorted by host and URL path and each is paired with the neighbour on its host that has the longest common path and
other lines; the text lines of both are aligned by longest common subsequence and shared ones are deleted. Markup adds to
this: menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles that are recognised by it are
not lines at all, and where the page marks its article, lines outside it go as well.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.llm.common import partitions, pick
from hexgale.session import cut_lineage

# Element names of HTML by their role, and words that name furniture in class, id and role attributes.
SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "select", "button", "textarea"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
CONTAINER = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ANYWHERE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|related|share|sharing|social|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|comments?|disqus|replies)(?:$|[\s_-])", re.I)
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner|sidebar|side|widget|login|search|toolbar|pagination|pager|skip)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


class Blocks(HTMLParser):
    """Text blocks of a page that are not furniture, each with whether it stands inside the page's article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # element, furniture, container
        self.hidden = self.inside = 0
        self.run: list[str] = []
        self.blocks: list[tuple[str, bool]] = []

    def _end_block(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((text, self.inside > 0))
            self.run = []

    def _pop(self) -> None:
        _, furniture, container = self.open.pop()
        self.hidden -= furniture
        self.inside -= container

    def _furniture(self, tag: str, attrs) -> bool:
        if tag in SKIP or tag in FURNITURE and not (tag == "header" and self.inside):
            return True
        if tag in ("body", "html") or tag in CONTAINER:
            return False
        named = {k: v or "" for k, v in attrs}
        if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES:
            return True
        marks = (named.get("class", ""), named.get("id", ""))
        return any(ANYWHERE.search(m) or not self.inside and OUTSIDE.search(m) for m in marks if m)

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in INLINE:
            self._end_block()
        if tag in VOID:
            if tag == "br":
                self.run.append(" ")
            return
        if tag in CONTAINER and any(x[0] in ("nav", "header", "form", "ul", "a") and x[1] for x in self.open):
            while self.open and self.hidden:  # a menu left open: the article ends it
                self._pop()
        if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and self.open and self.open[-1][0] in ("p", tag):
            self._pop()
        furniture = self._furniture(tag, attrs)
        self.open.append((tag, furniture, tag in CONTAINER))
        self.hidden += furniture
        self.inside += tag in CONTAINER

    def handle_endtag(self, tag) -> None:
        if tag not in INLINE:
            self._end_block()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                while len(self.open) > depth:
                    self._pop()
                break
            if self.open[depth][0] in CONTAINER and tag not in ("body", "html"):
                break  # a stray end tag does not close the article

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.run.append(data)


def blocks(html: str) -> list[tuple[str, bool]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser._end_block()
    return parser.blocks


def common_subsequence(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski's method)."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    ends: list[int] = []  # smallest end in b of a common subsequence of each length
    last: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k], last[k] = j, link
    out, link = [], last[-1] if last else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _key(url: str) -> str:
    """Host and path, so that pages of a host lie together in path order."""
    try:
        parts = urlsplit(url)
        return f"{(parts.netloc or '').lower()}\0{parts.path}?{parts.query}"
    except ValueError:
        return f"\0{url}"


def _host(key: str) -> str:
    return key.split("\0")[0]


def _parse(rows: DataFrame, only: frozenset | None = None) -> DataFrame:
    """Pages as sort key, lines, a digest that tells lists of lines apart, and whether each line stands in the article.
    ``only``: keys of the pages wanted, the others are not parsed."""
    fields = T.StructType([rows.schema["page_id"], rows.schema["url"]]).add("key", "string").add("digest", "string").add("lines", T.ArrayType(T.StringType())).add("inside", T.ArrayType(T.BooleanType()))

    def run(batches):
        for b in batches:
            if only is not None:
                b = b.filter(pa.array([_key(url or "") in only for url in b.column(1).to_pylist()], pa.bool_()))
            keys, digests, lines, inside = [], [], [], []
            for url, html in zip(b.column(1), b.column(2)):
                found = blocks(html.as_py() or "")
                keys.append(_key(url.as_py() or ""))
                lines.append([t for t, _ in found])
                inside.append([marked for _, marked in found])
                # Lines have no line feed: white space in them is one space.
                digests.append(hashlib.blake2b("\n".join(lines[-1]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            columns = [pa.array(keys, pa.string()), pa.array(digests, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(inside, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=fields.names)

    return rows.mapInArrow(run, fields)


def main_text(lines: list[str], inside: list[bool], other: list[str] | None) -> str:
    """Lines not shared with the neighbour's, and of a page that marks its article only those inside."""
    shared = set(common_subsequence(lines, other)) if other is not None else ()
    return "\n\n".join(x for i, x in enumerate(lines) if i not in shared and (inside[i] or True not in inside))


def _cuts(counts: DataFrame, n_parts: int) -> tuple[list[tuple], dict[tuple, int]]:
    """Places (key, digest) where ranges of pages begin, and copies under one key that fill ranges of their own, with the
    number of tasks that they are dealt over."""
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n <= 1000:
        return [], {}
    per_range = max(1, n // (4 * n_parts))
    heavy = {(r["key"], r["digest"]): -(-r["n"] // per_range) for r in counts.where(F.col("n") > per_range).collect()}
    every = max(1, per_range // 8)
    drawn = counts.where((F.col("n") <= per_range) & (F.pmod(F.xxhash64("key", "digest"), F.lit(every)) == 0))
    cuts, filled = {*heavy, *((key, digest + "g") for key, digest in heavy)}, 0  # "g": right behind the digest
    for key, digest, copies in sorted(map(tuple, drawn.select("key", "digest", "n").collect())):
        filled += copies * every
        if filled >= per_range:
            cuts.add((key, digest))
            filled = 0
    return sorted(cuts), heavy


def _guests(ranged: DataFrame) -> list[tuple]:
    """(key, digest, range): the last page before and the first page behind each range whose lines differ from those at
    its border, on the same host. Only names of pages at the borders reach the driver."""
    page = F.struct("key", "digest")
    ends = ranged.groupBy("range").agg(F.min(page).alias("head"), F.max(page).alias("tail"))
    ends = cut_lineage(ends)
    within = ranged.join(F.broadcast(ends), "range").groupBy("range").agg(F.min(F.when(F.col("digest") != F.col("head.digest"), page)).alias("head2"), F.max(F.when(F.col("digest") != F.col("tail.digest"), page)).alias("tail2"))
    rows = {r["range"]: r for r in ends.join(within, "range").collect()}

    def walk(order: list[int], near: str, far: str, far2: str) -> list[tuple]:
        out, last, found = [], None, None
        for at in order:
            # A neighbour range of nothing but the lines at this border passes on what it has found itself.
            if last is not None:
                found = last[far] if last[far]["digest"] != rows[at][near]["digest"] else last[far2] or found
            if found is not None and _host(found["key"]) == _host(rows[at][near]["key"]):
                out.append((found["key"], found["digest"], at))
            last = rows[at]
        return out

    return walk(sorted(rows), "head", "tail", "tail2") + walk(sorted(rows, reverse=True), "tail", "head", "head2")


def _compared(rows: DataFrame, n_parts: int) -> DataFrame:
    """Texts of pages, each compared with its neighbour in (host, path) order; pages without lines are not compared.

    Pages are cut into ranges at sampled keys, so a host of any size spreads over many tasks, and a page that stands under
    one URL very often is dealt over several. The nearest pages with other lines before and behind are sent to each range.
    Pages are parsed twice, first for keys and digests alone, so that lines are on disk only once, when they are dealt.
    """
    spark = rows.sparkSession
    pages = _parse(rows)
    counts = cut_lineage(pages.where("size(lines) > 0").groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")))
    cuts, heavy = _cuts(counts, n_parts)
    tasks = {bisect_right(cuts, page): n for page, n in heavy.items()}

    def place(key_at: int, lines_at: int | None = None):
        def run(batches):
            row = TaskContext.get().partitionId()
            for b in batches:
                at = [bisect_right(cuts, page) for page in zip(b.column(key_at).to_pylist(), b.column(key_at + 1).to_pylist())]
                if lines_at is not None:
                    at = [r if n.as_py() else -1 for r, n in zip(at, pc.list_value_length(b.column(lines_at)))]
                salts = [(row + i) % (n_parts if r < 0 else tasks.get(r, 1)) for i, r in enumerate(at)]
                row += len(at)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(salts, pa.int32())], names=[*b.schema.names, "range", "salt"])

        return run

    placed = [T.StructField("range", T.IntegerType()), T.StructField("salt", T.IntegerType())]
    ranged = counts.mapInArrow(place(0), T.StructType([*counts.schema.fields, *placed]))
    guests = [(key, digest, at, salt) for key, digest, at in _guests(ranged) for salt in range(tasks.get(at, 1))]
    both = pages.mapInArrow(place(2, 4), T.StructType([*pages.schema.fields, *placed])).withColumn("own", F.lit(True))
    if guests:
        wanted = F.broadcast(spark.createDataFrame(guests, "key string, digest string, range int, salt int"))
        found = _parse(rows, frozenset(x[0] for x in guests)).join(F.broadcast(wanted.select("key", "digest").distinct()), ["key", "digest"], "left_semi").groupBy("key", "digest").agg(F.first("lines").alias("lines"))
        both = both.unionByName(found.join(wanted, ["key", "digest"]).withColumn("own", F.lit(False)), allowMissingColumns=True)
    dealt = both.repartition(n_parts, "range", "salt").sortWithinPartitions("range", "salt", "key", "digest", "own")
    fields = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])

    def texts(before, run, after):
        """before, run, after: pages next to each other in order, the pages of each with the same lines."""
        lines, same = run
        known: dict = {}
        for page_id, url, key, inside, own in same:
            if own:
                near = [(x[0], y) for x, y in ((before, before and before[1][-1][2]), (after, after and after[1][0][2])) if x is not None and _host(y) == _host(key)]
                other = max(near, key=lambda x: _shared_prefix(x[1], key))[0] if near else None
                mark = (id(other), tuple(inside))
                if mark not in known:
                    known[mark] = main_text(lines, inside, other)
                yield page_id, url, known[mark]

    def runs(rows):
        for _, same in groupby(rows, key=lambda x: x[3]):
            first = next(same)
            yield first[4], [(x[0], x[1], x[2], x[5], x[8]) for x in (first, *same)]

    def compare(rows):
        for _, part in groupby(rows, key=lambda x: (x[6], x[7])):
            before = run = None
            for after in runs(part):
                if run is not None:
                    yield from texts(before, run, after)
                before, run = run, after
            yield from texts(before, run, None)

    def run(batches):
        kinds: list = []

        def rows():
            for b in batches:
                kinds[:] = [b.schema.field(0).type, b.schema.field(1).type, pa.string()]
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=fields.names)

        out = []
        for x in compare(rows()):
            out.append(x)
            if len(out) == 256:
                yield batch()
                out = []
        if out:
            yield batch()

    return dealt.select("page_id", "url", "key", "digest", "lines", "inside", "range", "salt", "own").mapInArrow(run, fields)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): blocks of the main text in page order, joined by two line feeds.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed; no length is
    capped. Every page that has lines is compared with the page of nearest URL among those on its host that have
    lines, but not the same; what they share goes, inside a marked article too, and a page whose lines all stand there in the same
    order becomes empty. Copies of a page are not compared with each other. NULL html counts as empty and gives empty text;
    NULL urls share one empty host. Repeated rows and ids give one row each; an empty table an empty result; other columns
    are left out. The input is read several times and has to be a stable table.
    """
    rows = pick(pages, page_id=page_id, url=url, html=html)
    return _compared(rows, partitions(rows.sparkSession)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
