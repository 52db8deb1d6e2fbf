"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line's set is the 64-bit hashes of its 8-byte character shingles (a shorter line is one shingle). ``ROWS * BANDS`` minwise
values over the whole set make the bands. Lines that share a band are candidates, outlines of the sets exclude those that
cannot be alike, exact Jaccard similarity of the full sets confirms the others, and distributed union-find joins them to components, of which the first line in document order stays.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.llm.common import components, release, store
from hexgale.session import cut_lineage

SHINGLE, ROWS, BANDS = 8, 4, 10
SIMILARITY = 0.8


#: A minwise value is the smallest hash after rotation and exclusive or with a mask. The rows of a band use different bits of
#: the hash first, the bands different parts of the range of values, so even small sets give them little in common.
_RANDOM = random.Random(1729)
MASKS = [[(band * 2**64 // BANDS + _RANDOM.getrandbits(59)) % 2**64 - 2**63 for _ in range(ROWS)] for band in range(BANDS)]


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once per row, also where ``then`` uses it inside a function of elements."""
    return F.transform(F.array(value), then)[0]


def _last(line: Column) -> Column:
    """Place of the last shingle of a line that is not empty."""
    return F.greatest(F.octet_length(line) - SHINGLE + 1, F.lit(1))


def _hashes(line: Column) -> Column:
    """Hashes of all byte shingles of a line that is not empty, repeats included."""
    return _once(line.cast("binary"), lambda raw: F.transform(F.sequence(F.lit(1), _last(line)), lambda i: F.xxhash64(F.substring(raw, i, F.lit(SHINGLE)))))


def shingles(line: Column) -> Column:
    """Distinct hashes of the byte shingles of a line that is not empty."""
    return F.array_distinct(_hashes(line))


#: Places of a line that share a row while minima are taken; of the thin form, in which most rows touch few minima.
PLACES, THIN_PLACES = 8, 4
#: The thin form parts the values of a row of hashes into up to 2 ** CELL_BITS cells, so that a cell holds this many or more.
CELL_BITS, PER_CELL = 6, 16


def _rotations(h: Column) -> list[Column]:
    return [h] + [F.shiftleft(h, 64 * r // ROWS).bitwiseOR(F.shiftrightunsigned(h, 64 - 64 * r // ROWS)) for r in range(1, ROWS)]


def _places(lines: DataFrame, keep: list[str], k: int, *more: Column) -> DataFrame:
    """Hashes h0 .. of every k places of a line as a row, beside ``keep`` and what ``more`` works out from the place of the last."""
    raw = lines.select(*keep, F.col("line").cast("binary").alias("raw")).select(*keep, "raw", _last(F.col("raw")).alias("last"))
    kept = raw.select("*", *more)
    at = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(k))).alias("i"))
    # The last place again where a row has places to spare; repeats of a shingle change no minimum.
    hashed = (F.xxhash64(F.substring("raw", F.least(F.col("i") + j, "last") if j else F.col("i"), F.lit(SHINGLE))).alias(f"h{j}") for j in range(k))
    return at.select(*(c for c in at.columns if c not in ("raw", "last", "i")), *hashed)


def _minima(lines: DataFrame, keep: list[str], thin: bool) -> DataFrame:
    """(keep, bands) for distinct lines (id, id2, .., line) that are not empty; ``keep`` has id and id2 and what depends on them.

    The places of a line are dealt out to rows, their shingles are hashed in generated code (a function of array elements
    would be interpreted), and minima are taken in hash aggregation. Where lines are dealt out by id already, nothing is
    shuffled.

    The thin form leaves out what cannot be a minimum: exclusive or with a mask sends the values with the mask's leading bits
    before all others, so a row matters to a minimum only if it holds such a value. Lines of n places use so many leading
    bits that a mask meets PER_CELL of n values or more; where it meets none, as in lines that repeat few shingles, bands is
    NULL, and the line needs the plain form.
    """
    k = THIN_PLACES if thin else PLACES
    bits = F.least(F.greatest(F.floor(F.log2(F.col("last") / PER_CELL)), F.lit(0)), F.lit(CELL_BITS)).cast("int")
    each = _places(lines, keep, k, *([bits.alias("bits")] if thin else []))
    rotated = [x.alias(f"r{r}_{j}") for j in range(k) for r, x in enumerate(_rotations(F.col(f"h{j}")))]
    values = [f"r{r}_{j}" for j in range(k) for r in range(ROWS)]
    if thin:
        each = each.select(*keep, (F.lit(63) - F.col("bits")).alias("drop"), (F.lit(CELL_BITS) - F.col("bits")).alias("short"), *rotated)
        cells = [" | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(shiftrightunsigned(r{r}_{j}, 1), drop) AS INT))" for j in range(k)) for r in range(ROWS)]
        each = each.select(*keep, "short", *(F.expr(x).alias(f"cells{r}") for r, x in enumerate(cells)), *values)
    else:
        each = each.select(*keep, *rotated)

    def least(b: int, r: int) -> Column:
        value = f"min(least({', '.join(f'r{r}_{j} ^ ({MASKS[b][r]}L)' for j in range(k))}))"
        if thin:  # values of the sign that the mask does not have come first, being negative
            cell = ((MASKS[b][r] ^ -(2**63)) % 2**64) >> (64 - CELL_BITS)
            value += f" FILTER (WHERE (shiftright(cells{r}, shiftright({cell}, short)) & 1L) = 1L)"
        return F.expr(value).alias(f"m{b}_{r}")

    found = each.groupBy(*keep).agg(*(least(b, r) for b in range(BANDS) for r in range(ROWS)))
    made = F.array(*(F.xxhash64(F.lit(b), *(f"m{b}_{r}" for r in range(ROWS))) for b in range(BANDS)))
    if thin:
        made = F.when(F.expr(" ^ ".join(f"m{b}_{r}" for b in range(BANDS) for r in range(ROWS))).isNotNull(), made)
    return found.select(*keep, made.alias("bands"))


def bands(lines: DataFrame) -> DataFrame:
    """(id, bands) for distinct lines (id, id2, line) that are not empty; bands is an array of longs."""
    return _minima(lines, ["id", "id2"], thin=False).select("id", "bands")


#: Longs of a line's outline, each of 64 bits.
OUTLINE = 32


def outlines(texts: DataFrame) -> DataFrame:
    """(id, n, w0 ..) for lines (id, line): the number of distinct shingles and, for each of 64 * OUTLINE lots that these
    are dealt out to by hash, whether their number is odd.

    A lot in which two lines differ holds a shingle that only one of them has, so lines differ in no fewer shingles than lots.
    """
    sets = texts.select("id", shingles(F.col("line")).alias("x")).select("id", F.size("x").alias("n"), F.explode("x").alias("h"))
    bits = sets.select("id", "n", F.expr(f"CAST(shiftrightunsigned(h, 6) & {OUTLINE - 1}L AS INT)").alias("at"), F.expr("shiftleft(1L, CAST(h & 63L AS INT))").alias("bit"))
    words = [F.expr(f"bit_xor(bit) FILTER (WHERE at = {j})").alias(f"w{j}") for j in range(OUTLINE)]
    return bits.groupBy("id", "n").agg(*words).select("id", "n", *(F.coalesce(f"w{j}", F.lit(0).cast("long")).alias(f"w{j}") for j in range(OUTLINE)))


def _end(known: DataFrame, end: str) -> DataFrame:
    """Outlines under the names of one end of a pair."""
    zero = F.lit(0).cast("long")
    return known.select(F.col("id").alias(end), F.coalesce("n", F.lit(0)).alias(f"{end}_n"), *(F.coalesce(f"w{j}", zero).alias(f"{end}_w{j}") for j in range(OUTLINE)))


def _may_be_alike(similarity: float) -> Column:
    """False only for pairs whose outlines differ in more lots than sets of that similarity have shingles apart."""
    apart = " + ".join(f"bit_count(a_w{j} ^ b_w{j})" for j in range(OUTLINE))
    return F.expr(f"({apart}) * {1 + similarity!r}D <= (a_n + b_n) * {1 - similarity!r}D + 0.001D")


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line: the document, the line's number and two 64-bit hashes that identify it."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "row", "line_no", "line", F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit(1)).alias("id2"))


def _texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(id, line) for places (id, doc_id, row, line_no), fetched from the documents."""
    fetch = places.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("at_row")).agg(F.collect_list(F.struct(F.col("line_no").alias("at"), "id")).alias("lines"))
    found = rows.join(fetch, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("at_row")))
    return found.select(F.split("text", "\n").alias("all"), F.explode("lines").alias("x")).select("x.id", F.col("all")[F.col("x.at")].alias("line"))


#: Further lines of a band, drawn by hash, that lines outside their components are compared with before all others.
LEADS = 4


def _with_root(shared: DataFrame, labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("node").alias("id"), "root")
    return shared.select("band", "id").join(up, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))


def _passed(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs that may be alike by their outlines."""
    return pairs.join(_end(known, "a"), "a").join(_end(known, "b"), "b").where(_may_be_alike(similarity)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _to_leads(shared: DataFrame, labels: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a band's lines with a few lines drawn from the band, as far as they lie in two components."""
    rows = _with_root(shared, labels)
    drawn = [F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(k))).alias(f"l{k}") for k in range(LEADS)]
    leads = rows.groupBy("band").agg(*drawn).select("band", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADS)]))).alias("lead"))
    return _passed(_ordered(rows.join(leads, "band").where(F.col("root") != F.col("lead.root")).select(F.col("id").alias("a"), F.col("lead.id").alias("b"))), known, similarity)


def _across(shared: DataFrame, labels: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a band that lie in two components and may be alike. Each has an end outside the band's largest component.

    Outlines are compared where rows of a band meet, so only pairs that are alike or nearly so leave the join.
    """
    rows = _with_root(shared, labels)
    sizes = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("band", "main")
    rows = store(rows.join(main, "band"))
    rest = rows.where("root <> main").select("band", F.col("id").alias("a"), F.col("root").alias("ra")).join(_end(known, "a"), "a")
    every = rows.select("band", F.col("id").alias("b"), "root", "main").join(_end(known, "b"), "b")
    met = (rest["band"] == every["band"]) & F.expr("root <> ra AND (root = main OR b > a)") & _may_be_alike(similarity)
    return _ordered(every.join(rest, met).select("a", "b"))


def _confirm(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full shingle sets have a Jaccard similarity of at least ``similarity``."""
    ta = texts.select(F.col("id").alias("a"), F.col("line").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("line").alias("tb"))
    both = pairs.join(ta, "a").join(tb, "b")
    alike = _once(shingles(F.col("ta")), lambda x: _once(shingles(F.col("tb")), lambda y: _once(F.size(F.array_intersect(x, y)), lambda n: n >= F.lit(similarity) * (F.size(x) + F.size(y) - n))))
    return both.where(alike).select("a", "b")


def line_decisions(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line_no, first_doc, first_line, kept) of every line of every text, lines being parted by line feeds.

    kept is false for all lines of a component but the first by (doc_id, row, line_no); equal lines are one component.
    ``row`` tells rows with equal ids apart. Empty lines are structure: always kept, never linked. NULL text has no line,
    empty text one empty line. NULL ids come first. Ties are broken by row and line number, so repeated rows lose all
    lines but those of the first. An empty table gives an empty result; other columns are left out.

    Equal lines are combined before each shuffle, so a line in a third of all documents is a few rows per map task. The
    input is read several times and has to be a stable table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    place = F.struct("doc_id", "row", "line_no")
    lines = _lines(rows)
    filled = lines.where("line <> ''")

    # One text per line: copies are combined before the shuffle, and shingles are made where the text has been dealt to.
    single = filled.groupBy("id", "id2").agg(F.first("line").alias("line"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    single = single.select("id", "id2", "line", "n", *(F.col(f"first.{c}").alias(c) for c in ("doc_id", "row", "line_no")))
    borne = store(_minima(single, ["id", "id2", "doc_id", "row", "line_no", "n"], thin=True))
    release(docs.sparkSession)  # shuffled texts
    lost = borne.where("bands is null").select("id", "id2", "doc_id", "row", "line_no")
    dealt = borne.select("id", F.explode("bands").alias("band"))
    if not lost.isEmpty():
        plain = store(bands(_texts(rows, lost).withColumn("id2", F.lit(0))))
        dealt = dealt.unionByName(plain.select("id", F.explode("bands").alias("band")))
    by_band = Window.partitionBy("band")
    ranged = dealt.select("band", "id", F.min("id").over(by_band).alias("lead"), F.max("id").over(by_band).alias("tail"))
    shared = store(ranged.where("lead <> tail").select("band", "id", "lead"))
    release(docs.sparkSession)  # shuffled bands

    ids = shared.select("id").distinct().withColumn("linked", F.lit(True))
    wanted = borne.drop("bands").join(ids, "id", "left").where("linked or n > 1").select("id", "id2", place.alias("first"), "linked")
    wanted = store(wanted)
    texts = store(_texts(rows, wanted.where("linked").select("id", "first.*")))
    known = store(outlines(texts))
    release(docs.sparkSession)

    lead = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = store(_confirm(_passed(lead, known, similarity), texts, similarity))
    release(docs.sparkSession)
    labels = components(links)
    for more in (_to_leads, _across):
        pairs = store(more(shared, labels, known, similarity))
        if pairs.isEmpty():
            continue
        links = links.unionByName(store(_confirm(pairs, texts, similarity)))
        release(docs.sparkSession)
        labels = components(links)

    up = labels.select(F.col("node").alias("id"), "root")
    grouped = wanted.join(up, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    verdict = grouped.join(least, "root").select("id", "id2", "keep")
    out = lines.select("doc_id", "row", "line_no", F.when(F.col("line") != "", F.col("id")).alias("id"), "id2").join(verdict, ["id", "id2"], "left")
    own = F.struct("doc_id", "row", "line_no")
    keep = F.coalesce("keep", own)
    return out.select("doc_id", "row", "line_no", keep["doc_id"].alias("first_doc"), keep["line_no"].alias("first_line"), keep.eqNullSafe(own).alias("kept"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every line that is not kept taken out of its text; all columns stay, texts without such lines as they are.

    A text that loses all its lines becomes empty; no row is dropped. NULL text stays NULL. See ``line_decisions``.
    """
    decided = line_decisions(docs, similarity, doc_id, text).where("not kept")
    gone = decided.groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row_at")).agg(F.collect_set("line_no").alias("__gone"))
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    joined = rows.join(gone, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__row_at")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
