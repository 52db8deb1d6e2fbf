"""Stupid-backoff language-model scores over words, computed relationally.

The text is cut into blocks of some megabytes. Every block counts its distinct n-grams and deals the sorted hashes out by
range: one row per block and range of hashes. The rows of a range are summed to the corpus counts, without a cutoff, and
each block gets back how often other blocks hold each of its n-grams, in the order in which it sent them, so no hash travels
back. There its documents meet the counts, and the scores of all positions are summed per document.

Every document is scored by the counts of all other documents: its own occurrences are taken off first, since in a model
without cutoff that holds the text itself no n-gram would ever be unseen. The score of a word after a context is
count(context + word) / count(context) for the longest context, up to ``order`` - 1 words, with which the word occurs in
another document, times ``alpha`` for every word the context had to be shortened. A lone word has count / number of words; a
word in no other document counts as one occurrence, shortened once more. Logarithms are whole millionths, so sums do not
depend on their order. N-grams are 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.llm.common import partitions, pick

ORDER, ALPHA = 3, 0.4
MICRO = 1_000_000
#: Bytes of text worked on at a time, and bytes of text that share one count table.
LOT, BLOCK = 1 << 21, 1 << 24
#: Number of block ``j`` of scan partition ``p``: p * SPREAD + j.
SPREAD = 1 << 24
KNOWN_WORDS = 1 << 19
#: N-grams of the corpus, repeats counted, per range of hashes.
RANGE = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def grams(texts: list[bytes], order: int, words: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(per n: hash of the n-gram that ends at each position, number of the text, place in the text) of all words.

    Where fewer than n words stand before the end of the n-gram, its hash means nothing (place < n - 1).
    """
    cut = [t.split() for t in texts]
    sizes = np.array([len(c) for c in cut], dtype=np.int64)
    n_words = int(sizes.sum())
    one = np.fromiter((words[w] for c in cut for w in c), dtype=np.uint64, count=n_words)
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n_words) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    levels = [_mix(one)]
    for n in range(2, order + 1):
        longer = np.zeros(n_words, dtype=np.uint64)
        longer[1:] = _mix(levels[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] + np.uint64(n))
        levels.append(longer)
    return [level.view(np.int64) for level in levels], text, place


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, num = np.concatenate(keys), np.concatenate(counts)
    sort = np.argsort(key)
    key, num = key[sort], num[sort]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(num, first) if len(first) else num


def pack(values: np.ndarray) -> list[bytes]:
    """Whole numbers as byte planes, lowest first and as many as the largest number has, each compressed by itself."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return [pa.compress(planes[:, i].tobytes(), codec="zstd", asbytes=True) for i in range(used)]


def unpack(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = np.frombuffer(pa.decompress(plane, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return out.reshape(-1).view("<u8")


def ranges(key: np.ndarray, num: np.ndarray, bits: int) -> Iterator[tuple[int, int, list[bytes], list[bytes]]]:
    """(range, distinct hashes, gaps between them, counts less one) of sorted hashes, by their ``bits`` highest bits."""
    shift = 64 - bits
    which = key >> shift
    cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(key)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            start = which[lo] << shift
            yield int(which[lo]), hi - lo, pack(np.diff(key[lo:hi], prepend=start).view(np.uint64)), pack(num[lo:hi] - 1)


def held_elsewhere(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted distinct keys of several holders: how often all the others together hold each."""
    key, num = np.concatenate(keys), np.concatenate(counts)
    sort = np.argsort(key, kind="stable")
    key, num = key[sort], num[sort]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    other = np.empty(len(key), np.int64)
    other[sort] = np.add.reduceat(num, np.flatnonzero(new))[np.cumsum(new) - 1] - num
    return np.split(other, np.cumsum([len(k) for k in keys])[:-1])


def count_grams(texts: list[bytes], order: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all n-grams that lie within one text, n = 1 .. order, sorted by hash."""
    levels, _, place = grams(texts, order, words)
    every = np.concatenate([level[place >= n] for n, level in enumerate(levels)])
    return np.unique(every, return_counts=True)


def document_sums(texts: list[bytes], table: tuple[np.ndarray, np.ndarray], corpus: int, order: int, alpha: float, words: Words) -> tuple[np.ndarray, ...]:
    """(words, sum of scores in millionths, positions scored by a shorter context than they have) of each text."""
    keys, totals = table
    levels, text, place = grams(texts, order, words)
    n_words = len(text)
    sizes = np.bincount(text, minlength=len(texts))
    step = int(np.rint(np.log(alpha) * MICRO))
    score, backed = np.zeros(n_words, np.int64), np.ones(n_words, bool)
    most = np.minimum(place + 1, order)
    # Words of all other documents; the score of a word that none of them holds.
    base = np.maximum(corpus - sizes, 1)[text]
    score[:] = np.rint(np.log(1.0 / base) * MICRO).astype(np.int64) + most * step
    for n, level in enumerate(levels, start=1):
        at = np.flatnonzero(place >= n - 1)
        other = np.zeros(n_words, np.int64)
        if len(at):
            # Equal n-grams side by side, in the order of texts: runs within a text are the text's own count.
            at = at[np.argsort(level[at], kind="stable")]
            key, owner = level[at], text[at]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            total = totals[np.searchsorted(keys, key[new])][np.cumsum(new) - 1]
            cuts = np.flatnonzero(new | np.concatenate(([True], owner[1:] != owner[:-1])))
            own = np.diff(np.append(cuts, len(at)))
            other[at] = total - np.repeat(own, own)
        hit = np.flatnonzero(other > 0)
        score[hit] = np.rint(np.log(other[hit] / base[hit]) * MICRO).astype(np.int64) + (most[hit] - n) * step
        backed[hit] = most[hit] > n
        # What the next longer n-gram is divided by: its context, which ends one word earlier.
        base = np.concatenate((np.ones(min(1, n_words), np.int64), other[:-1]))
    edge = np.concatenate(([0], np.cumsum(sizes)))
    total, back = np.concatenate(([0], np.cumsum(score))), np.concatenate(([0], np.cumsum(backed)))
    return sizes, total[edge[1:]] - total[edge[:-1]], back[edge[1:]] - back[edge[:-1]]


def _raw(value: str | None) -> bytes:
    return (value or "").encode()


def _lots(values: list[str | None], most: int) -> Iterator[list[bytes]]:
    """Runs of neighbouring rows with about ``most`` bytes of text."""
    lot, size = [], 0
    for v in values:
        raw = _raw(v)
        lot.append(raw)
        size += len(raw)
        if size >= most:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


class Blocks:
    """Block numbers of the rows of one scan partition, from the sizes of its texts in scan order alone."""

    def __init__(self, most: int) -> None:
        self.most, self.block, self.size = most, 0, 0

    def __call__(self, values: list[str | None]) -> list[int]:
        out = []
        for v in values:
            if self.size >= self.most:
                self.block, self.size = self.block + 1, 0
            out.append(self.block)
            self.size += len(_raw(v))
        return out


def stupid_backoff(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text",
    *, lot_bytes: int = LOT, block_bytes: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_words, score_micro, n_backed_off, mean_score) of every whole text, by a model of all other texts.

    Words are `[^\\x20\\x09-\\x0D]+`. score_micro is the sum of the natural logarithms in millionths, n_backed_off the number
    of words scored with a shorter context than they have, mean_score the mean logarithm per word (NULL without a word).
    NULL text counts as empty: it has no n-gram and scores 0. NULL and repeated ids and repeated rows are scored row by row,
    each by all other rows, so a repeated text is seen in its copy. Empty input gives an empty result; other columns are
    left out.

    An n-gram in every document is one hash per block, whatever its frequency; texts are shuffled once, by block. A task holds
    the counts of one block (a text longer than a block is one of its own) or of one range of hashes, of which there are more
    the more words the corpus has. The input is read three times and has to be a stable table. One number, the corpus size,
    reaches the driver.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    rows = pick(docs, doc_id=doc_id, text=text)
    n_parts, id_type = partitions(rows.sparkSession), rows.schema["doc_id"].dataType
    place = F.spark_partition_id().alias("scan")
    words_of = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    corpus = rows.agg(F.sum(words_of.cast("long"))).first()[0] or 0
    bits = max(4 * n_parts, order * corpus // RANGE, 1).bit_length()

    def batch_of(some, names):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds)], names=names)

    def count(batches):
        blocks, words, at, which, keys, counts = Blocks(block_bytes), Words(), None, 0, [], []

        def rows_of(number):
            parts = ranges(*_merge(keys, counts), bits)
            while some := list(islice(parts, 256)):
                yield batch_of([(number, *x) for x in some], ["block", "range", "n", "gaps", "counts"])

        for b in batches:
            values = b.column(1).to_pylist()
            numbers = np.array(blocks(values), dtype=np.int64)
            if b.num_rows:
                which = b.column(0)[0].as_py() * SPREAD
            for number in np.unique(numbers):
                if at is not None and number != at:
                    yield from rows_of(which + at)
                    keys, counts = [], []
                at = number
                lo, hi = np.searchsorted(numbers, [number, number + 1])
                for lot in _lots(values[lo:hi], lot_bytes):
                    key, num = count_grams(lot, order, words)
                    keys.append(key)
                    counts.append(num)
        if at is not None:
            yield from rows_of(which + at)

    def deal(batches):
        blocks = Blocks(block_bytes)
        for b in batches:
            if b.num_rows:
                numbers = np.array(blocks(b.column(2).to_pylist()), dtype=np.int64) + b.column(0)[0].as_py() * SPREAD
                yield pa.RecordBatch.from_arrays([pa.array(numbers), b.column(1), b.column(2)], names=["block", "doc_id", "text"])

    counted = rows.select(place, "text").mapInArrow(count, "block long, range long, n int, gaps array<binary>, counts array<binary>")

    def total(batches):
        at, blocks, keys, counts = None, [], [], []

        def replies():
            return batch_of([(block, at, len(x), pack(x)) for block, x in zip(blocks, held_elsewhere(keys, counts))], ["block", "range", "n", "others"])

        for b in batches:
            for block, which, n, gaps, num in zip(*(c.to_pylist() for c in b.columns)):
                if which != at:
                    if blocks:
                        yield replies()
                    at, blocks, keys, counts = which, [], [], []
                blocks.append(block)
                keys.append(np.cumsum(unpack(gaps, n)).view(np.int64) + (which << (64 - bits)))
                counts.append(unpack(num, n).astype(np.int64) + 1)
        if blocks:
            yield replies()

    summed = counted.repartition(n_parts, "range").sortWithinPartitions("range").mapInArrow(total, "block long, range long, n int, others array<binary>")
    table = summed.select("block", F.lit(0).alias("kind"), "range", "n", "others", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    dealt_type = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", id_type), T.StructField("text", T.StringType())])
    texts = rows.select(place, "doc_id", "text").mapInArrow(deal, dealt_type)
    texts = texts.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("range"), F.lit(0).alias("n"), F.lit(None).cast("array<binary>").alias("others"), "doc_id", "text")
    dealt = table.unionByName(texts).repartition(n_parts, "block").sortWithinPartitions("block", "kind", "range")
    fields = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("score_micro", T.LongType()), ("n_backed_off", T.LongType()), ("mean_score", T.DoubleType()))])

    def finish(ids, raw, others, words):
        """Scores of one block: counts of its own and, in the order of its hashes, those of all other blocks."""
        key, num = _merge(*map(list, zip(*(count_grams(lot, order, words) for lot in _lots(raw, lot_bytes)))))
        other = np.concatenate([np.empty(0, np.int64), *others])
        if len(other) != len(key):
            raise RuntimeError("the input changed while it was read")
        table = key, num + other
        size, total, back = (np.concatenate(x) for x in zip(*(document_sums(lot, table, corpus, order, alpha, words) for lot in _lots(raw, lot_bytes))))
        mean = pa.array(total / np.maximum(size, 1) / MICRO, mask=size == 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(back, pa.int64()), mean], names=fields.names)

    def score(batches):
        words, at, others, ids, raw = Words(), None, [], [], []
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if blocks[lo] != at:
                    if raw:
                        yield finish(pa.concat_arrays(ids), raw, others, words)
                    at, others, ids, raw = blocks[lo], [], [], []
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    others += [unpack(planes, n).astype(np.int64) for n, planes in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                else:
                    ids.append(part.column(4))
                    raw += part.column(5).to_pylist()
        if raw:
            yield finish(pa.concat_arrays(ids), raw, others, words)

    return dealt.select("block", "kind", "n", "others", "doc_id", "text").mapInArrow(score, fields)
