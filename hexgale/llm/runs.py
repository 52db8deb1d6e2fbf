"""Periodic runs of words by Baier grouping.

Phase one of the suffix sorter groups suffixes by their longest Lyndon prefix: groups are taken from the highest down, each
suffix of the group points to the next one to its left that is not yet taken, and suffixes that are pointed to leave their
group for a new one right above it, the higher the more pointers they got; their prefix grows by the taken group's prefix
once per pointer. When a group is taken, the length of its prefix is the Lyndon array of its suffixes. Done under the order
of words and under its inverse, this gives a Lyndon root of every run; common extensions to both sides (exact, from names
of blocks of doubling length) turn roots into runs.

Before the sorter, a text is cut where no run can pass: a word of a run has an equal word within a third of the run's
length, so inside a stretch of n words a word whose nearest equal lies further than n / 3 ends it. That is repeated while
it changes something; it removes only words that no run contains, and every run that is returned comes from the Lyndon roots.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hexgale.llm.common import pick

#: A run has at least this many words and periods.
LEAST, TIMES = 24, 3
#: Words of texts whose runs are found together; rounds of cutting before the sorter.
LOT, ROUNDS = 400_000, 16


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word starting at each place, by phase one of Baier's suffix sorter."""
    n = len(word)
    if not n:
        return []
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right.append(0)  # of the place before the first
    left.append(n - 1)  # of the place after the last
    first: dict[int, list[int]] = {}
    for i, c in enumerate(word):
        first.setdefault(c, []).append(i)
    # Groups in a linked list, ascending: members (in text order, some may have left), prefix length, lower neighbour.
    members: list[list[int]] = [[]]
    length, lower, higher = [0], [0], [0]
    of = [0] * n

    def insert(after: int, places: list[int], size: int) -> None:
        g, up = len(members), higher[after]
        members.append(places)
        length.append(size)
        lower.append(after)
        higher.append(up)
        higher[after] = g
        lower[up] = g
        for i in places:
            of[i] = g

    for c in sorted(first):
        insert(lower[0], first[c], 1)
    out = [0] * n
    while (g := lower[0]) != 0:
        size = length[g]
        pointed: dict[int, int] = {}
        for i in members[g]:
            if of[i] == g:
                out[i] = size
                p, r = left[i], right[i]
                left[r] = p
                if p >= 0:
                    right[p] = r
                    pointed[p] = pointed.get(p, 0) + 1
        # Take the group out of the list; its suffixes are no longer to the left of any other.
        lower[0] = lower[g]
        higher[lower[g]] = 0
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moved.setdefault((times, of[p]), []).append(p)
        # Most pointers first: each new group goes right above the old one, below those with more.
        for times, old in sorted(moved, reverse=True):
            insert(old, moved[times, old], length[old] + times * size)
    return out


class Blocks:
    """Names of all blocks of 1, 2, 4, ... words; two blocks of a length have one name if and only if they are equal."""

    def __init__(self, word: np.ndarray, longest: int):
        self.names = [word.astype(np.int64)]
        size = 1
        while 2 * size <= longest:
            a = self.names[-1]
            pair = a[:-size] * np.int64(len(word) + 1) + a[size:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the words from i on and from j on."""
        n = len(self.names[0])
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            # Each length can fit once, except the longest, which may fit again.
            while True:
                a, b = i + got, j + got
                fits = np.maximum(a, b) + (1 << k) <= n
                same = fits.copy()
                same[fits] = self.names[k][a[fits]] == self.names[k][b[fits]]
                got[same] += 1 << k
                if k < len(self.names) - 1 or not same.any():
                    break
        return got

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common suffix of the words before i and before j."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            while True:
                a, b = i - got - (1 << k), j - got - (1 << k)
                fits = np.minimum(a, b) >= 0
                same = fits.copy()
                same[fits] = self.names[k][a[fits]] == self.names[k][b[fits]]
                got[same] += 1 << k
                if k < len(self.names) - 1 or not same.any():
                    break
        return got


def stretches(word: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches that hold all runs of texts laid one after another.

    ``word``: names of words; ``text``: ascending number of the text of each word. See the module for the rule.
    """
    at = np.arange(len(word), dtype=np.int64)
    stretch = text.astype(np.int64)
    for _ in range(ROUNDS):  # fewer rounds only leave longer stretches
        if not len(at):
            break
        # Nearest equal word on either side within the same stretch.
        order = np.lexsort((at, word[at], stretch))
        p, w, s = at[order], word[at][order], stretch[order]
        gap = np.full(len(at) + 1, np.iinfo(np.int64).max)
        linked = (w[1:] == w[:-1]) & (s[1:] == s[:-1])
        gap[1:-1][linked] = (p[1:] - p[:-1])[linked]
        near = np.empty(len(at), dtype=np.int64)
        near[order] = np.minimum(gap[1:], gap[:-1])
        _, own, size = np.unique(stretch, return_inverse=True, return_counts=True)
        good = near <= size[own] // times
        kept, was = at[good], stretch[good]
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (was[1:] != was[:-1])
        number = np.cumsum(new) - 1
        enough = np.bincount(number, minlength=1)[number] >= least
        if enough.all() and len(kept) == len(at):
            break
        at, stretch = kept[enough], number[enough]
    if not len(at):
        return at, at
    begin = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
    starts = at[begin]
    return starts, starts + np.diff(np.append(begin, len(at)))


def find_runs(word: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of texts laid one after another, by start, then period; starts count from the first text."""
    none = np.zeros(0, dtype=np.int64)
    starts, ends = stretches(word, text, least, times)
    if not len(starts):
        return none, none, none
    # Stretches one after another, a word of its own between two; places there and in the texts.
    sizes = ends - starts
    offset = np.cumsum(sizes + 1) - sizes - 1
    line = np.empty(int(offset[-1] + sizes[-1]) + 1, dtype=np.int64)
    roots_at, roots_size = [], []
    for s, e, o in zip(starts.tolist(), ends.tolist(), offset.tolist()):
        names, own = np.unique(word[s:e], return_inverse=True)
        for ranks in (own, len(names) - own):
            size = np.array(lyndon_array(ranks.tolist()), dtype=np.int64)
            fit = np.flatnonzero(size * times <= e - s)
            roots_at.append(fit + o)
            roots_size.append(size[fit])
        line[o : o + e - s] = word[s:e]
    line[offset + sizes] = int(word.max()) + 1 + np.arange(len(offset))
    at, period = np.concatenate(roots_at), np.concatenate(roots_size)
    blocks = Blocks(np.unique(line, return_inverse=True)[1], int(sizes.max()))
    back, on = blocks.behind(at, at + period), blocks.ahead(at, at + period)
    start, length = at - back, back + period + on
    good = length >= np.maximum(least, times * period)
    found = np.unique(np.stack((start[good], period[good], length[good]), axis=1), axis=0)
    start, period, length = found.T if len(found) else (none, none, none)
    which = np.searchsorted(offset, start, side="right") - 1
    return start - offset[which] + starts[which], length, period


def plant(words: list[bytes], key: int) -> list[bytes]:
    """The fixed edit of the query: for one key in ten the words from a place on repeat with a period."""
    n = len(words)
    if key % 10 or not n:
        return words
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, planted: bool = False, doc_id: str = "doc_id", text: str = "text", lot: int = LOT) -> DataFrame:
    """(doc_id, n_words, runs, kept): runs {start, length, period} by start, then period, and the words left as one text.

    Words are stretches of bytes other than space and 0x09-0x0D. A run is a stretch of words with smallest period q and
    at least max(``least``, ``times`` * q) words that cannot be extended with that period. Words that a run contains after
    its first q words are left out of ``kept`` (joined by one space). With ``planted`` the query's edit is made first.

    Each scan task handles its own texts, several together up to ``lot`` words; one long text takes memory in proportion
    to its longest stretch that may hold a run. No shuffle, so no hot group. NULL and empty texts have no words and no
    runs; a NULL id is never edited; repeated rows are separate rows; ties between runs do not arise, as no two share
    start and period; an empty table gives an empty result; other columns are left out.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("kept", T.StringType())])
    arrow_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def solve(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        names = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        sizes = np.array([len(words) for words in texts])
        word = np.fromiter(map(names.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
        start, length, period = find_runs(word, np.repeat(np.arange(len(texts)), sizes), least, times)
        before = np.cumsum(sizes) - sizes
        which = np.searchsorted(before, start, side="right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for t, s, n, p in zip(which.tolist(), (start - before[which]).tolist(), length.tolist(), period.tolist()):
            out[t].append((s, n, p))
        return out

    def batch_of(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = solve(texts)
        kept = [b" ".join(collapse(w, r)).decode("utf-8", "replace") for w, r in zip(texts, runs)]
        told = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        columns = [pa.array(ids, id_type), pa.array([len(w) for w in texts], pa.int64()), pa.array(told, arrow_runs), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    id_type = None

    def run(batches):
        nonlocal id_type
        ids, texts, held = [], [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                if planted and key is not None:
                    words = plant(words, zlib.crc32(str(key).encode()))
                ids.append(key)
                texts.append(words)
                held += len(words)
                if held >= lot or len(ids) >= 4096:
                    yield batch_of(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield batch_of(ids, texts)

    return rows.mapInArrow(run, schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document of the edited table: number of runs, the one of greatest exact exponent, digests of runs and kept words."""
    found = periodic_runs(docs, planted=True)
    whole = T.StructType([found.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), *(T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256"))])

    def digest(batches):
        for batch in batches:
            out = []
            for runs, kept in zip(batch.column(2).to_pylist(), batch.column(3)):
                listed = [(r["start"], r["length"], r["period"]) for r in runs]
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
                best = _best(listed) if listed else (None, None, None)
                milli = 1000 * best[1] // best[2] if listed else None
                out.append((len(listed), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.as_py().encode()).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=whole.names)

    return found.mapInArrow(digest, whole)
