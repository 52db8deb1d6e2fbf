"""Text operators against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexgale.llm import bpe, common, cover_tree, fingerprints, html, language, line_dedup, lm_score, near_dedup, packing, repeats, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hashes string, component_id string, sequence_id string"
SYLLABLES = "an ber chi do ei fla gre ho in ju ka lo ma ne or pi qu ra su te".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    """Ids with gaps, copies, near copies, shared passages, repeated rows, odd texts and a NULL id."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 220)) for _ in range(40)]
    passage = prose(rng, 90)
    texts = list(base)
    texts += [base[0], base[1], base[1]]
    for k in range(8):
        words = base[3].split(" ")
        words[(7 * k) % len(words)] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(5)]
    texts += [None, "", " \n\t ", "a", "one two", "ab" * 700, "ab" * 650, "x\x1cy  z 　 é́ <|endoftext|> \U0001f600", "123 456"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, base[5]), (9, prose(rng, 20))]


def frame(spark, rows, parts: int = 3):
    full = [(i, t, ("en", "de", None)[(i or 0) % 3], "s", len(t or ""), "h", "c", "q") for i, t in rows]
    return _table(spark, full, parts)


def _table(spark, rows, parts):
    """A stable table: operators that read their input more than once need one."""
    return common.cut_lineage(spark.createDataFrame(rows, SCHEMA).coalesce(1).repartition(parts))


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(None, 1), (5, None)]
    parent: dict = {x: x for e in edges for x in e if None not in e}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_keep_estimates_small(spark):
    """The planner's estimate of a result's size must not grow with the rounds: as a product of products it filled the driver."""
    labels = common.components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63


def test_bands_are_made_in_generated_code(spark, capsys):
    """Shingles are hashed without functions of array elements, which Spark interprets; the values are those of ``_hashes``."""
    lines = spark.createDataFrame([(1, 1, "short"), (2, 2, "12345678"), (3, 3, "über die Brücke \u00e9\U0001f600" * 9)], "id long, id2 long, line string")
    line_dedup.bands(lines).explain()
    assert "lambda" not in capsys.readouterr().out
    got = {r["id"]: r["bands"] for r in line_dedup.bands(lines).collect()}
    for row in lines.select("id", line_dedup.shingles(F.col("line")).alias("h")).collect():
        least = [[min(_signed(_rotated(h, 64 * r // line_dedup.ROWS)) ^ m for h in row["h"]) for r, m in enumerate(band)] for band in line_dedup.MASKS]
        want = spark.range(1).select(F.array(*(F.xxhash64(F.lit(b), *(F.lit(v).cast("long") for v in values)) for b, values in enumerate(least))).alias("w")).first()["w"]
        assert got[row["id"]] == want


def _rotated(h: int, by: int) -> int:
    h %= 2**64
    return (h << by | h >> (64 - by)) % 2**64


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def test_words_made_of_known_pieces(monkeypatch):
    words = tokens.WordTokens(common.tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    odd = [*"abzABZ09!_-'&ßÀÿé×÷^`~ªµ½²İſıǅ", "\u0301", "\ufb01", " ", "\xa0", "\x1c", "'s", "'ll", "don't", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(odd, 40)) for _ in range(500)] + [chr(c) + d + chr(c) for c in range(0x21, 0x250) for d in ("a", "3!", "' ")]
    for x in texts:
        assert words.ids(x) == np.asarray(words.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), x
    # Runs whose pieces are known do not go through the tokenizer.
    words.ids("Größe tree ### ;;")
    monkeypatch.setattr(words, "_encode", None)
    assert words.ids("größe### tree;; größe;;") == b"".join(map(words.ids, ("größe", "###", "tree", ";;", "größe", ";;")))


def test_suffixes_are_sorted_on_group_by_group(monkeypatch):
    rng = np.random.default_rng(8)
    for _ in range(60):
        parts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        suffixes, data, ends, key = repeats.suffix_order(parts)
        places = [(p, i) for p, x in enumerate(parts) for i in range(len(x))]
        starts = np.cumsum([0] + [len(x) for x in parts])
        assert suffixes.tolist() == [int(starts[p]) + i for p, i in sorted(places, key=lambda at: (parts[at[0]][at[1] :], at[0]))]
        assert [int(k).to_bytes(8, "big").rstrip(b"\0") for k in key] == [parts[p][i : i + 8] for p, i in places]
    # Each sort finds the groups of the one before in order, and so has only to sort within them.
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **how: sorts.append(x) or argsort(x, **how))
    parts = [bytes(rng.integers(97, 101, 30).astype(np.uint8)) * 4 for _ in range(40)]
    repeats.suffix_order(parts)
    span = sum(map(len, parts)) + len(parts) + 1
    assert len(sorts) > 2 and all((np.diff(x // span) >= 0).all() for x in sorts[1:])


def test_lm_score_sends_few_bytes():
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(-(2**63), 2**63, 200_000)) for _ in range(3)]
    keys[1] = np.unique(np.concatenate((keys[1], keys[0][::3], [-(2**63), 2**63 - 1])))
    counts = [rng.integers(1, 300 if i else 2, len(k)) for i, k in enumerate(keys)]
    for key, num in zip(keys, counts):
        back = [(lm_score.unpack(gaps, n).cumsum().view(np.int64) + (which << 58), lm_score.unpack(c, n) + 1) for which, n, gaps, c in lm_score.ranges(key, num, 6)]
        assert (np.concatenate([k for k, _ in back]) == key).all() and (np.concatenate([c for _, c in back]) == num).all()
    # A hash that travels costs less than its 8 bytes, and what comes back of one that nobody else holds next to nothing.
    assert sum(len(x) for _, _, gaps, c in lm_score.ranges(keys[0], counts[0], 6) for x in gaps + c) < 6.5 * len(keys[0])
    others = lm_score.held_elsewhere(keys, counts)
    assert sum(map(len, lm_score.pack(others[2]))) < 0.1 * len(keys[2])
    want = {}
    for key, num in zip(keys, counts):
        for k, c in zip(key.tolist(), num.tolist()):
            want[k] = want.get(k, 0) + c
    for key, num, other in zip(keys, counts, others):
        assert [want[k] - c for k, c in zip(key.tolist(), num.tolist())] == other.tolist()
    assert lm_score.pack(np.empty(0, np.int64)) == [] and lm_score.unpack([], 2).tolist() == [0, 0]


@pytest.mark.parametrize("lot, block", [(lm_score.LOT, lm_score.BLOCK), (300, 900)])
def test_lm_score(spark, corpus, lot, block):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in corpus]

    def count_of(words: list[str]) -> Counter:
        return Counter(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))

    count = sum(map(count_of, texts), Counter())
    total = sum(map(len, texts))
    step = int(np.rint(np.log(lm_score.ALPHA) * lm_score.MICRO))

    def micro(share: float) -> int:
        return int(np.rint(np.log(share) * lm_score.MICRO))

    def score(words: list[str]) -> tuple[int, int]:
        own, out, backed = count_of(words), 0, 0
        elsewhere = max(total - len(words), 1)
        for i in range(len(words)):
            most = min(3, i + 1)
            value, short = micro(1 / elsewhere), most
            for n in range(most, 0, -1):
                gram = tuple(words[i + 1 - n : i + 1])
                if count[gram] > own[gram]:
                    value, short = micro((count[gram] - own[gram]) / (count[gram[:-1]] - own[gram[:-1]] if n > 1 else elsewhere)), most - n
                    break
            out, backed = out + value + short * step, backed + (short > 0)
        return out, backed

    got = lm_score.stupid_backoff(frame(spark, corpus), lot_bytes=lot, block_bytes=block).collect()
    assert Counter((r["doc_id"], r["n_words"], r["score_micro"], r["n_backed_off"]) for r in got) == Counter((i, len(w), *score(w)) for (i, _), w in zip(corpus, texts))
    assert all(r["mean_score"] is None if not r["n_words"] else abs(r["mean_score"] - r["score_micro"] / r["n_words"] / 1e6) < 1e-9 for r in got)
    assert lm_score.stupid_backoff(frame(spark, [])).count() == 0


def vectors_of(rng, n: int) -> list[tuple]:
    rows = []
    centres = rng.normal(size=(12, 16))
    for i in range(n):
        v = rng.normal(size=16) if i % 3 == 0 else centres[i % 12] + rng.normal(size=16) * 0.12
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(n + k, rows[4][1], 0) for k in range(5)]
    rows += [(n + 10, None, 0), (n + 11, [0.0] * 16, 0), (n + 12, [float("nan")] * 16, 0), (n + 13, [None] * 16, 0), (n + 14, rows[4][1], None), (n + 15, [1.0, 2.0], 0), (n + 16, [], 0), (n + 17, [float("inf")] + [1.0] * 15, 0)]
    return rows


@pytest.mark.parametrize("leaf", [16, 1024])
def test_vectors(spark, leaf):
    rows = vectors_of(np.random.default_rng(3), 300)
    ok = {i: (np.array(v, float), c) for i, v, c in rows if v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    parent = {i: i for i, _, _ in rows}
    links: Counter = Counter()
    for i, (a, c) in ok.items():
        for j, (b, d) in ok.items():
            if i < j and c == d and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links.update((i, j))
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(1)).withColumn("e", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicate_vectors(df, leaf=leaf).collect()}
    assert got == {i: (links[i], find(parent, i), find(parent, i) == i) for i in parent}
    assert sum(links.values()) > 100
    assert cover_tree.near_duplicate_vectors(df.limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(8)
    lines = [prose(rng, 30) for _ in range(30)]
    near = [" ".join("other" if k == j else w for k, w in enumerate(x.split(" "))) for j, x in enumerate(lines[:10])]
    texts = ["\n".join(rng.choices(lines + near, k=6)) + "\n\nab\n" for _ in range(40)] + [None, "", "\n\n", "ab"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = frame(spark, rows, 1)
    got = line_dedup.line_decisions(df).collect()

    def shingles(x: str) -> frozenset:
        b = x.encode()
        return frozenset(b[i : i + 8] for i in range(max(1, len(b) - 7)))

    seen = sorted({x for t in texts if t for x in t.split("\n") if x})
    parent = {x: x for x in seen}
    for i, a in enumerate(seen):
        for b in seen[:i]:
            sa, sb = shingles(a), shingles(b)
            if len(sa & sb) >= 0.8 * len(sa | sb):
                parent[find(parent, a)] = find(parent, b)
    text = dict(rows)
    kept = Counter(find(parent, text[r["doc_id"]].split("\n")[r["line_no"]]) for r in got if r["kept"] and text[r["doc_id"]].split("\n")[r["line_no"]])
    # Banding may miss a link right at the limit, so a component may keep a line too many; none may lose its last one.
    assert set(kept) == {find(parent, x) for x in seen} and sum(kept.values()) <= len(kept) + 2
    assert len(got) == sum(len(t.split("\n")) for _, t in rows if t is not None)
    cut = line_dedup.dedup_lines(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert sum(len(r["text"].replace("\n", "")) for r in cut.collect() if r["text"]) == sum(len(text[r["doc_id"]].split("\n")[r["line_no"]]) for r in got if r["kept"])
    assert line_dedup.line_decisions(frame(spark, [])).count() == 0


def near_pairs(rng: random.Random, words: range, changed: list[int], n: int) -> list[tuple[float, str, str]]:
    """Pairs of lines with some words changed, and their similarity."""
    out = []
    for _ in range(n):
        a = prose(rng, rng.choice(words)).split(" ")
        b = list(a)
        for at in rng.sample(range(len(b)), rng.choice(changed)):
            b[at] = prose(rng, 1)
        sa, sb = ({x.encode()[i : i + 8] for i in range(max(1, len(x.encode()) - 7))} for x in (" ".join(a), " ".join(b)))
        out.append((len(sa & sb) / len(sa | sb), " ".join(a), " ".join(b)))
    return out


def unbanded(spark, pairs) -> list[bool]:
    """Whether each pair of lines has no band in common."""
    lines = [(2 * i + k, 0, x) for i, p in enumerate(pairs) for k, x in enumerate(p[1:])]
    got = {r["id"]: set(r["bands"]) for r in line_dedup.bands(spark.createDataFrame(lines, "id long, id2 long, line string")).collect()}
    return [not got[2 * i] & got[2 * i + 1] for i in range(len(pairs))]


def test_lines_bands_of_whole_sets(spark):
    rng = random.Random(4)
    pairs = [p for p in near_pairs(rng, range(40, 161), [1, 2, 3, 4, 5, 6, 7, 8], 1600) if 0.8 <= p[0] < 0.9]
    assert len(pairs) > 400 and sum(unbanded(spark, pairs)) <= 0.01 * len(pairs)


def test_lines_exactly_as_brute_force(spark):
    rng = random.Random(12)
    pairs = near_pairs(rng, range(15, 60), [1, 2, 3], 60)
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p[1:])]
    got = {r["doc_id"]: r["first_doc"] for r in line_dedup.line_decisions(frame(spark, rows)).collect()}
    assert got == {2 * i + k: 2 * i if p[0] >= 0.8 else 2 * i + k for i, p in enumerate(pairs) for k in (0, 1)}


def test_lines_of_repeated_units(spark):
    """Lines with the same set of shingles are one component, however often they repeat it."""
    rng = random.Random(6)
    pairs = []
    for short, long in [(6, 8), (6, 12), (10, 20)]:
        pairs += [(1.0, x * short, x * long) for x in (prose(rng, 12) + " " for _ in range(40))]
    for unit in ["-", "=", "+--", "| ", "ab", " . ", "<br>", "*-*-", "lorem ", "----+"]:
        pairs += [(1.0, unit * m, unit * n) for m, n in ((30, 31), (70, 90), (64, 640))]
    assert not any(unbanded(spark, pairs))
    rows = [(2 * i + k, x) for i, p in enumerate(pairs[:120]) for k, x in enumerate(p[1:])]
    got = {r["doc_id"]: r["first_doc"] for r in line_dedup.line_decisions(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(240)}


def test_lines_of_one_template_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Lines that share bands but are not alike: few pairs reach the comparison of sets, those that are alike all do."""
    rng = random.Random(3)
    template = prose(rng, 60).split(" ")
    lines = [" ".join(prose(rng, 1) if rng.random() < 0.1 else w for w in template) for _ in range(60)]
    lines += [" ".join(w + "s" if j == 7 else w for j, w in enumerate(x.split(" "))) for x in lines[:20]]
    sets = [{x.encode()[i : i + 8] for i in range(len(x.encode()) - 7)} for x in lines]
    alike = [(i, j) for j in range(80) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    parent = {i: i for i in range(80)}
    for i, j in alike:
        x, y = find(parent, i), find(parent, j)
        parent[max(x, y)] = min(x, y)
    compared, confirm = [], line_dedup._confirm
    monkeypatch.setattr(line_dedup, "_confirm", lambda pairs, *more: compared.append(pairs.count()) or confirm(pairs, *more))
    got = {r["doc_id"]: r["first_doc"] for r in line_dedup.line_decisions(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {i: find(parent, i) for i in parent} and len(set(got.values())) > 40
    assert sum(compared) < 200


def test_lines_thin_minima_and_outlines(spark):
    """The thin form gives the bands of the plain one or none; outlines let all pairs pass that are alike."""
    rng = random.Random(9)
    pairs = near_pairs(rng, range(6, 120), [0, 1, 2, 3, 6], 300) + [(1.0, "=" * 300, "=" * 700), (1.0, "ab" * 90, "ab" * 400)]
    lines = spark.createDataFrame([(2 * i + k, 0, x) for i, p in enumerate(pairs) for k, x in enumerate(p[1:])], "id long, id2 long, line string")
    plain = {r["id"]: r["bands"] for r in line_dedup.bands(lines).collect()}
    thin = {r["id"]: r["bands"] for r in line_dedup._minima(lines, ["id", "id2"], thin=True).collect()}
    assert all(thin[i] in (None, plain[i]) for i in plain) and thin[600] is None and sum(x is None for x in thin.values()) < 40
    every = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a long, b long")
    passed = {r["a"] // 2 for r in line_dedup._passed(every, line_dedup.outlines(lines), 0.8).collect()}
    assert {i for i, p in enumerate(pairs) if p[0] >= 0.8} <= passed and sum(pairs[i][0] < 0.7 for i in passed) == 0


def check_packing(rows, capacity: int) -> int:
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    pieces = tokens.token_pieces(frame(spark, corpus), path, capacity=256)
    rows = packing.best_fit_pack(pieces, capacity=256, shard=40).collect()
    want: Counter = Counter()
    for i, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4").tobytes()
            want[i, n, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 256) <= -(-total // 256) * 1.05 + 2
    empty = packing.best_fit_pack(pieces.limit(0), capacity=256)
    assert empty.count() == 0 and {"sequence_id", "offset"} < set(empty.columns)
    with pytest.raises(ValueError):
        packing.best_fit_pack(pieces, capacity=10)


def test_local_search_empties_a_bin():
    lengths = np.array([6, 3, 1, 6, 3, 1, 5, 5, 4, 6])  # 40 in bins of 10
    bins = np.array([0, 0, 0, 1, 1, 1, 2, 3, 3, 4])
    better = packing.local_search(lengths, bins, 10)
    fill = np.bincount(better, weights=lengths)
    assert fill.max() <= 10 and len(fill) == 4


def removed(texts: list[bytes], length: int) -> list[tuple]:
    count: Counter = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [40, 200])
def test_repeats(spark, corpus, length):
    want = Counter((i, *w) for (i, _), w in zip(corpus, removed([(t or "").encode() for _, t in corpus], length)))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(frame(spark, corpus), length, 8).collect())
    assert got == want
    cut = repeats.cut_repeats(frame(spark, corpus), length, 8)
    assert cut.count() == len(corpus)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(60):
        parts = ["".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        parts += parts[: rng.randint(0, 2)]
        starts = [(p, i) for p in range(len(parts)) for i in range(len(parts[p]))]

        def common_prefix(x, y):
            a, b = parts[x[0]][x[1] :], parts[y[0]][y[1] :]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        want = [max((common_prefix(s, t) for t in starts if t != s), default=0) for s in starts]
        assert repeats.matching_statistics(parts).tolist() == want


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One<br>two &lt;b&gt;<p><b>Three  four</p><div id="comments"><p>Nice!</p></div>
<form><p>Search</p></form><script>var x="</p>";</script></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_html(spark):
    plain = "<div><p>Home | About</p><p>%s</p><p>Terms of use</p></div>"
    rows = [(1, "http://a.example/x/1", PAGE), (2, "http://b.example/x/1", plain % "First story"), (3, "http://b.example/x/2", plain % "Second story"), (4, "http://c.example/", plain % "Alone"), (5, None, None), (6, "http://d.example/1", "<p>Same</p>"), (7, "http://d.example/2", "<p>Same</p>"), (8, "x", ""), (1, "http://a.example/x/1", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")).withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_main_text(df).collect())
    article = "Head & more\n\nOne two <b>\n\nThree four"
    want = [(1, article), (1, article), (2, "First story"), (3, "Second story"), (4, "Home | About\n\nAlone\n\nTerms of use"), (5, ""), (6, "Same"), (7, "Same"), (8, "")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_html_hot_host_spans_ranges(spark):
    """Furniture is found on a host whose pages lie in many ranges, also at their borders."""
    rows = [(i, f"http://h.example/{i:05d}", f"<p>Top line</p><p>Story number {i}</p><p>Last line</p>") for i in range(1500)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(i, f"Story number {i}") for i in range(1500)}


def test_html_marked_articles_are_compared(spark):
    """Against brute force: furniture without a telling mark inside articles, copies under other URLs, a hot page, hosts."""
    rng = random.Random(3)
    page = "<html><body><p>Outside</p><article><div>Read on our site</div><p>%s</p><p>Edited by staff</p></article></body></html>"
    stories = [prose(rng, 5) for _ in range(30)]
    rows = [(i, f"http://h{rng.randrange(3)}.example/{rng.choice('ab')}/{rng.randrange(400)}", page % rng.choice(stories)) for i in range(1200)]
    rows += [(2000 + i, "http://h0.example/a/hot", page % "Hot story") for i in range(500)]
    rows += [(3000, "http://one.example/", page % "Alone"), (3001, "http://two.example/1", page % "Copy"), (3002, "http://two.example/2", page % "Copy")]
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(got) == len(rows)
    listed = {i: [t for t, _ in html.blocks(h)] for i, _, h in rows}
    keys = {i: html._key(u) for i, u, _ in rows}
    for i in got:
        host = [j for j in keys if html._host(keys[j]) == html._host(keys[i]) and listed[j] != listed[i]]
        near = max((html._shared_prefix(keys[i], keys[j]) for j in host), default=None)
        others = [listed[j] for j in host if html._shared_prefix(keys[i], keys[j]) == near] or [None]
        inside = [x != "Outside" for x in listed[i]]
        assert got[i] in {html.main_text(listed[i], inside, x) for x in others}
    assert got[2000] == "Hot story" and got[3000] == got[3001].replace("Copy", "Alone") == "Read on our site\n\nAlone\n\nEdited by staff"


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(100):
        a, b = rng.choices("abcd", k=rng.randint(0, 12)), rng.choices("abcd", k=rng.randint(0, 12))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.common_subsequence(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))


def near_brute(rows, n: int, percent: int):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(words[j : j + n]) for j in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else []))
    parent = {k: k for k in range(len(rows))}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(parent, i)] = find(parent, j)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(parent, k)] = min(least.get(find(parent, k), i), i)
    return [(i, len(sets[k]), None if i is None else least[find(parent, k)]) for k, (i, _) in enumerate(rows)]


def test_near_duplicates(spark, corpus):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, corpus)).collect())
    assert got == Counter(near_brute(corpus, 4, 80))
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_large_group(spark):
    """A group larger than any node, whose members are similar to the base and partly to each other, and its neighbours."""
    rng = random.Random(6)
    base = prose(rng, 200).split(" ")
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"w{i}x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(rng, 150)) for i in range(50)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter(near_brute(rows, 4, 80))


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = Counter()
    for i, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.bpe_encode(frame(spark, corpus), path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in got)


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path)
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "a", "The", "é", "ß", "1", "²", "'s", "'ll", "'", "<|endoftext|>", "<|", "!", "日本", "😀", "́", "\x00", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_language(spark):
    rng = random.Random(9)
    words = {"en": ["the", "with", "thing", "shine", "water"], "fr": ["été", "où", "château", "peux", "eau"], "de": ["über", "straße", "schön", "zeit", "ich"]}
    rows = []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(rng.choices(words[lang], k=40)), lang, "s", 0, "h", "c", "q"))
    odd = [(900, None, "en", "s", 0, "h", "c", "q"), (901, "123 !", "en", "s", 0, "h", "c", "q"), (902, "", None, "s", 0, "h", "c", "q"), (None, "the water", None, "s", 0, "h", "c", "q")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model, langs = language.fit_language_model(df)
    assert langs == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language.identify_language(df, model, langs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] for r in held)
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit_language_model(df.limit(0))
    assert nothing == (None, []) and {r["lang_pred"] for r in language.identify_language(df, *nothing).collect()} == {"und"}


def test_language_gradient():
    """Back-propagation through time against finite differences."""
    rng = np.random.default_rng(0)
    model = language.ByteGRU(3, hidden=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    codes, labels = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        both = np.concatenate([model._layer(codes, d, []).astype(np.float64) for d in "fb"], axis=2)
        z = both @ model.w["V"] + model.w["c"]
        z -= z.max(axis=2, keepdims=True)
        p = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
        return -p[:, np.arange(4), labels].mean()

    grads = model.gradient(codes, labels)
    for name, at in (("V", (1, 2)), ("Uf", (0, 4)), ("Ub", (2, 8)), ("Xf", (98, 3)), ("af", (1,)), ("ab", (0,)), ("c", (1,))):
        w, eps = model.w[name], 1e-3
        old = w[at]
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-4


def test_fingerprints(spark, corpus):
    rows = sorted([(i, t or "") for i, t in corpus if i is not None] + [(-1, "né" * 60)])
    rows = [x for n, x in enumerate(rows) if not n or x[0] != rows[n - 1][0]]
    got = {r["doc_id"]: r for r in fingerprints.next_edit_likeness(frame(spark, rows)).collect()}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"] == 1.0) if edited == t else 0 <= r["near_edited"] <= 1
        assert edited != t or r["fingerprint"] == r["edited_fingerprint"]
    assert fingerprints.next_edit_likeness(frame(spark, [])).count() == 0
    one = fingerprints.next_edit_likeness(frame(spark, [(4, "alone in here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    full = fingerprints.next_edit_likeness(frame(spark, corpus))
    assert full.count() == len(corpus)
    assert fingerprints.fingerprints(frame(spark, corpus)).count() == len(corpus)


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(40):
        codes = np.array(rng.choices(range(3), k=rng.randint(0, 90)), dtype=np.uint32)
        h, place = fingerprints.winnow(codes, 4, 6)
        if len(codes) < 4:
            assert len(h) == min(1, len(codes))
            continue
        all_h = fingerprints.rolling(codes, 4)
        key = (all_h >> np.uint64(21)).tolist()
        width = min(6, len(key))
        want = set()
        for s in range(len(key) - width + 1):
            least = min(key[s : s + width])
            want.add(max(j for j in range(s, s + width) if key[j] == least))
        assert set(place.tolist()) == want and (all_h[place] == h).all()


def test_pipeline_stages(spark, corpus, tmp_path):
    """Each stage against a plain version of its decision on its own input."""
    full = frame(spark, [(i, t) for i, t in corpus if i is not None]).dropDuplicates(["doc_id"])
    full.drop("hashes", "component_id", "sequence_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n == 4:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            assert check_packing(docs.collect(), 4096) >= 1
            break
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        if n == 0:
            assert set(after) == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
        if n == 1:
            assert set(after) == set(before)
        if n == 2:
            rows = sorted(before.items())
            assert set(after) == {i for i, _, c in near_brute(rows, 5, 80) if i == c}
        if n == 3:
            rows = sorted(before.items())
            size = {i: w[0] - w[1] for (i, _), w in zip(rows, removed([(t or "").encode() for _, t in rows], 200))}
            assert {i: len((t or "").encode()) for i, t in after.items()} == size  # the fixture is ASCII where it repeats


def test_pipeline_keeps_texts_when_nothing_is_learned(spark):
    rows = [(1, "some words"), (2, None), (3, "123 4"), (4, "\u4e2d\u6587"), (None, "\u00e9")]
    docs = frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.identify(spark, docs, "").collect()} == {rows[0], rows[3], rows[4]}


def test_pipeline_near_dedup_decides_rows(spark):
    """Rows that repeat an id or have none: one row of each group stays, and no other text goes with it."""
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (3, c), (None, d), (None, d), (4, "")]
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect())
    assert got == Counter([(1, a), (2, b), (3, c), (None, d), (4, "")])


def test_near_prefilter_passes_pairs_at_the_limit():
    """Pairs at exactly 0.8 with 45 shingles in all: the estimate lets every one through to the full sets."""
    for seed in (5, 25, 36):  # with pairs whose estimates are far off
        rng = np.random.default_rng(seed)
        for _ in range(500):
            union = np.unique(rng.integers(0, 1 << 63, 45, dtype=np.uint64))
            a, b = near_dedup.minwise(union[:40]), near_dedup.minwise(np.concatenate([union[:36], union[40:]]))
            assert np.sum(a == b) >= near_dedup.agreement(80)
