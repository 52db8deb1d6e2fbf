"""Nearest vectors, periodic runs and Merkle proofs against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexgale.llm import common, hamming_index, merkle, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx string, tree string, n string"


def docs_frame(spark, rows, parts: int = 3):
    full = [(*r, "leaf", "idx", "tree", "n") for r in rows]
    return common.cut_lineage(spark.createDataFrame(full, DOCS).repartition(parts))


# Nearest vectors


def brute_nearest(rows: dict[int, list[float]], k: int, every: int) -> dict[int, list[tuple[int, float]]]:
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], dtype=np.float64)
    out = {}
    for q in ids[ids % every == 0].tolist():
        c = hamming_index.cosines(np.broadcast_to(np.array(rows[q], dtype=np.float64), x.shape), x)
        order = [j for j in np.lexsort((ids, -c)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(c[j])) for j in order]
    return out


def found_nearest(df) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got: dict, expected: dict) -> float:
    pairs = [(q, i) for q, near in expected.items() for i, _ in near]
    return sum(i in {j for j, _ in got[q]} for q, i in pairs) / len(pairs)


@pytest.mark.parametrize("block", [200, hamming_index.BLOCK])
def test_nearest_vectors(spark, block):
    """Noise and clusters, copies, scaled copies, odd vectors, NULL and repeated ids, an extra column."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate((rng.normal(size=(500, 24)), centres[rng.integers(0, 12, 700)] + 0.2 * rng.normal(size=(700, 24)))).astype(np.float32).astype(float)
    rows = {7 * i - 700: v.tolist() for i, v in enumerate(x)}
    hot = rows[7 * 900 - 700]
    rows |= {50 * (10_000 + i): hot for i in range(300)}  # one vector in a fifth of the rows
    rows |= {50 * (20_000 + i): [v * 4 for v in rows[7 * i - 700]] for i in range(3)}
    odd = [(1, None), (3, []), (4, [0.0] * 24), (5, [float("nan")] * 24), (6, [float("inf")] * 24), (8, [1.0] * 23), (9, [None] * 24), (None, [1.0] * 24), (50, [None, 1.0]), (-700, rows[-700])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in [*rows.items(), *odd]], "vec_id long, embedding array<double>, code string")
    got = found_nearest(hamming_index.nearest_vectors(frame, block=block))
    expected = brute_nearest(rows, 5, 50)
    assert got.keys() == expected.keys()
    assert all(len(n) == 5 for n in got.values())
    assert recall(got, expected) >= 0.95
    # The hot vector and scaled copies are found without fail, ties by id.
    for q in list(expected):
        if q >= 500_000 and q < 1_000_000:
            assert got[q] == expected[q]
        if q >= 1_000_000:
            assert got[q][0] == expected[q][0]
    scores = {(q, i): s for q, near in got.items() for i, s in near}
    for (q, i), s in scores.items():
        assert s == hamming_index.cosines(np.array([rows[q]]), np.array([rows[i]]))[0]


def test_nearest_vectors_small_tables(spark):
    schema = "vec_id int, embedding array<float>"
    assert hamming_index.nearest_vectors(spark.createDataFrame([], schema)).count() == 0
    assert hamming_index.nearest_vectors(spark.createDataFrame([(50, None)], schema)).count() == 0
    few = {0: [1.0, 0.0], 50: [1.0, 1.0], 51: [1.0, 0.0], 53: [-1.0, 0.5]}
    got = found_nearest(hamming_index.nearest_vectors(spark.createDataFrame(list(few.items()), schema)))
    assert got == brute_nearest(few, 5, 50)
    assert found_nearest(hamming_index.nearest_vectors(spark.createDataFrame([(0, [1.0])], schema))) == {}


def test_pigeonhole_thresholds():
    """Every code within the radius differs in some substring by no more than its threshold."""
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    b = np.where(rng.random(20_000) < 0.5, a ^ (b & np.roll(b, 1) & np.roll(a, 2)), b)
    apart = np.bitwise_count(a ^ b).astype(np.int64)
    parts = np.stack([np.bitwise_count(((a ^ b) >> np.uint64(s)) & np.uint64(65535)) for s in (0, 16, 32, 48)], axis=1)
    for radius in range(33):
        most = hamming_index.thresholds(np.full(len(a), radius), 4)
        assert (parts <= most).any(axis=1)[apart <= radius].all()


# Periodic runs


def lyndon(w: list[int]) -> list[int]:
    return [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j))) for i in range(len(w))]


def brute_runs(w: list, least: int, times: int) -> list[tuple[int, int, int]]:
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(least, times * p) and not any(all(w[x] == w[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random, words: str = "abcd") -> list[str]:
    out: list[str] = []
    while rng.random() < 0.85:
        unit = rng.choices(words, k=rng.randint(1, 7))
        out += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
    return out


def test_lyndon_array():
    rng = random.Random(4)
    for _ in range(400):
        w = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 26))]
        w += w[: len(w) // 2] * rng.randint(0, 2)
        assert runs.lyndon_array(w) == lyndon(w)


def test_long_periodic_text_is_linear():
    """A hundred thousand equal words, and a long period: no step that grows with the square."""
    for period in (1, 2, 30_000):
        word = np.arange(100_000) % period
        start, length, got = runs.find_runs(word, np.zeros(len(word), dtype=np.int64))
        assert list(zip(start.tolist(), length.tolist(), got.tolist())) == [(0, 100_000, period)]


def test_periodic_runs(spark):
    rng = random.Random(6)
    texts = [" ".join(repetitive(rng)) for _ in range(60)] + [" ".join(repetitive(rng, "abcdefghijkl") + [f"w{i}" for i in range(40)] + repetitive(rng)) for _ in range(30)]
    texts += [None, "", " \n\t ", "x", "é́   y z " * 20, "a\x1cb " * 30, "one two\x0bthree\n" * 9, "ab " * 3000, " ".join(map(str, range(3000)))]
    rows = [(3 * i - 9, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a b " * 40, "en", "s", 0), (9, "a b c " * 30, "en", "s", 0)]
    expected = []
    for key, text, *_ in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words, 24, 3)
        gone = {i for s, size, p in found for i in range(s + p, s + size)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{size},{p}\n" for s, size, p in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        expected.append((key, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = runs.run_digests(docs_frame(spark, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    # The operator itself, without the edit, and in lots of a few words.
    plain = runs.periodic_runs(docs_frame(spark, rows), lot=50).where("doc_id = 0").collect()
    assert [tuple(map(tuple, r["runs"])) for r in plain] == [tuple(brute_runs(texts[3].split(), 24, 3))] * 3
    assert runs.run_digests(docs_frame(spark, [])).count() == 0


# Merkle proofs


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in tree[:-1]:
        left = i - i % 2
        out.append((nodes[left:i], nodes[i + 1 : left + 2]))
        i //= 2
    return out


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(*map(told, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in of[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            steps = path(trees[x], i) + path(top, g)
            folded = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in steps:
                folded = sha(*before, folded, *after)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(*(s for b, a in steps for s in b + a)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [(1,), (3, 1), (700, 64, 65, 1, 2)])
def test_merkle(spark, sizes):
    """One hot language, languages of one row, odd sizes at every level, NULL anywhere, repeated rows."""
    rng = random.Random(sum(sizes))
    names = [None, "en", "", "é", "zz"]
    rows = []
    for lang, n in zip(names, sizes):
        for _ in range(n):
            rows.append((rng.randint(-5, 2000), rng.choice([None, "", "ä\n", "text " * rng.randint(1, 300)]), lang, rng.choice([None, "s"]), rng.choice([None, 0, 9, 99])))
    if len(rows) > 20:
        rows[5:9] = [rows[4]] * 3 + [(None, "t", rows[4][2], "s", 1)]
    got = merkle.tamper_check(docs_frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_manifest(rows), key=str)


def test_merkle_general(spark):
    assert merkle.tamper_check(docs_frame(spark, [])).count() == 0
    rows = [(i, f"t{i % 5}", "en", f"s{i % 3}", 2**63 - 1) for i in range(40)]
    frame = docs_frame(spark, rows)
    assert not merkle.merkle_proofs(frame, F.lit(True)).where("tampered_leaf = leaf").count()
    by_source = merkle.merkle_proofs(frame, fields=("text", "source"), group="source").withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    assert by_source.where("folded = root").count() == 40 and by_source.select("subroot").distinct().count() == 3
    # The order of input rows and their partitions change nothing.
    again = merkle.merkle_proofs(frame.orderBy(F.desc("doc_id")).repartition(5), fields=("text", "source"), group="source")
    assert again.select("root").distinct().collect() == by_source.select("root").distinct().collect()
