"""Byte-pair encoding and decoding by forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains can never be merged over, so a text may be cut between
them for certain. Cut fragments are encoded independently (and memoised, as fragments repeat), their ids concatenated.
The words of the library's own splitting pattern are boundaries as well and are found inside the fragments.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hexgale.llm.common import Memo, pick

#: Unicode white space, and the word pattern of this vocabulary family.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Fragments and words kept per worker, twice: bounds its memory.
MEMO, PARTS = 600_000, 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256 on."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.id_of_byte = [vocab[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (bytes(alphabet[c] for c in side) for side in (left, right))
            self.rank[vocab[a], vocab[b]] = n
            self.merged.append(vocab[a + b])
        inside = bytearray(65536)
        for token in vocab:
            if token.decode("utf-8", "ignore") in self.special:
                continue
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = 1
        self.inside = inside
        self.word = regex.compile(WORD)
        # In this pattern a blank behind anything but white space starts a new word. Only where a blank stands between other
        # white space does the word depend on the whole run; such texts are not cut at blanks.
        self.run = regex.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.memo, self.parts = Memo(MEMO), Memo(PARTS)

    def _merge(self, fragment: bytes) -> list[int]:
        """Apply merges in rank order, leftmost first, to a fragment without forced boundaries."""
        ids = [self.id_of_byte[b] for b in fragment]
        get, none = self.rank.get, len(self.merged)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i] = self.merged[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def cuts(self, data: bytes) -> list[bytes]:
        """The fragments of ``data`` between its forced boundaries."""
        inside, start, out = self.inside, 0, []
        for i in range(1, len(data)):
            if not inside[data[i - 1] << 8 | data[i]]:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def fragment(self, text: str) -> tuple[str, int, str]:
        """Ids as decimals joined by commas, their number and the text they decode to."""
        ids: list[int] = []
        words = self.word.findall(text)
        for word, known in zip(words, self.parts.look(words)):
            if known is None:
                known = self.parts.young[word] = tuple(i for part in self.cuts(word.encode()) for i in self._merge(part))
            ids += known
        # The bytes of whole characters came in, so the bytes of the ids are whole characters again.
        plain = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return ",".join(map(str, ids)), len(ids), text if plain == text else plain

    def _section(self, text: str, out: list[tuple[str, int, str]]) -> None:
        if not self.run.search(text):
            head, *rest = text.split(" ")
            keys = [head] if head else []
            keys += [" " + x for x in rest]
        else:
            keys = self.word.findall(text)
        got = self.memo.look(keys)
        if None in got:
            young = self.memo.young
            for i, key in enumerate(keys):
                if got[i] is None:
                    found = young.get(key) or self.fragment(key)
                    if len(key) <= 64:
                        young[key] = found
                    got[i] = found
        out += got

    def encode(self, text: str) -> tuple[str, int, str]:
        out: list[tuple[str, int, str]] = []
        at = 0
        for hit in self.split_special.finditer(text) if self.split_special else ():
            if hit.start() > at:
                self._section(text[at : hit.start()], out)
            i = self.special[hit[0]]
            out.append((str(i), 1, hit[0]))
            at = hit.end()
        if at < len(text):
            self._section(text[at:], out)
        if not out:
            return "", 0, ""
        ids, counts, data = zip(*out)
        return ",".join(ids), sum(counts), "".join(data)

    def ids(self, text: str) -> list[int]:
        joined = self.encode(text)[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and file; its memo outlives a task."""
    return ForcedBoundaryBPE(path)


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    A map over rows without a shuffle; memory is one batch of texts and a memo of bounded size. NULL text counts as empty
    (no ids; hashes of the empty string). NULL and repeated ids, repeated rows and empty tables pass through row by row;
    other columns are left out. Very long texts and white space of any kind give the library's own ids. ``path`` is read
    on the executors, where the vocabulary package is installed as well.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            counts, shas, decoded_shas, ids, decoded = [], [], [], [], []
            for value in batch.column(1):
                joined, n, plain = bpe.encode(value.as_py() or "")
                counts.append(n)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_shas.append(hashlib.sha256(plain.encode()).hexdigest())
                if keep_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                    decoded.append(plain)
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
            if keep_ids:
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
