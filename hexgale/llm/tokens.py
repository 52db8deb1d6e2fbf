"""Token pieces of documents: ids of a public tokenizer, cut into pieces of bounded length."""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hexgale.llm.common import Memo, pick

#: The control characters that Python takes for white space and the tokenizer's pattern does not.
ODD = re.compile("[\x1c-\x1f]")
MEMO = 500_000
#: Words of these characters are parted as the pattern does it, letters, single digits and marks; composing characters and
#: apostrophes, at which it looks further, are left to the tokenizer.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a tokenizer has to do with a text for plain words to be parted here.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTED = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class WordTokens:
    """Ids of a vocabulary whose pattern drops white space: runs between white space are encoded once and memoised.

    New runs of plain characters are parted into pieces, which are memoised as well and cost the vocabulary's merges only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.pieces = Memo(MEMO), Memo(MEMO)
        made = json.loads(self.tokenizer.to_str())
        self.parts = (made["normalizer"] or {}).get("normalizers") == NORMAL and (made["pre_tokenizer"] or {}).get("pretokenizers") == PARTED
        self.added = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or "(?!)")
        marks = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter = {c: marks.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100) if PLAIN.fullmatch(chr(c))}

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in got]

    def _merged(self, piece: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(piece.lower().translate(self.letter))])

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        plain = [w for w in words if self.parts and PLAIN.fullmatch(w) and not self.added.search(w)]
        cut = [PIECE.findall(w) for w in plain]
        flat = [p for ps in cut for p in ps]
        known, young = self.pieces.look(flat), self.pieces.young
        for i, p in enumerate(flat):
            if known[i] is None:
                known[i] = young[p] = young.get(p) or self._merged(p)
        out, at = {}, 0
        for w, ps in zip(plain, cut):
            out[w] = b"".join(known[at : at + len(ps)])
            at += len(ps)
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._encode(rest) if rest else []))
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit values."""
        if ODD.search(text):
            return self._encode([text])[0]
        words = text.split()
        got = self.memo.look(words)
        if None in got:
            young = self.memo.young
            new = list(dict.fromkeys(w for w, known in zip(words, got) if known is None))
            young.update(self._new(new))
            got = [young[w] if known is None else known for w, known in zip(words, got)]
        return b"".join(got)


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its ids followed by ``end_id``; only longer ones are cut. NULL text counts as empty, so it is one piece
    holding ``end_id``. NULL and repeated ids and repeated rows give pieces row by row. A map without a shuffle; memory is
    one batch of texts and a memo of bounded size. ``ids`` carries the 32-bit ids as bytes.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    fields = [rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]
    tail, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches):
        words = word_tokens(path)
        for batch in batches:
            owner, piece, length, crc, kept = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                data = words.ids(value.as_py() or "") + tail
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    owner.append(row)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            out = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array([capacity * n for n in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * keep_ids, names=names)

    return rows.mapInArrow(run, T.StructType(fields))
