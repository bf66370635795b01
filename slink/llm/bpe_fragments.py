"""Byte-pair encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand together in no vocabulary token can never be merged, so between them there is a
certain cut. Words are cut there, the fragments are encoded independently (each distinct one once per worker) and
concatenated. A fragment that ends its word is encoded with the end-of-word mark, the others without it.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from slink.llm import arrow
from slink.llm.worker import kept

REMEMBERED = 400_000  # distinct words that a worker keeps

# The word pattern of the tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Below U+0250 composition changes nothing and letters change case one by one, but for U+0130; white space there is
# what str.split takes, but for 1C-1F.
_UNCOMMON = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in token strings: itself, or the next one from U+0100 on."""
    out, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out[byte] = chr(byte)
        else:
            out[byte], spare = chr(spare), spare + 1
    return out


class FragmentEncoder:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        self.tokenizer = Tokenizer.from_str(spec)
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix)
        self.inner = models.BPE(model["vocab"], merges)
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.added = added
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in added.items()}
        self.together = {
            token[i : i + 2]
            for whole in model["vocab"]
            for token in [whole.removesuffix(self.suffix) if self.suffix else whole]
            for i in range(len(token) - 1)
        }
        self.bytes = byte_characters()
        self.word = regex.compile(WORD_PATTERN)
        self.known: dict[str, bytes] = {}
        self.fragments: dict[tuple[str, bool], bytes] = {}

    def cuts(self, word: str) -> list[str]:
        """Fragments of a word of byte characters between its forced boundaries."""
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.together]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def encode_word(self, word: str) -> bytes:
        """Ids (unsigned 32-bit, little-endian) of a word of byte characters."""
        fragments = self.cuts(word)
        out = []
        for i, fragment in enumerate(fragments):
            key = fragment, i == len(fragments) - 1
            ids = self.fragments.get(key)
            if ids is None:
                model = self.last if key[1] else self.inner
                ids = np.array([t.id for t in model.tokenize(fragment)], "<u4").tobytes()
                if len(self.fragments) > REMEMBERED:
                    self.fragments.clear()
                self.fragments[key] = ids
            out.append(ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of lower-case text without white space."""
        ids = b"".join(
            self.encode_word(piece.encode().decode("latin-1").translate(self.bytes)) for piece in self.word.findall(chunk)
        )
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(chunk) < 64:
            self.known[chunk] = ids
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        if _UNCOMMON.search(text):
            normal = self.tokenizer.normalizer.normalize_str(text)
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                yield self.encode_word(piece)
            return
        known = self.known
        for chunk in text.lower().split():
            ids = known.get(chunk)
            yield self._chunk(chunk) if ids is None else ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text; the strings of added tokens are those tokens."""
        if "<|" not in text:
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [*self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, *self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks, as for a tokenizer file without a decoder; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, ids: str | None = None) -> DataFrame:
    """`keep` columns, n_tokens and the digests of ids and decoded text of each row of `docs` (text).

    With `ids` the token ids come along as an array under that name. Null and empty texts have no tokens; texts of
    any length are encoded whole; repeated rows encode alike; other columns are carried or ignored as `keep` says.
    The file is read where this is called and sent to the tasks (its size is that of the vocabulary).
    """
    keep = keep or []
    slim = docs.select(*keep, F.col("text").alias("_text"))
    shown = [F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    more = [F.lit(None).cast("array<int>").alias(ids)] if ids else []
    schema = slim.select(*keep, *shown, *more).schema
    spec = read_spec(tokenizer_path)
    shared, version = docs.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("fragments", version), lambda: FragmentEncoder(shared.value))
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                found = [encoder.encode(text) for text in arrow.strings(batch.column("_text"))]
                decoded = (encoder.decode(f).encode() for f in found)
                columns = [batch.column(k) for k in keep]
                columns += [
                    pa.array([len(f) // 4 for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in found], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(f, "<i4") for f in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
