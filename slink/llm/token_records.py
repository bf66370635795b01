"""Token ids in length-delimited binary files with masked checksums, and an offset index for shuffled reads.

A file is a row of frames: length (unsigned 64-bit), masked checksum of the length, payload, masked checksum of the
payload (unsigned 32-bit, all little-endian). A payload is doc_id (signed 64-bit), a byte that says if there is one,
the width of an id in bytes, the number of ids (unsigned 32-bit), and the ids. Files hold documents in ascending
doc_id order, file after file; the index, a Parquet table, says where each frame begins.

Each attempt of a task writes files under names of its own, and only the index rows of the attempt that succeeded
are committed, so lost executors and repeated tasks leave files that nothing refers to, and never a torn record.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from slink.llm import arrow
from slink.llm.bpe_fragments import byte_characters, read_spec
from slink.llm.worker import Generations, kept

FILE_BYTES = 64 << 20
PIECE_CHARS = 4 << 20
REMEMBERED, STEMS = 800_000, 400_000  # words and rows of letters that a worker keeps, those that come again the longest
MASK_DELTA = 0xA282EAD8
_LENGTH, _CHECK, _BODY = "<Q", "<I", "<qBBI"
_HEAD_BYTES, _CHECK_BYTES, _BODY_BYTES = 12, 4, 14
_WIDTHS = {2: "<u2", 4: "<u4"}
# White space of other kinds than blanks and line ends, and runs of white space, keep a text out of the word memory.
RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", "\n ", " \n", "\n\n")
_MARK = "\r"
# A blank and letters are one piece, punctuation after them another; letters are told apart only below U+0250.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")


def masked(data: bytes) -> int:
    """Rotated and shifted CRC-32, so that a checksum of data that holds checksums stays telling."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack(_BODY, doc_id or 0, doc_id is not None, width, len(ids) // width) + ids
    length = struct.pack(_LENGTH, len(payload))
    return length + struct.pack(_CHECK, masked(length)) + payload + struct.pack(_CHECK, masked(payload))


def read_frame(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record (doc_id, ids as unsigned 32-bit), None at the end; any damage is an error."""
    head = stream.read(_HEAD_BYTES)
    if not head:
        return None
    if len(head) < _HEAD_BYTES:
        raise ValueError("a record's head is cut off")
    if struct.pack(_CHECK, masked(head[:8])) != head[8:]:
        raise ValueError("a record's length is damaged")
    length = struct.unpack(_LENGTH, head[:8])[0]
    payload, tail = stream.read(length), stream.read(_CHECK_BYTES)
    if len(payload) < length or struct.pack(_CHECK, masked(payload)) != tail:
        raise ValueError("a record's payload is damaged")
    doc_id, known, width, count = struct.unpack_from(_BODY, payload)
    ids = np.frombuffer(payload, _WIDTHS[width], count, _BODY_BYTES).astype("<u4")
    return doc_id if known else None, ids


class Encoder:
    """A tokenizer that remembers the ids of words.

    Its pre-tokenizer begins a new piece at each blank, and makes each line end a piece, unless they are in a run of
    white space. So texts without such runs are encoded word by word, each with the blank or line end before it, and
    each distinct one once per worker; of words that are letters and punctuation each distinct row of letters once.
    Other texts are encoded as they are.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.mark = self.direct([_MARK])[0]
        # The same model for pieces that are rows of byte characters already, with a mark between them.
        self.bytes = byte_characters()
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.Split(self.bytes[ord(_MARK)], "isolated")
        self.known, self.stems, self.tails = Generations(REMEMBERED), Generations(STEMS), Generations(STEMS)

    def direct(self, texts: list[str]) -> list[bytes]:
        kind = _WIDTHS[self.width]
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, tokenizer: Tokenizer, pieces: list[str], mark: str) -> Iterator[bytes]:
        """Ids of pieces, many in one call: between them stands a mark that is in none, and that is a piece of its own."""
        kind = _WIDTHS[self.width]
        number = np.frombuffer(self.mark, kind)[0]
        for start in range(0, len(pieces), 1000):
            joined = mark.join(pieces[start : start + 1000])
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, kind)
            ends = np.flatnonzero(ids == number)
            data = ids.tobytes()
            yield from (
                data[a * self.width : b * self.width]
                for a, b in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True)
            )

    def _of_stems(self, stems: list[str]) -> Iterator[bytes]:
        blank = self.bytes[ord(" ")]
        spelt = [blank + (s if s.isascii() else s.encode().decode("latin-1").translate(self.bytes)) for s in stems]
        return self._marked(self.merger, spelt, self.bytes[ord(_MARK)])

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words, with a blank before each that does not begin with a line end."""
        cut = [w.rstrip(_PUNCTUATION) for w in words]
        plain = [s.isalpha() and (s.isascii() or _LETTERS.fullmatch(s) is not None) for s in cut]
        stems = self.stems.holding(set(compress(cut, plain)), self._of_stems)
        ends = [w[len(s) :] for w, s in zip(words, cut, strict=True)]
        tails = self.tails.holding(set(compress(ends, plain)), self.direct)
        rest = [w if w.startswith("\n") else " " + w for w, p in zip(words, plain, strict=True) if not p]
        others = self._marked(self.tokenizer, rest, _MARK)
        return [stems[s] + tails[e] if p else next(others) for s, e, p in zip(cut, ends, plain, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; equal texts are encoded once."""
        distinct = list(dict.fromkeys(texts))
        cut = [
            None if RARE.search(t) or any(r in t for r in RUNS) else t.replace("\n", " \n").split(" ") for t in distinct
        ]
        known = self.known.holding(set().union(*(words[1:] for words in cut if words)), self.words)
        firsts = self.direct([t if words is None else words[0] for t, words in zip(distinct, cut, strict=True)])
        ids = {
            text: first if words is None else first + b"".join(map(known.__getitem__, words[1:]))
            for text, first, words in zip(distinct, firsts, cut, strict=True)
        }
        return [ids[text] for text in texts]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Encode `docs` (doc_id, text), each with `end_id` appended, into record files and an index below `folder`.

    Rows are written in ascending doc_id order, nulls first; rows of one doc_id by a hash of their text, and equal
    rows in any order. Null and empty texts are the end id alone. Texts of any length are encoded whole; an empty
    table writes an empty index; other columns are ignored, whatever their names.
    """
    spec = read_spec(tokenizer_path)
    shared, version = docs.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    order = ["doc_id", "_h", "_n"]
    # The last key spreads even equal rows; it follows the scan, which is the same when a task runs again.
    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
        .withColumn("_n", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("records", version), lambda: Encoder(shared.value))
        end = np.array([end_id], _WIDTHS[encoder.width]).tobytes()
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(f"{base}/files", recursive=True)
        part, attempt, seq, stream, at = TaskContext.get().partitionId(), uuid.uuid4().hex, -1, None, 0
        names = ["part", "seq", "file", "doc_id", "offset", "n_tokens"]
        try:
            for whole in batches:
                for batch in arrow.pieces(whole, "text", PIECE_CHARS):
                    rows = []
                    encoded = encoder.encode(arrow.strings(batch.column("text")))
                    for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                        if stream is None or at >= FILE_BYTES:
                            if stream is not None:
                                stream.close()
                            seq, at = seq + 1, 0
                            name = f"{part:06d}-{seq:04d}-{attempt}.rec"
                            stream = system.open_output_stream(f"{base}/files/{name}")
                        record = frame(doc_id, ids + end, encoder.width)
                        stream.write(record)
                        rows.append((part, seq, name, doc_id, at, len(ids) // encoder.width + 1))
                        at += len(record)
                    columns = list(zip(*rows, strict=True))
                    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                    )
        finally:
            if stream is not None:
                stream.close()

    schema = "part int, seq int, file string, doc_id long, offset long, n_tokens long"
    placed.mapInArrow(run, schema).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, file, doc_id, offset and n_tokens of every record: what a shuffled reader seeks by."""
    return spark.read.parquet(f"{folder}/index")


def read_at(folder: str, file: str, offsets: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a file at the given offsets, in the given order."""
    system, base = pa.fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/files/{file}") as stream:
        for offset in offsets:
            stream.seek(offset)
            yield read_frame(stream)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every record, read from the files."""
    files = read_index(spark, folder).groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = files.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("file", "base")
    tasks = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        types = [pa.int64()] * 4

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/files/{file}", buffer_size=1 << 20) as stream:
                    rows: list[tuple] = []
                    while (record := read_frame(stream)) is not None:
                        doc_id, ids = record
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    spread = listed.repartition(tasks, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
