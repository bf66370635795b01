"""Alignment of two tokenizers by interval coalescing.

The tokens of both tokenizers are byte intervals of one text. They are sorted by start, the ends are accumulated to
their running maximum, and a group breaks where a start reaches it; inside a group every token of one tokenizer is
linked with every token of the other. How many documents hold an id pair linked is counted over the whole corpus.

Both tokenizers end a token before a blank or a line end that stands alone, so texts without runs of white space are
cut there, and each distinct piece is tokenized and coalesced once per worker; other texts are one piece. Documents
are taken in batches: a batch keeps, for each distinct pair in it, which of its documents hold it. Only the distinct
pairs of a batch are shuffled to be counted, and their counts come back to the batch, so no shuffle grows with the
links, and a pair that every document holds is one row per batch.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slink.llm import arrow
from slink.llm.bpe_fragments import byte_characters, read_spec
from slink.llm.token_records import RARE, RUNS, Encoder
from slink.llm.worker import Generations, kept
from slink.sources.shared import new_path

BATCH_CHARS = 3 << 20
BATCH_DOCS = 65_535
REMEMBERED = 320_000  # pieces; a generation holds more than the distinct ones of a batch
STEMS = 120_000
B_IDS = 1 << 20  # a pair is one number: id of A times this, plus id of B
EXPANDED = 64  # a group with more links than this is linked by its distinct ids

_LINKED = "pairs array<bigint>, held array<int>, docs binary, at binary, times binary"
_SUMS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_KEEP = "_k"


class _Vocabulary:
    """The bytes of all tokens of a tokenizer, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the given tokens in a row."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def coalesce(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every A and every B interval, from 0 in order of place."""
    start, end = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat([0, 1], [len(starts_a), len(starts_b)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.r_[False, start[order][1:] >= reached[:-1]] if len(order) else np.zeros(0, bool)
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(breaks)
    return groups[: len(starts_a)], groups[len(starts_a) :]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that are to stand `counts` times: the row of each copy, and its place among the copies."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def links(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, pair and times of the links of all groups; a large group gives each distinct pair once."""
    n = int(max(group_a[-1] if len(group_a) else -1, group_b[-1] if len(group_b) else -1)) + 1
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    large = in_a * in_b > EXPANDED
    small_a = np.flatnonzero(~large[group_a])
    row, place = _spread(in_b[group_a[small_a]])
    a = small_a[row]
    groups, pairs = [group_a[a]], [ids_a[a] * B_IDS + ids_b[first_b[group_a[a]] + place]]
    times = [np.ones(len(a), np.int64)]
    for g in np.flatnonzero(large).tolist():
        a, count_a = np.unique(ids_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
        b, count_b = np.unique(ids_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        pairs.append((a[:, None] * B_IDS + b[None, :]).ravel())
        times.append((count_a[:, None] * count_b[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    group, pair, many = np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(group, kind="stable")
    return group[order], pair[order], many[order]


class Aligner:
    """Tokenizers A (a JSON file's text) and B (a sentencepiece model's bytes), and what they gave for pieces so far.

    A piece's value is (tokens of A, of B, groups, links, groups as text, pairs and times); groups as text is None
    where the tokens do not spell the piece.
    """

    def __init__(self, spec_a: str, model_b: bytes):
        self.a = Encoder(spec_a)
        self.a.tokenizer.encode_special_tokens = True
        self.a.stems = Generations(STEMS)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        byte_of = {c: b for b, c in byte_characters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelt[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.spelt_a = _Vocabulary(spelt)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spelt_b = _Vocabulary(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )
        self.blank = self.b.piece_to_id("▁")
        # Pieces may be cut at blanks and line ends only if no token of B goes over them.
        self.cuts = not any("▁" in p.lstrip("▁") or p.startswith("▁▁") and p.strip("▁") or "\n" in p for p in pieces)
        # Each id as text with what follows it: another one of its side, the other side, the next group.
        self.ids = max(len(spelt), len(pieces))
        self.numbers = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self.known = Generations(REMEMBERED)

    def pieces(self, text: str) -> list[str]:
        """The text with a blank before it, in pieces, each beginning with a blank or a line end."""
        if not text:
            return []
        whole = " " + text
        if not self.cuts or text.endswith(" ") or RARE.search(text) or any(r in whole for r in RUNS):
            return [whole]
        return [w if w[:1] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]

    def _ids_a(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all pieces in a row, and how many each has."""
        kind = f"<u{self.a.width}"
        words = [p[1:] if p[0] == " " else p for p in pieces]
        # The word encoder puts a blank before what does not begin with a line end; runs of white space it does not take.
        rare = RARE.search("".join(words))
        plain = [
            i
            for i, (p, w) in enumerate(zip(pieces, words, strict=True))
            if len(w) < 200 and not (rare and RARE.search(w)) and " " not in w and "\n" not in p[1:]
        ]
        out: list = [None] * len(pieces)
        for i, ids in zip(plain, self.a.words([words[i] for i in plain]), strict=True):
            out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.a.direct([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return np.frombuffer(b"".join(out), kind).astype(np.int64), [len(ids) // self.a.width for ids in out]

    def _ids_b(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """B puts a blank before what it is given: where the piece has its own it is left off, else that blank's token goes."""
        out = []
        for piece, ids in zip(pieces, self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1), strict=True):
            if piece[0] != " ":
                if not ids or ids[0] != self.blank:
                    raise ValueError("a piece without a blank before it is not encoded apart")
                ids = ids[1:]
            out.append(ids)
        return np.fromiter(chain.from_iterable(out), np.int64), list(map(len, out))

    def coalesced(self, pieces: list[str]) -> list[tuple]:
        """Values of some pieces, all coalesced at once."""
        if not pieces:
            return []
        data = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in data], np.int64)
        sides = []
        valid = np.ones(len(pieces), bool)
        for found, spelt in ((self._ids_a(pieces), self.spelt_a), (self._ids_b(pieces), self.spelt_b)):
            ids, counts = found
            piece = np.repeat(np.arange(len(pieces)), counts)
            valid &= np.bincount(piece, spelt.sizes[ids], len(pieces)).astype(np.int64) == sizes
            sides.append((piece, ids, spelt))
        flat = np.frombuffer(b"".join(d for d, v in zip(data, valid, strict=True) if v), np.uint8)
        byte_piece = np.repeat(np.flatnonzero(valid), sizes[valid])
        same = valid.copy()
        for piece, ids, spelt in sides:
            same[byte_piece[spelt.joined(ids[valid[piece]]) != flat]] = False
        (piece_a, a, _), (piece_b, b, _) = ((p[k], i[k], s) for p, i, s in sides for k in [same[p]])
        ends_a, ends_b = np.cumsum(self.spelt_a.sizes[a]), np.cumsum(self.spelt_b.sizes[b])
        group_a, group_b = coalesce(ends_a - self.spelt_a.sizes[a], ends_a, ends_b - self.spelt_b.sizes[b], ends_b)
        group, pair, times = links(a, group_a, b, group_b)
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        first_a, first_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
        piece_of = piece_a[first_a[:-1]] if n else np.zeros(0, np.int64)
        every = np.arange(len(pieces) + 1)
        groups_at = np.searchsorted(piece_of, every).tolist()
        links_at = np.searchsorted(piece_of[group] if n else group, every).tolist()
        n_a, n_b = np.bincount(piece_a, minlength=len(pieces)).tolist(), np.bincount(piece_b, minlength=len(pieces)).tolist()
        n_links = np.bincount(piece_of[group], times, len(pieces)).astype(np.int64).tolist() if n else [0] * len(pieces)
        both = np.stack([pair, times], axis=1).tobytes()
        spelt = self._spelt(a, b, first_a, first_b)
        tokens_at = (first_a + first_b)[groups_at].tolist()
        out = []
        for i in range(len(pieces)):
            if not same[i]:
                out.append((0, 0, 0, 0, None, b""))
                continue
            text = "".join(spelt[tokens_at[i] : tokens_at[i + 1]])[:-1]
            some = both[16 * links_at[i] : 16 * links_at[i + 1]]
            out.append((n_a[i], n_b[i], groups_at[i + 1] - groups_at[i], n_links[i], text, some))
        return out

    def _spelt(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[str]:
        """Of all tokens, group by group and in a group A before B, the number with the mark that follows it."""
        in_a, in_b = np.diff(first_a), np.diff(first_b)
        if not (in_a.all() and in_b.all()):
            raise ValueError("a group without tokens of one side")
        marked = np.empty(len(a) + len(b), np.int64)
        of_a, of_b = np.arange(len(a)) + np.repeat(first_b[:-1], in_a), np.arange(len(b)) + np.repeat(first_a[1:], in_b)
        marked[of_a], marked[of_b] = a, b
        marked[of_a[first_a[1:] - 1]] += self.ids
        marked[of_b[first_b[1:] - 1]] += 2 * self.ids
        return list(map(self.numbers.__getitem__, marked.tolist()))

    def batch(self, texts: list[str]) -> tuple[list[tuple], tuple]:
        """Sums of each text, and the distinct pairs of all of them with the texts that hold them."""
        cut = [self.pieces(t) for t in texts]
        distinct = set(chain.from_iterable(cut))
        known = self.known.holding(distinct, self._by_size)
        index = {piece: i for i, piece in enumerate(distinct)}
        values = [known[piece] for piece in index]
        numbers = np.array([v[:4] for v in values], np.int64).reshape(-1, 4)
        spelt = [v[4] for v in values]
        sums, rows, doc_of = [], [], []
        for doc, pieces in enumerate(cut):
            at = list(map(index.__getitem__, pieces))
            parts = list(map(spelt.__getitem__, at))
            if not at or None in parts:
                sums.append((0, 0, 0, 0, ""))
                continue
            rows.append(np.array(at, np.int64))
            doc_of.append(doc)
            sums.append((*numbers[rows[-1]].sum(axis=0).tolist(), hashlib.sha256(";".join(parts).encode()).hexdigest()))
        return sums, self._held([v[5] for v in values], rows, doc_of, len(texts))

    def _by_size(self, pieces: list[str]) -> Iterator[tuple]:
        """Values of the pieces in their order, of about a million characters at once."""
        some, chars = [], 0
        for piece in pieces:
            some.append(piece)
            chars += len(piece)
            if chars > 1 << 20:
                yield from self.coalesced(some)
                some, chars = [], 0
        yield from self.coalesced(some)

    @staticmethod
    def _held(data: list[bytes], rows: list[np.ndarray], doc_of: list[int], n_docs: int) -> tuple:
        """Distinct pairs (sorted), how many texts hold each, which ones, and where a text holds it more than once."""
        both = np.frombuffer(b"".join(data), np.int64).reshape(-1, 2)
        sizes = np.array([len(d) // 16 for d in data], np.int64)
        starts = np.cumsum(sizes) - sizes
        pairs, number = np.unique(both[:, 0], return_inverse=True)
        if not rows:
            return pairs[:0], np.zeros(0, np.int32), np.zeros(0, "<u2"), np.zeros(0, "<i4"), np.zeros(0, "<i8")
        piece = np.concatenate(rows)
        doc = np.repeat(np.array(doc_of, np.int64), [len(r) for r in rows])
        row, place = _spread(sizes[piece])
        at = starts[piece][row] + place
        key = number[at] * n_docs + doc[row]
        more = np.flatnonzero(both[:, 1] > 1)
        extra = np.isin(at, more) if len(more) else np.zeros(0, bool)
        over, over_times = (key[extra], both[at[extra], 1] - 1) if len(more) else (key[:0], key[:0])
        del row, place, at
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(key)])
        key = key[first]
        np.add.at(times, np.searchsorted(key, over), over_times)
        held = np.bincount(key // n_docs, minlength=len(pairs)).astype(np.int32)
        many = np.flatnonzero(times > 1)
        used = held > 0
        return pairs[used], held[used], (key % n_docs).astype("<u2"), many.astype("<i4"), times[many].astype("<i8")


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without looking for cycles among the many small values that are made, which have none."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about `BATCH_CHARS` characters each, a longer row alone."""
    held, chars, rows = [], 0, 0
    for whole in batches:
        for batch in arrow.pieces(whole, "_text"):
            size = pa.compute.sum(pa.compute.binary_length(batch.column("_text"))).as_py() or 0
            if held and (chars + size > BATCH_CHARS or rows + batch.num_rows > BATCH_DOCS):
                yield pa.Table.from_batches(held)
                held, chars, rows = [], 0, 0
            held.append(batch)
            chars, rows = chars + size, rows + batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def groups(text: str | None, aligner: Aligner) -> list[tuple[list[int], list[int]]]:
    """The groups of one text as (ids of A, ids of B); none where the tokens do not spell it."""
    values = aligner.coalesced(aligner.pieces(text or ""))
    if any(v[4] is None for v in values):
        return []
    sides = (group.split("|") for v in values for group in v[4].split(";"))
    return [tuple([int(i) for i in side.split(",")] for side in pair) for pair in sides]


class Alignment:
    """What aligning all rows of `docs` (text, and the `keep` columns) gave, written to the shared folder.

    Defined cases: null and empty texts, and texts that the tokens of one side do not spell, have no tokens: zeros
    and the empty string. Texts of any length are aligned whole; repeated rows each count as a document; an empty
    table gives no rows; other columns are ignored, whatever their names. The tokenizer files are read where this is
    called and sent to the tasks (their size is that of the vocabularies).
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, keep: list[str]):
        spark = docs.sparkSession
        self.spark, self.keep = spark, keep
        spec, model = read_spec(path_a), read_model(path_b)
        shared, version = spark.sparkContext.broadcast((spec, model)), zlib.crc32(spec.encode() + model)
        slim = docs.select(F.struct(*keep).alias(_KEEP), F.col("text").alias("_text"))
        kept_type = slim.schema[_KEEP].dataType.simpleString()
        schema = f"batch long, ord int, {_KEEP} {kept_type}, {_SUMS}, {_LINKED}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = kept(("aligner", version), lambda: Aligner(*shared.value))
            base = TaskContext.get().partitionId() << 24
            fields = [pa.field("batch", pa.int64()), pa.field("ord", pa.int32()), None]
            fields += [pa.field(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            fields += [pa.field("groups_sha256", pa.string()), pa.field("pairs", pa.list_(pa.int64()))]
            fields += [pa.field("held", pa.list_(pa.int32()))] + [pa.field(n, pa.binary()) for n in ("docs", "at", "times")]
            for seq, table in enumerate(_batches(batches)):
                n = table.num_rows
                fields[2] = table.schema.field(_KEEP)
                with _uncollected():
                    sums, (pairs, held, docs_, at, times) = aligner.batch(arrow.strings(table.column("_text")))
                columns = [pa.array([base + seq] * n, pa.int64()), pa.array(range(n), pa.int32()), table.column(_KEEP).combine_chunks()]
                columns += [pa.array(c, f.type) for c, f in zip(zip(*sums, strict=True), fields[3:8], strict=True)]
                columns += [pa.nulls(n, f.type) for f in fields[8:]]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                one = [pa.array([base + seq]), pa.array([-1], pa.int32()), *(pa.nulls(1, f.type) for f in fields[2:8])]
                one += [pa.array([c], f.type) for c, f in zip((pairs, held), fields[8:10], strict=True)]
                one += [pa.array([c.tobytes()], pa.binary()) for c in (docs_, at, times)]
                yield pa.RecordBatch.from_arrays(one, schema=pa.schema(fields))

        path = new_path(spark, "alignment")
        slim.mapInArrow(run, schema).write.parquet(path)
        self.rows = spark.read.parquet(path)
        by_batch = self.rows.filter("ord = -1").select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("i", "p"))
        self._of_batch = by_batch.select("batch", "i", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
        path = new_path(spark, "pair-counts")
        self._of_batch.groupBy("pair").agg(F.sum("held").alias("n_docs")).write.parquet(path)
        self._counts = spark.read.parquet(path)

    def pairs(self) -> DataFrame:
        """a_id, b_id, n_docs (documents that hold them linked) and best (no other B id is linked with A's id in more)."""
        a = F.floor(F.col("pair") / B_IDS).cast("int")
        numbered = self._counts.withColumn("a_id", a)
        # One row per id of A, so never more than its vocabulary.
        most = F.broadcast(numbered.groupBy("a_id").agg(F.max("n_docs").alias("most")))
        return numbered.join(most, "a_id").select(
            "pair", "a_id", (F.col("pair") % B_IDS).cast("int").alias("b_id"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best")
        )

    def documents(self) -> DataFrame:
        """`keep`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
        counted = self._of_batch.select("batch", "i", "pair").join(self.pairs(), "pair")
        packed = counted.select(F.col("batch").alias("of"), "i", (F.col("n_docs") * 2 + F.col("best").cast("int")).alias("v"))
        kept_field = self.rows.schema[_KEEP]
        schema = f"{_KEEP} {kept_field.dataType.simpleString()}, {_SUMS}, n_best long, count_sum long"
        names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

        def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
            ords = rows.column("ord").to_numpy()
            docs = rows.filter(pa.array(ords >= 0))
            one = rows.filter(pa.array(ords < 0)).select(["held", "docs", "at", "times"]).to_pylist()[0]
            held, doc = np.array(one["held"], np.int64), np.frombuffer(one["docs"], "<u2")
            value = np.zeros(len(held), np.int64)
            value[counts.column("i").to_numpy()] = counts.column("v").to_numpy()
            times = np.ones(len(doc), np.int64)
            times[np.frombuffer(one["at"], "<i4")] = np.frombuffer(one["times"], "<i8")
            of_link = np.repeat(value, held)
            n = docs.num_rows
            n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, doc, times * (of_link & 1))
            np.add.at(count_sum, doc, times * (of_link >> 1))
            place = docs.column("ord").to_numpy()
            columns = [docs.column(_KEEP), *(docs.column(c) for c in names), pa.array(n_best[place]), pa.array(count_sum[place])]
            return pa.table(columns, names=[_KEEP, *names, "n_best", "count_sum"])

        left = self.rows.select("batch", "ord", _KEEP, *names, "held", "docs", "at", "times").groupBy("batch")
        return left.cogroup(packed.groupBy("of")).applyInArrow(run, schema).select(f"{_KEEP}.*", *names, "n_best", "count_sum")
