"""Scores of questions and schema elements, folded while an element's documents pass the questions that a task holds.

Documents pass element by element, a table's own before those of its columns and values, so however many an element
has only its lowest score per question and index is held. Of indexes with more documents than a question keeps of
them (`over`) only documents up to the last kept hit count (`search.cut_points`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators.block_stream import Kernel
from slink.operators.search import NO_VECTOR, ROWS_OUT, SOURCE, rounded, source_of, unit_vectors

ORDER = [SOURCE, "table_id", "column_id", "value", "index"]
INDEXES = len(fixed.ALL_INDEXES)
TABLE_SLOTS = len(fixed.TABLE_SCORES)
# Questions whose scores with a block of documents stand side by side.
LINES_AT_ONCE = 64
# Scores that differ from the last kept one by less are computed again as that one was.
NEAR = 1e-11

Key = tuple  # data source, table_id, column_id, value


def numbered_documents(documents: DataFrame) -> DataFrame:
    """The columns that the kernels take, the index as its number; those of no known index have the next number."""
    index = F.lit(INDEXES)
    for i, name in enumerate(fixed.ALL_INDEXES):
        index = F.when(F.col("index_name") == name, i).otherwise(index)
    element = [F.col(c).cast(t).alias(c) for c, t in (("table_id", "long"), ("column_id", "long"), ("value", "string"))]
    taken = documents.select(source_of(documents), index.cast("int").alias("index"), F.col("vec_id").cast("long").alias("vec_id"), *element, "embedding")
    return taken.filter(F.col(SOURCE).isNotNull() & F.col("table_id").isNotNull())


class _Documents:
    """A stretch of documents, in the order of `ORDER`."""

    def __init__(self, block: pa.Table, width: int, over: list[int]):
        self.units, self.null = unit_vectors(block["embedding"], width)
        self.across = np.ascontiguousarray(self.units.T)
        self.finite = bool(np.isfinite(self.units).all())
        self.index, self.vec_ids = block["index"].to_numpy(), block["vec_id"].to_numpy()
        place = np.full(INDEXES + 1, len(over))
        place[over] = np.arange(len(over))
        self.cut = place[self.index]
        self.free = self.cut == len(over)
        columns = [block[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ORDER[:4]]
        changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(self.index) > 1 else np.zeros(0, bool)
        self.elements = np.flatnonzero(np.r_[True, changes])
        self.slots = np.flatnonzero(np.r_[True, changes | (self.index[1:] != self.index[:-1])])
        first = block.select(ORDER[:4]).take(pa.array(self.elements))
        self.keys: list[Key] = list(zip(*(first[c].to_pylist() for c in ORDER[:4]), strict=True))

    def part(self, start: int, end: int) -> _Documents:
        """The documents of one element."""
        some = object.__new__(_Documents)
        some.units, some.across, some.finite = self.units[start:end], self.across[:, start:end], self.finite
        some.null, some.index, some.vec_ids, some.cut, some.free = (x[start:end] for x in (self.null, self.index, self.vec_ids, self.cut, self.free))
        some.elements, some.slots = np.zeros(1, int), np.flatnonzero(np.r_[True, some.index[1:] != some.index[:-1]])
        return some


class _Asked:
    """The questions of a strip, with the last hit that each keeps of the indexes in `over`."""

    def __init__(self, questions: pa.Table, over: list[int]):
        self.ids, self.sources, self.over = questions["question_id"].to_numpy(), questions[SOURCE].to_numpy(), over
        self.units, self.null = unit_vectors(questions["embedding"])
        self.finite = bool(np.isfinite(self.units).all())
        # The last place is for documents of all other indexes, which are kept.
        self.last, self.last_id = np.full((len(self.ids), len(over) + 1), -np.inf), np.full((len(self.ids), len(over) + 1), NO_VECTOR)
        for into, name in ((self.last, "cut_scores"), (self.last_id, "cut_ids")) if over else ():
            lists = questions[name].combine_chunks()
            into[lists.is_valid().to_numpy(zero_copy_only=False), :-1] = lists.flatten().to_numpy().reshape(-1, len(over))
        self.held = np.zeros(0)

    def lows(self, lines: np.ndarray, d: _Documents) -> tuple[np.ndarray, np.ndarray]:
        """Of each question and slot the lowest kept score, inf where there is none, and whether a kept one is no number."""
        q, n = self.units[lines], len(d.index)
        if self.held.size < len(q) * n:
            self.held = np.zeros(len(q) * n)
        scores = np.matmul(q, d.across, out=self.held[: len(q) * n].reshape(len(q), n))
        out = None
        if not d.free.all():
            last = self.last[lines]
            out = scores < np.take(last - NEAR, d.cut, axis=1)
            line, place = np.nonzero(~out & (scores <= np.take(last + NEAR, d.cut, axis=1)))
            if len(line):
                at = d.cut[place]
                again = rounded(np.einsum("ij,ij->i", q[line], d.units[place]))
                worse = (again < last[line, at]) | (again == last[line, at]) & (d.vec_ids[place] > self.last_id[lines[line], at])
                out[line[worse], place[worse]] = True
        if self.finite and d.finite:
            none = np.zeros((len(q), len(d.slots)), bool)
        else:
            no_number = np.isnan(scores)
            kept = no_number & ~(self.null[lines][:, None] | d.null)
            kept &= np.isneginf(np.take(self.last[lines], d.cut, axis=1)) & (d.vec_ids <= np.take(self.last_id[lines], d.cut, axis=1))
            none = np.logical_or.reduceat(kept, d.slots, axis=1)
            out = no_number if out is None else out | no_number
        if out is not None:
            np.copyto(scores, np.inf, where=out)
        return np.minimum.reduceat(scores, d.slots, axis=1), none

    def wide(self, lines: np.ndarray, d: _Documents, low: np.ndarray, none: np.ndarray) -> None:
        """Fold the documents' scores into lines x elements x indexes."""
        found, no_number = self.lows(lines, d)
        element = np.searchsorted(d.elements, d.slots, side="right") - 1 + low.shape[1] - len(d.elements)
        index = d.index[d.slots]
        low[:, element, index] = np.minimum(low[:, element, index], found)
        none[:, element, index] |= no_number


class _Rows:
    """Scores of questions and elements as batches of some size."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, ids: np.ndarray, key: Key, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            self.parts.append((ids, key, scores))
            self.rows += len(ids)
        if self.rows >= ROWS_OUT:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _, _ in self.parts]
        element = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        kinds = pa.int64(), pa.int64(), pa.string()
        columns = [pa.array([key[i + 1] for _, key, _ in self.parts], kind).take(element) for i, kind in enumerate(kinds)]
        scores = np.concatenate([s for _, _, s in self.parts])
        # inf is for what has no score.
        scores = [pa.array(scores[:, i], mask=np.isinf(scores[:, i])) for i in range(INDEXES)]
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([i for i, _, _ in self.parts])), *columns, *scores], names=["question_id", "table_id", "column_id", "value", *fixed.ALL_SCORES])
        self.parts, self.rows = [], 0
        return batch

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self.batch()


SCORE_SCHEMA = "question_id long, table_id long, column_id long, value string" + "".join(f", {n} double" for n in fixed.ALL_SCORES)


def _level(key: Key) -> int:
    return 2 if key[3] is not None else 1 if key[2] is not None else 0


class _Passing:
    """All elements past all questions of their source; an element is given when its last document has passed."""

    def __init__(self, questions: pa.Table, over: list[int], cells: int):
        self.asked, self.over, self.cells = _Asked(questions, over), over, cells
        self.key: Key | None = None
        self.lines = np.zeros(0, int)
        self.own = False

    def through(self, blocks: Iterator[pa.Table]) -> Iterator[tuple[np.ndarray, list[Key], np.ndarray, np.ndarray, np.ndarray]]:
        """Lines, elements, their lowest scores and what is no number, and which elements count (`own`)."""
        for block in blocks:
            sources = block[SOURCE].to_numpy()
            starts = np.flatnonzero(np.r_[True, sources[1:] != sources[:-1]])
            for start, end in zip(starts, [*starts[1:], len(sources)], strict=True):
                yield from self._add(block.slice(start, end - start))
        yield from self._last()

    def _last(self) -> Iterator[tuple]:
        if self.key is not None and len(self.lines):
            yield self.lines, [self.key], self.low[:, None], self.none[:, None], np.array([self.own])
        self.key = None

    def _add(self, block: pa.Table) -> Iterator[tuple]:
        d = _Documents(block, self.asked.units.shape[1], self.over)
        if self.key is None or self.key[0] != d.keys[0][0]:
            yield from self._last()
            self.lines = np.flatnonzero(self.asked.sources == d.keys[0][0])
            self.key, self.own = d.keys[0], False
            self.low, self.none = np.full((len(self.lines), INDEXES + 1), np.inf), np.zeros((len(self.lines), INDEXES + 1), bool)
        keys = d.keys if self.key == d.keys[0] else [self.key, *d.keys]
        own = np.logical_or.reduceat(block["own"].to_numpy(zero_copy_only=False), d.elements)
        own = np.r_[np.zeros(len(keys) - len(own), bool), own]
        own[0] |= self.own
        at_once = max(1, min(LINES_AT_ONCE, self.cells // (len(keys) * (INDEXES + 1))))
        for start in range(0, len(self.lines), at_once):
            some = slice(start, start + at_once)
            low = np.full((len(self.lines[some]), len(keys), INDEXES + 1), np.inf)
            none = np.zeros(low.shape, bool)
            low[:, 0], none[:, 0] = self.low[some], self.none[some]
            self.asked.wide(self.lines[some], d, low, none)
            self.low[some], self.none[some] = low[:, -1], none[:, -1]
            if len(keys) > 1:
                yield self.lines[some], keys[:-1], low[:, :-1], none[:, :-1], own[:-1]
        self.key, self.own = keys[-1], bool(own[-1])


def all_scores(over: list[int], cells: int) -> Kernel:
    """A row of nine scores for every question and every element that has one, table scores copied onto columns."""

    def run(questions: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        passing, rows = _Passing(questions, over, cells), _Rows()
        # Scores of the last table that passed a question, and which table that was.
        of_table, copied = np.full(len(passing.asked.ids), np.iinfo(np.int64).min), np.full((len(passing.asked.ids), TABLE_SLOTS), np.inf)
        for lines, keys, low, none, own in passing.through(blocks):
            low = np.where(none, np.inf, rounded(low))[:, :, :INDEXES]
            for i, key in enumerate(keys):
                scores = low[:, i]
                found = np.isfinite(scores).any(axis=1)
                if _level(key) == 0:
                    copied[lines], of_table[lines] = scores[:, :TABLE_SLOTS], key[1]
                elif _level(key) == 1:
                    same = of_table[lines] == key[1]
                    scores = np.concatenate([np.where(same[:, None], copied[lines], np.inf), scores[:, TABLE_SLOTS:]], axis=1)
                if own[i]:
                    yield from rows.add(passing.asked.ids[lines[found]], key, scores[found])
        yield from rows.rest()

    return run


DRAWN_SCHEMA = "question_id long, level string, digest string, table_id long, column_id long, value string"
LEVELS = np.array(["table", "column", "value"])


class _Drawn:
    """Of each question and level the elements of the smallest digests so far, as many as `draw` says."""

    def __init__(self, draw: np.ndarray):
        self.draw, self.keys = draw, []
        self.held = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64)]  # line, level, digest in two halves, element

    def add(self, lines: np.ndarray, level: int, digests: list[bytes], elements: np.ndarray) -> None:
        halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        more = lines, np.full(len(lines), level), halves[:, 0], halves[:, 1], elements
        self.held = [np.concatenate(x) for x in zip(self.held, more, strict=True)]

    def cut(self) -> None:
        line, level, high, low, _ = self.held
        order = np.lexsort((low, high, level, line))
        group = (line * len(LEVELS) + level)[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        self.held = [x[order[place < self.draw[line[order], level[order]]]] for x in self.held]


def first_known(over: list[int], cells: int, seed: int) -> Kernel:
    """Of the elements that have a score for a question, the first of each level by `training.sample_order`.

    Questions have `draw`, how many are wanted of each of `LEVELS`; all documents must be of the indexes in `over`.
    """

    def run(questions: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        passing = _Passing(questions, over, cells)
        drawn = _Drawn(questions["draw"].combine_chunks().flatten().to_numpy().reshape(-1, len(LEVELS)))
        before = [f"{seed}|{i}|".encode() for i in passing.asked.ids.tolist()]
        most = 2 * ROWS_OUT
        for lines, keys, low, none, _ in passing.through(blocks):
            known = np.isfinite(low).any(axis=2) | none.any(axis=2)
            for i, key in enumerate(keys):
                mine = lines[known[:, i] & (drawn.draw[lines, _level(key)] > 0)]
                if len(mine):
                    after = f"{key[1]}|{'' if key[2] is None else key[2]}|{key[3] or ''}".encode()
                    digests = [hashlib.md5(before[x] + after).digest() for x in mine.tolist()]
                    drawn.add(mine, _level(key), digests, np.full(len(mine), len(drawn.keys)))
                    drawn.keys.append(key)
            if len(drawn.held[0]) > most:
                drawn.cut()
                most = 2 * len(drawn.held[0]) + 2 * ROWS_OUT
        drawn.cut()
        for start in range(0, len(drawn.held[0]), ROWS_OUT):
            line, level, high, low, element = (x[start : start + ROWS_OUT] for x in drawn.held)
            digest = [f"{a:016x}{b:016x}" for a, b in zip(high.tolist(), low.tolist(), strict=True)]
            columns = [pa.array([drawn.keys[e][i + 1] for e in element.tolist()], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(passing.asked.ids[line]), pa.array(LEVELS[level].tolist(), pa.string()), pa.array(digest, pa.string()), *columns], names=["question_id", "level", "digest", "table_id", "column_id", "value"])

    return run


class _Wanted:
    """Which questions of a strip want which elements of their table."""

    def __init__(self, questions: pa.Table):
        lists = questions["wanted"].combine_chunks()
        line = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        codes = [lists.flatten().field(c).dictionary_encode("encode") for c in ("column_id", "value")]
        code = codes[0].indices.to_numpy() * max(1, len(codes[1].dictionary)) + codes[1].indices.to_numpy()
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(number, kind="stable")
        lines = np.split(line[order], np.cumsum(np.bincount(number, minlength=len(first)))[:-1])
        some = lists.flatten().take(pa.array(first)).to_pylist()
        self.lines = {(e["column_id"], e["value"]): x for e, x in zip(some, lines, strict=True)}
        with_table = [x for (column, value), x in self.lines.items() if value is None]
        # A table's scores are also those of its columns.
        self.of_table = np.unique(np.concatenate(with_table)) if with_table else np.zeros(0, int)


def wanted_scores(over: list[int]) -> Kernel:
    """A row of nine scores for every question and wanted element that is known to it, table scores copied onto columns.

    Questions have `wanted`, elements (column_id, value) of the one table whose documents pass. An element is known by
    any document of an index that is kept whole, or by a kept hit. Rows that repeat a question give one row.
    """

    def run(questions: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        asked, wanted, rows = _Asked(questions, over), _Wanted(questions), _Rows()
        copied = np.full((len(asked.ids), TABLE_SLOTS), np.inf), np.zeros((len(asked.ids), TABLE_SLOTS), bool)
        current: Key | None = None

        def lines_of(key: Key) -> np.ndarray:
            return wanted.of_table if _level(key) == 0 else wanted.lines.get(key[2:], np.zeros(0, int))

        def given() -> Iterator[pa.RecordBatch]:
            key, chosen = current, lines
            scores, no_number = rounded(low)[:, :INDEXES], none[:, :INDEXES]
            known = free | np.isfinite(low).any(axis=1) | none.any(axis=1)
            if _level(key) == 0:
                copied[0][chosen], copied[1][chosen] = scores[:, :TABLE_SLOTS], no_number[:, :TABLE_SLOTS]
                mine = np.isin(chosen, wanted.lines.get(key[2:], np.zeros(0, int)))
                chosen, scores, no_number, known = chosen[mine], scores[mine], no_number[mine], known[mine]
            elif _level(key) == 1:
                scores, no_number = (np.concatenate([x[chosen], y[:, TABLE_SLOTS:]], axis=1) for x, y in zip(copied, (scores, no_number), strict=True))
            chosen, scores, no_number = chosen[known], scores[known], no_number[known]
            order = np.argsort(asked.ids[chosen], kind="stable")
            ids = asked.ids[chosen[order]]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
            if len(first):
                scores, no_number = np.minimum.reduceat(scores[order], first), np.logical_or.reduceat(no_number[order], first)
                # As in Spark what is no number is above all others.
                yield from rows.add(ids[first], key, np.where(np.isinf(scores) & no_number, np.nan, scores))

        for block in blocks:
            d = _Documents(block, asked.units.shape[1], over)
            for key, start, end in zip(d.keys, d.elements, [*d.elements[1:], len(d.index)], strict=True):
                if key != current:
                    if current is not None:
                        yield from given()
                    current, free, lines = key, False, lines_of(key)
                    low, none = np.full((len(lines), INDEXES + 1), np.inf), np.zeros((len(lines), INDEXES + 1), bool)
                if not len(lines):
                    continue
                part = d.part(start, end)
                free |= bool(part.free.any())
                for at in range(0, len(lines), LINES_AT_ONCE):
                    some = slice(at, at + LINES_AT_ONCE)
                    asked.wide(lines[some], part, low[some, None], none[some, None])
        if current is not None:
            yield from given()
        yield from rows.rest()

    return run
