"""Exact nearest-neighbour search of many questions against many documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.operators.block_stream import STREAMS_PER_CORE, cell_stream, pair_stream, strip_count, streams
from slink.operators.grouping import number_rows, top_k_per_group
from slink.sources.stores import materialize

# Documents per block, and the fewest questions that are worth a strip of their own.
DOCUMENT_BLOCK = 8192
LEAST_QUESTIONS = 64
# Questions scored at a time inside a block, which bounds the score matrix.
SCORED_AT_ONCE = 256
# Best hits (score and document number) and numbers of questions' vectors that a task holds, and rows that it gives at a time.
HELD_HITS = 16_000_000
HELD_NUMBERS = 4_000_000
ROWS_OUT = 100_000
# Hits are ranked on the full score, less the noise of the arithmetic, and shown with fewer decimals.
RANKED_DECIMALS = 12
SHOWN_DECIMALS = 4

SOURCE = "data_source_id"
HIT_SCHEMA = f"question_id long, {SOURCE} long, index_name string, vec_id long, score double, rank int"
_ELEMENT_HITS = ["question_id", SOURCE, "index_name", "score"]
_ARROW_HITS = [
    ("question_id", pa.int64()),
    (SOURCE, pa.int64()),
    ("index_name", pa.string()),
    ("vec_id", pa.int64()),
    ("score", pa.float64()),
    ("rank", pa.int32()),
]


def limits_for(limits: tuple[int, int], indexes: list[str] = fixed.ALL_INDEXES) -> dict[str, int]:
    """Hits kept per index: the second limit holds for the value indexes."""
    return {name: limits[1] if name in fixed.VALUE_INDEXES else limits[0] for name in indexes}


def limit_column(k: int | dict[str, int], index: Column) -> Column:
    if isinstance(k, int):
        return F.lit(k)
    by_limit: dict[int, list[str]] = {}
    for name, limit in k.items():
        by_limit.setdefault(limit, []).append(name)
    chosen = F
    for limit, names in by_limit.items():
        chosen = chosen.when(index.isin(names), limit)
    return chosen


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of an ARRAY<FLOAT> column, straight from the Arrow buffers."""
    vectors = column.combine_chunks()
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(rows, -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def unit_vectors(column: pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`unit_rows`, and which rows have no vector: null, with null numbers, or not of `width`; these are NaN."""
    vectors = column.combine_chunks()
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    flat = vectors.flatten()
    if flat.null_count:
        without = np.unique(np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)])
    else:
        without = np.zeros(0, int)
    null = (sizes != width) | ~vectors.is_valid().to_numpy(zero_copy_only=False)
    null[without] = True
    units = np.full((len(sizes), width), np.nan)
    if not null.all() and width:
        units[~null] = unit_rows(pa.chunked_array([vectors.filter(pa.array(~null))]))
    return units, null


NO_VECTOR = np.iinfo(np.int64).max
# Arithmetic in another order may move a score by less than this.
NOISE = 1e-9
# Documents compared at a time in single precision, and of how many a hit must be kept for that to sort out most.
SKIMMED_AT_ONCE = 2048
SKIM_FROM = 32


def _near(q: np.ndarray, d: np.ndarray, single: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, places and scores of the pairs of unit rows that are not below `least`, by line and place.

    Single precision, `single` for `d`, sorts out pairs that are below by more than its error.
    """
    error = np.float32((q.shape[1] + 8) * 2.0**-22)
    q32, bound = q.astype(np.float32), (least.astype(np.float32) - error)[:, None]
    parts = []
    for start in range(0, len(d), SKIMMED_AT_ONCE):
        found = q32 @ single[start : start + SKIMMED_AT_ONCE].T
        line, place = np.divmod(np.flatnonzero(~(found < bound)), found.shape[1])
        parts.append((line, place + start))
    line, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(line, kind="stable")
    line, place = line[order], place[order]
    scores = np.concatenate([np.einsum("ij,ij->i", q[line[i : i + ROWS_OUT]], d[place[i : i + ROWS_OUT]]) for i in range(0, max(1, len(line)), ROWS_OUT)])
    close = ~(scores < least[line])
    return line[close], place[close], scores[close]


def _nearest(scores: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` best of each line, in any order; of equal scores those of smaller vec_id. Rows below 0 are fillers."""
    size = scores.shape[1]
    if keep == size:
        return scores, rows
    last = np.partition(scores, size - keep, axis=1)[:, size - keep]
    chosen = scores >= last[:, None]
    for i in np.flatnonzero(chosen.sum(axis=1) > keep).tolist():
        tied = np.flatnonzero(scores[i] == last[i])
        ids = np.where(rows[i, tied] < 0, NO_VECTOR, vec_ids[rows[i, tied]])
        chosen[i, tied[np.argsort(ids, kind="stable")][keep - np.count_nonzero(scores[i] > last[i]) :]] = False
    return scores[chosen].reshape(-1, keep), rows[chosen].reshape(-1, keep)


class _Best:
    """The best hits so far of the questions of one data source in one index."""

    def __init__(self, questions: pa.Table, asking: np.ndarray, k: int, carry: list[str]):
        self.questions, self.asking, self.k, self.have = questions, asking, k, 0
        self.vectors = questions["embedding"].take(pa.array(asking)).combine_chunks()
        self.columns = ["vec_id", *carry]
        self.scores, self.rows = np.zeros((len(asking), 0)), np.zeros((len(asking), 0), np.int32)
        self.seen = 0
        self.held: pa.Table | None = None  # documents that `rows` numbers
        self.compact = 4 * DOCUMENT_BLOCK

    def add(self, block: pa.Table) -> None:
        mine = block.select(self.columns)
        first, n = self.held.num_rows if self.held else 0, block.num_rows
        self.held = pa.concat_tables([self.held, mine]) if self.held else mine
        vec_ids, d = self.held["vec_id"].to_numpy(), unit_rows(block["embedding"])
        keep = min(self.k, self.have + n)
        if keep > self.have:
            grown = np.full((len(self.asking), keep), -np.inf), np.full((len(self.asking), keep), -1, np.int32)
            grown[0][:, : self.have], grown[1][:, : self.have] = self.scores, self.rows
            self.scores, self.rows = grown
        new = np.arange(first, first + n, dtype=np.int32)
        skim = self.have == self.k and self.seen >= SKIM_FROM * self.k
        self.seen += n
        single = d.astype(np.float32) if skim else None
        for start in range(0, len(self.asking), SCORED_AT_ONCE):
            some = slice(start, start + SCORED_AT_ONCE)
            q = unit_rows(pa.chunked_array([self.vectors.slice(start, SCORED_AT_ONCE)]))
            if self.have < self.k:
                found = rounded(q @ d.T)
                found = np.concatenate([self.scores[some, : self.have], found], axis=1)
                rows = np.concatenate([self.rows[some, : self.have], np.broadcast_to(new, (len(found), n))], axis=1)
                self.scores[some], self.rows[some] = _nearest(found, rows, vec_ids, keep)
                continue
            # Most documents are farther than the last hit that is kept.
            least = self.scores[some].min(axis=1) - NOISE
            if skim:
                line, place, near = _near(q, d, single, least)
            else:
                found = q @ d.T
                line, place = np.nonzero(~(found < least[:, None]))
                near = found[line, place]
            if not len(line):
                continue
            counts = np.bincount(line, minlength=len(q))
            lines = np.flatnonzero(counts)
            at = np.arange(len(line)) - (np.cumsum(counts) - counts)[line]
            more, rows = np.full((len(q), counts.max()), -np.inf), np.full((len(q), counts.max()), -1, np.int32)
            more[line, at], rows[line, at] = rounded(near), new[place]
            lines = lines + start
            more = np.concatenate([self.scores[lines], more[lines - start]], axis=1)
            rows = np.concatenate([self.rows[lines], rows[lines - start]], axis=1)
            self.scores[lines], self.rows[lines] = _nearest(more, rows, vec_ids, self.k)
        self.have = keep
        if self.held.num_rows > self.compact:
            used = np.zeros(self.held.num_rows, bool)
            used[self.rows] = True
            self.rows = (np.cumsum(used, dtype=np.int32) - 1)[self.rows].astype(np.int32)
            self.held = self.held.filter(pa.array(used)).combine_chunks()
            self.compact = 2 * self.held.num_rows + 4 * DOCUMENT_BLOCK

    def _batch(self, source: int, name: str, asked: np.ndarray, scores: np.ndarray, rows: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        n, rows = len(asked), pa.array(rows)
        columns = [
            pa.array(asked),
            pa.array(np.full(n, source, np.int64)),
            pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([name])).dictionary_decode(),
            self.held["vec_id"].combine_chunks().take(rows),
            pa.array(np.where(np.isinf(scores), np.nan, scores)),
            pa.array(ranks.astype(np.int32)),
            *(self.held[c].combine_chunks().take(rows) for c in self.columns[1:]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in _ARROW_HITS] + self.columns[1:])

    def hits(self, source: int, name: str, last_only: bool = False, once: bool = False) -> Iterator[pa.RecordBatch]:
        """In the order of rank; with `last_only` only hits of rank k, with `once` rows of one question have k together."""
        if not self.have or last_only and self.have < self.k:
            return
        self.held = self.held.combine_chunks()
        vec_ids, asked = self.held["vec_id"].to_numpy(), self.questions["question_id"].to_numpy()[self.asking]
        _, number, counts = np.unique(asked, return_inverse=True, return_counts=True)
        apart = np.flatnonzero(counts[number] == 1) if once else np.arange(len(asked))
        at_once = max(1, ROWS_OUT // self.have)
        for start in range(0, len(apart), at_once):
            some = apart[start : start + at_once]
            scores, rows = self.scores[some], self.rows[some]
            order = np.lexsort((vec_ids[rows], -scores), axis=1)
            order = order[:, -1:] if last_only else order
            ranks = np.arange(self.have + 1 - order.shape[1], self.have + 1)
            scores, rows = (np.take_along_axis(x, order, axis=1).ravel() for x in (scores, rows))
            yield self._batch(source, name, np.repeat(asked[some], order.shape[1]), scores, rows, np.tile(ranks, len(some)))
        for repeated in np.flatnonzero(counts > 1).tolist() if once else ():
            some = np.flatnonzero(number == repeated)
            scores, rows = self.scores[some].ravel(), self.rows[some].ravel()
            order = np.lexsort((vec_ids[rows], -scores))[: self.k]
            yield self._batch(source, name, np.repeat(asked[some[:1]], len(order)), scores[order], rows[order], np.arange(1, len(order) + 1))


    def _numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Each held document's element (its carried columns) as a number, and a document of each element."""
        code = np.zeros(self.held.num_rows, np.int64)
        for name in self.columns[1:]:
            column = self.held[name].combine_chunks().dictionary_encode("encode")
            code = np.unique(code * max(1, len(column.dictionary)) + column.indices.to_numpy(), return_inverse=True)[1]
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        return number, first

    def elements(self, source: int, name: str, fold: str) -> Iterator[pa.RecordBatch]:
        """Per question and element `FOLDS[fold]` of the scores of its hits."""
        if not self.have:
            return
        self.held = self.held.combine_chunks()
        number, document = self._numbered()
        asked, size = self.questions["question_id"].to_numpy()[self.asking], len(document)
        at_once = max(1, ROWS_OUT // self.have)
        for start in range(0, len(asked), at_once):
            scores, rows = (x[start : start + at_once] for x in (self.scores, self.rows))
            scores = np.where(np.isinf(scores), np.nan, scores).ravel()
            slot = (np.arange(len(rows))[:, None] * size + number[rows]).ravel()
            order = np.argsort(slot)
            slot, scores = slot[order], scores[order]
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            line, element = np.divmod(slot[first], size)
            found, n = FOLDS[fold](scores, first), len(first)
            columns = [
                pa.array(asked[start + line]),
                pa.array(np.full(n, source, np.int64)),
                pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([name])).dictionary_decode(),
                found if isinstance(found, pa.Array) else pa.array(found),
                *(self.held[c].combine_chunks().take(pa.array(document[element])) for c in self.columns[1:]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*_ELEMENT_HITS, *self.columns[1:]])


def _lists(scores: np.ndarray, first: np.ndarray) -> pa.Array:
    """Scores from each `first` on as one list of `score_steps`."""
    steps = pa.array(score_steps(scores), mask=np.isnan(scores))
    return pa.ListArray.from_arrays(pa.array(np.r_[first, len(scores)].astype(np.int32)), steps)


# What becomes of the scores of an element's hits; as in Spark NaN is above all others.
FOLDS = {"highest": np.maximum.reduceat, "lowest": np.fmin.reduceat, "all": _lists}


def score_steps(scores: np.ndarray) -> np.ndarray:
    """`shown_score` as whole numbers of the last shown decimal; NaN is 0."""
    exact, step = np.rint(np.nan_to_num(scores) * 10.0**RANKED_DECIMALS).astype(np.int64), 10 ** (RANKED_DECIMALS - SHOWN_DECIMALS)
    return (np.sign(exact) * ((np.abs(exact) + step // 2) // step)).astype(np.int16)


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores as they are ranked; what is no number is below all others."""
    scores = np.round(scores, RANKED_DECIMALS) + 0.0
    return np.where(np.isnan(scores), -np.inf, scores)


def _best_hits(k: int | dict[str, int], carry: list[str], last_only: bool = False, once: bool = False, fold: str | None = None):
    """Kernel of blocks that come index by index: one set of best hits is held, and given when its index is through."""

    def given(best: _Best, source: int, name: str) -> Iterator[pa.RecordBatch]:
        return best.elements(source, name, fold) if fold else best.hits(source, name, last_only, once)

    def search(questions: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        sources, current, best = questions[SOURCE].to_numpy(), None, None
        for block in blocks:
            source, name = block[SOURCE][0].as_py(), block["index_name"][0].as_py()
            if (source, name) != current:
                if best is not None:
                    yield from given(best, *current)
                current = source, name
                best = _Best(questions, np.flatnonzero(sources == source), k if isinstance(k, int) else k[name], carry)
            if len(best.asking):
                best.add(block)
        if best is not None:
            yield from given(best, *current)

    return search


def document_block_count(documents: DataFrame) -> int:
    return max(1, math.ceil(documents.count() / DOCUMENT_BLOCK))


def source_of(df: DataFrame) -> Column:
    """A question's or document's data source; tables without the column are all of one source."""
    return (F.col(SOURCE) if SOURCE in df.columns else F.lit(1)).cast("long").alias(SOURCE)


def shown_score(score: str = "score") -> Column:
    """A ranked score with fewer decimals, halves away from zero; whole numbers, as `round` is slow on many hits."""
    exact, step = F.rint(F.col(score) * 10.0**RANKED_DECIMALS), 10 ** (RANKED_DECIMALS - SHOWN_DECIMALS)
    whole = F.floor((F.abs(exact).cast("long") + F.lit(step // 2)) / F.lit(step))
    shown = F.signum(exact) * whole / F.lit(10.0**SHOWN_DECIMALS) + F.lit(0.0)
    return F.when(F.isnan(score), F.col(score)).otherwise(shown).alias(score)


def _plan(questions: DataFrame, documents: DataFrame, k: int | dict[str, int]) -> tuple[int, int, int]:
    """Strips of questions, blocks of documents, and the ranges of blocks that are searched apart.

    A strip is small enough for its best hits to be held. Where there are strips for every core a strip meets all
    documents in one task, whose hits are final; else documents are searched in ranges.
    """
    blocks = document_block_count(documents)
    rows, width = questions.agg(F.count("*"), F.max(F.size("embedding"))).first()
    cores = questions.sparkSession.sparkContext.defaultParallelism
    largest = k if isinstance(k, int) else max(k.values(), default=1)
    held = math.ceil(rows / max(1, HELD_HITS // max(1, min(largest, blocks * DOCUMENT_BLOCK))))
    strips = max(held, strip_count(questions, rows, 1, LEAST_QUESTIONS, HELD_NUMBERS // max(1, width or 1)))
    if strips < cores:
        return strips, blocks, streams(questions, strips, blocks)[0]
    # Strips in whole rounds of the cores, so that none waits for another's last one.
    rounds = min(math.ceil(strips / cores), STREAMS_PER_CORE)
    return max(strips, rounds * cores), blocks, 1


def strips_and_ranges(questions: DataFrame, documents: DataFrame) -> tuple[int, int]:
    """Strips of questions, and ranges of documents, of a stream that holds no hits."""
    strips, _, ranges = _plan(questions, documents, 1)
    return strips, ranges


def similarity_join(
    questions: DataFrame,
    documents: DataFrame,
    k: int | dict[str, int],
    carry: list[str] | None = None,
    plan: tuple[int, int, int] | None = None,
    last_only: bool = False,
    once: bool = False,
    fold: str | None = None,
) -> DataFrame:
    """Best hits of every question in every index of its data source, ranked, for each range of document blocks.

    Documents are cut into ranges by a hash of their unique id, however the indexes are filled, and questions into
    strips; a bounded number of tasks streams the documents past the strips, index by index. A task holds the best hits
    of a strip in one index, so only the top k of a whole range leave it: with one range they are final. Nothing is
    broadcast or collected. With `carry` columns of the documents come along with their hits, so that these need not be
    joined with the index again. `last_only` gives the hits of rank k alone; with `once` rows that repeat a question
    are one question, as for `top_k_hits`. With `fold`, of `FOLDS`, there is one row per question, index and element
    (the carried columns) instead of one per hit.
    """
    carry = carry or []
    strips, blocks, ranges = plan or _plan(questions, documents, k)
    left = questions.select("question_id", source_of(questions), "embedding").filter(F.col(SOURCE).isNotNull())
    right = documents.select(source_of(documents), "index_name", "vec_id", "embedding", *carry)
    right = right.filter(F.col(SOURCE).isNotNull() & F.col("index_name").isNotNull())
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in right.schema.fields if f.name in carry)
    strip = F.pmod(F.xxhash64("question_id"), F.lit(strips))
    block = F.pmod(F.xxhash64(SOURCE, "index_name", "vec_id"), F.lit(blocks))
    group = F.concat(F.col(SOURCE).cast("string"), F.lit("/"), F.col("index_name"))
    kernel = _best_hits(k, carry, last_only, once, fold)
    schema = HIT_SCHEMA if fold is None else f"question_id long, {SOURCE} long, index_name string, score {'array<short>' if fold == 'all' else 'double'}"
    return pair_stream(left, right, strip, strips, block, blocks, kernel, schema + types, ranges, group, DOCUMENT_BLOCK)


def top_k_hits(hits: DataFrame, k: int | dict[str, int]) -> DataFrame:
    """Best k hits per question and index, ties by vec_id, with `rank` from 1."""
    order = [F.desc("score"), F.asc("vec_id")]
    keys = ["question_id", "index_name"]
    largest = k if isinstance(k, int) else max(k.values())
    ranked = top_k_per_group(hits, keys, order, largest, salt_by=["vec_id"])
    return ranked if isinstance(k, int) else ranked.filter(F.col("rank") <= limit_column(k, F.col("index_name")))


def full_knn(
    questions: DataFrame, documents: DataFrame, k: int | dict[str, int], carry: list[str] | None = None, once: bool = False
) -> DataFrame:
    """`exact_knn` with the scores that it ranks by; with `once` rows that repeat a question are one question."""
    plan = _plan(questions, documents, k)
    found = similarity_join(questions, documents, k, carry, plan, once=once)
    return found if plan[2] == 1 else top_k_hits(found, k)


def _last_kept(questions: DataFrame, documents: DataFrame, k: dict[str, int], plan: tuple[int, int, int]) -> DataFrame:
    if plan[2] == 1:
        return similarity_join(questions, documents, k, plan=plan, last_only=True)
    hits = top_k_hits(similarity_join(questions, documents, k, plan=plan), k)
    return hits.filter(F.col("rank") == limit_column(k, F.col("index_name")))


def _finite(vector: str) -> Column:
    infinite = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~infinite, F.lit(False))


def _from_the_end(questions: DataFrame, documents: DataFrame, k: dict[str, int]) -> tuple[list[str], dict[str, int]]:
    """The indexes of `k` that have documents, and those whose hit of rank k stands nearer to the other end, with its number from there.

    All data sources must have equally many documents in such an index, and all vectors must be finite.
    """
    known = documents.filter(F.col("index_name").isin(list(k)) & source_of(documents).isNotNull())
    sizes = known.groupBy("index_name", source_of(documents)).agg(F.count("*").alias("n"), F.every(_finite("embedding")).alias("finite"))
    found = sizes.groupBy("index_name").agg(F.min("n").alias("least"), F.max("n").alias("n"), F.every("finite").alias("finite")).collect()
    back = {r.index_name: r.n - k[r.index_name] + 1 for r in found if r.finite and r.least == r.n and k[r.index_name] <= r.n < 2 * k[r.index_name] - 1}
    if back and not questions.filter(~_finite("embedding")).isEmpty():
        back = {}
    return [r.index_name for r in found], back


def last_kept(questions: DataFrame, documents: DataFrame, k: dict[str, int]) -> DataFrame:
    """Of `full_knn`, the hits of the last rank that is kept.

    A task holds as many hits of a question as it searches for, so strips are cut by the limits of indexes that have
    documents, and an index of less than twice its limit is searched from the other end: of n documents the hit of
    rank k is number n - k + 1 by falling vec_id and rising score.
    """
    names, back = _from_the_end(questions, documents, k)
    opposite = questions.withColumn("embedding", F.transform("embedding", lambda x: -x))
    backwards = documents.filter(F.col("index_name").isin(list(back))).withColumn("vec_id", -F.col("vec_id"))
    plan = _plan(opposite, backwards, back) if back else None
    if plan is None or plan[2] > 1:
        back = {}
    ahead = {name: k[name] for name in names if name not in back}
    parts = []
    if ahead or not back:
        ahead = ahead or k
        there = documents.filter(F.col("index_name").isin(list(ahead)))
        parts.append(_last_kept(questions, there, ahead, _plan(questions, there, ahead)))
    if back:
        found = _last_kept(opposite, backwards, back, plan)
        turned = {"vec_id": -F.col("vec_id"), "score": F.lit(0.0) - F.col("score"), "rank": limit_column(k, F.col("index_name"))}
        parts.append(found.withColumns(turned))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# Numbers of the vectors of an index that a task holds whole, and scores of questions with them side by side.
HELD_INDEX_NUMBERS = 32_000_000
HELD_SCORES = 4_000_000
# Documents by whose scores those that cannot be the last hit are told, and cells of the search for each core.
TRIED = 1024
CELLS_PER_CORE = 3


class _Held:
    """All documents of an index, for the hit of rank `k` of each question; there are more than `k`."""

    def __init__(self, documents: pa.Table, k: int):
        self.k, self.name, self.vec_ids = k, documents["index_name"][0].as_py(), documents["vec_id"].to_numpy()
        self.vectors = documents["embedding"].combine_chunks()
        width = int(np.nan_to_num(self.vectors.value_lengths().to_numpy(zero_copy_only=False)).max())
        self.single, self.clean = np.empty((width, len(self.vec_ids)), np.float32), True
        for start in range(0, len(self.vec_ids), DOCUMENT_BLOCK):
            units, _ = unit_vectors(pa.chunked_array([self.vectors.slice(start, DOCUMENT_BLOCK)]), width)
            self.single[:, start : start + len(units)] = units.T
            self.clean = self.clean and bool(np.isfinite(units).all())
        self.error = np.float32((width + 8) * 2.0**-22)
        self.tried = np.unique(np.linspace(0, len(self.vec_ids) - 1, TRIED).astype(int))

    def last(self, questions: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scores and vec_ids of the hits of rank k."""
        units, _ = unit_vectors(questions["embedding"], len(self.single))
        clean = self.clean and bool(np.isfinite(units).all())
        at_once = max(1, min(SCORED_AT_ONCE, HELD_SCORES // len(self.vec_ids)))
        for start in range(0, len(units), at_once):
            q = units[start : start + at_once]
            found = q.astype(np.float32) @ self.single
            if not clean:
                found = np.where(np.isnan(found), np.float32(-np.inf), found)
            chosen = [self._one(line, scores) for line, scores in zip(q, found, strict=True)]
            yield np.array([s for s, _ in chosen]), np.array([i for _, i in chosen], np.int64)

    def _one(self, q: np.ndarray, scores: np.ndarray) -> tuple[float, int]:
        share = self.k / len(scores)
        sure = share + 4 * math.sqrt(share * (1 - share) / len(self.tried)) + 2 / len(self.tried)
        below = len(self.tried) - 1 - int(sure * len(self.tried))
        least = np.partition(scores[self.tried], below)[below] if sure < 0.9 else -np.inf
        near = np.flatnonzero(scores >= least)
        few = scores[near]
        last = np.partition(few, len(few) - self.k)[len(few) - self.k] if len(few) >= self.k else -np.inf
        if last - 2 * self.error < least:  # the tried ones were not like the others
            near, few = np.arange(len(scores)), scores
            last = np.partition(few, len(few) - self.k)[len(few) - self.k]
        # Single precision leaves these in doubt; they are ranked by their full scores.
        doubtful = near[(few >= last - 2 * self.error) & (few <= last + 2 * self.error)]
        units, _ = unit_vectors(pa.chunked_array([self.vectors.take(pa.array(doubtful))]), len(self.single))
        full = rounded(np.einsum("ij,ij->i", np.broadcast_to(q, units.shape), units))
        place = np.lexsort((self.vec_ids[doubtful], -full))[self.k - 1 - np.count_nonzero(few > last + 2 * self.error)]
        return full[place], self.vec_ids[doubtful[place]]


def _last_of_held(k: dict[str, int]):
    def search(documents: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        held = _Held(documents, k[documents["index_name"][0].as_py()])
        for block in blocks:
            scores, vec_ids = (np.concatenate(x) for x in zip(*held.last(block), strict=True))
            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(scores), np.int32)), pa.array([held.name])).dictionary_decode()
            yield pa.RecordBatch.from_arrays([block["question_id"].combine_chunks(), name, pa.array(scores), pa.array(vec_ids)], names=["question_id", "index_name", "score", "vec_id"])

    return search


def last_of_held(questions: DataFrame, documents: DataFrame, groups: DataFrame, k: dict[str, int]) -> DataFrame:
    """Of `full_knn`, the score and vec_id of the last kept hit, what is no number below all others.

    `groups` are (data source, index) pairs of more documents than are kept. A task holds the documents of one and
    questions pass them, so neither hits are held nor do documents move once per strip of the questions.
    """
    groups = materialize(number_rows(groups.select(SOURCE, "index_name"), [], F.lit(0), [F.col(SOURCE), F.col("index_name")], "number"), "searched")
    n, rows = groups.count(), questions.count()
    cores = questions.sparkSession.sparkContext.defaultParallelism
    strips = max(1, min(math.ceil(CELLS_PER_CORE * cores / max(1, n)), math.ceil(rows / LEAST_QUESTIONS)))
    first = F.col("number") * strips
    right = questions.select(F.col("question_id").cast("long").alias("question_id"), source_of(questions), "embedding").join(groups, SOURCE)
    right = right.select((first + F.pmod(F.xxhash64("question_id"), F.lit(strips))).alias("cell"), "question_id", "embedding")
    left = documents.select(source_of(documents), "index_name", "vec_id", "embedding").join(groups, [SOURCE, "index_name"])
    left = left.select(F.explode(F.sequence(first, first + (strips - 1))).alias("cell"), "index_name", "vec_id", "embedding")
    schema = "question_id long, index_name string, score double, vec_id long"
    return cell_stream(left, right, max(1, n * strips), _last_of_held(k), schema, [], DOCUMENT_BLOCK)


def cut_points(questions: DataFrame, documents: DataFrame, k: dict[str, int]) -> tuple[list[str], DataFrame]:
    """Indexes with more documents than a question keeps of them, and per question its last kept hits there.

    `cut_scores` and `cut_ids` have a place for each of these indexes; where nothing is cut all scores are above.
    Only an index too large for a task is searched with its hits held.
    """
    sizes = documents.groupBy(source_of(documents), "index_name").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"))
    sizes = materialize(sizes.filter(F.col(SOURCE).isNotNull() & (F.col("n") > limit_column(k, F.col("index_name")))), "overfull")
    names = sorted(r.index_name for r in sizes.select("index_name").distinct().collect())
    fits = F.col("n") * F.greatest(F.col("width"), F.lit(1)) <= HELD_INDEX_NUMBERS
    found = last_of_held(questions, documents, sizes.filter(fits), k)
    large = sizes.filter(~fits)
    if not large.isEmpty():
        of_source = documents.withColumn(SOURCE, source_of(documents))
        rest = last_kept(questions, of_source.join(large, [SOURCE, "index_name"], "left_semi"), k)
        no_number = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
        found = found.unionByName(rest.select("question_id", "index_name", no_number.alias("score"), "vec_id"))
    last = [F.min(F.when(F.col("index_name") == n, F.struct("score", "vec_id"))) for n in names]
    cuts = [F.coalesce(x["score"], F.lit(float("-inf"))) for x in last], [F.coalesce(x["vec_id"], F.lit(NO_VECTOR)) for x in last]
    return names, found.groupBy("question_id").agg(*[F.array(*x).alias(c) for c, x in zip(("cut_scores", "cut_ids"), cuts, strict=True)])


def exact_knn(
    questions: DataFrame, documents: DataFrame, k: int | dict[str, int], carry: list[str] | None = None
) -> DataFrame:
    """Exact top k by cosine, with `rank` from 1 per question and index.

    Where each strip of questions meets all documents in one task its hits are already the answer; else the results
    of the ranges of documents are cut once more per question and index.
    """
    return full_knn(questions, documents, k, carry).withColumn("score", shown_score())


def element_knn(
    questions: DataFrame, documents: DataFrame, k: int | dict[str, int], element: list[str], fold: str = "highest"
) -> DataFrame:
    """Of `exact_knn`, per question, index and element the `highest` or `lowest` shown score, or `all` in an array.

    Hits are folded in the task that finds them, so no row per hit leaves it. The array holds whole steps of the last
    shown decimal, in any order, and NULL for what is no number.
    """
    plan = _plan(questions, documents, k)
    if plan[2] == 1:
        found = similarity_join(questions, documents, k, element, plan, fold=fold)
        return found if fold == "all" else found.withColumn("score", shown_score())
    hits = top_k_hits(similarity_join(questions, documents, k, element, plan), k).withColumn("score", shown_score())
    steps = F.when(~F.isnan("score"), F.rint(F.col("score") * 10**SHOWN_DECIMALS).cast("short"))
    folded = {"highest": F.max("score"), "lowest": F.min("score"), "all": F.collect_list(F.struct(steps.alias("step")))}[fold]
    found = hits.groupBy("question_id", SOURCE, "index_name", *element).agg(folded.alias("score"))
    return found.withColumn("score", F.col("score.step")) if fold == "all" else found


def drop_missing_hits(hits: DataFrame) -> DataFrame:
    """Imported hits use -1 for `nothing found`."""
    return hits.filter(F.col("vec_id") >= 0)


def hits_to_elements(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Vector number to (table, column, value)."""
    elements = links.select(source_of(links), "index_name", "vec_id", "table_id", "column_id", "value")
    keyed = hits if SOURCE in hits.columns else hits.withColumn(SOURCE, source_of(hits))
    return keyed.join(elements, [SOURCE, "index_name", "vec_id"])


def sentinel_to_null(table_id: Column, column_id: Column, value: Column) -> list[Column]:
    """Stored -1 and "" back to NULL. A missing table is an error."""
    checked = F.when(table_id.isNull() | (table_id == -1), F.raise_error(F.lit("element without a table"))).otherwise(table_id)
    return [
        checked.cast("int").alias("table_id"),
        F.nullif(column_id, F.lit(-1)).alias("column_id"),
        F.nullif(value, F.lit("")).alias("value"),
    ]


def null_to_sentinel(table_id: Column, column_id: Column, value: Column) -> list[Column]:
    return [
        F.coalesce(table_id, F.lit(-1)).alias("table_id"),
        F.coalesce(column_id, F.lit(-1)).alias("column_id"),
        F.coalesce(value, F.lit("")).alias("value"),
    ]
