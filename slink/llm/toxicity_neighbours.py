"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The labelled rows of a bounded sample are the examples, and all their words are the terms. Document frequencies are
counted over all texts. A term's IDF is damped as far as the examples' labels do not depend on it: nothing is left out,
but a word that goes with a label stands out of hundreds that do not. The cosines of some texts with all examples come,
in single precision, from one matrix product over the frequent terms and from the postings of the others. No part of
them is negative, so their error is a bounded share of them: examples within it of the last nearest one are compared
again in double precision, term by term, which is exact. Similarity-weighted votes are turned into probabilities by an
isotonic fit on the examples themselves, each without its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slink.llm import arrow
from slink.llm.quality_mil import held_out

SAMPLE_DOCS = 4000  # labelled rows used as examples, at most
SAMPLE_CHARS = 16_000_000  # characters of all examples together, at most; so the index is bounded too
DAMPED = 0.05  # share of its IDF that a word without any bearing on the label keeps
SLICE = 64  # examples that are worth a task of their own
TEXTS_AT_ONCE = 32
FREQUENT = 20  # terms in more than this part of the examples are columns of a matrix ...
DENSE_CELLS = 8_000_000  # ... of so many cells at most
ROUNDING = 2.0**-23  # single precision is off by less than this share of a cosine for each term that is added
NEIGHBOURS = 11
EVIDENCE = 3
TOXIC = 0.3

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the ranges' sizes."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    numbers = np.repeat(starts - before, sizes)
    numbers += np.arange(len(numbers))
    return numbers, sizes


@dataclass
class Examples:
    """Inverted index over the labelled examples: term -> postings."""

    vocabulary: dict[str, int]
    term_weight: np.ndarray  # damped IDF
    doc_ids: np.ndarray
    labels: np.ndarray
    postings: np.ndarray  # of each term, its first posting in the two below; one more at the end
    members: np.ndarray
    weights: np.ndarray
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration: votes ...
    chances: np.ndarray = field(default_factory=lambda: np.zeros(0))  # ... and their probabilities

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and how often each stands in a text."""
        counted = Counter(words(text))
        t = np.array(list(map(self.vocabulary.get, counted, repeat(-1))), np.int64)
        n = np.fromiter(counted.values(), np.int64, len(counted))
        known = np.flatnonzero(t >= 0)
        known = known[np.argsort(t[known])]
        return t[known], n[known]

    def vector(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        return _vector(self.term_weight, counts)

    @cached_property
    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term its row in the matrix of frequent ones, or -1; that matrix, a column an example."""
        sizes, examples = np.diff(self.postings), len(self.doc_ids)
        rows = np.argsort(-sizes, kind="stable")[: DENSE_CELLS // max(1, examples)]
        rows = rows[sizes[rows] * FREQUENT > examples]
        row = np.full(len(sizes), -1)
        row[rows] = np.arange(len(rows))
        matrix = np.zeros((len(rows), examples), np.float32)
        numbers, counts = _ranges(self.postings[rows], self.postings[rows + 1])
        matrix[np.repeat(np.arange(len(rows)), counts), self.members[numbers]] = self.weights[numbers]
        return row, matrix

    @cached_property
    def _by_example(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each example its first term in the two behind, with one more at the end; terms, ascending, and weights."""
        order = np.argsort(self.members, kind="stable")
        terms = np.repeat(np.arange(len(self.term_weight), dtype=np.int32), np.diff(self.postings))[order]
        return np.searchsorted(self.members[order], np.arange(len(self.doc_ids) + 1)), terms, self.weights[order]

    def _nearly(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosines of some vectors with all examples, in single precision."""
        row, matrix = self._frequent
        asked = np.zeros((len(vectors), len(matrix)), np.float32)
        rest = []
        for i, (t, w) in enumerate(vectors):
            at = row[t]
            asked[i, at[at >= 0]] = w[at >= 0]
            rest.append((t[at < 0], w[at < 0]))
        scores = asked @ matrix
        for i, (t, w) in enumerate(rest):
            numbers, sizes = _ranges(self.postings[t], self.postings[t + 1])
            parts = np.repeat(w, sizes)
            parts *= self.weights[numbers]
            scores[i] += np.bincount(self.members[numbers], parts, minlength=scores.shape[1])
        return scores

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each vector, the k examples of largest cosine above zero (ties: smaller doc_id first), and the cosines."""
        first, terms, weights = self._by_example
        weight_of = np.zeros(len(self.term_weight))
        for start in range(0, len(vectors), TEXTS_AT_ONCE):
            some = vectors[start : start + TEXTS_AT_ONCE]
            for (t, w), scores in zip(some, self._nearly(some), strict=True):
                last = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
                ids = np.flatnonzero((scores >= last * (1 - 2 * ROUNDING * (len(t) + 4))) & (scores > 0))
                numbers, sizes = _ranges(first[ids], first[ids + 1])
                weight_of[t] = w
                exact = np.bincount(np.repeat(np.arange(len(ids)), sizes), weight_of[terms[numbers]] * weights[numbers], len(ids))
                weight_of[t] = 0
                best = np.lexsort((self.doc_ids[ids], -exact))[:k]
                yield ids[best], exact[best]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """`all_nearest` of one vector."""
        return next(self.all_nearest([(t, w)], k))

    def vote(self, ids: np.ndarray, similarity: np.ndarray) -> float:
        return float((similarity * self.labels[ids]).sum() / similarity.sum()) if len(ids) else 0.0

    def votes_of_others(self, ids: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[float]:
        """The votes on the examples `ids`, which have these vectors, of the others."""
        for i, (near, similarity) in zip(ids, self.all_nearest(vectors, NEIGHBOURS + 1), strict=True):
            others = near != i
            yield self.vote(near[others][:NEIGHBOURS], similarity[others][:NEIGHBOURS])

    def chance(self, ids: np.ndarray, similarity: np.ndarray) -> float:
        if not len(self.votes):
            return 0.0
        return float(np.interp(self.vote(ids, similarity), self.votes, self.chances))


Counts = dict[int, int] | tuple[np.ndarray, np.ndarray]


def _sorted_counts(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms, ascending, and how often each stands in a text."""
    if isinstance(counts, tuple):
        return counts
    t = np.fromiter(sorted(counts), np.int64, len(counts))
    return t, np.array([counts[i] for i in t.tolist()], np.int64)


def _vector(term_weight: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector as (terms, weights), terms ascending; without terms it is empty."""
    t, n = _sorted_counts(counts)
    w = (1 + np.log(n.astype(np.float64))) * term_weight[t]
    return t, w / max(float(np.sqrt((w * w).sum())), 1e-300)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on x, as points to interpolate.

    Each level stands at the mean of its x, so that it rises between levels, and is shrunk by one imagined row at its mean.
    """
    order = np.argsort(x, kind="stable")
    levels: list[list[float]] = []  # sum of y, count, sum of x, highest x
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        levels.append([yi, 1, xi, xi])
        while len(levels) > 1 and (
            levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1] or levels[-2][3] == xi
        ):
            s, n, sx, high = levels.pop()
            levels[-1] = [levels[-1][0] + s, levels[-1][1] + n, levels[-1][2] + sx, high]
    xs = np.array([sx / n for _, n, sx, _ in levels])
    ys = np.array([(s + 0.5) / (n + 1) for s, n, _, _ in levels])
    return xs, np.maximum.accumulate(ys) if levels else ys


def label_gain(rows: list[tuple[int, int, Counts]], terms: int) -> np.ndarray:
    """Of each term, the likelihood ratio of its examples' labels against the labels' shares."""
    n = np.zeros((2, terms))
    for label in (0, 1):
        held = [_sorted_counts(counts)[0] for _, y, counts in rows if y == label]
        n[label] = np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=terms)
    share = sum(y for _, y, _ in rows) / max(len(rows), 1)
    expected = n.sum(axis=0) * np.array([[1 - share], [share]])
    seen = n > 0
    return 2 * np.where(seen, n * np.log(np.where(seen, n, 1) / np.where(seen, expected, 1)), 0).sum(axis=0)


def build(
    rows: list[tuple[int, int, Counts]], vocabulary: list[str], doc_freq: np.ndarray, docs: int
) -> tuple[Examples, list[tuple[np.ndarray, np.ndarray]]]:
    """Index, not yet calibrated, and the examples' vectors, from (doc_id, label, term counts) of the examples.

    `doc_freq` counts, of `docs` texts, those that hold a term. A word keeps half of its IDF where its label gain is
    what the best of as many words without bearing would reach by chance, and soon all or the damped share beside it.
    """
    rows = [(doc_id, label, _sorted_counts(counts)) for doc_id, label, counts in rows]
    same = Counter((r[0], r[1]) for r in rows)
    rows = sorted(rows, key=lambda r: (r[0], r[1], np.stack(r[2], 1).tolist() if same[r[0], r[1]] > 1 else []))
    n, v = len(rows), len(vocabulary)
    chance = 2 * np.log(max(v, 2))
    bearing = 1 / (1 + (chance / np.maximum(label_gain(rows, v), 1e-9)) ** 4)
    term_weight = np.log1p(docs / np.maximum(doc_freq, 1)) * (DAMPED + (1 - DAMPED) * bearing)
    vectors = [_vector(term_weight, counts) for _, _, counts in rows]
    # Ties between examples of one doc_id are settled by their order.
    heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
    order = sorted(range(n), key=lambda i: (rows[i][1], -bearing[heaviest[i]] if v else 0, heaviest[i], i))
    rows, vectors = [rows[i] for i in order], [vectors[i] for i in order]
    members = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
    of_term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in vectors]])
    weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
    by_term = np.lexsort((members, of_term))
    of_term, members, weights = of_term[by_term], members[by_term], weights[by_term]
    index = Examples(
        vocabulary={term: i for i, term in enumerate(vocabulary)},
        term_weight=term_weight,
        doc_ids=np.array([r[0] for r in rows], np.int64),
        labels=np.array([r[1] for r in rows], np.float64),
        postings=np.searchsorted(of_term, np.arange(v + 1)),
        members=members,
        weights=weights,
    )
    return index, vectors


def calibrate(index: Examples, votes: np.ndarray) -> None:
    """Probabilities from the votes of the others on each example."""
    index.votes, index.chances = _isotonic(votes, index.labels)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Examples:
    """Examples from at most `sample_docs` labelled rows that are not held out, of at most `sample_chars` characters.

    They are taken by a hash of doc_id, then by doc_id, text and label, so they do not depend on the order of the rows.
    Exact copies of a text under one label count once. Without labelled rows nothing is known, and every score is 0.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = (
        known.select("doc_id", F.col("toxic").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label")
        .limit(sample_docs)
    )
    # Bounded by sample_docs ids, so it is safe to broadcast; documents repeated under one id are bounded once more.
    found = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("_h", "_label")
        .agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text")).alias("_chars"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_h", "_label")
        .limit(sample_docs)
    )
    taken, chars = [], 0
    for r in found.collect():
        chars += r["_chars"] or 0
        if chars > sample_chars:
            break
        taken.append((r["doc_id"], r["_h"], r["_label"]))
    spark = docs.sparkSession
    first = spark.createDataFrame(taken, "doc_id long, _h long, _label int")
    rows = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
        .join(F.broadcast(first), ["doc_id", "_h"])
        .dropDuplicates(["_h", "_label"])
        .select("doc_id", "text", "_label")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(words(text)) for text in arrow.strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("_label").cast(pa.int32()),
                    pa.array([list(c) for c in counts], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                names=["doc_id", "label", "words", "n"],
            )

    sample = rows.mapInArrow(count, "doc_id long, label int, words array<string>, n array<long>").toArrow()
    vocabulary, examples = _numbered(sample)
    del sample
    held = np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for _, _, (t, _) in examples]]), minlength=len(vocabulary))
    # Words that are looked up most stand together in memory.
    numbers = {vocabulary[i]: i for i in np.argsort(-held, kind="stable").tolist()}
    doc_freq, total = _document_frequency(docs, numbers)
    del numbers
    index, vectors = build(examples, vocabulary, doc_freq, total)
    del examples
    calibrate(index, _votes(spark, index, vectors))
    return index


def _numbered(sample: pa.Table) -> tuple[list[str], list[tuple[int, int, Counts]]]:
    """All words in order, and the rows of `build`. A word is one string however many examples hold it."""
    listed = sample["words"].combine_chunks()
    words = listed.flatten().dictionary_encode()
    vocabulary = words.dictionary.to_pylist()
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    terms, times = number[words.indices.to_numpy()], sample["n"].combine_chunks().flatten().to_numpy()
    ends = np.cumsum(pa.compute.list_value_length(listed).to_numpy()).tolist()
    examples = []
    for doc_id, label, i, j in zip(sample["doc_id"].to_pylist(), sample["label"].to_pylist(), [0, *ends], ends):
        ascending = i + np.argsort(terms[i:j])
        examples.append((doc_id, label, (terms[ascending], times[ascending])))
    return [vocabulary[i] for i in order], examples


def _document_frequency(docs: DataFrame, numbers: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all texts each term stands, and the number of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # bounded by the characters of the examples
    terms = len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, seen, texts = shared.value, np.zeros(terms + 1, np.int64), 0
        for whole in batches:
            for batch in arrow.pieces(whole, "text"):
                for text in arrow.strings(batch.column("text")):
                    held = [numbers[word] for word in set(words(text)) if word in numbers]
                    seen[held] += 1
                texts += batch.num_rows
        seen[terms] = texts
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = np.zeros(terms + 1)
    for batch in counted.toArrow().to_batches():  # at most one row a term
        totals[batch.column("term").to_numpy()] = batch.column("n").to_numpy()
    shared.destroy()
    return totals[:terms], int(totals[terms])


def _votes(spark: SparkSession, index: Examples, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The vote of the others on each example, a slice of examples a task."""
    # Bounded by the characters of the examples; their vectors are numbers, so the words stay.
    shared = spark.sparkContext.broadcast((replace(index, vocabulary={}), vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors = shared.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            votes = pa.array(list(index.votes_of_others(ids, [vectors[i] for i in ids])), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), votes], names=["id", "vote"])

    votes = np.zeros(len(vectors))
    tasks = min(max(spark.sparkContext.defaultParallelism, 1), len(vectors) // SLICE + 1)
    for r in spark.range(0, len(vectors), 1, tasks).mapInArrow(run, "id long, vote double").collect():
        votes[r["id"]] = r["vote"]
    shared.destroy()
    return votes


def score(docs: DataFrame, examples: Examples, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, score, predicted and evidence (doc_id, label and cosine of the nearest examples).

    The cosine is over the terms; words in no example are like none of them. Null and empty texts, like all texts that
    share no word with an example, have no neighbours: their vote is 0 and their evidence is empty. Without any
    example the score is 0. Repeated rows score alike; texts of any length are read whole; ties between examples go to
    the smaller doc_id; other columns are carried or ignored as `keep` says.
    """
    keep = keep or []
    slim = docs.select(*keep, F.col("text").alias("_text"))
    kind = "array<struct<doc_id:bigint,label:int,similarity:double>>"
    schema = slim.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast(kind).alias("evidence")).schema
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(examples)  # bounded by SAMPLE_DOCS and SAMPLE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value

        def judged_alike(texts: list[str]) -> Iterator[tuple[float, list[dict]]]:
            for ids, similarity in index.all_nearest([index.vector(index.counts(text)) for text in texts], NEIGHBOURS):
                shown = [
                    {"doc_id": int(index.doc_ids[i]), "label": int(index.labels[i]), "similarity": float(s)}
                    for i, s in zip(ids[:EVIDENCE], similarity[:EVIDENCE], strict=True)
                ]
                yield index.chance(ids, similarity), shown

        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                texts = arrow.strings(batch.column("_text"))
                distinct = list(dict.fromkeys(texts))
                once = dict(zip(distinct, judged_alike(distinct), strict=True))
                judged = [once[text] for text in texts]
                scores = np.array([j[0] for j in judged])
                columns = [batch.column(k) for k in keep]
                columns += [
                    pa.array(scores),
                    pa.array((scores >= TOXIC).astype(np.int32)),
                    pa.array([j[1] for j in judged], evidence_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted", "evidence"])

    return slim.mapInArrow(run, schema)
