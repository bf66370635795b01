"""Licence notices by a positional index of rare words.

The index holds, for each word of the templates, the places where it stands in each of them. A file's licence words
are ordered by inverse document frequency over the whole corpus; of those that a template holds the rarest are looked
up, and their places in the file less their places in the template must agree on one start of the template. At each
such start the template's words are compared, weighted by their rarity, and its key phrases must stand there in full.

A template that has to stand word for word is found wherever it stands: all its words are in the file then, so the
rarest of them mark every place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slink.llm import arrow
from slink.llm.licence_templates import NOTICES, PHRASES

RAREST = 4  # words of a template that are looked up
LEAST_SHARE = 0.8  # of the weight of a template's words
SLACK_WORDS = 10  # a word may be moved by one place for each so many words of the template
# Words are runs of bytes that are digits, letters (A-Z become a-z) or not ASCII.
_WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    """A notice; `exact` ones count only word for word."""

    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    exact: bool

    @property
    def slack(self) -> int:
        return 0 if self.exact else len(self.words) // SLACK_WORDS


@dataclass(frozen=True)
class Match:
    """A place of a template: first and last word of the file, and the share of the template's weight found there."""

    template: int
    start: int
    end: int
    share: float


def templates(phrases: Iterable[tuple] = PHRASES, notices: Iterable[tuple] = NOTICES) -> list[Template]:
    split = lambda text: tuple(words_of(text))
    found = [Template(label, split(text), (split(text),), True) for label, text in phrases]
    return found + [Template(label, split(text), tuple(map(split, keys)), False) for label, text, keys in notices]


class Index:
    """Templates, the places of their words, and the words' weights."""

    def __init__(self, known: list[Template], frequencies: dict[bytes, int], documents: int):
        self.templates = known
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(dict)
        for t, template in enumerate(known):
            for place, word in enumerate(template.words):
                self.postings[word].setdefault(t, []).append(place)
        self.words = frozenset(self.postings)
        self.idf = {w: math.log((documents + 1) / (frequencies.get(w, 0) + 0.5)) + 1e-6 for w in self.words}
        self.weight = [sum(self.idf[w] for w in t.words) for t in known]
        self.needed = [frozenset(w for phrase in t.phrases for w in phrase) for t in known]
        self.rarest = sorted(self.words, key=lambda w: (-self.idf[w], w))

    def find(self, words: list[bytes]) -> list[Match]:
        """All matches in a file, by template and place."""
        present = self.words.intersection(words)
        asked = [t for t, needed in enumerate(self.needed) if needed <= present]
        if not asked:
            return []
        used = frozenset(w for t in asked for w in self.templates[t].words)
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in used:
                places[word].append(i)
        ranked = [w for w in self.rarest if w in places]
        out = []
        for t in asked:
            anchors = [w for w in ranked if t in self.postings[w]][:RAREST]
            out += self._placed(t, words, self._starts(t, anchors, places))
        return out

    def _starts(self, t: int, anchors: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
        """Places of the template's first word on which its rarest words in the file agree."""
        template = self.templates[t]
        offsets = [{p - q for q in self.postings[w][t] for p in places[w]} for w in anchors]
        if template.exact:
            return sorted(set.intersection(*offsets))
        least = (len(anchors) + 1) // 2
        if template.slack == 0:
            votes = Counter(o for some in offsets for o in some)
            return sorted(o for o, n in votes.items() if n >= least)
        said = sorted((o, a) for a, some in enumerate(offsets) for o in some)
        agreed, held, first = [], Counter(), 0
        for offset, anchor in said:
            held[anchor] += 1
            while said[first][0] < offset - template.slack:
                held[said[first][1]] -= 1
                first += 1
            if sum(n > 0 for n in held.values()) >= least:
                agreed.append(offset)
        return sorted(set(agreed))

    def _placed(self, t: int, words: list[bytes], starts: list[int]) -> Iterator[Match]:
        """The best match of each run of starts that lie within the slack of one another."""
        slack, best = self.templates[t].slack, None
        for start in starts:
            match = self._compared(t, words, start)
            if match is None:
                continue
            if best is not None and start - best[0] > slack:
                yield best[1]
                best = None
            if best is None or match.share > best[1].share:
                best = start, match
        if best is not None:
            yield best[1]

    def _compared(self, t: int, words: list[bytes], start: int) -> Match | None:
        template = self.templates[t]
        size, slack = len(template.words), template.slack
        if template.exact:
            there = start >= 0 and tuple(words[start : start + size]) == template.words
            return Match(t, start, start + size - 1, 1.0) if there else None
        low = max(0, start - slack)
        window = words[low : start + size + slack]
        found, first, last = 0.0, None, None
        for place, word in enumerate(template.words):
            # The nearest of the places where the word may stand.
            for move in sorted(range(-slack, slack + 1), key=abs):
                at = start + place + move - low
                if 0 <= at < len(window) and window[at] == word:
                    found += self.idf[word]
                    first, last = min(at, first if first is not None else at), max(at, last or 0)
                    break
        share = found / self.weight[t]
        if share < LEAST_SHARE or not all(_stands(window, phrase) for phrase in template.phrases):
            return None
        return Match(t, low + first, low + last, min(1.0, share))


def _stands(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    size = len(phrase)
    return any(tuple(words[i : i + size]) == phrase for i in range(len(words) - size + 1) if words[i] == phrase[0])


def build(docs: DataFrame, known: list[Template] | None = None) -> Index:
    """The index, its words weighted by in how many rows of `docs` (text) they stand.

    The counts are of the templates' words alone, so their number does not grow with the corpus. An empty table gives
    equal weights.
    """
    known = known if known is not None else templates()
    asked = frozenset(w for t in known for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                for text in arrow.strings(batch.column("_text")):
                    counts.update(asked.intersection(words_of(text)))
                counts[b""] += batch.num_rows
        columns = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    counts = docs.select(F.col("text").alias("_text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in counts.collect()}
    return Index(known, found, found.get(b"", 0))


def scan(docs: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """`keep` columns, n_words and matches (label, exact, first_word, last_word, share) of every row of `docs` (text).

    Matches are by place, then label; words are counted from 0. Defined cases: null and empty texts have no words and
    no matches; texts of any length are searched whole, and every place of an exact template counts, also of one that
    overlaps another; repeated rows match alike; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    slim = docs.select(F.struct(*keep).alias("_k"), F.col("text").alias("_text"))
    match = "struct<label: string, exact: boolean, first_word: long, last_word: long, share: double>"
    schema = f"_k {slim.schema['_k'].dataType.simpleString()}, n_words long, matches array<{match}>"
    kind = pa.list_(
        pa.struct(
            [("label", pa.string()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                sizes, matches = [], []
                for text in arrow.strings(batch.column("_text")):
                    words = words_of(text)
                    sizes.append(len(words))
                    found = [(index.templates[m.template], m) for m in index.find(words)]
                    rows = [(m.start, t.label, m.end, t.exact, m.share) for t, m in found]
                    matches.append(
                        [dict(label=b, exact=x, first_word=s, last_word=e, share=c) for s, b, e, x, c in sorted(rows)]
                    )
                columns = [batch.column("_k"), pa.array(sizes, pa.int64()), pa.array(matches, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["_k", "n_words", "matches"])

    return slim.mapInArrow(run, schema).select("_k.*", "n_words", "matches")
