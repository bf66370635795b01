"""Personal data by boosted trees over candidate spans, on top of exact base rules.

Generators propose overlapping spans that look like emails, addresses, cards and phones in any spelling. Trees judge
them by format and context. They learn from the texts themselves: spans of the base rules are positive, also respelt
(" at ", "(dot)", other separators, no plus sign) in their own context; look-alikes that fail the rules, respelt the
same way, are negative. A kind's threshold is the lowest chance at which the candidates of all held-back documents
of the table are precise enough.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.llm import arrow, boosting
from slink.llm.pii_rules import KINDS, Span, base_spans, digits_of, listed, luhn, small
from slink.operators.grouping import top_k_per_group

SAMPLE_DOCS = 6000  # documents whose candidates the trees are fitted on, at most
SAMPLE_CANDIDATES = 30_000  # candidates, respelt ones included, at most; each kind and verdict has an equal quota
PRECISION = 0.995
LEAST_PROVEN = 20  # held-back positives that a threshold needs
FALLBACK = 0.98  # least chance for a kind that has fewer
HELD_BACK = 3  # one text of so many, by its checksum, is held back from the trees
STEPS = 1024  # chances are counted in steps; a power of two, so that a step is exact
CONTEXT = 24
LONGEST_PART = 64

_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s|\sAT\s", re.ASCII)
_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?$", re.ASCII)
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s|\sDOT\s)"
_RIGHT = re.compile(rf"\s?[A-Za-z0-9-]{{1,64}}(?:{_DOT}[A-Za-z0-9-]{{1,64}}){{1,8}}", re.ASCII)
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20()._/-]{0,3}[0-9]){6,24}(?![0-9A-Za-z])")
_QUAD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\sdot\s)\s?[0-9]{1,3}){3}(?![0-9A-Za-z.])", re.ASCII)
_GROUPS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[^\W\d_]+")


class Taken:
    """Disjoint stretches of a text that are already spoken for."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans, key=lambda s: s[0]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2]) - 1
        return at >= 0 and self.ends[at] > span[0]

    def add(self, span: Span) -> None:
        """Take a span that touches none."""
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[2])


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data, whatever their spelling."""
    found: set[Span] = set()
    for m in _AT.finditer(text):
        left = _LEFT.search(text, max(0, m.start() - LONGEST_PART - 1), m.start())
        right = _RIGHT.match(text, m.end()) if left else None
        if right:
            found.add((left.start(), "email", right.end()))
    for m in _QUAD.finditer(text):
        found.add((m.start(), "ip", m.end()))
    for m in _NUMBER.finditer(text):
        n = len(digits_of(m[0]))
        if 12 <= n <= 19:
            found.add((m.start(), "card", m.end()))
        if 9 <= n <= 15:
            found.add((m.start(), "phone", m.end()))
    return sorted(found)


def features(text: str, span: Span) -> list[float]:
    """Format of a span and its context."""
    start, kind, end = span
    own = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = digits_of(own)
    groups = [len(g) for g in _GROUPS.findall(own)]
    parts = own.replace("[", "").replace("]", "").replace("(", "").replace(")", "").split(".")
    near = _WORDS.findall(before.lower())[-1:] + _WORDS.findall(after.lower())[:1]
    around = before + after
    return [
        *(float(kind == k) for k in KINDS),
        len(own),
        len(digits),
        len(digits) / len(own),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
        float(len(groups) == 4 and all(small(g) for g in _GROUPS.findall(own))),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        float("+" in own),
        float("@" in own),
        float("(" in own or "[" in own),
        own.count(" "),
        own.count("-"),
        own.count("."),
        own.count("/") + own.count("_"),
        len(parts[-1]),
        float(bool(re.search(r"\bdot\b|\bDOT\b", own))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "\"'=:"),
        float(after[:1] in "\"'=:/"),
        sum(c.isdigit() for c in around) / max(1, len(around)),
        sum(c.isupper() for c in around) / max(1, len(around)),
        float(any(w.startswith(("mail", "contact", "write", "tel", "phone", "call", "fax", "mobil")) for w in near)),
        float(any(w.startswith(("card", "visa", "pay", "account", "ip", "host", "server", "addr")) for w in near)),
        float(any(w.startswith(("version", "ver", "isbn", "order", "no", "id", "build", "section")) for w in near)),
    ]


def _respelt(own: str, kind: str, turn: int) -> str:
    """The span in another spelling."""
    if kind == "email":
        at, dot = ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" @ ", "."))[turn % 4]
        local, _, domain = own.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return own.replace(".", ("[.]", "(.)", " . ", ".")[turn % 4])
    if kind == "card":
        digits = digits_of(own)
        return ("." if turn % 2 else "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    plain = own.lstrip("+")
    return (plain, "00" + plain, plain.replace(" ", "."), plain.replace(" ", "/"))[turn % 4]


def examples(text: str) -> list[tuple[list[float], bool, str]]:
    """Features, verdict and kind of a text's candidates, as they stand and respelt."""
    base = set(base_spans(text))
    taken = Taken(list(base))
    out = []
    for turn, span in enumerate(sorted(base | set(candidates(text)))):
        start, kind, end = span
        good = span in base
        # A candidate that only touches a true span is no clear example of either side.
        if not good and taken.touches(span):
            continue
        out.append((features(text, span), good, kind))
        window = text[max(0, start - 200) : start]
        own = _respelt(text[start:end], kind, turn + start)
        moved = (len(window), kind, len(window) + len(own))
        if good or turn % 2:
            out.append((features(window + own + text[end : end + 200], moved), good, kind))
    return out


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates that the trees select and that no base span overlaps."""
        taken = Taken(base)
        proposed = [c for c in candidates(text) if not taken.touches(c)]
        if not proposed:
            return []
        chances = self.trees.chance(np.array([features(text, c) for c in proposed]))
        chosen: list[Span] = []
        for i in np.argsort(-chances, kind="stable"):
            span = proposed[i]
            if chances[i] >= self.thresholds[span[1]] and not taken.touches(span):
                chosen.append(span)
                taken.add(span)
        return chosen

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans, each by start and then kind as listed."""
        base = base_spans(text)
        every = sorted(base + self.added(text, base), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
        return base, every


def thresholds(counts: dict[tuple[str, int, bool], int]) -> dict[str, float]:
    """Threshold of each kind from held-back candidates counted by (kind, step of the chance, verdict).

    A kind with too few positives to prove one takes FALLBACK, or the chance above all of its own look-alikes if that
    is higher. A kind with enough positives of which no threshold is precise adds nothing.
    """
    found = {}
    for kind in KINDS:
        steps = np.array(sorted({step for k, step, _ in counts if k == kind}, reverse=True), np.int64)
        right, wrong = (np.array([counts.get((kind, int(s), y), 0) for s in steps], np.int64) for y in (True, False))
        if right.sum() < LEAST_PROVEN:
            above = (steps[wrong > 0].max(initial=-1) + 1) / STEPS
            found[kind] = max(FALLBACK, float(above))
            continue
        good, bad = np.cumsum(right), np.cumsum(wrong)
        proven = np.flatnonzero((good >= LEAST_PROVEN) & (good >= PRECISION * (good + bad)))
        found[kind] = max(float(steps[proven[-1]]) / STEPS, 0.5) if len(proven) else np.inf
    return found


def _checksum() -> Column:
    return F.crc32(F.col("text").cast("binary")) % HELD_BACK


def calibration(docs: DataFrame, trees: boosting.Trees) -> dict[tuple[str, int, bool], int]:
    """Candidates of all held-back documents, counted by kind, step of the chance and verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded: forty small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for batch in arrow.pieces(whole, "text"):
                found = [e for text in arrow.strings(batch.column("text")) for e in examples(text)]
                if found:
                    steps = np.floor(shared.value.chance(np.array([f[0] for f in found])) * STEPS).astype(int)
                    counts.update((f[2], int(s), f[1]) for f, s in zip(found, steps, strict=True))
        # At most one row per kind, step and verdict leaves a task.
        rows = [(*key, n) for key, n in sorted(counts.items())]
        types = (("kind", pa.string()), ("step", pa.int64()), ("y", pa.bool_()), ("n", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

    held = docs.filter(_checksum() == 0).select("text").mapInArrow(run, "kind string, step long, y boolean, n long")
    return {(r["kind"], r["step"], r["y"]): r["n"] for r in held.groupBy("kind", "step", "y").agg(F.sum("n").alias("n")).collect()}


def sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """Candidates (x, y, kind) that the trees are fitted on; the same for any partitioning.

    Of the texts not held back those of `sample_docs` documents are read, by a hash of doc_id, and of their candidates
    an equal quota of each kind and verdict is taken, by a hash of the text and the place in it.
    """
    fitted = docs.filter(_checksum() != 0).select("doc_id", "text")
    chosen = fitted.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # Bounded by sample_docs ids, so it is safe to broadcast.
    rows = fitted.join(F.broadcast(chosen.distinct()), "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "text"):
                found = []
                for text in arrow.strings(batch.column("text")):
                    own = hashlib.sha256(text.encode()).digest()
                    for i, (x, y, kind) in enumerate(examples(text)):
                        digest = hashlib.blake2b(i.to_bytes(8), key=own, digest_size=8).digest()
                        found.append((x, y, kind, int.from_bytes(digest, signed=True)))
                types = (("x", pa.list_(pa.float64())), ("y", pa.bool_()), ("kind", pa.string()), ("h", pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

    every = rows.mapInArrow(run, "x array<double>, y boolean, kind string, h long")
    quota = SAMPLE_CANDIDATES // (2 * len(KINDS))
    return top_k_per_group(every, ["kind", "y"], [F.col("h"), F.col("x")], quota, salt_by=["h"]).select("x", "y", "kind")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Trees learned from a bounded sample of `docs`, thresholds from all its held-back documents.

    Without candidates of both verdicts nothing is learned, and all kinds keep their base spans only.
    """
    rows = sorted((r["x"], r["y"], r["kind"]) for r in sample(docs, sample_docs).collect())
    y = np.array([r[1] for r in rows], np.float64)
    if len(np.unique(y)) < 2:
        empty = boosting.Trees(np.zeros((0, 7), np.int64), np.zeros((0, 7)), np.zeros((0, 8)), 0.0)
        return Model(empty, dict.fromkeys(KINDS, np.inf))
    trees = boosting.train(np.array([r[0] for r in rows]), y)
    return Model(trees, thresholds(calibration(docs, trees)))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    reach = 0
    for start, kind, end in spans:
        if start >= reach or not out:
            out += [text[at:start], f"[{kind.upper()}]"]
        reach = at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: Model, keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """`keep` columns, counts and digest of the base spans, and all spans of each row of `docs` (text).

    With `redact` the text without its spans comes along under that name (a null text stays null). Null and empty
    texts have no spans; texts of any length are read whole; repeated rows give the same spans; other columns are
    carried or ignored as `keep` says.
    """
    keep = keep or []
    slim = docs.select(*keep, F.col("text").alias("_text"))
    names = [f"n_{k}" for k in KINDS]
    types = ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string"
    fields = F.from_json(F.lit(None).cast("string"), types)
    shown = [fields[n].alias(n) for n in [*names, "base_sha256", "spans"]]
    schema = slim.select(*keep, *shown, *([F.col("_text").alias(redact)] if redact else [])).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: forty small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                texts = batch.column("_text").to_pylist()
                spans = [shared.value.spans(t or "") for t in texts]
                columns = [batch.column(k) for k in keep]
                for kind in KINDS:
                    columns.append(pa.array([sum(s[1] == kind for s in base) for base, _ in spans], pa.int64()))
                digests = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in spans]
                columns += [pa.array(digests, pa.string()), pa.array([listed(every) for _, every in spans], pa.string())]
                if redact:
                    clean = [t if t is None else redacted(t, every) for t, (_, every) in zip(texts, spans, strict=True)]
                    columns.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
