"""Document quality by gated attention over passages (multiple-instance learning).

Every passage of a text becomes a vector of character and word statistics. A small network encodes each vector, a
gate learns from the document labels how much each passage counts, and the weighted sum of the encoded passages is
scored. The network is fitted on a bounded sample of labelled rows and applied to whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slink.llm import arrow

PASSAGE_WORDS = 48
SAMPLE_DOCS = 4000  # labelled rows that the network is fitted on, at most
SAMPLE_PASSAGES = 64  # evenly spaced passages of a fitted row, at most; scoring takes all
HIDDEN = 24
STEPS = 160
ACCEPT = 0.7
WINDOW_CHARS = 1 << 20
ENCODED_CHARS = 1 << 17  # a step that stays in the processor's cache

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _kinds() -> np.ndarray:
    """Class of each byte: lower and upper letters one by one, and kinds of the other characters."""
    kinds = np.full(256, KINDS - 1, np.int64)
    kinds[97:123] = np.arange(26)
    kinds[65:91] = np.arange(26, 52)
    kinds[128:] = 52
    kinds[48:58] = 53
    for kind, characters in enumerate((b"#*$%&<>", b"!?", b"|", b".,;:", b"\n", b" \t\r\x0b\x0c"), start=54):
        kinds[list(characters)] = kind
    return kinds


KINDS = 61
_KIND = _kinds()
FEATURES = KINDS - 26 + 10


def _windows(text: str) -> list[bytes]:
    """The text in pieces of bounded size, cut at blanks where there are any, without white space at their ends."""
    out, start = [], 0
    while len(text) - start > WINDOW_CHARS:
        cut = text.rfind(" ", start, start + WINDOW_CHARS)
        cut = start + WINDOW_CHARS if cut <= start else cut
        out.append(text[start:cut].encode().strip())
        start = cut
    out.append(text[start:].encode().strip())
    return out


def _encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the passages of all chunks, and each passage's chunk."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    ends = np.cumsum([len(c) for c in chunks])
    filled = ~_SPACE[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[np.r_[0, ends]] = True
    begins = np.flatnonzero(filled & (np.r_[True, ~filled[:-1]] | edges[:-1]))
    if not len(begins):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    sizes = np.flatnonzero(filled & (np.r_[~filled[1:], True] | edges[1:])) - begins + 1
    chunk = np.searchsorted(ends, begins, side="right")
    words = len(begins)
    opens = (np.arange(words) - np.searchsorted(chunk, chunk)) % PASSAGE_WORDS == 0
    heads = np.flatnonzero(opens)
    passage = np.cumsum(opens) - 1
    count = len(heads)
    n_words = np.diff(np.r_[heads, words]).astype(np.float64)

    # A word's hash: its size, the sum of its bytes, and the sum of its bytes by place.
    values = np.where(filled, data, 0).astype(np.int64)
    plain = np.add.reduceat(values, begins)
    placed = np.add.reduceat(values * np.arange(len(data)), begins) - begins * plain
    hashes = (plain * 1000003 + placed) * 64 + np.minimum(sizes, 63)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & ~opens[1:]]
    distinct = np.unique(passage * (1 << 44) + hashes % (1 << 44)) >> 44

    def mean(of_words: np.ndarray) -> np.ndarray:
        return np.bincount(passage, of_words, count) / n_words

    starts = begins[heads]
    base = np.repeat(np.arange(count) * KINDS, np.diff(np.r_[starts, len(data)]))
    kinds = np.bincount(base + _KIND[data[starts[0] :]], minlength=count * KINDS).reshape(count, KINDS)
    length = kinds.sum(axis=1)
    upper = kinds[:, 26:52].sum(axis=1)
    folded = np.concatenate([kinds[:, :26] + kinds[:, 26:52], kinds[:, 52:]], axis=1)
    leading = data[begins]
    columns = [
        mean(np.minimum(sizes, 40)) / 10,
        mean(same),
        np.bincount(distinct, minlength=count) / n_words,
        mean(sizes <= 3),
        mean(sizes >= 12),
        mean(sizes == 1),
        mean((leading >= 65) & (leading <= 90)),
        upper / np.maximum(folded[:, :26].sum(axis=1), 1),
        n_words / PASSAGE_WORDS,
        np.log1p(length) / 5,
    ]
    stacked = np.concatenate([folded / length[:, None], np.stack(columns, axis=1)], axis=1)
    return stacked.astype(np.float32), chunk[heads]


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages of all texts, and the text that each belongs to."""
    found, owners = [np.zeros((0, FEATURES), np.float32)], [np.zeros(0, np.int64)]
    chunks, of, held = [], [], 0

    def flush() -> None:
        if chunks:
            rows, chunk = _encode(chunks)
            found.append(rows)
            owners.append(np.array(of)[chunk] if len(chunk) else np.zeros(0, np.int64))

    for i, text in enumerate(texts):
        for window in _windows(text):
            chunks.append(window)
            of.append(i)
            held += len(window)
            if held > ENCODED_CHARS:
                flush()
                chunks, of, held = [], [], 0
    flush()
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Network:
    """Weights of the encoder, the gate and the score; `prior` answers where nothing could be fitted.

    A text without passages is a bag of its own kind, which has nothing but its indicator: `empty` is its fitted score.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float
    constant: bool
    empty: float

    def score(self, rows: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
        scores = np.full(texts, self.empty)
        if not len(rows):
            return scores
        known, bags = np.unique(owners, return_inverse=True)
        if self.constant:
            scores[known] = self.prior
            return scores
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        scores[known] = _forward(self.weights, x, bags, len(known))["score"]
        return scores


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, count: int) -> dict[str, np.ndarray]:
    """Encode, weigh by the gate, sum and score; `bags` ascend."""
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    value, gate = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    logit = (value * gate) @ w["attend"]
    starts = np.searchsorted(bags, np.arange(count))
    e = np.exp(logit - np.maximum.reduceat(logit, starts)[bags])
    a = e / np.add.reduceat(e, starts)[bags]
    z = np.add.reduceat(a[:, None] * h, starts)
    score = _sigmoid((z @ w["out"] + w["out_bias"]).astype(np.float64))
    return {"h": h, "value": value, "gate": gate, "a": a, "z": z, "score": score}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, bags, len(labels))
    error = ((f["score"] - labels) / len(labels)).astype(np.float32)
    dz = error[:, None] * w["out"][None, :]
    pulled = (dz[bags] * f["h"]).sum(axis=1)
    starts = np.searchsorted(bags, np.arange(len(labels)))
    dlogit = f["a"] * (pulled - np.add.reduceat(f["a"] * pulled, starts)[bags])
    both = dlogit[:, None] * w["attend"][None, :]
    dvalue = both * f["gate"] * (1 - f["value"] ** 2)
    dgate = both * f["value"] * f["gate"] * (1 - f["gate"])
    dh = f["a"][:, None] * dz[bags] + dvalue @ w["value"].T + dgate @ w["gate"].T
    dh *= 1 - f["h"] ** 2
    return {
        "encode": x.T @ dh,
        "encode_bias": dh.sum(axis=0),
        "value": f["h"].T @ dvalue,
        "gate": f["h"].T @ dgate,
        "attend": (f["value"] * f["gate"]).T @ dlogit,
        "out": f["z"].T @ error,
        "out_bias": error.sum(keepdims=True),
    }


def train(rows: np.ndarray, owners: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Network:
    """Fit the network with Adam on labelled bags of passages; deterministic.

    Without labelled rows nothing speaks against a text, so every score is 1; with one class it is that class's share.
    Labelled texts without passages fit the score of such texts (one imagined row of each label): half without any.
    """
    without = np.ones(len(labels), bool)
    without[owners] = False
    empty = float((labels[without].sum() + 1) / (without.sum() + 2))
    prior = float((labels.sum() + 1) / (len(labels) + 1))
    constant = not len(rows) or len(np.unique(labels)) < 2
    mean = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES, np.float32)
    scale = rows.std(axis=0) + np.float32(1e-3) if len(rows) else np.ones(FEATURES, np.float32)
    if constant:
        return Network(mean, scale, {}, prior, True, empty)
    random = np.random.default_rng(7)

    def matrix(*shape: int) -> np.ndarray:
        return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {
        "encode": matrix(FEATURES, HIDDEN),
        "encode_bias": np.zeros(HIDDEN, np.float32),
        "value": matrix(HIDDEN, HIDDEN),
        "gate": matrix(HIDDEN, HIDDEN),
        "attend": matrix(HIDDEN),
        "out": matrix(HIDDEN),
        "out_bias": np.full(1, np.log(prior / max(1 - prior, 1e-6)), np.float32),
    }
    x = np.clip((rows - mean) / scale, -6, 6)
    known, bags = np.unique(owners, return_inverse=True)
    labels = labels[known]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    for step in range(1, steps + 1):
        for k, g in _gradients(w, x, bags, labels).items():
            g = g + 1e-4 * w[k]
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[k] = w[k] - (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(mean, scale, w, prior, False, empty)


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of every fit; a null id is never held out (and has no label)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """Network fitted on at most `sample_docs` labelled rows that are not held out.

    They are taken by a hash of doc_id, then by doc_id, text and label, repeated rows once, and enter the fit in that
    order, so the weights do not depend on the order of the rows.
    """
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col("quality").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label")
        .limit(sample_docs)
    )
    # Bounded by sample_docs ids, so both are safe to broadcast; documents repeated under one id are bounded once more.
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    taken = (
        hashed.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "_h", "_label")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_h", "_label")
        .limit(sample_docs)
    )
    rows = hashed.join(F.broadcast(taken), ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h", "_label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "text"):
                found, owners = passages(arrow.strings(batch.column("text")))
                packed = []
                for i in range(batch.num_rows):
                    own = found[owners == i]
                    step = max(1, -(-len(own) // SAMPLE_PASSAGES))
                    packed.append(own[::step].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        batch.column("_h"),
                        pa.array(packed, pa.binary()),
                        batch.column("_label").cast(pa.int32()),
                    ],
                    names=["doc_id", "h", "rows", "label"],
                )

    sample = rows.mapInArrow(run, "doc_id long, h long, rows binary, label int").collect()  # sample_docs rows at most
    sample.sort(key=lambda r: (r["doc_id"], r["h"], r["label"]))
    bags = [np.frombuffer(r["rows"], "<f4").reshape(-1, FEATURES) for r in sample]
    stacked = np.concatenate([np.zeros((0, FEATURES), np.float32), *bags])
    owners = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return train(stacked, owners, np.array([r["label"] for r in sample], np.float64))


def score(docs: DataFrame, network: Network, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, score and predicted of each row of `docs` (text).

    A null, empty or blank text has no passages; it gets the score fitted on such texts alone, and half, which is not
    accepted, where no label speaks of one. Texts of any length are scored whole, in windows of bounded size; repeated rows score alike; other columns are carried or ignored as `keep` says.
    """
    keep = keep or []
    slim = docs.select(*keep, F.col("text").alias("_text"))
    schema = slim.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    shared = docs.sparkSession.sparkContext.broadcast(network)  # bounded: some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.pieces(whole, "_text"):
                rows, owners = passages(arrow.strings(batch.column("_text")))
                scores = shared.value.score(rows, owners, batch.num_rows)
                columns = [batch.column(k) for k in keep]
                columns += [pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    return slim.mapInArrow(run, schema)
