"""Licence notices, whitening and token alignment on small tables, against plain versions of the same rules."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slink.llm import licence_index, token_alignment, token_records, whitening
from slink.llm.bpe_fragments import byte_characters, read_spec
from slink.llm.worker import Generations
from test_llm_text_operators import ODD, documents

CLASHING = ["whitened", "deviation", "key", "size", "_k", "_v", "n", "row", "part"]


def test_generations_keep_what_comes_again():
    made = []

    def make(keys):
        made.append(list(keys))
        return [k * 2 for k in keys]

    memory = Generations(6)
    for i in range(20):
        held = memory.holding({1, 2, 100 + i}, make)
        assert held[1] == 2 and held[100 + i] == 200 + 2 * i
    assert sum(k in (1, 2) for keys in made for k in keys) == 2 and len(memory.young) + len(memory.old) <= 10
    assert memory.holding(set(), make) is not None


# --- op11 ------------------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_places(text, phrases):
    words = plain_words(text)
    return sorted((i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def test_exact_phrases_are_found_at_every_place(spark):
    rnd = random.Random(5)
    vocabulary = "cc by CC-BY general Public license all rights reserved All the GNU ünï 42 é".split()
    texts = [" ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", ".\n", "-"]) for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    texts += ["cc by cc by", "CC\x00BY", "general public  license" * 3, "cc", "cc b" + "y" * 50]
    docs = documents(spark, [*ODD, *enumerate(texts, 100)])
    found = licence_index.scan(docs, licence_index.build(docs), ["doc_id", "n", "score"])
    rows = {r.doc_id: r for r in found.collect() if r.doc_id and r.doc_id >= 100}
    for i, text in enumerate(texts, 100):
        got = [(m.first_word, m.label) for m in rows[i].matches if m.exact]
        assert sorted(got) == plain_places(text, licence_index.PHRASES), text
        assert rows[i].n_words == len(plain_words(text))
    odd = [r for r in found.collect() if r.doc_id is None or r.doc_id < 100]
    assert len(odd) == len(ODD) and not any(r.matches for r in odd)
    assert licence_index.scan(documents(spark, []), licence_index.build(documents(spark, [])), ["doc_id"]).count() == 0


def test_notices_are_found_at_the_starts_their_rare_words_agree_on():
    """Every start of every template, compared plainly, against those that the index proposes.

    Whole notices are all found; of those with words left out a start may be missed on which fewer than half of the
    rarest words agree, and nothing is found that does not stand there.
    """
    missed = 0
    rnd = random.Random(6)
    known = licence_index.templates()
    index = licence_index.Index(known, {b"license": 50, b"the": 400, b"of": 390, b"gnu": 3}, 500)
    filler = "the of and river license house software version by public work".split()
    for number in range(120):
        template = known[rnd.randrange(len(known))]
        words = [w for w in template.words if number % 3 == 0 or rnd.random() > 0.04]
        text = [rnd.choice(filler).encode() for _ in range(rnd.randint(0, 40))] + words + [rnd.choice(filler).encode() for _ in range(20)]
        found = {index.templates[m.template].label for m in index.find(text)}
        plain = {
            t.label for n, t in enumerate(known) if any(index._compared(n, text, s) for s in range(-t.slack, len(text)))
        }
        assert found <= plain
        missed += found != plain
        if number % 3 == 0:
            assert found == plain and template.label in found
    assert missed <= 2


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under the Apache License, Version 2.0 (the License)", {"apache-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        ("Licensed under CC BY-SA 4.0.", {"cc-by", "cc-by-sa"}),
        ("The license of the river is under the house.", set()),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", set()),
    ],
)
def test_known_notices(text, labels):
    index = licence_index.Index(licence_index.templates(), {}, 10)
    assert {index.templates[m.template].label for m in index.find(licence_index.words_of(text))} == labels


# --- op12 ------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return made.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def plain_whitening(x):
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, right = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], right[:, ::-1]


@pytest.mark.parametrize("condition", [1.0, 1e-4])
def test_whitening_matches_the_covariance(spark, condition):
    rng = np.random.default_rng(3)
    scales = np.geomspace(1, condition, 7)[rng.permutation(7)] * 900
    data = rng.standard_normal((400, 7)) @ np.linalg.qr(rng.standard_normal((7, 7)))[0] * scales + 40
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000 + i, data[i % 3].tolist()) for i in range(200)]
    rows += [(9000, None), (9001, [1.0, None] + [0.0] * 5), (9002, [float("nan")] * 7), (9003, [float("inf")] * 7), (9004, [1.0, 2.0]), (None, data[0].tolist())]
    table = vectors(spark, rows)
    found = whitening.fit(table)
    x = np.floor(256 * data).astype(np.int64)
    n, sums, values, right = plain_whitening(x)
    assert found.n == n and found.sums == sums.tolist() and found.identity_error < 1e-9
    assert found.eigenvalues == pytest.approx(values[:4], rel=1e-9) and found.trace == pytest.approx(values.sum())
    got = whitening.whiten(table, found, ["vec_id", "n"]).collect()
    assert len(got) == 601 and {r.vec_id for r in got if r.vec_id and r.vec_id >= 9000} == set()
    for r in got[:50]:
        i = 0 if r.vec_id is None else r.vec_id % 1000 % 3 if r.vec_id >= 1000 else r.vec_id
        assert r.deviation == int(((n * x[i].astype(object) - sums) ** 2).sum())
        want = (x[i] - sums / n) @ right[:, :4] / np.sqrt(values[:4])
        assert np.abs(r.whitened) == pytest.approx(np.abs(want), abs=1e-7)


def test_whitening_of_too_few_or_flat_vectors(spark):
    assert whitening.fit(vectors(spark, [(1, None)])) is None
    assert whitening.whiten(vectors(spark, []), None, ["vec_id"]).count() == 0
    single = vectors(spark, [(i, [0.5, 1.0]) for i in range(5)])
    found = whitening.fit(single)
    assert found.n == 1 and len(found.eigenvalues) == 0
    assert [(r.deviation, r.whitened) for r in whitening.whiten(single, found, ["vec_id"]).collect()] == [(0, [])] * 5
    # Two directions of five, one entry constant: the others have no variance and no component.
    rng = np.random.default_rng(8)
    a, b = rng.integers(-9, 9, (2, 80))
    flat = vectors(spark, [(i, [float(p), float(q), float(p + q), 3.0, 0.0]) for i, (p, q) in enumerate(zip(a, b, strict=True))])
    found = whitening.fit(flat)
    assert len(found.eigenvalues) == 2 and found.identity_error < 1e-6


def test_deviations_beyond_64_bits_are_null():
    found = whitening.Whitening(3, [0, 0], np.zeros((2, 0)), np.zeros(0), 1.0, 0.0, 1)
    assert found.deviations(np.array([[1 << 40, 0], [2, 1]])) == [None, 45]


# --- op13 ------------------------------------------------------------------------------------------------------------

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE_OF = {c: b for b, c in byte_characters().items()}


def plain_alignment():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)

    def groups(text):
        """Groups between the offsets where tokens of both end; none where the bytes differ."""
        if not text:
            return []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        spelt_a = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
            return []
        ends_a, ends_b = np.cumsum([len(s) for s in spelt_a]), np.cumsum([len(s) for s in spelt_b])
        cuts = np.array(sorted(set(ends_a.tolist()) & set(ends_b.tolist())))
        found = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for i, g in zip(ids, np.searchsorted(cuts, ends), strict=True):
                found[g][side].append(i)
        return found

    return groups


def alignment_texts():
    rnd = random.Random(7)
    alphabet = ["a", "B", "é", "ß", "日", "🎉", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "ing", "the ", "▁", "<s>", "<|endoftext|>", "\x00", "12", "Straße "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    words = "the river and antidisestablishmentarianism old house\nof it's lamps. ünïcode x1 state-of-the-art".split(" ")
    return texts + [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(60)] + ["x" * 3000, "ab" * 2000, " ", "a ", "\n", "a\n", " a"]


def test_alignment_matches_a_plain_one(spark, monkeypatch):
    groups = plain_alignment()
    texts = alignment_texts()
    rows = [*ODD, *enumerate(texts, 100), (100, texts[0])]
    docs = documents(spark, rows)
    got = token_alignment.Alignment(docs, PATH_A, PATH_B, ["doc_id", "n", "score"]).documents().collect()
    found = [groups(t) for _, t in rows]
    counts = Counter()
    for g in found:
        counts.update({(x, y) for a, b in g for x in a for y in b})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    want = []
    for (i, _), g in zip(rows, found, strict=True):
        pairs = Counter()
        for a, b in g:
            for x, k in Counter(a).items():
                for y, m in Counter(b).items():
                    pairs[x, y] += k * m
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        want.append(
            (
                str(i), sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(pairs.values()),
                sum(m for p, m in pairs.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in pairs.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    have = [(str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got]
    assert sorted(have) == sorted(want)
    assert token_alignment.Alignment(documents(spark, []), PATH_A, PATH_B, ["doc_id"]).documents().count() == 0


def test_small_batches_and_memories_change_nothing(monkeypatch):
    texts = alignment_texts()
    whole = token_alignment.Aligner(read_spec(PATH_A), token_alignment.read_model(PATH_B))
    first = [whole.batch([t])[0][0] for t in texts]
    whole.known = Generations(4)
    assert [s for k in range(0, len(texts), 7) for s in whole.batch(texts[k : k + 7])[0]] == first
    plain = plain_alignment()
    assert all(token_alignment.groups(t, whole) == [(a, b) for a, b in plain(t)] for t in texts)


def test_coalescing_breaks_where_both_end():
    a, b = token_alignment.coalesce(np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 1, 5]), np.array([1, 5, 6]))
    assert a.tolist() == [0, 0, 1] and b.tolist() == [0, 0, 1]


# --- op6's encoder ---------------------------------------------------------------------------------------------------


def test_word_memory_encodes_as_the_library(monkeypatch):
    monkeypatch.setattr(token_records, "REMEMBERED", 50)
    monkeypatch.setattr(token_records, "STEMS", 10)
    library = Tokenizer.from_file(PATH_A)
    encoder = token_records.Encoder(read_spec(PATH_A))
    texts = alignment_texts() + ["don't, can't!! (x) _a_ it's' 'twas Ǆ.ŉ aɐb áb İx ok_then ab12cd ...", "É" * 300]
    for some in (texts, texts[::-1], texts + texts):
        want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode(some) == want


def test_alignment_batches_are_small():
    """A worker holds the links of one batch, some hundred bytes a character."""
    rows = pa.RecordBatch.from_pydict({"_text": ["ab " * 300_000] * 8})
    sizes = [sum(map(len, t.column("_text").to_pylist())) for t in token_alignment._batches(iter([rows]))]
    assert sum(sizes) == 8 * 900_000 and max(sizes) <= 3 << 20


def test_pieces_are_spelt_and_remembered():
    """Groups as text are cut from one row of numbers; a batch's pieces are remembered past the next batch."""
    whole = token_alignment.Aligner(read_spec(PATH_A), token_alignment.read_model(PATH_B))
    pieces = [" one", " naïve", "\n", "  two  spaces", " ", " don't", " İx"]
    plain = plain_alignment()
    for piece, (n_a, n_b, n_groups, n_links, text, _) in zip(pieces, whole.coalesced(pieces), strict=True):
        want = plain(piece[1:]) if piece[0] == " " else None
        if want:
            assert text == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
            assert n_links == sum(len(a) * len(b) for a, b in want)
    asked = []
    by_size = whole._by_size
    whole._by_size = lambda some: asked.extend(some) or by_size(some)
    batches = [[f"w{b}x{i} common{i}" for i in range(60_000)] for b in range(3)]
    for texts in batches:
        whole.batch(texts)
    assert len(asked) == 4 * 60_000
