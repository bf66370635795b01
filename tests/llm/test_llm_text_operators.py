"""Each text operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import bz2
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slink.llm import (
    bpe_fragments,
    pii_boost,
    pii_rules,
    quality_mil,
    quality_rules,
    secret_layers,
    simhash_pivots,
    token_records,
    toxicity_neighbours,
)
from slink.sources.shared import new_path

# Columns that operators use inside, as columns of the input.
CLASHING = ["score", "predicted", "_text", "_h", "_m", "fp", "t", "k", "n", "component_id", "spans", "b", "g", "kind"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(doc_id, text) rows as a table of documents with extra columns of clashing names."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return docs.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING])


PROSE = "the river and the old house of a man was for that in the evening with lamps by it . "
ODD = [
    (None, "no id at all " + PROSE * 3),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, PROSE * 4),
    (4, PROSE * 4),
    (5, PROSE * 4),
    (6, "long " * 60_000 + PROSE),
    (7, "x" * 200_000),
    (8, "é ß 日本語 🎉 " * 30),
]


def random_texts(count, seed, alphabet, longest):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(count)]


# --- op1 -------------------------------------------------------------------------------------------------------------


def quality_tables(spark):
    rnd = random.Random(3)
    words = "the river and old house of man was for evening with lamps by it stone green".split()
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(rnd.choice(words) + ("" if good else rnd.choice("#$%&")) * 3 for _ in range(60))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_from_labels_and_holds_out(spark):
    docs, labels = quality_tables(spark)
    network = quality_mil.fit(docs, labels)
    out = quality_mil.score(docs, network, ["doc_id"]).join(labels, "doc_id")
    rows = out.select("doc_id", quality_mil.held_out().alias("held_out"), "score", "predicted", "quality").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_edges(spark):
    docs, labels = quality_tables(spark)
    network = quality_mil.fit(docs, labels.union(spark.createDataFrame([(None, 1, 0), (5, None, None)], labels.schema)))
    odd = {r["doc_id"]: r for r in quality_mil.score(documents(spark, ODD), network, ["doc_id"]).collect()}
    assert len(odd) == len({i for i, _ in ODD})
    assert {odd[i]["score"] for i in (1, 2, 3)} == {0.5} and odd[1]["predicted"] == 0
    assert odd[4]["score"] == odd[5]["score"]
    assert quality_mil.score(documents(spark, []), network, ["doc_id"]).count() == 0
    unlabelled = quality_mil.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_mil.score(docs, unlabelled, ["doc_id"]).collect()} == {1.0}


def test_quality_of_texts_without_words_is_learnt_from_such_texts(spark):
    docs, labels = quality_tables(spark)
    empty = [i for i in range(1000, 1040) if zlib.crc32(str(i).encode()) % 4 != 2]
    more = docs.union(documents(spark, [(i, None if i % 2 else " ") for i in empty]))
    for label, accepted in ((0, 0), (1, 1)):
        network = quality_mil.fit(more, labels.union(spark.createDataFrame([(i, label, 0) for i in empty], labels.schema)))
        assert network.empty == pytest.approx((label * len(empty) + 1) / (len(empty) + 2))
        rows = quality_mil.score(documents(spark, [(1, None), (2, "")]), network, ["doc_id"]).collect()
        assert {r["predicted"] for r in rows} == {accepted}


def test_quality_fit_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = quality_tables(spark)
    again = docs.union(docs).union(documents(spark, [(4, "other " * 60), (4, None)])).repartition(7)
    one = quality_mil.fit(again, labels, sample_docs=70)
    two = quality_mil.fit(again.repartition(2, "text"), labels.union(labels).repartition(5), sample_docs=70)
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)
    assert one.prior == two.prior and one.empty == two.empty


def test_attention_gradients_match_differences():
    random_ = np.random.default_rng(1)
    n, bags = 9, np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    x = random_.standard_normal((n, 4)).astype(np.float64)
    shapes = {"encode": (4, 3), "encode_bias": (3,), "value": (3, 3), "gate": (3, 3), "attend": (3,), "out": (3,), "out_bias": (1,)}
    w = {k: random_.standard_normal(s) for k, s in shapes.items()}
    labels = np.array([1.0, 0.0, 1.0])

    def loss(w):
        p = quality_mil._forward(w, x, bags, 3)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, gradient in quality_mil._gradients(w, x, bags, labels).items():
        for at in np.ndindex(w[name].shape):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += 1e-6
            assert (loss(moved) - loss(w)) / 1e-6 == pytest.approx(gradient[at], abs=1e-4)


def test_passages_do_not_depend_on_batching():
    texts = [t or "" for _, t in ODD]
    together, owners = quality_mil.passages(texts)
    for i, text in enumerate(texts):
        alone, _ = quality_mil.passages([text])
        assert np.allclose(alone, together[owners == i])


# --- op2 -------------------------------------------------------------------------------------------------------------

PLAIN_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19
        and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain_spans(text, rules, order):
    found = [(m.start(), k, m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[0], order.index(s[1]), s[2]))


def test_pii_base_rules_match_plain_regexes():
    texts = random_texts(3000, 5, "ab1@.%+-_ 2590()é", 40) + random_texts(2000, 6, "0123456789 -.+", 60)
    texts += ["a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (555) 123-4567 x", "001.2.3.255 1.2.3.256", "a@b@c.d"]
    for text in texts:
        assert pii_rules.base_spans(text) == plain_spans(text, PLAIN_PII, list(pii_rules.KINDS)), text


def test_pii_scans_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "a@" * 100_000):
        pii_rules.base_spans(text)
        pii_boost.candidates(text)


def pii_documents(spark):
    rnd = random.Random(9)

    def card():
        digits = [rnd.randint(0, 9) for _ in range(15)]
        return next(c for x in range(10) if pii_rules.luhn(c := "".join(map(str, [*digits, x]))))

    rows = []
    for i in range(400):
        number = "".join(str(rnd.randint(0, 9)) for _ in range(11))
        pii = [
            f"mail us at u{i}@mail{i % 7}.example.com today",
            f"call +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} now",
            f"host {rnd.randint(1, 255)}.{rnd.randint(1, 255)}.9.{rnd.randint(1, 255)} down",
            f"card {card()} paid",
            f"order {number} sent",
        ]
        rnd.shuffle(pii)
        rows.append((i, "the house . " + " and the river ".join(pii)))
    return documents(spark, rows)


def test_pii_trees_add_respelt_spans_and_keep_the_base(spark):
    docs = pii_documents(spark)
    model = pii_boost.fit(docs)
    assert np.isfinite(model.thresholds["email"])
    text = "the house . mail us at u1 at mail3 dot example dot com today and the river order 98079157628 sent"
    base, every = model.spans(text)
    assert base == [] and [s[1] for s in every] == ["email"]
    assert pii_boost.redacted(text, every).startswith("the house . mail us at [EMAIL]")
    for r in docs.limit(50).collect():
        base, every = model.spans(r["text"])
        assert set(base) <= set(every)
        assert "98079157628" not in r["text"] or "[" not in pii_boost.redacted(r["text"], every)


def test_pii_kinds_with_little_proof_have_a_threshold(spark):
    """Ten emails are too few to prove a threshold of their own, and a small table has few of all kinds."""
    few = [(i, t if i < 10 else t.replace("@", " of ")) for i, t in ((r["doc_id"], r["text"]) for r in pii_documents(spark).collect())]
    text = "the house . mail us at u1 at mail3 dot example dot com today and the river order 98079157628 sent"
    for rows in (few, few[:40]):
        model = pii_boost.fit(documents(spark, rows))
        assert all(np.isfinite(t) for t in model.thresholds.values())
        assert [s[1] for s in model.spans(text)[1]] == ["email"]
    found = pii_boost.thresholds(
        {("email", 1020, True): 5, ("email", 1015, False): 1, ("phone", 900, True): 50, ("phone", 300, True): 1, ("phone", 800, False): 9}
        | {("ip", 900, True): 30, ("ip", 950, False): 30}
    )
    # Few positives: above the look-alikes. None: the fallback. Enough: what they prove, or nothing.
    assert found == {"email": 1016 / 1024, "card": pii_boost.FALLBACK, "phone": 900 / 1024, "ip": np.inf}


def test_pii_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pii_boost, "SAMPLE_CANDIDATES", 400)
    rows = [(r["doc_id"], r["text"]) for r in pii_documents(spark).collect()]
    numbers = " ".join(str(10**10 + 7919 * i) for i in range(3000))  # one document holds most of the look-alikes
    docs = documents(spark, [*rows, (1000, numbers)])
    models = [pii_boost.fit(d) for d in (docs.coalesce(1), docs.repartition(7, "doc_id"), docs.orderBy(F.desc("doc_id")))]
    for model in models:
        assert model.thresholds == models[0].thresholds and np.isfinite(model.thresholds["email"])
        assert np.array_equal(model.trees.leaves, models[0].trees.leaves)


def test_pii_edges(spark):
    model = pii_boost.fit(documents(spark, []))
    assert set(model.thresholds.values()) == {np.inf}
    out = pii_boost.find(documents(spark, ODD), model, ["doc_id", "lang"], redact="text").collect()
    assert len(out) == len(ODD)
    null = next(r for r in out if r["doc_id"] == 1)
    assert null["text"] is None and null["n_email"] == 0 and null["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii_boost.find(documents(spark, []), model, ["doc_id"]).count() == 0


def test_redaction_of_overlapping_spans():
    spans = [(0, "card", 5), (2, "phone", 8), (8, "ip", 9), (12, "email", 14)]
    assert pii_boost.redacted("0123456789abcdef", spans) == "[CARD][IP]9ab[EMAIL]ef"


# --- op3 -------------------------------------------------------------------------------------------------------------


def plain_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    lines = [l for l in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", l)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )


def test_quality_rules_match_plain_counts(spark):
    texts = random_texts(150, 11, "ab \n\t#|<é", 120) + ["a b c d e f g h " * n for n in range(5)] + [PROSE * 3, None, "", " "]
    docs = documents(spark, list(enumerate(texts)))
    for r in quality_rules.judge(docs, ["doc_id", "kind"]).collect():
        want = plain_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_edges_and_plan(spark):
    out = quality_rules.judge(documents(spark, ODD), ["doc_id", "text"])
    assert out.count() == len(ODD)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert quality_rules.judge(documents(spark, []), ["doc_id"]).count() == 0


# --- op5 -------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    found = [(m.start(), "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secret_layers.KINDS.index(s[1]), s[2]))


def test_secret_base_rules_match_plain_regexes():
    rnd = random.Random(4)
    parts = ["token", "TOKEN", "api_key", "apiKey", "ſecret", "secret", "passwd", " = ", ":", "'", '"', "=", "AKIA", "ABCDEFGH12", "0123456789abcdef", "zz", " ", "é", "K"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))
        assert secret_layers.scan(text) == plain_secrets(text), text


SECRET = 'token = "abcdef1234567890abcdef12"'


def percent(text):
    return "".join(f"%{b:02X}" for b in text.encode())


@pytest.mark.parametrize(
    "wrap",
    [
        percent,
        lambda s: percent(percent(s)),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#x{ord(c):x};" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(percent(s).encode()).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    ],
)
def test_secrets_below_encodings_map_to_the_text(wrap):
    inner = wrap(SECRET)
    text = f"é before {inner} after"
    base, every, layers, unopened = secret_layers.secrets(text)
    assert set(base) <= set(every) and layers > 1 and not unopened
    spans = [s for s in every if s not in base]
    assert {s[1] for s in spans} == {"assign", "hex"}
    low, high = text.index(inner), text.index(inner) + len(inner)
    assert all(low <= s[0] < s[2] <= high for s in spans)


def b64(data):
    return base64.b64encode(data).decode()


def wrapped(data, width, end="\n"):
    text = b64(data)
    return end.join(text[i : i + width] for i in range(0, len(text), width))


NOISE = random.Random(3).randbytes(3000).hex().upper().encode()


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: b64(gzip.compress(gzip.compress(s))),
        lambda s: b64(gzip.compress(bz2.compress(zlib.compress(s)))),
        lambda s: "api/v2/payload/" + b64(s),
        lambda s: "user_key_" + b64(s),
        lambda s: "user_key_" + b64(gzip.compress(s)),
        lambda s: b64(b"a\x00b\x01" + s),
        lambda s: b64(s.decode().encode("utf-16")),
        lambda s: b64(s.decode().encode("utf-16-be")),
        lambda s: wrapped(b"header of the file, filling up. " + s, 64),
        lambda s: wrapped(b"x" * 50 + s + b"y" * 99, 76, "\r\n  "),
        lambda s: wrapped(b"x" * 50 + s + b"y" * 99, 76, "\\n"),
        lambda s: wrapped(gzip.compress(NOISE + s), 76),
        lambda s: wrapped(zlib.compress(NOISE + s), 64),
    ],
)
def test_secrets_below_stacked_glued_and_wrapped_encodings(wrap):
    inner = wrap(SECRET.encode())
    text = f"é before {inner} after"
    base, every, layers, unopened = secret_layers.secrets(text)
    assert not unopened
    spans = [s for s in every if s not in base]
    assert {s[1] for s in spans} >= {"assign", "hex"}
    low, high = text.index(inner), text.index(inner) + len(inner)
    assert all(low <= s[0] < s[2] <= high for s in spans)


def test_streams_that_are_not_whole_are_counted_and_searched():
    cut = b64(gzip.compress(SECRET.encode() + NOISE)[:2000])
    _, every, _, unopened = secret_layers.secrets(f"log {cut} end")
    assert unopened == 1 and {s[1] for s in every} == {"assign", "hex"}


@pytest.mark.parametrize("second", [lambda s: base64.b64encode(s.encode()), lambda s: base64.b64encode(gzip.compress(s.encode()))])
def test_every_copy_of_an_encoded_secret_is_mapped(second):
    copies = [base64.b64encode(SECRET.encode()).decode(), second(SECRET).decode()]
    text = f"config {copies[0]} . again {copies[1]} . %41"
    every = secret_layers.secrets(text)[1]
    for at, copy in ((text.index(copies[0]), copies[0]), (text.rindex(copies[1]), copies[1])):
        inside = [s for s in every if at <= s[0] < s[2] <= at + len(copy)]
        assert {s[1] for s in inside} == {"assign", "hex"}


def test_secret_layers_end_and_do_not_open_bombs(spark):
    assert secret_layers.secrets("%41" * 20_000)[2] == 2
    bomb = base64.b64encode(zlib.compress(b"a" * 80_000_000)).decode()
    assert secret_layers.secrets(bomb)[3] == 1
    out = secret_layers.find(documents(spark, ODD), ["doc_id", "kind"]).collect()
    assert len(out) == len(ODD) and all(r["n_layers"] == 1 for r in out)
    assert secret_layers.find(documents(spark, []), ["doc_id"]).count() == 0


# --- op6 and op8 -----------------------------------------------------------------------------------------------------

MIXED = " \n\t\r\x0b\x0c\x1c\x85\xa0  aAbBzZ'sStTlL1½²é́ßİΣς日🎉.,!<|>-"
SPECIAL = ["Hi <|endoftext|>there! <|startoftext|> <|ENDOFTEXT|>", "Σας ΑΣ don't WE'LL", "a\n \n b", "a\n ", "a \nb", "  x", "x" * 3000]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_match_the_library(file):
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    texts = random_texts(2500, 8, MIXED, 50) + SPECIAL + [t or "" for _, t in ODD[:6]]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    if file.startswith("word"):
        encoder = bpe_fragments.FragmentEncoder(bpe_fragments.read_spec(path))
        got = [encoder.encode(t) for t in texts]
        for ids, own in zip(want, got, strict=True):
            assert encoder.decode(own) == library.decode(ids, skip_special_tokens=False)
    else:
        encoder = token_records.Encoder(bpe_fragments.read_spec(path))
        assert encoder.width == 2
        got = [np.frombuffer(b, "<u2").astype("<u4").tobytes() for b in encoder.encode(texts)]
    for text, ids, own in zip(texts, want, got, strict=True):
        assert np.frombuffer(own, "<u4").tolist() == ids, text


def test_forced_boundaries_are_in_no_token():
    encoder = bpe_fragments.FragmentEncoder(bpe_fragments.read_spec(public_tokenizers.path("word_bpe_49k.json")))
    assert len(encoder.cuts("qzqz")) > 1
    for token in list(encoder.tokenizer.get_vocab())[:5000]:
        if not token.startswith("<|"):
            assert len(encoder.cuts(token.removesuffix("</w>"))) == 1


def test_bpe_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = bpe_fragments.encode(documents(spark, ODD), path, ["doc_id", "n"], ids="token_ids").collect()
    assert len(out) == len(ODD)
    texts = dict(ODD)
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe_fragments.encode(documents(spark, []), path, ["doc_id"]).count() == 0


def test_records_round_trip_in_doc_id_order(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = new_path(spark, "records")
    rows = random.Random(1).sample(ODD, len(ODD)) + [(i, f"doc {i} " * (i % 9)) for i in range(100, 400)]
    token_records.write(documents(spark, rows).repartition(5), folder, path, end_id=2)
    got = token_records.read_back(spark, folder).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    crcs = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got)
    want = []
    for i, t in rows:
        tokens = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i or -1, len(tokens), zlib.crc32(tokens.tobytes())))
    assert crcs == sorted(want)
    # Shuffled reads by the index.
    some = token_records.read_index(spark, folder).filter("doc_id in (150, 151, 399)").collect()
    for r in some:
        ((doc_id, tokens),) = token_records.read_at(folder, r["file"], [r["offset"]])
        assert doc_id == r["doc_id"] and len(tokens) == r["n_tokens"] and tokens[-1] == 2


def test_records_of_an_empty_table_and_damage(spark):
    folder = new_path(spark, "records")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_records.write(documents(spark, []), folder, path, end_id=2)
    assert token_records.read_back(spark, folder).count() == 0
    good = token_records.frame(7, np.array([1, 2, 3], "<u2").tobytes(), 2)
    assert token_records.read_frame(io.BytesIO(good))[1].tolist() == [1, 2, 3]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(good[:-1]))


# --- op9 -------------------------------------------------------------------------------------------------------------


def toxic_tables(spark):
    rnd = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    bad = ["grimble", "snarf", "vextor"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rnd.choice(plain) for _ in range(50)] + ([rnd.choice(bad) for _ in range(4)] if toxic else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows_with_evidence(spark):
    docs, labels = toxic_tables(spark)
    examples = toxicity_neighbours.fit(docs, labels)
    assert {"grimble", "snarf", "vextor"} <= set(examples.vocabulary)
    rows = toxicity_neighbours.score(docs, examples, ["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97
    assert not {i for i in examples.doc_ids.tolist() if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) == 3 for r in rows)


def test_block_max_search_is_exact():
    rnd = random.Random(12)
    rows = [(i, rnd.randint(0, 1), {rnd.randrange(20): rnd.randint(1, 4) for _ in range(rnd.randint(0, 6))}) for i in range(500)]
    index, vectors = toxicity_neighbours.build(rows, [f"t{i}" for i in range(20)], np.arange(20) + 5.0, 500)
    dense = np.zeros((500, 20))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    assert np.allclose((dense**2).sum(axis=1)[dense.any(axis=1)], 1)
    for i in range(0, 500, 7):
        ids, similarity = index.nearest(*vectors[i], 11)
        if not len(vectors[i][0]):
            assert not len(ids)
            continue
        every = dense @ dense[i]
        want = np.lexsort((index.doc_ids, -every.round(12)))[: len(ids)]
        assert np.allclose(similarity, every[want]) and (ids == want).mean() > 0.6


def test_nearest_examples_of_many_texts_at_once(monkeypatch):
    """Frequent terms as a matrix and the others as postings give what each text alone gives, to the last bit."""
    rnd = random.Random(3)

    def counts():
        return {min(rnd.randrange(1, 80) ** 2 // 70, 89): rnd.randint(1, 4) for _ in range(rnd.randint(0, 30))}

    rows = [(i // 2, rnd.randint(0, 1), counts()) for i in range(300)]
    index, vectors = toxicity_neighbours.build(rows, [f"t{i}" for i in range(90)], np.arange(90) + 5.0, 500)
    asked = vectors[::3] + [index.vector(counts()) for _ in range(70)]
    dense = np.zeros((300, 90))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    found = list(index.all_nearest(asked, 11))
    assert 0 < len(index._frequent[1]) < 90
    for (t, w), (ids, similarity) in zip(asked, found, strict=True):
        every = np.array([sum((w[j] * dense[i, t[j]] for j in range(len(t))), 0.0) for i in range(300)])
        want = [i for i in np.lexsort((index.doc_ids, -every)) if every[i] > 0][:11]
        assert ids.tolist() == want and similarity.tolist() == every[want].tolist()
    monkeypatch.setattr(toxicity_neighbours, "DENSE_CELLS", 600)
    few = toxicity_neighbours.build(rows, [f"t{i}" for i in range(90)], np.arange(90) + 5.0, 500)[0]
    assert len(few._frequent[1]) == 2
    again = few.all_nearest(asked, 11)
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(found, again, strict=True))


def test_toxic_neighbours_of_texts_against_plain_tf_idf(spark):
    docs, labels = toxic_tables(spark)
    examples = toxicity_neighbours.fit(docs, labels)
    bags = {r["doc_id"]: Counter(r["text"].split()) for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    terms = sorted({w for i in known for w in bags[i]})
    assert list(examples.vocabulary) == terms and set(examples.doc_ids.tolist()) == set(known)
    share = sum(known.values()) / len(known)
    weight = {}
    for w in terms:
        gain = 0.0
        n = [sum(w in bags[i] for i in known if known[i] == y) for y in (0, 1)]
        for seen, part in zip(n, (1 - share, share), strict=True):
            gain += 2 * seen * math.log(seen / (sum(n) * part)) if seen else 0.0
        bearing = 1 / (1 + (2 * math.log(len(terms)) / max(gain, 1e-9)) ** 4)
        idf = math.log(1 + len(bags) / sum(w in b for b in bags.values()))
        weight[w] = idf * (0.05 + 0.95 * bearing)

    def vector(bag):
        raw = {w: (1 + math.log(n)) * weight[w] for w, n in bag.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors = {i: vector(bags[i]) for i in known}
    scored = {r["doc_id"]: r for r in toxicity_neighbours.score(docs, examples, ["doc_id"]).collect()}
    for i in range(0, 400, 9):
        own = vector(bags[i])
        every = {j: sum(x * own.get(w, 0) for w, x in v.items()) for j, v in vectors.items()}
        nearest = sorted(every, key=lambda j: (-round(every[j], 12), j))[:11]
        assert [e["doc_id"] for e in scored[i]["evidence"]] == nearest[:3]
        assert np.allclose([e["similarity"] for e in scored[i]["evidence"]], [every[j] for j in nearest[:3]])
        vote = sum(every[j] * known[j] for j in nearest) / sum(every[j] for j in nearest)
        assert math.isclose(scored[i]["score"], float(np.interp(vote, examples.votes, examples.chances)), abs_tol=1e-9)
    assert len({tuple(e["doc_id"] for e in r["evidence"]) for r in scored.values()}) > 300


def test_toxic_examples_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = toxic_tables(spark)
    again = docs.union(docs).union(documents(spark, [(3, "another text under a used id"), (3, None)])).repartition(7)
    one = toxicity_neighbours.fit(again, labels, sample_docs=90)
    two = toxicity_neighbours.fit(again.repartition(2, "text"), labels.repartition(5).union(labels), sample_docs=90)
    assert len(one.doc_ids) == 90 and one.doc_ids.tolist() == two.doc_ids.tolist()
    assert list(one.vocabulary) == list(two.vocabulary)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.chances, two.chances)
    few = toxicity_neighbours.fit(docs, labels, sample_chars=5000)
    assert 0 < len(few.doc_ids) < 40


def test_toxicity_edges(spark):
    docs, labels = toxic_tables(spark)
    examples = toxicity_neighbours.fit(docs, labels)
    odd = {r["doc_id"]: r for r in toxicity_neighbours.score(documents(spark, ODD), examples, ["doc_id"]).collect()}
    assert odd[1]["score"] == odd[2]["score"] == odd[4]["score"] and odd[1]["predicted"] == 0
    assert odd[1]["evidence"] == []
    assert toxicity_neighbours.score(documents(spark, []), examples, ["doc_id"]).count() == 0
    nothing = toxicity_neighbours.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity_neighbours.score(docs, nothing, ["doc_id"]).collect()} == {0.0}


# --- op10 ------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    lowest = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            lowest[g] = min(lowest.get(g, doc_id), doc_id)
    return prints, group, lowest


def near_copies():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    rows = [r for r in ODD if r[0] not in (6, 7)]
    for i in range(20):
        base = [rnd.choice(words) for _ in range(200)]
        for j in range(rnd.randint(1, 5)):
            changed = list(base)
            changed[rnd.randrange(200)] = rnd.choice(words)
            rows.append((100 + 10 * i + j, " ".join(changed)))
    return rows


def test_simhash_matches_brute_force(spark):
    rows = near_copies()
    prints, group, lowest = plain_components(rows)
    want = sorted(((i or -1), f"{p:016x}", lowest.get(g)) for (i, _), p, g in zip(rows, prints, group, strict=True))
    out = simhash_pivots.components(documents(spark, rows))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in out.collect()) == want
    kept = simhash_pivots.deduplicate(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(lowest.get(g) or -1 for g in set(group))
    assert simhash_pivots.components(documents(spark, [])).count() == 0
    assert simhash_pivots.deduplicate(documents(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [2048, 16])
def test_links_of_dense_groups_match_brute_force(spark, monkeypatch, chunk):
    """Groups large enough for tiles, and, with small chunks, for pairs of chunks."""
    monkeypatch.setattr(simhash_pivots, "CHUNK", chunk)
    rnd = random.Random(chunk)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:3]:
        for _ in range(120):
            prints.add(centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 2))) & (1 << 64) - 1)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    from slink.llm.components import connected_components

    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash_pivots.links(frame)).collect()}
    label = {p: p for p in signed}
    changed = True
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {p: got.get(p, p) for p in signed} == label


def test_long_chain_is_one_component(spark):
    from slink.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 6)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)}
    assert connected_components(edges.limit(0)).count() == 0


def test_examples_as_arrays_are_those_as_counts():
    """The driver holds numbers of words, not the words of each example."""
    rnd = random.Random(5)
    texts = [(i % 90, i % 2, {f"w{rnd.randrange(30):02d}": rnd.randint(1, 3) for _ in range(rnd.randint(0, 9))}) for i in range(120)]
    sample = pa.table(
        {
            "doc_id": pa.array([t[0] for t in texts], pa.int64()),
            "label": pa.array([t[1] for t in texts], pa.int32()),
            "words": pa.array([list(t[2]) for t in texts], pa.list_(pa.string())),
            "n": pa.array([list(t[2].values()) for t in texts], pa.list_(pa.int64())),
        }
    )
    vocabulary, rows = toxicity_neighbours._numbered(sample)
    assert vocabulary == sorted({w for t in texts for w in t[2]})
    counts = [(i, y, {vocabulary.index(w): n for w, n in c.items()}) for i, y, c in texts]
    freq = np.arange(len(vocabulary)) + 5.0
    (one, a), (two, b) = (toxicity_neighbours.build(r, vocabulary, freq, 500) for r in (rows, counts))
    assert (one.doc_ids == two.doc_ids).all() and (one.weights == two.weights).all() and (one.members == two.members).all()
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(a, b, strict=True))
