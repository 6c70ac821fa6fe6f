"""Toxicity, tokens, fingerprints, personal data and mixing against brute force on messy rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: (doc_id, text, source, and columns whose names the operators use inside)
MESSY = [
    (1, "Plain words here, plain words there.", "a", 1, "x"),
    (2, None, "a", 2, "x"),
    (3, "", "b", 3, None),
    (4, "Plain words here, plain words there.", None, 4, "y"),
    (5, "Plain words here, plain words there.", None, 4, "y"),
    (5, "Plain words here, plain words there.", None, 4, "y"),
    (6, " café 你好 \U0001f600 don't  stop\n\n\t42 007", "b", 5, "z"),
    (7, "word " * 3000, "c", 6, "z"),
    (None, "An id that is missing. +1 (743) 555-3824", "c", 7, "z"),
]
SCHEMA = "doc_id long, text string, source string, size long, pii string"


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(MESSY, SCHEMA)


def test_mixing_totals_and_bounds(spark, messy):
    from quernstone.llm.mixing import mix, mixture

    data = [(k, "w " * (1 + (k * 7919) % 50), f"s{k % 7 if k % 3 else 0}") for k in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    first, again = (mix(df).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert first.equals(again)
    assert (first["taken"] <= 2 * first["size"]).all()
    per = first.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
    assert (per["size"] == per["own"]).all() and ((per["taken"] - per["target"]).abs() <= 50).all()
    # the same targets by plain resharing
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(per.index))}
    left, active, want = 1.5 * per["size"].sum(), set(per.index), {}
    while True:
        level = left / sum(weights[s] for s in active)
        full = {s for s in active if level * weights[s] >= 2 * per["size"][s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * per["size"][s]
            left -= want[s]
        active -= full
    want |= {s: level * weights[s] for s in active}
    assert all(math.isclose(per["target"][s], want[s], rel_tol=1e-9) for s in per.index)
    got = mix(messy).toPandas()
    assert len(got) == len(MESSY)
    assert mixture(messy).columns == messy.columns
    assert mixture(messy).count() == got["copies"].sum()
    assert mix(messy.limit(0)).count() == 0


def test_mixing_keeps_expectations():
    from quernstone.llm.mixing import round_pairs

    total = np.zeros(5)
    for seed in range(2000):
        h = [seed * 1000003 + k for k in range(5)]
        got, held = round_pairs([3, 5, 1, 8, 2], [0.5] * 5, h, 0)
        assert math.isclose(sum(a * b for a, b in zip(got, [3, 5, 1, 8, 2])), 9.5)
        assert sum(0 < x < 1 for x in got) <= 1 and (held >= 0) == any(0 < x < 1 for x in got)
        total += got
    assert np.allclose(total / 2000, 0.5, atol=0.05)


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (40, 20), (64, 8)])
def test_bpe_equals_tiktoken(spark, messy, chunk, overlap):
    import base64

    import public_tokenizers as p
    import tiktoken

    from quernstone.llm.bpe import decode, encode

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    odd = ["".join(rng.choice(list("ab 'stre\n\t12.,é你 "), 500)) for _ in range(20)] + ["x" * 300, " " * 300, "'re" * 100, "\n" * 90 + "a"]
    df = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter((r["doc_id"], tuple(real.encode_ordinary(r["text"] or ""))) for r in df.collect())
    done = decode(encode(df, path, p.PATTERN, chunk=chunk, overlap=overlap), path, p.PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in done) == want
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in done) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in df.collect())


def test_simhash_edits_and_search(spark, messy):
    from quernstone.llm.simhash import near, with_edits

    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    data = [(int(k), " ".join(rng.choice(vocabulary, 60))) for k in rng.permutation(900)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in with_edits(df).collect()}
    ordered = sorted(data)
    likeness = []
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        edited = t[: len(t) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["next_fp"] == got[ordered[(k + 1) % len(ordered)][0]]["fp"]
        likeness.append((got[i]["fp"] ^ got[i]["edited_fp"]) & ((1 << 64) - 1))
    assert np.mean([bin(x).count("1") for x in likeness]) < 27
    odd = with_edits(messy).collect()
    assert len(odd) == len(MESSY)
    assert len({r["fp"] for r in odd if r["doc_id"] in (1, 4, 5)}) == 1
    assert with_edits(messy.limit(0)).count() == 0
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    fps = sorted({b ^ sum(1 << int(j) for j in rng.choice(62, k, replace=False)) for b in base for k in (0, 1, 2, 3, 4, 5)})
    table = spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")
    pairs = near(table.select("fp"), table).collect()
    want = {(a, b) for a in fps for b in fps if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert {(r["query"], r["fp"]) for r in pairs} == want and len(pairs) == len(want)


def base_spans(text):
    out = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans(spark, messy):
    from quernstone.llm.pii import find_pii, redact

    rng = np.random.default_rng(3)
    pieces = ["a@b.c", "x@y.z_w@q.com", "a..b@c.d.", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539  1488", "0000000000000000", "+1 (743) 555-3824", "+12", "+1-+2-3", "\U0001f600", "\x01", " ", "-", "9", "12"]
    texts = ["".join(rng.choice(pieces, 12)) for _ in range(400)] + ["1 " * 30000, "a." * 30000 + "@", "9" * 60000, "a@" + "b." * 30000 + "c", "My IBAN is GB82 WEST 1234 5698 7654 32, thanks", "IBAN GB82WEST12345698765433", "ssn 123-45-6789", "code 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_pii(df).collect():
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        assert [s for s in spans if s[0] in ("email", "ip", "card", "phone")] == base_spans(r["text"]), r["text"][:200]
    more = {r["doc_id"]: [s["kind"] for s in r["pii"] if s["kind"] in ("iban", "ssn")] for r in find_pii(df).collect()}
    assert [more[k] for k in range(len(texts) - 4, len(texts))] == [["iban"], [], ["ssn"], []]
    assert redact(df.filter("doc_id = " + str(len(texts) - 4))).first()["text"] == "My IBAN is [IBAN], thanks"
    clean = redact(messy)
    assert clean.columns == messy.columns and clean.count() == len(MESSY)
    assert find_pii(messy.limit(0)).count() == 0


def test_toxicity_chain(spark, messy):
    from quernstone.llm.toxicity import reject, score, train

    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    data, labels = [], []
    for k in range(900):
        bad = k % 9 == 0
        words = list(rng.choice(plain, 40))
        if bad:
            words[5] = words[20] = str(rng.choice(["zzoxic", "zzoxid", "zzoxim"]))
        data.append((k, " ".join(words)))
        labels.append((k, int(bad or k % 2), int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels[:600] + [(None, 1, 1), (3, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    chain = train(docs, known, ["quality", "toxic"])
    got = {r["doc_id"]: r["is_toxic"] for r in score(docs, chain).collect()}
    wrong = [k for k in range(600, 900) if got[k] != (k % 9 == 0)]
    assert len(wrong) <= 3, wrong
    assert reject(messy, chain).columns == messy.columns and reject(messy, chain).count() == len(MESSY)
    empty = train(docs, known.limit(0), ["quality", "toxic"])
    assert score(docs, empty).filter("is_toxic").count() == 0
    assert score(docs.limit(0), chain).count() == 0


def test_pii_of_a_text_of_many_spans(spark):
    """Time and memory follow the length: a text of 40,000 addresses, with characters outside the first plane between."""
    import time

    from quernstone.llm.pii import find_pii, redact

    parts = [f"u{k}@mail.example.org" + (" \U0001F600é" if k % 90 == 0 else "") for k in range(40_000)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    began = time.time()
    spans = {r["doc_id"]: r["pii"] for r in find_pii(docs).collect()}
    want, at = [], 0
    for k, part in enumerate(parts):
        want.append((at, at + len(f"u{k}@mail.example.org")))
        at += len(part) + 1
    assert [(s["start"], s["end"]) for s in spans[1]] == want and spans[2] == spans[3] == []
    kept = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert kept == {1: " ".join("[EMAIL]" + (" \U0001F600é" if k % 90 == 0 else "") for k in range(40_000)), 2: "", 3: None}
    assert time.time() - began < 90
