"""Phrase collocations against counts in plain Python, with and without ranks for all words."""

import re
from collections import Counter

import numpy as np
import pytest

from plansift.llm import collocations as op


def brute(rows, least=10, top=2000, longest=3, subsumed=50):
    words, phrases = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                phrases.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {p: a for p, a in phrases.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] >= subsumed * a:
            continue
        cuts = [(1_000_000 * a * a // (phrases[lang, w[:k]] * phrases[lang, w[k:]]), k, phrases[lang, w[:k]], phrases[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, le, r, words[lang], -s) for lang, ps in out.items() for k, (s, a, p, le, r) in enumerate(sorted(ps)[:top], 1))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
FEW = [dict(), dict(ranked=30, ranked_phrases=20), dict(ranked=0, ranked_phrases=0, portion=2000), dict(least=3, longest=4, ranked=40, ranked_phrases=40, portion=5000), dict(top=7), dict(longest=2)]


@pytest.mark.parametrize("few", FEW)
def test_equals_brute_force(spark, few):
    """Whatever has a rank, and however texts are cut into portions, the counts are the same."""
    rng = np.random.default_rng(3)
    names = np.array([f"w{i}" for i in range(60)] + ["Der", "ÉTÉ", "x.y", "a\x1cb", "日本"])
    texts = ["\t".join(rng.choice(names, 40, p=np.r_[np.full(5, 0.12), np.full(60, 0.4 / 60)])) + rng.choice(["", ". New York City", "!New York", " york\x0bnew"]) for _ in range(300)]
    rows = [(None if i % 7 == 0 else ["en", "de"][i % 3 == 0], t) for i, t in enumerate(texts)]
    got = op.collocations(spark.createDataFrame(rows, "lang string, text string"), **few)
    assert got.columns == COLUMNS
    want = brute(rows, **{k: v for k, v in few.items() if k in ("least", "top", "longest")})
    assert sorted(map(tuple, got.collect())) == want and want


def test_documents_equal_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, op.collocations(docs).collect())) == brute(rows)


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert sorted(map(tuple, op.collocations(odd, least=2).collect())) == brute(rows, least=2)
    assert op.collocations(odd.limit(0)).collect() == []


def test_tiles_dense_and_sparse():
    rng = np.random.default_rng(5)
    first = np.r_[rng.integers(0, 90, 60_000), rng.integers(0, 1 << 30, 500), [2**31 - 1, 2**31 - 1]].astype(np.int64)
    second = np.r_[rng.integers(0, 90, 60_000), rng.integers(0, 5000, 500), [2**31 - 1, 2**31 - 1]].astype(np.int64)
    code, n = op.tile_counts(first, second)
    assert Counter(dict(zip(code.tolist(), n.tolist(), strict=True))) == Counter((first << 32 | second).tolist())
    assert len(op.tile_counts(first[:0], second[:0])[0]) == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_019, 3_000_000_021, 3_000_000_055
    counts = [("en", "x", l), ("en", "y", r)]
    pairs = [("en", "x y", a)]
    row = op.scored([spark.createDataFrame(t, "lang string, phrase string, n long") for t in (counts, pairs)]).first()
    assert row["score"] == 1_000_000 * a * a // (l * r)


def test_a_very_long_text(spark):
    rows = [("en", "alpha beta gamma " * 200_000)]
    got = op.collocations(spark.createDataFrame(rows, "lang string, text string"), portion=10_000)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_a_task_holds_a_bounded_part(spark):
    """Texts of a batch become Python objects a few at a time, and the cells that a task sums up stay below a fixed number."""
    import tracemalloc

    import pyarrow as pa

    def peak(run):
        tracemalloc.start()
        try:
            return sum(1 for _ in run()), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4000, "text": ["some words " * 1000] * 4000})
    n, mb = peak(lambda: op._portions(iter([batch]), 1_000_000))
    assert n == 44 and mb < 10  # 44 MB of text

    words = np.array([f"w{i}" for i in range(3000)])
    rng = np.random.default_rng(1)
    texts = [" ".join(words[rng.integers(0, 3000, 30_000)]) for _ in range(100)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 100, "text": texts})
    none = np.zeros(0, np.int64)
    held = type("Held", (), {"value": [({"en": (pa.array(words, pa.large_string()), none, none)}, None)]})
    total = sum(pa.compute.sum(b.column("n")).as_py() for b in op._count_phrases(held, op.PORTION)(iter([batch])))
    assert total == 100 * 29_999
    _, mb = peak(lambda: op._count_phrases(held, op.PORTION)(iter([batch])))
    assert mb < 160


def test_rare_phrases_stay_numbers(spark, monkeypatch):
    """Where some frequent phrases have no rank, a task hashes words only: no rare pair is told by its text."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    names = np.array([f"w{i}" for i in range(400)])
    rows = [("en", " ".join(rng.choice(names, 200)) + " . often seen here" + " . odd one" * (i < 12)) for i in range(100)]
    levels, made = [], op._count_phrases
    monkeypatch.setattr(op, "_count_phrases", lambda held, size: levels.append(held.value) or made(held, size))
    got = op.collocations(spark.createDataFrame(rows, "lang string, text string"), ranked=380, ranked_phrases=3)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    monkeypatch.undo()
    assert len(levels) == 2 and all(more is not None for _, more in levels[1])
    hashed, digest = [], op.xxhash.xxh64_intdigest
    monkeypatch.setattr(op.xxhash, "xxh64_intdigest", lambda x, seed: hashed.append(x) or digest(x, seed))
    held = type("Held", (), {"value": levels[1]})
    batch = pa.RecordBatch.from_pydict({"lang": [lang for lang, _ in rows], "text": [text for _, text in rows]})
    assert sum(b.num_rows for b in made(held, op.PORTION)(iter([batch]))) > 0
    assert len(hashed) <= len(names) + 6 * len(levels[1])


def test_keys_are_those_of_spark(spark):
    words = ["a", "日本", "x" * 100]
    want = spark.createDataFrame([("en", "a 日本 " + "x" * 100)], "lang string, phrase string").select(*(op._key(k).alias(f"k{k}") for k in (1, 2, 3))).first()
    key, hashes = np.array([op.xxhash.xxh64_intdigest("en", 42)], np.uint64), op._hashes(op.pa.array(words))
    for k in range(3):
        key = op.chained(hashes[k : k + 1], key)
        assert key.astype(np.int64)[0] == want[k]
