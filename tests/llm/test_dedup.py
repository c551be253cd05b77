"""Line, substring and near-duplicate dedup, and components, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plansift.llm import line_templates, phrase_dedup, simhash
from plansift.llm.components import components


def roots(nodes, links):
    at = {n: n for n in nodes}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for n in nodes:
        groups[top(n)].add(n)
    return {frozenset(g) for g in groups.values()}


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 60)] + [tuple(map(int, rng.integers(1000, 1300, 2))) for _ in range(200)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        got[r["root"]].add(r["node"])
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {frozenset(g) for g in got.values()} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert all(r in g for r, g in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_duplicates(spark, docs, texts):
    extra = [(10_000 + n, f"{texts[3]} tail{n}", None, None, None) for n in range(30)] + [(20_000, None, None, None, None), (20_001, "", None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    all_texts = texts | {r[0]: r[1] for r in extra}
    fp = {i: brute_fingerprint(t) for i, t in all_texts.items()}
    ids = sorted(fp)
    groups = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    want = {i: min(g) for g in groups for i in g}
    got = simhash.near_duplicates(rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["fingerprint"] == format(fp[r["doc_id"]], "016x") for r in got)


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}


def similarities(texts, least):
    """Jaccard similarity of 5-word shingles of all pairs at ``least`` or more."""
    own = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in own.items():
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for ids in where.values() if len(ids) < 500 for k, a in enumerate(ids) for b in ids[k + 1 :])
    return {(a, b): n / (len(own[a]) + len(own[b]) - n) for (a, b), n in shared.items() if n >= least * (len(own[a]) + len(own[b]) - n)}


def test_one_of_each_near_duplicate_group_stays(spark, docs, texts):
    rng = np.random.default_rng(9)
    extra, base = [], [letters(rng, 300).split() for _ in range(60)]
    for n, words_ in enumerate(base):
        for k in range(1, 4):
            own = list(words_)
            for at in rng.choice(300, 2 * k, replace=False):
                own[at] = letters(rng, 1)
            extra.append((10_000 + 10 * n + k, " ".join(own), None, None, None))
        extra.append((10_000 + 10 * n, " ".join(words_).upper(), None, None, None))
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    everything = texts | {r[0]: r[1] for r in extra}
    kept = {r["doc_id"] for r in simhash.keep_one(rows).collect()}
    near, loose = similarities(everything, 0.8), similarities(everything, 0.65)
    sure = roots(everything, near)
    possible = {i: g for g in roots(everything, loose) for i in g}
    assert all(min(g) in kept for g in possible.values())  # the first of what is near at all stays
    # whoever goes has a partner, and of the groups at 0.8 nearly all come down to one
    assert all(len(possible[i]) > 1 for i in everything if i not in kept)
    groups = [g for g in sure if len(g) > 1]
    assert len(groups) > 60 and sum(len(g & kept) <= 1 for g in groups) >= 0.97 * len(groups)
    pairs = [(a, b) for (a, b), j in near.items() if j < 1]
    code = simhash.code_for(rows.count(), 0.8)
    nodes = sorted({x for p in pairs for x in p})
    fps = simhash.long_fingerprints([everything[i] for i in nodes], code.longs)
    table = spark.createDataFrame([(i, bytes(f.tobytes())) for i, f in zip(nodes, fps, strict=True)], "node long, fp binary")
    root = {i: min(g) for g in roots(nodes, [(r["a"], r["b"]) for r in simhash.similar_links(table, code).collect()]) for i in g}
    assert sum(root[a] == root[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_similar_texts_of_a_large_group_connect(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = letters(rng, 200).split()
    texts = []
    for _ in range(300):
        own = list(base)
        for at in rng.choice(200, 2, replace=False):
            own[at] = letters(rng, 1)
        texts.append((len(texts), " ".join(own)))
    texts += [(1000 + n, letters(rng, 200)) for n in range(50)]
    monkeypatch.setattr(simhash, "CELL", 32)
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(1000, 1050)]


def test_links_of_large_cells_connect_all(spark, monkeypatch):
    rng = np.random.default_rng(1)
    near = {0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(40, 2, replace=False)) for _ in range(500)}
    far = {int(x) for x in rng.integers(0, 2**62, 200)}
    fps = sorted(near | far)
    monkeypatch.setattr(simhash, "CELL", 64)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    want = roots(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 4])
    assert roots(fps, [(r["a"], r["b"]) for r in links]) == want


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id IS NULL").count() == 0
    assert kept.where("doc_id IN (0, 1, 2)").count() == 1  # no words
    assert simhash.keep_one(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def brute_spans(texts, size=35):
    split = {i: (t or "").encode().split() for i, t in texts}
    seen = Counter(tuple(w[k : k + size]) for w in split.values() for k in range(len(w) - size + 1))
    out = {}
    for i, w in split.items():
        cover = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        kept = [x for j, x in enumerate(w) if j not in cover]
        out[i] = (len(w), len(cover), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_repeated_passages(spark, docs, texts, odd):
    passage = " ".join(f"p{i}" for i in range(50))
    extra = [(5000 + n, f"{'x%d ' % n * n}{passage} tail{n} " + " ".join(f"r{n}_{i}" for i in range(20)), None, None, None) for n in range(40)]
    extra += [(6000, "a b c d e f g h " * 20, None, None, None), (6001, None, None, None, None), (6002, passage, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = brute_spans([*texts.items(), *((r[0], r[1]) for r in extra)])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrase_dedup.digest(rows).collect()} == want
    got = phrase_dedup.without_repeats(odd).collect()
    assert len(got) == odd.count()
    assert {(r["n_words"], r["n_removed"]) for r in got if r["doc_id"] in (11, 12)} == {(60, 50)}
    assert {(r["n_words"], r["n_removed"]) for r in got if r["doc_id"] == 10} == {(3000, 3000)}
    assert phrase_dedup.digest(docs.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:  # keys with many rows take the broadcast way
        m.setattr(phrase_dedup, "HEAVY", 3)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrase_dedup.digest(rows).collect()} == want


def test_occurrences_come_from_the_automata(monkeypatch):
    phrase = [b"w%d" % n for n in range(60)]
    part = [(b"a", phrase), (b"b", [b"x", *phrase]), (b"c", [b"y%d" % n for n in range(60)])]
    seen = Counter(h for _, w in part for h in phrase_dedup.anchors(phrase_dedup.Runs(w)).phrase.tolist())
    twice = lambda h: np.array([seen[x] > 1 for x in h.tolist()])
    found = {uid: a.place.tolist() for uid, _, a in phrase_dedup.located(part, twice, 35, 8)}
    assert found.keys() == {b"a", b"b"} and [p + 1 for p in found[b"a"]] == found[b"b"]

    class Blind:
        """Knows its phrases and finds none."""

        words = 0

        def __len__(self):
            return self.words

        def add_word(self, *_):
            self.words += 1

        def make_automaton(self):
            pass

        def iter(self, _):
            return iter(())

    monkeypatch.setattr(phrase_dedup.ahocorasick, "Automaton", Blind)
    assert not list(phrase_dedup.located(part, twice, 35, 8))


def masked(line):
    """Tokens of a line, those with a digit as fields; None without tokens."""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
    return tuple("<*>" if re.search("[0-9]", t) else t for t in tokens) or None


def templates_by_hand(texts, docs=10, constant=0.6, depth=3):
    """Recurring masked lines, with sets and loops."""
    where = defaultdict(set)
    for text in set(texts):
        for t in {masked(x) for x in (text or "").split("\n")} - {None}:
            where[t].add(text)
    leaf = lambda t: (len(t), t[:depth])
    at = defaultdict(set)
    for t, own in where.items():
        at[leaf(t)] |= own
    where = {t: own for t, own in where.items() if len(at[leaf(t)]) >= docs}
    often = Counter()
    for t, own in where.items():
        for k, tok in enumerate(t[depth:]):
            often[leaf(t), k, tok] += len(own) * (tok != "<*>")
    groups, named = defaultdict(set), {}
    for t, own in where.items():
        fixed = frozenset((k, tok) for k, tok in enumerate(t[depth:]) if often[leaf(t), k, tok] >= docs)
        if sum(x != "<*>" for x in t[:depth]) + len(fixed) >= len(t) * constant:
            named[t] = (leaf(t), fixed)
            groups[leaf(t), fixed] |= own
    spread = {g: sum(map(len, map(set, zip(*map(line_templates.sketches, own), strict=True)))) / 8 for g, own in groups.items()}
    return {t for t, g in named.items() if spread[g] >= docs and 8 * spread[g] >= len(groups[g])}


def letters(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n))


def test_line_templates(spark, docs, texts, odd):
    rng = np.random.default_rng(5)
    notice = "This page is part of the public archive\nAll times are given in local time\nWrite to the desk for corrections"
    body = letters(rng, 400).split()
    extra = [f"{letters(rng, 5)}\nPage {n} of {n + 7} printed by user{n} today\n{letters(rng, 5)}" for n in range(30)]
    extra += [f"{notice}\n{letters(rng, 8)}" for _ in range(60)]
    extra += ["the very same first line\nthe very same second line here\nthe very same third line"] * 30
    extra += ["\n".join(f"{letters(rng, 4)}\nonly this document says so" for _ in range(12))]
    # near copies of one text: forty lines of ten words, of which each copy has five words of its own
    for _ in range(60):
        own = list(body)
        for k in rng.choice(400, 5, replace=False):
            own[k] = letters(rng, 1)
        extra.append("\n".join(" ".join(own[k : k + 10]) for k in range(0, 400, 10)))
    rows = [(7000 + n, t, None, None, None) for n, t in enumerate(extra)]
    everything = texts | {r[0]: r[1] for r in rows}
    gone = templates_by_hand(everything.values())
    table = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r["doc_id"]: r for r in line_templates.digest(table).collect()}
    for i, text in everything.items():
        kept = [raw for raw in (text or "").split("\n") if masked(raw) not in gone]
        assert (got[i]["text"] or "") == "\n".join(kept)
    assert all(got[i]["n_dropped"] == 1 and "printed by" not in got[i]["text"] for i in range(7000, 7030))
    assert all(got[i]["n_dropped"] == 3 and got[i]["n_lines"] == 4 for i in range(7030, 7090))  # the notice goes whole
    assert all(got[i]["n_dropped"] == 0 for i in range(7090, 7181))  # copies, a document's own repeats, near copies
    joined = {r["doc_id"]: r for r in line_templates.drop_recurring(table.select("doc_id", "text"), few=-1).collect()}
    assert joined == got
    out = line_templates.drop_recurring(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    assert out.where(F.col("doc_id") == 0).first()["text"] is None
    assert line_templates.drop_recurring(odd.limit(0)).count() == 0
