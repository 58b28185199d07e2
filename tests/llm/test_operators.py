"""The training-data operators on small tables: brute force, round trips, and awkward rows."""

import collections
import hashlib
import itertools
import math
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import bpe, crosspoly, digests, edits, licences, mixer, mixing, neardup, queries, quotes, spots, toxicity

DATA = "/root/testdata/sf0.001"
AWKWARD = [(1, ""), (2, None), (3, "the end of the story is near the end"), (3, "the end of the story is near the end"), (4, "Ünï çödé " * 3000), (5, "one"), (None, "no id here"), (6, "\n\n  \t")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", 0.5) for r in AWKWARD], SCHEMA + ", id string, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_tiktoken(awkward, empty):
    own = bpe.codec(digests.RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(digests.RANKS), special_tokens={})
    rng = random.Random(1)
    many = ["".join(rng.choice("ab 'é\n漢🙂1.re") for _ in range(rng.randrange(200))) for _ in range(300)] + ["x" * 3000]
    for t, ids in zip(many, own.encode_many(many), strict=True):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == ref.encode_ordinary(t)
        assert own.decode(ids).decode() == t
        starts, ends = own.offsets(t, ids)
        assert all(t[s:e].encode().find(own.bytes_of[i]) >= 0 for s, e, i in zip(starts, ends, got, strict=True))
    with pytest.raises(ValueError):
        own.decode(np.array([60000], "<u4").tobytes())
    assert bpe.round_trip(awkward, digests.RANKS, P.PATTERN).count() == len(AWKWARD)
    back = bpe.decode(bpe.encode(awkward, digests.RANKS, P.PATTERN), digests.RANKS, P.PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in AWKWARD)
    assert bpe.round_trip(empty, digests.RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("leaf", [2, 64])
def test_edit_counts(awkward, empty, leaf, monkeypatch):
    monkeypatch.setattr(edits, "LEAF", leaf)
    own = bpe.codec(digests.RANKS, P.PATTERN)
    rng, alpha = random.Random(3), ["a", "b", "'", "r", "e", "s", " ", "  ", "\n", "1", "é", "!", "the", "'re"]
    for _ in range(400):
        tree = edits.PieceTree("".join(rng.choice(alpha) for _ in range(rng.randrange(300))), own)
        for _ in range(3):
            tree.edit(rng.randrange(len(tree.text) + 2), rng.randrange(8), "".join(rng.choice(alpha) for _ in range(rng.randrange(5))))
            assert tree.total == len(next(own.encode_many([tree.text]))) // 4
    change = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("drop"), F.lit("x").alias("insert")))
    assert edits.count(awkward.withColumn("edits", change), digests.RANKS, P.PATTERN).count() == len(AWKWARD)
    assert edits.count(empty.withColumn("edits", change), digests.RANKS, P.PATTERN).count() == 0


def _components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) * 100 >= percent * max(len(a), len(sets[j])) and a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("chunk", "region"), [(0, 2000), (150, 3)])
def test_near_duplicates(spark, monkeypatch, chunk, region):
    monkeypatch.setattr(neardup, "REGION", region)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [word() for _ in range(60)]
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(word() for _ in range(30))) for i in range(40)] + [(200, ""), (201, None), (202, "One"), (203, "one"), (204, rows[0][1])]
    got = neardup.linked(spark.createDataFrame(rows, SCHEMA), 2, 80, chunk).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("region", [2000, 4])
def test_near_duplicates_of_documents(spark, monkeypatch, region):
    """Every link of a whole table, by brute force; also where all regions are split again and again."""
    monkeypatch.setattr(neardup, "REGION", region)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = neardup.linked(docs, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows, 2, 80)


def test_prefix_lengths():
    """shared() against a loop, on minima that often agree."""
    rng = np.random.default_rng(1)
    minima = rng.integers(0, 2, (300, 12)).astype(np.uint16)
    rows = sorted((int(t), tuple(m)) for t, m in zip(rng.integers(0, 3, 300), minima.tolist(), strict=True))
    p = np.array([[t, *np.array(m, ">u2").view(">i8")] for t, m in rows], np.int64)
    want = [0] + [0 if a[0] != b[0] else next((i for i in range(12) if a[1][i] != b[1][i]), 12) for a, b in zip(rows, rows[1:], strict=False)]
    assert neardup.shared(p).tolist() == want


def test_near_duplicates_awkward(awkward, empty):
    assert neardup.linked(awkward, 2).count() == len(AWKWARD)
    assert neardup.linked(empty, 2).count() == 0


def test_near_duplicates_share_ids(spark):
    """Rows with one doc_id and several texts, and rows without doc_id, are linked by their own texts."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, b), (9, b + " more"), (None, a + " more"), (None, a + " more"), (None, "alone here now"), (None, None)]
    got = collections.Counter((r.doc_id, r.h, r.component_id, r.kept, r.stays) for r in neardup.linked(spark.createDataFrame(rows, SCHEMA), 2).collect())
    flat = sorted((str(d), c, k, s, n) for (d, _, c, k, s), n in got.items() if c is not None)
    assert flat == [("7", 7, True, True, 1), ("7", 7, True, True, 1), ("9", 7, False, False, 1), ("None", 7, False, False, 2)]
    assert [(k, s) for (_, _, c, k, s) in got if c is None] == [(True, True)] * 2


def test_toxicity(spark, awkward, empty):
    rng = random.Random(2)
    texts = []
    for i in range(400):
        w = [rng.choice("alpha beta gamma delta river stone cloud".split()) for _ in range(30)]
        bad = i % 5 == 0
        texts.append((i, " ".join(w + (["vileword", "groupname"] if bad else [])), int(bad)))
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in texts], SCHEMA), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    m = toxicity.train(docs.filter("doc_id % 2 = 0"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in texts)
    assert toxicity.score(awkward, m).count() == len(AWKWARD)
    assert toxicity.annotate(awkward, m).columns == [*awkward.columns, "toxicity"]
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_long_texts():
    """Terms that training has not kept don't count, however many a text has."""
    rng = np.random.default_rng(3)
    bad = [np.array([1, 2, *rng.choice(np.arange(10, 1000), 20, replace=False)], np.int32) for _ in range(100)]
    good = [rng.choice(np.arange(10, 1000), 22, replace=False).astype(np.int32) for _ in range(400)]
    m = toxicity.fit([np.sort(r) for r in bad + good], np.array([1.0] * 100 + [0.0] * 400))
    long = np.arange(1000, 200_000, dtype=np.int32)
    z = toxicity.margins(m, [long, np.concatenate([[1, 2], long]).astype(np.int32), np.array([1, 2], np.int32)])
    assert math.isclose(z[0], m.bias, abs_tol=1e-6) and z[0] < 0
    assert math.isclose(z[1], z[2], abs_tol=1e-4) and z[1] > 0


def test_interactions():
    """A pair of terms can count though neither does alone."""
    rows = [np.array(x, np.int32) for x in ([1], [2], [1, 2], [3])] * 100
    y = np.array([0.0, 0.0, 1.0, 0.0] * 100)
    m = toxicity.fit(rows, y, bits=4, k=4, epochs=60, clear=0.0, cost=1.0)
    z = toxicity.margins(m, rows[:4])
    assert z[2] > 0 > max(z[0], z[1], z[3])


@pytest.mark.parametrize("kind", ["either", "both"])
def test_interactions_by_default(kind):
    """With default parameters the machine finds pairs that its linear part can't: one of two terms but not both, or an
    insult with a group, each harmless alone."""
    terms, rng = toxicity.Terms(18), np.random.default_rng(1)
    rows, y = [], []
    for _ in range(5000):
        a, b = rng.random(2) < (0.5 if kind == "either" else 0.2)
        words = [f"filler{x}" for x in rng.integers(0, 300, 20)] + ["alpha"] * int(a) + ["beta"] * int(b)
        rows.append(terms(" ".join(words).encode()))
        y.append(float(a != b if kind == "either" else a and b))
    y = np.array(y)
    m = toxicity.fit(rows[:4000], y[:4000])
    right = lambda x: ((toxicity.margins(x, rows[4000:]) >= 0) == (y[4000:] > 0)).mean()
    assert right(m) > 0.99
    assert right(m) > right(toxicity.Machine(m.bits, m.bias, m.weights, m.factors * 0)) + 0.02


def test_sample_is_bounded(spark):
    """Rows that share a doc_id don't break the bound; ids of any type."""
    docs = spark.createDataFrame([("a", f"word{i}") for i in range(50)] + [(f"b{i}", "other") for i in range(5)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1)] + [(f"b{i}", 0) for i in range(5)], "doc_id string, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels, max_rows=3)).count() == 55


def test_mixer(spark, awkward, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0
    got = {r.doc_id: r for r in mixer.score(docs, train).collect()}
    counts, rows = collections.Counter(), docs.collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update([*r.text.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    held = base = 0.0
    for r in rows:
        w = [*r.text.encode().lower().split(), None]
        g = got[r.doc_id]
        want = math.fsum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert math.isclose(g.base_score, want, rel_tol=1e-9)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        if not g.train:
            held, base = held + g.score, base + g.base_score
    assert held > base
    assert mixer.score(awkward, F.lit(True)).count() == len(AWKWARD)
    assert mixer.score(awkward, F.lit(False)).count() == len(AWKWARD)
    assert mixer.score(empty, F.lit(True)).count() == 0


def test_mixer_words(spark):
    """Texts are split into the same words as by bytes.lower().split(), whatever they hold, many at a time and in small slices."""
    odd = [t or "" for _, t in AWKWARD] + ["", " ", "\n\t", " a ", "A\x0bB\x0cc\x1cd\x85e\u00a0f\u2003g", "\u0130\u00c4 \u00e4 K", "\x00 \x00a", "x" * 5000, " y" * 3000]
    texts = pa.array([x for t in odd for x in (t, t + " end")])
    words, starts = mixer.split(texts)
    want = [t.encode().lower().split() for t in texts.to_pylist()]
    assert [words.cast(pa.binary()).to_pylist()[a:b] for a, b in itertools.pairwise(starts.tolist())] == want
    b = pa.record_batch([texts, pa.array([len(t.encode()) for t in texts.to_pylist()])], names=["text", "n"])
    old, mixer.SLICE = mixer.SLICE, 4000
    try:
        parts = list(mixer.slices(b, 1))
    finally:
        mixer.SLICE = old
    assert len(parts) > 3 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))


def test_mixer_memory(spark, tmp_path, monkeypatch):
    """Every worker of the mixer gets a few MB at a time, and scores don't depend on the batches."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.concat(F.lit(" word"), F.col("id").cast("string")), 1500), F.lit(" end")).alias("text")).coalesce(1)
    plain, seen = type(docs).mapInArrow, str(tmp_path)

    def watched(df, run, *rest):
        def look(batches):
            for b in batches:
                with open(f"{seen}/{os.getpid()}", "a") as f:
                    f.write(f"{b.nbytes}\n")
                yield b

        return plain(df, lambda batches: run(look(batches)), *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    train = F.col("doc_id") % 10 != 0
    got = {r.doc_id: r.score for r in mixer.score(docs, train).collect()}
    sizes = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert len(got) == 900 and max(sizes) > 1 << 20
    assert max(sizes) < 8 << 20
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(100_000))
    monkeypatch.setattr(mixer, "GATHERED", 1)
    try:
        small = {r.doc_id: r.score for r in mixer.score(docs, train).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert all(math.isclose(got[k], small[k], rel_tol=1e-12) for k in got)


def test_mixer_gathers(monkeypatch):
    """Small batches are mixed together, rows in turn; texts laid out from a slice are those of the slice."""
    monkeypatch.setattr(mixer, "GATHERED", 100)
    batches = [pa.record_batch([pa.array(range(i, i + n), pa.int64())], names=["x"]) for i, n in ((0, 5), (5, 0), (5, 9), (14, 30), (44, 1))]
    assert [b.column(0).to_pylist() for b in mixer.gathered(iter(batches))] == [list(range(14)), list(range(14, 44)), [44]]
    assert not list(mixer.gathered(iter([])))
    values, starts = np.arange(12, dtype=np.uint16), np.array([0, 3, 3, 4, 12])
    variants, classes = mixer.joined(values, starts), mixer.joined(np.arange(244, 256, dtype=np.uint8), starts)
    own = mixer.Texts(variants.slice(1), classes.slice(1), (np.zeros(1, np.int32), np.zeros(12, np.int64), np.zeros(12, np.int64), 1))
    assert own.variants.tolist() == list(range(3, 12)) and own.starts.tolist() == [0, 0, 1, 9]
    assert own.one.tolist() == [0, 0, *range(248, 255)]
    assert own.two.tolist() == [0, 0, 248, *(a * 256 + a + 1 for a in range(248, 254))]


def test_licences(spark, awkward, empty):
    rows = [(1, "x\nReleased under the MIT License.\nAll rights reserved, cc BY 4"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the license is under the table"), (4, "RELEASED under MIT license")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels, got[1].score) == (12, 2, 6, 9, "cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert (got[2].labels, got[3].labels, got[4].labels, got[4].score) == ("apache", "", "mit", 0.8)
    assert licences.scan(awkward).count() == len(AWKWARD)
    assert licences.scan(empty).count() == 0


def test_licences_across_lines(spark):
    """Wrapped statements are found, scattered words of one long line aren't; against brute force over all windows."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    far = " ".join(["released", *["x"] * 30, "under", *["y"] * 30, "the", *["z"] * 30, "license"])
    rng, some = random.Random(6), "released under the mit license public domain software into all rights reserved a".split()
    rows = [(1, bsd), (2, far), (3, "This work is licensed under a\nCreative Commons\nAttribution 4.0\nInternational License"), (4, bsd + "\nx" * 60 + "\n" + bsd), (5, "released under the terms of the MIT license")]
    rows += [(10 + i, "".join(rng.choice(some) + rng.choice([" ", "\n", " q "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, SCHEMA), phrases={"no such phrase": "none"}).collect()}
    assert [got[i].labels for i in (1, 2, 3, 5)] == ["bsd", "", "cc-by", "mit"] and [b.label for b in got[4].blocks] == ["bsd"] * 2
    for i, text in rows:
        words, want = "".join(c if c.isalnum() else " " for c in text.lower()).split(), []
        for t, label in licences.TEMPLATES.items():
            own, width, last = set(t.split()), 2 * len(t.split()), None
            for j, w in enumerate(words):
                part = len(own & set(words[j : j + width])) / len(own)
                if w in own and part >= 0.8:
                    if last is not None and j < last + width:
                        want[-1] = (want[-1][0], label, max(part, want[-1][2]))
                    else:
                        want.append((j, label, part))
                    last = j
        assert [tuple(b) for b in got[i].blocks] == want


def test_licence_table(spark):
    """Templates from a table of many, by brute force over sets; copies of one text are scanned alike."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    table = [(f"l{i}", " ".join(rng.sample(words, rng.randrange(3, 8)))) for i in range(60)] + [("none", " ,; ")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(80)] + [(200 + i, "w1 w2 w3 w4 w5 w6") for i in range(50)]
    got = licences.scan(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(table, "label string, text string"), phrases={"no such": "x"}).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t, want = texts[r.doc_id].split(), set()
        for label, text in table[:-1]:
            own, width = set(text.split()), 2 * len(text.split())
            if any(len(own & set(t[j : j + width])) >= 0.8 * len(own) - 1e-9 for j in range(len(t))):
                want.add(label)
        assert r.labels == ",".join(sorted(want))


def test_spots(spark, awkward, empty):
    rows = spark.createDataFrame([r for r in AWKWARD], SCHEMA).collect()
    got = spots.compare_with_next(awkward.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    order = sorted(((r.doc_id if r.doc_id is not None else -(2**63), r.text or "", r.doc_id) for r in rows), key=lambda x: (-x[0], x[1]))
    by = collections.Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got)
    import hashlib

    for i, (_, t, d) in enumerate(order):
        nxt, half = order[(i + 1) % len(order)][1], len(t) // 2
        by[(d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())] -= 1
    assert set(by.values()) == {0}
    assert spots.compare_with_next(empty).count() == 0
    a = spots.spots(b"the quick brown fox is in the old house and the big garden")
    assert spots.likeness(a, a) == 1 and spots.likeness(a, frozenset()) == 0 and spots.likeness(frozenset(), frozenset()) == 1
    assert spots.likeness(a, frozenset([1]), 0.5) == 0


def test_spots_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(spots, "RANGE_BYTES", 1)
    rows = [(i * 7 % 50, f"text {i} of the words in a row") for i in range(50)]
    a = spots.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    monkeypatch.setattr(spots, "RANGE_BYTES", 10**9)
    b = spots.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 50


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 16))
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(1000 + i, [float(x) for x in v[0]]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, [1.0] * 16)]
    got = crosspoly.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    good = [(i, np.array(x)) for i, x in rows[:630]]
    m = np.array([x for _, x in good])
    found = total = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    for i, x in good:
        if i % 20 == 0:
            s = sorted(((-float((m[j] * x).sum()), good[j][0]) for j in range(len(good)) if good[j][0] != i))[:20]
            mine = sorted(by[i], key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
            assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
            found += len({b for _, b in s} & {r.vec_id for r in mine})
            total += len(s)
    assert found >= 0.9 * total
    assert crosspoly.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def _exact(vectors, ids, at, k=20):
    s = vectors @ vectors[at]
    keep = np.flatnonzero(ids != ids[at])
    return s[keep][np.lexsort((ids[keep], -s[keep]))[:k]]


@pytest.mark.parametrize(("dim", "sigma", "longer"), [(64, 0.0, 1), (64, 0.3, 1), (64, 0.0, 10), (128, 0.0, 1), (300, 0.1, 1)])
def test_nearest_of_uneven_lengths(spark, dim, sigma, longer):
    """Recall by brute force with several tables and bands; every query finds k."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, dim))
    v *= np.exp(sigma * rng.standard_normal((3000, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    v[7] *= longer
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = crosspoly.search(rows, F.col("vec_id") % 50 == 0).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 60
    found = sum((g.score.to_numpy() >= _exact(v, np.arange(3000), q)[-1] - 1e-9).sum() for q, g in got.groupby("query_id"))
    assert found >= 0.9 * 1200


def test_nearest_of_embeddings(spark):
    """Recall by brute force on the table itself, and the share of pairs that are looked at."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = rows.select("vec_id", "embedding").toPandas()
    v, ids = np.array(t.embedding.tolist(), dtype=np.float64), t.vec_id.to_numpy()
    got = crosspoly.search(rows, F.col("vec_id") % 20 == 0).toPandas()
    by = dict(list(got.groupby("query_id")))
    at = np.flatnonzero(ids % 20 == 0)
    assert sum((by[ids[i]].score.to_numpy() >= _exact(v, ids, i)[-1] - 1e-9).sum() for i in at) >= 0.9 * 20 * len(at)


def test_nearest_extremes(spark):
    """Components that are huge or tiny take part, vectors of other lengths meet their own kind, a query's own id never counts."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    for scale in (1e200, 1e-200):
        rows = spark.createDataFrame([(i, (r * scale).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = crosspoly.search(rows, F.col("vec_id") == 0).orderBy("rank").collect()
        assert len(got) == 20 and len({r.vec_id for r in got}) == 20
        assert not np.isfinite(got[0].score) if scale > 1 else got[0].score == 0  # the products are beyond doubles
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(100 + i, [1.0, 0.0, float(i)]) for i in range(5)] + [(0, [5.0, 5.0]), (0, [1.0, 0.0])]
    got = crosspoly.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 100), k=3).collect()
    ranked = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        ranked[r.query_id].append((r.vec_id, r.score))
    assert ranked[100] == [(101, 1.0), (102, 1.0), (103, 1.0)]
    assert len(ranked[0]) == 6 and all(i not in (0, 100) for i, _ in ranked[0])  # two vectors of id 0, three rows each


def test_nearest_among_near_copies(spark):
    """A third of all vectors are copies that sketches can't tell apart: their queries go through the buckets again."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3000, 32))
    v[::3] = v[0] + 1e-4 * rng.standard_normal((1000, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = crosspoly.search(rows, F.col("vec_id") % 50 == 0).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 60
    found = sum((g.score.to_numpy() >= _exact(v, np.arange(3000), q)[-1] - 1e-9).sum() for q, g in got.groupby("query_id"))
    assert found >= 0.9 * 1200


def _tie_rows():
    return [(i, [1.0, 0.0]) for i in range(2000)] + [(5000 + i, [0.0, 1.0]) for i in range(5)]


def test_nearest_ties(spark):
    """A vector that most rows share: its smallest ids, repeated rows as often as they are there."""
    rows = _tie_rows() + [(3, [1.0, 0.0])] * 2
    got = crosspoly.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 1500), k=6).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, x) for x in (1, 2, 3, 3, 3, 4)] + [(1500, x) for x in (0, 1, 2, 3, 3, 3)]


def test_mixing(spark):
    rows = [(i, "a" if i < 80 else "b" if i < 95 else None, "x" * 40) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = mixing.four_bytes(F.col("text"))
    totals = mixing.source_totals(docs, tokens)
    plan = {r.source: r for r in mixing.plan(totals, repeats=2.0).collect()}
    assert math.isclose(sum(r.weight for r in plan.values()), 1, rel_tol=1e-9)
    assert math.isclose(plan[None].goal / plan[None].tokens, 2.0, rel_tol=1e-6) and plan["a"].blocks == 1
    got = mixing.draw(docs, mixing.plan(totals, repeats=2.0), tokens).collect()
    n = collections.Counter(r.doc_id for r in got)
    assert set(n) == set(range(100)) and max(n.values()) == 2
    for budget in (300, 1000, 5000):
        p = {r.source: r for r in mixing.plan(totals, entropy=0.9, budget=budget).collect()}
        got = collections.Counter()
        for r in mixing.draw(docs, mixing.plan(totals, entropy=0.9, budget=budget), tokens).collect():
            got[r.source] += 10
        for s, r in p.items():
            assert r.goal - 10 - 1e-6 <= got[s] <= r.goal + 1e-6
    assert mixing.draw(docs.limit(0), mixing.plan(mixing.source_totals(docs.limit(0), tokens), repeats=2.0), tokens).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "Hello there.\nSecond line."), (1, 1, "On Monday A wrote:\n> Hello   there.\n> second LINE.\nMy answer."),
        (1, 2, ">> Hello there.\n>> Second line.\n> My answer.\nThanks."), (1, 3, "> Second line.\npartly"), (2, 0, "> Thanks.\nelsewhere"), (2, 1, "> nowhere\nlost"), (3, 0, None), (3, 1, ""), (None, 1, "> x"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert len(got) == len(rows)
    pick = lambda *k: (got[k].n_quotes, got[k].n_linked, got[k].reply_conv, got[k].reply_turn, got[k].clean)
    assert pick(1, 1) == (1, 1, 1, 0, "My answer.")
    assert pick(1, 2) == (2, 2, 1, 1, "Thanks.") and got[1, 2].deepest == 2
    assert pick(1, 3) == (1, 1, 1, 0, "partly")
    assert pick(2, 0) == (1, 1, 1, 2, "elsewhere")
    assert pick(2, 1) == (1, 0, None, None, "lost")
    assert pick(3, 0) == (0, 0, None, None, "")


def test_partial_quotations(spark):
    """Any line links a passage; most lines win, then the later message; other conversations come last."""
    rows = [
        (1, 0, "alpha\nbeta\ngamma"), (1, 1, "alpha\ndelta"), (1, 2, ">\n> beta\n> gamma\nx"), (1, 3, "> alpha\n> beta\n> gamma changed\ny"),
        (1, 4, "> reworded\n> delta\nz"), (1, 5, "> alpha\nw"), (2, 0, "> new words\n> beta\n> gamma\nv"), (2, 1, "> alpha\nu"),
    ]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [got[k] for k in [(1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (2, 1)]] == [(1, 0), (1, 1), (1, 1), (1, 1), (1, 0), (1, 0)]


def test_reply_order(spark):
    """Threads depth first, across conversations, with rings, copies and shared keys; against brute force."""
    talk = [
        (1, 0, "one"), (1, 1, "> one\ntwo"), (1, 2, "> two\nthree"), (1, 3, "> one\nfour"),  # 3 replies to 0
        (2, 0, "> two\nfive"), (2, 1, "> five\nsix"),  # another conversation, placed in the first
        (3, 0, "> eight\nseven"), (4, 0, "> seven\neight"), (4, 1, "> eight\nnine"), (7, 0, "> nine\nten"),  # a ring, and what hangs on it
        (5, 0, "> eleven\neleven"), (6, 0, "> later"), (6, 1, "later"),  # neither itself nor what comes later
        (8, 0, "x"), (8, 0, "x"), (8, 1, "> x\ny"), (None, 1, "> one"), (2, None, "> one"),
    ]
    run = lambda rows: quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    by = collections.defaultdict(list)
    for r in run(talk):
        by[r.thread_conv, r.thread_turn].append((r.place, r.conv_id, r.turn))
    want = {
        (1, 0): [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 2, 0), (4, 2, 1), (5, 1, 3)], (3, 0): [(0, 3, 0), (1, 4, 0), (2, 4, 1), (3, 7, 0)],
        (5, 0): [(0, 5, 0)], (6, 0): [(0, 6, 0)], (6, 1): [(0, 6, 1)], (8, 0): [(0, 8, 0), (0, 8, 0), (2, 8, 1)], (None, 1): [(0, None, 1)], (2, None): [(0, 2, None)],
    }
    assert {k: sorted(v) for k, v in by.items()} == want
    # Random replies: each message has a line of its own; a chain of 150 is deeper than one doubling.
    rng = random.Random(3)
    keys = [(c, t) for c in range(12) for t in range(8)] + [(20, t) for t in range(150)]
    up = {k: (20, k[1] - 1) if k[0] == 20 and k[1] else rng.choice([None, *([(k[0], rng.randrange(k[1]))] * 3 if k[1] else []), rng.choice([x for x in keys if x[0] != k[0]])]) for k in keys}
    say = lambda k: f"said {k[0]} {k[1]}"
    got = run([(*k, (f"> {say(up[k])}\n" if up[k] else "") + say(k)) for k in keys])
    assert {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in got} == {k: up[k] or (None, None) for k in keys}
    for k in keys:  # rings begin with their smallest
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is not None:
            up[min(seen[seen.index(at) :])] = None
    order, below = {}, collections.defaultdict(list)
    for k in sorted(keys):
        below[up[k]].append(k)
    for root in below[None]:
        todo, n = [root], 0
        while todo:
            k = todo.pop()
            order[k], n = (*root, n), n + 1
            todo += reversed(below[k])
    assert {(r.conv_id, r.turn): (r.thread_conv, r.thread_turn, r.place) for r in got} == order


def test_quotation_query_in_reply_order(spark, tmp_path):
    """The query's rows come in reply order: a conversation that quotes another follows the message quoted."""
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 0, "elsewhere"), (9, 0, "the last"), (0, 0, "> the last\nfirst by number"), (0, 1, "more")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.conv_id, r.turn) for r in queries.QUERIES["op1_quotation_links"](spark, str(tmp_path)).collect()]
    assert got == [(1, 0), (1, 1), (2, 0), (9, 0), (0, 0), (0, 1)]


def test_quotation_query_keeps_rows(spark, tmp_path):
    """Rows that share a key, or have none, are messages of their own."""
    rows = [(1, 0, "first"), (1, 1, "x"), (1, 1, "y\n> nowhere\nz"), (1, 1, "x"), (1, 2, "last"), (None, None, "p"), (None, None, "q"), (1, None, "r"), (1, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = collections.Counter((r.conv_id, r.turn, r.n_quotes, r.n_linked, r.reply_turn, r.clean_sha256) for r in queries.QUERIES["op1_quotation_links"](spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 0, 0, 0, None, sha("first")), *[(1, 1, 1, 1, 0, sha("x"))] * 2, (1, 1, 2, 1, 0, sha("y\nz")), (1, 2, 2, 2, 1, sha("last"))]
    want += [(None, None, 0, 0, None, sha("p")), (None, None, 0, 0, None, sha("q")), (1, None, 0, 0, None, sha("r")), (1, None, 0, 0, None, sha(""))]
    assert got == collections.Counter(want)


def test_quotation_query_equals_sql(spark):
    _quotation_query_equals_sql(spark, DATA, f"{DATA}/conversations.parquet")


def test_quotation_query_equals_sql_on_ties(spark, tmp_path):
    rows = [(1, 0, "first"), (1, 0, "earlier\nof two"), (1, 1, "b"), (1, 1, "b"), (1, 1, "c"), (1, 2, "last"), (None, None, "p"), (None, 0, None), (2, 0, ""), (2, 1, "after nothing")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    _quotation_query_equals_sql(spark, str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")


def _quotation_query_equals_sql(spark, folder, files):
    df = queries.QUERIES["op1_quotation_links"](spark, folder)
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{files}'")
    r = c.execute(queries.ORACLES["op1_quotation_links"])
    names = [x[0] for x in r.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def test_pipeline(spark):
    """Each stage against brute force on the whole smallest table and awkward rows."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(10**6 + (i or 0), t, None, None, None) for i, t in AWKWARD if i is not None] + [(None, "no id here", None, None, None)]
    docs = table.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    # Toxicity: what goes scores 0.5 or more; few clean labelled documents go.
    clean = stages["toxicity"](spark, docs, DATA)
    assert clean.columns == docs.columns
    m = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = toxicity.score(docs, m).collect()
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(r.doc_id for r in scores if r.score < 0.5)
    # Near copies: one row of each component.
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    single = stages["near copies"](spark, docs, DATA)
    assert single.columns == docs.columns
    want = sorted({d for d, _, c in _components([r for r in rows if r[0] is not None], 5, 80) if d == c})
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == want
    assert single.filter("doc_id is null").count() == 1
    # Mixing: each document once at least, whole permutations, and none more than the limit rounded up.
    mixed = stages["mixing"](spark, single, DATA)
    assert mixed.columns == docs.columns
    drawn = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(drawn) == {r.doc_id for r in single.select("doc_id").collect()}
    assert max(drawn.values()) <= math.ceil(corpus_pipeline.REPEATS)
    # Encoding: as tiktoken, row by row.
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(digests.RANKS), special_tokens={})
    by = dict(rows)
    for r in stages["encoding"](spark, mixed, DATA).collect():
        ids, text = np.array(ref.encode_ordinary(by[r.doc_id] or ""), "<u4"), (by[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.select("doc_id").distinct().count() <= table.count()


def test_batches_are_bounded(spark, monkeypatch):
    """Workers get texts a few MB at a time, not 64: the batch behind each column that operators look at."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.repeat(F.concat(F.lit(" "), F.col("id").cast("string")), 1500)).alias("text")).coalesce(1)
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))

    def looked_at(column):
        if column.get_total_buffer_size() > 16 << 20:
            raise ValueError("a large batch")
        return [b"" for _ in range(len(column))]

    class Codec:
        length_of, cache = np.ones(1, np.int64), {}

        def encode_many(self, many):
            if sum(map(len, many)) > 16 << 20:
                raise ValueError("a large batch")
            return [bytes(4) for _ in many]

        def decode(self, ids):
            return ids

    monkeypatch.setattr(toxicity, "texts", looked_at)
    monkeypatch.setattr(neardup, "texts", looked_at)
    monkeypatch.setattr(bpe, "codec", lambda path, pattern: Codec())
    machine = toxicity.train(docs, labels)
    assert toxicity.annotate(docs, machine).agg(F.count("toxicity")).first()[0] == toxicity.score(docs, machine).agg(F.count("score")).first()[0] == 3000
    assert neardup.described(docs, 5).agg(F.sum("n_shingles"), F.count("doc_id")).first() == (0, 3000)
    assert bpe.round_trip(docs, digests.RANKS, P.PATTERN).agg(F.sum("n_tokens"), F.count("doc_id")).first() == (3000, 3000)


CLASHING = ["row", "_id", "_h", "_s", "_source", "_tokens", "_last", "_slice", "_block", "_key", "_weight", "_n", "blocks", "rest", "_toxicity", "toxicity", "score", "h", "node", "id", "key", "word", "train", "first"]


def test_clashing_columns(spark):
    """Columns with the names that operators and stages use inside stay as they are."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"some words of text {i % 7} here", "abc"[i % 3], *[7] * len(CLASHING)) for i in range(40)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, DATA)
        assert own.columns == docs.columns, name
        assert {r[c] for r in own.collect() for c in CLASHING} == {7}, name
    drawn = mixing.draw(docs, mixing.plan(mixing.source_totals(docs, mixing.four_bytes(F.col("text"))), repeats=2.0), mixing.four_bytes(F.col("text")))
    assert drawn.columns == [*docs.columns, "_block_", "_key_", "_weight_"]
    n = docs.count()
    assert neardup.linked(docs, 2).count() == mixer.score(docs, F.lit(True)).count() == licences.scan(docs).count() == spots.compare_with_next(docs).count() == n
    assert bpe.round_trip(docs, digests.RANKS, P.PATTERN).count() == n
    talk = docs.withColumn("conv_id", F.col("doc_id")).withColumn("turn", F.lit(0).cast("long"))
    assert quotes.threads(talk).count() == n
    assert crosspoly.search(docs.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.rand(1), F.rand(2))), F.col("vec_id") == 0).count() == 20
