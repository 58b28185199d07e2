"""Small exact cases of the operators."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest import registry
from palimpsest.functions import codecs
from palimpsest.operators import access, diff, graph, manifest, order, publish, refs, store
from palimpsest.sources import inventory, json_table, point, record_files, tree


def test_longest_prefix(spark):
    policies = spark.createDataFrame([("security", ["team/security"]), ("security/prod", ["admin"])], "prefix string, domains array<string>")
    paths = ["security", "security/repro.test.ts", "security-notes.md", "security/prod/secrets.env"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    want = {"security": "team/security", "security/repro.test.ts": "team/security", "security-notes.md": "public", "security/prod/secrets.env": "admin"}
    for f in (access.with_policy, access.with_policy_theta):
        assert {r.path: r.domains[0] for r in f(df, policies).collect()} == want


def test_access(spark):
    df = spark.createDataFrame([(["public"], ["public"], True), (["public"], ["admin"], False), (["admin"], [], True), (["public"], [], False), (["x"], ["x", None], True)], "a array<string>, p array<string>, ok boolean")
    assert df.filter(access.can_access(F.col("a"), F.col("p")) != F.col("ok")).count() == 0


def test_domains_and_paths(spark):
    df = spark.createDataFrame([([" team/security ", "public", "team/security"], "././a\\b"), ([" "], ".\\x")], "d array<string>, p string")
    rows = df.select(manifest.normalized_domains(F.col("d")).alias("d"), manifest.normalized_path(F.col("p")).alias("p")).collect()
    assert [(r.d, r.p) for r in rows] == [(["public", "team/security"], "a/b"), (["public"], "./x")]


@pytest.mark.parametrize(("path", "why"), [("a/b", None), ("a//b", "empty"), ("a/..", "unsafe"), ("a/b?", "not_portable"), ("a/NUL.txt", "reserved"), ("a./b", "reserved"), ("x" * 256, "too_long"), ("/".join(["y" * 200] * 6), "path_too_long")])
def test_path_problem(spark, path, why):
    assert spark.createDataFrame([(path,)], "p string").select(manifest.path_problem(F.col("p"))).first()[0] == why


def test_collisions(spark):
    at = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert manifest.collisions(at("Foo", "foo")).count() == 1
    assert manifest.collisions(at("Dir/left", "dir/right")).count() == 1
    assert manifest.collisions(at("left/Foo", "right/foo")).count() == 0
    assert [tuple(r) for r in manifest.files_under_files(at("Parent", "parent/child")).collect()] == [("Parent", "parent/child")]


def test_diff_and_merge(spark):
    m = lambda **f: spark.createDataFrame(list(f.items()), "path string, hash string")
    got = {r.path: r.status for r in diff.diff(m(a="1", b="1", c="1"), m(a="1", b="2", d="1")).collect()}
    assert got == {"b": "modified", "c": "deleted", "d": "added"}
    plan = {r.path: (r.outcome, r.kind) for r in diff.merge(m(a="1", b="1", c="1", g="1"), m(a="2", b="1", c="2", d="1", e="1"), m(a="1", b="3", d="2", e="1", f="1")).collect()}
    assert plan == {"a": ("keep_line", None), "b": ("take_incoming", None), "c": ("conflict", "delete_modify"), "d": ("conflict", "add_add"), "e": ("keep_line", None), "f": ("take_incoming", None), "g": ("delete", None)}


def test_generations(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCDE"], "node string")
    edges = spark.createDataFrame([("C", "A"), ("D", "A"), ("D", "B"), ("E", "C"), ("E", "D"), ("E", "D")], "node string, parent string")
    assert {r.node: r.generation for r in graph.generations(nodes, edges).collect()} == {"A": 0, "B": 0, "C": 1, "D": 1, "E": 2}


def test_cas(spark):
    rows = [(1, 0, 10, None), (1, 1, 11, 0), (1, 2, 12, 0), (1, 3, 13, 1), (2, 0, 20, 5), (2, 1, 21, None)]
    got = {r.attempt: r.outcome for r in refs.cas_outcomes(spark.createDataFrame(rows, "key int, seq long, attempt int, expected long")).collect()}
    assert got == {10: "accepted", 11: "accepted", 12: "conflict", 13: "accepted", 20: "conflict", 21: "accepted"}


def test_fold_against_a_loop(spark):
    """Early, stale and repeated attempts: key 1 is absent when 10 expects generation 0."""
    rng = random.Random(3)
    rows = [(1, 0, 10, 0), (1, 1, 11, None), (1, 2, 12, 0)]
    rows += [(k, i, 100 * k + i, rng.choice([None, 0, 1, 2, 3])) for k in range(2, 40) for i in range(rng.randrange(1, 30))]
    want, state = {}, {}
    for k, _, a, e in sorted(rows):
        won = state.get(k) == e
        state[k] = (0 if e is None else e + 1) if won else state.get(k)
        want[a] = ("accepted" if won else "conflict", state[k])
    got = publish.fold(spark.createDataFrame(rows, "key long, seq long, attempt long, expected long"))
    assert {r.attempt: (r.outcome, r.generation) for r in got.collect()} == want
    assert want[10][0] == "conflict" and want[11][0] == want[12][0] == "accepted"


def test_refusals(spark):
    m = lambda *rows: spark.createDataFrame(list(rows), "path string, hash string")
    fine = m(("a", "1"))
    for bad in (m(("a", "1"), ("a", "2")), m(("Straße", "1"), ("STRASSE", "2"))):
        for sides in ((bad, fine, fine), (fine, bad, fine), (fine, fine, bad)):
            with pytest.raises(ValueError, match="duplicate|collision"):
                diff.checked_merge(*sides)
    with pytest.raises(ValueError, match="collision in merged"):
        diff.checked_merge(m(), m(("Foo", "1")), m(("foo", "1")))
    assert diff.checked_merge(fine, fine, m(("a", "2"))).count() == 1


def test_cycles_are_errors(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "node string, parent string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    for bad in (e(("a", "b"), ("b", "a"), ("c", "a")), e(("a", "gone"))):
        with pytest.raises(ValueError, match="cycle"):
            graph.generations(n, bad)
    assert {r.node for r in graph.generations(n, e(("a", "b"), ("b", "a"), ("c", "a")), strict=False).collect()} == set()


def test_repeated_rows_keep_their_policy(spark):
    df = spark.createDataFrame([("p/x",), ("p/x",)], "path string")
    p = spark.createDataFrame([("p", ["admin"])], "prefix string, domains array<string>")
    assert access.with_policy_theta(df, p).count() == access.with_policy(df, p).count() == 2


def test_deep_groups(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "group long, member long")
    assert access.members(chain).filter("group = 0").count() == 60


def test_positions(spark):
    names = ["b/a", "b-a", "a", "é", "Z", "ab", "b"]
    df = spark.createDataFrame([(x,) for x in names], "p string")
    got = lambda *by: [r.p for r in order.positions(df, *by).orderBy("position").collect()]
    assert got(F.col("p")) == sorted(names, key=str.encode)
    assert got(order.by_segments(F.col("p"))) == sorted(names, key=lambda x: [s.encode() for s in x.split("/")])
    assert got(order.by_encoded_name(F.col("p"))) == sorted(names, key=lambda x: (len(x.encode()), x.encode()))


def test_records_of_files(spark, tmp_path):
    places = {"objects/loose/0/12/ab/one.rgl": b"payload", "objects/loose/0/12/ab/two.rgl": None, "objects/tmp/x": None, "objects/other": None}
    for name, payload in places.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(codecs.record(codecs.object_id(bytes(32)), 2, 0, payload, b"MAGIC") if payload else b"MAGIC")
    got = {r.path: (r.status, r.payload) for r in record_files(spark, str(tmp_path), b"MAGIC").collect()}
    assert got["objects/loose/0/12/ab/one.rgl"] == ("ok", b"payload") and got["objects/loose/0/12/ab/two.rgl"] == ("the number is cut", None)
    assert {r.status for r in record_files(spark, str(tmp_path), b"MAGIC", audited=False).collect()} == {"ok", "unavailable"}
    assert {r.path: r["class"] for r in inventory(spark, str(tmp_path)).collect()} == dict(zip(places, ("unindexed_orphan", "unindexed_orphan", "stale_temporary", "unexpected"), strict=True))


def test_put_outcomes(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "object string, payload binary")
    got = store.put_outcomes(rows(("a", b"1"), ("b", b"1")), rows(("a", b"1"), ("b", b"2"), ("c", b"3"), ("c", b"3"), ("d", b"1"), ("d", b"2")))
    assert {r.object: r.outcome for r in got.collect()} == {"a": "already_present", "b": "quarantined", "c": "stored", "d": "quarantined"}


def test_blake3_and_identities():
    """Published vectors: bytes 0, 1, ... 250, 0, ... of each length."""
    data = bytes(i % 251 for i in range(3000))
    assert codecs.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert codecs.blake3(data[:1]).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert len({codecs.blake3(data[:n]) for n in (1023, 1024, 1025, 2048, 2049, 3000)}) == 6
    text = codecs.object_text(codecs.object_id(bytes(32)), "id_")
    for bad in (text.upper(), text[:-1], text + "0", "id_!", "xx_" + text[3:]):
        with pytest.raises(codecs.Malformed):
            codecs.read_object_text(bad, "id_")
    assert codecs.diagnostic({0: [b"\x01", None], 5: {1: "x"}}) == {"0": ["hex:01", None], "5": {"1": "x"}}
    assert codecs.signing_preimage(b"S\0", 1, 2, b"a" * 16, b"k" * 32, 10, 300, b"xy") == b"S\0\x00\x01\x02" + b"a" * 16 + b"\x20" + b"k" * 32 + b"\x0a\xac\x02\x02xy"


def test_sources(spark, tmp_path):
    assert json_table(spark, str(tmp_path / "none"), "name string").count() == 0
    (tmp_path / "x.json").write_text('{\n "name": "a"}')
    df = json_table(spark, str(tmp_path), "name string")
    assert point(df, "name", "a").count() == 1
    with pytest.raises(LookupError):
        point(df, "name", "b")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/y").write_text("y")
    assert [r.path for r in tree(spark, str(tmp_path)).collect()] == ["x.json"]


def test_codecs():
    for n in (0, 127, 128, 300, 2**64 - 1):
        assert codecs.read_uvarint(codecs.uvarint(n)) == (n, len(codecs.uvarint(n)))
    for bad in (b"\x80\x00", b"\x80", b"\xff" * 9 + b"\x02", b""):
        with pytest.raises(codecs.Malformed):
            codecs.read_uvarint(bad)
    value = {0: 1, 3: [b"x", "é", None, True, -5], 300: {}}
    assert codecs.read_cbor(codecs.cbor(value)) == value
    for bad in (b"\x18\x01", b"\xa2\x01\x00\x00\x00", b"\xa2\x00\x00\x00\x00", b"\xf9\x00\x00", b"\x9f\xff", b"\xc0\x00", b"\x62a", b"\x01\x01", b"\x63e\xcc\x81"):
        with pytest.raises(codecs.Malformed):
            codecs.read_cbor(bad)
    ident = codecs.object_id(bytes(32))
    assert codecs.read_object_text(codecs.object_text(ident, "id_"), "id_") == ident
    r = codecs.record(ident, 2, 0, b"payload", b"MAGIC")
    assert codecs.read_record(r, b"MAGIC") == (ident, 2, 0, b"payload")
    for i in range(len(r)):
        with pytest.raises(codecs.Malformed):
            codecs.read_record(r[:i], b"MAGIC")
    data = bytes(5_000_000)
    assert sum(codecs.chunk_lengths(data)) == len(data)
    assert max(codecs.chunk_lengths(data)) <= codecs.LARGEST
    assert codecs.chunk_lengths(b"") == []


def test_case_fold_of_whole_texts(spark, tmp_path):
    """Every word is folded, not the first one only."""
    texts = ["One STRASSE Straße", "a ﬁne Cafe\u0301 İ", " ", "", None, "x\nÀ\tΣΑΣ " * 2000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.folded for r in registry.QUERIES["case_fold_full"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t.casefold()) for i, t in enumerate(texts)}
