"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: words (runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased) and the
word starts of four, five and six bytes, hashed to 2**bits slots. The machine gives each slot a weight and a vector of k factors,

    z = bias + sum w_i x_i + 1/2 (|sum v_i x_i|^2 - sum |v_i x_i|^2),    score = 1 / (1 + exp(-z)),

so a pair of terms (an insult with the mention of a group) can weigh more, or less, than the sum of both. It learns by
AdaGrad on log loss from a bounded sample of labelled rows: at most max_rows of them, the first by a hash of doc_id
(every labelled row where there are fewer). The model's size is fixed by bits and k, so it may be sent to every executor.

A slot is learnt for its own effect, or for that of its pair with another slot: neither of two terms need say anything alone.

Edge cases: other columns may have any names; null and empty texts have no terms and get the bias alone; a null label or doc_id takes no part in learning;
a doc_id that is labelled twice counts toxic if any label says so; repeated rows are scored each; without labelled rows,
or with labels of one class only, the bias is the smoothed log odds and the other weights are zero; empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fresh, mapped, release, texts

#: Bytes of a word, lower-cased, and a space for every other byte.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Machine:
    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray


class Terms:
    """Slots of a text, each once, in order. Slots of seen words are kept packed, for up to keep words."""

    def __init__(self, bits: int, keep: int = 150_000):
        self.mask, self.keep, self.seen = (1 << bits) - 1, keep, {}

    def pack(self, w: bytes) -> bytes:
        """The word's slot, and those of its starts of four, five and six bytes."""
        slots = [zlib.crc32(w), *(zlib.crc32(w[:n], n) for n in (4, 5, 6) if len(w) >= n)]
        return array("i", [x & self.mask for x in slots]).tobytes()

    def __call__(self, text: bytes) -> np.ndarray:
        words, seen = set(text.translate(WORD).split()), self.seen
        if len(seen) > self.keep:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = self.pack(w)
        return np.unique(np.frombuffer(b"".join([seen[w] for w in words]), dtype=np.int32))


def margins(m: Machine, rows: list[np.ndarray]) -> np.ndarray:
    """z of each set of slots."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    z = np.full(len(rows), m.bias)
    if (full := np.flatnonzero(sizes)).size:
        at = np.concatenate([rows[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        v = m.factors[at]
        total = np.add.reduceat(v, starts, axis=0, dtype=np.float64)
        z[full] += np.add.reduceat(m.weights[at], starts, dtype=np.float64) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v.astype(np.float64) ** 2).sum(1), starts))
    return z


def screened(rows: list[np.ndarray], labels: np.ndarray, bits: int, least: int, clear: float, pool: int) -> np.ndarray:
    """Whether a slot is learnt: it is in at least `least` rows, and its shares of both classes differ by `clear` standard
    errors, or those of its pair with another such slot do, by 1.75 times as many. Pairs are looked for among the pool
    slots whose own shares don't differ and that divide the rows most evenly."""
    pos = labels > 0
    n = np.array([len(labels) - pos.sum(), pos.sum()], np.float64)
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, pos, strict=True) if y == c] or [np.empty(0, np.int32)]), minlength=1 << bits) for c in (False, True)]

    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = (a + b) / n.sum()
        return np.abs(b / n[1] - a / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())

    often = counts[0] + counts[1]
    keep = (often >= least) & (gap(*counts) >= clear)
    rest = np.flatnonzero((often >= least) & ~keep)
    rest = np.sort(rest[np.argsort(-(often * (n.sum() - often))[rest], kind="stable")[:pool]])
    place = np.full(1 << bits, -1)
    place[rest] = np.arange(len(rest))
    # Rows in which both slots of a pair are, by class: two tables of pool * pool numbers, and no more at a time than a few of their rows.
    both = [np.zeros(len(rest) ** 2, np.int32) for _ in (0, 1)]
    for r, y in zip(rows, pos, strict=True):
        at = place[r]
        at = at[at >= 0]
        for part in range(0, len(at), 256):
            both[int(y)][(at[part : part + 256, None] * len(rest) + at).ravel()] += 1
    for i in range(len(rest)):
        a, b = (x[i * len(rest) : (i + 1) * len(rest)] for x in both)
        z = np.where(a + b >= least, gap(a, b), 0)
        z[i] = 0
        if (z >= 1.75 * clear).any():
            keep[rest[i]] = True
    return keep


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = 18, k: int = 4, epochs: int = 4, batch: int = 32, rate: float = 0.3, l2: float = 1e-4, least: int = 4, clear: float = 4.0, cost: float = 2.0, pool: int = 2048, start: float = 0.05, seed: int = 7) -> Machine:
    """Learns from sets of slots and labels 0 or 1. Slots that screened() leaves out stay at zero; a missed positive counts
    cost times, as positives are rare and a document that is rejected can be looked at again. The same rows in the same order give the same machine."""
    pos = float(labels.sum())
    m = Machine(bits, float(np.log((pos + 0.5) / (len(labels) - pos + 0.5))), np.zeros(1 << bits, np.float32), np.zeros((1 << bits, k), np.float32))
    if pos == 0 or pos == len(labels):
        return m
    keep = screened(rows, labels, bits, least, clear, pool)
    rows = [r[keep[r]] for r in rows]
    rng = np.random.default_rng(seed)
    m.factors = np.where(keep[:, None], rng.standard_normal((1 << bits, k)) * start, 0).astype(np.float32)
    gw, gv, gb = np.full(1 << bits, 1e-2, np.float32), np.full((1 << bits, k), 1e-2, np.float32), 1e-2
    for _ in range(max(epochs, -(-600 * batch // len(rows)))):  # 600 steps at least
        deal = rng.permutation(len(rows))
        for i in range(0, len(deal), batch):
            pick = deal[i : i + batch]
            own, y = [rows[j] for j in pick], labels[pick]
            error = 1 / (1 + np.exp(-np.clip(margins(m, own), -30, 30))) - y
            error *= np.where(y > 0, cost, 1.0)
            step = float(error.sum())  # rows without kept slots move the bias too
            gb += step**2
            m.bias -= rate * step / gb**0.5
            full = np.array([len(r) > 0 for r in own])
            if not full.any():
                continue
            own, error = [r for r in own if len(r)], error[full]
            sizes = np.array([len(r) for r in own])
            at, of = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            v = m.factors[at]
            total = np.add.reduceat(v, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            order = np.argsort(at, kind="stable")
            at, of = at[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            slots, e = at[first], error[of].astype(np.float32)
            dw = np.add.reduceat(e, first) + l2 * m.weights[slots]
            dv = np.add.reduceat(e[:, None] * (total[of] - v[order]), first, axis=0) + l2 * m.factors[slots]
            dv *= 0.1  # pairs move slower than single terms
            gw[slots] += dw**2
            gv[slots] += dv**2
            m.weights[slots] -= rate * dw / np.sqrt(gw[slots])
            m.factors[slots] -= 0.05 * rate * dv / np.sqrt(gv[slots])
    return m


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, label_col: str = "toxic") -> DataFrame:
    """doc_id, text, label of at most max_rows labelled rows, the first by a hash of doc_id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    picked = known.orderBy(F.xxhash64("_of"), "_of").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_of")).select("doc_id", "text", F.col("_label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, k: int = 4, max_rows: int = 10_000) -> Machine:
    """The driver gathers the slots of the sample, at most max_rows sets of them, and fits the machine. doc_id may have any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([terms(t).tobytes() for t in texts(b.column(1))], pa.binary()), b.column(2)], names=["doc_id", "slots", "label"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = mapped(sample(docs, labels, max_rows), run, f"doc_id {kind}, slots binary, label int")
    # Rows that share a doc_id are all in the sample's join, so the bound is kept on rows too.
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(max_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.slots)))
    machine = fit([np.sort(np.frombuffer(bytes(r.slots), dtype=np.int32)) for r in rows], np.array([float(r.label) for r in rows]), bits, k)
    del rows
    release()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bits, machine.bias, machine.weights, machine.factors))  # fixed by bits and k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*sent.value)
        terms = Terms(m.bits)
        for b in batches:
            z = []
            for i in range(0, b.num_rows, 256):
                z.append(margins(m, [terms(t) for t in texts(b.column(1).slice(i, 256))]))
            z = np.concatenate(z) if z else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def annotate(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Every column of docs and last the score, named out (with underscores behind it where docs has that column)."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bits, machine.bias, machine.weights, machine.factors))
    at, out = docs.columns.index(text_col), fresh(out, docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*sent.value)
        terms = Terms(m.bits)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                z = margins(m, [terms(t) for t in texts(part.column(at))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*part.schema.names, out])

    return mapped(docs, run, docs.select("*").withColumn(out, F.lit(0.0)).schema)
