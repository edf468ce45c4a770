"""Language ID: averaged embeddings of hashed subwords, a linear softmax over them, and calibrated rejection.

Subwords are the runs of three bytes of a text whose ASCII letters are lower-cased and whose other ASCII is blank.
Texts that are null or have no letter are ``und`` with score 0, as is every text where nothing was learned (no labelled
row). Only a text decides its prediction. Every input row gives one row, repeated ones included; other columns are
ignored; an empty table gives none. Of equal scores the language that sorts first is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, read_table

BUCKETS, WIDTH = 8192, 16
#: Documents fitted on at most for each language and in all (those of the smallest id hashes); languages known at most.
PER_LANGUAGE, MAX_DOCS, MAX_LANGUAGES = 500, 2000, 200
#: Accepted predictions must have been right this often among the documents kept for calibration.
PRECISION = 0.99
SLICE = 1 << 21

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint32)


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of a text, slice by slice; blank ones are left out."""
    for at in range(0, max(len(text) - 2, 0), SLICE):
        b = _FOLD[np.frombuffer(text, dtype=np.uint8, count=min(SLICE + 2, len(text) - at), offset=at)]
        h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        h = h[h != 0x202020] * np.uint32(2654435761)
        yield (h >> np.uint32(19)).astype(np.int32)


def subword_counts(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for h in subwords(f" {text} ".encode()):
        out += np.bincount(h, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket: its embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    accept: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in subwords(f" {text} ".encode()):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_counts(counts: np.ndarray, languages: list[str], epochs: int = 30, rate: float = 4.0, batch: int = 64, seed: int = 0) -> Model:
    """Embeddings and softmax by stochastic gradient descent on four fifths of the rows; temperature and threshold on the rest."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    x = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    train = np.flatnonzero(~held)
    for epoch in range(epochs):
        rng.shuffle(train)
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            h = x[rows] @ emb
            g = softmax(h @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = x[rows].T @ (g @ w.T)
            w -= step * (h.T @ g)
            bias -= 0.1 * step * g.sum(axis=0)
            emb -= 20 * step * back  # a document's mean touches each embedding by a small share only
    table = (emb @ w).astype(np.float32)
    model = Model(names, table, bias.astype(np.float64), 1.0, 0.0)
    if held.any():
        z = x[held] @ table + bias
        loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(held.sum()), y[held]], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        order = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
        model.accept = float(score[order[good[-1]]]) if len(good) else 1.0
    return model


def held_out():
    """True for documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_docs: int = MAX_DOCS) -> Model | None:
    """A model of the labelled documents that are not held out. The sample is bounded, and its subword counts, not its texts, come to the driver."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", F.xxhash64("doc_id").alias("_order"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    place = F.pmod("_order", F.lit(1 << 30)) / float(1 << 30)
    ids = known.where(place < share).groupBy("doc_id").agg(F.min("lang").alias("_lang"), F.min("_order").alias("_order")).orderBy("_order", "doc_id").limit(max_docs)
    schema = pa.schema([("o", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for o, lang, text in zip(*(b.column(c).to_pylist() for c in ("_order", "_lang", "text")), strict=True):
                c = subword_counts(text or "")
                at = np.flatnonzero(c)
                rows.append((o, lang, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            if rows:
                yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("_order", "_lang", "text").mapInArrow(measure, "o bigint, lang string, at binary, n binary").limit(2 * max_docs).collect()
    rows.sort(key=lambda r: (r.o, r.lang, bytes(r.at), bytes(r.n)))
    counts = np.zeros((len(rows), BUCKETS), dtype=np.uint32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], dtype="<u2")] = np.frombuffer(r["n"], dtype="<u4")
    return fit_counts(counts, [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row; ``accepted`` is false where the calibrated score is under the threshold."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) if model else ("und", 0.0) for t in b.column("text").to_pylist()]
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
            yield batch_of(
                schema, doc_id=b.column("doc_id"), held_out=b.column("held_out"), lang_pred=[x for x, _ in found], score=[s for _, s in found],
                accepted=[bool(model) and x != "und" and s >= model.accept for x, s in found],
            )

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, accepted boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
