"""Filter interaction audit: what each order of a set of filters removes, and what each filter would have caught besides.

One pass of a byte transducer (``spans``) over each text counts words, capitals, code points and symbols, and puts the
words into a hash table that confirms equal bytes, so distinct words are exact. Texts travel no further than that pass,
only their SHA-256 does. Documents are then counted by part, failed filters and labels, and the orders are applied to
those counts, so the work after the first aggregate depends on the number of parts alone.

Null texts are empty ones, with no words; a null part is the empty string. Every row is a document, repeated ones too. A
text is a copy if a row of a smaller id has it; a null id is neither smaller nor larger than any. A document has a
label if any of its label rows says so. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import batch_of, materialize, read_table

SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
#: Least words; least distinct words and most capitals, in hundredths of words and of code points.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5

_MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measures(column: pa.Array, symbols: bytes = SYMBOLS, limit: int = spans.LIMIT) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text of a column, a row each."""
    kinds = spans.byte_kinds(symbols=symbols)
    out = np.zeros((len(column), len(_MEASURES)), dtype=np.int64)
    seen, seen_row = set(), -1
    for w in spans.words(column, kinds, limit=limit):
        np.add.at(out[:, 0], w.texts, np.diff(np.searchsorted(w.start, w.bounds)))
        for k, hit in ((2, w.kinds == spans.CAPITAL), (3, w.kinds != spans.CONTINUATION), (4, w.kinds == spans.SYMBOL)):
            total = np.concatenate([[0], np.cumsum(hit)])
            out[w.texts, k] += total[w.bounds[1:]] - total[w.bounds[:-1]]
        length = w.end - w.start

        def equal(a, b, w=w, length=length):
            same = (w.row[a] == w.row[b]) & (length[a] == length[b])
            return same & spans.same_bytes(w.data, w.start[a], w.data, w.start[b], np.where(same, length[a], 0))

        if not len(w.start):
            continue
        first = np.unique(spans.insert(w.hashes() ^ (w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), equal))
        if w.new == 0 and w.bounds[-1] <= limit and len(w.texts) > 1:
            out[:, 1] += np.bincount(w.row[first], minlength=len(out))
        else:  # a text that may have come in parts
            row = int(w.texts[0])
            seen, seen_row = (seen, row) if row == seen_row else (set(), row)
            seen.update(w.texts_at(first))
            out[row, 1] = len(seen)
    return out


def measured(docs: DataFrame, part: str = "source", symbols: bytes = SYMBOLS) -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols) of every row; ``digest`` is the SHA-256 of the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            data, at = spans.bytes_of(column)
            digests = [hashlib.sha256(data[s:e]).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            counts = measures(column, symbols)
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("part", pa.string()), ("digest", pa.binary()), *((m, pa.int64()) for m in _MEASURES)])
            yield batch_of(schema, doc_id=b.column("doc_id"), part=b.column("part"), digest=digests, **{m: counts[:, k] for k, m in enumerate(_MEASURES)})

    rows = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(run, f"doc_id {id_type}, part string, digest binary, " + ", ".join(f"{m} bigint" for m in _MEASURES))


def text_failures() -> list[Column]:
    """Conditions of the filters that a text's own counts decide, in the order of ``FILTERS``."""
    return [
        F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_points"), F.col("n_symbols") > 0,
    ]


def failed_counts(texts: DataFrame, labels: DataFrame, failures: list[Column]) -> DataFrame:
    """(part, failed, good, toxic, n): documents by part, failed filters (bits, that of copies last) and labels.

    Rows are counted by (id, text) first, so a crowd of copies is as many small rows as it has ids; labels meet them by
    id; then a crowd is one row for each part and label, with its smallest id, and only those are compared by text.
    """
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures)), F.lit(0))
    rows = texts.groupBy("doc_id", "part", "digest", bits.alias("failed")).agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    crowds = materialize(
        rows.groupBy("digest", "part", "failed", "good", "toxic")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    )
    firsts = crowds.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("crowds"))
    copies = 1 << len(failures)
    alone = F.col("n_null") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = crowds.join(firsts, "digest").select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed"), alone.alias("n")), F.struct((F.col("failed") + copies).alias("failed"), (F.col("n") - alone).alias("n")))).alias("x")
    )
    return split.groupBy("part", F.col("x.failed").alias("failed"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def order_effects(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of :func:`failed_counts`.

    The orders are a table made of the filters' names; what a set of failed filters does in an order is arithmetic on its bits.
    """
    orders = F.lit(",".join(map("".join, permutations(filters))))
    steps = counts.withColumn("_order", F.explode(F.split(orders, ","))).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bit = lambda letters: sum((F.when(F.instr(letters, f) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters)), F.lit(0))
    failed, step = F.col("failed"), F.col("_step")
    own, before = bit(F.substring("_order", step, F.lit(1))), bit(F.substring("_order", F.lit(1), step - 1))
    gone, fails = failed.bitwiseAND(before) != 0, failed.bitwiseAND(own) != 0
    removed = ~gone & fails
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).alias(name)
    done = steps.groupBy("part", F.col("_order").alias("filter_order"), step.alias("step"), own.alias("own")).agg(
        total(~gone & ~fails, "kept"), total(removed, "removed"), total(gone & fails, "redundant"), total(failed == own, "unique_fails"), total(removed & F.col("good"), "good_lost"), total(removed & F.col("toxic"), "toxic_lost")
    )
    shares = done.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return done.join(shares, ["part", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What filters A (few words), B (few distinct words), C (many capitals), D (symbols) and E (copies) do in every order, by part."""
    texts = measured(docs, part)
    return order_effects(materialize(failed_counts(texts, labels.select("doc_id", "quality", "toxic"), text_failures())))


def op13_filter_interactions(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_interactions": op13_filter_interactions}

ORACLE_SQL = {
    "op13_filter_interactions": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text
), g AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    MAP {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails
  FROM d JOIN firsts USING (text) LEFT JOIN g USING (doc_id)
), s AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), t AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o
), r AS (
  SELECT part, good, toxic, n, filter_order, step, filter_order[step] AS own, fails[filter_order[step]] AS fail,
    len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone, len(list_filter(map_values(fails), lambda v: v)) = 1 AS single FROM s, t
), q AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fail), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fail AND single), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fail AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND fail AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM q
"""
}
