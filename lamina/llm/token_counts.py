"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies.

A pre-token is a newline, or a run of spaces with the word after it. No piece of the models accepted here crosses such
an edge (this is checked on loading), so the counts of a text's pre-tokens add up to the library's count of the text.
Null texts count as empty (0 tokens). Every input row gives one row, repeated ids and rows included; an empty table
gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, read_table, texts_of

#: Pre-tokens whose counts every task holds: at most so many. One of more than so many characters is held by its MD5, so their bytes are bounded too.
HOT_TOKENS, HOT_CHARS = 131_072, 32
OVER_LIMIT = 4096
#: Distinct pre-tokens a task gathers before it passes them on.
HELD = 200_000

_UNIT = re.compile(r"\n| *[^ \n]+| +")
_models: dict = {}


def load_model(path: str):
    """The sentencepiece model at ``path``; raises ValueError if its pieces cross pre-token edges."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if "\n" in p or "▁" in p.lstrip("▁"):
                raise ValueError(f"piece {p!r} crosses the edges of pre-tokens")
        _models[path] = sp
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text as the encoder sees it, that is with a space put before it; none for the empty text."""
    if not text:
        return []
    text = " " + text.replace("▁", " ")
    if "  " in text or "\0" in text:
        return _UNIT.findall(text)
    return [t for t in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if t]


def count_pieces(sp, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. A newline before it stands for what precedes it; that and the encoder's own space make two pieces."""
    return [len(x) - 2 for x in sp.encode(["\n" + t for t in tokens], num_threads=1)]


def vocabulary(docs: DataFrame, model_path: str) -> DataFrame:
    """(token, n_docs, n_pieces) of each distinct pre-token of all documents."""
    schema = pa.schema([("token", pa.string()), ("n_docs", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in texts_of(b.column(0)):
                seen.update(set(pre_tokens(t)))
                if len(seen) > HELD:
                    yield batch_of(schema, token=list(seen), n_docs=list(seen.values()))
                    seen.clear()
        yield batch_of(schema, token=list(seen), n_docs=list(seen.values()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load_model(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count_pieces(sp, b.column(0).to_pylist()), pa.int64())], names=["token", "n_docs", "n_pieces"])

    found = docs.select("text").mapInArrow(gather, "token string, n_docs bigint")
    return found.groupBy("token").agg(F.sum("n_docs").alias("n_docs")).mapInArrow(measure, "token string, n_docs bigint, n_pieces bigint")


def hot_counts(vocab: DataFrame, limit: int = HOT_TOKENS, chars: int = HOT_CHARS) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, by :func:`held_key`: those of the highest frequency classes that hold ``limit`` at most in all."""
    key = F.when(F.length("token") <= chars, F.col("token")).otherwise(F.concat(F.lit("\0"), F.md5("token")))
    classes = vocab.select(key.alias("key"), "n_pieces", F.floor(8 * F.log2("n_docs")).alias("_class"))
    room, least = limit, None
    for r in sorted(classes.groupBy("_class").count().collect(), key=lambda r: -r._class):  # a few hundred classes
        if (room := room - r["count"]) < 0:
            break
        least = r._class
    if least is None:
        return {}
    return {r.key: r.n_pieces for r in classes.where(F.col("_class") >= least).select("key", "n_pieces").toLocalIterator()}


def held_key(token: str, chars: int = HOT_CHARS) -> str:
    """A pre-token of at most ``chars`` characters itself, a longer one's MD5 after a null, which is one character longer than that."""
    return token if len(token) <= chars else "\0" + md5(token.encode()).hexdigest()


def count_tokens(docs: DataFrame, model_path: str, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens.

    Documents send on only their rarer pre-tokens with frequencies; the frequent ones, a table of bounded size, are
    summed where the text is read. Rows sent on meet the vocabulary's counts in a join on the pre-token.
    """
    docs = docs.select("doc_id", "text")
    vocab = materialize(vocabulary(docs, model_path))
    hot = docs.sparkSession.sparkContext.broadcast(hot_counts(vocab, hot_tokens))
    fields = [("uid", pa.int64()), ("n_bytes", pa.int64()), ("token", pa.string()), ("own", pa.bool_()), ("n", pa.int64())]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field("doc_id").type), *fields])
            ids = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts_of(b.column("text")), strict=True):
                uid += 1
                own, rest = 0, []
                for t, k in Counter(pre_tokens(text)).items():
                    if (n := known.get(held_key(t))) is None:
                        rest.append((None, uid, None, t, False, k))
                    else:
                        own += n * k
                rows.append((doc_id, uid, len(text.encode()), f"{uid % 4099}", True, own))
                rows += rest
                if len(rows) > 50_000:
                    yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                    rows = []
            if rows:
                yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    # Rows with ``own`` are one for each document and carry what was summed at once; their token only spreads them.
    rows = docs.mapInArrow(spread, f"doc_id {id_type}, uid bigint, n_bytes bigint, token string, own boolean, n bigint")
    counted = rows.join(vocab.select("token", "n_pieces").hint("merge"), "token", "left")
    n = F.col("n") * F.when(F.col("own"), F.lit(1)).otherwise(F.col("n_pieces"))
    return (
        counted.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(n).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens")
    )


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE_SQL: dict[str, str] = {}
