"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Null texts count as empty (no spans). Every input row gives one row; rows that repeat an id are told apart by their
text, and rows alike in both are judged alike. A null owner or repository counts as one of its own. An empty table gives
an empty result; other columns are ignored by :func:`scan` and carried by :func:`mask`.

A candidate's value is hashed; how many distinct owners and repositories hold the hash anywhere in the corpus tells a
widely copied example from a credential that belongs to one owner and so may be live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, materialize, read_table, unused

#: (kind, pattern, group that is measured and hashed, characters that group must have). Order settles ties of start.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The method's own kinds: credentials that show their issuer, and signed web tokens.
ADDED = (
    ("issued", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_)[A-Za-z0-9_-]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
#: A value held by so many distinct owners, or repositories, or more is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
MARK = "[SECRET]"


def _parts(text: Column, found: Column, pattern: str, group: int, least: int) -> Column:
    """For each match of a pattern: code points before it (since the last one) and in it, and the hash of its value where that is long enough."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))
    parts = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"), F.when(F.length(x["v"]) >= least, F.sha2(x["v"], 256)).alias("hash")))
    kind = "array<struct<gap:int,n:int,hash:string>>"
    return F.when(F.size(found) > 0, parts.cast(kind)).otherwise(F.array().cast(kind))


def _blocks(a: Column) -> Column:
    """An array cut into blocks of about the square root of its length, so that what grows within a block, or by a block, stays short."""
    size = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / size).cast("int")), lambda i: F.slice(a, i * size + 1, size))


def _before(blocks: Column, worth) -> Column:
    """The sum of ``worth`` of all blocks before each one."""
    sums = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + worth(b)))
    return F.slice(sums, 1, F.size(blocks))


def _spans(blocks: Column, starts: Column, order: int, kind: str) -> Column:
    """Spans of one kind, in code points, from its blocks of parts and the place each block starts at."""
    span = "struct<start:int,ord:int,kind:string,end:int,hash:string>"

    def step(acc, x):
        at = acc["at"] + x["gap"]
        found = F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (at + x["n"]).alias("end"), x["hash"].alias("hash")).cast(span)
        return F.struct((at + x["n"]).alias("at"), F.when(x["hash"].isNotNull(), F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def walk(z):
        return F.aggregate(z["b"], F.struct(z["s"].alias("at"), F.expr(f"cast(array() as array<{span}>)").alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), walk))


def find(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """(doc_id, text_hash, owner, repository, spans) of every row; spans ordered by start, then kind. Values leave as hashes only.

    A repository is an owner's documents of one ``repository`` value.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"))
    kinds = [*KINDS, *ADDED]
    # Runs too short to count are not worth placing: the quick pattern asks for one that is long enough, its fixed start included.
    for kind, pattern, group, least in kinds:
        quick = pattern[:-1] + "{%d,}" % (least - pattern.index("[")) if kind in ("access", "hex") else pattern
        rows = rows.withColumn(f"_{kind}", F.when(F.col("text").rlike(quick), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    keep = ["doc_id", "text_hash", "owner", "repository"]
    parts = [_parts(F.col("text"), F.col(f"_{kind}"), pattern, group, least).alias(kind) for kind, pattern, group, least in kinds]
    rows = rows.withColumn("text_hash", F.xxhash64("text")).select(*keep, *parts)
    rows = rows.select(*keep, *[_blocks(F.col(k[0])).alias(k[0]) for k in kinds])
    length = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"])
    rows = rows.select(*keep, *[k[0] for k in kinds], *[_before(F.col(k[0]), length).alias(f"{k[0]}_at") for k in kinds])
    spans = [_spans(F.col(k[0]), F.col(f"{k[0]}_at"), i, k[0]) for i, k in enumerate(kinds)]
    return rows.select(*keep, F.array_sort(F.concat(*spans)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_places) of every candidate value; holders are made distinct before they are counted, so a value in a third of all documents costs its holders only."""
    held = found.select(F.explode("spans.hash").alias("hash"), "owner", "repository").groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_places"))


def verdicts(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, judged) of the texts with spans; ``judged`` has start, end and live of each span."""
    each = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.start", "s.ord", "s.end", "s.hash")
    known = hot_lookup(each, materialize(ownership(found)), "hash", "n_places")
    live = (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repositories") < EXAMPLE_REPOSITORIES)
    return known.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", live.alias("live")))).alias("judged"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _of(order: int):
    return lambda s: s["ord"] == order


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """One row per document: counts of the base kinds, all spans, and how many are live-looking or examples."""
    found = materialize(find(docs, owner, repository))
    base = F.filter("f.spans", lambda s: s["ord"] < len(KINDS))
    counts = [F.size(F.filter("f.spans", _of(i))).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(KINDS)]
    judged = verdicts(found)
    f, v = found.alias("f"), judged.alias("v")
    same = F.col("f.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("f.text_hash") == F.col("v.text_hash"))
    live = F.size(F.filter("v.judged", lambda s: s["live"]))
    return f.join(v, same, "left").select(
        "f.doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("f.spans")).alias("spans"),
        F.coalesce(F.when(F.col("v.judged").isNotNull(), live), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.when(F.col("v.judged").isNotNull(), F.size("v.judged") - live), F.lit(0)).cast("long").alias("n_example"),
    )


def mask(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """``docs`` with every live-looking span of ``text`` replaced by a mark; spans that overlap share one. Examples stay, and so do all rows and columns.

    The text is cut once for each block of marks and put together within the block, so the work grows with the text, not with its square.
    """
    judged = verdicts(materialize(find(docs, owner, repository)))  # a filter on spans here would be pushed below and find them twice
    id_, hash_, marks_, ends_ = (unused(n, docs) for n in ("_id", "_hash", "_marks", "_ends"))
    marks = judged.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.filter("judged", lambda s: s["live"]).alias(marks_)).where(F.size(marks_) > 0)
    marks = marks.select(id_, hash_, _blocks(F.col(marks_)).alias(marks_))
    # How far the text is used up before each block and after the last: the furthest end so far.
    furthest = F.aggregate(marks_, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.greatest(F.element_at(acc, -1), F.array_max(F.transform(b, lambda s: s["end"])))))
    marks = marks.select(id_, hash_, marks_, furthest.alias(ends_))
    text = docs["text"]

    def step(acc, s, cut, begin):
        out = F.concat(acc["out"], cut.substr(acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(MARK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

    def block(z):
        with_cut = F.array(F.struct(z["from"].alias("from"), text.substr(z["from"] + 1, z["to"] - z["from"]).alias("cut")))
        one = F.transform(with_cut, lambda c: F.aggregate(z["b"], F.struct(c["from"].alias("at"), F.lit("").alias("out")), lambda acc, s: step(acc, s, c["cut"], c["from"]), lambda acc: acc["out"]))
        return one[0]

    zipped = F.arrays_zip(F.col(marks_).alias("b"), F.slice(ends_, 1, F.size(marks_)).alias("from"), F.slice(ends_, 2, F.size(marks_)).alias("to"))
    masked = F.concat(F.array_join(F.transform(zipped, block), ""), text.substr(F.element_at(ends_, -1) + 1, F.length(text)))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(hash_)), "left")
    return joined.withColumn("text", F.when(F.col(marks_).isNull(), text).otherwise(masked)).select(*docs.columns)


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_secret_scans": op9_secret_scans}
ORACLE_SQL: dict[str, str] = {}
