"""URL filters: a sorted array of 64-bit digests, memory-mapped, probed by binary search and confirmed by the full string.

A list holds strings host + path prefix (``example.org/es/``) with a verdict; an entry without a ``/`` is a host and fits
any path. An entry fits its host and all subdomains where the url's path starts with its path; the longest fitting entry
wins, of equally long ones that of the longer host. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. Null urls and those without ``://`` have both empty and fit
nothing. Urls that fit nothing get the default verdict. Every input row gives one row, repeated ones included; an empty
table gives none, an empty list fits nothing; a list entry given twice keeps its smallest verdict; other columns are ignored.

The digests of a url's candidates (each parent domain with each path prefix of a length that the list has) are taken by
feeding one running hash, so a long path costs its length for each label of the host and no strings are built but for
digests that were found. A list too large to send is first brought down to the entries whose digest some url has.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, materialize, read_table, unused

#: A list of at most so many entries and bytes is sent to every executor.
MAX_ENTRIES, MAX_BYTES = 4_000_000, 256 << 20
#: Digests looked up together in a task.
PROBED = 1 << 20
DEFAULT = "allow"
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

_TAIL = re.compile(r"([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_open: dict[str, DigestIndex] = {}


def host_and_path(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host, path = _TAIL.match(rest).groups()
    return host.translate(_LOWER), path


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode())


def parents(host: str) -> list[str]:
    """The host and its parent domains, the longest first; none for the empty host."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def candidate_digests(host: str, path: str, lengths: list[int]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(domain, number of digests, digests): each parent domain of ``host`` with the prefixes of ``path`` that are ``lengths`` bytes long (rising)."""
    raw = path.encode()
    usable = lengths[: bisect_right(lengths, len(raw))]
    for domain in parents(host):
        running, at, out = xxhash.xxh64(domain.encode()), 0, []
        for n in usable:
            running.update(raw[at:n])
            at = n
            out.append(running.intdigest())
        yield domain, len(out), np.array(out, dtype=np.uint64)


class DigestIndex:
    """Digests in order, where each entry's string and verdict stand, and the strings themselves, all memory-mapped."""

    PARTS = ("digests", "offsets", "strings", "verdicts")

    @staticmethod
    def write(entries: list[tuple[str, str]], folder: str, names: dict[str, str]) -> None:
        keys = [k.encode() for k, _ in entries]
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        order = np.argsort(digests, kind="stable")
        keys = [keys[i] for i in order]
        arrays = {
            "digests": digests[order],
            "offsets": np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64),
            "strings": np.frombuffer(b"".join(keys) or b"\0", dtype=np.uint8),
            "verdicts": np.array([entries[i][1] == "block" for i in order], dtype=bool),
        }
        for part, a in arrays.items():
            np.save(os.path.join(folder, names[part]), a)

    def __init__(self, folder: str, names: dict[str, str]):
        self.digests, self.offsets, self.strings, self.verdicts = (np.load(os.path.join(folder, names[p]), mmap_mode="r") for p in self.PARTS)

    def search(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``digests`` the index has, and where its entries of that digest begin."""
        if not len(self.digests):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.digests, digests)
        found = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests)
        return found, at[found]

    def confirm(self, at: int, key: str) -> int:
        """Place of the entry that is ``key`` itself among those of one digest from ``at`` on, or -1."""
        raw, own = key.encode(), self.digests[at]
        while at < len(self.digests) and self.digests[at] == own:
            if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == raw:
                return int(at)
            at += 1
        return -1

    def rules(self, urls: list[tuple[str, str]], lengths: list[int]) -> list[tuple[str, bool] | None]:
        """The winning (entry, blocked) of each (host, path)."""
        out: list[tuple[str, bool] | None] = [None] * len(urls)
        held: list[tuple[int, str, np.ndarray]] = []
        size = 0

        def look() -> None:
            nonlocal held, size
            if not held:
                return
            ends = np.cumsum([len(d) for _, _, d in held])
            found, places = self.search(np.concatenate([d for _, _, d in held]))
            for i, at in zip(found.tolist(), places.tolist(), strict=True):
                k = int(np.searchsorted(ends, i, side="right"))
                row, domain, d = held[k]
                key = domain + urls[row][1].encode()[: lengths[i - (int(ends[k]) - len(d))]].decode(errors="ignore")
                if (out[row] is None or _rank(key) > _rank(out[row][0])) and (j := self.confirm(at, key)) >= 0:
                    out[row] = key, bool(self.verdicts[j])
            held, size = [], 0

        for row, (host, path) in enumerate(urls):
            for domain, n, d in candidate_digests(host, path, lengths):
                held.append((row, domain, d))
                size += n
                if size >= PROBED:
                    look()
        look()
        return out


def _rank(key: str) -> tuple[int, int]:
    """Entries are ranked by their length, then by that of their host."""
    return len(key), len(key.partition("/")[0])


def _ship(spark: SparkSession, entries: list[tuple[str, str]]) -> dict[str, str]:
    """Write the index among the files that Spark looks after and have it copied to each executor; returns the files' names. A list is sent once, however often it is used."""
    tag = xxhash.xxh3_128_hexdigest("\n".join(f"{k} {v}" for k, v in sorted(entries)).encode())
    names = {p: f"lamina-{tag}-{p}.npy" for p in DigestIndex.PARTS}
    folder = os.path.join(SparkFiles.getRootDirectory(), f"lamina-{tag}")
    if not os.path.exists(folder):
        os.makedirs(folder)
        DigestIndex.write(entries, folder, names)
        for n in names.values():
            spark.sparkContext.addFile(os.path.join(folder, n))
    return names


def _met(pages: DataFrame, listed: DataFrame, lengths: list[int]) -> DataFrame:
    """The entries of ``listed`` whose digest is one of some url's candidates. Digests are made distinct in each task and again before they are joined."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for url in b.column(0).to_pylist():
                for _, n, d in candidate_digests(*host_and_path(url), lengths):
                    parts.append(d)
                    size += n
                if size >= PROBED:
                    yield batch_of(pa.schema([("digest", pa.int64())]), digest=np.unique(np.concatenate(parts)).view(np.int64))
                    parts, size = [], 0
            if parts:
                yield batch_of(pa.schema([("digest", pa.int64())]), digest=np.unique(np.concatenate(parts)).view(np.int64))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([digest(k) for k in b.column("key").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.view(np.int64))], names=["key", "verdict", "digest"])

    known = listed.mapInArrow(digests, "key string, verdict string, digest bigint")
    return known.join(pages.select("url").mapInArrow(seen, "digest bigint").distinct(), "digest", "left_semi").select("key", "verdict")


def judge(pages: DataFrame, listed: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``listed`` has ``key`` (host and path) and ``verdict`` (allow or block)."""
    spark = pages.sparkSession
    listed = listed.where("key is not null and verdict in ('allow', 'block')").groupBy("key").agg(F.min("verdict").alias("verdict"))
    path_length = F.octet_length("key") - F.octet_length(F.substring_index("key", "/", 1))
    # As many different lengths as the longest entry has bytes, at most.
    lengths = sorted(r.n for r in listed.select(path_length.alias("n")).distinct().collect())
    count = lambda: listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    fits = lambda s: s.n <= MAX_ENTRIES and (s.bytes or 0) <= MAX_BYTES
    size = count()
    if not fits(size):
        listed = materialize(_met(pages, listed, lengths))
        size = count()
    rows = pages.select("page_id", "url")
    if fits(size):
        return _indexed(rows, _ship(spark, [(r.key, r.verdict) for r in listed.collect()]), lengths, default)
    # Still too large: the entries go in shares of their hash, each an index of its own; the best of all shares counts.
    shares = int(max(size.n / MAX_ENTRIES, (size.bytes or 0) / MAX_BYTES) * 1.2) + 1
    uid = unused("uid", rows)
    rows = materialize(rows.withColumn(uid, F.monotonically_increasing_id()))
    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    found = None
    for i in range(shares):
        part = _indexed(rows, _ship(spark, [(r.key, r.verdict) for r in listed.where(share == i).collect()]), lengths, default, uid).where("rule is not null").select(uid, "rule", "verdict")
        found = part if found is None else found.unionByName(part)
    order = F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)))
    best = found.groupBy(uid).agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    split = _indexed(rows, _ship(spark, []), lengths, default, uid).select(uid, "page_id", "host", "path")
    return split.join(best, uid, "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _indexed(pages: DataFrame, names: dict[str, str], lengths: list[int], default: str, *carried: str) -> DataFrame:
    """Pages judged by the index sent under ``names``."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = names["digests"]
        if tag not in _open:
            _open[tag] = DigestIndex(SparkFiles.getRootDirectory(), names)
        index = _open[tag]
        for b in batches:
            split = [host_and_path(u) for u in b.column("url").to_pylist()]
            rules = index.rules(split, lengths)
            schema = pa.schema([("page_id", b.schema.field("page_id").type), *((c, pa.string()) for c in ("host", "path", "rule", "verdict")), *((c, pa.int64()) for c in carried)])
            yield batch_of(
                schema, page_id=b.column("page_id"), host=[h for h, _ in split], path=[p for _, p in split], rule=[r and r[0] for r in rules],
                verdict=[default if r is None else "block" if r[1] else "allow" for r in rules], **{c: b.column(c) for c in carried},
            )

    return pages.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string" + "".join(f", {c} bigint" for c in carried))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "key string, verdict string"))


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {
    "op1_url_filter": """
WITH tail AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM tail
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
)
SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path, max_by(r.rule, length(r.rule)) AS rule,
       coalesce(max_by(r.verdict, length(r.rule)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
GROUP BY p.page_id
"""
}
