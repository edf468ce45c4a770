"""Spans of words, lattice likelihoods, collocations and filter interactions, held against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_documents import SCHEMA, awkward

from lamina.llm import collocations, interactions, likelihood, spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use themselves, and kinds that can't be hashed.
CLASHES = ["part", "digest", "word", "n", "rank", "a", "l", "failed", "_order", "_step", "_bucket", "_place", "held_out", "n_tokens", "c", "lattice", "own", "phrase"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted(map(repr, [tuple(r) for r in df.select(*cols).collect()]))


@pytest.mark.parametrize("limit", [1 << 21, 64, 7])
def test_spans(limit):
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "ab  cd", "x" * 700 + " y " + "x" * 700, ". a.b ", "é ü", "last "] + ["".join(rng.choice("ab A\t\n.é#") for _ in range(rng.randrange(200))) for _ in range(60)]
    for context in (0, 2):
        got: dict[int, list] = {}
        for w in spans.words(pa.array(texts), spans.byte_kinds(), context=context, limit=limit):
            found, length = w.texts_at(np.arange(len(w.start))), w.end - w.start
            for r, x, fresh in zip(w.row.tolist(), found, w.fresh.tolist(), strict=True):
                if fresh:
                    got.setdefault(r, []).append(x.decode())
            same = lambda a, b, w=w, n=length: (n[a] == n[b]) & spans.same_bytes(w.data, w.start[a], w.data, w.start[b], np.where(n[a] == n[b], n[a], 0))
            for hashes in (w.hashes(), np.zeros(len(w.start), dtype=np.uint64)):  # all collide in the second
                first: dict[bytes, int] = {}
                assert spans.insert(hashes, same).tolist() == [first.setdefault(x, i) for i, x in enumerate(found)]
        assert [got.get(i, []) for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]


def test_measures_in_parts():
    texts = ["Ab ab é #1 Ab " * 40, None, "x $", "Zz " * 500]
    want = [[len(w := WORD.findall(t or "")), len(set(w)), len(re.findall("[A-Z]", t or "")), len(t or ""), len(re.findall("[#$%&*|]", t or ""))] for t in texts]
    for limit in (1 << 21, 100, 13):
        assert interactions.measures(pa.array(texts), limit=limit).tolist() == want


def test_interactions(spark, docs, empty):
    table = [(i, t, s) for i, t, _, s, *_ in awkward()]
    marks = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(2, 1, 1), (4, None, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("y"))
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    count: Counter = Counter()
    for i, t, s in table:
        t = t or ""
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in table)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        count[s or "", frozenset(f for f, x in zip("ABCDE", fails, strict=True) if x), i in good, i in toxic] += 1
    want, shapley = [], Counter()
    for part in {p for p, *_ in count}:
        own = [(f, g, x, n) for (p, f, g, x), n in count.items() if p == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [r for r in own if not r[0] & set(order[:k])]
                gone = [r for r in left if f in r[0]]
                total = lambda rows: sum(r[3] for r in rows)
                shapley[part, f] += total(gone)
                want.append((part, order, k + 1, total(left) - total(gone), total(gone), total(r for r in own if f in r[0]) - total(gone), total(r for r in own if r[0] == {f}), total(r for r in gone if r[1]), total(r for r in gone if r[2])))
    got = interactions.audit(docs, labels)
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows_of(got, *cols) == sorted(repr((*r, shapley[r[0], r[1][r[2] - 1]])) for r in want)
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes[3:]} == {"bigint"}
    assert interactions.audit(empty, labels).count() == 0 and interactions.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def brute_phrases(table, least, inside, top):
    f, n = Counter(), Counter()
    for lang, text in table:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    rows: dict[str, list] = {}
    for (lang, p), a in f.items():
        w = p.split(" ")
        if len(w) < 2 or a < least:
            continue
        cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(x == lang and b >= least and len(q.split(" ")) == 3 and len(w) == 2 and f" {p} " in f" {q} " and 100 * b >= inside * a for (x, q), b in f.items()):
            continue
        rows.setdefault(lang, []).append((-score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])]


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations(spark, docs, empty, shards):
    rng = random.Random(3)
    extra = [(rng.choice(["en", None, "und"]), " ".join(rng.choice(["New", "york", "city", "ice  cream", "a\tb", "the", "of.", "x,"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    table = [(lang, t) for _, t, lang, *_ in awkward()] + extra
    frame = docs.select("text", "lang", "rank", "_bucket").unionByName(spark.createDataFrame(extra, "lang string, text string"), allowMissingColumns=True)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, inside, top in ((10, 50, 2000), (3, 80, 5)):
        got = collocations.collocations(frame, least=least, inside=inside, top=top, shards=shards)
        assert rows_of(got, *cols) == sorted(map(repr, brute_phrases(table, least, inside, top)))
    assert collocations.collocations(empty).count() == 0


def test_collocation_scores_are_exact(spark):
    n = [(("en", "a b"), 900_000_000_003), (("en", "a"), 900_000_000_007), (("en", "b"), 900_000_000_011), (("en", None), 5)]
    found = spark.createDataFrame([(*k, v) for k, v in n], "lang string, phrase string, n bigint")
    a, l, r = (v for _, v in n[:3])
    assert collocations.scored(found).collect()[0].score == 10**6 * a * a // (l * r)


def test_phrases_of_long_texts_in_parts():
    text = "one two three four, five six seven " * 30
    seeds = np.zeros(1, dtype=np.uint64)
    count = lambda limit: Counter((k, x) for w in spans.words(pa.array([text]), collocations._KINDS, fold=True, context=2, limit=limit) for k, _, key in collocations.phrases(w, seeds, 3) for x in key.tolist())
    whole = count(1 << 21)
    assert sum(n for (k, _), n in whole.items() if k == 1) == 210 and whole == count(50) == count(9)


def test_lattice():
    pieces = likelihood.Pieces.of({b" a": -1.0, b" ab": -2.0, b"b": -1.5, b"ba": -2.5, b"a": -1.2, b" ": -3.0, b"c": -4.0})
    assert abs(pieces.prior.sum() - 1) < 1e-12 and len(pieces.prior) == 256 + 3 + 1
    logs = np.log(pieces.prior)
    number = {pieces.data[s : s + n].tobytes(): k for k, (s, n) in enumerate(zip(pieces.start, pieces.length, strict=True))}
    words, counts = [b"abab", b"a", b"b", "é".encode(), b"abcabab", b"z" * 9], np.array([3.0, 1, 2, 5, 1, 2])

    def cuts(x):
        if not x:
            yield []
        for n in range(1, 4):
            if len(x) >= n and x[:n] in number:
                yield from ([number[x[:n]], *rest] for rest in cuts(x[n:]))

    expected = np.zeros(len(logs))
    got, uses = likelihood.lattice(pieces, logs, words, counts)
    for word, total, c in zip(words, got, counts, strict=True):
        ways = [(math.exp(sum(logs[k] for k in w)), w) for w in cuts(b" " + word)]
        assert abs(math.log(sum(p for p, _ in ways)) - total) < 1e-9
        for p, w in ways:
            np.add.at(expected, w, c * p / sum(p for p, _ in ways))
    alone = likelihood.lattice(pieces, logs, [b"z" * 900])[0][0]  # far below what a double holds
    assert abs(alone - logs[number[b" "]] - 900 * logs[number[b"z"]]) < 1e-6
    assert np.allclose(uses, expected) and likelihood.lattice(pieces, logs, [])[0].size == 0
    with pytest.raises(ValueError, match="mark"):
        likelihood.Pieces.of({b"a b": 0.0})


def test_likelihood(spark, docs, empty, sf):
    P = pytest.importorskip("public_tokenizers")
    pieces = likelihood.Pieces.load(P.path("piece_bpe_32k.model"))
    table = [(i, WORD.findall((t or "").translate(LOWER))) for i, t, *_ in awkward()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, w in table if not held(i) for x in [*w, None])
    n, v = sum(c.values()), len(c)
    results = [likelihood.score(docs, pieces, rounds=2, hot_words=hot).collect() for hot in (0, 3, 131_072)]
    words = sorted({x for _, w in table for x in w})
    known = np.array([c[x] for x in words], dtype=float)
    prob = pieces.prior
    for _ in range(2):
        uses = likelihood.lattice(pieces, np.log(prob), [x.encode() for x in words], known)[1]
        uses[-1] = c[None]
        prob = (uses + likelihood.PRIOR * pieces.prior) / (uses.sum() + likelihood.PRIOR)
    each = dict(zip(words, likelihood.lattice(pieces, np.log(prob), [x.encode() for x in words])[0] / math.log(10), strict=True))
    whole = lambda i, w: (i, held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
    order = lambda r: (repr(r[0]), r[2], round(r[-1], 3))
    want = sorted(((*whole(i, w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), sum(each[x] for x in w) + math.log10(prob[-1])) for i, w in table), key=order)
    for got in results:
        got = sorted((tuple(r) for r in got), key=order)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert likelihood.score(empty, pieces).count() == 0
    lone = spark.createDataFrame([(3, "a b"), (4, None)], "doc_id bigint, text string").where(likelihood.held_out() | F.lit(True))
    assert {r.n_tokens for r in likelihood.score(lone, pieces).collect()} == {3, 1}
    tables = spark.read.parquet(f"{sf}/documents.parquet")
    rounds = [likelihood.score(tables, pieces, rounds=k).where("held_out").agg(F.sum("score")).first()[0] for k in (0, 2)]
    assert rounds[0] < rounds[1] < 0  # what was learned makes unseen texts likelier
