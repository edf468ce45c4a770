"""The pipeline's stages on the small corpus: what each keeps, changes and adds, held against brute force on its own input."""

import re
import zlib

import numpy as np

import corpus_pipeline
from lamina.llm import quality
from lamina.llm import secrets
from lamina.llm.common import materialize, read_table
from lamina.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf))
        assert docs.columns == columns, name
        seen.append(docs.count())
        if name in ("substring_dedup", "secret_scans"):
            assert seen[-1] == seen[-2]
    assert seen[1] < seen[0] and seen[2] < seen[1]
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert secrets.scan(docs).agg({"n_live": "sum"}).first()[0] == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def rows_of(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    P = __import__("public_tokenizers")
    before = read_table(spark, sf, "documents")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf))
        found[name] = rows_of(before), after
        before = after
    rows, kept = found["quality_rules"]
    model = quality.fit(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    score = lambda t: model[0].probability(quality.features(np.array(quality.text_stats(t or ""))))[0]
    stats = {i: quality.text_stats(r["text"] or "") for i, r in rows.items()}
    good = {i for i, r in rows.items() if stats[i][0] >= 50 and 2 * stats[i][4] <= stats[i][0] and score(r["text"]) >= model[1]}
    assert rows_of(kept) == {i: rows[i] for i in good}

    rows, kept = found["simhash_near_dedup"]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words((r["text"] or "").lower())) else set() for i, r in rows.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert rows_of(kept) == {i: rows[i] for i in rows if root[i] == i}

    rows, cut = found["substring_dedup"]
    first, expected = {}, {}
    for i in sorted(rows):
        w = words(rows[i]["text"])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        expected[i] = [x for j, x in enumerate(w) if j not in gone]
    cut = rows_of(cut)
    assert {i: words(r["text"]) for i, r in cut.items()} == expected
    assert all(r["text"] == rows[i]["text"] for i, r in cut.items() if expected[i] == words(rows[i]["text"]))
    assert all({k: v for k, v in r.items() if k != "text"} == {k: v for k, v in rows[i].items() if k != "text"} for i, r in cut.items())

    rows, masked = found["secret_scans"]
    holders = {}
    spans = {i: [] for i in rows}
    for i, r in rows.items():
        for kind, pattern, group, least in [*secrets.KINDS, *secrets.ADDED]:
            for m in re.finditer(pattern, r["text"] or "", re.A):
                if len(m[group]) >= least:
                    spans[i].append((m.start(), m.end(), m[group]))
                    holders.setdefault(m[group], set()).add((r["source"], r["lang"]))
    live = {v for v, h in holders.items() if len({s for s, _ in h}) < secrets.EXAMPLE_OWNERS and len(h) < secrets.EXAMPLE_REPOSITORIES}
    for i, r in rows_of(masked).items():
        text, at, out = rows[i]["text"] or "", 0, ""
        for s, e in sorted((s, e) for s, e, v in spans[i] if v in live):
            if s >= at:
                out += text[at:s] + secrets.MARK
            at = max(at, e)
        assert (r["text"] or "") == out + text[at:]

    rows, packed = found["best_fit_packing"]
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids: dict[int, list] = {}
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), dtype="<u4").tolist())
    assert ids == {i: [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2] for i, r in rows.items()}


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
