"""The pipeline's stages on small tables."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.edge import SCHEMA, edge_docs, edge_rows, empty_docs

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows.append(docs.count())
    start, good, single, clean, mixed, sharded = rows
    assert start > good > single >= clean <= mixed == sharded
    assert docs.select("doc_id").distinct().count() == clean


def test_stages_live_with_odd_rows(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0, name
            assert {c.split()[0] for c in SCHEMA.split(", ")} <= set(out.columns), name
    assert len(edge_rows()) == 12


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def brute_first_ids(docs):
    """The smallest id of each component of texts whose sets of five-word shingles are 0.8 alike."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and root[a] != root[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_near_copies_at_0_8_go_and_others_stay(spark):
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(20)]  # chains of overlaps: 0.90 from one to the next
    for k in range(30):  # near copies with one to five words replaced
        own = [f"x{j}" for j in range(100)]
        for j in range(k % 6):
            own[10 + 15 * j] = f"y{k}"
        docs.append((100 + k, " ".join(own)))
    docs += [(200, "a b c"), (201, "A  b c"), (202, "a b d"), (203, ""), (204, None)]
    docs += [(int(r.doc_id) + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == brute_first_ids(docs)
