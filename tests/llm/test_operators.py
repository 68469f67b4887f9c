"""Operators against brute force on small tables."""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.edge import edge_docs, edge_rows, empty_docs
from tests.oracle import oracle_rows, spark_rows
from tidemark.llm import alike, decontaminate, licences, mixture, ppm, quality, queries, reshard, search, simhash, toxicity, urlrules
from tidemark.llm.store import stored
from tidemark.sources.scratch import shared_dir

SF = "/root/testdata/sf0.001"


def table(name):
    con = duckdb.connect()
    return con.execute(f"SELECT * FROM '{SF}/{name}.parquet'").fetchdf()


def space_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


# op1


def brute_fingerprint(t):
    w = space_words(t)
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = collections.defaultdict(list)
    for k in range(len(ids)):
        least[root(k)].append(ids[k])
    return [min((i for i in least[root(k)] if i is not None), default=None) for k in range(len(ids))]


def test_simhash_matches_brute_force(spark):
    docs = table("documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash"](spark, SF).collect()}
    ids, fps = docs.doc_id.tolist(), [brute_fingerprint(t) for t in docs.text]
    want = brute_components(ids, fps)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, want, strict=True)}


def near_fingerprints(rng, n, near):
    """``n`` random fingerprints, some with a neighbour of up to five flipped bits; chains of such."""
    fps = [int(x) for x in rng.integers(0, 1 << 62, size=n, dtype=np.int64)]
    for k in range(0, near, 2):
        x = fps[k]
        for b in rng.choice(64, size=int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        fps[k + 1] = x
    return sorted(set(fps))


def grouped(edges, nodes):
    """The smallest node that each one reaches."""
    parent = {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in nodes}


@pytest.mark.parametrize(("leaf", "limit"), [(simhash.LEAF, simhash.GROUP_ROWS), (8, simhash.GROUP_ROWS), (64, 100)])
def test_links_join_chains_of_near_fingerprints(spark, leaf, limit):
    """In one cell, in trees of depth ten and more, and with cells dealt over several tasks."""
    fps = near_fingerprints(np.random.default_rng(3), 1500, 1000)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, leaf, limit).collect()
    if leaf == 8:
        assert len(simhash.Forest(len(fps), np.array(fps, np.uint64)[:, None], [(0, *b) for b in simhash.BLOCKS], leaf).trees[0][3]) >= 5
    a = np.array(fps, dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)
    want = grouped([(signed[x], signed[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], signed)
    assert grouped([(e.u, e.v) for e in edges], signed) == want


def test_a_large_group_of_near_fingerprints_is_one(spark):
    rng = np.random.default_rng(4)
    flips = np.array([[1 << int(b) for b in rng.choice(62, size=2, replace=False)] for _ in range(25_000)]).sum(axis=1)
    fps = sorted({int(x) ^ 0x0123456789ABCDEF for x in flips})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert len(set(grouped([(e.u, e.v) for e in edges], fps).values())) == 1 and len(edges) < 40 * len(fps)


def test_dealt_tiles_meet_in_pairs():
    rng = np.random.default_rng(2)
    keys, salt, first = rng.integers(0, 5, 400), rng.integers(0, 1 << 60, 400).astype(np.uint64), rng.random(400) < 0.5
    tiles = simhash.Tiles(np.array([3, 1]), np.array([2, 3]), np.array([4, 1]))
    dealt, rows = tiles.deal(keys, salt, first)
    pieces = collections.defaultdict(set)
    for k, r in zip(dealt.tolist(), rows.tolist(), strict=True):
        pieces[k].add(r)
    together = {(a, b) for p in pieces.values() for a in p for b in p}
    assert all((a, b) in together for a in range(400) for b in range(400) if keys[a] == keys[b] and not (first[a] and first[b]))
    assert all(keys[a] == keys[b] for a, b in together)


def test_without_copies_keeps_one_of_each(spark):
    docs = edge_docs(spark)
    left = alike.without_copies(docs)
    assert left.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in left.collect())
    assert set(got.values()) == {1}
    assert (1, "one two three four five six") in got and (None, "one two three four five six") not in got and (4, edge_rows()[3][1]) in got and len(got) == 6
    assert alike.without_copies(empty_docs(spark)).count() == 0


def test_simhash_edges(spark):
    rows = simhash.digest(simhash.near_duplicates(edge_docs(spark))).collect()
    assert len(rows) == len(edge_rows()) and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


# op2


def brute_trie(texts):
    trie = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    for t in texts:
        b = b"\0" * ppm.ORDER + (t or "").encode() + b"\0"
        for p in range(ppm.ORDER, len(b)):
            for k in range(ppm.ORDER + 1):
                trie[k][b[p - k : p]][b[p]] += 1
    return trie


def brute_ppm(trie, t):
    b, total = b"\0" * ppm.ORDER + (t or "").encode() + b"\0", 0.0
    for p in range(ppm.ORDER, len(b)):
        out, done = set(), False
        for k in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in trie[k].get(b[p - k : p], {}).items() if s not in out}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[p] in seen:
                total, done = total + math.log10(seen[b[p]] / whole), True
                break
            total += math.log10(len(seen) / whole)
            out |= set(seen)
        if not done:
            total -= math.log10(max(1, 256 - len(out)))
    return total


def check_ppm(rows, docs):
    apart = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = collections.Counter()
    for i, t in docs:
        if not apart(i):
            counts.update(space_words(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    trie = brute_trie([t for i, t in docs if not apart(i)])
    want = []
    for i, t in docs:
        w = [*space_words(t), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((repr(i), apart(i), len(w), sum(counts[x] > 0 for x in w), n, base, brute_ppm(trie, t)))
    got = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-5)


def test_ppm_matches_brute_force(spark):
    docs = table("documents").head(60)
    own = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    check_ppm(ppm.score(spark.createDataFrame(own, "doc_id long, text string")).collect(), own)


def test_ppm_learns_from_all_grams(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_GRAMS", 500)
    docs = table("documents")
    own = [(int(i), t[:300]) for i, t in zip(docs.doc_id[:40], docs.text[:40], strict=True)]
    check_ppm(ppm.score(spark.createDataFrame(own, "doc_id long, text string")).collect(), own)


def test_ppm_edges(spark):
    rows = [(i, t if t is None or len(t) < 1000 else t[:3000], *more) for i, t, *more in edge_rows()]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    check_ppm(ppm.score(docs).collect(), [(r[0], r[1]) for r in rows])
    assert ppm.score(empty_docs(spark)).count() == 0
    alone = ppm.score(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert alone.score == pytest.approx(-3 * math.log10(256)) and alone.train_tokens == 0


# op3


def test_flow_is_least():
    flow = reshard.min_cost_flow([5, 7, 0], [4, 8], [[1, 3], [2, 1], [0, 0]])
    assert sum(flow.values()) == 12 and sum(x * [[1, 3], [2, 1], [0, 0]][i][j] for (i, j), x in flow.items()) == 4 + 3 + 7
    best = min(a * 1 + (5 - a) * 3 + (4 - a) * 2 + (7 - 4 + a) * 1 for a in range(5))
    assert best == 14


def check_shards(rows, shards):
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r)
    for own in per.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    load = [sum(r.size for r in per[k]) for k in range(shards)]
    return load


def test_sharding_is_near_equal_and_moves_little(spark):
    rows = queries.QUERIES["op3_sharding"](spark, SF).collect()
    docs = table("documents")
    assert sorted(r.doc_id for r in rows) == sorted(docs.doc_id)
    sizes = {int(i): len((t or "").encode()) + 16 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    crcs = {int(i): zlib.crc32((t or "").encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(r["size"] == sizes[r.doc_id] and r.text_crc32 == crcs[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in rows)
    load, mean = check_shards([_Row(r) for r in rows], 40), sum(sizes.values()) / 40
    assert max(load) - mean <= max(sizes.values()) and mean - min(load) <= max(sizes.values())


class _Row:
    def __init__(self, r):
        self.shard, self.slot, self.size = r["shard"], r["slot"], r["size"]


def test_no_move_without_need():
    blocks = [(k % 4, k, 10) for k in range(40)]
    assert reshard.place_blocks(blocks, [100] * 4) == [k % 4 for k in range(40)]
    grown = reshard.place_blocks(blocks, [80] * 5)
    assert sum(g != b[0] for g, b in zip(grown, blocks, strict=True)) == 8 and collections.Counter(grown) == dict.fromkeys(range(5), 8)


def test_no_fewer_bytes_could_move():
    """Blocks of one size over random layouts: what moves is what old shards hold beyond their capacities, and no more."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, olds = int(rng.integers(2, 6)), int(rng.integers(2, 7))
        blocks = [(int(rng.integers(0, olds)), k, 10) for k in range(n * int(rng.integers(2, 12)))]
        capacity = len(blocks) * 10 // n
        held = collections.Counter(b[0] for b in blocks)
        target = reshard.place_blocks(blocks, [capacity] * n)
        assert set(collections.Counter(target).values()) == {capacity // 10}
        assert sum(t != b[0] for t, b in zip(target, blocks, strict=True)) == sum(max(0, h - (capacity // 10 if o < n else 0)) for o, h in held.items())


def test_one_old_shard_with_all_rows_is_dealt_evenly(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(100).alias("size"), F.lit(3).alias("old_shard"))
    load = collections.Counter(r.shard for r in reshard.reshard(rows, 40).collect())
    assert len(load) == 40 and max(load.values()) <= 1.02 * 1000 and min(load.values()) >= 0.97 * 1000


def test_reshard_edges_and_rewritten_files(spark, tmp_path):
    out = reshard.reshard(reshard.by_source(edge_docs(spark)), 3)
    assert out.count() == len(edge_rows())
    check_shards([_Row(r) for r in out.collect()], 3)
    path = str(tmp_path / "shards")
    told = reshard.rewritten(reshard.by_source(edge_docs(spark)), 3, path).collect()
    check_shards([_Row(r) for r in told], 3)
    assert collections.Counter(r.doc_id for r in told) == collections.Counter(r[0] for r in edge_rows())
    files = spark.read.parquet(path)
    hit = {k for r in told if r.shard != r.old_shard for k in (r.shard, r.old_shard)}
    assert {r.shard for r in files.collect()} <= hit and hit
    for k in hit:
        assert files.where(F.col("shard") == k).count() == sum(r.shard == k for r in told)
    assert collections.Counter((r.doc_id, r.text) for r in files.collect()) <= collections.Counter((e[0], e[1]) for e in edge_rows())
    assert reshard.rewritten(reshard.by_source(empty_docs(spark)), 3, str(tmp_path / "none")).count() == 0


# op4


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group(0)
    path = re.match("[^?#]*", rest[len(host) :]).group(0)
    host = re.sub("[A-Z]", lambda m: m.group(0).lower(), host)
    fit = [(len(h + p), h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules_match_brute_force(spark):
    rules = [("com", "/", "block"), ("com", "/a", "allow"), ("com", "/a/b", "block"), ("x.com", "", "allow"), ("x.com", "/a/b/c", "block"), ("y.x.com", "/a", "block"), ("co", "/", "allow"), ("com", "/ab", "allow")]
    hosts = ["com", "x.com", "X.COM", "y.x.com", "z.y.x.com", "xx.com", "co", "a.co", "com.", "x.com:80", ""]
    paths = ["", "/", "/a", "/ab", "/a/b", "/a/b/c?x=/a", "/b#/a", "?q", "/A", "/a\n/b", "/a/é"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "x.com/a", "://", "http://x.com/a"] * 2
    pages = spark.createDataFrame([(k if k % 7 else None, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = urlrules.judge(pages, spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string"))
    want = [(k if k % 7 else None, *brute_verdict(u, rules)) for k, u in enumerate(urls)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.verdict for r in urlrules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "block").collect()} == {"block"}


def test_url_query_matches_its_oracle(spark):
    assert spark_rows(queries.QUERIES["op4_url_rules"](spark, SF)) == oracle_rows(queries.ORACLES["op4_url_rules"], SF)


# op5


def test_network_gradients():
    rng = np.random.default_rng(0)
    words = toxicity._joined([b"you are an idiot and a clown my friend", b"the cat sat on the mat", b"", b"a b c " * 20])
    vocabulary, y, w = toxicity.Vocabulary(words), np.array([1, 0, 0, 1]), np.ones(4)
    at, inside, text = toxicity.windows(words)
    net = toxicity.Network(rng.normal(size=(2, 1 << toxicity.ODDS_BITS)).astype(np.float32))
    tokens = vocabulary.tokens[at]
    best = net.most(net.logits(net.projected(vocabulary), tokens, inside), text)[1]

    def loss():
        z = net.logits(net.projected(vocabulary), tokens[best], inside[best]).astype(float)
        q = 1 / (1 + np.exp(-z))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    for name, g in net.gradients(vocabulary, tokens[best], inside[best], y, w).items():
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][k]
        net.p[name][k] = old + 1e-2
        up = loss()
        net.p[name][k] = old - 1e-2
        down = loss()
        net.p[name][k] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k], rel=2e-2, abs=1e-4)


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_on_held_out_rows(spark):
    source = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op5_toxicity"](spark, source).toPandas()
    labels = duckdb.connect().execute(f"SELECT * FROM '{source}/labels.parquet'").fetchdf().merge(rows, on="doc_id")
    apart = labels[labels.held_out]
    assert all(apart.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0))
    assert auc(apart.toxic.to_numpy(), apart.score.to_numpy()) > 0.9
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge_docs(spark), labels)
    rows = toxicity.score(edge_docs(spark), model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty_docs(spark), toxicity.fit(empty_docs(spark), labels.limit(0))).count() == 0


# op6


def test_mixing_meets_targets(spark):
    rows = queries.QUERIES["op6_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    p = np.array(rows.domains.tolist()) * rows.tokens.to_numpy()[:, None]
    after = (p * rows.rate.to_numpy()[:, None]).sum(axis=0) / rows.tokens.sum()
    want = [queries.WEIGHTS[k] for k in sorted(queries.WEIGHTS)]
    assert after == pytest.approx(want, abs=5e-3) and (rows.rate >= 0).all()
    assert (rows.copies - rows.rate).abs().max() < 1


def test_mixing_edges(spark):
    docs = edge_docs(spark)
    model = mixture.fit_domains(docs.withColumn("domain", F.coalesce("lang", F.lit("other"))))
    out = mixture.mixed(docs, model, {"en": 0.5, "other": 0.5}, whole=True)
    assert out.count() == len(edge_rows()) and out.where("rate < 1").count() == 0
    nothing = mixture.fit_domains(empty_docs(spark).withColumn("domain", F.col("lang")))
    assert mixture.mixed(empty_docs(spark), nothing, {}).count() == 0


# op7


def brute_base(t):
    t = re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(p, label) for phrase, label in licences.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licences_match_brute_force(spark):
    docs = table("documents")
    extra = [(10**6, "MIT License MIT license general Public license"), (10**6 + 1, "Licensed under CC BY-NC 4.0."), (10**6 + 2, "permission is hereby granted, free of charge, to any person getting a copy of this software"), (10**6 + 3, "license " * 5000)]
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)] + extra + [(r[0], r[1]) for r in edge_rows()]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert told == sorted(repr((i, *brute_base(t))) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[10**6 + 1].labels == "cc-by-nc" and by[10**6 + 2].labels == "mit" and by[10**6 + 2].score < 1 and by[10**6 + 3].labels == ""
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)
    assert licences.scan(empty_docs(spark)).count() == 0


def brute_labels(w):
    """Labels and best agreement of all templates and phrases at all places."""
    labels, best = set(), 0.0
    for _, label, body, key_at, key_n, _ in licences.templates():
        for start in range(1 - len(body), len(w)):
            agree = [0 <= start + k < len(w) and w[start + k] == x for k, x in enumerate(body)]
            if all(agree[key_at : key_at + key_n]) and sum(agree) / len(body) >= licences.COVERAGE:
                labels.add(label)
                best = max(best, sum(agree) / len(body))
    return ",".join(sorted(labels)), best


def test_licence_templates_match_brute_force(spark):
    """Templates with up to a fifth of their words replaced, also the rarest, among other words, with equal anchors elsewhere and at the ends of texts."""
    rng, rows = np.random.default_rng(5), []
    bodies = [body for _, _, body, *_ in licences.templates()]
    pool = sorted({w for b in bodies for w in b}) + ["alpha", "beta", "gamma"]
    for i in range(400):
        own = list(bodies[i % len(bodies)])
        for k in rng.choice(len(own), size=int(rng.integers(0, len(own) // 4 + 2)), replace=False):
            own[k] = str(rng.choice(pool))
        before, after = (rng.choice(pool, int(rng.integers(0, 700 if i % 10 == 0 else 12))).tolist() for _ in range(2))
        rows.append((i, " ".join([*before, *own, *after])))
    rows.append((1000, "distribution and use in source and binary forms with or without changes are permitted"))
    rows += [(k, "binary forms " * (k - 1000)) for k in range(1001, 1040)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].labels == "bsd"
    for i, t in rows:
        labels, best = brute_labels(t.split())
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(best)), t


def test_licences_in_a_text_of_a_million_template_words(spark):
    text = "redistribution and use in source and binary forms with or without modification are permitted " * 70_000
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_words == 980_000 and row.labels == "bsd" and row.score == 1 and row.n_base == 0


# op8


def test_leaks_found_and_clean_left_alone(spark):
    docs, items = table("documents"), table("benchmark")
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    grams = {tuple(w[p : p + 8]) for w in map(words, items.text) for p in range(len(w) - 7)}
    want = {int(i) for i, t in zip(docs.doc_id, docs.text, strict=True) if any(tuple(w[p : p + 8]) in grams for w in [words(t)] for p in range(len(w) - 7))}
    got = {r.doc_id for r in queries.QUERIES["op8_spaced_seeds"](spark, SF).where("leaked").collect()}
    assert got == want


def test_replaced_words_are_tolerated(spark):
    rng = np.random.default_rng(5)
    items, rows = table("benchmark"), []
    for k, t in enumerate(items.text.head(20)):
        w = t.split()
        for j in rng.choice(len(w), size=max(1, len(w) // 9), replace=False):
            w[j] = "zzz"
        rows.append((k, "foo bar baz " * 30 + " ".join(w) + " qux quux" * 30))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = decontaminate.overlaps(spark.createDataFrame([*rows, (99, "foo bar " * 200)], "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in out if r.leaked} == set(range(20))
    for r in out:
        if r.leaked:
            assert int(items.item_id[r.doc_id]) in r.item_ids and r.spans[0].begin >= 85


def brute_leaks(doc, items):
    """Item ids, most equal words and spans of all alignments that the rule calls leaks, whatever finds them."""
    ids, most, spans = set(), 0, set()
    for i, item in items:
        need = min(decontaminate.MIN_WORDS, math.ceil(decontaminate.AGREE * len(item)))
        for shift in range(1 - len(item), len(doc)):
            equal = np.array([0 <= shift + k < len(doc) and doc[shift + k] == w for k, w in enumerate(item)])
            if equal.sum() < need:
                continue
            runs = [(int(equal[a:z].sum()), -a, z) for a in range(len(item)) for z in range(a + 1, len(item) + 1) if equal[a] and equal[z - 1] and equal[a:z].sum() >= decontaminate.AGREE * (z - a) - 1e-9]
            n, a, z = max(runs, default=(0, 0, 0))
            if n and n >= need:
                ids.add(i)
                most = max(most, n)
                spans.add((shift - a, shift + z))
    return sorted(ids), most, sorted(spans)


def test_leaks_match_brute_force(spark):
    """Items of 1 to 40 words, copied with some words replaced, at the ends of texts too; ids, most equal words and spans."""
    rng, pool = np.random.default_rng(8), [f"v{k}" for k in range(400)]
    items = [(k, rng.choice(pool, n).tolist()) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 13, 15, 20, 26, 33, 40])]
    items[0] = (0, ["alone"])
    rows = []
    for d in range(72):
        own = list(items[d % len(items)][1])
        for k in rng.choice(len(own), size=int(rng.integers(0, len(own) // 4 + 1)), replace=False):
            own[k] = str(rng.choice(pool))
        rows.append((d, [*rng.choice(pool, int(rng.integers(0, 30))).tolist(), *own, *rng.choice(pool, int(rng.integers(0, 30))).tolist()]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.overlaps(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string"), bench).collect()}
    found = 0
    for d, w in rows:
        ids, most, spans = brute_leaks(w, items)
        r = got[d]
        assert (r.item_ids, r.n_equal, r.leaked) == (ids, most, most > 0) and [(x.begin, x.end) for x in r.spans] == spans
        found += r.leaked
    assert found > 40


def test_no_leak_of_the_rule_is_lost(spark):
    """Items of 5 to 19 words with every choice of up to three words replaced that the rule still calls a leak, and cut off at either end of a document."""
    docs, items = [], []
    for n in range(5, 20):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        need = min(decontaminate.MIN_WORDS, math.ceil(decontaminate.AGREE * n))
        for gone in range(min(3, n - need) + 1):
            for out in itertools.combinations(range(n), gone):
                if n > 16 and not any(sum(k not in out for k in range(a, z)) >= max(need, decontaminate.AGREE * (z - a)) for a in range(n) for z in range(a + 1, n + 1)):
                    continue
                words = ["other" if k in out else w for k, w in enumerate(item)]
                docs.append((n, words if len(docs) % 2 else ["before", *words, "after"]))
        docs += [(n, x) for x in (item[n - need :], item[:need])]
    got = decontaminate.overlaps(spark.createDataFrame([(d, " ".join(w)) for d, (_, w) in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs) > 2500
    assert not [docs[r.doc_id] for r in got if r.item_ids != [docs[r.doc_id][0]]]


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "too short", "x"), (None, edge_rows()[3][1][:300], "x"), (5, edge_rows()[3][1][:300], "x")], "item_id long, text string, row string")
    out = decontaminate.overlaps(edge_docs(spark), bench).collect()
    assert len(out) == len(edge_rows()) and {r.doc_id for r in out if r.leaked} == {4, 5} and all(r.item_ids == [5] for r in out if r.leaked)
    assert decontaminate.overlaps(edge_docs(spark), bench.limit(0)).where("leaked").count() == 0
    assert decontaminate.overlaps(empty_docs(spark), bench).count() == 0


# op9


def test_quality_accuracy_and_kept_columns(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    out = quality.score(docs, quality.fit(docs, half)).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.95
    assert out[out.quality == 1].kept.mean() > 0.97


def test_views_exchange_the_surest_rows_of_the_whole_table(spark):
    """Pseudo-labels of each round against the margins of every unlabelled row, worked out here."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("doc_id % 3 = 0")
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality IN (0, 1)")
    surest = quality._Surest(docs.select("doc_id", "lang", "source", "n_chars", "text"), known.select("doc_id"))
    rows = docs.join(known, "doc_id", "left_anti").orderBy("doc_id").toPandas()
    taken, rounds = [set(), set()], 0

    def checked(model, view, share):
        nonlocal rounds
        got = surest(model, view, share)
        pages = list(quality.views(pa.array(rows.text.tolist())))
        z = np.concatenate([model.margins(b, o, f, rows.lang.tolist(), rows.source.tolist(), rows.n_chars.tolist()) for b, o, f in pages])[:, 1 - view]
        left = sorted((math.floor(max(-32.0, min(32.0, v)) * 64), int(i)) for v, i in zip(z, rows.doc_id, strict=True) if i not in taken[view])
        bad, good = left[math.ceil(0.05 * (1 - share) * len(left)) - 1][0], left[-math.ceil(0.05 * share * len(left))][0]
        want = [{i for s, i in left if s <= bad and s < 0}, {i for s, i in left if s >= good and s >= 0}]
        most = [int(quality.PSEUDO * (1 - share)) + 1, int(quality.PSEUDO * share) + 1]
        for label in (0, 1):
            own = [i for i, q in zip(got["doc_id"], got["quality"], strict=True) if q == label]
            assert set(own) <= want[label] and len(own) == len(set(own)) == min(most[label], len(want[label]))
        assert len(got["trigrams"]) == len(got["layout"]) == len(got["doc_id"])
        taken[view].update(got["doc_id"])
        rounds += 1
        return got

    assert len(rows) < 2000
    quality.CoTrained(quality.sampled(docs.join(known, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "text"), 4000, ("doc_id", "lang", "source", "n_chars", "quality")), checked)
    assert rounds == 2 * quality.ROUNDS and all(taken)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, 1, 0), (8, 0, 0), (8, 1, 0), (9, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(edge_docs(spark), quality.fit(edge_docs(spark), labels)).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out)
    assert quality.score(edge_docs(spark), quality.fit(edge_docs(spark), labels.limit(0))).where("kept").count() == len(edge_rows())
    assert quality.score(empty_docs(spark), quality.fit(empty_docs(spark), labels)).count() == 0


# op10


def brute_search(texts, ids, query, k, terms):
    words = [collections.Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())) for t in texts]
    size = [sum(w.values()) for w in words]
    mean = sum(size) / len(size)
    df = collections.Counter(x for w in words for x in w)
    own = words[query]
    weight = {x: math.log(1 + (len(texts) - df[x] + 0.5) / (df[x] + 0.5)) * 3 * own[x] / (2 + own[x]) for x in own}
    chosen = sorted(own, key=lambda x: (df[x] < 2, -weight[x]))
    cut = chosen[:terms] if terms else chosen
    tie = terms and len(chosen) > terms and (df[chosen[terms - 1]] > 1) == (df[chosen[terms]] > 1) and abs(weight[chosen[terms - 1]] - weight[chosen[terms]]) < 1e-9
    score = [sum(weight[x] * w[x] * 2.2 / (w[x] + 1.2 * (0.25 + 0.75 * n / mean)) for x in cut if x in w) for w, n in zip(words, size, strict=True)]
    best = sorted((-round(s, 9), ids[k], s) for k, s in enumerate(score) if s > 0)[:k]
    return [s for *_, s in best], [i for _, i, _ in best], tie


@pytest.mark.parametrize(("terms", "rounds"), [(16, False), (None, False), (None, True)])
def test_search_is_exact(spark, terms, rounds):
    """Scores, ranks and ids, over several shards, blocks of documents and rounds with a shared floor."""
    docs = table("documents")
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = stored(search.build_index(df.repartition(20 if rounds else 3), 16), "index")
    assert index.count() >= (search.FIRST_SHARDS * search.MORE_SHARDS if rounds else 3)
    got = search.search(index, df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10, terms).toPandas()
    for i in docs.doc_id[docs.doc_id % 20 == 0]:
        want, who, tie = brute_search(list(docs.text), list(docs.doc_id), int(np.flatnonzero(docs.doc_id == i)[0]), 10, terms)
        if not tie:
            own = got[got.query_id == i].sort_values("rank")
            assert own.score.tolist() == pytest.approx(want, rel=1e-9) and own["rank"].tolist() == list(range(1, len(want) + 1)) and own.doc_id.tolist() == who


def test_search_in_blocks_of_queries(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = stored(search.build_index(df.repartition(2), 16), "index")
    asked = search.query_terms(df.withColumnRenamed("doc_id", "query_id"), search.document_frequencies(index), df.count()).withColumn("floor", F.lit(0.0))
    one, many = (search._met(index, stored(search.query_blocks(asked, n), "query_blocks"), 100.0, 3).toPandas() for n in (1, 5))
    key = lambda x: sorted(zip(x.query_id, x.doc_id, x.score.round(9), strict=True))
    assert key(one) == key(many) and len(one)


def test_search_raises_floors(spark):
    """Packed blocks take the floors known, keep the others, and lose nothing else; a search leaves no tables of its own but the index, the blocks and the result."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = stored(search.build_index(df.repartition(20), 16), "index")
    asked = search.query_terms(df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), search.document_frequencies(index), df.count()).withColumn("floor", F.lit(0.5))
    packed = stored(search.query_blocks(asked, 3), "query_blocks")
    least = asked.where("query_id % 40 = 0").select("query_id", (F.col("query_id") + 1.0).alias("floor")).distinct()
    before, after = (x.toPandas().set_index("block").sort_index() for x in (packed, search.raised_floors(packed, least, 3)))
    assert len(before) == 3 and before.drop(columns="q_floor").map(bytes).equals(after.drop(columns="q_floor").map(bytes))
    floors = {i: f for ids, b in zip(after.q_ids, after.q_floor, strict=True) for i, f in zip(ids, np.frombuffer(b), strict=True)}
    assert len(floors) == asked.select("query_id").distinct().count() and all(f == (0.5 if i % 40 else i + 1.0) for i, f in floors.items())
    kept = Path(shared_dir(spark).removeprefix("file:"))
    there = set(kept.iterdir())
    found = search.search(index, df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))
    assert sorted(p.name.split("-")[0] for p in set(kept.iterdir()) - there) == ["found", "query_blocks"] and found.count()


@pytest.mark.parametrize("rows", [4096, 64])
def test_search_leaves_out_blocks_of_other_kinds(monkeypatch, rows):
    """A block has rows of one language, and once floors are known a query is scored against its own language alone."""
    rng, k, n = np.random.default_rng(3), 5, 400
    words = 2000  # two languages of 1,000 words each, and some words that both use
    chance = 1 / np.arange(2, 1002)
    own = rng.integers(0, 2, n)
    monkeypatch.setattr(search, "KIND_ROWS", rows)
    tf = np.stack([np.bincount(1000 * side + rng.choice(1000, 120, p=chance / chance.sum()), minlength=words) for side in own])
    tf[:, 900:910] += rng.integers(0, 2, (n, 10))
    doc, term = np.nonzero(tf)
    keys, lengths = np.arange(words) * 7 - 300, tf.sum(axis=1)
    packed = search.packed_shard(pa.array(np.arange(n)), lengths, doc, keys[term].view(np.uint64), tf[doc, term], 64)
    shard = search.Shard(packed)
    ids = np.array(packed["ids"].to_pylist())
    kind = own[ids]
    assert shard.groups[-1] == n and len(shard.begin) > 4 and all(len(set(kind[a:z])) == 1 for a, z in itertools.pairwise(shard.begin))
    idf = np.log(1 + (n - (tf > 0).sum(axis=0) + 0.5) / ((tf > 0).sum(axis=0) + 0.5))
    asked = np.arange(60)
    weights = idf * 3 * tf[asked] / (2 + tf[asked])
    scores = (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths / lengths.mean())[:, None])) @ weights.T
    query, at = np.nonzero(weights)
    parts = {"q_vocabulary": keys, "q_at": np.searchsorted(query, np.arange(len(asked) + 1)), "q_term": at.astype(np.int32), "q_weight": weights[query, at], "q_floor": np.sort(scores, axis=0)[-k]}
    seen, real = [], search.Search._matrix
    monkeypatch.setattr(search.Search, "_matrix", lambda self, b, live: seen.extend((own[asked[self.names[q]]], kind[self.shard.begin[b]]) for q in live) or real(self, b, live))
    q, place, score = search.Search(shard, {c: x.tobytes() for c, x in parts.items()}, lengths.mean(), k).top()
    assert seen and all(a == b for a, b in seen)
    for i in range(len(asked)):
        want = sorted((-round(x, 9), d) for d, x in enumerate(scores[:, i]) if x > 0)[:k]
        assert sorted(zip(-np.round(score[q == i], 9), ids[place[q == i]], strict=True))[:k] == want


def test_search_of_long_texts(monkeypatch):
    """Frequent terms keep their counts, and single precision loses no row where thousands of terms add up to nearly equal scores."""
    rng, n, words, k = np.random.default_rng(4), 40, 9000, 3
    tf = rng.integers(1, 4, (n, words))
    tf[1:] = tf[0]
    tf[np.arange(n), np.arange(n)] += 1
    tf[5, 100] = 50_000
    doc, term = np.nonzero(tf)
    lengths = np.full(n, 20_000)
    packed = search.packed_shard(pa.array(np.arange(n)), lengths, doc, np.arange(words)[term].astype(np.uint64), tf[doc, term])
    shard = search.Shard(packed)
    assert shard.tfs.max() == 50_000 and shard.tfs.sum() == tf.sum()
    weights = rng.random(words) + 0.5
    scores = (tf * 2.2 / (tf + 1.2)) @ weights
    for known in (0.0, np.sort(scores)[-k]):
        parts = {"q_vocabulary": np.arange(words), "q_at": np.array([0, words]), "q_term": np.arange(words, dtype=np.int32), "q_weight": weights, "q_floor": np.array([known])}
        monkeypatch.setattr(search, "MATRIX_TERMS", 2048 if known else 1)
        one = search.Search(shard, {c: x.tobytes() for c, x in parts.items()}, 20_000.0, k)
        q, place, score = one.top()
        assert one.small > words * 2.0**-24
        assert [packed["ids"][int(p)].as_py() for p in place[:k]] == np.argsort(-scores)[:k].tolist() and score[:k] == pytest.approx(np.sort(scores)[::-1][:k], rel=1e-12)


def test_search_edges(spark):
    index = stored(search.build_index(edge_docs(spark)), "index")
    asked = edge_docs(spark).select(F.col("doc_id").alias("query_id"), "text")
    out = search.search(index, asked, 3).collect()
    best = {r.query_id: (r.doc_id, r["rank"]) for r in out if r["rank"] == 1}
    assert best[1] == (1, 1) and best[8] == (8, 1) and 2 not in best and None not in best
    nothing = stored(search.build_index(empty_docs(spark)), "index")
    assert search.search(nothing, asked, 3).count() == 0 and search.search(index, asked.limit(0), 3).count() == 0


def test_search_query_asks_whole_texts(spark):
    docs = table("documents")
    got = queries.op10_search(spark, SF).toPandas()
    for i in docs.doc_id[docs.doc_id % 20 == 0]:
        want, who, _ = brute_search(list(docs.text), list(docs.doc_id), int(np.flatnonzero(docs.doc_id == i)[0]), 10, None)
        own = got[got.query_id == i].sort_values("rank")
        assert own.score.tolist() == pytest.approx(want, rel=1e-9) and own.doc_id.tolist() == who


@pytest.mark.parametrize(("known", "few"), [(False, 24), (True, 24), (True, 10**6), (True, -1)])
def test_search_pivots_and_copies(monkeypatch, known, few):
    """Both ways of scoring a block, with floors known before or not, against all scores; copies have equal ones, in order of ids."""
    monkeypatch.setattr(search, "FEW", few)
    rng, k = np.random.default_rng(7), 5
    tf = rng.poisson(0.4 * (rng.random((150, 60)) < 0.6))
    tf[100:130] = tf[3]
    tf[140] = 0
    doc, term = np.nonzero(tf)
    keys = np.arange(60) * 7 - 200
    lengths, ids = tf.sum(axis=1), rng.permutation(150)
    packed = search.packed_shard(pa.array(ids), lengths, doc, keys[term].view(np.uint64), tf[doc, term], 16)
    shard = search.Shard(packed)
    weights = rng.random((40, 60)) * (rng.random((40, 60)) < 0.5)
    share = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths / lengths.mean())[:, None])
    scores = share @ weights.T
    floor = np.sort(scores, axis=0)[-k] if known else np.zeros(40)
    query, at = np.nonzero(weights)
    order = np.lexsort((-(tf > 0).sum(axis=0)[at], query))
    query, at = query[order], at[order]
    asked = {"q_vocabulary": keys, "q_at": np.searchsorted(query, np.arange(41)), "q_term": at.astype(np.int32), "q_weight": weights[query, at], "q_floor": floor}
    assert shard.frequencies().tolist() == (tf > 0).sum(axis=0)[np.searchsorted(keys, shard.terms)].tolist()
    q, place, score = search.Search(shard, {c: x.tobytes() for c, x in asked.items()}, lengths.mean(), k).top()
    held = np.flatnonzero(lengths)
    for own in range(40):
        exact = np.round(scores[:, own], 9)
        want = sorted((-exact[d], ids[d]) for d in held if exact[d] > 0)[:k]
        found = np.array(packed["ids"].to_pylist())[place[q == own]]
        got = sorted(zip(-np.round(score[q == own], 9), found, strict=True))[:k]
        assert got == want
