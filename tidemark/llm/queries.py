"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, licences, mixture, ppm, quality, reshard, search, secrets, simhash, toxicity, turns, urlrules
from ..sources.scratch import shared_path
from .store import stored
from .textmodel import some_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: ``doc_id, fingerprint, component_id``."""
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


@_query
def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every text of ``documents`` under a byte trie of the training rows, with the word base."""
    return ppm.score(_table(spark, sf_dir, "documents"))


@_query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, now held by source, over 40 shards of near-equal bytes at the fewest bytes moved, as read from the shards written."""
    rows = reshard.rewritten(reshard.by_source(_table(spark, sf_dir, "documents")), 40, shared_path(spark, "shards"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


# The url rules of query op4.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


@_query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule and the verdict for every url of ``pages``."""
    rules = licences.literal_rows(spark, URL_RULES, ["host", "path", "verdict"])
    return urlrules.judge(_table(spark, sf_dir, "pages"), rules)


ORACLES["op4_url_rules"] = """
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS n,
                CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
split AS (SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
best AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
         FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (n)
"""


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learnt from the labels of rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


# Target shares of tokens by language for query op6 and the pipeline.
WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def language_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> mixture.Domains:
    """Domains told by the languages of those documents that ``labels`` covers."""
    covered = docs.where("lang IS NOT NULL").select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    chosen = some_ids(covered, mixture.MAX_LABELLED)
    return mixture.fit_domains(docs.join(chosen, "doc_id", "left_semi").withColumn("domain", F.col("lang")))


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row of ``documents`` is to be taken for its languages to have their target shares."""
    docs = _table(spark, sf_dir, "documents")
    rated = mixture.mixed(docs.select("doc_id", "text"), language_domains(spark, docs, sf_dir), WEIGHTS)
    return rated.select("doc_id", "tokens", "domains", "rate", "copies")


@_query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every text of ``documents``."""
    return licences.scan(_table(spark, sf_dir, "documents"))


@_query
def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the ``benchmark`` passages it holds."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every row of ``documents`` by text, by metadata and by both, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


@_query
def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of ``documents`` for every row whose id is divisible by 20, by BM25 on that row's whole text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = stored(search.build_index(docs), "index", batch=500)  # whole texts are large
    return search.search(index, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


@_query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the vectors of ``embeddings`` by six rounds of Yinyang Lloyd over 16 entries for each eighth of a vector."""
    return codes.digest(*codes.compress(_table(spark, sf_dir, "embeddings")))


# Fixed values of query op11's oracle: parts, entries, rounds.
_P, _K, _R = 8, 16, 6


def _codes_sql() -> str:
    part = "list_slice(x, p * len(x) // 8 + 1, (p + 1) * len(x) // 8)"
    nearest = "SELECT vec_id, label, p, v, arg_min(j, row(dist, j)) AS j, min(dist) AS dist FROM (SELECT q.*, b.j, list_sum(list_transform(list_zip(q.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM q JOIN {book} b USING (p)) GROUP BY vec_id, label, p, v"
    rounds = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"q AS MATERIALIZED (SELECT vec_id, label, CAST(p AS INTEGER) AS p, {part} AS v FROM k, range({_P}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS j, v AS e FROM q WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {_K}))",
    ]
    for r in range(_R + 1):
        rounds.append(f"a{r} AS MATERIALIZED ({nearest.format(book=f'b{r}')})")
        if r < _R:
            rounds.append(f"m{r} AS (SELECT p, j, i, sum(c) AS s, count(*) AS n FROM (SELECT p, j, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2, 3)")
            rounds.append(f"e{r} AS (SELECT p, j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM m{r} GROUP BY 1, 2)")
            rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT o.p, o.j, coalesce(w.e, o.e) AS e FROM b{r} o LEFT JOIN e{r} w ON w.p = o.p AND w.j = o.j)")
    return f"""WITH {", ".join(rounds)},
    c AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{_R} GROUP BY 1, 2),
    h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{_R})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


ORACLES["op11_codes"] = _codes_sql()


@_query
def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations``, each rebuilt on the first turns of another one."""
    own = turns.placed(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    return turns.trie(turns.rebuilt(own, head, F.col("conv_id") - F.col("conv_id") % 100, HEADS - 1)).drop("n_ends")


HEADS = 6  # of query op12: heads have fewer turns than this

_CRC_STEP = "xor(c, s)"
for _ in range(8):
    _CRC_STEP = f"list_transform([{_CRC_STEP}], lambda x: xor(x >> 1, (x & 1) * 3988292384))[1]"  # a bit of CRC-32, reflected

ORACLES["op12_turns"] = f"""
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, '')))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, s: {_CRC_STEP}), 4294967295::BIGINT) % {HEADS} AS h FROM t),
b AS (SELECT c.conv_id, list_concat(coalesce(o.own[:c.h], []), c.own[c.h + 1:]) AS seq FROM crc c LEFT JOIN t o ON o.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, seq[:d] AS node, d, d = len(seq) AS ends, CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS size FROM b, range(100000) r(d) WHERE d <= len(seq)),
n AS MATERIALIZED (SELECT node, d, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS MATERIALIZED (SELECT v.node, count(u.node) AS n_children FROM n v LEFT JOIN n u ON u.d = v.d + 1 AND u.node[:v.d] = v.node GROUP BY 1),
s AS (SELECT v.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved FROM n v JOIN n u ON u.d >= v.d AND u.node[:v.d] = v.node JOIN k ON k.node = u.node GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM n JOIN k USING (node) JOIN s USING (node) LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.node[:n.d - 1]
"""


@_query
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``: those of known forms, and strings that the corpus's identifiers don't make shorter."""
    docs = _table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.identifiers(docs)))
