"""Operator 4: url filters by a sort-merge sweep over reversed-host keys. DataFrame functions only.

A url is asked once for each suffix of its host, under the key ``reversed labels, then path``. Under such
keys a rule is an interval: it opens at its own key and closes behind the last key that starts with it.
Rules and keys of one suffix are sorted together; on the way a rule's opening puts it on top of the stack
and its closing brings back the rule around it, so each key sees the innermost rule that is active there.
Of the suffixes' rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def _host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _rule_events(rules: DataFrame) -> DataFrame:
    """Openings and closings ``(suffix, at, kind, top)``; ``top`` is the innermost rule from there on.

    The rule around another one on the same host is found by its prefixes, of the lengths that rules have.
    """
    lengths = F.broadcast(rules.select(F.length("rule_path").alias("n")).distinct())
    inner = rules.join(lengths, F.col("n") < F.length("rule_path")).select(
        "suffix", F.col("rule_path").alias("inner_path"), F.substring("rule_path", F.lit(1), F.col("n")).alias("rule_path")
    )
    around = inner.join(rules, ["suffix", "rule_path"]).groupBy("suffix", "inner_path")
    around = around.agg(F.max_by("own", F.length("rule_path")).alias("outer"))
    opened = rules.select("suffix", F.col("rule_path").cast("binary").alias("at"), F.lit(0).alias("kind"), F.col("own").alias("top"))
    none = "named_struct('size', -1, 'labels', 0, 'rule', cast(null AS string), 'verdict', cast(null AS string))"
    closed = rules.join(around.withColumnRenamed("inner_path", "rule_path"), ["suffix", "rule_path"], "left").select(
        "suffix",
        F.concat(F.col("rule_path").cast("binary"), F.unhex(F.lit("FF"))).alias("at"),
        F.lit(2).alias("kind"),
        F.coalesce("outer", F.expr(none)).alias("top"),
    )
    return opened.union(closed)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url, ...)``.

    ``rules(host, path, verdict)``: a rule fits its host and all its subdomains if the url's path starts with
    the rule's path; the one with the longest ``host`` + ``path`` wins, then the one with more labels. Of equal
    rules with different verdicts ``block`` holds. Rules with a null column or an empty host are ignored. Where no
    rule fits, ``rule`` is null and ``verdict`` is ``default``; so it is for null urls and those without ``://``,
    whose host and path are empty. Repeated rows and null ids come back as they are; an empty table gives an empty
    result; columns other than the named ones are ignored.

    Pages are asked for once for each different combination that rules can tell apart (as many labels and as long a
    path as the longest rule has), so a host with a third of all rows costs no more than another one; its keys
    are spread over salts, to each of which only that host's rules are copied.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("rule_path"), F.col("verdict").alias("v"))
    rules = rules.where("h <> '' AND rule_path IS NOT NULL AND v IS NOT NULL").groupBy("h", "rule_path").agg(F.max("v").alias("v"))
    rules = rules.select(
        F.array_join(_labels(F.col("h")), ".").alias("suffix"),
        "rule_path",
        F.struct(
            (F.length("h") + F.length("rule_path")).alias("size"),
            F.size(_labels(F.col("h"))).alias("labels"),
            F.concat("h", "rule_path").alias("rule"),
            F.col("v").alias("verdict"),
        ).alias("own"),
    )
    depth, reach = rules.agg(F.coalesce(F.max("own.labels"), F.lit(1)), F.coalesce(F.max(F.length("rule_path")), F.lit(0))).first()

    host, path = _host_and_path(F.col("url"))
    asked = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = asked.withColumn("near", F.array_join(F.slice(_labels(F.col("host")), 1, depth), "."))
    asked = asked.withColumn("front", F.substring("path", 1, reach))
    keys = asked.select("near", "front").distinct()
    labels = F.split("near", r"\.")
    keys = keys.select(
        "near", "front", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))).alias("suffix")
    )
    keys = keys.select(
        "suffix",
        F.pmod(F.xxhash64("front"), F.lit(SALTS)).alias("salt"),
        F.col("front").cast("binary").alias("at"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(rules.schema["own"].dataType).alias("top"),
        "near",
        "front",
    )
    events = _rule_events(rules).select(
        "suffix", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt"), "at", "kind", "top"
    )
    sweep = Window.partitionBy("suffix", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = keys.unionByName(events, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(sweep))
    best = seen.where("kind = 1 AND top.size >= 0").groupBy("near", "front").agg(F.max("top").alias("top"))
    return asked.join(best, ["near", "front"], "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )
