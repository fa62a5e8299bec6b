"""URL filters by a sort-merge range join over reversed hosts.

The key of a url is its host with labels reversed, then its path: `www.example.com/en/1` becomes
`com.example.www/en/1`. A rule on host H fits H and all its subdomains, whose keys are exactly those
from rev(H) + "." up to, not including, rev(H) + "0", as "." and "/" are neighbours in code-point
order. So each ruled host is one interval, and two intervals nest or are disjoint.

Rules and urls are dealt into ranges of keys, each range is sorted, and one sweep keeps a stack of the
ruled hosts whose intervals are open. A url looks only at the stack: at each level at those rule paths
that start its path, one lookup for each rule path length of that level. The longest fitting rule
(host and path together; then the longer host, then the greater in code-point order) decides.

The ranges' bounds come from a bounded uniform sample of url keys. A bound that recurs stands for a
hot key, and that key's rows are dealt at random among its ranges. A rule goes to each range that its
interval meets: besides its own place only to ranges that begin inside it, and at one place at most
one chain of nested hosts is open. The sweep holds the rules of one such chain, not the range.

Defined results: a url that is null or has no "://" has empty host and path and fits no rule. Without
a fitting rule the verdict is `default`. Repeated urls and page_ids are judged apart. Rules with null
parts are left out; of rules with equal host and path "block" wins. An empty rule table leaves every
url at the default. Columns beside the url pass through `judge` whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import partitions, table

#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Sampled url keys for each range of keys.
SAMPLE = 50


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Ascending bounds between ranges of keys, from the SAMPLE * ranges keys with the smallest hashes."""
    sample = keys.withColumn("h", F.xxhash64("key", "salt")).orderBy("h").limit(SAMPLE * ranges).select("key")
    found = sorted(r[0] for r in sample.toLocalIterator())
    return [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """`pages` as (row, host, path, rule, verdict): row holds all its columns; rules has host, path, verdict."""
    ranges = partitions(pages.sparkSession)
    urls = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hashable = [F.col("row")[f.name] for f in pages.schema if "map<" not in f.dataType.simpleString()]
    urls = urls.withColumns({"key": F.concat(reversed_host(F.col("host")), F.lit("/"), F.col("path")), "salt": F.xxhash64(*hashable)})
    bounds = _bounds(urls.select("key", "salt"), ranges)

    def dealt(batches):
        """Adds the range of each url; among the ranges of a recurring bound the salt chooses."""
        for batch in batches:
            at = []
            for key, salt in zip(batch["key"].to_pylist(), batch["salt"].to_pylist(), strict=True):
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                at.append(low + salt % (high - low + 1))
            yield batch.append_column("at", pa.array(at, pa.int32()))

    def dealt_rules(batches):
        """A row for each range that a rule's interval meets."""
        for batch in batches:
            rows, at = [], []
            for i, key in enumerate(batch["key"].to_pylist()):
                met = range(bisect_left(bounds, key), bisect_right(bounds, key[:-1] + "0") + 1)
                rows += [i] * len(met)
                at += met
            yield batch.take(pa.array(rows, pa.int64())).append_column("at", pa.array(at, pa.int32()))

    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(F.concat(reversed_host(F.col("host")), F.lit(".")).alias("key"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    known = known.mapInArrow(dealt_rules, "key string, rule_host string, rule_path string, verdict string, at int")
    urls_schema = urls.withColumn("at", F.lit(0)).schema
    events = urls.mapInArrow(dealt, urls_schema).unionByName(known, allowMissingColumns=True)

    def sweep(batches):
        stack: list[tuple[str, dict[str, str], list[int]]] = []  # (key, verdict by path, lengths of the paths)
        at = None
        for batch in batches:
            picked, rule_of, verdict_of = [], [], []
            columns = zip(*(batch[c].to_pylist() for c in ("at", "key", "rule_host", "rule_path", "verdict", "path")), strict=True)
            for i, (place, key, rule_host, rule_path, verdict, path) in enumerate(columns):
                if place != at:
                    at = place
                    stack.clear()
                while stack and not key.startswith(stack[-1][0]) and not (key.startswith(stack[-1][0][:-1]) and key[len(stack[-1][0]) - 1 :][:1] == "/"):
                    stack.pop()
                if rule_host is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    stack[-1][1][rule_path] = verdict
                    if len(rule_path) not in stack[-1][2]:
                        stack[-1][2].append(len(rule_path))
                    continue
                best = None
                for rule_key, verdicts, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and (found := verdicts.get(path[:n])) is not None:
                            rank = (len(rule_key) + n, len(rule_key), path[:n])
                            if best is None or rank > best[0]:
                                best = (rank, rule_key, path[:n], found)
                picked.append(i)
                rule_of.append(None if best is None else ".".join(reversed(best[1][:-1].split("."))) + best[2])
                verdict_of.append(default if best is None else best[3])
            out = batch.select(["row", "host", "path"]).take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rule_of, pa.string()), pa.array(verdict_of, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    schema = urls.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("").alias("verdict")).schema
    ordered = events.repartitionById(ranges, "at").sortWithinPartitions("at", "key", F.col("rule_host").isNull())
    return ordered.mapInArrow(sweep, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT u.n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  GROUP BY u.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (n)
"""
