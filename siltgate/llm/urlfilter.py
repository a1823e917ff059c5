"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest confirmation.

Each URL is expanded into the expressions that a rule could name: the suffixes
of its host at a label boundary, with the prefixes of its path, both of the
lengths that rules have, so a long URL has no more of them than a short one. Expressions meet the rules in an equi-join on the first
four bytes of their SHA-256; the full digests then confirm the pairs, and the
longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")])
#: Rule tables with at most so many rows are broadcast (under 64 MB at 640 bytes a rule).
BROADCAST_RULES = 100_000
#: Rule tables beyond that are repeated so many times, and the expressions salted as often.
SALTS = 16


def _lower(c):
    """A-Z to lower case and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url) -> tuple:
    """Host and path of a URL column: both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, _lower(host)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def _hosts(host, most: int):
    """The host's suffixes at a label boundary, with at most as many labels as a rule has."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def _paths(path, lengths: list[int]):
    """The path's prefixes of the lengths that rules have."""
    listed = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    return F.transform(F.filter(listed, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict for the column ``url``.

    ``rules(host, path, verdict)``: a rule fits a URL whose host is the rule's
    or one of its subdomains and whose path starts with the rule's path; the
    longest rule string (host and path) wins, at equal length the one with the longer host,
    then ``block``. No fitting rule: rule null and the ``default`` verdict.

    Defined cases: a null URL or one without ``://`` has an empty host and path
    and fits no rule; so does an empty host. Repeated pages keep a row each,
    repeated rules count once. All columns of ``pages`` are returned; columns
    called host, path, rule or verdict are replaced. Texts of any length work.
    """
    rules = rules.select(_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null").distinct()
    # The distinct lengths of rule paths: at most as many as a URL has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    rules = rules.withColumn("text", F.concat("host", "path"))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    keyed = rules.select(
        F.struct(F.length("text").alias("size"), F.length("host").alias("hosted"), F.col("verdict").alias("verdict"), "text").alias("fits"),
        digest(F.concat_ws("\0", "host", "path")).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, 4))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = parts(F.col(url))
    # a host and path are judged once, however many pages have them; the pages themselves are not carried along
    rows = pages.select(host.alias("_host"), path.alias("_path")).where("_host <> ''").distinct()
    wide = rows.select("_host", "_path", F.explode(_hosts(F.col("_host"), most)).alias("h")).select("*", F.explode(_paths(F.col("_path"), lengths)).alias("p"))
    wide = wide.withColumn("digest", digest(F.concat_ws("\0", "h", "p"))).withColumn("short", F.substring("digest", 1, 4))
    if keyed.count() <= BROADCAST_RULES:
        met = wide.join(F.broadcast(keyed), "short")
    else:
        wide = wide.withColumn("salt", F.pmod(F.xxhash64("_host", "_path"), F.lit(SALTS)))
        met = wide.join(keyed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["short", "salt"])
    best = met.where("digest = rule_digest").groupBy("_host", "_path").agg(F.max("fits").alias("fits"))
    page = pages.select(F.struct(*kept).alias("_page"), host.alias("_host"), path.alias("_path"))
    out = page.join(best, ["_host", "_path"], "left")
    return out.select(*[F.col("_page")[c].alias(c) for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("fits.text").alias("rule"), F.coalesce("fits.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (``host/path``, verdict)."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules]
    return spark.createDataFrame(rows, RULE_TYPE)
