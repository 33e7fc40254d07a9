"""Secret scans over an incremental blob ledger.

Every row of a document table is one version at one path; its text, the blob, is named by the SHA-256 of its UTF-8
bytes. The ledger is an append-only Parquet folder with one row per blob and scan: the rule versions that ran and the
spans that they found, none included. ``update`` scans only the pairs of blob and rule version that the ledger does not
hold, ``findings`` joins what the ledger knows back to every path. A new version of a rule therefore costs one scan of
that rule, and a new path of a known blob costs none.

Native DataFrame functions only. A pattern cuts a text into gaps and matches (``split`` and ``regexp_extract_all`` see the
same leftmost, non-overlapping matches), and a match starts at the running sum of the lengths before it, so that work is
linear in a text's length. Equal texts are one blob and are scanned once, however many there are: they meet in an
aggregation that combines before the shuffle. The join back to paths moves ids and digests only and reads stored tables
on both sides, so that adaptive execution can split a blob with many paths.

Defined results: a null text is the empty text; rows with null or repeated ids are paths of their own; a text without a
finding has no spans; offsets count code points, ends are exclusive; further columns are not read; an empty table gives an
empty table. A pair that two concurrent updates scanned counts once.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetra.storage import new_folder, stored


class Rule(NamedTuple):
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more. A text with a match holds one of ``hints``
    (any case if ``folded``); texts without are passed over by plain comparison."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    folded: bool = False

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"

    def possible(self) -> Column:
        body = F.lower("text") if self.folded else F.col("text")
        found = [body.contains(h) for h in self.hints]
        return reduce(operator.or_, found) if found else F.col("text").rlike(self.pattern)


#: The base patterns, in the order in which spans of one start are listed. Least lengths stand in the pattern
#: where a run is taken whole or not at all; a match of ``assign`` that is too short still takes its place.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Spans beyond the base: key headers, tokens with a known head, and logins inside a URL.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("prefixed_token", 1, r"(?:gh[opsur]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", 0, 20, ("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "glpat-", "xox", "sk_live_")),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
    Rule("url_login", 1, r"[a-z]{1,16}://[^\s/:@]{1,128}:[^\s/:@]{1,128}@", hints=("://",)),
)
RULES = BASE + ADDED

LEDGER = "blob string, rules array<string>, spans array<struct<rule: string, start: bigint, end: bigint>>"


def paths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and blob of every row."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _blob(F.col(f"`{text}`")).alias("blob"))


def _blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _cuts(rule: Rule) -> Column:
    """rule, length of the gap before, of the match and of the part that counts, for every match in ``text``."""
    pattern = F.lit(rule.pattern)
    sizes = lambda found: F.transform(found, F.length)
    whole = sizes(F.regexp_extract_all("text", pattern, F.lit(0)))
    part = sizes(F.regexp_extract_all("text", pattern, F.lit(rule.group))) if rule.group else whole
    cuts = F.zip_with(
        F.arrays_zip(sizes(F.split("text", rule.pattern, -1)).alias("gap"), whole.alias("whole")), part,
        lambda c, p: F.struct(F.lit(rule.id).alias("rule"), c["gap"].alias("gap"), c["whole"].alias("size"), (p >= rule.least).alias("counts")),
    )
    wanted = F.array_contains("todo", rule.id) & rule.possible()
    return F.when(wanted, F.filter(cuts, lambda c: c["size"].isNotNull())).otherwise(F.array())


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, todo: ids of the rules to run)."""
    cuts = blobs.select("blob", "todo", F.posexplode_outer(F.concat(*[_cuts(r) for r in rules])).alias("at", "cut"))
    rows = cuts.select("blob", "todo", "at", "cut.*")
    before = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(before))
    span = F.when(F.col("counts"), F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end"))
    return ends.groupBy("blob").agg(F.first("todo").alias("rules"), F.array_sort(F.collect_list(span)).alias("spans"))


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Append to the folder ``ledger`` the scans of all pairs of blob and rule version that it does not hold."""
    spark = docs.sparkSession
    ids = F.array(*[F.lit(r.id) for r in rules])
    body = F.col(f"`{text}`")
    blobs = docs.select(_blob(body).alias("blob"), F.coalesce(body, F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = _read(spark, ledger)
    if known is None:
        todo = blobs.withColumn("todo", ids)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        left = F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", left).where(F.size("todo") > 0).drop("seen")
    scan(todo, rules).write.mode("append").parquet(ledger)


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger, or None before its first scan."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def digests(ledger: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """blob, a count n_<kind> per base rule, base_sha256 and spans: what the given rule versions found in each blob."""
    known = ledger.select("blob", F.explode_outer("spans").alias("span")).select("blob", "span.*").distinct()
    rank = F.coalesce(*[F.when(F.col("rule") == r.id, F.lit(i)) for i, r in enumerate(rules)])
    entry = F.when(rank.isNotNull(), F.struct("start", rank.alias("rank"), "end"))
    kind = lambda s: F.get(F.array(*[F.lit(r.kind) for r in rules]), s["rank"])
    text = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")
    basic = [i for i, r in enumerate(rules) if r.kind in {b.kind for b in base}]
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    return known.groupBy("blob").agg(F.array_sort(F.collect_list(entry)).alias("found")).select(
        "blob", *[count(i).alias(f"n_{rules[i].kind}") for i in basic],
        F.sha2(text(F.filter("found", lambda s: s["rank"].isin(basic))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, blob and the digests of every path whose blob the ledger holds."""
    known = digests(_read(docs.sparkSession, ledger), rules)
    return paths(docs, doc_id, text).join(stored(known, "secret-digests"), "blob")


def scan_all(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger (a new one by default) up to date with docs, then list the findings of every path."""
    ledger = ledger or new_folder(docs.sparkSession, "secret-ledger")
    update(docs, ledger, rules)
    return findings(docs, ledger, rules)
