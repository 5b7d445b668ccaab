"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by its SHA-256.  The ledger, a Parquet
table in the shared folder, has a row for each scan of a blob: the rule versions
it was scanned with, and the spans with the version that found each.  A scan
reads only blobs for which some rule version is missing, and applies only that;
findings of current versions are then joined back to all paths (rows) that hold
the blob.  All of it is built-in functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.cluster import cut, few, new_table
from helixframe.llm.spans import add_matches, count_of, joined, located

BASE = ("assign", "access", "hex")


class Rule(NamedTuple):
    """version: any text, changed with the rule; pattern; least: characters of the match, or of its group, that count; hint: a pattern that any text with a match fulfils."""

    version: str
    pattern: str
    least: int = 0
    group: int = 0
    hint: str = ""


# Of an ordinary text, a pass each over the few characters that a match must hold decides most rules.
RULES = {
    "assign": Rule("1", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, "[:=]"),
    "access": Rule("1", r"AKIA[A-Z0-9]+", 18, 0, "AKIA"),
    "hex": Rule("1", r"[0-9a-f]+", 16, 0, "[0-9a-f]{16}"),
    "pem": Rule("2", r"-----BEGIN [A-Z ]*+(?<= PRIVATE KEY)-----", 0, 0, "-----BEGIN "),
    "git": Rule("1", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0, "gh"),
}
SPAN = "struct<start:int,end:int,kind:string,version:string>"
LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"


def _kept(rule: Rule, match: Column) -> Column:
    return F.length(F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match) >= rule.least


def _versioned(spans: Column, version: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(version).alias("version")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if it doesn't exist yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, path: str, *, text_col: str = "text", rules: dict = RULES) -> None:
    """Scans the blobs of docs that the ledger lacks for some rule version, each once, and appends them."""
    spark = docs.sparkSession
    names = [f"{name}@{rule.version}" for name, rule in rules.items()]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    seen = read_ledger(spark, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    wanted = F.array(*map(F.lit, names))
    done = seen.where(F.size(F.array_except(wanted, "seen")) == 0).select("blob")
    # A blob's copies are one row before the shuffle already, so that a hot text is no burden.
    blobs = rows.join(few(done), "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    work = blobs.join(seen, "blob", "left")
    work = work.select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    due = {name: F.array_contains("todo", key) & (F.col("text").rlike(rules[name].hint) if rules[name].hint else F.lit(True)) for name, key in zip(rules, names, strict=True)}
    work = add_matches(work, {name: rule.pattern for name, rule in rules.items()}, "text", due)
    for name, rule in rules.items():
        spans = located(name, rule.pattern, "text", lambda m, rule=rule: _kept(rule, m))
        work = work.withColumn(f"__s_{name}", _versioned(spans, rule.version))
    found = F.concat(*[F.coalesce(F.col(f"__s_{name}"), F.expr(f"cast(array() as array<{SPAN}>)")) for name in rules])
    work.select("blob", F.col("todo").alias("scanned"), found.alias("spans")).write.mode("append").parquet(path)


def scan_secrets(docs: DataFrame, path: str, *, text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """All columns of docs, with secret_blob and secret_spans: array of (start, kind, end) by start, then kind as the rules list them.

    path: the ledger, in a folder that all executors share; it is brought up to
    date first.  Only spans of the versions in rules count: those that replaced
    or dropped rules have left in the ledger don't.  Positions are code points, end exclusive.  A null text reads
    as empty.  Rows with the same text share one scan and one ledger row,
    whatever their number and ids.  An empty table gives an empty table.
    Columns of docs that are called as one of the new ones are replaced; other
    names are free.
    """
    update_ledger(docs, path, text_col=text_col, rules=rules)
    current = F.array(*[F.lit(f"{name}@{rule.version}") for name, rule in rules.items()])
    own = F.filter("spans", lambda s: F.array_contains(current, F.concat_ws("@", s["kind"], s["version"])))
    ledger = read_ledger(docs.sparkSession, path).select("blob", own.alias("spans")).where(F.size("spans") > 0)
    # Two drivers may have scanned a blob at once; each span counts once.
    spans = F.array_distinct(F.flatten(F.collect_list("spans")))
    rank = lambda s: F.element_at(F.create_map(*[x for i, name in enumerate(rules) for x in (F.lit(name), F.lit(i))]), s["kind"])
    ranked = F.transform(spans, lambda s: F.struct(s["start"], rank(s).alias("rank"), s["end"], s["kind"]))
    # Kept apart from the join below, so that adaptive execution can split a blob that very many paths hold.
    findings = cut(ledger.groupBy("blob").agg(F.array_sort(ranked).alias("found")))
    old = [c for c in docs.columns if c not in ("secret_blob", "secret_spans")]
    paths = docs.select(F.struct(*[F.col(f"`{c}`") for c in old]).alias("row"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("secret_blob"))
    paths = paths.join(findings.withColumnRenamed("blob", "secret_blob"), "secret_blob", "left")
    empty = F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")
    plain = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return paths.select("row", "secret_blob", F.coalesce(plain, empty).alias("secret_spans")).select("row.*", "secret_blob", "secret_spans")


def op7_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, new_table(spark, "secret-ledger")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    counts = [count_of("secret_spans", kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
