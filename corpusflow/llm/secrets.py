"""Secret scans with an incremental ledger of content-addressed blobs.

Every text that any path ever had is a blob named by its SHA-256. The ledger is
a stored table that says which blob was scanned by which rule version and what
was found. A scan reads it, scans only blobs for the rules that are not in it yet,
appends the findings, and joins the findings of the current rule versions back to
all paths that hold the blob. A new rule, or a new version of one, scans every
blob once more for that rule alone; a new path to a known blob costs no scan.

Everything is a column expression: a rule's matches come from one extraction, and
their places from the lengths of what lies between them. Copies are combined
before the shuffle, so a blob shared by a third of all paths is scanned once.

Defined results: null and empty texts have no finding; repeated rows each get
their row; a match that fails its rule's length is dropped, but still uses up its
characters; a token of three parts is looked for where a run of its characters starts.
Every rule takes time in proportion to a text, however long or hostile, and no call
stack. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Matches placed at a time.
BLOCK = 256
LEDGER = "blob binary, scanned array<string>, findings array<struct<rule:string,start:int,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose ``group`` must have at least ``least`` characters, and whose match must start with ``lead``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    lead: str = ""

    @property
    def version(self) -> str:
        """Changes with anything that changes what the rule finds."""
        said = f"{self.pattern}\n{self.group}\n{self.least}" + (f"\n{self.lead}" if self.lead else "")
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"


BASE = (
    Rule(
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1, 6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # Whole runs of these characters, so the length may be asked for in the pattern.
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    # A repeated class, not a repeated group: Java matches a group one call deeper each time.
    Rule("pem", "-----BEGIN (?:[A-Z][A-Z ]*)?PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Any run of these characters matches and is judged once; a pattern that starts with the lead would run to the
    # end of a run from each place inside it.
    Rule("jwt", r"[A-Za-z0-9_-]{11,}(\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?", 1, 1, "eyJ"),
)
RULES = BASE + ADDED


def spans(text: Column, rule: Rule) -> Column:
    """Places of a rule's matches, leftmost first, end exclusive, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<rule:string,start:int,stop:int>>")
    fits = [F.transform(found, lambda m: m.startswith(rule.lead)).alias("fits")] if rule.lead else []
    parts = F.arrays_zip(
        F.transform(found, F.length).alias("size"), *fits,
        F.transform(judged, F.length).alias("judged"),
        F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"),
    )

    def step(held: Column, part: Column) -> Column:
        start = held["at"] + part["gap"]
        stop = start + part["size"]
        one = F.struct(F.lit(rule.version).alias("rule"), start.alias("start"), stop.alias("stop"))
        return F.struct(
            stop.alias("at"),
            F.when((part["judged"] >= rule.least) & (part["fits"] if rule.lead else F.lit(True)), F.concat(held["out"], F.array(one))).otherwise(held["out"]).alias("out"),
        )

    def place(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step, lambda held: held["out"])

    def in_blocks(parts: Column) -> Column:
        """Arrays grow by copying, so spans are placed block by block, each from where the blocks before it end."""
        starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), F.lit(BLOCK)))
        blocks = F.transform(starts, lambda first: F.slice(parts, first, F.lit(BLOCK)))
        ends = F.aggregate(
            blocks, F.array(F.lit(0)),
            lambda held, run: F.concat(held, F.array(F.aggregate(run, F.element_at(held, -1), lambda at, m: at + m["gap"] + m["size"]))),
        )
        return F.flatten(F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(blocks)), place))

    # Bound to a name of its own, or each block would match the text again.
    placed = F.get(F.transform(F.array(parts), in_blocks), F.lit(0))
    worth = text.contains(rule.lead) if rule.lead else text.rlike(rule.pattern)
    return F.when(worth, F.coalesce(placed, none)).otherwise(none)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def blob_id(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> None:
    """Scans unseen pairs of blob and rule version and appends them to the ledger."""
    spark = docs.sparkSession
    blobs = (
        docs.select(F.coalesce("text", F.lit("")).alias("text"), blob_id("text").alias("blob"))
        .groupBy("blob").agg(F.first("text").alias("text"))
    )
    seen = F.array().cast("array<string>")
    if _exists(spark, ledger):
        known = (
            spark.read.schema(LEDGER).parquet(ledger)
            .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        )
        blobs = blobs.join(known, "blob", "left")
        seen = F.coalesce("seen", seen)
    versions = F.array(*[F.lit(r.version) for r in rules])
    new = blobs.withColumn("scanned", F.array_except(versions, seen)).filter(F.size("scanned") > 0)
    none = F.array().cast("array<struct<rule:string,start:int,stop:int>>")
    found = [
        F.when(F.array_contains("scanned", r.version), spans(F.col("text"), r)).otherwise(none) for r in rules
    ]
    new.select("blob", "scanned", F.concat(*found).alias("findings")).write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and its spans (start, no, stop; ``no`` numbers the rules as given), sorted, for every row."""
    spark = docs.sparkSession
    current = F.array(*[F.lit(r.version) for r in rules])
    entry = F.struct(
        F.lit(0).alias("start"), F.lit(0).cast("int").alias("no"), F.lit(0).alias("stop")
    )
    none = F.filter(F.array(entry), lambda _: F.lit(False))
    placed = F.transform(
        F.filter("findings", lambda f: F.array_contains(current, f["rule"])),
        lambda f: F.struct(
            f["start"].alias("start"), F.array_position(current, f["rule"]).cast("int").alias("no"), f["stop"].alias("stop")
        ),
    )
    # A pair scanned by two runs at once is in the ledger twice and counts once.
    per_blob = (
        spark.read.schema(LEDGER).parquet(ledger)
        .select("blob", placed.alias("spans")).filter(F.size("spans") > 0)
        .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    paths = docs.select("doc_id", blob_id("text").alias("blob"))
    return paths.join(per_blob, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", F.element_at(kinds, s["no"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )
