"""Secret scans over an incremental ledger of content-addressed blobs.

Only DataFrame operations. A version is a row (path columns, text); its blob is the
SHA-256 of the text. The ledger holds, as Parquet in one folder, the (blob, rule
version) pairs that were scanned and the findings. A scan reads the text of each
unseen blob once, however many paths hold it, appends to the ledger, and findings
are joined back to all paths.

Spans count code points, end exclusive. A null text is the empty text; a null path is
kept; repeated rows and equal texts get equal findings; an empty table gives an empty
result; other columns are not read by ``scan`` and are kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from docloom.llm.store import exists, join_small, new_dir, staged


FINDINGS = "blob_id string, rule_key string, start bigint, `end` bigint"
SCANNED = "blob_id string, rule_key string"


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must have ``least`` characters. Matches are leftmost and don't overlap."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The contract's three kinds in their order, then two public token formats.
NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
RULES = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
)
BASE = ("assign", "access", "hex")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(text: Column, rule: Rule, number: int) -> Column:
    """An array of (rule, i, before, length, ok): the gap before each match, and the match."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    if rule.group:
        pairs = F.zip_with(whole, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m, g: F.struct(F.length(m).alias("len"), F.length(g).alias("part")))
    else:
        pairs = F.transform(whole, lambda m: F.struct(F.length(m).alias("len"), F.length(m).alias("part")))
    # There is a gap more than there are matches; zip_with gives null for it.
    hits = F.zip_with(
        pairs,
        gaps,
        lambda m, gap: F.struct(
            F.lit(number).alias("rule"),
            F.length(gap).alias("before"),
            m["len"].alias("len"),
            (m["part"] >= rule.least).alias("ok"),
        ),
    )
    return F.filter(hits, lambda h: h["len"].isNotNull())


def find(blobs: DataFrame, rules: tuple[Rule, ...], seen: str | None = None) -> DataFrame:
    """(blob_id, rule, start, end) of blobs(blob_id, text[, seen]); seen: array of rule keys to leave out."""
    arrays = []
    for n, rule in enumerate(rules):
        todo = F.col("text").rlike(rule.pattern)
        if seen:
            todo = todo & ~F.array_contains(F.col(seen), rule.key)
        hits = _hits(F.col("text"), rule, n)
        arrays.append(F.when(todo, hits).otherwise(F.expr("cast(array() as array<struct<rule:int,before:int,len:int,ok:boolean>>)")))
    rows = blobs.select("blob_id", F.posexplode(F.concat(*arrays)).alias("i", "hit")).select("blob_id", "i", "hit.*")
    each = Window.partitionBy("blob_id", "rule").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("len")).over(each))
    return rows.where("ok").select("blob_id", "rule", (F.col("end") - F.col("len")).alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger has not seen; return (blob_id, kind, rule, start, end) of all blobs in it."""
    spark = versions.sparkSession
    named = versions.select(blob_id(F.col(text)).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unseen = named
    keys = [r.key for r in rules]
    if exists(spark, f"{ledger}/scanned"):
        scanned = spark.read.schema(SCANNED).parquet(f"{ledger}/scanned").where(F.col("rule_key").isin(keys))
        seen = scanned.groupBy("blob_id").agg(F.collect_set("rule_key").alias("seen"))
        unseen = named.dropDuplicates(["blob_id"]).join(seen, "blob_id", "left")
        unseen = unseen.where(F.col("seen").isNull() | (F.size("seen") < len(keys)))
        unseen = unseen.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        found = find(unseen, rules, "seen")
        pairs = unseen.select("blob_id", F.explode(F.array_except(F.array(*map(F.lit, keys)), F.col("seen"))).alias("rule_key"))
    else:
        found = find(named.dropDuplicates(["blob_id"]), rules)
        pairs = named.select("blob_id").distinct().select("blob_id", F.explode(F.array(*map(F.lit, keys))).alias("rule_key"))
    # The unseen pairs are fixed before the ledger grows; findings go first, so that a
    # scan that is cut off between the two writes is scanned again.
    step = new_dir(spark, "ledger-step")
    pairs.write.parquet(f"{step}/scanned")
    names = F.element_at(F.array(*map(F.lit, keys)), F.col("rule") + 1)
    found.select("blob_id", names.alias("rule_key"), "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    spark.read.schema(SCANNED).parquet(f"{step}/scanned").write.mode("append").parquet(f"{ledger}/scanned")
    kinds = F.element_at(F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.key), F.lit(n))]), F.col("rule_key"))
    every = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings").where(F.col("rule_key").isin(keys)).distinct()
    return every.select("blob_id", F.split_part("rule_key", F.lit("@"), F.lit(1)).alias("kind"), kinds.alias("rule"), "start", "end")


def by_path(versions: DataFrame, findings: DataFrame, text: str | None = "text", spans: str = "spans", blob: str = "blob_id") -> DataFrame:
    """versions with ``spans`` (in place of a column of that name), a sorted array of (start, rule, kind, end); empty where nothing is found.

    Where ``text`` is None, versions has the blob's name in column ``blob``, and no text moves; else
    only texts with findings do, where their names are few enough to be broadcast.
    """
    each = findings.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "rule", "kind", "end"))).alias("spans"))
    each = each.toDF("_hit_blob", "_hit_spans")
    names = [c for c in versions.columns if c != spans]
    own = versions.toDF(*(f"_{n}" for n in range(len(versions.columns))))
    at = {c: F.col(f"_{n}") for n, c in enumerate(versions.columns)}
    if text is None:
        joined = own.join(each, at[blob] == F.col("_hit_blob"), "left")
    else:
        joined = join_small(own, staged(each, "hits"), blob_id(at[text]), "_hit_blob", "left")
    none = F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")
    return joined.select(*(at[c].alias(c) for c in names), F.coalesce("_hit_spans", none).alias(spans))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by ``mark``; overlapping spans become one."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    # Columns go by number meanwhile, so that no name of docs clashes.
    columns = docs.columns
    hit = by_path(docs.toDF(*(f"c{n}" for n in range(len(columns)))), findings, f"c{columns.index('text')}", "found")
    text = F.col(f"c{columns.index('text')}")

    def step(acc, s):
        part = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], F.array(part, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    end = F.array_max(F.transform("found", lambda s: s["end"])).cast("int")
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, end + 1, F.length(text)))
    clean = F.when(F.size("found") > 0, F.aggregate("found", start, step, done)).otherwise(text)
    return hit.select(*(clean.alias(c) if c == "text" else F.col(f"c{n}").alias(c) for n, c in enumerate(columns)))
