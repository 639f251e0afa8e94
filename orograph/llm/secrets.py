r"""Secret scan over an incremental blob ledger, with DataFrame functions only.

A text is a blob, known by its SHA-256. The ledger is a folder of Parquet rows ``(blob, rules, findings)``: the rule
versions (``kind@version``) that were run over the blob in one scan, and what they found. A scan takes every historical
version's text, looks up which rule versions its blob has not seen, reads one copy of each blob that has some, runs only
those rules, appends to the ledger, and joins findings back to every path (here: document) that has the blob.

Findings of a rule are the leftmost non-overlapping matches of its pattern; those whose group ``part`` is shorter than
``least`` are dropped after matching, so what they cover stays used up. Offsets count code points, ends are exclusive.

Defined results: a null text is an empty blob. Repeated rows share a blob and each get its findings. An empty table gives
no rows. Extra columns are ignored by the scan.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int>"
#: Matches that are folded together.
FOLD = 128


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: The base rules. In hex and access a run that is long enough is found by its own length: a shorter one holds no longer one.
ASSIGN = Rule("assign", "(" + "|".join(any_case(x) for x in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = Rule("access", "AKIA[A-Z0-9]{16,}")
HEX = Rule("hex", "[0-9a-f]{24,}")
BASE_RULES = (ASSIGN, ACCESS, HEX)
#: Public token formats.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def find(text: Column, rule: Rule) -> Column:
    """array<SPAN> of a rule's findings. The pieces between matches and the matches themselves tell where each one lies.

    Lengths are added up in blocks of ``FOLD`` matches, and the blocks are moved by what comes before them: an array that grows by a fold is never
    longer than a block or the number of blocks, so a text with very many findings takes time in proportion."""
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part))
    each = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(part, F.length).alias("part"))
    none, no_numbers = F.array().cast(f"array<{SPAN}>"), F.array().cast("array<int>")

    def step(acc, x):
        at = acc["at"] + x["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), at.alias("start"), (at + x["n"]).alias("end"))
        return F.struct((at + F.coalesce(x["n"], F.lit(0))).alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def folded(each):
        blocks = F.transform(F.sequence(F.lit(1), F.size(each), F.lit(FOLD)), lambda i: F.aggregate(F.slice(each, i, F.lit(FOLD)), F.struct(F.lit(0).alias("at"), none.alias("found")), step))
        return F.transform(F.array(blocks), placed)[0]

    def placed(blocks):
        start = F.struct(F.lit(0).alias("at"), no_numbers.alias("all"))
        before = F.aggregate(blocks, start, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        moved = lambda b, by: F.transform(b["found"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end")))
        return F.flatten(F.zip_with(blocks, before, moved))

    # an array of one is how an expression gets a name, so that it is worked out once
    return F.when(text.rlike(rule.pattern), F.transform(F.array(each), folded)[0]).otherwise(none)


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob binary, rules array<string>, findings array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # no scan was made yet
            raise
        return spark.createDataFrame([], schema)


def scan(docs: DataFrame, ledger: str, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Brings the ledger (a folder) up to date with docs and returns ``doc_id, blob, findings`` for each row of docs."""
    spark = docs.sparkSession
    wanted = F.array(*(F.lit(r.key) for r in rules))
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_of(text).alias("blob"))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("copy"))
    known = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    unseen = blobs.join(known, "blob", "left").select("blob", "copy", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    texts = docs.select(F.col(doc_id).alias("copy"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # a repeated id with other texts meets its blob again by the digest; equal rows are told apart by nothing and count once
    meet = texts.join(unseen.hint("shuffle_hash"), texts["copy"].eqNullSafe(unseen["copy"]) & (F.unhex(F.sha2("t", 256)) == unseen["blob"]))
    found = F.concat(*(F.when(F.array_contains("todo", r.key), find(F.col("t"), r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules))
    meet.select("blob", F.col("todo").alias("rules"), found.alias("findings")).write.mode("append").parquet(ledger)
    now = read_ledger(spark, ledger)
    kinds = [r.kind for r in rules]
    spans = F.filter(F.flatten(F.collect_list("findings")), lambda x: x["kind"].isin(kinds))
    # a rule's newer version replaces what an older one found: only rows that ran a wanted version count
    now = now.where(F.arrays_overlap("rules", wanted) & (F.size("findings") > 0)).withColumn(
        "findings", F.filter("findings", lambda x: F.exists("rules", lambda r: F.array_contains(wanted, r) & (F.substring_index(r, "@", 1) == x["kind"]))))
    found = now.groupBy("blob").agg(spans.alias("findings"))
    order = F.create_map(*(F.lit(v) for i, k in enumerate(kinds) for v in (k, i)))
    by = lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    # two scans of one blob at a time may have written the same findings: equal ones are neighbours
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    sorted_ = F.transform(F.array(F.array_sort(F.transform("findings", by))), once)[0]
    sorted_ = F.transform(sorted_, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return paths.join(found.select("blob", sorted_.alias("findings")), "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
