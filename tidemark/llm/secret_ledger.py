"""Secret scan with an incremental ledger of text blobs.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes
(and its length).  The ledger says which (blob, rule, rule version)
triples were scanned and what was found.  A run

1. addresses all rows, keeping one text per distinct blob;
2. drops the pairs the ledger already holds, per rule and version, so a
   blob is read again only for a new or changed rule;
3. scans the rest and appends one ledger row per (blob, rule, version),
   findings or none;
4. joins the findings back to every path (row) that carries the blob.

Only DataFrame functions are used.  A rule's spans come from two
expressions: the matches of its pattern and the pieces between them.  Their
lengths, in code points and in bytes, become one row a match; a running sum
over a text's matches gives the positions, so the work grows in proportion
to the matches.  Matches that fail the rule's length test are dropped after
matching, so the pattern's leftmost non-overlapping matches stay what they
are.  Redaction cuts a text at byte positions, which needs no walk over it.

A ledger kept under a name (``scan_with_ledger``) is a Parquet table that
runs append to.  Its rows follow from (blob, rule, version) alone, so a run
that is repeated or races with another may append a row twice; readers take
one of each.

Defined results: null text counts as empty; null or repeated ids are kept
row by row; an empty table gives an empty ledger and no rows; extra
columns are never read by the scan.  Shuffles: the text once by blob (after
dropping local copies); everything after that is narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut_lineage, only, text_or_empty, unused
from tidemark.sources.io import missing_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java syntax); a match counts if ``group`` has ``least`` characters or more."""
    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: The base rules of the query contract, in listed order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: start and end count code points, from_byte and to_byte bytes of the UTF-8 text; ends are exclusive.
SPAN = "struct<start:int,end:int,from_byte:int,to_byte:int>"
LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"


def blob_address(text: Column) -> Column:
    """Content address of a text: SHA-256 of its UTF-8 bytes, and its length."""
    return F.concat_ws("-", F.sha2(text, 256), F.octet_length(text).cast("string"))


def _simple(rule: Rule) -> str:
    """The pattern with the length test inside it, where that is the same:
    a single run of one character class cannot hide a second match."""
    for tail in ("[0-9a-f]+", "[A-Z0-9]+"):
        head = rule.pattern.removesuffix(tail)
        if rule.group == 0 and rule.pattern.endswith(tail) and (head == "" or head.isalnum()):
            return f"{head}{tail[:-1]}{{{rule.least - len(head)},}}"
    return rule.pattern


def rule_matches(rule: Rule, text: str = "text") -> Column:
    """All matches of one rule's pattern in order, as array<struct<gap,size,gap_bytes,size_bytes,ok>>:
    lengths of the piece before a match and of the match, and whether it passes the length test."""
    pattern = F.lit(_simple(rule))
    whole = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(F.col(text), pattern, F.lit(rule.group))
    pieces = F.split(F.col(text), _simple(rule), -1)
    lengths = F.transform(
        F.arrays_zip(whole.alias("w"), tested.alias("t"), F.slice(pieces, 1, F.size(whole)).alias("p")),
        lambda x: F.struct(F.char_length(x["p"]).alias("gap"), F.char_length(x["w"]).alias("size"),
                           F.octet_length(x["p"]).alias("gap_bytes"), F.octet_length(x["w"]).alias("size_bytes"),
                           (F.char_length(x["t"]) >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<gap:int,size:int,gap_bytes:int,size_bytes:int,ok:boolean>>")
    return F.when(F.col(text).rlike(_simple(rule)), lengths).otherwise(none)


def scan_blobs(blobs: DataFrame, rules=BASE_RULES) -> DataFrame:
    """New ledger rows for every (blob, rule) of ``blobs`` (blob, text, todo array<string>)."""
    found = [F.when(F.array_contains("todo", r.name), F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), rule_matches(r).alias("matches"))) for r in rules]
    key = ["blob", "rule", "version"]
    scanned = cut_lineage(blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("x"))
                          .select("blob", "x.rule", "x.version", "x.matches"), "matches")
    upto = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end, to_byte = (F.sum(F.col(f"m.gap{u}") + F.col(f"m.size{u}")).over(upto).cast("int") for u in ("", "_bytes"))
    spans = (scanned.filter(F.size("matches") > 0).select(*key, F.posexplode("matches").alias("i", "m"))
             .select(*key, "m", end.alias("end"), to_byte.alias("to_byte"))
             .groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("m.ok"), F.struct(
                 (F.col("end") - F.col("m.size")).alias("start"), "end",
                 (F.col("to_byte") - F.col("m.size_bytes")).alias("from_byte"), "to_byte")))).cast(f"array<{SPAN}>").alias("spans")))
    none = scanned.filter(F.size("matches") == 0).select(*key, F.array().cast(f"array<{SPAN}>").alias("spans"))
    return spans.unionByName(none)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules=BASE_RULES,
                  text_col: str = "text") -> DataFrame:
    """The rows to append to ``ledger`` so that it covers every text of ``versions``."""
    blobs = (only(versions, text=text_col).select(text_or_empty().alias("text"))
             .select(blob_address(F.col("text")).alias("blob"), "text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = blobs.dropDuplicates(["blob"]).withColumn("todo", names)
    else:
        known = F.lit(False)
        for r in rules:
            known = known | ((F.col("rule") == r.name) & (F.col("version") == r.version))
        done = ledger.filter(known).groupBy(F.col("blob").alias("known")).agg(F.collect_set("rule").alias("done"))
        todo = (blobs.dropDuplicates(["blob"]).join(done, F.col("blob") == F.col("known"), "left")
                .withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
                .filter(F.size("todo") > 0).select("blob", "text", "todo"))
    return scan_blobs(todo, rules)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules=BASE_RULES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per row of ``versions``: doc_id, blob and found, an array of
    (start, kind, rule, end, from_byte, to_byte) ordered by start, then the rules' listed order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    found = (ledger.filter(current & (F.size("spans") > 0))
             .select("blob", F.transform("spans", lambda s: F.struct(
                 s["start"].alias("start"), order[F.col("rule")].alias("kind"), F.col("rule").alias("rule"),
                 s["end"].alias("end"), s["from_byte"].alias("from_byte"), s["to_byte"].alias("to_byte"))).alias("found"))
             .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found")))
    paths = (only(versions, id=id_col, text=text_col)
             .select(F.col("id").cast("long").alias("doc_id"), blob_address(text_or_empty()).alias("blob")))
    empty = F.array().cast("array<struct<start:int,kind:int,rule:string,end:int,from_byte:int,to_byte:int>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found"))


def secret_findings(versions: DataFrame, ledger: DataFrame | None = None, rules=BASE_RULES, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per path, ledger after the run); the new ledger rows are written."""
    fresh = cut_lineage(update_ledger(versions, ledger, rules, text_col), "ledger")
    after = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    return findings_by_path(versions, after, rules, id_col, text_col), after


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The named ledger, each (blob, rule, version) once; empty if there is none yet."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.createDataFrame([], LEDGER)
    return rows.dropDuplicates(["blob", "rule", "version"])


def scan_with_ledger(versions: DataFrame, path: str, rules=BASE_RULES, id_col: str = "doc_id",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per path, the rows this run appended to the ledger at ``path``)."""
    ledger = read_ledger(versions.sparkSession, path)
    fresh = cut_lineage(update_ledger(versions, ledger, rules, text_col), "ledger")
    known = cut_lineage(ledger.unionByName(fresh), "ledger-known")     # the table itself changes next
    fresh.write.mode("append").parquet(path)
    return findings_by_path(versions, known, rules, id_col, text_col), fresh


def digest(found: DataFrame, rules=BASE_RULES) -> DataFrame:
    """Counts per rule and the joined spans of each path."""
    joined = F.concat_ws(",", F.transform("found", lambda s: F.concat_ws(
        ":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda name: lambda s: s["rule"] == name
    counts = [F.size(F.filter("found", of(r.name))).cast("long").alias(f"n_{r.name}") for r in rules]
    return found.select("doc_id", *counts, joined.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def redact(docs: DataFrame, found: DataFrame, mask: str = "[REDACTED]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (overlapping spans by one).

    ``found`` gives the blob's spans; rows are matched by content address."""
    key, blob, kept, tail = (unused(docs, c) for c in ("key", "blob", "kept", "tail"))
    spans = (found.filter(F.size("found") > 0).select("blob", "found").dropDuplicates(["blob"])
             .select("blob", F.explode("found").alias("s")).select("blob", "s.from_byte", "s.to_byte", "s.kind"))
    before = Window.partitionBy("blob").orderBy("from_byte", "kind").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("to_byte").over(before), F.lit(0))           # end of the masks so far
    opens = spans.select("blob", "to_byte", "from_byte", reach.alias("reach"))
    pieces = opens.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.when(F.col("from_byte") >= F.col("reach"), F.struct(
            F.col("reach").alias("a"), F.col("from_byte").alias("b"))))).alias(kept), F.max("to_byte").alias(tail))
    text = F.col(f"`{text_col}`")
    # the outer transform takes the bytes once; a piece is then a copy of its own bytes
    cut = F.transform(F.array(text.cast("binary")), lambda data: F.array_join(F.concat(
        F.transform(F.col(kept), lambda p: F.substring(data, p["a"] + 1, p["b"] - p["a"]).cast("string")),
        F.array(F.substring(data, F.col(tail) + 1, F.octet_length(data)).cast("string"))), mask))[0]
    return (docs.withColumn(key, blob_address(text_or_empty(text_col)))
            .join(pieces.withColumnRenamed("blob", blob), F.col(key) == F.col(blob), "left")
            .withColumn(text_col, F.when(F.col(kept).isNull(), text).otherwise(cut))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
