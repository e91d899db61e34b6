"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its bytes. The ledger is a
Parquet table of (blob, rules, spans): which rule versions have looked at a blob and what they
found. A scan reads only blobs for which some rule version is missing, once per distinct blob
and with the missing rules alone, and appends; findings are then joined back to all paths.
Raising a rule's version makes exactly that rule run again.

Offsets are code points, end exclusive. Matches of one rule are leftmost and do not overlap;
a match that fails the rule's length is dropped and the search goes on behind it.

Defined results: NULL texts count as empty; repeated rows share one blob and one scan; an empty
table gives an empty result and leaves the ledger as it was; very long texts are scanned whole, in
time that follows their length; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F

from chaintally.llm import common
from chaintally.session import shared_folder

common.travels(__name__)


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    flags: int = 0
    #: Group whose length counts, and the least length.
    group: int = 0
    least: int = 0
    #: Lower-case texts of which a match must contain one; spares most texts the slow search.
    needs: tuple[str, ...] = ()

    @property
    def name(self):
        return f"{self.kind}@{self.version}"


#: In the order in which spans with the same start are listed.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.IGNORECASE | re.ASCII, group=2, least=8, needs=("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, needs=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),  # whole runs, as [0-9a-f]+ with 32 or more characters
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs=("private key-----",)),
    # runs are entered at their beginning only and not given back, so that a long one is read once
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", needs=("eyj",)),
)
BASE = ("assign", "access", "hex")
#: Written in place of a secret.
MASK = "[secret]"

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def scanner(rules):
    """A function from (text, names of rules) to the sorted spans of those rules."""
    ready = []
    for order, rule in enumerate(rules):
        ready.append((order, rule, re.compile(rule.pattern, rule.flags)))

    def find(text, names):
        lower, found = text.lower(), []
        for order, rule, pattern in ready:
            if rule.name in names and (not rule.needs or any(x in lower for x in rule.needs)):
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.append((m.start(), order, m.end(), rule.kind))
        return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(found)]

    return find


def content_address(docs):
    """``docs`` with ``blob``, the SHA-256 of the text's bytes."""
    return docs.withColumn("blob", F.sha2(common.as_bytes(), 256))


def _exists(spark, path):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def read_ledger(spark, path):
    return spark.read.schema(f"blob string, rules array<string>, spans {DDL}").parquet(path)


def update(docs, path, rules=RULES):
    """Scan what the ledger at ``path`` lacks for the texts of ``docs``, and append it there."""
    spark, wanted = docs.sparkSession, F.array(*[F.lit(r.name) for r in rules])
    versions = content_address(docs.select("text"))
    if _exists(spark, path):
        seen = read_ledger(spark, path).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        missing = versions.select("blob").distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")
        ).filter(F.size("rules") > 0)
        versions = versions.join(missing, "blob")
    else:
        versions = versions.withColumn("rules", wanted)
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))

    def make():
        find = scanner(rules)
        return lambda row: (find(row["text"] or "", set(row["rules"])),)

    find = common.struct_udf(make, f"spans {DDL}", pa.schema([("spans", SPANS)]))
    (blobs.withColumn("found", find(F.struct("text", "rules")))
     .select("blob", "rules", F.col("found.spans").alias("spans")).write.mode("append").parquet(path))
    return read_ledger(spark, path)


def findings(docs, ledger, rules=RULES):
    """``docs`` with ``spans`` of the given rules, joined back from the ledger to every path.

    Blobs without a finding are left out before the join; a blob that many paths share is one
    row on the ledger's side, and its paths are split by skew-join handling.
    """
    own = [c for c in docs.columns if c.lower() not in ("blob", "spans")]
    kinds, current = [r.kind for r in rules], F.array(*[F.lit(r.name) for r in rules])
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    # spans of superseded versions stay in the ledger, but only current ones are returned
    rows = ledger.filter(F.size("spans") > 0).withColumn("kinds", F.transform(
        F.array_intersect("rules", current), lambda n: F.substring_index(n, "@", 1)))
    known = rows.select("blob", F.filter("spans", lambda s: F.array_contains("kinds", s["kind"])).alias("spans")).filter(
        F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    known = known.select("blob", F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    keyed = content_address(docs).select(*own, "blob")
    return keyed.join(known, "blob", "left").select(
        *own, "blob", F.coalesce("spans", F.array().cast(DDL)).alias("spans"))


def scan(docs, path=None, rules=RULES):
    """Update the ledger (a new one in the shared folder if no path is given) and return the findings."""
    path = path or new_ledger(docs.sparkSession)
    return findings(docs, update(docs, path, rules), rules)


def new_ledger(spark):
    return f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex[:12]}"


def redact(docs, path=None, rules=RULES):
    """``docs`` with every span in the text replaced by the mask; overlapping spans by one mask."""
    own = docs.columns

    def make():
        def mask(row):
            text, spans = row["text"], row["spans"]
            if text is None or not spans:
                return (text,)
            kept, last = [], 0
            for s in spans:
                if s["start"] >= last:
                    kept += [text[last:s["start"]], MASK]
                last = max(last, s["end"])
            return ("".join([*kept, text[last:]]),)
        return mask

    mask = common.struct_udf(make, "text string", pa.schema([("text", pa.string())]))
    found = scan(docs.select(F.struct(*own).alias("__own"), "text"), path, rules)
    clean = F.when(F.size("spans") > 0, mask(F.struct(F.col("__own.text").alias("text"), "spans"))["text"]).otherwise(F.col("__own.text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col("__own")[c].alias(c) for c in own])


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs, path=None):
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), path)
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(kind) for kind in BASE],
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
