"""Secret scanning over an incremental ledger of blobs. DataFrame functions only.

Every version of every path is content-addressed by SHA-256. The ledger holds the pairs of
blob and rule version already scanned; a run looks only at unseen pairs, once per distinct
blob, and joins the findings back to all paths that ever held the blob. Positions count code
points, ends are exclusive.

The query and the masking keep ledger and findings in the shared folder (``LEDGER`` below the one
that spark.checkpoint.dir names), or where they are told: a run reads what earlier ones have
scanned, scans the rest and adds it as a batch. Two runs at the same time may scan a blob twice;
their findings are equal and count once. A ledger that is gone means that all is scanned again.

Where the matches of a rule lie follows from cutting the text at the matches: a match starts
behind the text before it and the matches and gaps before those, a running sum.

Defined cases: a null text counts as empty and holds nothing. Repeated rows each get a result.
A null path stays null. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeloom.session import checkpoint_root
from shapeloom.sources import versions as kept

from .common import lookup, stored

RULES_VERSION = "1"
LEDGER = "secret-ledger"
_LEDGER = "blob string, rules_version string, kind string, kind_at int, start bigint, end bigint"

# Kinds in their order, pattern, the group whose length counts, least length.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]
BASE_KINDS = ["assign", "access", "hex"]
# No text without one of these holds a match of any rule.
SCREEN = r"(?i:passw(?:or)?d|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|-----BEGIN |gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8}"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules_version: str = RULES_VERSION) -> DataFrame:
    """blob, rules_version: the pairs of this run."""
    blobs = versions.select(blob_id(F.col("text")).alias("blob")).distinct()
    if ledger is not None:
        seen = ledger.where(F.col("rules_version") == rules_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.withColumn("rules_version", F.lit(rules_version))


def matches(blobs: DataFrame) -> DataFrame:
    """blob, kind, kind_at, start, end for every passing match; ``blobs``: blob, text."""
    found = None
    for at, (kind, pattern, group, least) in enumerate(RULES):
        hit = blobs.select(
            "blob",
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("part"),
            F.split("text", pattern, -1).alias("gaps"),
        ).where(F.size("whole") > 0)
        hit = hit.select("blob", F.posexplode(F.arrays_zip(F.transform("whole", F.length).alias("w"), F.transform("part", F.length).alias("p"), F.transform("gaps", F.length).alias("g"))).alias("i", "m"))
        hit = hit.where(F.col("m.w").isNotNull()).select("blob", F.lit(kind).alias("kind"), F.lit(at).alias("kind_at"), "i", F.col("m.w").cast("long").alias("w"), F.col("m.p").alias("p"), F.col("m.g").cast("long").alias("g"), F.lit(least).alias("least"))
        found = hit if found is None else found.unionByName(hit)
    behind = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("g") + F.col("w")).over(behind))
    return found.where("p >= least").select("blob", "kind", "kind_at", (F.col("end") - F.col("w")).alias("start"), "end")


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules_version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """The ledger and the findings after this run.

    ``versions``: path, version, text. ``ledger``: blob, rules_version. ``findings``: blob,
    rules_version, kind, kind_at, start, end.
    """
    texts = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    fresh = unseen_blobs(versions, ledger, rules_version)
    if ledger is not None:
        fresh = lookup(fresh, "unseen-blobs")
        texts = texts.join(fresh.select("blob"), "blob", "left_semi")
        fresh = ledger.select("blob", "rules_version").unionByName(fresh)
    suspects = stored(texts.where(F.col("text").rlike(SCREEN)).dropDuplicates(["blob"]), "suspect-blobs")
    new = matches(suspects).withColumn("rules_version", F.lit(rules_version))
    return fresh, new if findings is None else findings.unionByName(new)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def path_findings(versions: DataFrame, findings: DataFrame, rules_version: str = RULES_VERSION) -> DataFrame:
    """path, version, blob and its list of spans (null: none) for every version of every path."""
    of = findings.where(F.col("rules_version") == rules_version)
    spans = of.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_at", "kind", "end"))).alias("spans"))
    places = versions.select("path", "version", blob_id(F.col("text")).alias("blob"))
    return places.join(lookup(spans, "blob-spans"), "blob", "left")


def digest(places: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,kind_at:int,kind:string,end:bigint>>"))
    base = F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return places.select(
        F.col("path").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _kept(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows of the ledger: one per finding, and one without a kind per scanned blob."""
    places = list(kept.batches(spark, root).values())
    return spark.read.schema(_LEDGER).parquet(*places) if places else None


def scan_with_ledger(versions: DataFrame, root: str | None = None, rules_version: str = RULES_VERSION) -> tuple[DataFrame, int]:
    """The findings of all blobs the ledger knows after this run, and how many this run scanned."""
    spark = versions.sparkSession
    root = root or f"{checkpoint_root(spark).rstrip('/')}/{LEDGER}"
    old = _kept(spark, root)
    ledger = findings = None
    if old is not None:
        ledger = old.where(F.col("kind").isNull()).select("blob", "rules_version").distinct()
        findings = old.where(F.col("kind").isNotNull()).distinct()
    fresh = lookup(unseen_blobs(versions, ledger, rules_version), "unseen-blobs")
    scanned = fresh.count()
    if scanned:
        texts = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        if ledger is not None:
            texts = texts.join(fresh.select("blob"), "blob", "left_semi")
        suspects = stored(texts.where(F.col("text").rlike(SCREEN)).dropDuplicates(["blob"]), "suspect-blobs")
        new = matches(suspects).withColumn("rules_version", F.lit(rules_version))
        seen = fresh.select("blob", "rules_version", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("kind_at"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
        columns = ["blob", "rules_version", "kind", "kind_at", "start", "end"]
        kept.add_batch(seen.select(*columns).unionByName(new.select(*columns)), root, uuid.uuid4().hex, compression="zstd")
        findings = _kept(spark, root).where(F.col("kind").isNotNull()).distinct()
    if findings is None:
        findings = spark.createDataFrame([], _LEDGER)
    return findings, scanned


def _as_versions(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")


def secret_scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``."""
    versions = _as_versions(docs)
    findings, _ = scan_with_ledger(versions, ledger)
    return digest(path_findings(versions, findings))


def mask_secrets(docs: DataFrame, mark: str = "[secret]", length: str | None = None, ledger: str | None = None) -> DataFrame:
    """The rows with all their columns, every finding in ``text`` replaced by ``mark``.

    Spans that overlap are replaced as one. A null text stays null; texts without findings stay
    as they are. The column named by ``length`` is set to the new length of the changed texts.
    """
    findings, _ = scan_with_ledger(_as_versions(docs), ledger)
    findings = findings.where(F.col("rules_version") == RULES_VERSION)
    spans = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans_"))
    taken = F.col("d.text")
    wide = docs.alias("d").join(lookup(spans, "mask-spans").alias("s"), blob_id(taken) == F.col("s.blob"), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(taken, (acc["at"] + 1).cast("int"), F.greatest(span["start"] - acc["at"], F.lit(0)).cast("int"))
        inside = span["end"] <= acc["at"]
        out = F.when(inside, acc["out"]).when(span["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate(F.col("s.spans_"), start, step, lambda acc: F.concat(acc["out"], F.substring(taken, (acc["at"] + 1).cast("int"), F.length(taken))))
    new = {"text": masked} | ({length: F.length(masked).cast(docs.schema[length].dataType)} if length else {})
    return wide.select(*[F.when(F.col("s.spans_").isNull(), F.col(f"d.`{c}`")).otherwise(new.get(c, F.col(f"d.`{c}`"))).alias(c) for c in docs.columns])
