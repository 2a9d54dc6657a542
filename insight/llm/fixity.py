"""WARC fixity audit with Merkle trees over ordered offset ranges.

Records lie in files at byte offsets; each replica is a table of record bytes by file and offset in the shared
folder, hashed from what is read there.  Every record is hashed; the records of each ``LEAF_BYTES`` of offsets
form a leaf whose hash covers their offsets and hashes in order; ``FANOUT`` neighbouring ranges form the
next node, up to one root per file.  A node covers a bounded stretch, so no group grows with the data and
each level is an aggregate of the one below, stored in the shared folder.  Two replicas are compared at the
roots, and only children of differing nodes are joined, level by level, down to the records.

Defined results: null url and html are empty; records at the same offset of a file are ordered by hash;
a file or range that one replica lacks differs; empty tables agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight.llm.storage import stage_folder, stored

LEAF_BYTES, FANOUT = 1 << 16, 16
#: Aim for the bytes of one WARC file.
FILE_BYTES = 16 << 20


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC resource record as text: headers, an empty line, the payload, two line ends."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
                    F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def place_records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``page_id`` and ``record`` with the record's ``file``, ``offset`` and ``n_bytes``.

    A page's file follows from a hash of its id and the number of files from the total size; inside a file
    records lie in order of page id, size and hash.
    """
    rows = pages.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn("n_bytes", F.octet_length("record").cast("long"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    order = Window.partitionBy("file").orderBy("page_id", "n_bytes", "sha")
    placed = rows.withColumns({"file": number % files, "sha": F.sha2("record", 256)})
    return placed.withColumn("offset", F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")).drop("sha")


def written(records: DataFrame, name: str) -> DataFrame:
    """A replica: its records' bytes with file and offset, written to the shared folder and read from there."""
    path = stage_folder(records.sparkSession, f"fixity-{name}")
    records.write.option("compression", "zstd").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)


def hashed(replica: DataFrame) -> DataFrame:
    """``file``, ``offset`` and hash ``sha`` of the bytes of every record of a replica."""
    return replica.select("file", "offset", F.sha2("record", 256).alias("sha"))


def merkle_levels(records: DataFrame, name: str) -> list[DataFrame]:
    """Stored levels of the tree: records (``file``, ``at``, ``hash``), leaves, ... up to one root per file."""
    base = records.select("file", F.col("offset").alias("at"), "sha")
    base = base.groupBy("file", "at").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ","), 256).alias("hash"))
    levels = [stored(base, f"fixity-{name}")]
    step = LEAF_BYTES
    while True:
        parent = F.expr(f"at div {step}")
        pair = F.struct("at", "hash")
        up = levels[-1].groupBy("file", parent.alias("up")).agg(F.sort_array(F.collect_list(pair)).alias("kids"))
        text = F.array_join(F.transform("kids", lambda k: F.concat(k["at"].cast("string"), F.lit(":"), k["hash"])), ",")
        levels.append(stored(up.select("file", F.col("up").alias("at"), F.sha2(text, 256).alias("hash")), f"fixity-{name}"))
        if levels[-1].where("at > 0").isEmpty():
            return levels
        step = FANOUT


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Places where the replica differs: ``file``, ``offset``, ``status`` (corrupt, missing or extra).

    Both sides: ``file``, ``offset``, ``sha``.
    """
    ours, theirs = merkle_levels(records, "ours"), merkle_levels(replica, "theirs")
    depth = max(len(ours), len(theirs))

    def raised(levels: list[DataFrame]) -> list[DataFrame]:
        """A smaller tree's root is wrapped until both have the same height."""
        out = list(levels)
        while len(out) < depth:
            wrap = F.sha2(F.concat(F.lit("0:"), F.col("hash")), 256)
            out.append(out[-1].select("file", "at", wrap.alias("hash")))
        return out

    ours, theirs = raised(ours), raised(theirs)
    differing = None
    for k in range(depth - 1, -1, -1):
        a, b = ours[k], theirs[k].withColumnRenamed("hash", "other")
        if differing is not None:
            up = F.expr(f"at div {LEAF_BYTES if k == 0 else FANOUT}")
            parents = differing.select("file", F.col("at").alias("_up"))
            a, b = (x.withColumn("_up", up).join(parents, ["file", "_up"], "left_semi").drop("_up") for x in (a, b))
        both = a.join(b, ["file", "at"], "full_outer")
        differing = stored(both.where(~F.col("hash").eqNullSafe(F.col("other"))), "fixity-differing")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("corrupt")
    return differing.select("file", F.col("at").alias("offset"), status.alias("status"))


def fixity_audit(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Audit of a replica of the WARC files of ``pages`` in which some records are damaged.

    Page ids of remainder 7 by 101 have a flipped bit in their first byte, those of remainder 11 by 211 are lost,
    and behind records of remainder 19 by 307 lies a stray one inside the record's bytes.
    """
    records = written(place_records(pages, file_bytes).select("page_id", "file", "offset", "n_bytes", "record"), "records")
    flipped = F.when(F.expr("page_id % 101 = 7"), F.concat(F.lit("w"), F.substr("record", F.lit(2)))).otherwise(F.col("record"))
    damaged = records.where(F.expr("not coalesce(page_id % 211 = 11, false)")).select("file", "offset", flipped.alias("record"))
    stray = records.where("page_id % 307 = 19").select("file", (F.col("offset") + 1).alias("offset"), F.lit("stray").alias("record"))
    found = audit(hashed(records), hashed(written(damaged.unionByName(stray), "replica")))
    owner = records.select("file", "offset", "page_id", "n_bytes")
    at = F.when(F.col("status") == "extra", F.col("offset") - 1).otherwise(F.col("offset"))
    return found.withColumn("_at", at).join(owner.withColumnRenamed("offset", "_at"), ["file", "_at"]).select(
        "page_id", "file", "offset", "n_bytes", "status")
