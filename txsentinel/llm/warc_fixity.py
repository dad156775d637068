"""Merkle fixity audit of WARC replicas (DataFrame functions only).

Pages are written as WARC response records in files of ``FILE_RECORDS`` slots
(file = id div FILE_RECORDS, slot = id mod FILE_RECORDS, the manifest that both
replicas share).  A leaf hashes one slot's records; an inner node hashes its
``2^FAN_BITS`` children together with their slots and byte lengths, so a tree
covers hashes and ordered offset ranges alike.

The audit compares the file roots of two replicas and descends only below nodes
whose hashes differ, so sound files cost one row each after their trees are
built.  What is left at the bottom are the damaged slots with their byte range
in the first replica.

Defined results: null url or html count as empty; records with a null id are
put in file -1, slot 0, several records of one slot add up to one leaf whatever
their order and number (see ``leaves``); a slot that only one replica has is ``missing`` or ``extra``;
extra columns are not read; two empty replicas give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txsentinel.session import materialize

FAN_BITS = 4
LEVELS = 3
FILE_RECORDS = 1 << (FAN_BITS * LEVELS)


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """file, slot, record (text) of every page."""
    page, url, html = (F.col(f"`{c}`") for c in (id_col, url_col, html_col))
    key = page.cast("long")
    return pages.select(
        F.coalesce(F.floor(key / F.lit(FILE_RECORDS)).cast("long"), F.lit(-1).cast("long")).alias("file"),
        F.coalesce(F.pmod(key, F.lit(FILE_RECORDS)).cast("int"), F.lit(0)).alias("slot"),
        record_text(page, url, html).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """file, slot, hash, length of every slot in use; texts are hashed before anything moves.

    A slot's record hash is the leaf.  Where records share a slot (repeated or missing ids, be they a
    third of all rows), the leaf hashes their number and the sums of the eight 32-bit words of their
    hashes: sums need no order, add up before the shuffle and take the same few bytes for any number
    of records.  Such sums tell damage from sound copies; they are not meant to withstand records
    chosen to cancel each other out."""
    hashed = records.select("file", "slot", F.sha2("record", 256).alias("h"),
                            F.octet_length("record").cast("long").alias("size"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    summed = hashed.groupBy("file", F.col("slot").alias("node")).agg(
        F.sum("size").alias("length"), F.count(F.lit(1)).alias("n"),
        *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    # the sums of one record are its words (numbers only: a hash aggregation without a sort)
    single = F.lower(F.concat(*[F.lpad(F.hex(F.col(f"w{i}").cast("long")), 8, "0") for i in range(8)]))
    many = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", *(f"w{i}" for i in range(8)))]), 256)
    return summed.select("file", "node", "length",
                         F.when(F.col("n") == 1, single).otherwise(many).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: a node hashes its children's numbers, lengths and hashes in order."""
    child = F.struct("node", "length", "hash")
    return (nodes.groupBy("file", F.shiftright("node", FAN_BITS).alias("above"))
            .agg(F.sort_array(F.collect_list(child)).alias("children"), F.sum("length").alias("total"))
            .select("file", F.col("above").alias("node"), F.col("total").alias("length"),
                    F.sha2(F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(
                        ":", c["node"].cast("string"), c["length"].cast("string"), c["hash"]))),
                        256).alias("hash")))


def merkle_levels(records: DataFrame) -> list[DataFrame]:
    """Leaves first, file roots last; each level is written once and read by the next."""
    levels = [materialize(leaves(records), "merkle-0")]
    for k in range(LEVELS):
        levels.append(materialize(parents(levels[-1]), f"merkle-{k + 1}"))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Damaged slots: file, slot, start, end (byte range in the first replica, null if only the
    second has it), status (changed, missing, extra), first_hash, second_hash."""
    ours, theirs = merkle_levels(first), merkle_levels(second)
    suspects = None
    for level in range(LEVELS, -1, -1):
        a = ours[level].select("file", "node", "length", F.col("hash").alias("first_hash"))
        b = theirs[level].select("file", "node", F.col("hash").alias("second_hash"))
        if suspects is not None:
            at = F.shiftright("node", FAN_BITS)
            above = suspects.select("file", F.col("node").alias("above"))
            a = a.withColumn("above", at).join(above, ["file", "above"], "left_semi").drop("above")
            b = b.withColumn("above", at).join(above, ["file", "above"], "left_semi").drop("above")
        differ = ~F.col("first_hash").eqNullSafe(F.col("second_hash"))
        suspects = materialize(a.join(b, ["file", "node"], "full").where(differ), f"suspects-{level}")
    # byte offsets of the damaged slots: only slots of files with damage are summed up
    in_files = ours[0].join(suspects.select("file").distinct(), "file", "left_semi")
    order = W.partitionBy("file").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = in_files.select("file", "node", "length", F.sum("length").over(order).alias("end"))
    return (suspects.drop("length").join(ends, ["file", "node"], "left")
            .select("file", F.col("node").alias("slot"), (F.col("end") - F.col("length")).alias("start"),
                    "end", F.when(F.col("first_hash").isNull(), "extra")
                    .when(F.col("second_hash").isNull(), "missing").otherwise("changed").alias("status"),
                    "first_hash", "second_hash"))
