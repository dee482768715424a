"""Exact dedup: group by a 128-bit hash of the normalised text, compare the bytes inside each group, keep one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.common import BROADCAST_ROWS, NO_ID, doc_id, drop, keep, keyed, restrict

#: The characters that normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"
TWO64 = 2**64


def normalised():
    """The text without blanks, as a Column over keyed rows."""
    return F.translate("text", BLANKS, "")


def members(docs: DataFrame, hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, sha, norm) of the rows in groups above one: only their texts move. Their keys go to the texts by broadcast as
    long as they are few, else both sides are shuffled."""
    keys = keep(hashed.join(groups.where("group_size > 1").select("h", "sha"), ["h", "sha"]).select("did", "rid", "h", "sha").distinct(), "members")
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed(docs).join(F.broadcast(keys) if few else keys, ["did", "rid"]).select("h", "sha", normalised().alias("norm"))


def grouped(docs: DataFrame) -> DataFrame:
    """(did, rid, keep, kept, group_size, sha) of every row; see exact_dedup."""
    norm = F.encode("norm", "UTF-8")
    hashed = keyed(docs).select("did", "rid", normalised().alias("norm"), F.char_length("text").alias("n"))
    hashed = keep(hashed.select("did", "rid", F.unhex(F.md5(norm)).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"), "n"), "hashes")
    # longest original, then smallest id, in one number: the aggregation stays hash-based
    two64 = F.lit(str(TWO64)).cast("decimal(20,0)")
    low = F.when(F.col("did") == NO_ID, 0).otherwise(F.lit(str(2**63)).cast("decimal(20,0)") - F.col("did").cast("decimal(20,0)"))
    code = (F.col("n").cast("decimal(20,0)") * two64 + low.cast("decimal(20,0)")).cast("decimal(38,0)")
    rows = keep(hashed.select("did", "rid", "h", "sha", code.alias("code")).groupBy("h", "sha", "code", "did", "rid").agg(F.count("*").alias("times")), "rows")
    groups = keep(rows.groupBy("h", "sha").agg(F.max("code").alias("best"), F.sum("times").alias("group_size")), "groups")
    differing = members(docs, hashed, groups).distinct().groupBy("h", "sha").count().where("count > 1")
    if not differing.isEmpty():
        raise RuntimeError("two texts share MD5 and SHA-256")
    drop(hashed)
    first = rows.join(groups, ["h", "sha"]).where("code = best").groupBy("h", "sha").agg(F.min("rid").alias("first"))
    out = rows.join(keep(groups.join(first, ["h", "sha"]), "groups"), ["h", "sha"])
    rest = F.pmod(F.col("best"), F.lit(str(TWO64)).cast("decimal(38,0)"))
    keeper = F.when(rest == 0, F.lit(NO_ID)).otherwise((F.lit(str(2**63)).cast("decimal(20,0)") - rest).cast("long"))
    best = (F.col("code") == F.col("best")) & (F.col("rid") == F.col("first"))
    out = out.select("did", "rid", keeper.alias("keep"), best.alias("best"), "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return out.select("did", "rid", "keep", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "group_size", "sha")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they have the same characters besides blanks; of equal ones the longest original stays, then
    the smallest doc_id. Null texts count as empty, empty texts are equal to each other, a null doc_id comes last. Rows
    that repeat a doc_id are returned and counted each; of those that tie one is kept. Very long texts are hashed whole
    and extra columns are ignored; an empty table gives an empty result.

    Every text is hashed once, and only hashes are grouped, combined on the map side. Where a group has more than one
    row, the texts themselves are compared; should two differ, the run stops instead of merging them."""
    return grouped(docs).select(doc_id(), doc_id("keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup_stage(docs: DataFrame) -> DataFrame:
    """One row of each group, the kept one, with all its columns. Edges as in exact_dedup: nulls and empty texts are one
    group, an empty table stays empty, very long texts pass whole."""
    return restrict(docs, keep(grouped(docs).where("kept").select("did", "rid"), "kept"), once=True)


ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text,'') t, regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g') norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w keep_id, count(*) OVER (PARTITION BY norm) group_size, doc_id = first_value(doc_id) OVER w kept, sha256(norm) text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)"""
