"""Line dedup: lines spread over many sites are boilerplate.

HyperLogLog sketches of the sites merge per line hash, first on the map side; lines whose estimate lies near the
threshold get exact distinct counts; the lines above it leave the documents. A site is a document's `source`."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.common import doc_id, keep, keyed

MIN_SITES = 5
LG_K = 10
#: Blanks that are trimmed off lines.
BLANKS = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame) -> DataFrame:
    """(did, rid, site, no, a, b): two hashes of every line that is not blank, trimmed."""
    lines = keyed(docs, F.coalesce("source", F.lit("")).alias("site")).select("did", "rid", "site", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    t = F.trim(F.col("line"), F.lit(BLANKS))
    return lines.select("did", "rid", "site", "no", t.alias("t")).where("t <> ''").select("did", "rid", "site", "no", F.xxhash64("t").alias("a"), F.hash("t").alias("b"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(a, b) of the lines on min_sites sites or more. The band that is counted exactly spans six standard errors of
    the sketch, and at least two sites, around the threshold."""
    band = max(2.0, 6 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sketch = rows.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.count("*").alias("c"))
    seen = keep(sketch.where((F.col("sites") >= min_sites - band) & (F.col("c") >= min_sites)).select("a", "b", "sites"), "spread")
    near = seen.where(F.col("sites") <= min_sites + band).select("a", "b")
    sure = seen.where(F.col("sites") > min_sites + band).select("a", "b")
    pairs = rows.join(near, ["a", "b"]).select("a", "b", "site").distinct()
    exact = pairs.groupBy("a", "b").count().where(F.col("count") >= min_sites).select("a", "b")
    return sure.unionByName(exact)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """One row per document: did, rid, doc_id, n_lines, n_removed, kept_sha256, kept_text.

    Lines end at line feeds; blanks around them don't count for equality; blank lines stay. A null source is a site of
    its own, the same as an empty one. Null and empty texts have one empty line; very long texts are split whole;
    repeated rows are returned each; a null doc_id is an id like others; extra columns are ignored; an empty table gives
    an empty result. Kept lines are joined by line feeds as they were."""
    rows = keep(line_rows(docs), "lines")
    bad = keep(boilerplate(rows, min_sites, lg_k), "boilerplate")
    hit = rows.join(bad, ["a", "b"]).groupBy("did", "rid").agg(F.collect_set("no").alias("gone"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [[], [], [], []]
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                lines, gone = text.split("\n"), set(gone or ())
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
                for c, v in zip(cols, (len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["did", "rid", "n_lines", "n_removed", "kept_sha256", "kept_text"])

    out = keyed(docs).join(hit, ["did", "rid"], "left").mapInArrow(run, "did long, rid long, n_lines long, n_removed long, kept_sha256 string, kept_text string")
    return out.select("did", "rid", doc_id(), "n_lines", "n_removed", "kept_sha256", "kept_text")


ORACLE = r"""WITH l AS (SELECT doc_id, coalesce(source,'') site, unnest(string_split(coalesce(text,''), chr(10))) line, generate_subscripts(string_split(coalesce(text,''), chr(10)),1) no FROM documents),
 t AS (SELECT *, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) t FROM l),
 bad AS (SELECT t FROM t WHERE t<>'' GROUP BY t HAVING count(DISTINCT site)>=5)
SELECT doc_id, count(*) n_lines, count(*) FILTER (t.t IN (SELECT t FROM bad)) n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (t.t NOT IN (SELECT t FROM bad)), '')) kept_sha256 FROM t GROUP BY doc_id"""
