"""Substring dedup on a De Bruijn graph of tokens.

Edges are the windows of 35 words, nodes the 34 words that neighbouring windows share. Buckets by smallest 16-gram keep
only windows that can repeat (windows.py); where paths under one key differ - the graph branches there - their single
windows become edges of their own. Repeated edges whose nodes have in- and out-degree 1 compact to chains through joins,
and the words at every chain's source coordinates (document, first word, length) are compared before any is removed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from arcwise.llm.common import doc_id, drop
from arcwise.llm.windows import Units, classified, compared, covered, repeated_windows, with_spans

WINDOW = 35
K = 16


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(did, rid, start, n): runs of n windows from word `start` that occur more than once in all documents."""
    u = Units(True, window, min(k, window))

    def search(seed: int) -> tuple[list[DataFrame], None]:
        found = classified(u, docs, seed)
        single = repeated_windows(u, docs, found.open, seed)
        drop(found.open)
        return [found.same, single], None

    return compared(u, docs, search)


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: did, rid, doc_id, n_words, n_removed, kept_sha256, kept_text.

    Removed is every word in a window whose words also start anywhere else, in this document or another; all windows
    are judged on the input. Words are runs of non-blanks, unchanged. Null, empty and blank texts have no words; documents
    shorter than a window lose nothing; rows that repeat id and text repeat each other's windows and are returned each;
    a null doc_id is an id like others. Very long texts are hashed in pieces that overlap by a window. Extra columns,
    whatever their names, are ignored; an empty table gives an empty result."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept_text")}
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                rows["n_words"].append(len(words))
                if spans:
                    gone = covered(spans, window, len(words)).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept = b" ".join(words)
                rows["n_removed"].append(rows["n_words"][-1] - len(words))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["kept_text"].append(kept.decode())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept_text"], pa.string())], ["did", "rid", *rows])

    out = with_spans(docs, repeated_spans(docs, window, k)).mapInArrow(run, "did long, rid long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select("did", "rid", doc_id(), "n_words", "n_removed", "kept_sha256", "kept_text")
