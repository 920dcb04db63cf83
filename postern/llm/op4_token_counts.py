"""Token counts by a count-only Viterbi over unigram vocabulary matches.

See unigram.py for the lattice, the tie rules and the chunks.  Only the best score and the piece count are carried;
no path is kept.  Defined results: null and empty texts have 0 pieces and score 0; equal texts equal counts; a text is
read in whole however long; null ids pass through; an empty table gives an empty one; columns other than doc_id and
text are not looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C, unigram


def count_tokens(docs: DataFrame, model: str = unigram.MODEL) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens, score: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = unigram.lattice(model)
        kept, chunk, count = lattice.counts.get, lattice.chunk.findall, lattice.count
        for batch in batches:
            chars, tokens, scores = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                best = [kept(c) or count(c) for c in chunk(lattice.normal(text))]
                chars.append(len(text))
                tokens.append(sum([n for _, n in best]))
                scores.append(sum([s for s, _ in best], 0.0))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_chars": pa.array(chars, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE: dict[str, str] = {}
