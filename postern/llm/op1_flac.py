"""Media columns: FLAC streams, PCM blocks with seekable sample offsets, features.

``store`` appends bytes 0 to each text's UTF-8 bytes up to a positive multiple of 64 and keeps the payload as an 8-bit
mono FLAC stream (byte b is the sample b - 128).  ``pcm_blocks`` decodes streams into one row for each block, with the
offset of its first sample, so that a range of samples is a filter on offsets; flac.read_samples seeks in one stream.
Decoding verifies every checksum.  ``features`` computes digests and features of the payloads from the block rows.

The query runs the three behind each other: streams and blocks go from one to the next as Arrow columns and are not
written as tables between.  Text hardly shrinks as PCM (0.92 of its bytes), so a table of the streams would hold 1.6
times what the text takes as Parquet; a caller who keeps them writes the result of ``store`` or ``pcm_blocks``.

Defined results: null and empty texts are 64 bytes 0; equal texts (and repeated rows) have equal streams; a long text's frames are coded
and decoded in groups of bounded size; null ids pass through; an empty table gives an empty one; columns other than
doc_id and text are not looked at; a damaged stream fails with what is wrong.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C, flac

UNIT = 64
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCKS = "doc_id long, block_no int, sample_offset long, n_samples int, channels int, bits int, pcm binary, n_bytes long, samples long, media_bytes long, media_sha256 string"
BLOCK_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("block_no", pa.int32()), ("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()),
    ("pcm", pa.binary()), ("n_bytes", pa.int64()), ("samples", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "text"):
            data, at = C.text_buffer(batch.column("text"))
            payloads = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                payload = np.zeros(max(UNIT, -(-(b - a) // UNIT) * UNIT), np.uint8)
                payload[: b - a] = data[a:b]
                payloads.append(payload)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "media": pa.array(flac.encode(payloads), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row for each PCM block of each stream, with the offset of its first sample; a stream's rows follow each other.

    samples, media_bytes and media_sha256 are those of the whole stream, n_bytes is the row's of media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "media"):
            medias = batch.column("media").to_pylist()
            rows = []
            for doc, n, m, blocks in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), medias, flac.decode(medias)):
                stream, offset, digest = flac.Stream(m), 0, hashlib.sha256(m).hexdigest()
                for k, x in enumerate(blocks):
                    rows.append((doc, k, offset, len(x), x.shape[1], stream.bits, flac.pcm_bytes(x, stream.bits), n, stream.samples, len(m), digest))
                    offset += len(x)
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCK_FIELDS)], schema=BLOCK_FIELDS)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, BLOCKS)


class _Payload:
    """What is gathered over the blocks of one 8-bit mono stream, from the first on."""

    def __init__(self) -> None:
        self.sha, self.tail = hashlib.sha256(), b""
        self.blocks = self.size = self.peak = self.energy = self.changes = 0
        self.sign: bool | None = None

    def add(self, pcm: bytes) -> None:
        y = np.frombuffer(pcm, np.int8).astype(np.int32)
        payload = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
        self.sha.update(payload)
        self.tail = (self.tail + payload)[-UNIT:]
        self.blocks, self.size = self.blocks + 1, self.size + len(payload)
        self.peak, self.energy = max(self.peak, int(np.abs(y).max())), self.energy + int((y * y).sum())
        sign = y >= 0
        self.changes += int(np.count_nonzero(sign[1:] != sign[:-1])) + (self.sign is not None and bool(sign[0]) != self.sign)
        self.sign = bool(sign[-1])

    def feature(self) -> str:
        """Blocks, peak, energy and sign changes of the samples."""
        return f"blocks={self.blocks};peak={self.peak};energy={self.energy};changes={self.changes}"


def features(blocks: DataFrame) -> DataFrame:
    """Digests and features of the payloads, from the rows of pcm_blocks as they come; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in FEATURES.split(",")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        now, rows = _Payload(), []
        for batch in batches:
            for doc, block, offset, size, _, _, pcm, n, samples, media_bytes, digest in zip(*[c.to_pylist() for c in batch.columns]):
                if not block:
                    now = _Payload()
                if offset != now.size:
                    raise flac.Damaged(f"a block of doc_id {doc} is missing at sample {now.size}")
                now.add(pcm)
                if offset + size == samples:
                    rows.append((doc, n, now.size, now.sha.hexdigest(), zlib.crc32(now.tail), media_bytes, digest, now.feature()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []

    return blocks.mapInArrow(run, FEATURES)


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(pcm_blocks(store(C.table(spark, sf_dir, "documents"))))


QUERIES = {"op1_flac": op1_flac}
ORACLE: dict[str, str] = {}
