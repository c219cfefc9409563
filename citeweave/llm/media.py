"""Media columns: texts carried as FLAC streams, decoded into seekable PCM blocks.

``encode_media`` turns payloads into FLAC streams, ``pcm_blocks`` decodes a
media column into one row per PCM block with its sample and byte offsets, and
``read_samples`` seeks.  Every decode verifies frame CRCs and the stream's MD5
(see :mod:`citeweave.llm.flac`).  Null payloads count as empty; equal payloads
give equal streams; rows are independent, so order and repeats do not matter;
an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac
from .arrow_tools import bounded_slices, utf8_of
from .tables import read_table

UNIT = 64


def padded(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def encode_media(df: DataFrame, payload: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each payload as a FLAC stream of 8-bit mono samples."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, payload):
            raw = utf8_of(b, payload)
            media = flac.encode_streams([padded(r) for r in raw])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = dict(df.dtypes)[key]
    return df.select(key, payload).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def pcm_blocks(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per PCM block: (key, block, first_sample, n_samples, byte_offset, pcm).

    ``byte_offset`` is where the block's frame starts in its stream, so a reader
    can seek; a null stream has no blocks, a damaged one raises ``FlacError``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block", "first_sample", "n_samples", "byte_offset", "pcm"]
        for b in bounded_slices(batches, media):
            keep = [(k, m) for k, m in zip(b.column(key).to_pylist(), b.column(media).to_pylist(), strict=True) if m is not None]
            rows = []
            for (k, m), blocks in zip(keep, flac.decode_blocks([m for _, m in keep]), strict=True):
                starts = flac.read_info(m).starts
                rows += [(k, i, at, len(x), starts[i], x.astype(np.int16).tobytes()) for i, (at, x) in enumerate(blocks)]
            if rows:
                kinds = [b.schema.field(key).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, block int, first_sample long, n_samples int, byte_offset long, pcm binary"
    return df.select(key, media).mapInArrow(run, schema).withColumnRenamed("key", key)


def read_samples(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples ``first`` to ``first + count`` of a stream, decoding only the frames that hold them."""
    return flac.decode_from(stream, first, count)


def features(samples: np.ndarray) -> str:
    """Integer features of signed samples: blocks, peak, mean magnitude, energy and sign changes."""
    peak, total = int(np.abs(samples).max(initial=0)), int(np.abs(samples).sum())
    energy = int((samples * samples).sum())
    turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    n = max(1, len(samples))
    return f"blocks={-(-len(samples) // flac.BLOCK)};peak={peak};mean={total // n};energy={energy // n};turns={turns}"


def media_digest(df: DataFrame) -> DataFrame:
    """Round trip of each text through its FLAC stream, with digests of what was read back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            raw = utf8_of(b)
            media = flac.encode_streams([padded(r) for r in raw])
            pcm = flac.decode_streams(media)
            back = [(x + 128).astype(np.uint8).tobytes() for x in pcm]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                b.column("doc_id"),
                pa.array(map(len, raw), pa.int64()),
                pa.array(map(len, back), pa.int64()),
                pa.array(map(sha, back), pa.string()),
                pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()),
                pa.array(map(len, media), pa.int64()),
                pa.array(map(sha, media), pa.string()),
                pa.array(map(features, pcm), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a FLAC stream and back."""
    return media_digest(read_table(spark, sf_dir, "documents"))
