"""Token-id files: Simple-8b blocks with offsets, written in ascending id order and read back.

A file (suffix .s8b) is ``MGS8``, version (u32), the words of all blocks (u64), then the footer: words of
each block (u32), and for each document its id (i64), whether the id is null (u8) and its count of ids
(u64); then the counts of blocks, documents and ids (u64 each) and ``MGS8``. All numbers are little-endian.

Defined results: null text counts as empty; each document's ids end with the end id, so an empty one has
that id alone. Null ids come first; repeated ids are ordered by text. Columns beside id and text are not read.
An empty table writes no file and gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm import simple8b
from marginalia.llm.common import materialise, partitions, shared_dir
from marginalia.llm.textkernel import spare

MAGIC, VERSION = b"MGS8", 1
#: Files for each shuffle partition: so many ranges of ids are cut, each written as a file.
RANGES = 2


def file_system(uri: str):
    """The file system of a folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Writer:
    """Streams ids of documents into one file; memory holds one run of blocks and the footer."""

    RUN = 256 * simple8b.BLOCK

    def __init__(self, stream):
        self.out, self.rest, self.held = stream, [], 0
        self.blocks, self.ids, self.nulls, self.counts, self.n = [], [], [], [], 0
        stream.write(MAGIC + struct.pack("<I", VERSION))

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.ids += [0 if i is None else i for i in doc_ids]
        self.nulls += [i is None for i in doc_ids]
        self.counts.append(counts)
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.RUN:
            self._flush(self.held - self.held % simple8b.BLOCK)

    def _flush(self, n: int) -> None:
        joined = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint64)
        words, per_block = simple8b.encode(joined[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.blocks.append(per_block)
        self.rest, self.held = [joined[n:]], len(joined) - n

    def close(self) -> None:
        self._flush(self.held)
        blocks = np.concatenate(self.blocks)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        self.out.write(blocks.astype("<u4").tobytes() + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + counts.astype("<u8").tobytes())
        self.out.write(struct.pack("<QQQ", len(blocks), len(self.ids), self.n) + MAGIC)
        self.out.close()


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, its ids) of a file that can seek, decoded by runs of blocks."""
    size = source.size()
    source.seek(0)
    head = source.read(8)
    source.seek(size - 28)
    tail = source.read(28)
    if head != MAGIC + struct.pack("<I", VERSION) or tail[24:] != MAGIC:
        raise ValueError("not a token-id file of this version")
    n_blocks, n_docs, n_ids = struct.unpack("<QQQ", tail[:24])
    source.seek(size - 28 - 4 * n_blocks - 17 * n_docs)
    foot = source.read(4 * n_blocks + 17 * n_docs)
    blocks = np.frombuffer(foot, "<u4", n_blocks).astype(np.int64)
    ids = np.frombuffer(foot, "<i8", n_docs, 4 * n_blocks)
    nulls = np.frombuffer(foot, np.uint8, n_docs, 4 * n_blocks + 8 * n_docs)
    counts = np.frombuffer(foot, "<u8", n_docs, 4 * n_blocks + 9 * n_docs).astype(np.int64)
    source.seek(8)
    held, block = np.zeros(0, np.uint64), 0
    for i in range(n_docs):
        need = int(counts[i])
        parts, got = [held], len(held)
        while got < need:
            run = blocks[block : block + 256]
            parts.append(simple8b.decode(np.frombuffer(source.read(8 * int(run.sum())), "<u8")))
            got += len(parts[-1])
            block += len(run)
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if nulls[i] else int(ids[i])), held[:need]
        held = held[need:]


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """__range, __id, __text: ids cut at quantiles, one range holds neighbours only; and the number of ranges."""
    n = partitions(docs.sparkSession) * RANGES
    base = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    cuts = base.select(F.col("__id").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)
    bounds = sorted({int(c) for c in cuts})
    part = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= F.col("__id"))) if bounds else F.lit(0)
    return base.withColumn("__range", F.when(F.col("__id").isNull(), F.lit(0)).otherwise(part).cast("int")), len(bounds) + 1


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode all texts and write a file for each range of ids; returns range, path, n_docs, n_ids (materialised).

    A task writes under names of its own and only finished tasks report theirs, so repeated attempts do no harm.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/marginalia/tokens-{uuid.uuid4().hex}"

    def write(batches):
        import pyarrow as pa

        from marginalia.llm.byte_tokens import encoder

        enc, (fs, root) = encoder(tokenizer_path), file_system(folder)
        fs.create_dir(root, recursive=True)
        now, path, out, done = None, "", None, []

        def finish():
            if out is not None:
                out.close()
                done.append((now, path, len(out.ids), out.n))

        for batch in batches:
            ranges, ids, texts = batch["__range"].to_numpy(), batch["__id"].to_pylist(), batch["__text"]
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if out is None or ranges[a] != now:
                    finish()
                    now = int(ranges[a])
                    path = f"{root}/range-{now:08d}-{uuid.uuid4().hex}.s8b"
                    out = Writer(fs.open_output_stream(path))
                for low, high, tokens, bounds in enc.encode(texts.slice(a, b - a).to_pylist()):
                    counts = np.diff(bounds) + 1
                    ended = np.full(len(tokens) + high - low, end_id, np.int64)
                    keep = np.ones(len(ended), bool)
                    keep[np.cumsum(counts) - 1] = False
                    ended[keep] = tokens
                    out.add(ids[a + low : a + high], counts, ended)
        finish()
        spare()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["range", "path", "n_docs", "n_ids"])

    rows, n = _ranges(docs, id_col, text_col)
    rows = rows.repartitionById(n, "__range").sortWithinPartitions("__range", F.col("__id").asc_nulls_first(), "__text")
    return materialise(rows.mapInArrow(write, "range int, path string, n_docs bigint, n_ids bigint"), "token-files")


def read_token_files(files: DataFrame, folder_uri: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document of the files, from the files alone; one task reads each file.

    The offsets of the files are a running sum over one row for each file.
    """
    order = W.orderBy("range")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    placed = files.select("path", before.alias("start"), (F.row_number().over(order) - 1).alias("task"))

    def read(batches):
        import pyarrow as pa

        fs, _ = file_system(folder_uri)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(path) as source:
                    for doc, ids in read_file(source):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])

    return placed.repartitionById(max(files.count(), 1), "task").mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_offsets(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token-id files of docs in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, id_col, text_col), shared_dir(docs.sparkSession), id_col)
