"""Sources and sinks: DOCX files, event feeds as CSV, job results as JSON, exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The name space of word-processing markup, and headings that open a bibliography.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
HEADINGS = ("references", "bibliography", "works cited", "reference list", "literature cited")
#: Bytes of document markup that one file may unpack to.
MOST_MARKUP = 256 << 20


def docx_blocks(content: bytes) -> Iterator[tuple[int, str, str, bool, bool]]:
    """(index, text, style, is_table, is_graphic) of the paragraphs and table cells of a DOCX file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        info = z.getinfo("word/document.xml")
        if info.file_size > MOST_MARKUP:
            raise ValueError("the document's markup is too large")
        root = ElementTree.fromstring(z.read(info))
    in_table = {p for t in root.iter(f"{WORD}tbl") for p in t.iter(f"{WORD}p")}
    for i, p in enumerate(root.iter(f"{WORD}p")):
        text = []
        for node in p.iter():
            if node.tag == f"{WORD}t":
                text.append(node.text or "")
            elif node.tag in (f"{WORD}br", f"{WORD}cr"):
                text.append("\n")
            elif node.tag == f"{WORD}tab":
                text.append("\t")
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        graphic = any(node.tag.endswith(("}drawing", "}pict")) for node in p.iter())
        yield i, "".join(text), "" if style is None else style.get(f"{WORD}val", ""), p in in_table, graphic


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, block_idx, text, style, is_table, is_graphic, error: blocks of all DOCX files of a path; a broken file gives one row with its error."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows += [(p, *b, None) for b in docx_blocks(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append((p, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "block_idx", "text", "style", "is_table", "is_graphic", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, block_idx int, text string, style string, is_table boolean, is_graphic boolean, error string")


def split_references(blocks: DataFrame, key: str = "path") -> DataFrame:
    """Blocks with part body or references: what follows the last bibliography heading of a document is its references."""
    heading = F.lower(F.trim(F.regexp_replace("text", r"^[0-9.\s]+|[:.\s]+$", ""))).isin(*HEADINGS)
    last = F.max(F.when(heading, F.col("block_idx"))).over(W.partitionBy(key))
    part = F.when(heading & (F.col("block_idx") == last), "heading").when(F.col("block_idx") > last, "references").otherwise("body")
    return blocks.withColumn("part", part)


#: Column names of the event feed.
EVENT_COLUMNS = {"OriginalPaperDOI": "link", "RetractionNature": "label", "RetractionDate": "event_date", "Record ID": "record_id", "RetractionDOI": "notice_doi"}


def read_event_feed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV feed of publication events by its column names; a byte-order mark before the first name does no harm."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return raw.select([F.col(f"`{a}`").alias(b) if a in raw.columns else F.lit(None).cast("string").alias(b) for a, b in EVENT_COLUMNS.items()])


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of jobs with their result kept as text, to be read as a variant."""
    return spark.read.text(path).select(F.get_json_object("value", "$.job_id").alias("job_id"), F.get_json_object("value", "$.status").alias("status"), F.get_json_object("value", "$.result").alias("result"))


def write_index(events: DataFrame, path: str, keys: list[str]) -> None:
    """The event index as Parquet, one row for each key."""
    events.dropDuplicates(keys).write.mode("overwrite").parquet(path)
