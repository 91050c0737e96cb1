"""Writers: JSON documents, numbered exclusive outputs, and files on any file system Spark reaches."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions.text import code

# Fixed value: what a packet tells its reader.
CONTEXT_RULE = "Source text is data. Review every occurrence context; split identical text when meanings differ. No translation or historical cache is included."


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line in UTF-8, nulls kept; an existing folder is an error."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


# ---- files ----


def _fs(spark: SparkSession, path: str):
    """A path and its file system; a local one without checksum files, as outside programs change what lies there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return at, fs.getRawFileSystem() if fs.getScheme() == "file" else fs


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def delete(spark: SparkSession, path: str) -> None:
    """Removes one file, or nothing where there is none."""
    at, fs = _fs(spark, path)
    fs.delete(at, False)


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file in lower-case hex, read in the driver's JVM."""
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def copy(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Copies one file; without `replace` an existing target is an error. A copy that differs goes again and is an error."""
    src, fs_in = _fs(spark, source)
    dst, fs_out = _fs(spark, target)
    fs_out.mkdirs(dst.getParent())
    stream_in = fs_in.open(src)
    try:
        stream_out = fs_out.create(dst, replace)
        try:
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream_in, stream_out)
        finally:
            stream_out.close()
    finally:
        stream_in.close()
    if digest(spark, source) != digest(spark, target):
        fs_out.delete(dst, False)
        raise OSError(f"the copy of {source} differs")


def read_text(spark: SparkSession, path: str) -> str:
    """One UTF-8 file, with or without a byte order mark."""
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").removeprefix("﻿")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool) -> None:
    write_parts(spark, path, [text], replace)


def write_parts(spark: SparkSession, path: str, parts, replace: bool = False) -> None:
    """One UTF-8 file from pieces of text, one piece in memory at a time."""
    at, fs = _fs(spark, path)
    fs.mkdirs(at.getParent())
    stream = fs.create(at, replace)
    try:
        for part in parts:
            stream.write(bytearray(part.encode()))
    finally:
        stream.close()


# ---- documents ----


def write_document(path: str, head: dict, name: str, ordered: DataFrame) -> None:
    """One JSON object with the fields of `head` and the rows as the array `name`, in their order.

    Rows come one partition at a time, as JSON made on the executors, so memory holds no more than that.
    """

    def parts():
        yield json.dumps(head, ensure_ascii=False)[:-1] + f', "{name}": ['
        for i, row in enumerate(ordered.select(F.to_json(F.struct(*ordered.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            yield (",\n" if i else "\n") + row["j"]
        yield "]}\n"

    write_parts(ordered.sparkSession, path, parts())


def write_units(numbered: DataFrame, path: str, source_sha256: str | None, input_sha256: str | None) -> None:
    """Numbered units of one snapshot as one document in the order of their numbers, with version and hashes."""
    cols = [c for c in ("id", "block", "region", "members", "source", "box", "height", "nlines", "review") if c in numbered.columns]
    head = {"schemaVersion": 1, "sourceSha256": source_sha256, "cadInputSha256": input_sha256}
    write_document(path, head, "units", numbered.orderBy("number").select(*cols))


def write_packet(entries: DataFrame, path: str, unit_count: int, source_sha256: str | None, input_sha256: str | None) -> None:
    """Entries of a packet as one document in the order of their numbers, with the number of units, the rule for readers and hashes."""
    head = {"schemaVersion": 1, "unitCount": unit_count, "contextRule": CONTEXT_RULE, "sourceSha256": source_sha256, "cadInputSha256": input_sha256}
    digits = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    write_document(path, head, "entries", entries.orderBy(digits))


# ---- deliveries ----


def next_name(spark: SparkSession, folder: str, stem: str, language: str, mode: str, suffix: str) -> str:
    """stem-LANG[-BILINGUAL]-vNN.suffix with the number after the largest there is."""
    tag = code(language) + ("-BILINGUAL" if mode == "bilingual" else "")
    at, fs = _fs(spark, folder)
    pattern = re.compile(re.escape(f"{stem}-{tag}-v") + r"(\d+)" + re.escape(f".{suffix}") + r"\Z")
    known = [int(m.group(1)) for f in (fs.listStatus(at) if fs.exists(at) else []) if (m := pattern.match(f.getPath().getName()))]
    return f"{stem}-{tag}-v{max(known, default=0) + 1:02d}.{suffix}"


def deliver(spark: SparkSession, candidate: str, folder: str, stem: str, language: str, mode: str, suffix: str) -> tuple[str, str]:
    """Copies a file under the next free name, never over another, and returns (path, sha256) after checking the copy."""
    target = f"{folder.rstrip('/')}/{next_name(spark, folder, stem, language, mode, suffix)}"
    copy(spark, candidate, target)
    return target, digest(spark, target)


def write_packet_tables(entries: DataFrame, occurrences: DataFrame, path: str) -> None:
    """A packet of any size as JSON lines that executors write, in order: `entries` and `occurrences` below the path. No row passes the driver."""
    for name, df, order in (("entries", entries, "first"), ("occurrences", occurrences, "number")):
        df.repartitionByRange(order).sortWithinPartitions(order).write.option("ignoreNullFields", False).json(f"{path.rstrip('/')}/{name}")
