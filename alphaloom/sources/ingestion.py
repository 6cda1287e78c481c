"""A folder of documents as a stream into the incremental store: whole files or archives of many, text out of HTML, one row a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.sources import store

#: Elements without text of their own, elements that end a line, and references; fixed values.
SILENT = ("script", "style", "head", "noscript", "template")
BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|aside|main|form|blockquote|pre|hr|title"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))

ROWS = "path string, text string, version timestamp"


def html_text(html: Column) -> Column:
    """The text of HTML: silent elements, comments and tags go, blocks end lines, references are decoded, white space is evened; null stays null."""
    t = html
    for name in SILENT:
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}[ \t\r\n]*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n"), r"<[a-zA-Z/!?][^>]*>", "")
    for reference, text in REFERENCES:
        t = F.replace(t, F.lit(reference), F.lit(text))
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def html_text_sql(html: str) -> str:
    """The same in DuckDB SQL."""
    t = html
    for name in SILENT:
        t = rf"regexp_replace({t}, '(?is)<{name}\b[^>]*>.*?</{name}[ \t\r\n]*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?i)</?({BLOCKS})\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g')"
    for reference, text in REFERENCES:
        t = f"replace({t}, '{reference}', '{text.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


#: A line of an archive: a document's name and its whole content.
LINES = "path string, value string"


def _texts(files: DataFrame, path: Column, text: Column) -> DataFrame:
    is_html = F.lower(path).rlike(r"\.html?$") | text.rlike(r"(?i)^[ \t\r\n]*<(!doctype|html)\b")
    return files.select(path.alias("path"), F.when(is_html, html_text(text)).otherwise(text).alias("text"), F.col("_metadata.file_modification_time").alias("version"))


def documents(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, text, version) of the files below ``folder`` as a stream; files of HTML give their text."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return _texts(files, F.col("_metadata.file_path"), F.col("value"))


def archived(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """The same of the archives in ``folder``: files of JSON lines (LINES), so that the number of files grows with bytes and not with documents."""
    return _texts(spark.readStream.schema(LINES).option("maxFilesPerTrigger", per_batch).json(folder), F.col("path"), F.col("value"))


def write_archives(rows: DataFrame, folder: str) -> None:
    """Write documents (path, value) as archives, a file for each task and at most 100,000 documents."""
    rows.select("path", "value").write.option("maxRecordsPerFile", 100_000).mode("append").json(folder)


def ingest_folder(spark: SparkSession, folder: str, path: str, checkpoint: str, per_batch: int = 1000, source: Callable = documents) -> None:
    """Take all files that are new since the last run into the store at ``path``; a batch that runs again changes nothing.

    ``source``: ``documents`` or ``archived``. A document that comes again replaces its earlier text.
    """

    def take(batch: DataFrame, number: int) -> None:
        store.ingest(batch, path, str(number), "path", "version")

    source(spark, folder, per_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
