"""Folders of notes and documents as tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import frontmatter, note_body, short_hash, tags, wikilinks

IGNORED = (".obsidian", ".trash", ".git", "templates", "node_modules", ".pytest_cache", "__pycache__")
SUFFIXES = ("txt", "md", "html")


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """One row per *.md under root, but for ignored folders: path, relative_path, doc_id, title, body, tags, wikilinks, frontmatter, modified.

    Bytes that are no UTF-8 are replaced. A root that is not there raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^.*" + _escaped(base) + "/+", "")
    part = F.slice(F.split("relative_path", "/"), 1, F.greatest(F.size(F.split("relative_path", "/")) - 1, F.lit(0)))
    notes = files.select("path", relative.alias("relative_path"), F.col("modificationTime").alias("modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("full_text"))
    kept = notes.where(~F.arrays_overlap(part, F.array(*[F.lit(x) for x in IGNORED])))
    text = F.col("full_text")
    return kept.select(
        "path", "relative_path", short_hash(F.col("relative_path")).alias("doc_id"), F.regexp_replace(F.substring_index("relative_path", "/", -1), r"\.md$", "").alias("title"),
        note_body(text).alias("body"), "full_text", frontmatter(text).alias("frontmatter"), tags(text).alias("tags"), wikilinks(text).alias("wikilinks"), "modified",
    )


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for html in batch["html"]:
            parser = _Text()
            parser.feed(html or "")
            parser.close()
            out.append(" ".join(parser.parts))
        yield pd.DataFrame({"id": batch["id"], "text": out})


def html_to_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text): every text node, joined by blanks, by a real parser."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(html_texts, f"id {kind}, text string")


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, doc_id, suffix, text) of the .txt, .md and .html files right in a folder; doc_id hashes the full path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    read = files.select("path", F.lower(F.substring_index("path", ".", -1)).alias("suffix"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    plain = read.where("suffix <> 'html'").select("path", "suffix", "text")
    parsed = html_to_text(read.where("suffix = 'html'"), "path", "text").select(F.col("id").alias("path"), F.lit("html").alias("suffix"), "text")
    plain_path = F.regexp_replace("path", "^file:/+", "/")
    return plain.unionByName(parsed).select("path", short_hash(plain_path).alias("doc_id"), "suffix", "text")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that can't be read has nulls."""
    return spark.read.schema(schema).json(path)
