"""Dropped files: saved web pages, web archives, and the answers of an image reader."""

from __future__ import annotations

import email
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.functions import dates, text
from marquee.operators.rules import in_window
from marquee.operators.venues import venue_or_tba

def _glob(suffixes: list[str] | tuple[str, ...]) -> str:
    return "*.{" + ",".join(s[1:] + "," + s[1:].upper() for s in suffixes) + "}"


ARCHIVES = (".mhtml",)
PAGES = tuple(s for s in config.WEB_SUFFIXES if s not in ARCHIVES)


def list_artifacts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (*config.IMAGE_SUFFIXES, *config.WEB_SUFFIXES)) -> DataFrame:
    """Files of a folder with one of the suffixes, others are not opened: origin, name, suffix, length, modified, content.

    One listing under one pattern names each path once, so no distinct (a shuffle of the contents) is needed.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffixes)).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(F.col("path").alias("origin"), name.alias("name"), text.suffix(name).alias("suffix"), "length",
                    F.col("modificationTime").alias("modified"), "content")


def _first_html_part(raw: bytes) -> str:
    for part in email.message_from_bytes(raw).walk():
        body = part.get_payload(decode=True) if part.get_content_type() == "text/html" else None
        if body:
            return body.decode("utf-8", errors="replace")
    return ""


def decode_archives(files: DataFrame) -> DataFrame:
    """(origin, html) of web archives (origin, content): the first non-empty HTML part.

    MIME decoding has no SQL form, so this is the one Python step. It is a bulk narrow job over Arrow batches;
    ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds what a worker holds.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"origin": b["origin"], "html": [_first_html_part(bytes(c)) for c in b["content"]]})

    return files.select("origin", "content").mapInPandas(decode, "origin string, html string")


def artifact_pages(web: DataFrame, archives: DataFrame, rank: int = 2) -> DataFrame:
    """Saved pages and web archives, listed apart, as input of ``pages.stage_pages``."""
    html = web.select(
        "origin", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))  # other encodings: the replacement sign, as far as they differ
    pages = html.unionByName(decode_archives(archives))
    return pages.select(F.lit("artifact").alias("kind"), "html", F.lit(None).cast("string").alias("page_venue"),
                        F.lit(config.ARTIFACTS).alias("source_name"), F.lit(rank).alias("source_rank"), "origin",
                        F.lit(0).alias("endpoint_rank"))


def response_items(body: Column) -> Column:
    """Elements of the JSON array inside a free-text answer: from the first "[" to the last "]", else the whole text."""
    t = F.trim(body)
    cut = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    doc = F.try_parse_json(F.when(cut != "", cut).otherwise(t))
    return F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array().cast("array<variant>"))


def stage_responses(responses: DataFrame, p: RunParams, rank: int = 2) -> DataFrame:
    """Listings read from images. ``responses`` is (origin, body), one answer per image.

    An item in which any of the five fields is present but not text is skipped; rows outside the window are found
    but count neither as kept nor as filtered.
    """
    fields = ["artist", "venue", "date", "time", "source_note"]
    items = responses.select("origin", F.posexplode(response_items(F.col("body"))).alias("pos", "item"))

    def field(name: str) -> Column:
        return text.squeeze_ends(F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")))

    readable = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
    for name in fields:
        v = F.try_variant_get("item", f"$.{name}", "variant")
        readable = readable & (v.isNull() | F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    rows = items.where(readable).select(
        field("artist").alias("artist"), venue_or_tba(field("venue")).alias("venue"),
        dates.parse_date_text(field("date"), p.year).alias("date"), text.blank_to_null(field("time")).alias("time"),
        text.source_label("Artifacts", field("source_note"), config.ARTIFACTS).alias("source"),
        F.lit(None).cast("string").alias("url"), F.lit(config.ARTIFACTS).alias("source_name"),
        F.lit(rank).alias("source_rank"), "origin", F.col("pos").cast("long").alias("pos"))
    rows = rows.where((F.col("artist") != "") & F.col("date").isNotNull())
    return rows.select("*", F.lit(True).alias("found"), in_window(F.col("date"), p).alias("kept"), F.lit(False).alias("filtered"))
