"""Text search by line: marks of three-letter runs rule blocks of lines out before a pattern is tried on any."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..plans.query import spread

#: Lines of a block, bits of its marks, most lines of an answer, and signs of a line that is shown.
BLOCK, MARKS, LIMIT, MOST, SHOWN = 32, 4096, 50, 300, 240
#: Blocks whose maps are made at once: MARKS bytes each.
AT_ONCE = 2048


def marks_of(low: str) -> np.ndarray:
    """The mark of each run of three signs of a text in small letters: a mix of the three code points."""
    signs = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(signs) < 3:
        return np.zeros(0, np.int64)
    mixed = (signs[:-2] * np.uint32(0x9E3779B1)) ^ (signs[1:-1] * np.uint32(0x85EBCA77)) ^ (signs[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(MARKS)).astype(np.int64)


def marks(runs: Iterable[str]) -> np.ndarray:
    """Where runs of three signs are marked."""
    return np.fromiter((marks_of(r)[0] for r in runs), np.int64)


def runs_of(text: str) -> set[str]:
    low = text.lower()
    return {low[i : i + 3] for i in range(len(low) - 2)}


def block_maps(blocks: Iterable[Iterable[str]]) -> list[bytes]:
    """The map of each block of lines; runs do not go from one line to the next."""
    texts = ["\n".join(lines).lower() for lines in blocks]
    bits = np.zeros((len(texts), MARKS), np.uint8)
    for own, low in zip(bits, texts, strict=True):
        at = marks_of(low)
        ends = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) == 10
        own[at[~(ends[:-2] | ends[1:-1] | ends[2:])] if len(at) else at] = 1
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def index_lines(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, first, lines, grams): blocks of lines, each with a map of the runs of three signs that its lines have.

    ``files`` has path and text; lines end at line feeds, a null text has none, a last empty line does not
    count.  The maps take a fixed 512 bytes a block, about a quarter of its text.
    """
    text = F.regexp_replace("text", "\n$", "")
    lines = spread(files.filter("text <> ''").select("path", "text"), "path", "text").select("path", F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, "\r$", "")).alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / block).cast("int")), lambda b: F.struct((b * block + 1).alias("first"), F.slice("lines", b * block + 1, block).alias("lines")))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.iloc[at : at + AT_ONCE]
                yield part.assign(grams=block_maps(part["lines"]))

    blocks = lines.select("path", F.explode(cut).alias("b")).select("path", "b.*")
    return checkpointed(blocks.mapInPandas(marked, "path string, first int, lines array<string>, grams binary"))


def needed(pattern: str, regex: bool) -> list[str]:
    """Runs of three signs that every line with the pattern has, in small letters; none where that cannot be told.

    Of a regular expression only the text before its first sign with a meaning is sure to be there.
    """
    sure = pattern
    if regex:
        head = re.match(r"[^\\^$.|?*+()\[\]{}]*", pattern)[0]
        rest = pattern[len(head) :]
        sure = "" if "|" in pattern else head[:-1] if rest[:1] in ("?", "*", "{") else head
    return sorted(runs_of(sure))


def search_lines(index: DataFrame, patterns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(q, pattern, path, line, text, total): the first ``limit`` lines of each pattern by path and line, and how many there are.

    ``patterns`` is the stated set of questions: pattern, regex, ignore_case, and under, a folder or file to
    look in or null.  An empty pattern finds nothing; patterns shorter than three signs look at all lines.
    """
    asked = patterns.filter(F.length(F.trim("pattern")) > 0).select("pattern", "regex", "ignore_case", "under").distinct().collect()  # the stated set
    spark = patterns.sparkSession
    rows = [(n, r["pattern"], r["regex"], r["ignore_case"], r["under"]) for n, r in enumerate(asked)]
    questions = checkpointed(spark.createDataFrame(rows, "q int, pattern string, regex boolean, ignore_case boolean, under string"))
    wanted = [marks(needed(r["pattern"], r["regex"])) for r in asked]

    def able(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks that may have a question's pattern."""
        for batch in batches:
            maps = np.frombuffer(b"".join(batch["grams"]), np.uint8).reshape(len(batch), MARKS // 8)
            for q, at in enumerate(wanted):
                may = ((maps[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                if may.any():
                    yield batch[may].drop(columns="grams").assign(q=q)

    found = index.mapInPandas(able, "path string, first int, lines array<string>, q int")
    lines = found.join(F.broadcast(questions), "q").select("q", "pattern", "regex", "ignore_case", "under", "path", "first", F.posexplode("lines").alias("nth", "text"))  # the stated set
    inside = F.col("under").isNull() | (F.col("path") == F.col("under")) | F.startswith("path", F.concat(F.regexp_replace("under", "/+$", ""), F.lit("/")))
    cased = lambda c: F.when(F.col("ignore_case"), F.lower(c)).otherwise(F.col(c))
    flagged = F.when(F.col("ignore_case"), F.concat(F.lit("(?i)"), "pattern")).otherwise(F.col("pattern"))
    hits = lines.filter(inside).filter(F.when(F.col("regex"), F.regexp_like("text", flagged)).otherwise(F.contains(cased("text"), cased("pattern"))))
    hits = checkpointed(hits.select("q", "pattern", "path", (F.col("first") + F.col("nth")).alias("line"), F.when(F.length("text") > SHOWN, F.concat(F.substring("text", 1, SHOWN - 1), F.lit("…"))).otherwise(F.col("text")).alias("text")))
    place = F.row_number().over(Window.partitionBy("q").orderBy("path", "line"))
    total = hits.groupBy("q").agg(F.count("*").alias("total"))
    return hits.withColumn("place", place).filter(F.col("place") <= min(max(limit, 1), MOST)).join(total, "q").select("q", "pattern", "path", "line", "text", "total")
