"""Frozen, verifiable exports: watermarks, pages, page manifests, indexes, publication.

A release holds the rows up to watermarks taken once. A page takes rows from where the last page
ended, at most so many source rows and at most so many bytes of lines, so each page depends on all
before it. That chain is followed in parallel: in a block of rows, wherever a page may come in (its
first page_rows places), pointer doubling tells where the page that leaves the block begins in the
next one. Such maps compose, block by block and then group by group, so what the driver follows is
one bounded list; the entries found go down again, and every block cuts its own pages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.files import Tables

PAGE_ROWS, PAGE_BYTES, INDEX_REFS, BLOCK_PAGES = 500, 1 << 20, 256, 8
#: Maps that one task, or the driver, composes.
GROUP = 1024


def freeze(tables: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """Watermarks: the largest sequence number of each table, 0 where it's empty."""
    return {name: df.agg(F.coalesce(F.max(c), F.lit(0)).alias("m")).first()["m"] for name, (df, c) in tables.items()}


def up_to(rows: DataFrame, seq: str, watermark: int) -> DataFrame:
    """Rows that were there at the freeze, whatever their timestamps say."""
    return rows.where(F.col(seq) <= watermark)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rn from 1 in an order: ranges are sorted in parallel and written with their places;
    they begin where the counts of those before them end (a row a range is gathered)."""
    spark = rows.sparkSession
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = Tables(spark, "numbered").cut(at).withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    starts, n = [], 0
    for r in sorted(at.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((r["_part"], n))
        n += r["n"]
    first = spark.createDataFrame(starts, "_part long, _first long")
    return at.join(F.broadcast(first), "_part").withColumn("rn", F.col("_place") + F.col("_first") + 1).drop("_part", "_first", "_at", "_place")


def next_starts(size: np.ndarray, page_rows: int, page_bytes: int) -> np.ndarray:
    """For each row, where the page ends that begins at it; size: bytes of each row's line, 0 for one
    that isn't released."""
    if size.max(initial=0) > page_bytes:
        raise ValueError(f"a line of {size.max()} bytes doesn't fit a page of {page_bytes}")
    upto = np.cumsum(size)
    return np.minimum(np.arange(len(size)) + page_rows, np.searchsorted(upto, upto - size + page_bytes, side="right"))


def _ends(size: np.ndarray, own: int, page_rows: int, page_bytes: int) -> np.ndarray:
    """Where pages from the first page_rows places leave a block of so many own rows (others follow them
    in size), counted from its end."""
    jump = np.append(next_starts(size, page_rows, page_bytes), len(size))
    jump[own:] = np.arange(own, len(size) + 1)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return np.append(jump, np.full(max(page_rows - len(jump), 0), len(size)))[:page_rows] - own
        jump = further


def _blocks(rows: DataFrame, page_rows: int, block_pages: int) -> DataFrame:
    """rows(rn) with their block; the first rows of a block also follow the block before it."""
    size = page_rows * block_pages
    own = F.floor((F.col("rn") - 1) / size).cast("long")
    return rows.withColumn("block", F.explode(F.when((F.pmod(F.col("rn") - 1, F.lit(size)) < page_rows) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))


def _entries(maps: DataFrame, count: int, group: int) -> DataFrame:
    """maps(block, ends) of blocks 0 to count - 1 -> (block, entry): the place at which the first page
    that begins in a block begins. More maps than the driver takes are composed by groups first."""

    def walk(rows: list[tuple[int, bytes]], entry: int) -> list[tuple[int, int]]:
        out = []
        for block, ends in rows:
            out.append((block, entry))
            entry = int(np.frombuffer(ends, np.int32)[entry])
        return out

    def composed(p: pd.DataFrame) -> pd.DataFrame:
        maps = [np.frombuffer(e, np.int32) for e in p.sort_values("block")["ends"]]
        whole = maps[0]
        for m in maps[1:]:
            # places beyond the table's end stay there
            whole = m[np.minimum(whole, len(m) - 1)]
        return pd.DataFrame({"block": [p["block"].iloc[0] // group], "ends": [whole.tobytes()]})

    def down(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        return pd.DataFrame(walk(list(zip(p["block"], p["ends"], strict=True)), int(p["entry"].iloc[0])), columns=["block", "entry"])

    if count <= group:
        return maps.sparkSession.createDataFrame(walk(sorted((r["block"], bytes(r["ends"])) for r in maps.collect()), 0), "block long, entry int")
    by = F.floor(F.col("block") / group).cast("long")
    upper = _entries(maps.groupBy(by.alias("group")).applyInPandas(composed, "block long, ends binary"), -(-count // group), group)
    at = maps.withColumn("group", by).join(upper.select(F.col("block").alias("group"), "entry"), "group")
    return at.groupBy("group").applyInPandas(down, "block long, entry int")


def _cuts(size: np.ndarray, own: int, entry: int, page_rows: int, page_bytes: int) -> list[tuple[int, int]]:
    """The pages that begin in a block, as places in it."""
    after, out = next_starts(size, page_rows, page_bytes), []
    while entry < own:
        out.append((entry, int(after[entry])))
        entry = int(after[entry])
    return out


def page_plan(rows: DataFrame, tables: Tables, page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES, block_pages: int = BLOCK_PAGES, group: int = GROUP) -> DataFrame:
    """rows(rn, line, included) -> (block, entry, pages): where the first page that begins in a block does
    so, and how many pages that hold a line there are before it."""
    own = page_rows * block_pages

    def chart(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        block, size = int(p["block"].iloc[0]), p["size"].to_numpy()
        n = int(((p["rn"] - 1) // own == block).sum())
        return pd.DataFrame({"block": [block], "own": [n], "sizes": [size.astype(np.int32).tobytes()], "ends": [_ends(size, n, page_rows, page_bytes).astype(np.int32).tobytes()]})

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n = []
            for data, own_rows, entry in zip(p["sizes"], p["own"], p["entry"], strict=True):
                size = np.frombuffer(data, np.int32).astype(np.int64)
                n.append(sum(bool(size[i:j].any()) for i, j in _cuts(size, own_rows, entry, page_rows, page_bytes)))
            yield pd.DataFrame({"block": p["block"], "entry": p["entry"], "n": n})

    size = F.when(F.col("included"), F.octet_length("line") + 1).otherwise(0).cast("long")
    charts = tables.cut(_blocks(rows.select("rn", size.alias("size")), page_rows, block_pages).groupBy("block").applyInPandas(chart, "block long, own int, sizes binary, ends binary"))
    entries = _entries(charts.select("block", "ends"), charts.count(), group)
    some = tables.cut(charts.join(entries, "block").select("block", "own", "sizes", "entry").mapInPandas(filled, "block long, entry int, n long")).withColumn("group", F.floor(F.col("block") / group).cast("long"))
    starts, n = [], 0
    for r in some.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").toLocalIterator():
        starts.append((r["group"], n))
        n += r["n"]
    before = rows.sparkSession.createDataFrame(starts, "group long, before long")
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("block")) - F.col("n")
    return some.withColumn("inside", inside).join(before, "group").select("block", "entry", (F.col("before") + F.col("inside")).alias("pages"))


def page_bodies(rows: DataFrame, plan: DataFrame, page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """The pages that begin in the blocks of the plan, which may be some of a page_plan's."""
    own = page_rows * block_pages

    def cut(p: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(begun):
            p, block = p.sort_values("rn"), int(p["block"].iloc[0])
            text = [line.encode() + b"\n" if good else b"" for line, good in zip(p["line"], p["included"], strict=True)]
            rn, page = p["rn"].to_numpy(), int(begun["pages"].iloc[0])
            for i, j in _cuts(np.array([len(t) for t in text], np.int64), int(((rn - 1) // own == block).sum()), int(begun["entry"].iloc[0]), page_rows, page_bytes):
                if body := b"".join(text[i:j]):
                    page += 1
                    out.append((page, rn[i], rn[j - 1], sum(map(bool, text[i:j])), len(body), hashlib.sha256(body).hexdigest(), body.decode()))
        return pd.DataFrame(out, columns=["page", "first_rn", "last_rn", "rows", "byte_length", "sha256", "body"])

    at = _blocks(rows.select("rn", "line", "included"), page_rows, block_pages).groupBy("block")
    return at.cogroup(plan.groupBy("block")).applyInPandas(cut, "page long, first_rn long, last_rn long, rows long, byte_length long, sha256 string, body string")


def pages(rows: DataFrame, lines: str = "line", included: str = "included", page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES, block_pages: int = BLOCK_PAGES, group: int = GROUP) -> DataFrame:
    """rows(rn, line, included) -> (page, first_rn, last_rn, rows, byte_length, sha256, body), pages from 1.
    Source rows count towards a page whether included or not; a page without lines is left out, and
    a line that is longer than a page raises. A task holds a block's lines: block_pages times page_rows
    of them."""
    at = rows.select("rn", F.col(lines).alias("line"), F.col(included).alias("included"))
    plan = page_plan(at, Tables(rows.sparkSession, "pages"), page_rows, page_bytes, block_pages, group)
    return page_bodies(at, plan, page_rows, page_bytes, block_pages)


def page_numbers(rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The rows rule alone: rows(rn) with their page from 0."""
    return rows.withColumn("page", F.floor((F.col("rn") - 1) / page_rows).cast("long"))


def page_index(manifest: DataFrame, refs: int = INDEX_REFS) -> DataFrame:
    """manifest(part, ...) with part from 0 -> (index, parts, next): indexes of at most refs parts,
    filled from the last part on, each naming the one that follows it."""
    total = manifest.agg((F.max("part") + 1).alias("total"))
    at = manifest.crossJoin(F.broadcast(total)).withColumn("back", F.floor((F.col("total") - 1 - F.col("part")) / refs))
    built = at.groupBy("back").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return built.select(F.col("back").alias("index"), "parts", F.when(F.col("back") > 0, F.col("back") - 1).alias("next"))


def root_manifest(tables: DataFrame) -> DataFrame:
    """tables(name, rows, pages, index) -> one row, the manifest as JSON and its digest."""
    body = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("name", "rows", "pages", "index"))).alias("tables")), {"ignoreNullFields": "false"})
    return tables.agg(body.alias("body")).withColumn("sha256", F.sha2("body", 256))


def write_pages(manifest: DataFrame, path: str) -> None:
    """Store page bodies under their digests: writing again writes the same."""
    manifest.select(F.col("sha256").alias("id"), "rows", "byte_length", "body").write.mode("overwrite").parquet(path)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages whose bytes aren't those of their name or length: none in a good release."""
    at = spark.read.parquet(path)
    return at.where((F.sha2("body", 256) != F.col("id")) | (F.octet_length("body") != F.col("byte_length"))).select("id")


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A page's lines by its digest."""
    if not (len(part) == 64 and all(c in "0123456789abcdef" for c in part)):
        raise ValueError("a part is named by a SHA-256 digest")
    return spark.read.parquet(path).where(F.col("id") == part).select(F.explode(F.split(F.regexp_replace("body", "\n$", ""), "\n")).alias("line"))


def publishable(release: DataFrame, opinions: DataFrame) -> DataFrame:
    """Frozen members (id, revision) whose opinion has changed or gone since: publication needs none."""
    at = opinions.where("status = 'approved'").select("id", F.col("revision").alias("now"))
    return release.join(at, "id", "left").where(F.col("now").isNull() | (F.col("now") != F.col("revision"))).select("id")


def publishable_map(revisions: DataFrame, opinions: DataFrame, column: str = "opinion_revisions") -> DataFrame:
    """The same for members that are stored as a JSON object of revisions by id."""
    at = revisions.select(F.explode(F.from_json(column, "map<string,long>")).alias("id", "revision"))
    return publishable(at, opinions)


def latest(releases: DataFrame) -> DataFrame:
    """The release published last, by time then id."""
    return releases.where("status = 'released'").orderBy(F.desc("published_at"), F.desc("id")).limit(1)


def keyset_page(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next rows by a key: a filter that reaches the scan and a bounded sort."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def lines_of(rows: DataFrame, columns: list[str]) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def day_rows(rows: DataFrame, millis: str) -> DataFrame:
    return rows.withColumn("day", S.local_day(millis))

