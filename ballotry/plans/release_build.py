"""A release, built step by step: frozen once, continued after a stop, verified, published.

Each step writes under a name of its own and then commits by compare-and-set on the release's state,
so a step that dies leaves files nobody names and the next run does it again, with the same bytes.
Steps: the members (opinions released), then for each kind of rows its frozen lines with the plan of
pages, then pages in batches of blocks, then its indexes in batches, from the last page to the first,
and at the end the root manifest. A change of moderation before publication makes a release invalid.

Small batches are made many at a time (a run), by one job: the step of a run's first batch writes it, and
the state says what is ahead. The steps of the others only commit; build() commits a run at once. So jobs
go by rows, not by steps.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import release
from ..sources import files
from .state import States

KINDS = ("opinions", "responses", "presentations")
#: Names of a release's parts.
PART = re.compile(r"manifest|[di]-(opinions|responses|presentations)-[0-9]{12}")
_REF = ("part", "sha256", "row_count", "byte_length")
_PART_ROW = "part string, sha256 string, row_count long, byte_length long, body string"
#: Blocks, and index pages, that a run goes up to where a step takes fewer, and the steps it has at most.
RUN_BLOCKS, RUN_INDEXES, RUN_STEPS = 4096, 1024, 512


def _ref(part: dict | None) -> dict | None:
    """What an index or the manifest says of a part, in this order."""
    return part and {c: part[c] for c in _REF}


def _number() -> F.Column:
    """A part's number in its name."""
    return F.substring("part", -12, 12).cast("long")


def _run(step: int, most: int) -> int:
    """Steps in a run."""
    return max(1, min(RUN_STEPS, most // step))


class Conflict(Exception):
    """Another writer was first, or what the release rests on has changed."""


@dataclass(frozen=True)
class Sources:
    """Tables with a sequence number seq: opinions(id, revision, status, line), answers(opinion_id, line),
    presentations(opinion_id, ...) and the events on them. lines(marks) puts presentations together
    from what was there at the marks: (seq, opinion_id, line)."""

    opinions: DataFrame
    responses: DataFrame
    presentations: Callable[[dict], DataFrame]
    marks: Callable[[], dict]


@dataclass(frozen=True)
class Sizes:
    page_rows: int = release.PAGE_ROWS
    page_bytes: int = release.PAGE_BYTES
    block_pages: int = release.BLOCK_PAGES
    index_refs: int = release.INDEX_REFS
    #: Blocks of pages, and index pages, in a step.
    batch_blocks: int = 4096
    batch_indexes: int = 1024


class Release:
    """One release in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, sources: Sources | None = None, sizes: Sizes = Sizes()) -> None:  # noqa: B008
        self.spark, self.folder, self.sources, self.sizes = spark, folder, sources, sizes
        self.states = States(spark, f"{folder}/state")

    def prepare(self, name: str, moderation: int, created: str, reason: str = "", metadata: dict | None = None) -> dict:
        """Freeze watermarks and moderation, once: a second call gives what the first did."""
        if now := self.states.current():
            return now
        metadata = metadata or {}
        if len(json.dumps(metadata).encode()) > self.sizes.page_bytes // 2:
            raise ValueError("the metadata is too large for a manifest")
        counts = {k: {"rows": 0, "pages": 0, "index_pages": 0, "index": None} for k in KINDS}
        first = {"id": name, "status": "preparing", "phase": "members", "cursor": 0, "marks": self.sources.marks(), "moderation": moderation, "created": created, "reason": reason, "metadata": metadata, "counts": counts, "frozen": {}, "ahead": [], "wrote": None, "sha256": None}
        return self.states.swap(0, first) or self.states.current()

    def advance(self, moderation: int, expected: int | None = None, run: bool = False) -> dict:
        """One step on, or all steps that one job makes (run). expected: the number the caller thinks the
        release is at."""
        now = self.states.current()
        if now["status"] in ("released", "draft"):
            return now
        if now["status"] == "invalidated" or (now["moderation"] != moderation and self._commit(now, status="invalidated")):
            raise Conflict("moderation has changed since the release was prepared")
        if expected is not None and expected != now["number"]:
            raise Conflict(f"the release is at {now['number']}, not {expected}")
        kind, _, phase = now["phase"].partition(":")
        if kind == "members":
            return self._members(now)
        if kind == "manifest":
            return self._manifest(now)
        return self._freeze(now, kind) if phase == "freeze" else {"pages": self._pages, "index": self._index}[phase](now, kind, run)

    def build(self, moderation: int) -> dict:
        """All steps that are left."""
        while (now := self.advance(moderation, run=True))["status"] == "preparing":
            pass
        return now

    def _commit(self, now: dict, **change: object) -> dict:
        done = self.states.swap(now["number"], {**now, "wrote": None, **change})
        if done is None:
            raise Conflict("another writer is ahead")
        return done

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _wrote(self, what: str, kind: str) -> list[str]:
        return [s["wrote"]["path"] for s in self.states.history() if s["wrote"] and (s["wrote"]["what"], s["wrote"]["kind"]) == (what, kind)]

    def _members(self, now: dict) -> dict:
        rows = release.up_to(self.sources.opinions, "seq", now["marks"]["opinions"]).where("status = 'approved'").select("id", "revision")
        return self._commit(now, phase="opinions:freeze", wrote={"what": "members", "kind": "", "path": self._write(rows, "members")})

    def members(self) -> DataFrame:
        return self.spark.read.parquet(*self._wrote("members", ""))

    def _freeze(self, now: dict, kind: str) -> dict:
        """The kind's rows up to the marks, in order, each with its line and whether it is of a member."""
        if kind == "presentations":
            rows = self.sources.presentations(now["marks"])
        else:
            rows = release.up_to(getattr(self.sources, kind), "seq", now["marks"][kind])
        key = F.col("id" if kind == "opinions" else "opinion_id")
        member = self.members().select(F.col("id").alias("_member"))
        at = rows.join(member, key == F.col("_member"), "left").select("seq", "line", F.col("_member").isNotNull().alias("included"))
        numbered = self._write(release.numbered(at, ["seq"]).select("rn", "line", "included"), f"rows-{kind}")
        s = self.sizes
        plan = release.page_plan(self.spark.read.parquet(numbered), files.Tables(self.spark, "plan"), s.page_rows, s.page_bytes, s.block_pages)
        planned = self._write(plan, f"plan-{kind}")
        blocks = self.spark.read.parquet(planned).agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).first()["n"]
        frozen = {**now["frozen"], kind: {"path": numbered, "plan": planned, "blocks": blocks}}
        return self._commit(now, phase=f"{kind}:pages", cursor=0, frozen=frozen)

    def _pages(self, now: dict, kind: str, run: bool) -> dict:
        s, frozen, first, have = self.sizes, now["frozen"][kind], now["cursor"], now["counts"][kind]
        ahead, change = now["ahead"], {}
        if not ahead:
            path, ahead = self._page_run(frozen, kind, first)
            change = {"wrote": {"what": "parts", "kind": kind, "path": path}}
        steps = len(ahead) if run else 1
        added, ahead = ahead[:steps], ahead[steps:]
        counts = {**now["counts"], kind: {**have, **{n: have[n] + sum(a[n] for a in added) for n in ("rows", "pages")}}}
        until = first + steps * s.batch_blocks
        ended = until >= frozen["blocks"]
        after = KINDS.index(kind) + 1
        phase = now["phase"] if not ended else f"{KINDS[after]}:freeze" if after < len(KINDS) else f"{KINDS[0]}:index"
        cursor = until if not ended else counts[KINDS[0]]["pages"] if phase.endswith("index") else 0
        return self._commit(now, phase=phase, cursor=cursor, counts=counts, ahead=ahead, **change)

    def _page_run(self, frozen: dict, kind: str, first: int) -> tuple[str, list[dict]]:
        """The pages of the batches from a block on, written, and how many pages and rows each batch has."""
        s = self.sizes
        until = min(first + s.batch_blocks * _run(s.batch_blocks, RUN_BLOCKS), frozen["blocks"])
        some = self.spark.read.parquet(frozen["plan"]).where((F.col("block") >= first) & (F.col("block") < until))
        size = s.page_rows * s.block_pages
        rows = self.spark.read.parquet(frozen["path"]).where((F.col("rn") > first * size) & (F.col("rn") <= until * size + s.page_rows))
        parts = release.page_bodies(rows, some, s.page_rows, s.page_bytes, s.block_pages)
        step = F.floor((F.col("first_rn") - 1 - first * size) / (size * s.batch_blocks)).cast("long")
        path = self._write(parts.select(F.format_string(f"d-{kind}-%012d", "page").alias("part"), "sha256", F.col("rows").alias("row_count"), "byte_length", "body", step.alias("step")), f"parts-{kind}")
        made = {r["step"]: {"pages": r["pages"], "rows": r["rows"]} for r in self.spark.read.parquet(path).groupBy("step").agg(F.count("*").alias("pages"), F.sum("row_count").alias("rows")).collect()}
        return path, [made.get(i, {"pages": 0, "rows": 0}) for i in range(max(1, -(-(until - first) // s.batch_blocks)))]

    def parts(self, kind: str) -> DataFrame:
        """The parts of a kind (or index:kind, or manifest) that steps have committed."""
        paths, now = self._wrote("parts", kind), self.states.current()
        if not paths:
            return self.spark.createDataFrame([], _PART_ROW)
        found = self.spark.read.schema(_PART_ROW).parquet(*paths)
        if now["ahead"]:  # of the run that is being committed
            of, _, name = kind.rpartition(":")
            found = found.where(_number() <= now["counts"][name]["index_pages" if of else "pages"])
        return found

    def _index(self, now: dict, kind: str, run: bool) -> dict:
        """Index pages from the page the cursor is at, downwards."""
        s, top, have = self.sizes, now["cursor"], now["counts"][kind]
        after = KINDS.index(kind) + 1
        following = {"phase": f"{KINDS[after]}:index" if after < len(KINDS) else "manifest", "cursor": now["counts"][KINDS[after]]["pages"] if after < len(KINDS) else 0}
        if not top:
            return self._commit(now, **following)
        ahead, change = now["ahead"], {}
        if not ahead:
            path, ahead = self._index_run(now, kind)
            change = {"wrote": {"what": "parts", "kind": f"index:{kind}", "path": path}}
        steps = len(ahead) if run else 1
        added, ahead = ahead[:steps], ahead[steps:]
        counts = {**now["counts"], kind: {**have, "index_pages": have["index_pages"] + sum(a["pages"] for a in added), "index": added[-1]["last"]}}
        low = max(0, top - steps * s.index_refs * s.batch_indexes)
        change |= {"cursor": low} if low else following
        return self._commit(now, counts=counts, ahead=ahead, **change)

    def _index_run(self, now: dict, kind: str) -> tuple[str, list[dict]]:
        """The index pages of the batches from the cursor down, written, and how many each batch has, and its
        last. Each names the digest of the one built before it, so a run of them is one task's chain over
        references, not bodies."""
        s, top, have, name = self.sizes, now["cursor"], now["counts"][kind], now["id"]
        low = max(0, top - s.index_refs * s.batch_indexes * _run(s.batch_indexes, RUN_INDEXES))
        refs = self.parts(kind).where((_number() > low) & (_number() <= top)).select(_number().alias("n"), "part", "sha256", "row_count", "byte_length")

        def chain(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("n")
            if p["n"].tolist() != list(range(low + 1, top + 1)):
                raise ValueError(f"pages of {kind} are missing")
            known, out, at = p[list(_REF)].to_dict("records"), [], _ref(have["index"])
            for end in range(top, low, -s.index_refs):
                some = known[max(end - s.index_refs, low) - low : end - low]
                body = json.dumps({"schema_version": 3, "kind": "page_index", "release_id": name, "table": kind, "pages": some, "next": at}, separators=(",", ":"))
                at = {"part": f"i-{kind}-{have['index_pages'] + len(out) + 1:012}", "sha256": hashlib.sha256(body.encode()).hexdigest(), "row_count": len(some), "byte_length": len(body.encode())}
                out.append({**at, "body": body, "step": len(out) // s.batch_indexes})
            return pd.DataFrame(out)

        path = self._write(refs.groupBy().applyInPandas(chain, f"{_PART_ROW}, step long"), f"index-{kind}")
        made = self.spark.read.parquet(path).groupBy("step").agg(F.count("*").alias("pages"), F.max(F.struct(*_REF)).alias("last")).orderBy("step").collect()
        return path, [{"pages": r["pages"], "last": r["last"].asDict()} for r in made]

    def _manifest(self, now: dict) -> dict:
        tables = {k: {"rows": (c := now["counts"][k])["rows"], "pages": c["pages"], "index": _ref(c["index"])} for k in KINDS}
        root = {"schema_version": 3, "format": "jsonl-pages-v1", "release": {"id": now["id"], "prepared_at": now["created"], "cutoff": now["created"], "description": now["reason"]}, "updated_through": now["created"], **now["metadata"], "tables": tables}
        body = json.dumps(root, separators=(",", ":"))
        sha = hashlib.sha256(body.encode()).hexdigest()
        path = self._write(self.spark.createDataFrame([("manifest", sha, 1, len(body.encode()), body)], _PART_ROW), "manifest")
        return self._commit(now, status="draft", phase="done", cursor=0, sha256=sha, wrote={"what": "parts", "kind": "manifest", "path": path})

    def every_part(self) -> DataFrame:
        """All parts, the bodies with them."""
        out = self.parts("manifest")
        for kind in KINDS:
            out = out.unionByName(self.parts(kind)).unionByName(self.parts(f"index:{kind}"))
        return out

    def publish(self, opinions: DataFrame, moderation: int, published: str) -> dict:
        """Release a draft whose stored bytes are those of their digests and whose members all still
        stand as they were frozen."""
        now = self.states.current()
        if now["status"] == "released":
            return now
        if now["status"] != "draft" or now["moderation"] != moderation:
            raise Conflict("only a draft of the present moderation can be published")
        bad = self.every_part().where((F.sha2("body", 256) != F.col("sha256")) | (F.octet_length("body") != F.col("byte_length")))
        if bad.limit(1).count() or release.publishable(self.members(), opinions).limit(1).count():
            raise Conflict("stored bytes or members aren't those of the release")
        return self._commit(now, status="released", published=published)

    def read(self, part: str = "manifest") -> str:
        """A part's body by its name, of a draft or a released one."""
        if not PART.fullmatch(part):
            raise ValueError("not the name of a part")
        if self.states.current()["status"] not in ("draft", "released"):
            raise Conflict("the release isn't built")
        kind = "manifest" if part == "manifest" else part.split("-")[1] if part[0] == "d" else f"index:{part.split('-')[1]}"
        found = self.parts(kind).where(F.col("part") == part).first()
        if found is None:
            raise KeyError(part)
        if hashlib.sha256(found["body"].encode()).hexdigest() != found["sha256"] or len(found["body"].encode()) != found["byte_length"]:
            raise ValueError("stored bytes aren't those of the part")
        return found["body"]
