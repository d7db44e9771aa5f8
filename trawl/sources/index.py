"""A positional trigram index over a text column, kept as Parquet, with an append, seal, tombstone and merge life cycle.

Layout under the index's path: ``segments/<id>/postings`` (trigram, df, n_occ, keys, counts, occ), blocks of documents that lie together,
each sorted by trigram and key so that statistics of small pages prune a trigram lookup, and made where the documents lie, without a
shuffle or a sort of Spark's; ``segments/<id>/dictionary`` (trigram, df, n_occ);
``segments/<id>/rows`` (doc_key, text), the texts as they were sealed, sorted by key in small pages so that a search reads those of
its candidates; ``pending/<batch>``; ``tombstones/<batch>``; ``replaced/<batch>``; ``manifest/<version>.json``. Everything but the
manifest's newest version is immutable. A version is written last, under a name that only one writer can take, so readers
see a whole state before and after every step, and a job that dies leaves files that no manifest names.

Rows are visible once sealed: pending ones and tombstoned ones are not. A search sees texts as they were sealed, by probe
and by scan alike; a row whose text has changed is appended and sealed again, and then only its new text counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import trigram as T
from trawl.sources.files import Files
from trawl.sources.members import near

#: Segments above which sealing merges, and how many a merge leaves.
TARGET_SEGMENTS = 10
#: Of the layout; an index of another format isn't opened.
FORMAT = 3
#: Seconds after which a writer's lock counts as left by a dead one.
STALE_SECONDS = 3600.0
#: What ``build`` takes as options. partitions: of postings; target_segments: of seals; autovacuum_enabled: whether ``vacuum`` seals pending rows.
OPTIONS = {"partitions": int, "target_segments": int, "autovacuum_enabled": bool}
BUILDS = {"count": 0}
_DICTIONARY = "trigram int, df bigint, n_occ bigint"
_KEYS = "doc_key bigint"
_ROWS = "doc_key bigint, text string"
#: How tables are written; pages are small, since searches read few rows of them.
_PACKED = {"compression": "zstd"}
_PAGES = {**_PACKED, "parquet.block.size": str(16 << 20), "parquet.page.size": str(128 << 10), "parquet.page.row.count.limit": "500"}

Source = DataFrame | str | Callable[[], DataFrame]


class Conflict(RuntimeError):
    """Another writer published a version, or holds the lock."""


class TextIndex:
    """source: the base table, with a key that is unique and not null in indexed rows, and a text column: a path of Parquet
    files or a function, which are read anew by each seal and search, or a frame, whose files are those it began with."""

    def __init__(self, source: Source, key_col: str, text_col: str, path: str):
        self.source, self.key_col, self.text_col = source, key_col, text_col
        self.spark: SparkSession = source.sparkSession if isinstance(source, DataFrame) else SparkSession.active()
        self.files = Files(self.spark, path)

    @property
    def docs(self) -> DataFrame:
        """The base table as it is now."""
        if isinstance(self.source, str):
            return self.spark.read.parquet(self.source)
        return self.source() if callable(self.source) else self.source

    @classmethod
    def build(cls, source: Source, key_col: str, text_col: str, path: str, initial: DataFrame | None = None, options: dict | None = None) -> TextIndex:
        """Indexes ``initial`` (default: all of the base table) as one segment; null texts are accepted and have no postings."""
        options = dict(options or {})
        for name, value in options.items():
            if name not in OPTIONS or type(value) is not OPTIONS[name] or OPTIONS[name] is int and value < 1:
                raise ValueError(f"option {name}={value!r}: options are {', '.join(OPTIONS)}")
        index = cls(source, key_col, text_col, path)
        if index.files.names("manifest"):
            raise Conflict(f"{path} holds an index")
        segment = index._write_segment(initial if initial is not None else index.docs, 0, options)
        index._publish({"format": FORMAT, "version": 0, "options": options, "segments": [segment] if segment else [], "consumed": [], "tombstones": [], "replaced": []})
        BUILDS["count"] += 1
        return index

    @classmethod
    def open(cls, source: Source, key_col: str, text_col: str, path: str) -> TextIndex:
        index = cls(source, key_col, text_col, path)
        index.manifest()
        return index

    # state

    def manifest(self) -> dict:
        versions = [n for n in self.files.names("manifest") if n.endswith(".json") and not n.startswith(".")]
        if not versions:
            raise FileNotFoundError(f"no index at {self.files.root}")
        state = self.files.read_json("manifest", versions[-1])
        if state.get("format") != FORMAT:
            raise ValueError(f"the index at {self.files.root} has format {state.get('format')}, not {FORMAT}")
        return state

    def _publish(self, state: dict) -> None:
        if not self.files.create(json.dumps(state), "manifest", f"{state['version']:012d}.json"):
            raise Conflict("another writer has published; nothing of this step is visible")

    def _write_segment(self, rows: DataFrame, epoch: int, options: dict) -> dict | None:
        return self._write(rows.where(F.col(self.key_col).isNotNull()).select(F.col(self.key_col).cast("bigint").alias("doc_key"), F.col(self.text_col).alias("text")), epoch, options)

    def _write(self, rows: DataFrame, epoch: int, options: dict) -> dict | None:
        """A segment of (doc_key, text): texts are shuffled once, by ranges of keys; postings are made from them where they lie."""
        name = uuid.uuid4().hex
        rows.repartitionByRange("doc_key").sortWithinPartitions("doc_key").write.options(**_PAGES).parquet(self.files.path("segments", name, "rows"))
        sealed = self._tables(_ROWS, [("segments", name, "rows")])
        if "partitions" in options:
            sealed = sealed.repartitionByRange(options["partitions"], "doc_key")
        T.blocks(sealed, "doc_key", "text").write.options(**_PAGES).parquet(self.files.path("segments", name, "postings"))
        return self._describe(name, epoch)

    def _describe(self, name: str, epoch: int) -> dict | None:
        """Writes the dictionary of a segment whose postings and rows are there; its manifest entry, or None if it has no rows."""
        docs = self._tables(_ROWS, [("segments", name, "rows")]).count()
        if not docs:
            self.files.delete("segments", name)
            return None
        blocks = self._tables(T.BLOCKS, [("segments", name, "postings")])
        blocks.groupBy("trigram").agg(F.sum("df").alias("df"), F.sum("n_occ").alias("n_occ")).repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(self.files.path("segments", name, "dictionary"))
        n = self.spark.read.schema(_DICTIONARY).parquet(self.files.path("segments", name, "dictionary")).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        return {"id": name, "epoch": epoch, "docs": docs, "postings": int(n), "bytes": sum(b for _, b in self.files.sizes("segments", name, "postings"))}

    def _tables(self, schema: str, folders: list[tuple[str, ...]]) -> DataFrame:
        paths = [self.files.path(*f) for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, schema: str, part: str, state: dict, segments: list[dict] | None = None, shape: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
        """A part of segments, without what later segments replace. shape: makes rows that have doc_key of it."""
        by_batches: dict[tuple[str, ...], list[dict]] = {}
        for s in state["segments"] if segments is None else segments:
            by_batches.setdefault(tuple(r["batch"] for r in state["replaced"] if r["epoch"] > s["epoch"]), []).append(s)
        out = []
        for batches, own in by_batches.items():
            rows = shape(self._tables(schema, [("segments", s["id"], part) for s in own]))
            if batches:  # not an anti-join, which Spark moves below what shape has left out
                gone = self._tables(_KEYS, [("replaced", b) for b in batches]).distinct().withColumn("gone", F.lit(True))
                rows = rows.join(gone, "doc_key", "left").where("gone is null").select(*rows.columns)
            out.append(rows)
        return reduce(DataFrame.union, out) if out else shape(self._tables(schema, []))

    def postings(self, state: dict | None = None, codes: list[int] | None = None) -> DataFrame:
        """(trigram, doc_key, occ) of all trigrams or some."""
        return self._live(T.BLOCKS, "postings", state or self.manifest(), shape=lambda blocks: T.expanded(blocks if codes is None else blocks.where(F.col("trigram").isin(codes))))

    def posting_keys(self, codes: list[int], state: dict | None = None) -> DataFrame:
        """(trigram, doc_key) of some trigrams; positions aren't read."""
        return self._live(T.BLOCKS, "postings", state or self.manifest(), shape=lambda blocks: blocks.where(F.col("trigram").isin(codes)).select("trigram", F.explode("keys").alias("doc_key")))

    def dictionary(self, state: dict | None = None, segments: list[str] | None = None) -> DataFrame:
        """Replaced rows count until a merge drops them, as tombstoned ones do."""
        names = segments if segments is not None else [s["id"] for s in (state or self.manifest())["segments"]]
        return self._tables(_DICTIONARY, [("segments", n, "dictionary") for n in names])

    def rows(self, state: dict | None = None, shape: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
        """(doc_key, text) of sealed rows, tombstoned ones among them. shape: leaves rows out of the stored ones."""
        return self._live(_ROWS, "rows", state or self.manifest(), shape=shape)

    def sealed_keys(self, state: dict | None = None) -> DataFrame:
        return self.rows(state).select("doc_key")

    def tombstones(self, state: dict | None = None) -> DataFrame:
        return self._tables(_KEYS, [("tombstones", b) for b in (state or self.manifest())["tombstones"]])

    # life cycle

    def append(self, keys: DataFrame) -> None:
        """Notes keys (first column) as pending; null keys are skipped. Their rows are looked up when they are sealed."""
        self._write_pending(keys.select(F.col(keys.columns[0]).cast("bigint").alias("doc_key")).where("doc_key is not null"))

    def _write_pending(self, keys: DataFrame) -> str:
        batch = uuid.uuid4().hex
        keys.write.parquet(self.files.path("pending", batch))
        return batch

    def pending_batches(self, state: dict | None = None) -> list[str]:
        done = set((state or self.manifest())["consumed"])
        return [b for b in self.files.names("pending") if b not in done and self.files.complete("pending", b)]

    def pending(self, batches: list[str] | None = None) -> DataFrame:
        return self._tables(_KEYS, [("pending", b) for b in (self.pending_batches() if batches is None else batches)])

    def lock(self, wait: float = 0.0) -> _Lock:
        """To hold while writing. wait: seconds to try for; 0 tries once."""
        return _Lock(self.files, wait)

    def detach(self) -> list[str]:
        """The cut-off of a seal: batches complete now. Later ones wait for the next seal."""
        return self.pending_batches()

    def seal(self, batches: list[str] | None = None, target: int | None = None, wait: float = 0.0, keep_missing: bool = True) -> int:
        """Indexes the rows of the detached batches (default: all complete ones) as one segment; merges if there are more than ``target``. Returns rows sealed.

        The base table is read as it is now. A key without a row in it stays pending (keep_missing) for a later seal, which sees rows
        that arrive until then, or is dropped. A key that is pending twice is indexed once; one that is sealed with the text that
        it has now isn't indexed again, one whose text has changed is, and replaces what was sealed.
        """
        with self.lock(wait):
            return self._seal(batches, target, keep_missing)

    def _seal(self, batches: list[str] | None, target: int | None, keep_missing: bool) -> int:
        state = self.manifest()
        target = target or state["options"].get("target_segments", TARGET_SEGMENTS)
        batches = self.detach() if batches is None else [b for b in batches if b not in state["consumed"]]
        if not batches:
            return 0
        epoch, name = state["version"] + 1, uuid.uuid4().hex
        base = self.docs.select(F.col(self.key_col).cast("bigint").alias("doc_key"), F.col(self.text_col).alias("text"))

        def staged(rows: DataFrame, part: str, schema: str) -> tuple[DataFrame, int]:
            rows.write.options(**_PACKED).parquet(self.files.path("staging", name, part))
            kept = self._tables(schema, [("staging", name, part)])
            return kept, kept.count()

        # keys first, then the texts of those alone: what is shuffled depends on the rows to seal, not on the table or the index
        asked, n_asked = staged(self.pending(batches).distinct(), "asked", _KEYS)
        here, n_here = staged(asked.join(base.select("doc_key"), "doc_key", "left_semi"), "here", _KEYS)
        known, n_known = staged(here.join(self.sealed_keys(state), "doc_key", "left_semi"), "known", _KEYS) if n_here else (here, 0)
        segment, replaced = None, list(state["replaced"])
        if n_here:
            due = near(base, "doc_key", here, n_here).join(here, "doc_key").withColumn("again", F.lit(False))  # not a semi-join, which Spark moves below the bitmap's
            if n_known:
                sealed = self.rows(state, lambda t: near(t, "doc_key", known, n_known)).select("doc_key", F.struct("text").alias("was"))
                due = due.drop("again").join(sealed, "doc_key", "left").where(F.col("was").isNull() | ~F.col("was.text").eqNullSafe(F.col("text"))).select("doc_key", "text", F.col("was").isNotNull().alias("again"))
            rows, n_due = staged(due.select("doc_key", "text", "again"), "due", f"{_ROWS}, again boolean")
            segment = self._write(rows.select("doc_key", "text"), epoch, state["options"]) if n_due else None
            again = rows.where("again").select("doc_key")
            if segment and n_known and again.head(1):
                again.write.parquet(self.files.path("replaced", name))
                replaced.append({"batch": name, "epoch": epoch})
        if keep_missing and n_here < n_asked:
            missing = asked.join(base.select("doc_key"), "doc_key", "left_anti")
            if missing.head(1):  # before the state says that its batch is done, so that no failure loses a key
                self._write_pending(missing)
        self._publish({**state, "version": epoch, "segments": [*state["segments"], *([segment] if segment else [])], "consumed": [*state["consumed"], *batches], "replaced": replaced})
        self.files.delete("staging", name)
        if len(state["segments"]) + bool(segment) > target:
            self._merge(target)
        return segment["docs"] if segment else 0

    def tombstone(self, keys: DataFrame, wait: float = 0.0) -> int:
        """Hides keys (first column) from all searches from now on; null keys are skipped. Returns how many weren't hidden before."""
        with self.lock(wait):
            state = self.manifest()
            batch = uuid.uuid4().hex
            given = keys.select(F.col(keys.columns[0]).cast("bigint").alias("doc_key")).where("doc_key is not null").distinct()
            given.join(self.tombstones(state), "doc_key", "left_anti").write.parquet(self.files.path("tombstones", batch))
            n = self._tables(_KEYS, [("tombstones", batch)]).count()
            if n:
                self._publish({**state, "version": state["version"] + 1, "tombstones": [*state["tombstones"], batch]})
            return n

    def merge(self, target: int = TARGET_SEGMENTS, wait: float = 0.0) -> int:
        """Rewrites segments so that ``target`` are left at most, postings from the texts; tombstoned and replaced rows go. Returns how many there are now."""
        with self.lock(wait):
            return self._merge(target)

    def _merge(self, target: int) -> int:
        state = self.manifest()
        if len(state["segments"]) <= target:
            return len(state["segments"])
        groups: list[list[dict]] = [[] for _ in range(max(1, target))]
        for s in sorted(state["segments"], key=lambda s: (-s["bytes"], s["id"])):  # the largest first, each to the smallest group
            min(groups, key=lambda g: sum(x["bytes"] for x in g)).append(s)
        dead, out, epoch = self.tombstones(state), [], state["version"] + 1
        for group in groups:
            if len(group) <= 1:
                out += group
                continue
            live = self._live(_ROWS, "rows", state, group)
            if state["tombstones"]:  # else texts would be shuffled for a join with nothing
                live = live.join(dead, "doc_key", "left_anti")
            if merged := self._write(live.select("doc_key", "text"), epoch, state["options"]):
                out.append(merged)
        oldest = min((s["epoch"] for s in out), default=epoch)
        self._publish({**state, "version": epoch, "segments": out, "replaced": [r for r in state["replaced"] if r["epoch"] > oldest]})
        return len(out)

    def vacuum(self) -> bool:
        """Seals pending rows and removes files that no manifest names, and all versions but the newest; only while nobody reads an older one. False, and nothing is done, while another writer is at work."""
        try:
            lock = self.lock().__enter__()
        except Conflict:
            return False
        try:
            if self.manifest()["options"].get("autovacuum_enabled", True):
                self._seal(None, None, True)
            self._sweep()
        finally:
            lock.__exit__()
        return True

    def _sweep(self) -> None:
        state = self.manifest()
        done = [b for b in state["consumed"] if b in set(self.files.names("pending"))]
        kept = {"segments": {s["id"] for s in state["segments"]}, "tombstones": set(state["tombstones"]), "replaced": {r["batch"] for r in state["replaced"]}, "staging": set()}
        for folder, live in kept.items():
            for name in self.files.names(folder):
                if name not in live:
                    self.files.delete(folder, name)
        for name in done:
            self.files.delete("pending", name)
        last = state["version"] + 1  # the names of pending batches that are gone needn't be kept
        self._publish({**state, "version": last, "consumed": []})
        for name in self.files.names("manifest"):
            if name != f"{last:012d}.json":
                self.files.delete("manifest", name)

    # introspection

    def _segment(self, i: int, state: dict | None = None) -> str:
        segments = (state or self.manifest())["segments"]
        if not 1 <= i <= len(segments):
            raise IndexError(f"segment {i} of {len(segments)}")
        return segments[i - 1]["id"]

    def segment_blocks(self, i: int, trigram: int | None = None) -> DataFrame:
        """The postings of a segment as they are stored, of all trigrams or one."""
        blocks = self._tables(T.BLOCKS, [("segments", self._segment(i), "postings")])
        return blocks if trigram is None else blocks.where(F.col("trigram") == trigram)

    def segments(self) -> DataFrame:
        """(segment_idx, docs, postings, size): from 1; size: bytes of the postings' files."""
        rows = [(i, s["docs"], s["postings"], s["bytes"]) for i, s in enumerate(self.manifest()["segments"], 1)]
        return self.spark.createDataFrame(rows, "segment_idx int, docs bigint, postings bigint, size bigint")

    def segment_entries(self, i: int) -> DataFrame:
        """(trigram, df, n_occ) of a segment, in trigram order."""
        return self.dictionary(segments=[self._segment(i)]).orderBy("trigram")

    def segment_files(self, i: int) -> DataFrame:
        """(file, bytes) of a segment's postings."""
        return self.spark.createDataFrame(self.files.sizes("segments", self._segment(i), "postings"), "file string, bytes bigint")

    def postings_preview(self, i: int, trigram: int, max_docs: int) -> DataFrame:
        """(doc_key, positions_count, first_position, last_position) of the first documents, in key order; tombstones aren't applied."""
        found = T.expanded(self.segment_blocks(i, trigram))
        rows = found.select("doc_key", F.size("occ").alias("positions_count"), F.col("occ")[0]["pos"].alias("first_position"), F.element_at("occ", -1)["pos"].alias("last_position"))
        return rows.orderBy("doc_key").limit(max(0, max_docs))

    def posting_positions(self, i: int, trigram: int, key: int) -> DataFrame:
        """(position, flags) of one trigram in one document, in order; none if it isn't there; tombstones aren't applied."""
        found = T.expanded(self.segment_blocks(i, trigram).where(F.array_contains("keys", F.lit(key).cast("bigint")))).where(F.col("doc_key") == key)
        return found.select(F.inline("occ")).select(F.col("pos").cast("bigint").alias("position"), "flags")

    def storage_stats(self) -> DataFrame:
        """One row: version, segments, docs, pending rows, tombstones, files, bytes."""
        state = self.manifest()
        sizes = self._component_sizes(state)
        row = (state["version"], len(state["segments"]), sum(s["docs"] for s in state["segments"]), self.pending().count(), self.tombstones(state).count(), sum(n for n, _ in sizes.values()), sum(b for _, b in sizes.values()))
        return self.spark.createDataFrame([row], "version bigint, segments int, docs bigint, pending_rows bigint, tombstones bigint, files bigint, bytes bigint")

    def _component_sizes(self, state: dict) -> dict[str, tuple[int, int]]:
        folders = {part: [("segments", s["id"], part) for s in state["segments"]] for part in ("postings", "dictionary", "rows")}
        folders |= {"pending": [("pending", b) for b in self.pending_batches(state)], "tombstones": [("tombstones", b) for b in state["tombstones"]], "replaced": [("replaced", r["batch"]) for r in state["replaced"]]}
        out = {}
        for part, at in folders.items():
            sizes = [b for f in at for _, b in self.files.sizes(*f)]
            out[part] = (len(sizes), sum(sizes))
        return out

    def overhead(self) -> DataFrame:
        """(component, files, bytes, rows) by name; bytes sum to what the index's current state takes."""
        state = self.manifest()
        stored = lambda schema, part: self._tables(schema, [("segments", s["id"], part) for s in state["segments"]])
        tables = {"postings": stored(T.BLOCKS, "postings"), "dictionary": self.dictionary(state), "rows": stored(_ROWS, "rows"), "pending": self.pending(self.pending_batches(state)), "tombstones": self.tombstones(state), "replaced": self._tables(_KEYS, [("replaced", r["batch"]) for r in state["replaced"]])}
        rows = lambda part: int(tables[part].agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]) if part == "postings" else tables[part].count()
        return self.spark.createDataFrame([(part, n, b, rows(part)) for part, (n, b) in sorted(self._component_sizes(state).items())], "component string, files bigint, bytes bigint, rows bigint")

    def trigram_frequencies(self, codes: list[int], state: dict | None = None) -> dict[int, int]:
        """Documents that have each of a pattern's codes, summed over segments; 0 for codes of none."""
        found = self.dictionary(state).where(F.col("trigram").isin(codes)).groupBy("trigram").agg(F.sum("df").alias("df")).collect() if codes else []
        return {c: 0 for c in codes} | {r["trigram"]: int(r["df"]) for r in found}


class _Lock:
    """One writer at a time. The file says who began and when; one older than ``STALE_SECONDS`` is taken over, which loses
    nothing, since a slow writer that comes back finds its version's name taken."""

    def __init__(self, files: Files, wait: float):
        self.files, self.wait, self.owner = files, wait, uuid.uuid4().hex

    def _holder(self) -> dict | None:
        try:
            return self.files.read_json("writer.lock")
        except Exception:  # noqa: BLE001  it has just gone
            return None

    def __enter__(self) -> _Lock:
        until = time.time() + self.wait
        while not self.files.create(json.dumps({"owner": self.owner, "at": time.time()}), "writer.lock"):
            holder = self._holder()
            if holder and time.time() - holder["at"] > STALE_SECONDS:
                self.files.move_away("writer.lock")
            elif time.time() >= until:
                raise Conflict(f"{self.files.path('writer.lock')} is there: another writer is at work")
            else:
                time.sleep(0.2)
        return self

    def __exit__(self, *_) -> None:
        holder = self._holder()
        if holder and holder["owner"] == self.owner:
            self.files.delete("writer.lock")


def builds() -> int:
    """Successful builds in this process."""
    return BUILDS["count"]
