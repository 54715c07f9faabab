"""The store: endpoints that can be set, deleted, scanned and queried.

State is a compacted base, in which every path is unique, and the change log
since.  Reads take the base less the paths that the log mentions, and the log's
last word on these; Spark broadcasts the log's side while it is small, and
shuffles beyond.  Writes gather in an overlay on the driver and go to the
log in batches.  A batch's numbers are claimed by creating a file that must not
exist, so several writers of a folder never share one; readers pass over batches
that are not finished.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost import render
from waypost.errors import InvalidOperation, NotFound, WaypostError
from waypost.functions import paths as P
from waypost.functions import values as V
from waypost.operators import entity, scan
from waypost.plans import planner
from waypost.sources import log as changes

#: Writes that wait on the driver before they go to the log by themselves.
MOST_PENDING = 10_000


class EndpointStore:
    def __init__(self, spark: SparkSession, base: DataFrame | None = None, path: str | None = None, compat: bool = False):
        self.spark, self.path, self.compat = spark, path, compat
        self.base = base if base is not None else spark.createDataFrame([], V.ENDPOINT_SCHEMA)
        self.log: DataFrame | None = None
        #: Number of the last change that the base holds, and of the last one known.
        self.seq = self.last = 0
        self.pending: dict[str, tuple[Any, bool]] = {}

    @classmethod
    def in_memory(cls, spark: SparkSession, pairs: dict[str, Any] | None = None, compat: bool = False) -> EndpointStore:
        store = cls(spark, compat=compat)
        for path, value in (pairs or {}).items():
            store.set(path, value)
        return store

    @classmethod
    def from_store(cls, store: EndpointStore, compat: bool | None = None) -> EndpointStore:
        """A store on another's present state, that has its own writes from here on."""
        out = cls(store.spark, store.endpoints, compat=store.compat if compat is None else compat)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, compat: bool = False) -> EndpointStore:
        """A store kept in a folder of any file system that Spark reads."""
        store = cls(spark, path=path.rstrip("/"), compat=compat)
        store.refresh()
        return store

    def store_mut(self) -> EndpointStore:
        """The store itself, for callers that keep a read-only and a writing handle apart."""
        return self

    # files of a folder

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _is_there(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _names(self, folder: str = "") -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist; False if it does."""
        from py4j.protocol import Py4JJavaError

        fs, at = self._fs(path)
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        out.writeBytes(text)
        out.close()
        return True

    def _size_of(self, claim: int) -> int:
        """How many numbers a claim takes; its writer may be just about to say so."""
        fs, at = self._fs(f"{self.path}/claims/{claim:020d}")
        for _ in range(200):
            told = self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8")
            if told.endswith("."):
                return int(told[:-1])
            time.sleep(0.05)
        raise InvalidOperation(f"The claim of change {claim} has no size; its writer is gone: delete it")

    def _claims(self) -> tuple[list[int], list[int]]:
        """First numbers of all batches, and of those not finished."""
        names = self._names("claims")
        every = sorted(int(n) for n in names if n.isdigit())
        return every, [n for n in every if f"{n:020d}.done" not in names]

    def _claim(self, n: int) -> int:
        """The first of n numbers that no other writer gets."""
        while True:
            every, _ = self._claims()
            first = every[-1] + self._size_of(every[-1]) if every else 1
            if self._create(f"{self.path}/claims/{first:020d}", f"{n}."):
                return first

    def _bases(self) -> list[int]:
        return sorted(int(n.removeprefix("base-")) for n in self._names() if n.startswith("base-") and self._is_there(f"{self.path}/{n}/_SUCCESS"))

    def _base(self, seq: int) -> DataFrame:
        if not self._is_there(f"{self.path}/base-{seq}"):
            return self.spark.createDataFrame([], V.ENDPOINT_SCHEMA)
        return self.spark.read.schema(V.ENDPOINT_SCHEMA).parquet(f"{self.path}/base-{seq}").select(*changes.ENDPOINT)

    def _log_after(self, seq: int) -> DataFrame | None:
        """Finished batches beyond a change, at which a batch has ended."""
        if not self._is_there(f"{self.path}/log"):
            return None
        return changes.read(self.spark, f"{self.path}/log", seq, self._claims()[1])

    def refresh(self) -> None:
        """Takes notice of what other writers of the folder have added."""
        if self.path:
            self.seq = max(self._bases(), default=0)
            self.base, self.log = self._base(self.seq), self._log_after(self.seq)
            every, _ = self._claims()
            self.last = max(self.seq, every[-1] + self._size_of(every[-1]) - 1 if every else 0)

    # state

    def _stored(self) -> DataFrame:
        if self.log is None:
            return self.base
        return self._on_top(self.base, self.log)

    @staticmethod
    def _on_top(base: DataFrame, log: DataFrame) -> DataFrame:
        """A base less the paths that a log mentions, and the log's state; root takes part, so a read below a literal head prunes both."""
        return base.join(log.select("root", "path").distinct(), ["root", "path"], "left_anti").select(*changes.ENDPOINT).unionByName(changes.current(log))

    def overlaid(self, writes: dict[str, tuple[Any, bool]] | None = None) -> DataFrame:
        """All endpoints as they stand, with ``writes`` of a running query on top."""
        top = self.pending | (writes or {})
        if not top:
            return self._stored()
        rows = [self._row(p, v) for p, (v, deleted) in top.items() if not deleted]
        live = self.spark.createDataFrame(rows, V.ENDPOINT_SCHEMA)
        paths = self.spark.createDataFrame([(P.parse(p)[0], p) for p in top], "root string, path string")
        return self._stored().join(F.broadcast(paths), ["root", "path"], "left_anti").select(*changes.ENDPOINT).union(live)  # no more than MOST_PENDING paths and a query's own

    @property
    def endpoints(self) -> DataFrame:
        return self.overlaid()

    @staticmethod
    def _row(path: str, value: Any) -> tuple:
        segments = P.parse(path)
        return (segments[0], len(segments), path, list(segments), *V.to_row(value).values())

    # points

    def set(self, path: str, value: Any) -> None:
        text = P.text_of(P.checked_path(path))
        V.tag_of(value)
        self.apply({text: (value, False)})

    def get(self, path: str) -> Any:
        text = P.canonical(path)
        if text in self.pending:
            value, deleted = self.pending[text]
            if deleted:
                raise NotFound(text)
            return value
        return scan.get_value(self._stored(), text)

    def delete(self, path: str) -> None:
        self.get(path)
        self.apply({P.canonical(path): (None, True)})

    def exists(self, path: str) -> bool:
        try:
            self.get(path)
        except NotFound:
            return False
        return True

    def apply(self, writes: dict[str, tuple[Any, bool]]) -> None:
        """Takes over all writes of a query at once."""
        for path, write in writes.items():
            self.pending.pop(path, None)  # the last write of a path counts, and its order
            self.pending[path] = write
        if len(self.pending) >= MOST_PENDING:
            self.flush()

    def load(self, ep: DataFrame) -> None:
        """Adds many endpoints as one batch of the log and one change, without passing the driver; of several values of a path the one of the highest hash stays."""
        self.flush()
        self._append(lambda first: changes.as_log(ep, first), 1)

    # scans

    def list_prefix(self, prefix: str = "") -> DataFrame:
        return scan.list_prefix(self.endpoints, prefix)

    def get_prefix(self, prefix: str = "") -> DataFrame:
        return scan.get_prefix(self.endpoints, prefix)

    def query(self, pattern: str) -> DataFrame:
        return scan.query(self.endpoints, pattern, self.compat)

    def get_entity(self, path: str) -> Any:
        return entity.reconstruct(self.endpoints, path, self.compat)

    def entities(self, base: str) -> DataFrame:
        return entity.json(entity.with_entity(self.endpoints, P.parse(base)), self.compat)

    def count(self) -> int:
        return self.endpoints.count()

    def count_prefix(self, prefix: str) -> int:
        return scan.get_prefix(self.endpoints, prefix).count()

    def find_by_value(self, value: Any, pattern: str | None = None) -> DataFrame:
        return scan.find_by_value(self.endpoints, value, pattern)

    def clear(self) -> None:
        """Forgets everything; a folder's files stay and the deletions go to its log with the next flush."""
        if self.path is None:
            self.base, self.log, self.pending = self.spark.createDataFrame([], V.ENDPOINT_SCHEMA), None, {}
            return
        self.flush()
        self.refresh()
        gone = self._stored()
        self._append(lambda first: gone.withColumns({"seq": F.lit(first).cast("long"), "deleted": F.lit(True), "ts": F.current_timestamp()}).select(*[f.name for f in V.LOG_SCHEMA.fields]), 1)

    def ql(self, text: str) -> Any:
        return planner.execute(self, text)

    # the log

    def _append(self, rows_from: Callable[[int], DataFrame], n: int) -> None:
        """Adds a batch of n changes; ``rows_from`` makes its rows, given the first number."""
        if self.path:
            first = self._claim(n)
            changes.write(rows_from(first), f"{self.path}/log", first)
            self._create(f"{self.path}/claims/{first:020d}.done", "")
            self.refresh()
        else:
            rows = rows_from(self.last + 1)
            self.last += n
            self.log = rows if self.log is None else self.log.union(rows)

    def flush(self) -> None:
        """Moves waiting writes to the log; where the store has a folder, to its files."""
        if self.pending:
            now, writes = datetime.now(UTC), list(self.pending.items())
            self._append(lambda first: self.spark.createDataFrame([(*self._row(p, v), first + i, deleted, now) for i, (p, (v, deleted)) in enumerate(writes)], V.LOG_SCHEMA), len(writes))
            self.pending = {}

    def compact(self) -> None:
        """Writes the state as a new base, from which reads start; history and earlier snapshots stay readable until ``forget_before``.

        The base ends before the first batch that some writer hasn't finished.
        """
        self.flush()
        if not self.path:
            return
        self.refresh()
        _, unfinished = self._claims()
        seq = unfinished[0] - 1 if unfinished else self.last
        if self.log is None or seq <= self.seq:
            return
        state = self._on_top(self.base, self.log.where(F.col("seq") <= seq))
        state.repartitionByRange("root", "path").sortWithinPartitions("root", "path").write.mode("overwrite").partitionBy("root").parquet(f"{self.path}/base-{seq}")
        self.refresh()

    def forget_before(self, seq: int) -> None:
        """Deletes what only snapshots before change ``seq`` and older history need."""
        kept = max((b for b in self._bases() if b <= seq), default=0)
        self._create(f"{self.path}/forgotten-{kept}", "")
        for b in self._bases():
            if b < kept:
                fs, at = self._fs(f"{self.path}/base-{b}")
                fs.delete(at, True)
        for name in self._names("log"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) <= kept:
                fs, at = self._fs(f"{self.path}/log/{name}")
                fs.delete(at, True)
        self.refresh()

    def history(self, path: str, first=None, last=None) -> DataFrame:
        """All changes of a path, those before compactions included."""
        self.flush()
        log = self._log_after(-1) if self.path else self.log
        return changes.history(log if log is not None else changes.empty(self.spark), P.canonical(path), first, last)

    def snapshot(self, until_seq: int | None = None, as_of=None) -> DataFrame:
        """The state after a change or at a time: the last base not after it, and the log from there."""
        self.flush()
        if not self.path:
            return self.base if self.log is None else self._on_top(self.base, self._past(self.log, until_seq, as_of))
        log = self._log_after(-1)
        if log is None:
            return self.base
        until = self.last if until_seq is None else until_seq
        if as_of is not None:
            later = log.where(F.col("ts") > F.lit(as_of)).agg(F.min("seq")).first()[0]
            until = until if later is None else min(until, later - 1)
        forgotten = max((int(n.removeprefix("forgotten-")) for n in self._names() if n.startswith("forgotten-")), default=0)
        if until < forgotten:
            raise InvalidOperation(f"The state before change {forgotten} has been forgotten")
        at = max((b for b in self._bases() if b <= until), default=0)
        return self._on_top(self._base(at), self._past(self._log_after(at), until, as_of))

    @staticmethod
    def _past(log: DataFrame, until_seq: int | None, as_of) -> DataFrame:
        past = log if until_seq is None else log.where(F.col("seq") <= until_seq)
        return past if as_of is None else past.where(F.col("ts") <= F.lit(as_of))

    def index_stats(self) -> dict[str, int] | None:
        """Counts of the log; None for a store without a folder."""
        if not self.path:
            return None
        found = changes.stats(self.log).first().asDict() if self.log is not None else {"total_operations": 0, "total_adds": 0, "total_removes": 0}
        return found | {"pending_operations": len(self.pending)}

    # the clients' interface

    def _answer(self, act) -> dict[str, Any]:
        try:
            return {"success": True, "error": None, "data": act()}
        except WaypostError as e:
            return {"success": False, "error": f"{type(e).__name__}: {e}", "data": None}

    def api_get(self, path: str) -> dict[str, Any]:
        return self._answer(lambda: V.value_to_json(self.get(path)))

    def api_set(self, path: str, value: Any) -> dict[str, Any]:
        return self._answer(lambda: self.set(path, V.json_to_value(value)))

    def api_query(self, query: str) -> dict[str, Any]:
        def act() -> Any:
            found = self.ql(query)
            if isinstance(found, DataFrame):
                return [r["json"] if "json" in found.columns else [r["path"], V.value_to_json(V.from_row(r))] for r in self._rows(found)]
            return render.plain(found)

        return self._answer(act)

    def api_list(self, prefix: str = "") -> dict[str, Any]:
        return self._answer(lambda: [r["path"] for r in self._rows(self.list_prefix(prefix))])

    @staticmethod
    def _rows(df: DataFrame) -> Iterator:
        return df.orderBy(df.columns[0]).toLocalIterator()

    @staticmethod
    def health() -> dict[str, Any]:
        return {"success": True, "error": None, "data": "OK"}
