"""Enforcement: check a frame against its contract, write it only if it passes, infer drafts, report events.

guard() wraps writes of any session; session.guarded_session() builds one whose analyzer refuses violating writes by itself.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.request
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, replace
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .checks import Violation, Write, columns_of, output_of, verify
from .contract import Contract, ContractError, Dataset, Field, parse
from .operators.quality import report
from .plans.analysis import facts, fingerprint
from .plans.catalyst import translate
from .sources.files import read as read_dataset

log = logging.getLogger(__name__)


class ContractViolation(Exception):
    """A write that its contract refuses; findings has why."""

    def __init__(self, findings: list[Violation]):
        self.findings = findings
        super().__init__("\n".join(f"{v.type}: {v.message}" + (f" (expected {v.expected}, is {v.actual})" if v.expected else "") for v in findings))


class CheckNotRun(Exception):
    """The check itself could not be made."""


def _contract(c) -> Contract:
    return c if isinstance(c, Contract) else parse(c)


def findings(df: DataFrame, contract, name: str, *, location: str | None = None, format: str | None = None, mode: str | None = None, partition_by=(), overwrite: str | None = None, csv: dict | None = None, catalog: dict | None = None, mutation: dict | None = None, runtime: bool = False, **options) -> list[Violation]:
    """What verify() finds for writing df as the output of that name; runtime adds the checks on rows (one pass)."""
    try:
        contract = _contract(contract)
    except ContractError as x:
        return [Violation("INVALID_CONTRACT", str(x))]
    target = next((d for d in contract.outputs if d.name == name), None)
    plan, _ = translate(df)
    where = location or (target.location if target else "")
    out = verify(Write(plan, columns_of(df.schema), where, format, mode, tuple(partition_by), overwrite, csv or {}, catalog or {}, mutation), contract, **options)
    target = target or output_of(contract, where)
    if runtime and not out and target:
        out = [Violation("RUNTIME_DATA_QUALITY_VIOLATION", f"{r.column}: {r.failed} of {r.total} rows fail {r.check}", r.column, where, r.check, ", ".join(r.examples)) for r in report(df, list(target.schema)).collect() if r.failed]
    return out


def checked(df: DataFrame, contract, name: str, **options) -> DataFrame:
    """df if it conforms, else ContractViolation."""
    if bad := findings(df, contract, name, **options):
        raise ContractViolation(bad)
    return df


def csv_reader_options(d: Dataset) -> dict[str, str]:
    """A dataset's csv layout under the names that the engine's readers and writers take."""
    return {{"delimiter": "sep"}.get(k, k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in d.csv.items()}


class Files:
    """Moves within a file system, each of which can be taken back until the end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.undo: list = []
        self.aside: list[tuple] = []

    def at(self, path):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path) if isinstance(path, str) else path
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def join(self, base, rel: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(base, rel)

    def files(self, base) -> list[str]:
        """Relative names of a folder's data files."""
        fs, p = self.at(base)
        root, it, out = p.toUri().getPath().rstrip("/"), fs.listFiles(p, True), []
        while it.hasNext():
            f = it.next().getPath().toUri().getPath()
            rel = f[f.index(root) + len(root) :].lstrip("/")
            if not any(x.startswith(("_", ".")) for x in rel.split("/")):
                out.append(rel)
        return sorted(out)

    def _rename(self, fs, source, target) -> None:
        """Some file systems say no, others raise."""
        try:
            moved = fs.rename(source, target)
        except Exception as x:
            raise CheckNotRun(f"{source} cannot be moved to {target}: {x}") from x
        if not moved:
            raise CheckNotRun(f"{source} cannot be moved to {target}")

    def put(self, source, target) -> None:
        """Move source to where nothing is."""
        fs, to = self.at(target)
        if to.getParent() is not None:
            fs.mkdirs(to.getParent())
        if fs.exists(to):
            raise CheckNotRun(f"{source} cannot be moved to {target}, which exists")
        self._rename(fs, self.at(source)[1], to)
        self.undo.append(lambda: fs.delete(to, True))

    def put_aside(self, target, aside) -> None:
        """Move what is at target out of the way, if anything is."""
        fs, at = self.at(target)
        if not fs.exists(at):
            return
        _, to = self.at(aside)
        fs.mkdirs(to.getParent())
        self._rename(fs, at, to)
        self.undo.append(lambda: fs.rename(to, at))
        self.aside.append((fs, to))

    def roll_back(self) -> None:
        for step in reversed(self.undo):
            step()

    def finish(self) -> None:
        for fs, p in self.aside:
            fs.delete(p, True)


@dataclass(frozen=True)
class Staged:
    output: Dataset
    location: str
    stage: str
    mode: str
    dynamic: bool
    rows: int
    seconds: float


class Run:
    """One job under a contract: reads by name, staged writes, published all or none when the block ends without an error."""

    def __init__(self, spark: SparkSession, contract, *, name: str | None = None, sinks=(), **options):
        self.spark, self.contract, self.options, self.sinks = spark, _contract(contract), options, sinks
        self.name = name or self.contract.id
        self.staged: list[Staged] = []
        self.written: set[str] = set()

    def __enter__(self):
        return self

    def read(self, name: str, as_: str = "spark", *, location: str | None = None, format: str | None = None, csv: dict | None = None):
        """The declared input, with only its declared columns: a Spark frame, or as_ pandas or arrow (on the driver)."""
        d = next((d for d in self.contract.inputs if d.name == name), None)
        if d is None:
            raise CheckNotRun(f"no input {name}")
        df = read_dataset(self.spark, replace(d, location=location or d.location, format=format or d.format, csv=csv or d.csv))
        if as_ not in ("spark", "pandas", "arrow"):
            raise CheckNotRun(f"no such kind of frame: {as_}")
        return df if as_ == "spark" else df.toPandas() if as_ == "pandas" else df.toArrow()

    def chunks(self, name: str, rows: int, **how):
        """The declared input as pandas frames of so many rows at most, one partition on the driver at a time."""
        import pandas as pd

        df, part = self.read(name, **how), []
        for r in df.toLocalIterator():
            part.append(tuple(r))
            if len(part) == rows:
                yield pd.DataFrame(part, columns=df.columns)
                part = []
        if part:
            yield pd.DataFrame(part, columns=df.columns)

    def check(self, df: DataFrame, name: str, **how) -> list[Violation]:
        return findings(df, self.contract, name, **{**self.options, **how})

    def write(self, df: DataFrame, name: str, *, location: str | None = None, format: str | None = None, mode: str | None = None, partition_by=None, overwrite: str | None = None, csv: dict | None = None):
        """Check, then write beside the target; the block's end moves it into place. What is not given is as declared."""
        d = next((d for d in self.contract.outputs if d.name == name), None)
        if d is None:
            raise ContractViolation([Violation("OUTPUT_LOCATION_MISMATCH", f"no output {name}")])
        where, format, mode = location or d.location, format or d.format or "parquet", mode or d.save_mode or "error"
        keys = tuple(d.partition_keys if partition_by is None else partition_by)
        layout = csv if csv is not None else d.csv
        overwrite = (overwrite or d.overwrite or "static") if keys and mode == "overwrite" else None
        bad = self.check(df, name, location=where, format=format, mode=mode, partition_by=keys, overwrite=overwrite, csv=layout)
        self._tell("CONTRACT_VALIDATION", name, bad, df)
        if bad:
            raise ContractViolation(bad)
        stage = f"{where.rstrip('/')}__staged_{time.time_ns()}"
        counted, began = Observation(), time.time()
        w = df.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(format).options(**csv_reader_options(replace(d, csv=layout)))
        (w.partitionBy(*keys) if keys else w).save(stage)
        self.staged.append(Staged(d, where, stage, mode, overwrite == "dynamic", counted.get["rows"], time.time() - began))
        self.written.add(name)

    def _tell(self, kind: str, name: str, bad: list[Violation], df: DataFrame | None = None, **more):
        event = {"type": kind, "job": self.name, "contract": self.contract.id, "version": self.contract.version, "output": name}
        event |= {"status": "FAILED" if bad else "PASSED", "violations": [asdict(v) for v in bad]} | more
        if df is not None and self.options.get("computeFingerprint"):
            event["fingerprint"] = fingerprint(translate(df)[0]).overall
        for s in self.sinks:
            s(event)

    def __exit__(self, kind, error, trace):
        missing = [d for d in self.contract.outputs if d.name not in self.written]
        files = Files(self.spark)
        try:
            if kind is None and missing and self.options.get("failOnMissingOutput", True):
                raise ContractViolation([Violation("MISSING_OUTPUT", f"{d.name} was never written", None, d.location) for d in missing])
            if kind is None:
                self._publish(files)
        finally:
            for x in self.staged:
                fs, p = files.at(x.stage)
                fs.delete(p, True)
        return False

    def _publish(self, files: Files):
        """Move all staged outputs into place; on any failure everything is as it was."""
        sizes = {}
        for x in self.staged:
            fs, p = files.at(x.location)
            if x.mode == "error" and fs.exists(p):
                raise CheckNotRun(f"{x.location} exists")
            names = files.files(x.stage)
            sizes[x.stage] = {"rows": x.rows, "files": len(names), "bytes": files.at(x.stage)[0].getContentSummary(files.at(x.stage)[1]).getLength(), "seconds": round(x.seconds, 3)}
        try:
            for x in self.staged:
                self._place(files, x)
        except Exception:
            files.roll_back()
            raise
        files.finish()
        for x in self.staged:
            self._tell("WRITE", x.output.name, [], **sizes[x.stage])

    def _place(self, files: Files, x: Staged):
        fs, target = files.at(x.location)
        there, old = fs.exists(target), f"{x.location.rstrip('/')}__old_{time.time_ns()}"
        if there and x.mode == "ignore":
            return
        if there and x.mode == "append":  # file by file, under names that no other write gives
            for rel in files.files(x.stage):
                files.put(files.join(files.at(x.stage)[1], rel), files.join(target, rel))
        elif there and x.dynamic:  # only the partitions that have new data are replaced
            for part in sorted({rel.rpartition("/")[0] for rel in files.files(x.stage)}):
                files.put_aside(files.join(target, part), f"{old}/{part}")
                files.put(files.join(files.at(x.stage)[1], part), files.join(target, part))
            files.aside.append((fs, files.at(old)[1]))
        else:
            files.put_aside(target, old)
            files.put(x.stage, target)


def job(contract, spark: SparkSession | None = None, *, name: str | None = None, **options):
    """Decorator: the function gets the run as its first argument."""

    def wrap(f):
        @wraps(f)
        def call(*args, **kwargs):
            with Run(spark or SparkSession.active(), contract, name=name or f.__name__, **options) as run:
                return f(run, *args, **kwargs)

        return call

    return wrap


def reads(**inputs: str):
    """Decorator for a function whose first argument is a run: each keyword gets the named input."""

    def wrap(f):
        @wraps(f)
        def call(run: Run, *args, **kwargs):
            return f(run, *args, **{k: run.read(n) for k, n in inputs.items()}, **kwargs)

        return call

    return wrap


def writes(output: str, **how):
    """Decorator for a function whose first argument is a run: the frame that it returns is written as the named output."""

    def wrap(f):
        @wraps(f)
        def call(run: Run, *args, **kwargs):
            df = f(run, *args, **kwargs)
            run.write(df, output, **how)
            return df

        return call

    return wrap


def file_sink(path: str):
    """Events as JSON lines."""

    def put(event: dict):
        with open(path, "a") as f:
            f.write(json.dumps(event) + "\n")

    return put


def log_sink(logger=None):
    """Events as log records: failures as errors."""
    logger = logger or logging.getLogger("contractlens")
    return lambda event: logger.log(logging.ERROR if event.get("status") == "FAILED" else logging.INFO, json.dumps(event))


def shared_sink(spark: SparkSession, folder: str):
    """Each event as a JSON file of its own in a folder of any file system that the session reaches."""

    def put(event: dict):
        files = Files(spark)
        fs, p = files.at(f"{folder.rstrip('/')}/event-{time.time_ns()}-{uuid.uuid4().hex}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(event).encode()))
        out.close()

    return put


def http_sink(url: str, token: str | None = None, *, times: int = 3, wait: float = 0.1, dead_letter=None, timeout: float = 10):
    """Events by POST. What cannot be delivered after some tries goes to the dead-letter sink; it never stops a job."""

    def send(event: dict):
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(event).encode(), head, method="POST"), timeout=timeout):
            pass

    tried = retrying(send, times, wait)

    def put(event: dict):
        try:
            tried(event)
        except Exception as x:
            log.warning("event not delivered to %s: %s", url, x)
            if dead_letter:
                dead_letter(event | {"undelivered": str(x)})

    return put


class Summary:
    """A sink that counts: events by type and status, findings by type; .event() has the job's totals."""

    def __init__(self):
        self.events: Counter = Counter()
        self.findings: Counter = Counter()
        self.rows = 0

    def __call__(self, event: dict):
        self.events[event["type"], event.get("status")] += 1
        self.findings.update(v["type"] for v in event.get("violations", ()))
        self.rows += event.get("rows", 0)

    def event(self) -> dict:
        failed = sum(n for (_, status), n in self.events.items() if status == "FAILED")
        return {"type": "SUMMARY", "status": "FAILED" if failed else "PASSED", "events": sum(self.events.values()), "failed": failed, "findings": dict(self.findings), "rows": self.rows}


def fan_out(*sinks):
    return lambda event: [s(event) for s in sinks] and None


def failures_only(sink):
    return lambda event: sink(event) if event["status"] == "FAILED" else None


def retrying(sink, times: int = 3, wait: float = 0.1):
    def put(event: dict):
        for k in range(times):
            try:
                return sink(event)
            except Exception:
                if k == times - 1:
                    raise
                time.sleep(wait * 2**k)

    return put


def guard(df: DataFrame, contract, name: str, location: str, *, format: str = "parquet", mode: str = "error", partition_by=(), runtime: bool = False, **options) -> None:
    """Check the write, row checks included where asked for, and only then make it."""
    checked(df, contract, name, location=location, format=format, mode=mode, partition_by=partition_by, runtime=runtime, **options)
    w = df.write.format(format).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(location)


def guarded_batches(contract, name: str, location: str, *, format: str = "parquet", mode: str = "append", partition_by=(), stream: str | None = None, **options):
    """For writeStream.foreachBatch: each micro-batch is checked as its own write before it is made.

    An appended batch is written once however often it is replayed: before its files are moved into place their names are noted under
    its id, and what a replay finds noted is removed first. Streams that share a location need different names (stream).
    """
    options.setdefault("runtime", True)
    stream = stream or name

    def put(df: DataFrame, batch: int) -> None:
        df.persist()  # checked and written from one computation
        try:
            if mode != "append":
                guard(df, contract, name, location, format=format, mode=mode, partition_by=partition_by, **options)
                return
            checked(df, contract, name, location=location, format=format, mode=mode, partition_by=partition_by, **options)
            _append_once(df, location, f"{stream}-{batch:012d}", f"{stream}-{batch - 2:012d}", format, partition_by)
        finally:
            df.unpersist()

    return put


def _append_once(df: DataFrame, location: str, key: str, settled: str, format: str, partition_by) -> None:
    files = Files(df.sparkSession)
    base, stage = location.rstrip("/"), f"{location.rstrip('/')}__staged_{key}"
    w = df.write.format(format).mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).save(stage)
    fs, note = files.at(f"{base}/_batches/{key}")
    if fs.exists(note):
        for rel in json.loads(_text(df.sparkSession, fs, note)):
            fs.delete(files.at(f"{base}/{rel}")[1], False)
    names = files.files(stage)
    out = fs.create(note, True)
    out.write(bytearray(json.dumps(names).encode()))
    out.close()
    for rel in names:
        files.put(files.join(files.at(stage)[1], rel), files.at(f"{base}/{rel}")[1])
    fs.delete(files.at(stage)[1], True)
    fs.delete(files.at(f"{base}/_batches/{settled}")[1], False)  # only the latest batch can be replayed


def _text(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def draft_of(w: Write, id: str = "draft") -> Contract:
    """A draft contract from an observed write: what it reads and the columns that it would write."""
    from pyspark.sql.types import StructType

    def fields(cols, keys=()):
        place = {k: i + 1 for i, k in enumerate(keys)}
        return tuple(Field(n, t, True, nullable, partitioned=n in place, position=place.get(n)) for n, t, nullable, *_ in cols)

    reads: dict = {}
    for p in facts(w.plan)["read"]:
        reads.setdefault(dataset_root(p.info["location"]), p)
    name = lambda loc: loc.rstrip("/").rpartition("/")[2].partition(".")[0]
    taken: dict[str, int] = {}

    def unique(loc):
        n = name(loc)
        taken[n] = taken.get(n, 0) + 1
        return n if taken[n] == 1 else f"{n}_{taken[n]}"

    inputs = tuple(Dataset(unique(loc), loc, p.info.get("format"), fields(columns_of(StructType.fromJson(json.loads(p.info["schema"]))))) for loc, p in reads.items())
    output = Dataset(name(w.location), w.location, w.format, fields(w.schema, w.partition_by or ()), w.mode, overwrite=w.overwrite)
    draft = Contract(id, "1.0.0", "draft", inputs, (output,))
    if bad := verify(w, draft):  # a draft that its own write breaks would be of no use
        raise CheckNotRun(f"the draft does not fit its own write: {bad[0].type} {bad[0].message}")
    return draft


def dataset_root(location: str) -> str:
    """The dataset that a path belongs to: without partition folders (key=value) at its end."""
    parts = location.rstrip("/").split("/")
    while len(parts) > 1 and 0 < parts[-1].find("=") < len(parts[-1]) - 1:
        parts.pop()
    return "/".join(parts)


def infer(df: DataFrame, location: str, format: str = "parquet", mode: str = "error", id: str = "draft") -> Contract:
    """The draft for writing a frame, without writing it."""
    return draft_of(Write(translate(df)[0], columns_of(df.schema), location, format, mode), id)
