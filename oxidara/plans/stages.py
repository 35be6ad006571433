"""Steps whose results are kept by content: same inputs, parameters and code, same result.

A step's tables live in a folder that all executors share, reached through Spark's file system only.  Each attempt writes to a folder
of its own and its manifest names that folder last, so neither a step that broke off nor a half-written table is ever taken for done.  The key of a step
holds a digest of all code of this package but its training-data part: a constant changed anywhere recomputes what it may have changed.

What must be known of a table as a whole (its fingerprint, counts, what gates ask) is observed in the pass that writes it, so no table is read for it; the manifest keeps these
metrics, so a kept step has them as well."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable
from functools import lru_cache
from importlib import resources

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageFailed(RuntimeError):
    """A step did not give what it declares; trying again would not help."""


#: Seconds before a failed connection is tried again.
WAITS = (2, 4, 8)
TRANSIENT = (ConnectionError, TimeoutError)
#: The same among Java's errors, by class, wherever they are in the chain of causes.
TRANSIENT_JAVA = (
    "java.net.SocketException",
    "java.net.SocketTimeoutException",
    "java.net.UnknownHostException",
    "java.util.concurrent.TimeoutException",
    "org.apache.hadoop.ipc.RetriableException",
    "org.apache.hadoop.ipc.StandbyException",
    "org.apache.hadoop.net.ConnectTimeoutException",
    "org.apache.spark.rpc.RpcTimeoutException",
)
#: Links of a chain of causes that are looked at; chains may be circular.
MOST_CAUSES = 50


def _java_classes(error) -> list[str]:
    """The classes of a Java error, its parents included, and of its causes."""
    found, at = [], error
    for _ in range(MOST_CAUSES):
        if at is None:
            break
        kind = at.getClass()
        while kind is not None:
            found.append(kind.getName())
            kind = kind.getSuperclass()
        at = at.getCause()
    return found


def transient(error: BaseException) -> bool:
    """If an error may be gone on another try: a lost connection or a timeout, in Python or anywhere in the chain of causes behind a Spark error."""
    chain, at = [], error
    while at is not None and at not in chain:
        chain.append(at)
        at = at.__cause__ or at.__context__
    for one in chain:
        if isinstance(one, TRANSIENT):
            return True
        java = one.java_exception if isinstance(one, Py4JJavaError) else getattr(one, "_origin", None)
        if java is not None and not set(_java_classes(java)).isdisjoint(TRANSIENT_JAVA):
            return True
    return False


def _digest_columns(frame: DataFrame) -> list[Column]:
    h = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in frame.columns])
    return [F.count(F.lit(1)).alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.bit_xor(h).alias("_x")]


def _digest(frame: DataFrame, row: dict) -> str:
    return hashlib.sha256(f"{frame.schema.simpleString()}|{row['_n']}|{row['_s']}|{row['_x']}".encode()).hexdigest()


def fingerprint(frame: DataFrame) -> str:
    """A digest of a table's schema and rows, whatever their order; repeated rows count."""
    return _digest(frame, frame.agg(*_digest_columns(frame)).first().asDict())


def files_digest(spark: SparkSession, path: str) -> str:
    """A digest of the bytes of a file, or of all files below a folder, by their names: tasks read and digest the files, each below 2 GB.  Empty files do not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return fingerprint(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")))


@lru_cache(maxsize=1)
def code_digest() -> str:
    """A digest of the sources that a step's result may depend on."""
    package = resources.files(__package__.partition(".")[0])
    parts = []
    for folder in ("functions", "operators", "plans", "sources"):
        for file in sorted(package.joinpath(folder).iterdir(), key=lambda f: f.name):
            if file.name.endswith(".py"):
                parts.append(f"{folder}/{file.name}:{hashlib.sha256(file.read_bytes()).hexdigest()}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


class Store:
    """Results of steps below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Tables that this store gave, with their fingerprints: they need not be read again to know what they are.
        self.known: list[tuple[DataFrame, str]] = []
        #: Digests of what the steps read, by step and name: they tell one run from another.
        self.read: dict[str, str] = {}
        #: What was observed of the steps' outputs, by step and name.
        self.metrics: dict[str, dict[str, dict]] = {}

    def _fingerprint(self, frame: DataFrame) -> str:
        return next((digest for kept, digest in self.known if kept is frame), None) or fingerprint(frame)

    def _manifest(self, at: str) -> dict | None:
        """The manifest of a step, if it is there: asked of the file system, as a failed read would be reported to every query listener."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/manifest")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return None
        rows = self.spark.read.text(f"{at}/manifest").collect()  # one line
        return json.loads(rows[0]["value"]) if rows else None

    def run(self, name: str, step: Callable[..., dict[str, DataFrame]], inputs: dict[str, DataFrame], outputs: list[str], params: dict | None = None, observe: dict[str, list[Column]] | None = None) -> dict[str, DataFrame]:
        """The outputs of step(**inputs, **params), computed only if they are not there yet or were changed since.

        observe: for an output, named aggregates of whole numbers, doubles or texts; they are found in ``metrics`` afterwards."""
        params, observe = params or {}, observe or {}
        digests = {k: self._fingerprint(v) for k, v in sorted(inputs.items())}
        self.read |= {f"{name}.{k}": digest for k, digest in digests.items()}
        parts = [name, code_digest(), inspect.getsource(step), json.dumps(params, sort_keys=True), *(f"{k}!{c}" for k, columns in sorted(observe.items()) for c in columns), *(f"{k}:{digest}" for k, digest in digests.items())]
        at = f"{self.folder}/{name}-{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:16]}"
        manifest = self._manifest(at)
        if manifest is not None:
            kept = {k: self.spark.read.parquet(f"{at}/{manifest['attempt']}/{k}") for k in outputs}
            if all(fingerprint(v) == manifest["outputs"].get(k) for k, v in kept.items()):
                self.known += [(v, manifest["outputs"][k]) for k, v in kept.items()]
                self.metrics[name] = manifest["metrics"]
                return kept
        for wait in (*WAITS, None):
            try:
                return self._attempt(name, at, step, inputs, outputs, params, observe)
            except Exception as e:
                if wait is None or not transient(e):
                    raise
                time.sleep(wait)
        raise AssertionError

    def _attempt(self, name: str, at: str, step: Callable, inputs: dict, outputs: list[str], params: dict, observe: dict[str, list[Column]]) -> dict[str, DataFrame]:
        """Compute, write and observe: Spark's work happens in the writes."""
        made = step(**inputs, **params)
        missing = [k for k in outputs if k not in made]
        if missing:
            raise StageFailed(f"{name} did not give {missing}")
        attempt, seen = f"attempt-{uuid.uuid4().hex}", {}
        for k in outputs:
            seen[k] = Observation()
            made[k].observe(seen[k], *_digest_columns(made[k]), *observe.get(k, [])).write.parquet(f"{at}/{attempt}/{k}")
        kept = {k: self.spark.read.parquet(f"{at}/{attempt}/{k}") for k in outputs}
        found = {k: dict(v.get) for k, v in seen.items()}
        digests = {k: _digest(kept[k], row) for k, row in found.items()}
        metrics = {k: {c: x for c, x in row.items() if not c.startswith("_")} for k, row in found.items()}
        line = json.dumps({"attempt": attempt, "params": params, "outputs": digests, "metrics": metrics, "finished": time.time(), "spark": self.spark.version, "code": code_digest()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
        self.known += [(v, digests[k]) for k, v in kept.items()]
        self.metrics[name] = metrics
        return kept
