import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from oxidara.plans import stages

calls = []


def double(rows, by=2):
    calls.append(by)
    return {"out": rows.select((F.col("id") * by).alias("x"))}


def nothing(rows):
    return {}


def test_kept_and_recomputed(spark, tmp_path):
    store = stages.Store(spark, str(tmp_path))
    calls.clear()
    for _ in range(2):
        out = store.run("double", double, {"rows": spark.range(5)}, ["out"])["out"]
        assert sorted(r["x"] for r in out.collect()) == [0, 2, 4, 6, 8]
    assert calls == [2]
    store.run("double", double, {"rows": spark.range(6)}, ["out"])
    store.run("double", double, {"rows": spark.range(5)}, ["out"], {"by": 3})
    assert calls == [2, 2, 3]


def test_changed_output_is_noticed(spark, tmp_path):
    store = stages.Store(spark, str(tmp_path))
    calls.clear()
    store.run("double", double, {"rows": spark.range(5)}, ["out"])
    folder = next(p for p in tmp_path.iterdir() if p.name.startswith("double-"))
    written = next(p for p in folder.iterdir() if p.name.startswith("attempt-"))
    spark.range(1).select(F.col("id").alias("x")).write.mode("overwrite").parquet(str(written / "out"))
    out = store.run("double", double, {"rows": spark.range(5)}, ["out"])["out"]
    assert out.count() == 5 and calls == [2, 2]


def test_missing_output(spark, tmp_path):
    with pytest.raises(stages.StageFailed):
        stages.Store(spark, str(tmp_path)).run("nothing", nothing, {"rows": spark.range(1)}, ["out"])


def test_retries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "WAITS", (0, 0, 0))
    tries = []

    def flaky(rows):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return {"out": rows}

    def broken(rows):
        tries.append(1)
        raise ValueError

    store = stages.Store(spark, str(tmp_path))
    assert store.run("flaky", flaky, {"rows": spark.range(2)}, ["out"])["out"].count() == 2 and len(tries) == 3
    tries.clear()
    with pytest.raises(ValueError):
        store.run("broken", broken, {"rows": spark.range(2)}, ["out"])
    assert len(tries) == 1


def test_failed_writes_are_tried_again(spark, tmp_path, monkeypatch):
    """Spark's work happens in the write: an attempt that breaks off there leaves nothing that is taken for done."""
    monkeypatch.setattr(stages, "WAITS", (0, 0, 0))
    kind = type(spark.range(1))
    write, tries = kind.write, []

    class Flaky:
        def __init__(self, frame):
            self.frame = frame

        def parquet(self, path):
            tries.append(path)
            write.fget(self.frame).parquet(path)
            if len(tries) < 3:
                raise ConnectionError

    monkeypatch.setattr(kind, "write", property(lambda frame: Flaky(frame) if "x" in frame.columns else write.fget(frame)))
    out = stages.Store(spark, str(tmp_path)).run("double", double, {"rows": spark.range(2)}, ["out"])["out"]
    assert out.count() == 2 and len(set(tries)) == 3


def test_changed_code_recomputes(spark, tmp_path, monkeypatch):
    """A constant changed in any operator makes another key."""
    from oxidara.operators import faults

    calls.clear()
    stages.Store(spark, str(tmp_path)).run("double", double, {"rows": spark.range(3)}, ["out"])
    before = stages.code_digest()
    read = type(stages.resources.files("oxidara")).read_bytes
    monkeypatch.setattr(type(stages.resources.files("oxidara")), "read_bytes", lambda self: read(self).replace(b"SPIKE_P, PERSIST_P, WATCH_P = 2e-5", b"SPIKE_P, PERSIST_P, WATCH_P = 3e-5"))
    stages.code_digest.cache_clear()
    assert faults.SPIKE_P == 2e-5 and stages.code_digest() != before
    stages.Store(spark, str(tmp_path)).run("double", double, {"rows": spark.range(3)}, ["out"])
    stages.code_digest.cache_clear()
    assert calls == [2, 2]


def refused(spark):
    """A real error of Java's sockets, as Spark's own calls raise it."""
    return spark._jvm.java.net.Socket("127.0.0.1", 1)


def test_java_causes(spark, tmp_path):
    """Connection errors behind Py4J and behind Spark's own exceptions are transient; errors of analysis, data and missing paths are not."""
    with pytest.raises(Exception) as direct:
        refused(spark)
    wrapped = spark._jvm.java.lang.RuntimeException("task failed", spark._jvm.java.io.IOException("call", direct.value.java_exception))
    with pytest.raises(Exception) as thrown:
        raise Py4JJavaError("call", wrapped)
    with pytest.raises(Exception) as chained:
        try:
            refused(spark)
        except Py4JJavaError as e:
            raise ValueError("the write failed") from e
    for error in (direct, thrown, chained):
        assert stages.transient(error.value)
    wrong = (lambda: spark.sql("SELECT nothing"), lambda: spark.sql("SELECT raise_error('bad row')").collect(), lambda: spark.read.parquet(str(tmp_path / "none")))
    for call in wrong:
        with pytest.raises(Exception) as error:
            call()
        assert not stages.transient(error.value)


def test_a_refused_connection_is_tried_again(spark, tmp_path, monkeypatch):
    """Spark reading from a store that does not answer: its exception holds the cause, and the second try succeeds.  An analysis error is raised at once."""
    monkeypatch.setattr(stages, "WAITS", (0, 0, 0))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("ipc.client.connect.max.retries", "0")
    tries = []

    def first_fails(rows):
        tries.append(1)
        return {"out": spark.read.parquet("hdfs://127.0.0.1:1/x") if len(tries) == 1 else rows}

    def wrong(rows):
        tries.append(1)
        return {"out": rows.select("not_there")}

    store = stages.Store(spark, str(tmp_path))
    assert store.run("fails", first_fails, {"rows": spark.range(3)}, ["out"])["out"].count() == 3 and len(tries) == 2
    tries.clear()
    with pytest.raises(Exception, match="not_there"):
        store.run("wrong", wrong, {"rows": spark.range(3)}, ["out"])
    assert len(tries) == 1


def test_metrics_come_with_the_write(spark, tmp_path):
    """Counts and fingerprint are observed where the table is written: no row is made twice, a gate starts no job, and a kept step has them too."""
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def step(rows):
        return {"out": rows.mapInArrow(counting, "id bigint")}

    observe = {"out": [F.count_if(F.col("id") > 6).alias("large"), F.max("id").alias("most")]}
    for _ in range(2):
        store = stages.Store(spark, str(tmp_path))
        out = store.run("step", step, {"rows": spark.range(10)}, ["out"], observe=observe)["out"]
        assert made.value == 10 and store.metrics["step"]["out"] == {"large": 3, "most": 9}
        assert store._fingerprint(out) == stages.fingerprint(out)


def test_screening_and_counts_in_one_pass(spark, tmp_path):
    from oxidara.operators import ingest
    from oxidara.plans import run

    rows = [(f"T{i % 3}", "A", str(i), "1", "40" if i % 5 else "x", "1", i) for i in range(50)]
    feed = spark.createDataFrame(rows, "tail string, component string, serial string, month string, usage_hours string, reading string, row bigint")
    roster = spark.createDataFrame([("T0",), ("T1",)], "tail string")
    store = stages.Store(spark, str(tmp_path))
    params = {"components": ["A"], "n_months": 5, "order": "row"}
    screened = store.run("screen", run.screen_step, {"inspections": feed, "roster": roster}, ["screened"], params, {"screened": ingest.screen_metrics()})["screened"]
    spark.sparkContext.setJobGroup("gate", "nothing may run here")
    counts = ingest.summary(store.metrics["screen"]["screened"])
    with pytest.raises(ingest.Refused):
        ingest.stop_quarantined(counts)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("gate")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    row = ingest.reconcile(screened).first().asDict()
    assert {k: counts[k] for k in row} == row
    assert counts["reason_counts"] == {r["reason"]: r["n_rows"] for r in ingest.reason_counts(screened).collect()}


def test_digest_of_files(spark, tmp_path):
    for name, text in (("a", b"one\ntwo\n"), ("b", b"one\ntwo\n"), ("c", b"one\ntwO\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_bytes(text)
        (tmp_path / name / "more.csv").write_bytes(b"x")
    a, b, c = (stages.files_digest(spark, str(tmp_path / x)) for x in "abc")
    assert a == b != c
    (tmp_path / "b" / "third.csv").write_bytes(b"y")
    assert stages.files_digest(spark, str(tmp_path / "b")) != a
    assert set(run_versions(spark)) == {"python", "spark", "pyspark", "numpy", "pandas", "pyarrow"}


def run_versions(spark):
    from oxidara.plans import run

    return run.versions(spark)
