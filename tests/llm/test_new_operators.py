"""Whitening, clustering and decontamination against plain versions, with unusual rows and clashing extra columns."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oxidara.llm import clustering, decontamination, registry, whitening

DATA = "/root/testdata/sf0.01"
ODD_VECTORS = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [1.0, 2.0]]


def vectors(spark, rows, clash=True):
    """vec_id, embedding, and columns named like those that operators use inside."""
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    if clash:
        frame = frame.withColumns({c: F.lit("x") for c in ("v", "y", "cluster", "component", "n", "`a.b`")})
    return frame.repartition(3)


def plain_whitening(rows, k, scale=1024, shift=100_000):
    x = np.floor(scale * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + shift
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(d) ** 2 for d in n * one - s) for one in x]
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("dimension", "falling"), [(20, 0.7), (40, 1.0), (5, 1.0), (60, 0.97)])
def test_whitening(spark, dimension, falling):
    """Spectra with and without a gap: blocks narrower than the space, blocks that grow, fewer dimensions than components."""
    r = np.random.default_rng(dimension)
    values = r.normal(size=(400, dimension)) * falling ** np.arange(dimension) @ np.linalg.qr(r.normal(size=(dimension, dimension)))[0] + r.normal(size=dimension)
    rows = [(i, v.tolist()) for i, v in enumerate(values)] + [(7, values[3].tolist()), (None, values[4].tolist())]
    odd = [(1000 + i, v) for i, v in enumerate(ODD_VECTORS)]
    report = []
    got = whitening.whiten(vectors(spark, rows + odd), report=report).toPandas()
    k = min(8, dimension)
    assert len(got) == len(rows) * k and set(got["n"]) == {len(rows)} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert report[-1][1] <= 1e-9 and [w for w, _ in report] == sorted(w for w, _ in report)
    if dimension == 20:
        assert max(w for w, _ in report) < dimension and len(report) > 1  # certified inside a block narrower than the space
    deviation, whitened, explained = plain_whitening(rows, k)
    for j in range(k):
        own = got[got["component"] == j + 1]
        assert sorted(map(int, own["deviation"])) == sorted(deviation)
        assert own["explained"].iloc[0] == pytest.approx(explained[j], rel=1e-9)
        by_id = own.dropna(subset="vec_id").groupby("vec_id")["whitened"].first()
        at = [i for i in range(400) if i != 7]
        mine, want = by_id.loc[at].to_numpy(), whitened[at, j]
        assert np.abs(mine - want * np.sign(mine @ want)).max() < 1e-6


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(9)])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).toPandas()  # variance along one direction only
    assert set(line["component"]) == {1} and len(line) == 9 and line["explained"].iloc[0] == pytest.approx(1.0)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [1.0, 2.0])])).count()


def test_whitening_sums_are_exact(spark):
    """Deviations of far and near values, where 64 bits and doubles would not do."""
    rows = [(i, [2.0**28 * (-1) ** i + i / 1024, i / 1024]) for i in range(50)]
    got = whitening.whiten(vectors(spark, rows)).where("component = 1").toPandas()
    assert sorted(map(int, got["deviation"])) == sorted(plain_whitening(rows, 1)[0]) and int(got["deviation"].max()) > 1 << 70


def test_whitening_query(spark):
    got = registry.op11_whitening(spark, DATA)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = got.toPandas().sort_values(["vec_id", "component"])
    order = np.argsort([i for i, _ in rows], kind="stable")
    deviation, whitened, explained = plain_whitening([rows[i] for i in order], 8)
    assert got["deviation"].tolist()[::8] == deviation and got["identity_error"].max() < 1e-9
    mine = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(mine * np.sign((mine * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:8], explained, rtol=1e-9)


def plain_clusters(rows, k, rounds, scale=256, seed=2):
    x = np.floor(scale * np.array([v for _, v in rows])).astype(np.int64)
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x[j].tolist()) for j, (i, _) in enumerate(rows) if i is not None]
    c = np.array([v for _, v in sorted(named)[:k]])
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if turn < rounds:
            c = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)] if (own == j).any() else c[j].tolist() for j in range(len(c))])
    return own, d[np.arange(len(x)), own], c


@pytest.mark.parametrize(("dimension", "k", "spread"), [(6, 7, 0.2), (3, 12, 1.0), (2, 40, 0.01), (4, 1, 1.0)])
def test_clustering(spark, dimension, k, spread):
    """Groups, ties (coarse values), empty clusters, repeated ids and vectors: as by comparing all vectors with all centroids."""
    r = np.random.default_rng(k)
    middle = r.normal(size=(5, dimension))
    values = (middle[r.integers(0, 5, 300)] + spread * r.normal(size=(300, dimension))).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(values)] + [(5, values[8].tolist()), (None, values[9].tolist())] + [(1000 + i, values[0].tolist()) for i in range(60)]
    odd = [(2000 + i, v) for i, v in enumerate(ODD_VECTORS)] if dimension != 2 else []
    report = []
    got = clustering.cluster(vectors(spark, rows + odd), k=k, rounds=5, dimension=dimension, report=report).toPandas()
    own, distance, c = plain_clusters(rows, k, 5)
    want = collections.Counter((i, int(a), int(d)) for (i, _), a, d in zip(rows, own, distance, strict=True))
    assert collections.Counter((None if np.isnan(i) else int(i), a, d) for i, a, d in zip(got["vec_id"], got["cluster"], got["distance"], strict=True)) == want
    assert set(got["inertia"]) == {int(distance.sum())}
    for j, part in got.groupby("cluster"):
        assert set(part["cluster_inertia"]) == {int(distance[own == j].sum())}
        assert set(part["centroid_sha256"]) == {hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()}
    assert report[0] == len(rows) and (k == 1 or report[-1] < len(rows))  # the first pass compares all, later ones do not


def test_bounds_hold():
    """After any moves of the centroids, bounds stay on their side of the true distances, and clusters are those of a full scan."""
    r = np.random.default_rng(3)
    x = r.integers(-500, 500, (400, 8))
    c = r.integers(-500, 500, (9, 8))
    move = clustering.Move.to(c)
    cluster, upper, lower, n = clustering.reassign(x, np.full(400, -1, dtype=np.int32), np.zeros(400), np.zeros(400), move)
    assert n == 400
    for turn in range(12):
        c = c + r.integers(-40, 41, c.shape) // (turn + 1)
        move = clustering.Move.to(c, move.centroids)
        cluster, upper, lower, n = clustering.reassign(x, cluster, upper, lower, move)
        d = np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        assert (cluster == d.argmin(axis=1)).all()
        own = d[np.arange(400), cluster]
        d[np.arange(400), cluster] = np.inf
        assert (upper >= own).all() and (lower <= d.min(axis=1)).all()
    assert n < 400


def test_large_components(spark):
    """Products of doubles would round: exact whole numbers all the same; beyond that an error."""
    values = np.random.default_rng(1).integers(-(1 << 24), 1 << 24, (40, 3)) / 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    got = clustering.cluster(vectors(spark, rows), k=4, dimension=3, scale=1).toPandas()
    own, distance, _ = plain_clusters(rows, 4, 5, scale=1)
    assert dict(zip(got["vec_id"], got["distance"], strict=True)) == {i: int(d) for i, d in enumerate(distance)}
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(vectors(spark, [(1, [1e12, 0.0, 0.0])]), k=1, dimension=3).count()


def test_clustering_without_vectors(spark):
    assert clustering.cluster(vectors(spark, [(1, None), (2, [1.0])]), dimension=3).count() == 0
    assert clustering.cluster(vectors(spark, [(1, [1.0, 2.0, 3.0])]), k=40, dimension=3).first()["distance"] == 0


def plain_hits(docs, items, window=10):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            grams[tuple(w[a : a + size])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                g = tuple(w[a : a + size])
                if g in grams:
                    hit |= set(range(a, a + size))
                    found |= grams[g]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("each", [1024, 1])
def test_decontamination(spark, monkeypatch, hot, each):
    """Passages whole, cut, overlapping, at either end, repeated; short items; frequent shingles over salts; tables of few bits."""
    monkeypatch.setattr(decontamination, "HOT", hot)
    monkeypatch.setattr(decontamination, "BITS_EACH", each)
    monkeypatch.setattr(decontamination, "LEAST_BITS", 5 if each == 1 else 16)
    r = np.random.default_rng(17)
    vocabulary = [f"w{x}" for x in range(60)] + ["ÄÖ", "漢字", "naïve", "the", "x9"]
    text = lambda n: r.choice(vocabulary, n).tolist()
    passages = [text(int(n)) for n in (10, 11, 25, 40, 9, 3, 2, 1, 12)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(2, " ".join(text(15))), (None, " ".join(text(14))), (50, None), (51, " .,; "), (52, ""), (53, passages[3][5] + " " + " ".join(passages[3][6:20]))]
    docs = []
    for i in range(60):
        words = text(int(r.integers(0, 80)))
        for _ in range(int(r.integers(0, 3))):
            p = [*passages, items[9][1].split(), items[10][1].split()][int(r.integers(0, 11))]
            a, b = sorted(r.integers(0, len(p) + 1, 2).tolist()) if r.random() < 0.4 else (0, len(p))
            at = int(r.choice([0, len(words), int(r.integers(0, len(words) + 1))]))
            words = [*words[:at], *p[a:b], *words[at:]]
        docs.append((i, "".join(w.upper() + str(r.choice([" ", ", ", "\n", " -- ", "  " if False else "_"])) for w in words)))
    docs += [(1, docs[3][1]), (None, " ".join(passages[2])), (70, None), (71, ""), (72, "..."), (73, " ".join(passages[2] * 400)), (74, "w1"), (75, " ".join(passages[0][:9]))] + [(100 + i, " ".join(passages[1])) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("row", "shingle", "words", "item_id")}).repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    got = collections.Counter(tuple(x) for x in decontamination.decontaminate(frame, bench).collect())
    assert got == plain_hits(docs, items)
    assert sum(n for x, n in got.items() if x[5]) > 40


def test_decontamination_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "z z")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "b c"), (2, "c d"), (3, "g")], "item_id bigint, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in decontamination.decontaminate(docs, bench, spans=True).collect()}
    assert got[2] == [] and sum(b - a for a, b in got[1]) == 4 and {w for a, b in got[1] for w in range(a, b)} == {1, 2, 3, 6}
    none = decontamination.decontaminate(docs, bench.limit(0)).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_hit"], x["contaminated"]) for x in none) == [(1, 7, 0, False), (2, 2, 0, False)]
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0
    assert decontamination.decontaminate(docs, spark.createDataFrame([(1, "not there at all")], "item_id bigint, text string")).where("contaminated").count() == 0


@pytest.mark.parametrize("name", ["op12_clustering", "op13_decontamination"])
def test_sql(spark, name):
    for t in ("documents", "benchmark", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    expected = duckdb.sql(registry.oracle_sql()[name]).fetchall()
    got = registry.queries()[name](spark, DATA)
    names = [c[0] for c in duckdb.sql(f"DESCRIBE {registry.oracle_sql()[name]}").fetchall()]
    assert collections.Counter(tuple(x[c] for c in names) for x in got.collect()) == collections.Counter(expected)
