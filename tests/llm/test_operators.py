"""Each operator against a plain version, on a small table with unusual rows and clashing extra columns."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oxidara.llm import ann, bpe, exact_dedup, html_text, language_id, ngram_join, packing, quality, registry, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "a"), (-5, "a"), (-5, "a"), (-6, "ÀÉ 漢字 'll we've <|endoftext|> 12 x"), (-7, "w" * 5000), (None, "no id at all"), (-8, "one two three four"), (-9, "One two THREE four"), (-10, "%%%% 1234 !!!"), (-11, "word " * 3000)]
BLANK = "\x20\x09-\x0d"


@pytest.fixture(scope="module")
def rows():
    return [*duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall(), *ODD]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    return made.select("*", *[F.lit(None).cast("string").alias(c) for c in ("n", "class", "label", "score", "gram", "norm")]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(f"[{BLANK}]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0))
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect())
    expected = collections.Counter()
    for i, t in rows:
        norm = re.sub(f"[{BLANK}]", "", t or "")
        best = min(groups[norm])
        keep = None if best[1] else best[2]
        expected[i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert got == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_tokens(docs, rows, empty):
    t, path = library("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    each = [(i, x or "", t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    counts = collections.Counter((i, len(x.encode()), len(ids), len(ids) > 2048) for i, x, ids in each)
    assert collections.Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect()) == counts
    hashes = collections.Counter(
        (i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, _, ids in each
    )
    assert collections.Counter(tuple(r) for r in bpe.encode_frame(docs, path).collect()) == hashes
    assert token_counts.token_counts(empty, path).count() == 0 and bpe.encode_frame(empty, path).count() == 0


def test_packing(docs, rows, empty):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    found = packing.pack(docs, path, with_ids=True).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    wanted = collections.Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x in rows)
    got = collections.Counter()
    for (i, n), own in pieces.items():  # rows that repeat an id and a length are told apart by where their pieces begin
        own.sort(key=lambda p: p[0])
        whole = [[]]
        for start, ids in own:
            place = next(w for w in whole if len(w) == start and w is not None) if any(len(w) == start for w in whole) else None
            if place is None:
                place = []
                whole.append(place)
            assert len(place) == start
            place += ids
        for w in whole:
            assert len(w) == n
            got[i, tuple(w)] += 1
    assert {k: n for k, n in got.items() if len(k[1]) <= packing.WINDOW} == {k: n for k, n in wanted.items() if len(k[1]) <= packing.WINDOW}
    assert {(i, len(w)) for i, w in got} == {(i, len(w)) for i, w in wanted} and sum(got.values()) == len(rows)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 48])
def test_padding_at_any_number_of_tasks(spark, parts):
    """Sequences are filled alike however the input is split; every document's pieces follow one another from 0."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").repartition(parts)
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).cache()
    used = found.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end"))
    row = used.agg(F.sum("used").alias("tokens"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("used") != F.col("end")).alias("gaps"), F.max("used").alias("most")).first()
    assert row["gaps"] == 0 and row["most"] <= packing.WINDOW
    assert 1 - row["tokens"] / (packing.WINDOW * row["n"]) < 0.015
    by_doc = found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole"), F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("last"))
    assert by_doc.where("n <> whole OR first <> 0 OR last <> whole").isEmpty() and by_doc.count() == docs.count()


def test_capacity_tree():
    r, tree, have = np.random.default_rng(1), packing.CapacityTree(100), collections.Counter()
    for _ in range(2000):
        n = int(r.integers(1, 101))
        best = min((c for c, k in have.items() if k and c >= n), default=-1)
        assert tree.tightest(n) == best
        change = -1 if best >= 0 and r.random() < 0.5 else 1
        place = best if change < 0 else n
        tree.add(place, change)
        have[place] += change


def test_ngram_join(docs, rows, empty):
    def grams(t):
        w = re.findall(f"[^{BLANK}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            common = len(x & sets[b])
            if x and 100 * common >= 75 * (len(x) + len(sets[b]) - common) and sets[b]:
                root[find(a)] = find(b)
    smallest = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)].append(i)
    expected = collections.Counter((i, len(sets[k]), min(smallest[find(k)], default=None)) for k, (i, _) in enumerate(rows))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == expected
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize("blocks", [(1024, 16_384), (16, 8)])
def test_near_group(spark, monkeypatch, blocks):
    """Many near copies of one text, none of them equal, and variants that link with few or none: components and links as by all pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", blocks[1])
    r = np.random.default_rng(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(int(r.integers(1, 6))):
            words[int(r.integers(0, 60))] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    link = np.array([[a != b and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)])
    low = np.arange(len(rows))
    for _ in rows:
        low = np.minimum(low, np.where(link, low[None, :], len(rows)).min(axis=1))
    assert len(set(low.tolist())) > 3
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), count_links=True)
    assert sorted((x["doc_id"], x["component_id"], x["n_links"]) for x in found.collect()) == [(i, int(low[i]), int(link[i].sum())) for i in range(len(rows))]


def test_ngram_join_of_all_sizes(spark):
    """Families of texts of 6 to 3000 words with edits around the threshold, so that signatures of different widths meet: links and components as by all pairs."""
    r = np.random.default_rng(21)
    texts = []
    for size in (6, 12, 40, 90, 260, 300, 520, 1030, 3000):
        base = [f"w{x}" for x in r.integers(0, 40 * size, size)]
        for _ in range(14):
            words = base[: size - int(r.integers(0, max(2, size // 5)))]
            for at in r.integers(0, len(words), int(r.integers(0, max(2, size // 28)))):
                words[at] = f"x{int(r.integers(0, 1 << 40))}"
            texts.append(" ".join(words))
    texts += [" ".join(t.split()[: len(t.split()) * 4 // 5]) for t in texts[::9]]
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) if len(t.split()) >= 5 else frozenset([tuple(t.split())]) for t in texts]
    link = np.array([[a != b and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)])
    low = np.arange(len(texts))
    for _ in texts:
        low = np.minimum(low, np.where(link, low[None, :], len(texts)).min(axis=1))
    share = link.sum() / (len(texts) * 13)
    assert 0.2 < share < 0.9 and len(set(low.tolist())) > 9
    found = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6), count_links=True)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["n_links"]) for x in found.collect()) == [(i, len(sets[i]), int(low[i]), int(link[i].sum())) for i in range(len(texts))]


def test_blocks_of_an_ngram(spark, monkeypatch):
    """Members of different clusters at one n-gram are compared in blocks of any size; of many close ones a forest is given, not the pairs."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 62, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: int(r.integers(80, 101))], r.integers(0, 1 << 62, int(r.integers(0, 15)), dtype=np.uint64)))) for _ in range(60)]
    rows = [(7, i, len(g), 0) for i, g in enumerate(sets)]
    members = spark.createDataFrame(rows, "gram bigint, class bigint, n int, place int")
    signatures = spark.createDataFrame([(i, len(g), ngram_join._signature(g)) for i, g in enumerate(sets)], "class bigint, n bigint, signature binary")
    a, b = np.triu_indices(len(sets), 1)
    n = np.array([len(g) for g in sets])
    differ = ngram_join._differing_bits([ngram_join._signature(g) for g in sets], a, b)
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(differ, a, b, strict=True))
    close = (differ * 175 <= (n[a] + n[b]) * 25) & (100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b]))
    for labels in (None, spark.createDataFrame([(i, i % 3) for i in range(50)], "node bigint, root bigint")):
        own = [i % 3 if labels is not None and i < 50 else i for i in range(60)]
        root = {i: i for i in own}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in zip(a[close].tolist(), b[close].tolist(), strict=True):
            root[find(own[i])] = find(own[j])
        wanted = {(x, y) for x in root for y in root if find(x) == find(y)}
        for room in (1024, 7):
            monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", room)
            edges = ngram_join._close_in_blocks(members, labels, signatures, 75).collect()
            got = {i: i for i in root}

            def find_got(x, root=got):
                while root[x] != x:
                    x = root[x]
                return x

            for e in edges:
                got[find_got(e["a"])] = find_got(e["b"])
            assert {(x, y) for x in root for y in root if find_got(x) == find_got(y)} == wanted
            assert len(edges) <= 60 * (1 + 60 // room)


@pytest.mark.parametrize("blocks", [(1 << 18, 1024), (300, 7)])
def test_link_counts(spark, monkeypatch, blocks):
    """Links of every row, by all pairs: a family with some of its pairs linked, copies of members, a pair, rows alone, a null id."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks[1])
    r = np.random.default_rng(3)
    texts = []
    for i in range(40):
        words = [f"w{k}" for k in range(60 + i)]
        for _ in range(int(r.integers(0, 3))):
            words[int(r.integers(0, 60))] = f"x{i}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[7], " ".join(f"y{k}" for k in range(50)), " ".join(f"y{k}" for k in range(51)), "quite alone", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (3, texts[9])]

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    n_links = [sum(1 for b, y in enumerate(sets) if a != b and x and 100 * len(x & y) >= 75 * len(x | y)) for a, x in enumerate(sets)]
    assert len(set(n_links)) > 5
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string"), count_links=True)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in found.collect()) == collections.Counter((i, len(x), n) for (i, _), x, n in zip(rows, sets, n_links, strict=True))


@pytest.mark.parametrize("hot", [1, 2, 8, 0x8000])
def test_salted_ngrams(spark, monkeypatch, hot):
    """Copies and variants of texts whose n-grams are dealt over salts, so that classes are alone in theirs: links and components as by all pairs."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base)] * 40 + [" ".join([*base[: 30 + i], f"x{i}", *base[31 + i :]]) for i in range(6)]
    texts += [" ".join([*base[:50], *[f"z{i}-{k}" for k in range(10)]]) for i in range(9)]  # share many n-grams and do not link
    r = np.random.default_rng(41)
    for f in range(6):
        own = [f"f{f}-{x}" for x in r.integers(0, 400, 80)]
        for _ in range(7):
            words = list(own)
            for at in r.integers(0, 80, int(r.integers(0, 4))):
                words[at] = f"x{int(r.integers(0, 1 << 40))}"
            texts.append(" ".join(words))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    link = np.array([[a != b and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)])
    low = np.arange(len(texts))
    for _ in texts:
        low = np.minimum(low, np.where(link, low[None, :], len(texts)).min(axis=1))
    assert (low[:46] == 0).all() and len(set(low.tolist())) > 10
    found = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7), count_links=True)
    assert sorted((x["doc_id"], x["component_id"], x["n_links"]) for x in found.collect()) == [(i, int(low[i]), int(link[i].sum())) for i in range(len(texts))]


def test_classes_alone_in_their_salts():
    """Two classes of one frequent n-gram in two salts are both handed on; of an n-gram that is not salted, a class alone is not."""
    key = np.array([5, 9, 9, (1 << ngram_join.GRAM_BITS) + 7, (2 << ngram_join.GRAM_BITS) + 7])
    met = ngram_join._met(key, np.array([1, 2, 3, 4, 5]), np.full(5, 30), np.zeros(5, dtype=np.int64), 75).to_pylist()
    assert [(r["a"], r["b"], r["gram"]) for r in met] == [(2, 3, None), (4, None, 7), (5, None, 7)]


def test_ngram_join_sql(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{folder}/documents.parquet'")
    expected = duckdb.sql(ngram_join.ORACLE).fetchdf().sort_values("doc_id")
    got = registry.op8_ngram_join(spark, folder).toPandas().sort_values("doc_id")
    for c in ("doc_id", "n_shingles", "class_id", "component_id", "n_links"):
        assert got[c].tolist() == expected[c].tolist()


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 20), (30, 30)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in ngram_join.components(links).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20}


def test_nearest(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(600, 16)).astype(np.float32)
    v[100:130] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for row in ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    d = v.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = np.round(unit @ unit[q], 12)
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]
        hits += len({i for i, _ in got[q]} & set(best))
    assert sorted(got) == list(range(0, 600, 50)) and hits >= 54
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_leaves_rows_out(spark, monkeypatch):
    """Vectors with structure: windows that hold a small part of the table find nearly all true neighbours."""
    monkeypatch.setattr(ann, "LEAST_BLOCK", 64)
    r = np.random.default_rng(7)
    centres = r.normal(size=(300, 6)) @ r.normal(size=(6, 48))
    v = (centres[r.integers(0, 300, 12_000)] + 0.15 * r.normal(size=(12_000, 48))).astype(np.float32)
    frame = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "vec_id bigint, embedding array<float>")
    report = {}
    found = ann.nearest(frame, F.col("vec_id") % 50 == 0, report=report).cache()
    rows = ann.usable(frame)
    truth = ann.exact(rows, rows.where("vec_id % 50 = 0").collect())
    assert truth.count() == 240 * 5 and ann.recall(found, truth) >= 0.9
    assert report["share"] < 1 and report["share"] / report["curves"] < 0.35 and report["recall"] >= ann.TARGET


def test_nearest_without_structure(spark):
    """Independent vectors: one curve is read, not all of them, and columns named as inside the operator do not clash."""
    r = np.random.default_rng(8)
    v = r.normal(size=(3000, 64))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "curve", "key", "place", "block", "candidate", "`a.b`")})
    report = {}
    found = ann.nearest(frame, F.col("vec_id") % 50 == 0, report=report).cache()
    rows = ann.usable(frame)
    truth = ann.exact(rows, rows.where("vec_id % 50 = 0").collect())
    assert report["curves"] == 1 and report["share"] <= 1 and ann.recall(found, truth) >= 0.9
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("most", [4096, 5])
def test_nearest_ties(spark, monkeypatch, most):
    """Equal cosines of different vectors (one direction, many lengths): the smaller ids; queries dealt over groups."""
    monkeypatch.setattr(ann, "MOST_QUERIES", most)
    lengths = [1.0, 2.0, 4.0, 0.5, 0.25, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0, 1024.0, 0.125]
    rows = [(i, [lengths[i % 14] * x for x in (1.0, 2.0, 3.0, 4.0)]) for i in range(200)] + [(1000, [-1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for row in ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append(row["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == got[100] == got[150] == [0, 1, 2, 3, 4]


def test_hilbert_neighbours():
    """Consecutive keys are neighbouring cells, and each cell has one key."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_language_id(spark, docs, empty):
    found = registry.op4_language_id(spark, DATA.replace("sf0.001", "sf0.01")).alias("f")
    known = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.97
    model = language_id.fit(known.join(docs.select("doc_id", "text"), "doc_id"))
    odd = {r["doc_id"]: r for r in language_id.predict(docs.where("doc_id < 0"), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (-1, -2, -3, -10)) and odd[-4]["lang_pred"] != "und"
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(known.join(docs.select("doc_id", "text"), "doc_id").limit(0))
    assert language_id.predict(docs.limit(5), nothing).where("lang_pred <> 'und'").count() == 0


def test_mixture():
    """A text half in one language and half in another has both in its set."""
    r = np.random.default_rng(5)
    words = {"x": ["abba", "baba", "abab"], "y": ["zuzu", "uzuz", "zzuu"]}
    table = np.full((2, 1 << language_id.GRAM_BITS), -9.0, dtype=np.float32)
    from oxidara.llm.words import Run, borders

    def run(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return Run(0, data, np.array([0, len(data)]))

    for i, k in enumerate("xy"):
        piece = run(" ".join(words[k]))
        begin, end, _ = borders(piece, language_id._INSIDE)
        table[i, language_id._grams(piece, begin, end)[0]] = -1.0
    model = language_id.Model(["x", "y"], table)
    mixed = " ".join(r.choice(words["x"], 30).tolist() + r.choice(words["y"], 30).tolist())
    assert np.allclose(language_id.mixtures(model, run(mixed))[0], [[0.5, 0.5]], atol=0.01)
    assert language_id.mixtures(model, run(" ".join(words["x"] * 10)))[0].tolist() == [[1.0, 0.0]]


def test_mixture_likelihoods_against_plain_em():
    """Proportions and their bound against many plain steps."""
    r = np.random.default_rng(12)
    counts = np.array([3, 40, 7, 120])
    likelihood = np.exp(r.normal(size=(4, counts.sum())))
    at = np.cumsum(counts) - counts
    allowed = np.ones((4, 4))
    allowed[2, 1] = 0
    share, reached, bound = language_id._proportions(likelihood, at, counts, allowed)
    for d in range(4):
        own = likelihood[:, at[d] : at[d] + counts[d]]
        p = allowed[:, d] / allowed[:, d].sum()
        for _ in range(20_000):
            joint = own * p[:, None]
            p = (joint / joint.sum(axis=0)).mean(axis=1)
        best = float(np.log((own * p[:, None]).sum(axis=0)).sum())
        assert reached[d] <= best + 1e-9 <= bound[d] + 1e-6 and bound[d] - reached[d] <= language_id.TOLERANCE + 1e-9
        assert np.log((own * share[:, d, None]).sum(axis=0)).sum() == pytest.approx(reached[d])


def test_quality(spark, docs, empty):
    big = DATA.replace("sf0.001", "sf0.1")
    found = registry.op10_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["p"] for r in found.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.1
    model = quality.fit(docs)
    odd = {r["doc_id"]: r["score"] for r in quality.score(docs.where("doc_id < 0"), model).collect()}
    assert odd[-1] == odd[-2] == odd[-3] == 0
    assert quality.score(empty, quality.fit(empty)).count() == 0


def test_label_model_recovers_planted_accuracies():
    """Two kinds of junk, each seen by two labellers that also complain about good rows; a fifth labeller is mostly noise."""
    r = np.random.default_rng(8)
    n = 60_000
    kind = r.choice(3, n, p=[0.85, 0.1, 0.05])
    hit = np.array([[0.03, 0.9, 0.02], [0.01, 0.8, 0.02], [0.05, 0.03, 0.95], [0.02, 0.02, 0.7], [0.1, 0.15, 0.15]])
    rest = r.random((n, 5)) < 0.3  # what is no complaint abstains
    vote = np.where(r.random((n, 5)) < hit.T[kind], quality.BAD, np.where(rest, quality.NONE, quality.GOOD))
    rows, count = np.unique(vote, axis=0, return_counts=True)
    model = quality.label_model(rows, count)
    good = model.posterior(vote) >= 0.5
    rates = np.stack([hit, 0.7 * (1 - hit), 0.3 * (1 - hit)], axis=2).transpose(1, 0, 2)
    best = quality.LabelModel(rates, np.array([0.85, 0.1, 0.05])).posterior(vote) >= 0.5  # what can be known with the planted rates
    assert ((kind == 0) == good).mean() > ((kind == 0) == best).mean() - 0.005
    assert np.abs(model.rates[0, :, quality.BAD] - hit[:, 0]).max() < 0.03
    junk = model.shares[1:] / model.shares[1:].sum()
    by_bad = (junk[:, None] * model.rates[1:, :, quality.BAD]).sum(axis=0)
    assert np.abs(by_bad - (2 * hit[:, 1] + hit[:, 2]) / 3).max() < 0.06
    said = vote != quality.NONE
    right = np.where(kind[:, None] == 0, vote == quality.GOOD, vote == quality.BAD)
    assert np.abs(model.accuracy() - right.sum(axis=0) / said.sum(axis=0)).max() < 0.02


def test_label_model_is_plain_em():
    """The vectorised steps against loops over rows, classes and labellers."""
    r = np.random.default_rng(9)
    rows = np.unique(r.integers(0, 3, (25, 3)), axis=0)
    count = r.integers(1, 50, len(rows))
    weight = []
    for v in rows:
        bad = [j for j in range(3) if v[j] == quality.BAD]
        w = {0: 1.0, 1: 0.5}.get(len(bad), 0.1)
        weight.append([w, *[(1 - w) / len(bad) if j in bad else 0.0 for j in range(3)]])
    got, posteriors = quality._settled(rows, count.astype(float), np.array(weight), 7, -1.0)
    for _ in range(7):
        share = [sum(w[c] * n for w, n in zip(weight, count, strict=True)) + quality.SMOOTHING for c in range(4)]
        rate = [[[sum(w[c] * n for w, n, v in zip(weight, count, rows, strict=True) if v[j] == k) + quality.SMOOTHING for k in range(3)] for j in range(3)] for c in range(4)]
        rate = [[[x / sum(three) for x in three] for three in by] for by in rate]
        weight = []
        for v in rows:
            p = [share[c] / sum(share) * rate[c][0][v[0]] * rate[c][1][v[1]] * rate[c][2][v[2]] for c in range(4)]
            weight.append([x / sum(p) for x in p])
    assert np.allclose(got.rates, rate) and np.allclose(posteriors, weight)


def test_quality_of_few_or_equal_texts(spark):
    """With too few different texts for a scorer the posterior of the votes counts; repeated ids stay rows of their own."""
    rows = [(1, "The same clean text, over and over again in every row of it.")] * 30 + [(1, "%%% $$$ *** %%% ### @@@ %%% ^^^ &&& ***"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash")).repartition(3)
    found = collections.Counter((r["doc_id"], r["predicted"]) for r in quality.score(docs, quality.fit(docs)).collect())
    assert found[1, 1] == 30 and sum(found.values()) == 32


def test_toxicity(spark, docs, empty):
    big = DATA.replace("sf0.001", "sf0.1")
    found = registry.op3_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    share = {r["toxic"]: r["p"] for r in found.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    # some documents labelled toxic hold nothing that sets them apart, which bounds what can be found
    assert share[1] >= 0.9 and share[0] <= 0.05
    model = toxicity.fit_texts(["good text here", "you bad thing"] * 20, np.array([0, 1] * 20))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id < 0"), model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[-1] == scores[-2]
    assert toxicity.score(empty, toxicity.fit_texts([], np.array([]))).count() == 0


def test_characters_are_read():
    """The features of words against a loop over their characters, and the gradient of the filters against differences."""
    from oxidara.llm.words import Run

    data = np.frombuffer("bad badly  cab, x ".encode(), dtype=np.uint8)
    triples, begin = toxicity.word_triples(Run(0, data, np.array([0, len(data)])))
    r = np.random.default_rng(3)
    filters = r.normal(size=(1 << toxicity.TRIPLE_BITS, toxicity.CHARS)).astype(np.float32)
    got = toxicity.read_characters(filters, triples, begin)
    for word, row in zip(("bad", "badly", "cab", "x"), got, strict=True):
        padded = [0, *word.encode(), 0]
        codes = [((((padded[i] << 16) | (padded[i + 1] << 8) | padded[i + 2]) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - toxicity.TRIPLE_BITS) for i in range(len(word))]
        assert np.allclose(row, filters[codes].mean(axis=0), atol=1e-5)
    sample = toxicity.Sample(np.zeros((4, toxicity.FIXED), dtype=np.float32), np.arange(4), triples, begin)
    words = np.full((1, toxicity.WINDOW), 4)
    words[0, :4] = [2, 0, 1, 3]
    d_x = r.normal(size=(1, toxicity.WINDOW, toxicity.INPUTS))
    g = sample.filter_gradients(d_x, words)
    at = int(triples[0])
    moved = filters.copy()
    moved[at, 1] += 1
    change = (sample.batch(moved, words)[0] - sample.batch(filters, words)[0])[:4, toxicity.FIXED + 1]
    assert abs(g[at, 1] - (change * d_x[0, :4, toxicity.FIXED + 1]).sum()) < 1e-4


@pytest.mark.parametrize("seed", [0, 1])
def test_gradients(seed):
    """Back-propagation against differences."""
    r = np.random.default_rng(seed)
    net = toxicity.Network.new(seed)
    x = np.concatenate((r.normal(size=(50, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS)))).astype(np.float32)
    words = r.integers(0, 51, (4, toxicity.WINDOW))
    y, w = np.array([0, 1, 1, 0], dtype=np.float32), np.ones(4, dtype=np.float32)

    def loss():
        z = net.forward(x.astype(np.float64), words)
        return float((np.logaddexp(0, z) - y * z).sum())

    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    got = net.gradients(x, words, y, w)
    for key, value in net.weights.items():
        at = tuple(int(r.integers(0, n)) for n in value.shape)
        old, step = value[at], 1e-3
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert abs((up - down) / (2 * step) - got[key][at]) < 2e-2 * max(1, abs(got[key][at]))
    for _ in range(5):
        b, t, i = int(r.integers(0, 4)), int(r.integers(0, toxicity.WINDOW)), int(r.integers(0, toxicity.INPUTS))
        at = words[b, t], i
        same = words == words[b, t]
        if at[0] == 50:
            continue
        old, step = x[at], 1e-2
        x[at] = old + step
        up = loss()
        x[at] = old - step
        down = loss()
        x[at] = old
        wanted = got["x"][same][:, i].sum()
        assert abs((up - down) / (2 * step) - wanted) < 3e-2 * max(1, abs(wanted))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>One,  two\nthree.<p>Four<br>five</article><footer>f</footer>", "T\nOne, two three.\nFour five"),
        ("<body><div class=sidebar><p>Links, many of them, and so on and so forth.</p></div><div id=main><p>The article has a long text, with commas, of course.</p><p>Short.</p></div><div class='comments'><p>First, I would like to say, nice one, really nice.</p></div>", "The article has a long text, with commas, of course.\nShort."),
        ("<script>var t='</p>';</script><p>Only this, then, is the text of the page.</p>", "Only this, then, is the text of the page."),
        ("<article><p>cut off &am", "cut off &am"),
        ("<body><svg width=1/><math/><article><p>Behind drawings.</p></article>", "Behind drawings."),
        ("<body><svg><path d='x'/><text>not this</text><g><article><p>Behind an open drawing.</p></article>", "Behind an open drawing."),
        ("<svg><foreignObject><div><p>A label, which is long, but only a label.</p></div></foreignObject></svg><article><p>Behind.</p></article>", "Behind."),
        ("<body><template><p>Never shown.</p></template><article><p>Shown.</p></article>", "Shown."),
        ("<body><template><article><p>Behind an open template.</p></article>", "Behind an open template."),
        ("<div class='layout sidebar-right'><article><p>All of it.</p></article></div>", "All of it."),
        ("<div class='page-menu'><p>The text of a page without an article, long, long enough.</p></div>", "The text of a page without an article, long, long enough."),
        ("<div id=main><p>The article has a long text, with commas, of course.</p><div class='post-comments'><p>First, I would like to say, nice one, really nice.</p></div><p class='comment-text'>And another, who says, more or less, the same.</p></div>", "The article has a long text, with commas, of course."),
        ("<article><p>A story.</p></article><div class=comments><article><p>First, I would like to say, nice one, really nice.</p></article></div>", "A story."),
        ("<div class='layout comments-open'><article><p>A story.</p></article></div>", "A story."),
        ("a < b and c > d", "a < b and c > d"),
        *[
            (f"<body><div id=story><p>The article has a long text, with commas, of course.</p></div><div class='{name}'><p>Not this, whatever it says, at length, or not.</p></div>", "The article has a long text, with commas, of course.")
            for name in ("page-footer", "content-sidebar", "main-menu", "comment-body", "article-promo", "post-share", "page-header", "body_newsletter")
        ],
        ("<article><div class='entry-header'><h1>Title</h1></div><p>One.</p></article>", "Title\nOne."),
        ("<body><div><p>The article has a long text, with commas, of course.</p></div>He left.<p>That was the end of it.</p>", "The article has a long text, with commas, of course.\nHe left.\nThat was the end of it."),
        ("<body><div><p>The first part has a long text, with commas, of course.</p></div><section>***</section><div><p>The second part has a long text, with commas, as well.</p></div><div><a href=x>More, of the same, to read</a></div>", "The first part has a long text, with commas, of course.\n***\nThe second part has a long text, with commas, as well."),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_of_the_pages():
    """A plain extractor, which knows that these pages have one article of headings and paragraphs."""
    import html as library

    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()
    assert len(pages) >= 200
    for (page,) in pages:
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(library.unescape(re.sub("<[^>]*>", " " if "<br" in x else "", re.sub("<br[^>]*>", " ", x))).split()) for x in re.split("</?(?:p|h1)(?: [^>]*)?>", inner)]
        assert html_text.main_text(page) == "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("piece", ["<div></p>", "<li><div>", "<x></y>", "<article>", "<div class=comments><p>a", "<table><td>", "<svg><g>", "<section class=sidebar><article>b"])
def test_html_of_deep_pages(piece):
    """Time grows with the length of a page, also if nothing in it is ever closed."""
    import time

    took = []
    for size in (1 << 19, 1 << 21):
        began = time.process_time()
        html_text.main_text(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 12


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<p>Ünï</p>")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(tuple(r) for r in html_text.extract_text(pages).collect()) == [(1, "u", "", 0), (1, "u", "Ünï", 3)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


LONG = "word, " * 40 + "end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<section><p>L</section><section><p>Short last section.</section>", "L\nShort last section."),
        ("<body><div>He left.</div><div><p>L<p>L</div><div>The end.</div>", "He left.\nL\nL\nThe end."),
        ("<h1>Title</h1><div><div><p>L</div></div>", "Title\nL"),
        ("<body><h1>Title</h1><p>By me.</p><div><div><h2>Part</h2><div><p>L</div></div></div>", "Title\nBy me.\nPart\nL"),
        ("<body><div class=post><header><h1>Title</h1></header><p>L</div>", "Title\nL"),
        ("<body><header><h1>Site</h1></header><div><p>L</div><footer>End</footer>", "L"),
        ("<body><div class=post><header class=banner><h1>Buy</h1></header><p>L</div>", "L"),
        ("<body><form><div><p>L</p><input><button>Go</button></div></form>", "L"),
        ("<body><div><p>L</div><form><label>Name</label><p>x</p></form>", "L"),
        ("<form><div><label>Name</label> <label>Mail</label></div></form>", ""),
        ('<p>One <span class="ad">BUY <span>NOW</span> it</span>two <span hidden>x</span>three<i style="display: none">y</i>.</p>', "One two three."),
        ("<div><span class=ad>x<div>y</div></div><div><p>L</div>", "L"),
        ("<div><p>L <a class='share-link' href=x>Share</a></p><p>M <b class=big>N</b></p></div>", "L\nM N"),
        ("<body><div><p>L</div><div><a href=1>One</a> <a href=2>Two</a></div>", "L"),
    ],
)
def test_html_without_an_article(page, text):
    assert html_text.main_text(page.replace("L", LONG)) == text.replace("L", LONG)


def test_html_of_made_up_pages():
    """Pages of nested elements around one container, with headings and paragraphs beside it on the way and boilerplate anywhere: the text that was put in."""
    r = np.random.default_rng(31)
    pick = lambda *x: str(r.choice(x))
    sentence = lambda n: " ".join(f"w{int(k)}" + ("," if r.random() < 0.15 else "") for k in r.integers(0, 900, n)) + "."

    def noise(inside=False):
        found = some()
        return "" if inside and found.startswith("<ul>") else found  # inside the container a list of links may be part of the text

    def some():
        return pick(
            "<nav><a href=x>Home</a> <a href=y>About us</a></nav>", "<div class='sidebar'><p>" + sentence(30) + "</p></div>", "<ul><li><a href=1>One more story</a><li><a href=2>Another</a></ul>", "<aside>" + sentence(12) + "</aside>",
            "<div id=comments><p>" + sentence(25) + "</p></div>", "<form><label>Your mail</label><input></form>", "<script>var a = '<p>no</p>';</script>", "<div class='ad-box'><div>" + sentence(9) + "</div></div>", "<!-- " + sentence(5) + " -->", "<div hidden><p>" + sentence(20) + "</p></div>", "",
        )

    for _ in range(150):
        blocks, inner = [], []
        for _ in range(int(r.integers(2, 9))):
            text = sentence(int(r.integers(3, 90)))
            blocks.append(text)
            spot = text.find(" ")
            mark = pick("", "", " <span class=advert>Buy now</span>", " <b hidden>not shown</b>")
            inner.append(f"<p>{text[:spot]}{mark}{text[spot:]}</p>" if spot > 0 else f"<p>{text}</p>")
            inner.append(noise(inside=True))
        blocks.append(text := sentence(120))
        inner.append(f"<p>{text}</p>")
        page = f"<div>{''.join(inner)}</div>"
        for _ in range(int(r.integers(0, 4))):  # wrappers, with short text before and after
            head, tail = sentence(int(r.integers(1, 6))), sentence(int(r.integers(1, 6)))
            kind = pick("h1", "h2", "p")
            page = f"<{pick('div', 'section')}>{noise()}<{kind}>{head}</{kind}>{page}<p>{tail}</p>{noise()}</{pick('div', 'section')}>" if r.random() < 0.7 else f"<div>{noise()}{page}{noise()}</div>"
            if "<" + kind + ">" + head in page and page.count(f"<p>{tail}</p>"):
                blocks = [head, *blocks, tail]
        page = f"<html><head><title>T</title></head><body><header><h1>Site</h1></header>{noise()}{page}{noise()}<footer>{sentence(8)}</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(blocks), page


def test_windows_and_network_against_plain_steps():
    """Every window of every text, and each gate of both directions, by loops in double precision."""
    r = np.random.default_rng(14)
    net = toxicity.Network.new(3)
    counts = np.array([0, 1, 5, 31, 32, 33, 47, 48, 49, 0, 90, 131])
    x = r.normal(size=(counts.sum(), toxicity.INPUTS)).astype(np.float32)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    sigma = lambda v: 1 / (1 + np.exp(-v))

    def read(rows, d):
        h, states = np.zeros(toxicity.HIDDEN), []
        for row in rows if d == "f" else rows[::-1]:
            gx, gh = row @ w["W" + d], h @ w["U" + d]
            z, reset = sigma(gx[:8] + gh[:8]), sigma(gx[8:16] + gh[8:16])
            c = np.tanh(gx[16:] + reset * gh[16:])
            h = z * h + (1 - z) * c
            states.append(h)
        return states if d == "f" else states[::-1]

    def logit(rows):
        padded = np.concatenate((rows, np.zeros((toxicity.WINDOW - len(rows), toxicity.INPUTS))))  # padding is read, but not attended to
        forth, back = read(padded, "f"), read(padded, "b")
        e = np.array([f @ w["af"] + b @ w["ab"] + row @ w["wa"] for f, b, row in zip(forth, back, padded, strict=True)])[: len(rows)]
        value = np.array([f @ w["of"] + b @ w["ob"] + row @ w["wo"] for f, b, row in zip(forth, back, padded, strict=True)])[: len(rows)]
        alpha = np.exp(e - e.max())
        return float((alpha / alpha.sum()) @ value + w["bias"][0])

    at, wanted = 0, []
    for n in counts.tolist():
        own = x[at : at + n].astype(np.float64)
        starts = [0] if 0 < n <= toxicity.WINDOW else list(range(0, n - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)) if n else []
        assert {k for s in starts for k in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))  # every word is in some window
        wanted.append(max((logit(own[s : s + toxicity.WINDOW]) for s in starts), default=-np.inf))
        at += n
    assert np.allclose(toxicity.document_logits(net, x, counts), wanted, atol=1e-4)


def test_sample_of_repeated_ids_and_bytes(spark, monkeypatch):
    """An id that repeats gives one text to the sample, and the sample's bytes are bounded; texts without words have the least score."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_texts", lambda texts, toxic, seed=5: seen.append((texts, toxic.tolist())))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(20) for k in range(1 + 500 * (i == 3))] + [(5, None)], "doc_id bigint, text string").repartition(4)
    toxicity.fit(docs, labels)
    texts, toxic = seen.pop()
    assert len(texts) == 20 and sorted(texts) == sorted(f"text {i} 0" for i in range(20)) and sum(toxic) == 10
    toxicity.fit(docs, labels, most_bytes=90)
    assert 5 <= len(seen.pop()[0]) <= 11


def test_least_score_of_texts_without_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " .,; ")], "doc_id bigint, text string")), model).collect()}
    assert scores[-1] == scores[-2] == scores[-3] <= min(scores.values()) and scores[-1] < 1e-12
