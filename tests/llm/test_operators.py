"""The ten operators against SQL, the tokenizers library or brute force, on the small tables and on planted cases."""

import functools
import glob
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quillgraph.llm import byte_cnn, host_rules, huffman, min_max, multi_index, packing, pieces, queries  # noqa: E402
from quillgraph.llm.arrow import slices, texts, words  # noqa: E402
from quillgraph.llm.shards import ShardStore  # noqa: E402
from quillgraph.session import ship_package  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string"
ROWS = [(1, None, "en", "h", 0, "x"), (2, "", "en", None, 0, "y"), (3, "one", None, "h", 3, None), (4, " \t\n", "fr", "h", 3, "z"), (5, "w " * 5000, "en", "h", 10000, "q"), (6, "w " * 5000, "en", "h", 10000, "q"), (6, "w " * 5000, "en", "h", 10000, "q")]


@pytest.fixture
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(frame):
    plain = lambda v: None if v is None or str(v) == "<NA>" or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@here
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    assert rows(queries.OPERATORS[name](spark, FOLDER).toPandas()) == rows(con.execute(queries.SQL[name]).df())


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(str(public_tokenizers.path(name)))
    made.encode_special_tokens = True
    return made


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@here
def test_packing(spark):
    texts_ = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    found, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op1_best_fit_packing(spark, FOLDER).collect():
        found[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found.keys() == texts_.keys()
    for doc, parts in found.items():
        ids, at = library_ids("byte_bpe_50k.json", texts_[doc]), 0
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and len(parts) == -(-len(ids) // 1024)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * math.ceil(sum(n for x in sequences.values() for _, n in x) / 1024) + 1


def test_packing_edges(docs):
    got = packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2}
    assert packing.pack_documents(docs.where("false"), queries.tokenizer("byte_bpe_50k.json")).count() == 0


@here
def test_token_file(spark):
    at = 0
    got = {r["doc_id"]: r for r in queries.op2_huffman_token_file(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = library_ids("word_bpe_49k.json", r["text"])
        assert tuple(got[r["doc_id"]])[:4] == (r["doc_id"], at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_huffman_round_trip(n):
    ids = np.random.default_rng(n).geometric(0.05, n).astype(np.int64)
    values, counts = np.unique(ids, return_counts=True)
    bits = huffman.code_lengths(counts)
    assert bits.max() <= 16 and sum(2.0**-b for b in bits.tolist()) <= 1
    book = huffman.Codebook(values, bits)
    data, offsets = book.encode(ids)
    assert book.decode(data, offsets, n).tolist() == ids.tolist()


@here
def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op3_byte_cnn_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert got.count() == 1000 and ((held["score"] >= 0.5) == held["quality"]).mean() > 0.8


def test_classifier_edges(docs):
    none = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in byte_cnn.quality_scores(docs, none).collect()} == {0.5}
    one = docs.sparkSession.createDataFrame([(5, 1), (3, 0), (1, None)], "doc_id long, quality int")
    assert byte_cnn.quality_scores(docs, one).count() == len(ROWS)


def passages(n, seed, size=20_000):
    """Texts of letters; every second one holds 300 bytes of signs somewhere and has label 0."""
    random, texts_ = np.random.default_rng(seed), []
    for k in range(n):
        body = random.choice(list(b"abcdefgh "), size).astype(np.uint8)
        if k % 2 == 0:
            at = int(random.integers(0, size - 300))
            body[at : at + 300] = random.choice(list(b"#$%&"), 300)
        texts_.append(body.tobytes())
    return texts_, np.arange(n) % 2


def test_classifier_learns_from_whole_texts():
    """A short passage in a long text decides its label, wherever it is."""
    net = byte_cnn.train(*passages(60, 1))
    fresh, labels = passages(40, 2)
    assert ((byte_cnn.score(net, fresh) >= 0.5) == labels).mean() >= 0.9


def test_classifier_gradient_is_of_the_whole_text():
    """Against differences of the loss that score() gives, with the passages that decide far apart."""
    random = np.random.default_rng(5)
    f64 = lambda *shape: random.normal(0, 0.3, shape)
    net = byte_cnn.Network(f64(byte_cnn.WIDTH, 256, byte_cnn.FILTERS), f64(2 * byte_cnn.FILTERS + 1, byte_cnn.HIDDEN), f64(byte_cnn.HIDDEN + 1))
    raw = random.integers(0, 256, 6_000).astype(np.uint8).tobytes()
    params = (net.tables, net.hidden, net.output)
    grads = [np.zeros_like(p) for p in params]
    byte_cnn._gradient(net, byte_cnn.padded(raw), 1, 1.0, grads)
    for p, g in zip(params, grads, strict=True):
        for at in np.argsort(-np.abs(g).reshape(-1))[:5]:
            place, loss = np.unravel_index(at, p.shape), []
            for step in (1e-5, -1e-5):
                p[place] += step
                loss.append(-math.log(byte_cnn.score(net, [raw])[0]))
                p[place] -= step
            assert g[place] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_classifier_samples_labels_of_its_documents(spark):
    """Most labels are of other documents; both kinds are found among those that are there."""
    labels = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = spark.range(4_000, 4_006).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert byte_cnn.fit(docs, labels, sample=2).trained


def test_rules_edges(docs):
    got = {r["doc_id"]: r for r in host_rules.judge(docs).collect()}
    assert got[1]["n_words"] == 0 and got[5]["n_repeat_words"] == 5000 and not any(r["kept"] for r in got.values())
    assert host_rules.keep_good(docs.where("false")).columns == docs.columns


def test_rules_go_by_row(spark):
    """A clean row stays when another row under its key, or its null key, is rejected; hosts lose all their rows."""
    ship_package(spark)
    clean, bad = " ".join(f"w{k}" for k in range(80)), "w " * 80
    made = [(None, clean, "en", "h", 1, "a"), (None, bad, "en", "h", 2, "b"), (7, clean, "en", "h", 3, "c"), (7, bad, "en", "h", 4, "d"), (8, clean, None, None, 5, None)]
    made += [(k, clean, "en", "h", k, "e") for k in range(10, 20)] + [(k, clean if k == 20 else bad, "en", "worse", k, "f") for k in range(20, 40)]
    df = spark.createDataFrame(made, SCHEMA).withColumn("n_words", F.lit("own"))
    got = host_rules.keep_good(df)
    assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
    wanted = [(*r, "own") for r in made if r[1] == clean and r[3] != "worse"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_slices_keep_words():
    column = pa.array([f"Ab{k} Cd" * (k % 7) for k in range(200)] + [None])
    batch = pa.RecordBatch.from_arrays([column], ["t"])
    for part in slices(batch, "t", 300):
        row, code, distinct = words(texts(part, "t"), lower=True)
        wanted = [[w.lower() for w in (x or "").split()] for x in part.column(0).to_pylist()]
        got = [[] for _ in wanted]
        for r, c in zip(row.tolist(), code.tolist(), strict=True):
            got[r].append(distinct[c].as_py())
        assert got == wanted


def all_segmentations(store, text):
    unit, cp = pieces.SPACE + text.replace(" ", pieces.SPACE), None
    cp = np.array([ord(c) for c in unit])
    source, length, piece, weight = store.trie.matches(cp, np.full(len(cp), len(cp)))
    found, todo = {}, [((), 0, 1.0)]
    while todo:
        ids, at, w = todo.pop()
        if at == len(cp):
            found[ids] = w
        for k in np.flatnonzero(source == at):
            todo.append((ids + (int(piece[k]),), at + int(length[k]), w * float(weight[k])))
    total = sum(found.values())
    return {ids: w / total for ids, w in found.items()}


def test_gumbel_samples(spark):
    ship_package(spark)
    model = queries.tokenizer("piece_bpe_32k.model")
    n, k = 6000, 3
    got = pieces.sample(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("on it").alias("text")), model, k=k).collect()
    exact = all_segmentations(pieces.lattices(model, 1.0), "on it")
    first, by_doc = Counter(), defaultdict(list)
    estimate = Counter()
    for r in got:
        ids = tuple(r["ids"])
        assert abs(math.exp(r["log_prob"]) - exact[ids]) < 1e-9
        by_doc[r["doc_id"]].append((r["sample"], ids, r["perturbed"]))
        first[ids] += r["sample"] == 0
        estimate[ids] += exact[ids] / r["inclusion"] / n
    assert all(len({x[1] for x in v}) == min(k, len(exact)) for v in by_doc.values())
    assert all(a[2] >= b[2] for v in by_doc.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    for ids, p in exact.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3  # the first draw follows the distribution
        if p > 0.02:
            assert abs(estimate[ids] / p - 1) < 0.15  # inclusion weights are unbiased


def test_gumbel_edges(docs):
    model = queries.tokenizer("piece_bpe_32k.model")
    odd = docs.select("doc_id", "text", "component").union(docs.sparkSession.createDataFrame([(9, "  日本 x\n é ", "c")], "doc_id long, text string, component string"))
    got = pieces.decode(pieces.sample(odd, model, k=2), model).select("doc_id", "decoded").collect()
    wanted = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert all(r["decoded"] == wanted[r["doc_id"]] for r in got) and {r["doc_id"] for r in got} == wanted.keys()


WORD = re.compile("[^\x20\x09-\x0D]+")


def naive_components(texts_, size, percent):
    sets = {}
    for k, t in texts_.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {k: k for k in sets}
    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {k: (len(sets[k]), root[k]) for k in sets}


@here
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    made = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    ship_package(spark)
    wanted = naive_components({r["doc_id"]: r["text"] for r in made.collect()}, size, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in min_max.near_duplicates(made, size=size).collect()}
    assert got == wanted


def test_near_duplicates_in_a_large_group(spark):
    """Variants of one text whose smallest is like few of them: links are found beyond the first of a bucket."""
    ship_package(spark)
    random = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    texts_ = {}
    for k in range(60):
        w = list(base)
        for at in random.choice(60, 6, replace=False):
            w[at] = f"v{random.integers(3)}"
        texts_[k] = " ".join(w)
    got = min_max.near_duplicates(spark.createDataFrame(list(texts_.items()), "doc_id long, text string"), size=2).collect()
    wanted = naive_components(texts_, 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v[1] for k, v in wanted.items()}


def test_near_duplicates_edges(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in min_max.near_duplicates(docs, size=2).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5)}
    assert min_max.near_duplicates(docs.where("false")).count() == 0


@here
def test_vectors(spark):
    made = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op8_inverted_multi_index(spark, FOLDER).collect()}
    x = np.stack(made["embedding"]).astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    same = made["label"].to_numpy()[:, None] == made["label"].to_numpy()[None]
    link = (x @ x.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)
    found = sum(n for n, _ in got.values())
    assert found <= link.sum() and found >= 0.9 * link.sum()


def test_vector_edges(spark):
    ship_package(spark)
    v = [1.0, 2.0, 3.0, 4.0]
    made = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0, 8.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [float("nan"), 1.0, 1.0, 1.0], 1), (9, [-1.0, 2.0, 0.0, 1.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1)} | {k: (0, k) for k in range(4, 10)}


def test_shards_keep_rows(docs, tmp_path):
    store = ShardStore(docs.sparkSession, f"file://{tmp_path}/s", fan_in=2)
    for _ in range(4):
        store.append(docs)
    store.compact()
    assert store.read().count() == 4 * len(ROWS) and len(store.manifest().runs) == 1
    assert store.read(version=1).count() == len(ROWS)


@here
def test_pipeline(spark):
    import corpus_pipeline

    kept = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert kept.columns == spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "best-fit packing"]
    packed = corpus_pipeline.run(spark, FOLDER)
    assert 0 < packed.select("doc_id").distinct().count() <= kept.count()
