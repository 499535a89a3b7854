"""Defined results of the ten operators: nulls, repeated rows and keys, ties, long texts, empty tables, clashing names."""

import functools
import gzip
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quillgraph.llm import byte_cnn, host_rules, huffman, min_max, multi_index, packing, pieces, queries, url_rules, warc  # noqa: E402
from quillgraph.llm.shards import CommitConflict, Manifest, Run, ShardStore  # noqa: E402
from quillgraph.session import ship_package  # noqa: E402

LONG = "a long one, " * 40_000


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(str(public_tokenizers.path(name)))
    made.encode_special_tokens = True
    return made


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids + [2]


# op1, op2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    """The encoder's short cuts give the library's ids on strings of signs, spaces, accents and wide characters."""
    from quillgraph.llm.tokens import TextEncoder

    r = random.Random(4)
    alphabet = [" ", " ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "a", "B", "ß", "É", "é", "e\u0301", "ñ", "7", "42", "'", "'s", "'LL", "_", "-", "!?", "<|", "<|endoftext|>", "日本", "😀", "\u200b", "I\u0307", "\x0b", "\x1c", "\x85", "word", "The"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(3_000)]
    flat, counts = TextEncoder(str(public_tokenizers.path(name))).encode(pa.array(made, pa.large_string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(made, ends - counts, ends, strict=True):
        assert flat[a:b].tolist() == library_ids(name, text)[:-1], repr(text)


def test_token_file_edges(spark, tmp_path):
    made = [(3, "same"), (3, "same"), (3, "other"), (1, None), (2, ""), (None, "no key"), (9, LONG), (4, "\x00 zero")]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("ids", F.lit("own"))
    huffman.write_tokens(df, f"file://{tmp_path}/t", queries.tokenizer("word_bpe_49k.json"))
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"]), r["n_tokens"], bytes(r["ids"])) for r in huffman.read_tokens(spark, f"file://{tmp_path}/t").collect())
    wanted, at = [], 0
    ties = {r["text"]: r["tie"] for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    for key, text in sorted(made, key=lambda x: (x[0] is not None, x[0], ties[x[1]])):
        ids = library_ids("word_bpe_49k.json", text)
        wanted.append(((key is not None, key, at), len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert got == wanted
    huffman.write_tokens(df.where("false"), f"file://{tmp_path}/none", queries.tokenizer("word_bpe_49k.json"))
    assert huffman.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_odd_characters_leave_the_rest_of_a_text_in_pieces():
    """A text with an apostrophe is cut as any other; only what touches the odd character is one chunk, its case kept."""
    from quillgraph.llm.tokens import TextEncoder

    encoder = TextEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    made = ["Word, (word) 42 Don't!", "", " \n", "e\u0301T\u0300t,H\u0331 \u00c9T\u00c9\u00d7\u00e9 a\u00a0B", "'", "x"]
    flat, counts = encoder.encode(pa.array(made, pa.large_string()))
    assert set(encoder.known) == {"word", ",", "(", ")", "4", "2", "Don't", "!", "e\u0301T\u0300t", "H\u0331", "\u00c9T\u00c9\u00d7\u00e9", "a\u00a0B", "'", "x"}
    ends = np.cumsum(counts)
    assert [flat[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == [library_ids("word_bpe_49k.json", x)[:-1] for x in made]


def test_blocks_decode_together():
    """Blocks of any size, empty ones too, decode side by side to what each decodes to alone."""
    r = np.random.default_rng(6)
    ids = [r.geometric(0.02, n).astype(np.int64) for n in (300, 0, 1, 256, 70_000, 0, 511)]
    values, counts = np.unique(np.concatenate(ids), return_counts=True)
    book = huffman.Codebook(values, huffman.code_lengths(counts))
    blocks = [(*book.encode(x), len(x)) for x in ids]
    assert book.decode_all(blocks).tolist() == np.concatenate(ids).tolist()
    assert [book.decode(*b).tolist() for b in blocks] == [x.tolist() for x in ids]
    assert book.decode_all(blocks[1:2]).tolist() == []


def test_parts_say_how_often_they_have_each_id(spark):
    """Counts of ids come from the stage table's last row a part, without a look at its ids."""
    made = [(k, "word and " * k if k % 3 else None) for k in range(40)]
    table = huffman.token_table(spark.createDataFrame(made, "doc_id long, text string"), queries.tokenizer("word_bpe_49k.json"))
    wanted = Counter(i for _, text in made for i in library_ids("word_bpe_49k.json", text))
    ids, counts = huffman.id_counts(table.drop("ids", "n"))
    assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == wanted and len(ids) == len(wanted)
    assert table.where("ids is not null").count() == 40


def test_packing_of_one_length(spark):
    """A length that all rows have is dealt to several buckets, and every sequence is full."""
    parts = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit(256).cast("long").alias("length"))
    got = packing.pack(parts, 1024, bucket_rows=700).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r["offset"])
    assert len(by_sequence) == 1250 and all(sorted(x) == [0, 256, 512, 768] for x in by_sequence.values())


# op3


def test_convolution_is_the_naive_one():
    r = np.random.default_rng(2)
    net = byte_cnn.Network(r.normal(0, 0.5, (byte_cnn.WIDTH, 256, byte_cnn.FILTERS)), r.normal(0, 0.4, (2 * byte_cnn.FILTERS + 1, byte_cnn.HIDDEN)), r.normal(0, 0.4, byte_cnn.HIDDEN + 1))
    for raw in (b"", b"x", r.integers(0, 256, 255).astype(np.uint8).tobytes(), r.integers(0, 256, 1_000).astype(np.uint8).tobytes()):
        data, half = byte_cnn.padded(raw), byte_cnn.CHUNK // 2
        response = np.array([[max(0.0, sum(net.tables[w, data[at + w], f] for w in range(byte_cnn.WIDTH))) for f in range(byte_cnn.FILTERS)] for at in range(len(data) - byte_cnn.WIDTH + 1)])
        hidden = []
        for at in range(0, len(response) - half, half):
            chunk = response[at : at + byte_cnn.CHUNK]
            hidden.append(np.maximum(np.concatenate([chunk.mean(0), chunk.max(0) * 0.25, [1.0]]) @ net.hidden, 0))
        wanted = 1 / (1 + math.exp(-(np.max(hidden, 0) @ net.output[:-1] + net.output[-1])))
        assert byte_cnn.score(net, [raw])[0] == pytest.approx(wanted, rel=1e-9)


def test_classifier_rows(spark):
    made = [(1, None, "a"), (1, "good text here", "b"), (None, "### $$ %%", "c"), (2, LONG, "d"), (2, LONG, "d")]
    df = spark.createDataFrame(made, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, byte_cnn.keep_good(df, labels, threshold=0.0).collect()), key=repr) == sorted(made, key=repr)
    assert byte_cnn.keep_good(df, labels, threshold=1.1).count() == 0
    assert byte_cnn.quality_scores(df.where("false"), labels).count() == 0
    scores = [r["score"] for r in byte_cnn.quality_scores(df, labels).where("doc_id = 2").collect()]
    assert len(scores) == 2 and scores[0] == scores[1]


# op4


def test_bad_hosts_lose_good_documents(spark):
    clean, bad = " ".join(f"w{k}" for k in range(80)), "w " * 80
    made = [(k, bad if k % 10 else clean, "bad.example") for k in range(100)] + [(100 + k, clean if k % 20 else bad, f"h{k % 5}") for k in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    judged = {r["doc_id"]: r for r in host_rules.judge(df).collect()}
    assert all(judged[k]["kept"] == (s != "bad.example" and t == clean) for k, t, s in made)
    rates = {s: judged[k]["host_rate"] for k, _, s in made}
    assert 0.5 < rates["bad.example"] < 0.9  # shrunk towards the others
    assert {r["doc_id"] for r in host_rules.keep_good(df).collect()} == {k for k in judged if judged[k]["kept"]}


# op5


PAGES = [(5, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (2, "http://b/", "x" * 200), (7, None, "x" * 200), (None, "http://n/", "x" * 200), (1, "u\r\nv", "short"), (3, "http://s/", "short"), (4, "http://e/", None), (6, "http://é/", "é" * 50), (8, "http://é/", "é" * 50), (9, "http://l/", LONG)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=repr)
    first = {}
    for k, _, h in PAGES:
        raw = (h or "").encode()
        if len(raw) >= 100 and k is not None:
            first[raw] = min(k, first.get(raw, k))
    import hashlib

    wanted = []
    for k, _, h in PAGES:
        raw = (h or "").encode()
        again = raw in first and first[raw] != k
        wanted.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    assert got == sorted(wanted, key=repr)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_ids_of_text(spark):
    df = spark.createDataFrame([("a>b c", "u", "y" * 150), ("b", "u", "y" * 150)], "page_id string, url string, html string")
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.round_trip(df).collect()) == [("a>b c", None), ("b", "a>b c")]


def test_warc_push_down_and_skipping(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archive_pages(df, path)
    bare = warc.read_warc(spark, path, payload=False).where(F.col("record_type").isin("revisit", "metadata") & (F.col("target_uri") == "http://a/"))
    plan = bare._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "isnotnull" in plan.lower()
    rows = bare.collect()
    assert [(r["record_id"], r["refers_to"], r["payload"]) for r in rows] == [("<urn:page:5>", "<urn:page:2>", None)]
    assert rows[0]["headers"]["warc-profile"] == warc.SAME_PAYLOAD and rows[0]["headers"]["warc-date"].endswith("Z")


class Watched:
    """A file in memory that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.reads = data, 0, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.reads += 1
        self.at += n
        return self.data[self.at - n : self.at]


def test_warc_foreign_members_and_unread_payloads():
    head = lambda kind, n: f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {n}\r\n\r\n".encode()
    foreign = gzip.compress(head("response", 3) + b"abc\r\n\r\n")  # no length in its header
    noise = np.random.default_rng(1).integers(0, 256, 3_000_000).astype(np.uint8).tobytes()
    ours = bytearray(warc.member(warc.record([("WARC-Type", "response")], noise)))
    ours[1_000_000:1_000_100] = bytes(100)  # a payload that cannot be inflated
    plain = head("metadata", 5) + b"plain\r\n\r\n"
    small = b"".join(warc.member(warc.record([("WARC-Type", "response")], b"%d" % k)) for k in range(500))
    file = Watched(foreign + bytes(ours) + plain + small)
    found = list(warc.records(file, True, lambda h: h["warc-type"] == "metadata"))
    assert [(h["content-length"], p) for h, p in found] == [("5", b"plain")] and file.reads <= 6
    assert [p for _, p in warc.records(Watched(foreign + plain + small), True, lambda h: True)] == [b"abc", b"plain", *(b"%d" % k for k in range(500))]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(file, True, lambda h: True))
    with pytest.raises(ValueError):
        list(warc.records(Watched(plain[:-8]), True, lambda h: True))


# op6


def test_gumbel_gives_every_segmentation(spark):
    """More draws than segmentations: each once, with its exact probability and inclusion 1; no rows give none."""
    model = queries.tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["on", "é日", "it", ""])], "doc_id long, text string")
    got = defaultdict(list)
    for r in pieces.sample(df, model, k=60).collect():
        got[r["doc_id"]].append(r)
    store = pieces.lattices(model, 1.0)
    for k, text in enumerate(["on", "é日", "it", ""]):
        rows = got[k]
        assert len({tuple(r["ids"]) for r in rows}) == len(rows) < 60
        assert sum(math.exp(r["log_prob"]) for r in rows) == pytest.approx(1) and all(r["inclusion"] == 1 for r in rows)
        assert pieces.spell(store, pa.array([r["ids"] for r in rows], pa.list_(pa.int32()))) == [text] * len(rows)
    assert pieces.sample(df.where("false"), model).count() == 0


def test_gumbel_spells_as_the_library(spark):
    import sentencepiece

    model = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    made = [(1, "Some words, 日本 and 😀."), (2, LONG), (None, "no key"), (None, "no key"), (3, "tab\tand\nline")]
    got = pieces.sample(spark.createDataFrame(made, "doc_id long, text string"), model, k=2).collect()
    assert len(got) == 10 and all(library.decode(r["ids"]) in {t for k, t in made if k == r["doc_id"]} for r in got)
    again = [r["ids"] for r in got if r["doc_id"] is None]
    assert len({tuple(x) for x in again}) == 2  # equal rows are drawn alike


# op7

CASES = [(1, "a b c d e f g h i j"), (1, "q r s t u v w x y z"), (2, "q r s t u v w x y z"), (3, "A b C d e f g h i j"), (None, "a b c d e f g h i j"), (None, "lone text of its own"), (4, None), (5, ""), (4, "one"), (6, "ONE"), (6, "ONE")]


def test_near_duplicates_by_row(spark):
    """Rows are documents: one key may have several texts, and its component is named by the smallest key."""
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in min_max.near_duplicates(df, size=2).collect())
    assert got == Counter(
        {(1, 9, 1, True): 2, (2, 9, 1, False): 1, (3, 9, 1, False): 1, (None, 9, 1, False): 1, (None, 4, None, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (4, 1, 4, True): 1, (6, 1, 4, False): 2}
    )


def test_keep_first_keeps_one_row_of_a_group(spark):
    made = [(*r, k, "m") for k, r in enumerate(CASES)] + [(7, "seen twice", 90, "m"), (7, "seen twice", 91, "m")]
    df = spark.createDataFrame(made, "doc_id long, text string, id int, mark string")
    got = min_max.keep_first(df, size=2)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, CASES[0][1]), (1, CASES[1][1]), (None, "lone text of its own"), (4, None), (5, ""), (4, "one"), (7, "seen twice")], key=repr)


def test_near_duplicates_with_text_keys(spark):
    df = spark.createDataFrame([(f"k{r[0]}", r[1]) for r in CASES[:4]], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in min_max.near_duplicates(df, size=2).collect()} == {("k1", "k1"), ("k2", "k1"), ("k3", "k1")}


# op8


def test_vectors_with_repeated_ids(spark):
    made = [(1, [1.0, 0.0, 0.0, 0.1], 1), (1, [0.0, 1.0, 0.1, 0.0], 1), (2, [0.0, 1.0, 0.1, 0.001], 1), (3, [0.0, 0.0, 1.0, 0.0], 1), (None, [0.0, 0.0, 1.0, 0.0], 1)]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label string")).collect()]
    assert Counter(got) == Counter([(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, True)])
    assert multi_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_sequence_is_in_order():
    r = np.random.default_rng(3)
    a, b = np.sort(r.random((20, 7)), 1), np.sort(r.random((20, 5)), 1)
    i, j = multi_index.multi_sequence(a, b, 35)
    for k in range(20):
        sums = a[k, i[k]] + b[k, j[k]]
        assert (np.diff(sums) >= 0).all() and len(set(zip(i[k].tolist(), j[k].tolist(), strict=True))) == 35
    grid = multi_index.Grid.fit(r.normal(size=(400, 8)), 6)
    x = r.normal(size=(50, 8))
    visits = grid.visits(x, grid.cells)
    for place in (0, 3, 20, 35):
        assert (grid.ranks(x, visits[:, place]) == place).all()


def test_vectors_of_a_clean_corpus(spark):
    """Few planted pairs, none among the sampled vectors most likely: found all the same, by a share of the cells."""
    r = np.random.default_rng(8)
    x = r.normal(size=(12_000, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = multi_index._turned(x[:60], 0.985)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([x, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in multi_index.near_vectors(df).where("vec_id >= 12000").collect()}
    assert sum(got[12_000 + k] == k for k in range(60)) >= 54
    fitted = multi_index.fit(df.selectExpr("vec_id AS class", "label", "embedding AS vector").where("class < 12000"), 0.98)
    assert fitted[1] < fitted[0].cells / 2


# op9


def test_shards_with_any_columns(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    store.append(spark.createDataFrame([(7, "a"), (8, None)], "arrival_run long, x string"), arrival=F.col("arrival_run"))
    store.append(spark.createDataFrame([(9, "b", 1.5)], "arrival_run long, x string, more double"))
    store.append(spark.createDataFrame([(1.0,)], "more double"))
    store.append(spark.createDataFrame([], "arrival_run long"))
    wanted = [(7, "a", None), (8, None, None), (9, "b", 1.5), (None, None, 1.0)]
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(wanted, key=repr)
    assert store.read(version=1).columns == ["arrival_run", "x"]
    store.compact()
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(wanted, key=repr)
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("z",)], "More string"))


def test_shards_null_arrivals_tiers_and_versions(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=3)
    df = spark.range(300).withColumn("who", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    store.append(df, arrival=F.col("who"))
    assert len(store.manifest().runs) == 3 and store.read().count() == 300
    sized = lambda b, files=1: store.tier(Run("", b, files, 1))
    assert [sized(b) for b in (1, 1 << 19, 1 << 20, 3 << 20, 9 << 20)] == [0, 0, 1, 2, 3] and sized(64 << 20) == -1 and sized(64 << 20, 2) == 4
    before = store.manifest().version
    store.compact()
    assert store.read(version=before).count() == store.read().count() == 300 and len(store.manifest().runs) == 1
    stale = Manifest(before, store.manifest().schema, [])
    with pytest.raises(CommitConflict):
        store._commit(stale)
    other = ShardStore(spark, store.root)
    other.append(df)
    store.append(df)  # retries on the other writer's version
    assert store.read().count() == 900
    store.expire(keep=1)
    assert store.versions() == [store.manifest().version] and store.read().count() == 900


# op10


def naive_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_against_brute_force(spark):
    r = random.Random(6)
    labels, steps = ["a", "b", "com", "a-b", "x1"], ["/", "/a", "/ab", "/a/b", "", "/é"]
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for _ in range(150) if (h := ".".join(r.choice(labels) for _ in range(r.randint(1, 5)))) is not None and (p := r.choice(steps)) is not None}.values())
    rules += [("block", "com", "/same"), ("allow", "com", "/same")]
    urls = [None, "", "no scheme", "http://", "http://COM/same?x#y", "ftp://a.com", "x://y://com/a"]
    urls += [f"http://{'.'.join(r.choice(labels) for _ in range(r.randint(1, 6)))}{r.choice(steps)}{r.choice(['', 'b', '?q=/a', '#f'])}" for _ in range(500)] * 2
    df = spark.createDataFrame([(k, u, "r", "k", "b") for k, u in enumerate(urls)], "page_id long, url string, row string, _key string, host string")
    got = {x["page_id"]: x for x in url_rules.judge_urls(df, rules).collect()}
    assert len(got) == len(urls) and url_rules.judge_urls(df, rules).columns == ["page_id", "url", "row", "_key", "host", "path", "rule", "verdict"]
    for k, u in enumerate(urls):
        x = got[k]
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == naive_verdict(u, rules), u
        assert (x["url"], x["row"], x["_key"]) == (u, "r", "k")


def test_urls_edges(spark):
    df = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x")], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.judge_urls(df, spark.createDataFrame([], "verdict string, host string, path string"), default="block").collect()] == ["block", "block"]
    assert url_rules.judge_urls(df.where("false"), [("allow", "b", "/")]).count() == 0
    nested = [("block" if k % 2 else "allow", "b", "/" + "x" * k) for k in range(200)]
    deep = spark.createDataFrame([(2, "http://a.b/" + "x" * 150)], "page_id long, url string")
    assert url_rules.judge_urls(deep, nested).first()["rule"] == "b/" + "x" * 150
