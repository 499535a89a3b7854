"""The pipeline against a brute-force version on planted documents."""

import functools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quillgraph.llm import byte_cnn  # noqa: E402
from quillgraph.session import ship_package  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, n_words string, print string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [(prose(r.randint(60, 300)), f"host{k % 6}") for k in range(120)]
    texts += [(prose(70) + " $$## %%&& " * 30 + prose(40), "host1") for _ in range(40)]  # junk that the classifier learns
    texts += [(prose(30), "host2") for _ in range(10)] + [("same words " * 60, f"host{k % 6}") for k in range(5)]
    texts += [(prose(20), "bad.example") for _ in range(30)] + [(prose(90), "bad.example") for _ in range(3)]  # a host that goes
    texts += [(texts[k][0], "host3") for k in range(10) for _ in range(3)]  # exact copies
    for k in range(10, 20):  # near copies
        w = texts[k][0].split()
        w[len(w) // 2] = "changed"
        texts.append((" ".join(w), "host4"))
    texts += [(prose(3_000), None), (None, "host1"), ("", None), (" \t\n", "host2")]
    rows = [(k, t, "xx", s, len(t or ""), f"r{k}", "own", None) for k, (t, s) in enumerate(texts)]
    rows.append((None, prose(80), "xx", "host0", 1, "null key", "own", None))
    rows.append((5, prose(80), None, "host0", None, "key 5 again", "own", None))
    rows.append((*rows[6][:5], "row 6 again", "own", None))
    return rows


def rules(rows):
    def failed(text):
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] >= 2 for j in range(3)}
        return len(w) < 50 or 100 * len(hit) > 50 * len(w)

    hosts = defaultdict(list)
    for r in rows:
        if r[3] is not None:
            hosts[r[3]].append(failed(r[1]))
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 1e-6), 1 - 1e-6)
    spread = sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / len(rates) - mean * (1 - mean) * sum(1 / len(x) for x in hosts.values()) / len(hosts)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    gone = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    return [r for r in rows if not failed(r[1]) and r[3] not in gone], gone


def one_of_each(rows, size=5):
    sets = []
    for r in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and part[i] != part[j]:
                part = [part[j] if x == part[i] else x for x in part]
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[part[k] if sets[k] else ("alone", k)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    made.encode_special_tokens = True
    return made


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    ship_package(spark)
    rows, folder = corpus(), str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int("$$##" not in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2 == 0] + [(9_999, 1), (None, 0), (8, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)

    wanted, gone = rules(rows)
    assert gone == {"bad.example"}
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns and plain(kept) == sorted(wanted, key=repr)

    staged = spark.createDataFrame(wanted, SCHEMA)
    net = byte_cnn.fit(staged, spark.read.parquet(f"{folder}/labels.parquet").where(~byte_cnn.held_out()))
    scores = byte_cnn.score(net, [(r[1] or "").encode() for r in wanted])
    good = [r for r, s in zip(wanted, scores, strict=True) if s >= 0.5]
    assert plain(corpus_pipeline.quality_classifier(spark, staged, folder)) == sorted(good, key=repr)
    junk = [r for r in wanted if "$$##" in r[1]]
    assert len([r for r in good if "$$##" in r[1]]) < len(junk) / 10 and len(good) > 0.9 * (len(wanted) - len(junk))

    first = one_of_each(good)
    assert len(first) < len(good) - 30
    deduped = corpus_pipeline.near_dedup(spark, spark.createDataFrame(good, SCHEMA), folder)
    assert deduped.columns == docs.columns
    one = lambda r: (r[0], r[1])  # noqa: E731 -- of rows with one key and text, either may stay
    assert sorted(map(one, map(tuple, deduped.collect())), key=repr) == sorted(map(one, first), key=repr)

    packed = corpus_pipeline.run(spark, folder).collect()
    pieces = Counter((r["doc_id"], r["start"], r["length"]) for r in packed)
    expected = Counter()
    for key, text, *_ in first:
        n = len(tokenizer().encode(text or "", add_special_tokens=False).ids) + 1
        head = n - (math.ceil(n / 1024) - 1) * 1024
        cuts = [0, *range(head, n + 1, 1024)]
        expected.update((key, a, b - a) for a, b in zip(cuts, cuts[1:]))
    assert pieces == expected
    room = Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    bins = []
    for n in sorted((n for (_, _, n), times in pieces.items() for _ in range(times)), reverse=True):  # one by one, each to the fullest with room
        at = max((k for k, b in enumerate(bins) if b + n <= 1024), key=lambda k: bins[k], default=None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert max(room.values()) <= 1024 and len(room) == len(bins)


def test_pipeline_of_nothing(spark, tmp_path):
    ship_package(spark)
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    bad = spark.createDataFrame([(1, None, None, None, None, None, None, None)] * 3, SCHEMA)
    assert corpus_pipeline.quality_rules(spark, bad, folder).count() == 0
    assert corpus_pipeline.quality_classifier(spark, bad, folder).count() == 3
    assert corpus_pipeline.near_dedup(spark, bad, folder).count() == 3
    assert corpus_pipeline.best_fit_packing(spark, bad, folder).select(F.sum("length")).first()[0] == 3
