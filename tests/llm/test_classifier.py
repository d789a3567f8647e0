"""The quality classifier against plain versions of its encoding, its score and its fitting."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlake.llm import common, quality

SMALL = "/root/testdata/sf0.001"
WHITE = b" \t\n\r\x0b\x0c"


def plain_passages(raw):
    """Passages of 64 words, each a list of words with the white space behind them; words of more than 32 bytes are several."""
    starts = [0] + [i for i in range(1, len(raw)) if raw[i - 1] in WHITE and raw[i] not in WHITE]
    words = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    words = [w[i : i + 32] for w in words for i in range(0, len(w), 32)]
    return [words[i : i + 64] for i in range(0, len(words), 64)]


def kind(b):
    return 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b in b".,;:" else 5 if b in b"\n\r" else 6 if b in b" \t" else 7 if b > 127 else 4


def plain_encoding(text):
    raw = text.encode()
    if not raw:
        return [[0.0] * 79]
    passages, often, out, at = plain_passages(raw), Counter(w for p in plain_passages(raw) for w in p), [], 0
    low = [b + 32 if 65 <= b < 91 else b for b in raw]
    for p in passages:
        size, sizes = sum(map(len, p)), [len(w) for w in p]
        row = [sum(kind(b) == k for w in p for b in w) / size for k in range(8)]
        mean = sum(sizes) / len(p)
        row += [len(set(p)) / len(p), sum(often[w] > 1 for w in p) / len(p), mean / 10, math.sqrt(max(0, sum(x * x for x in sizes) / len(p) - mean**2)) / 10, len(p) / 64, math.log1p(len(passages)) / 5, 1.0]
        pairs = [0] * 64
        for i in range(at, min(at + size, len(raw) - 1)):
            pairs[((low[i] * 131 + low[i + 1]) * 2654435761 % 2**32) >> 26] += 1
        out.append(row + [math.sqrt(x / size) for x in pairs])
        at += size
    return out


TEXTS = ("", "one", "a b", " \n leading", "trailing \n\n", "Zwei Wörter; 12.5% 漢字" * 30, "漢" * 500, "x" * 5000 + " y", "line\nby\nline\n" * 80, "a\t\x0bB\x0cc" * 100, "word " * 200, " " * 300)


@pytest.mark.parametrize("text", TEXTS)
def test_encoding(text):
    assert np.allclose(quality.encode(text), np.array(plain_encoding(text)), atol=1e-6)
    assert np.array_equal(quality.encode(None), quality.encode(""))


def test_passages_of_texts_without_blanks():
    """Scripts without blanks and one word a line have as many passages as others of their size."""
    assert len(quality.encode("漢字" * 10_000)) == -(-60_000 // (32 * 64)) and len(quality.encode("w\n" * 10_000)) == -(-10_000 // 64)


def plain_score(net, rows):
    x = [[(v - m) / s for v, m, s in zip(r, net.mean, net.scale, strict=True)] for r in rows]

    def through(v, w):
        return [sum(a * w[i][j] for i, a in enumerate(v)) for j in range(len(w[0]))]

    h = [[math.tanh(a + b) for a, b in zip(through(r, net.p["E"]), net.p["e"], strict=True)] for r in x]
    raw = [sum(w * math.tanh(a) / (1 + math.exp(-b)) for w, a, b in zip(net.p["w"], through(r, net.p["V"]), through(r, net.p["U"]), strict=True)) for r in h]
    weight = [math.exp(r - max(raw)) for r in raw]
    z = [sum(w * r[j] for w, r in zip(weight, h, strict=True)) / sum(weight) for j in range(len(h[0]))]
    return 1 / (1 + math.exp(-(sum(a * c for a, c in zip(z, net.p["c"], strict=True)) + net.p["c0"][0])))


def test_scores_against_a_plain_version(spark):
    common.small_batches(spark)
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    allowed = common.crc_bucket("doc_id", 3) != 1
    net = quality.classifier(docs, labels, allowed)
    got = {r.doc_id: r for r in quality.classify(docs, labels, allowed).collect()}
    for r in docs.where(F.length("text") < 3000).orderBy("doc_id").limit(12).collect():
        assert got[r.doc_id].score == pytest.approx(plain_score(net, plain_encoding(r.text)), abs=1e-5)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def bags_frame(spark, bags, labels):
    rows = [(i, int(y), len(b), bytearray(b.astype(np.float32).tobytes())) for i, (b, y) in enumerate(zip(bags, labels, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, y int, n long, passages binary")


@pytest.mark.parametrize("passages", (1, 7, quality.HELD))
def test_one_replica_is_the_fit_in_memory(spark, passages):
    rng = np.random.default_rng(2)
    labels = (rng.random(50) < 0.4).astype(float)
    bags = [rng.normal(size=(int(rng.integers(1, 9)), 79)).astype(np.float32) + y for y in labels]
    frame = bags_frame(spark, bags, labels)
    order = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id", "y", F.lit(1))).collect()]
    plain = quality.fit([bags[i] for i in order], labels[order], epochs=3)
    got = quality.fit_written(frame.repartition(5), rounds=3, passages=passages)
    assert all(np.allclose(plain.p[k], got.p[k], atol=1e-6) for k in plain.p)


def test_replicas_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(quality, "REPLICA", 30)
    rng = np.random.default_rng(3)
    labels = (rng.random(120) < 0.5).astype(float)
    bags = [rng.normal(size=(3, 79)).astype(np.float32) + y for y in labels]
    net = quality.fit_written(bags_frame(spark, bags, labels))
    assert ((net.score([b.astype(float) for b in bags]) >= 0.5) == labels).mean() > 0.95
    assert quality.fit_written(bags_frame(spark, [], [])) is None


@pytest.mark.parametrize("size", ("sf0.001", "sf0.01"))
def test_a_fitted_document_of_very_many_passages(spark, size):
    """One labelled row of 210,000 passages, the first by hash, takes no other row's place."""
    common.small_batches(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    allowed = common.crc_bucket("doc_id", 3) != 1
    first = labels.where(allowed).orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("a "), 210_000 * 64)).otherwise(F.col("text")))
    share = []
    for some in (docs, long):
        held_out = quality.classify(some, labels, allowed).join(labels, "doc_id").where(~allowed)
        share.append(held_out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0])
    assert share[0] > 0.9 and abs(share[0] - share[1]) <= 0.02
