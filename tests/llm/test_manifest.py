"""The Merkle manifest against a plain version of it, on odd rows."""

import random
import zlib
from hashlib import sha256

import pytest

from runlake.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, at long, n string, digest string, path string"


def plain(rows):
    """Rows as (doc_id, text, lang, source, n_chars)."""

    def enc(v):
        return b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode())

    def leaf(doc_id, text, lang, source, n_chars):
        return sha256(b"".join(map(enc, (doc_id, source, lang, n_chars, text)))).hexdigest()

    def tree(digests):
        """The top, and of each node its edges upwards."""
        edges, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for i, k in enumerate(at):
                run = level[k // 8 * 8 : k // 8 * 8 + 8]
                edges[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
                at[i] = k // 8
            level = [sha256("".join(level[k : k + 8]).encode()).hexdigest() for k in range(0, len(level), 8)]
        return level[0], edges

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs]
    trees = [tree([leaf(*r) for r in g]) for g in groups]
    root, tops = tree([top for top, _ in trees])
    out = []
    for g, (top, edges), upper in zip(groups, trees, tops, strict=True):
        for r, own in zip(g, edges, strict=True):
            path, d = own + upper, leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                d = leaf(r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:])
            for left, right in path:
                d = sha256((left + d + right).encode()).hexdigest()
            proof = sha256("".join(left + right for left, right in path).encode()).hexdigest()
            out.append((r[0], leaf(*r), top, root, proof, d, d == root))
    return sorted(out, key=str)


def found(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=str)


def test_odd_rows(spark):
    """Null values, empty and long texts, repeated and equal rows, lone leaves, a lang that holds most rows, ids out of order."""
    rng = random.Random(3)
    rows = [(i * 7 % 601 - 90, f"Text {i} ÄÖ", "en", "web", i) for i in range(601)]
    rows += [(i, None if i % 3 else "", rng.choice(["de", None, "", "é"]), None, None) for i in range(40)]
    rows += [(5, "Same", "en", "web", 4)] * 90 + [(None, "No Id", "en", "a", 1), (None, None, None, None, None), (9, "Long A " * 200_000, "fr", "web", 7), (10**17, "Only", "zz", "web", 1)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", (1, 2, 7, 8, 9, 64, 65))
def test_sizes(spark, n):
    rows = [(i, f"A{i}", "en", "s", 2) for i in range(n)]
    assert found(spark, rows, 2) == plain(rows)


def test_many_langs(spark):
    rows = [(i, "T", f"l{i % 83}", "s", 1) for i in range(200)]
    assert found(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_are_dealt_to_several_tasks(spark):
    """One row, many times over, does not end in one partition of the range partitioning."""
    from pyspark.sql import functions as F

    from runlake.llm.common import Tables

    rows = spark.range(4000).select(F.lit("en").alias("lang"), F.lit(1).cast("long").alias("doc_id"), F.lit("d").alias("digest"))
    tables = Tables(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.ordered(tables, rows, ["lang"], ["doc_id", "digest"], "x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.at for r in got.orderBy("at").collect()] == list(range(4000))
    parts = spark.read.parquet(f"{tables.folder}/x-[0-9a-f]*").groupBy(F.shiftright("__nth", 33)).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 3000
