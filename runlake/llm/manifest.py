"""Merkle manifest of a dataset by slot pivots.

Each row is a leaf. Leaves get their places within their group by a range partitioning, without a window
over a whole group. Level by level, conditional aggregates spread the children of a parent into `FANOUT`
columns: their concatenation hashes the parent, and the columns but a child's own are its siblings. Proofs
are carried down from the root run by run, so a level is joined once for every `FANOUT` of its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, sized

FANOUT = 8
SLOTS = range(FANOUT)
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Paths, of a few KB each, that a join may broadcast.
PATHS = 2000
EDGE = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(c: Column) -> Column:
    """A value as its byte count, a colon and itself; null as `-`."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column) -> Column:
    return hashed(*(encoded(text if name == "text" else docs[name]) for name in FIELDS))


def tampered_text(docs: DataFrame) -> Column:
    """Text in which A-Z are lower-cased where 3 divides crc32 of the decimal doc_id, elsewhere null."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ordered(tables: Tables, rows: DataFrame, group: list[str], order: list[str], what: str) -> DataFrame:
    """`rows` with `at`, the place from 0 in `order` within `group`, and `n`, the rows of the group.

    Rows are range partitioned and sorted by group and order; running row numbers of the partitions give the
    places, shifted by what the partitions before hold of the group. A tiebreaker deals equal rows, of which
    one key may have very many, to several partitions.
    """
    dealt = tables.written(rows.withColumn("__tie", F.monotonically_increasing_id()), f"{what}-rows")
    ranged = dealt.repartitionByRange(*group, *order, "__tie").sortWithinPartitions(*group, *order, "__tie")
    numbered = tables.written(ranged.drop("__tie").withColumn("__nth", F.monotonically_increasing_id()), what)
    part = F.shiftright("__nth", 33).alias("__part")
    held = numbered.groupBy(part, *group).agg(F.count("*").alias("__held"), F.min("__nth").alias("__first"))
    # a group's rows here: one for each partition that holds some of it
    of_group = Window.partitionBy(*group)
    before = F.sum("__held").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    held = tables.written(held.withColumn("__shift", F.coalesce(before, F.lit(0)) - F.col("__first")).withColumn("n", F.sum("__held").over(of_group)).select("__part", *group, "__shift", "n"), f"{what}-shifts")
    same = part == held["__part"]
    for g in group:
        same &= numbered[g].eqNullSafe(held[g])
    out = numbered.join(sized(held), same)
    return out.select(*(numbered[c] for c in rows.columns), (F.col("__nth") + F.col("__shift")).alias("at"), held["n"])


def climb(tables: Tables, nodes: DataFrame, widest: int, carried: list[str], what: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level and the tops (tree, digest) of `nodes` (tree, at, n, digest and the `carried` columns).

    A run is (tree, parent, n, s0 to s7) and, at the lowest level, each carried column once a slot. A tree of one
    node goes up unchanged while others still grow.
    """
    runs = []
    while True:
        slot = F.col("at") % FANOUT
        spread = [F.max(F.when(slot == i, F.col(c))).alias(f"{c}{i}") for c in ["digest", *carried] for i in SLOTS]
        run = nodes.groupBy("tree", F.shiftright("at", 3).alias("parent")).agg(F.first("n").alias("n"), *spread)
        run = tables.written(run, f"{what}{len(runs)}")
        runs.append(run)
        digest = F.when(F.col("n") == 1, F.col("digest0")).otherwise(hashed(*(F.coalesce(f"digest{i}", F.lit("")) for i in SLOTS)))
        nodes = run.select("tree", F.col("parent").alias("at"), F.shiftright(F.col("n") + FANOUT - 1, 3).alias("n"), digest.alias("digest"))
        carried, widest = [], -(-widest // FANOUT)
        if widest <= 1:
            return runs, nodes.select("tree", "digest")


def descend(tables: Tables, runs: list[DataFrame], tops: DataFrame, carried: list[str], what: str) -> DataFrame:
    """Of each node at the bottom its digest, carried columns, and `path`: its siblings to the left and right, level by level upwards.

    `tops` (tree, path and any columns of the tree) gives what is above each tree's top.
    """
    above = tops.withColumn("at", F.lit(0).cast("long"))
    of_tree = [c for c in tops.columns if c not in ("tree", "path")]
    for level in range(len(runs) - 1, -1, -1):
        run, mine = runs[level], carried if level == 0 else []
        joined = run.join(sized(above, PATHS).withColumnRenamed("at", "parent"), ["tree", "parent"])
        children = []
        for i in SLOTS:
            left, right = (F.concat(F.lit(""), *(F.coalesce(f"digest{j}", F.lit("")) for j in side)) for side in (range(i), range(i + 1, FANOUT)))
            own = F.when(F.col("n") == 1, F.array().cast(EDGE)).otherwise(F.array(F.struct(left.alias("left"), right.alias("right"))))
            columns = [F.concat(own, "path").alias("path"), F.col(f"digest{i}").alias("digest"), (F.col("parent") * FANOUT + i).alias("at"), *(F.col(f"{c}{i}").alias(c) for c in mine)]
            children.append(F.when(F.col(f"digest{i}").isNotNull(), F.struct(*columns)))
        child = joined.select("tree", *of_tree, F.explode(F.array_compact(F.array(*children))).alias("child"))
        above = child.select("tree", *of_tree, *(F.col(f"child.{c}").alias(c) for c in ("at", "path", *mine)), *([F.col("child.digest").alias("digest")] if level == 0 else []))
        if level:
            above = tables.written(above, f"{what}-paths{level}")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`.

    Leaves of a lang ascend by doc_id (null first; rows that repeat one by their digest); every `FANOUT` consecutive
    nodes become one until one is left, the subroot; subroots, ordered by lang (null first, bytewise), likewise give
    the root. The proof of a row is what its siblings, level by level, concatenate to. A tampered row's leaf is made
    anew from its changed text and folded up with the siblings of the original; it is verified if that gives the root.
    Null values, empty and very long texts hash like others, rows without a doc_id are not tampered, every repeated
    row is a leaf of its own, an empty table gives no rows, and other columns of `docs` take no part.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "manifest")
    changed = tampered_text(docs)
    leaves = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), leaf(docs, docs["text"]).alias("digest"), F.when(changed.isNotNull(), leaf(docs, changed)).alias("altered"))
    leaves = ordered(tables, leaves, ["lang"], ["doc_id", "digest"], "leaves")
    counts = leaves.groupBy("lang").agg(F.first("n").alias("leaves"))
    trees = tables.written(ordered(tables, counts, [], ["lang"], "langs").select("lang", F.col("at").alias("tree")), "trees")
    shape = counts.agg(F.max("leaves").alias("widest"), F.count("*").alias("trees")).first()
    if not shape.trees:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    trees = sized(trees)
    nodes = leaves.join(trees, leaves["lang"].eqNullSafe(trees["lang"])).select("tree", "at", "n", "digest", "doc_id", "altered")
    runs, tops = climb(tables, nodes, shape.widest, ["doc_id", "altered"], "runs")
    tops = tables.written(tops, "subroots")
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(shape.trees).cast("long").alias("n"), "digest")
    upper_runs, root = climb(tables, upper, shape.trees, [], "upper")
    root = root.first().digest
    bottom = tables.written(spark.range(1).select(F.col("id").alias("tree"), F.array().cast(EDGE).alias("path")), "bottom")
    subroots = descend(tables, upper_runs, bottom, [], "upper").select(F.col("at").alias("tree"), "path", F.col("digest").alias("subroot"))
    found = descend(tables, runs, tables.written(subroots, "tops"), ["doc_id", "altered"], "runs")
    folded = F.aggregate("path", F.coalesce("altered", "digest"), lambda d, edge: hashed(edge["left"], d, edge["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda edge: F.concat(edge["left"], edge["right"])), "").cast("binary"), 256)
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return tables.result(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")


#: Levels that the SQL writes out; enough for FANOUT ** LEVELS leaves of a lang and as many langs.
LEVELS = 9


def oracle_sql() -> str:
    """The manifest in DuckDB SQL: positions by windows, parents by ordered string aggregates, every level written out."""

    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"

    def leaf_sql(text: str) -> str:
        return "sha256(concat(" + ", ".join(enc(text if f == "text" else f) for f in FIELDS) + "))"

    crc = "list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda crc, byte: {}, CAST(4294967295 AS UBIGINT))"
    step = "xor(crc, byte)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v // 2, 3988292384 * (v % 2)))[1]"
    hit = f"xor({crc.format(step)}, CAST(4294967295 AS UBIGINT)) % 3 = 0"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"made AS (SELECT doc_id, lang, {leaf_sql('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {hit} THEN {leaf_sql(lower)} END AS altered FROM documents)",
        "placed AS (SELECT doc_id, leaf, altered, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM made)",
        "a0 AS (SELECT tree, pos, n, leaf AS digest FROM placed)",
    ]
    for name, start in (("a", None), ("b", f"SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, digest FROM a{LEVELS}")):
        if start:
            parts.append(f"{name}0 AS ({start})")
        for k in range(LEVELS):
            parts.append(f"{name}{k + 1} AS (SELECT tree, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k} GROUP BY tree, pos // {FANOUT})")
            # of every node the siblings before and behind it
            run = f"PARTITION BY tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
            parts.append(f"{name}{k}e AS (SELECT tree, pos, n, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
    fold, last = "SELECT *, coalesce(altered, leaf) AS d, '' AS p FROM placed", "f0"
    parts.append(f"f0 AS ({fold})")
    step_no = 0
    for name in "ab":
        for k in range(LEVELS):
            step_no += 1
            at = f"f.pos // {FANOUT ** k}" if name == "a" else f"f.tree // {FANOUT ** k}"
            tree = "f.tree" if name == "a" else "0"
            parts.append(f"f{step_no} AS (SELECT f.* REPLACE (CASE WHEN e.n = 1 THEN f.d ELSE sha256(concat(e.l, f.d, e.r)) END AS d, concat(f.p, e.l, e.r) AS p) FROM {last} f JOIN {name}{k}e e ON e.tree = {tree} AND e.pos = {at})")
            last = f"f{step_no}"
    return f"""WITH {", ".join(parts)} SELECT f.doc_id, f.leaf, s.digest AS subroot, t.digest AS root, sha256(f.p) AS proof_sha256, f.d AS folded_root, f.d = t.digest AS verified FROM {last} f JOIN a{LEVELS} s ON s.tree = f.tree CROSS JOIN b{LEVELS} t"""
