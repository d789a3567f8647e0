"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: the number of words of a line, then its leading words; words with a digit are
variable fields and read as <*>. A leaf holds any number of templates: a template is a line of which one
quarter of the words is a variable field, so lines share it if their other three quarters are the same. Of
the templates that a line could have it takes the one that occurs in most documents. Lines whose template
recurs across documents are dropped, all but the first.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, written

#: Leading words that lead to a leaf.
DEPTH = 3
#: Shorter lines are never dropped: they recur by chance.
MIN_WORDS = 5
#: Documents in which a template must occur.
MIN_DOCS = 3


def _parsed(docs: DataFrame, depth: int, min_words: int) -> DataFrame:
    """(doc_id, pos, leaf, q1..q4) of the lines with enough words; texts stay behind, as hashes."""
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # most lines need neither rewriting
    spaced = reduce(or_, (F.col("line").contains(x) for x in ("  ", "\t", "\r", "\f", "\x0b")))
    lines = lines.select("doc_id", "pos", F.trim(F.when(spaced, F.regexp_replace("line", "[ \\t\\r\\f\\x0B]+", " ")).otherwise(F.col("line"))).alias("line"))
    lines = lines.select("doc_id", "pos", F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", "[^ 0-9]*[0-9][^ ]*", "<*>")).otherwise(F.col("line")).alias("line"))
    lines = lines.withColumn("n", F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)).where(F.col("n") >= min_words)
    heads = [F.expr(f"substring_index(line, ' ', cast(floor(n * {i} / 4) as int))") for i in range(5)]
    quarters = [F.xxhash64(F.substr("line", F.length(a) + 1, F.length(b) - F.length(a))).alias(f"q{i + 1}") for i, (a, b) in enumerate(zip(heads, heads[1:], strict=False))]
    return lines.select("doc_id", "pos", F.xxhash64("n", F.substring_index("line", " ", depth)).alias("leaf"), *quarters)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, pos) of the lines to drop."""
    quarters = ["q1", "q2", "q3", "q4"]
    keys = written(_parsed(docs, depth, min_words), "lines")
    # a leaf that fewer documents have holds nothing to drop
    leaves = keys.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    open_ = keys.join(sized(written(leaves, "leaves")), "leaf", "left_semi")
    templates = F.array(*(F.xxhash64("leaf", F.lit(k), *(q for q in quarters if q != left_out)) for k, left_out in enumerate(quarters)))
    possible = open_.select("doc_id", "pos", F.posexplode(templates).alias("k", "template"))
    # counted by document first, so a very common line is no hot key
    counts = possible.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # the most frequent, then the first of the four
    best = F.max_by("template", 4 * F.col("n") - F.col("k")).alias("template")
    named = written(possible.join(sized(written(counts, "templates")), "template").groupBy("doc_id", "pos").agg(best), "named")
    per_doc = named.groupBy("template", "doc_id").agg(F.min("pos").alias("pos"))
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where(F.col("n") >= min_docs)
    found = named.join(sized(written(recurring, "recurring")), "template")
    return found.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos"))).select("doc_id", "pos")


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """`docs` with recurring lines taken out of `text`, and the numbers of its lines and of those dropped under the names `counts`.

    Null texts stay null (0 lines); an empty text is one empty line. Rows without a doc_id are left as they
    are. Rows that repeat a doc_id count as one document; each keeps or loses the same line numbers.
    """
    drop = recurring_lines(docs, depth, min_words, min_docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    joined = docs.join(drop, "doc_id", "left")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    joined = joined.withColumn(counts[0], F.when(F.col("text").isNull(), 0).otherwise(n_lines))
    # a row that repeats an id may have fewer lines
    joined = joined.withColumn("__drop", F.filter("__drop", lambda p: p < F.col(counts[0])))
    joined = joined.withColumn(counts[1], F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size("__drop")), F.lit(0)))

    def kept(row: Column) -> Column:
        """The lines between neighbouring cuts, in one pass over a text of any number of lines."""
        between = F.transform(F.sequence(F.lit(0), F.size(row["cuts"]) - 2), lambda i: F.slice(row["lines"], F.get(row["cuts"], i) + 2, F.get(row["cuts"], i + 1) - F.get(row["cuts"], i) - 1))
        return F.array_join(F.flatten(between), "\n")

    # bound as an argument, so that neither is evaluated again for each cut
    row = F.struct(F.split("text", "\n").alias("lines"), F.concat(F.array(F.lit(-1)), "__drop", F.array(counts[0])).alias("cuts"))
    text = F.when(F.size("__drop") > 0, F.get(F.transform(F.array(row), kept), F.lit(0))).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*(c for c in docs.columns if c not in counts), *counts)


def oracle_sql(depth: int = DEPTH, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS) -> str:
    """The same in DuckDB, on words instead of hashes."""
    return f"""
WITH raw AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), words AS (
  SELECT doc_id, pos, string_split(regexp_replace(trim(regexp_replace(line, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' '), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g'), ' ') AS w FROM raw
), keys AS (
  SELECT doc_id, pos, len(w) AS n, w[1:{depth}] AS head, w,
    w[1:len(w) // 4] AS q1, w[len(w) // 4 + 1:len(w) * 2 // 4] AS q2, w[len(w) * 2 // 4 + 1:len(w) * 3 // 4] AS q3, w[len(w) * 3 // 4 + 1:] AS q4
  FROM words WHERE len(w) >= {min_words}
), leaves AS (
  SELECT n, head FROM keys GROUP BY n, head HAVING count(DISTINCT doc_id) >= {min_docs}
), possible AS (
  {" UNION ALL ".join(f"SELECT doc_id, pos, {k} AS k, n, head, {a} AS a, {b} AS b, {c} AS c FROM keys SEMI JOIN leaves USING (n, head)" for k, (a, b, c) in enumerate((("q2", "q3", "q4"), ("q1", "q3", "q4"), ("q1", "q2", "q4"), ("q1", "q2", "q3"))))}
), counts AS (
  SELECT k, n, head, a, b, c, count(DISTINCT doc_id) AS docs FROM possible GROUP BY k, n, head, a, b, c HAVING count(DISTINCT doc_id) >= {min_docs}
), named AS (
  SELECT doc_id, pos, (k, n, head, a, b, c) AS template FROM possible JOIN counts USING (k, n, head, a, b, c) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY docs DESC, k) = 1
), recurring AS (
  SELECT template, min(doc_id) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= {min_docs}
), dropped AS (
  SELECT m.doc_id, m.pos FROM named m JOIN recurring r ON m.template = r.template WHERE m.doc_id <> r.first_doc OR m.pos <> r.first_pos
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (WHERE d.pos IS NULL) AS text, count(*) AS n_lines, count(d.pos) AS n_dropped
  FROM raw r LEFT JOIN dropped d ON r.doc_id = d.doc_id AND r.pos = d.pos GROUP BY r.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS INTEGER) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
