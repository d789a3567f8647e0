"""N-gram Jaccard join with prefixes under several global token orders.

Documents are sets of word shingles. If two sets are similar enough, their prefixes share a shingle under
every global order of shingles. Prefixes under all orders are taken in one pass: those of the first order
(rare before frequent, then by hash) become postings and find candidates, those of the others are kept as
fingerprints. A candidate must share a prefix shingle under every order before texts move to be compared.

Links are needed for components, not as a list of all pairs, so work need not follow the square of a group:
lists of the first order are linked as stars, the components found are contracted, and only documents in
different components are looked at further. Those meet in their lists only where their places there leave
room for enough shared shingles. In the end no pair that may be similar enough is left unverified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, bucketed, mix, n_buckets, needed_only, shingle_sets, sized
from .graph import components

#: Text that shares one packed row of an exchange.
FLUSH = 4 << 20
#: Frequent shingles known to every task: at most this many, 9 bytes each; the rest counts as rare.
FREQUENT_MOST = 1_000_000
#: Fewest documents of a frequent shingle.
FREQUENT_LEAST = 4
#: Orders of shingles; the first finds candidates, the others filter them.
ORDERS = 3
#: The first round of stars uses one list in so many.
STARS = 8

_WIDE = np.uint64(40)


def prefix_size(n: int, num: int, den: int) -> int:
    """Shingles of a set of n among which a set of Jaccard similarity num/den shares at least one."""
    return n - -(-num * n // den) + 1


class _Slab:
    """Distinct sets of some documents; equal sets are linked here and stand for one."""

    def __init__(self):
        self.clear()

    def by_doc(self) -> None:
        """Sets in the order of their documents."""
        order = sorted(range(len(self.docs)), key=self.docs.__getitem__)
        self.docs, self.sets = [self.docs[i] for i in order], [self.sets[i] for i in order]

    def clear(self) -> None:
        self.bytes, self.by_digest, self.links = 0, {}, []
        self.docs: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sizes: list[tuple[int, int]] = []

    def add(self, doc: int, s: np.ndarray, size: int) -> None:
        """A document's set, and the bytes of its text."""
        self.bytes += size + 64
        self.sizes.append((doc, len(s)))
        if len(s):
            first = self.by_digest.setdefault(xxhash.xxh3_128_digest(s.tobytes()), doc)
            if first != doc:
                self.links.append((first, doc))
            else:
                self.docs.append(doc)
                self.sets.append(s)


def _slabs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Slab]:
    slab = _Slab()
    for batch in batches:
        texts = batch.column("text")
        sizes = pc.binary_length(texts).fill_null(0).to_pylist()
        for doc, s, size in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts, width), sizes, strict=True):
            if doc is not None:
                slab.add(doc, s, size)
            if slab.bytes >= FLUSH:
                yield slab
                slab.clear()
    if slab.sizes:
        yield slab


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_low_bytes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").reshape(-1)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    # numpy sorts short integers by radix
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    if len(order):
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), part


def frequent_shingles(docs: DataFrame, width: int, buckets: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, as sorted fingerprints, with the binary logarithm of their counts over all documents.

    Every shingle of every distinct set of a slab is counted, by a fingerprint of 24 bits within its bucket;
    buckets follow the data, so fingerprints collide as rarely at any size. A collision moves a shingle in
    the order of all documents alike and costs no result. At most FREQUENT_MOST of the counts come back.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _slabs(batches, width):
            if slab.sets:
                s = np.concatenate(slab.sets)
                bucket = (s % np.uint64(buckets)).astype(np.int64)
                parts = list(_by_bucket(bucket))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in parts], pa.int64()), "prints": pa.array([_low_bytes(s[p] >> _WIDE, 3) for _, p in parts], pa.binary())})

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        prints, times = np.unique(_from_low_bytes(b"".join(frame["prints"]), 3), return_counts=True)
        some = times >= FREQUENT_LEAST
        level = np.floor(np.log2(times[some])).astype(np.uint8)
        bucket = int(frame["bucket"].iloc[0])
        parts = [(bucket, int(v), int((level == v).sum()), prints[some][level == v].astype("<u4").tobytes()) for v in np.unique(level)]
        return pd.DataFrame(parts, columns=["bucket", "level", "n", "prints"])

    counted = bucketed(docs.mapInArrow(send, "bucket long, prints binary"), buckets).applyInPandas(count, "bucket long, level int, n long, prints binary")
    counted = tables.written(counted, "frequent")
    room, least = FREQUENT_MOST, 64
    for r in sorted(counted.groupBy("level").agg(F.sum("n").alias("n")).collect(), reverse=True):
        if r.n > room:
            break
        room, least = room - r.n, r.level
    rows = counted.where(F.col("level") >= least).collect()  # FREQUENT_MOST shingles at most
    keys = [(np.uint64(r.bucket) << np.uint64(24)) | np.frombuffer(r.prints, "<u4").astype(np.uint64) for r in rows]
    levels = [np.full(r.n, r.level, np.uint8) for r in rows]
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    keys, levels = np.concatenate(keys), np.concatenate(levels)
    order = np.argsort(keys)
    return keys[order], levels[order]


def _levels(s: np.ndarray, buckets: int, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(s), np.uint64)
    own = ((s % np.uint64(buckets)) << np.uint64(24)) | (s >> _WIDE)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, levels[at], 0).astype(np.uint64)


def _rank_keys(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of shingles in the first global order: rarer levels first, then by hash. They fit a signed number."""
    return (level << np.uint64(57)) | (mix(s, 0) >> np.uint64(7))


POSTING, STAR, DOC, LINK = 0, 1, 2, 3


def _prefixes(s: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """A set's prefixes under each order but the first, as places; these are orders by hash."""
    if not len(s):
        return [s] * (ORDERS - 1)
    size = prefix_size(len(s), num, den)
    return [np.partition(mix(s, order), size - 1)[:size] for order in range(1, ORDERS)]


def _index(docs: DataFrame, width: int, num: int, den: int, buckets: int, frequent) -> DataFrame:
    """One table (kind, x, y, z, prints): postings (shingle, doc) of prefix shingles that two documents share, candidate
    stars (a, b, shared lists), documents (doc, size, last prefix place, 16-bit fingerprints of the other prefixes) and
    links of equal sets (a, b)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = frequent.value
        for slab in _slabs(batches, width):
            last = {}
            rows: dict[str, list] = {k: [] for k in ("bucket", "base", "wide", "prints", "docs", "shared", "known_prints", "known_docs", "facts", "others")}
            others = b""
            facts = [(LINK, a, b, 0) for a, b in slab.links]
            if slab.sets:
                slab.by_doc()
                n = np.array([len(s) for s in slab.sets], np.int64)
                s = np.concatenate(slab.sets)
                place = _rank_keys(s, _levels(s, buckets, keys, levels))
                starts, size = np.cumsum(n) - n, n - -(-num * n // den) + 1
                ends = starts + n
                chosen = np.concatenate([a + np.argpartition(place[a:b], k - 1)[:k] for a, b, k in zip(starts.tolist(), ends.tolist(), size.tolist(), strict=True)])
                cuts = np.cumsum(size) - size
                last = dict(zip(slab.docs, np.maximum.reduceat(place[chosen], cuts).astype(np.int64).tolist(), strict=True))
                others = b"".join([p.astype("<u2").tobytes() for one in slab.sets for p in _prefixes(one, num, den)])
                ids, doc = mix(s[chosen], 7), np.repeat(np.array(slab.docs, np.int64), size)
                bucket, prints = (ids % np.uint64(buckets)).astype(np.int64), ids >> np.uint64(24)
                # documents ascend already, so a stable sort by shingle is enough
                order = np.argsort((bucket.astype(np.uint64) << _WIDE) | prints, kind="stable")
                bucket, prints, doc = bucket[order], prints[order], doc[order]
                new = np.append(True, (prints[1:] != prints[:-1]) | (bucket[1:] != bucket[:-1]))
                of_list = np.cumsum(new) - 1
                shared = np.bincount(of_list) > 1
                star = ~new & (mix(prints, 3) % np.uint64(STARS) == 0)
                heads = doc[new][of_list]
                pairs, times = np.unique(np.stack((heads[star], doc[star])), axis=1, return_counts=True)
                facts += [(STAR, a, b, t) for a, b, t in zip(*pairs.tolist(), times.tolist(), strict=True)]
                # ids as 32-bit distances from the smallest where they fit
                base = int(doc.min())
                kind = np.uint32 if int(doc.max()) - base < 1 << 32 else np.int64
                base = base if kind is np.uint32 else 0
                firsts, rest = np.flatnonzero(new), np.flatnonzero(~new)
                known = {b: rest[part] for b, part in _by_bucket(bucket[rest])}
                for b, part in _by_bucket(bucket[firsts]):
                    own, more = firsts[part], known.get(b, rest[:0])
                    rows["bucket"].append(b)
                    rows["base"].append(base)
                    rows["prints"].append(_low_bytes(prints[own], 5))
                    rows["docs"].append((doc[own] - base).astype(kind).tobytes())
                    rows["shared"].append(shared[of_list[own]].tobytes())
                    rows["known_prints"].append(_low_bytes(prints[more], 5))
                    rows["known_docs"].append((doc[more] - base).astype(kind).tobytes())
                    rows["wide"].append(kind is np.int64)
                    rows["facts"].append(b"")
                    rows["others"].append(b"")
            # documents with fingerprints first, in the fingerprints' order
            size_of = dict(slab.sizes)
            facts = [(DOC, doc, size_of[doc], last[doc]) for doc in slab.docs] + facts + [(DOC, doc, size, -1) for doc, size in slab.sizes if doc not in last]
            # facts ride along in a bucket of their own choice
            rows["bucket"].append(slab.sizes[0][0] % buckets)
            for k in ("prints", "docs", "shared", "known_prints", "known_docs"):
                rows[k].append(b"")
            rows["base"].append(0)
            rows["wide"].append(False)
            rows["facts"].append(np.array(facts, np.int64).tobytes())
            rows["others"].append(others)
            yield pa.RecordBatch.from_pydict(rows, schema)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])

        def numbers(column: str) -> np.ndarray:
            parts = [np.frombuffer(b, np.int64 if wide else np.uint32).astype(np.int64) + base for b, base, wide in zip(frame[column], frame["base"], frame["wide"], strict=True)]
            return np.concatenate(parts)

        prints, doc = _from_low_bytes(b"".join(frame["prints"]), 5), numbers("docs")
        shared = np.frombuffer(b"".join(frame["shared"]), bool)
        order = np.lexsort((doc, prints))
        prints, doc, shared = prints[order], doc[order], shared[order]
        out = [np.frombuffer(b"".join(frame["facts"]), np.int64).reshape(-1, 4)]
        fingerprints = []
        for facts, others in zip(frame["facts"], frame["others"], strict=True):
            ends = 2 * (ORDERS - 1) * np.cumsum([prefix_size(n, num, den) for kind, _, n, last in np.frombuffer(facts, np.int64).reshape(-1, 4).tolist() if kind == DOC and last >= 0])
            fingerprints += [others[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            fingerprints += [None] * (len(facts) // 32 - len(ends))
        if len(doc):
            new = np.append(True, prints[1:] != prints[:-1])
            of_list = np.cumsum(new) - 1
            keep = shared | (np.bincount(of_list) > 1)[of_list]
            star = ~new & (mix(prints, 3) % np.uint64(STARS) == 0)
            pairs, times = np.unique(np.stack((doc[new][of_list][star], doc[star])), axis=1, return_counts=True)
            out.append(np.stack((np.full(len(times), STAR), *pairs, times), 1))
            more, docs_ = _from_low_bytes(b"".join(frame["known_prints"]), 5), numbers("known_docs")
            all_prints, all_docs = np.append(prints[keep], more).astype(np.int64), np.append(doc[keep], docs_)
            out.append(np.stack((np.full(len(all_docs), POSTING), (bucket << 40) | all_prints, all_docs, np.zeros(len(all_docs), np.int64)), 1))
        out = pd.DataFrame(np.concatenate(out), columns=["kind", "x", "y", "z"])
        return out.assign(prints=pd.Series(fingerprints + [None] * (len(out) - len(fingerprints)), dtype=object))

    schema = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("wide", pa.bool_()), *((k, pa.binary()) for k in ("prints", "docs", "shared", "known_prints", "known_docs", "facts", "others"))])
    sent = docs.mapInArrow(send, "bucket long, base long, wide boolean, prints binary, docs binary, shared binary, known_prints binary, known_docs binary, facts binary, others binary")
    return bucketed(sent, buckets).applyInPandas(merge, "kind long, x long, y long, z long, prints binary")


def _filtered(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share a fingerprint under every order but the first, which they share a shingle under already."""
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    prints = needed_only(facts.select("doc", "prints"), ids, "doc")
    both = pairs.join(prints.select(F.col("doc").alias("a"), F.col("prints").alias("prints_a")), "a").join(prints.select(F.col("doc").alias("b"), F.col("prints").alias("prints_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(batch.column("prints_a").to_pylist(), batch.column("prints_b").to_pylist(), strict=True):
                orders = (np.frombuffer(b, "<u2").reshape(ORDERS - 1, -1) for b in (mine, theirs))
                keep.append(all(np.isin(p, q).any() for p, q in zip(*orders, strict=True)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "prints_a", "prints_b").mapInArrow(check, "a long, b long")


def _verified(docs: DataFrame, facts: DataFrame, pairs: DataFrame, width: int, num: int, den: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) that are similar enough. Texts meet in a join that Spark can split where one document has many partners."""
    pairs = tables.written(_filtered(pairs, facts), "filtered")
    texts = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # 500,000 pairs are 8 MB
    right = other.join(F.broadcast(pairs) if pairs.count() <= 500_000 else pairs.hint("merge"), "b")
    left = needed_only(texts, pairs.select("a").distinct(), "a")
    both = right.join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            # a document with many partners is read once
            _, first, which = np.unique(batch.column("a").to_numpy(), return_index=True, return_inverse=True)
            own, others = shingle_sets(batch.column("text_a").take(pa.array(first)), width), shingle_sets(batch.column("text_b"), width)
            for a, b, i, theirs in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), which.tolist(), others, strict=True):
                mine = own[i]
                same = len(np.intersect1d(mine, theirs, assume_unique=True))
                if same and den * same >= num * (len(mine) + len(theirs) - same):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _own_ids(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """`docs` with an id for every row, and (doc_id, node) of the rows that share their doc_id and so got one above all others."""
    shared = tables.written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    if shared.isEmpty():
        return docs, None
    top = docs.agg(F.max("doc_id").alias("top")).first().top
    node = F.when(F.col("again"), F.monotonically_increasing_id() + (top + 1)).otherwise(F.col("doc_id"))
    rows = tables.written(docs.join(sized(shared), "doc_id", "left").select("doc_id", node.alias("node"), "again", "text"), "rows")
    return rows.select(F.col("node").alias("doc_id"), "text"), rows.where("again").select("doc_id", "node")


def join_components(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text): components of Jaccard links of at least num/den.

    Null and empty texts have no shingles and are linked with nothing; a text of fewer words than `width` is
    one shingle. Equal sets are linked. Rows that repeat a doc_id are one document: each row is a set of its own
    while links are sought, and the document has the links of all of them; each row has its own number of
    shingles. Rows without a doc_id are left out.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "ngram")
    docs, again = _own_ids(docs.select(F.col("doc_id").cast("long"), "text"), tables)
    buckets = n_buckets(docs)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width, buckets, tables))
    measure = (width, num, den)
    index = tables.written(_index(docs, *measure, buckets, frequent), "index")
    postings = index.where(F.col("kind") == POSTING).select(F.col("x").alias("token"), F.col("y").alias("doc"))
    facts = index.where(F.col("kind") == DOC).select(F.col("x").alias("doc"), F.col("y").alias("n"), F.col("z").alias("last"), "prints")
    links = index.where(F.col("kind") == LINK).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if again is not None:
        links = links.unionByName(again.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))

    # each document against the head of the lists it shares most
    stars = index.where((F.col("kind") == STAR) & (F.col("x") != F.col("y"))).groupBy("x", "y").agg(F.sum("z").alias("z"))
    best = stars.groupBy("y").agg(F.max_by("x", F.struct("z", (-F.col("x")).alias("x"))).alias("a")).select("a", F.col("y").alias("b"))
    tried = tables.written(best, "tried")
    links = tables.written(links.unionByName(_verified(docs, facts, tried, *measure, tables)), "links")

    # components against each other: one pair for each component and list with a larger component in it
    comps = tables.written(components(links, tables), "comps")
    # a list of one component stays one, so only the others are looked at from here on
    opened = tables.written(_open_lists(postings, comps), "open")
    groups = opened.groupBy("token", "comp").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    heads = groups.groupBy("token").agg(F.max(F.struct("n", "comp", "doc")).alias("head")).where(F.col("head.n") > 1)
    pairs = groups.join(heads, "token").where(F.col("comp") != F.col("head.comp"))
    pairs = pairs.select(F.least("doc", "head.doc").alias("a"), F.greatest("doc", "head.doc").alias("b")).distinct()
    pairs = tables.written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    tried = tables.written(tried.unionByName(pairs), "tried")
    links = tables.written(links.unionByName(_verified(docs, facts, pairs, *measure, tables)), "links")

    # all that is left: every pair of documents in different components that may still be similar enough
    comps = tables.written(components(links, tables), "comps")
    pairs = tables.written(candidates(_open_lists(opened.select("token", "doc"), comps), facts, num, den).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = tables.written(links.unionByName(_verified(docs, facts, pairs, *measure, tables)), "links")
        comps = components(links, tables)
    out = facts.select("doc", F.col("n").alias("n_shingles")).join(comps, "doc", "left")
    if again is not None:
        out = out.join(again, out["doc"] == again["node"], "left")
    name = F.coalesce("doc_id", "doc") if again is not None else F.col("doc")
    return tables.result(out.select(name.alias("doc_id"), "n_shingles", F.coalesce("comp", name).alias("component_id")), "near")


def candidates(listed: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): every pair of documents of different components that share a prefix shingle and may be similar enough.

    `listed` (token, doc, comp) holds the lists with more than one component. All prefix shingles are put in one
    more order: those in no such list first, then by the length of their lists. Take of a pair the document whose
    prefix ends first: its prefix shingles are shared with the other's prefix or not at all. Of those none is
    shared before the first list the two have in common, so its place there bounds the intersection. A row is
    made only where that bound suffices, so members of a group whose own shingles come first meet hardly ever.
    """
    lists = listed.groupBy("token").agg(F.count("*").alias("length"))
    sizes = facts.select("doc", "n", "last", (F.col("n") - F.ceil(F.col("n") * num / den) + 1).alias("prefix"))
    in_doc = Window.partitionBy("doc")
    rows = listed.join(lists, "token").join(sizes, "doc").withColumn("place", F.row_number().over(in_doc.orderBy("length", "token")) + F.col("prefix") - F.count("*").over(in_doc))
    rows = rows.select("token", "doc", "comp", "n", "last", (F.col("n") - F.col("place") + 1).alias("room"))
    one, two = (rows.select("token", *(F.col(c).alias(f"{c}_{x}") for c in rows.columns[1:])) for x in "ab")
    shared = F.least("room_a", "n_a", "n_b")
    first = (F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (F.col("doc_a") < F.col("doc_b")))
    pairs = one.join(two, (one["token"] == two["token"]) & (F.col("comp_a") != F.col("comp_b")) & first & (den * shared >= num * (F.col("n_a") + F.col("n_b") - shared)))
    return pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def _open_lists(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """(token, doc, comp) of the lists that still hold more than one component."""
    listed = postings.join(sized(comps), "doc", "left").select("token", "doc", F.coalesce("comp", "doc").alias("comp"))
    mixed = listed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    return listed.join(mixed, "token", "left_semi").distinct()
