"""Each corpus operator against a plain version of itself, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlake.llm import chunks, common, decontaminate, graph, licenses, lines, ngram_join, packing, quality, queries, repeats, topk_search, toxicity
from runlake.llm.tokens import TokenIds

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, comp long, x string, bucket int"


@pytest.fixture(scope="module", autouse=True)
def batches(spark):
    common.small_batches(spark)


def table(spark, texts, start=0):
    """A documents table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or ""), 7, "y", 1) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(11)
    base, passage, boiler = words(rng, 120), words(rng, 60), words(rng, 30, 20)
    texts = [None, "", " \n\t", "one", "one", "one two three", "ONE two THREE", base, base, base.upper(), "a" * 700, "ab" * 400, "é" * 300 + base]
    for i in range(40):  # near copies
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    for _ in range(25):  # texts that share a passage
        texts.append(words(rng, rng.randrange(30, 120)) + " " + passage + "\n" + words(rng, 20))
    texts += [boiler + " " + words(rng, 3) for _ in range(10)]
    texts += [words(rng, 4000), words(rng, 9)]
    return texts


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def naive_components(sets):
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in sets}


def test_ngram_join(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "FLUSH", 4000)  # many slabs even here
    sets = {i: shingle_set(t) for i, t in enumerate(odd_texts)}
    want = naive_components(sets)
    got = {r.doc_id: r for r in ngram_join.join_components(table(spark, odd_texts).repartition(5)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert ngram_join.join_components(table(spark, [])).count() == 0


def test_ngram_join_at_the_threshold(spark):
    """Sets with exactly 75 shingles of 100 in common are linked, 74 of 100 are not."""
    base = [f"t{i}" for i in range(79)]  # 75 shingles
    texts = [" ".join([*base, *(f"x{k}y{i}" for i in range(n))]) for k, n in enumerate((25, 0, 26))]
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(table(spark, texts)).collect()}
    assert got == naive_components({i: shingle_set(t) for i, t in enumerate(texts)}) == {0: 0, 1: 0, 2: 2}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    got = {r.doc: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {x: x for pair in links for x in pair}
    for _ in range(200):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert all(got.get(i, i) == c for i, c in comp.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefixes_share_a_shingle_under_every_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 75 * (len(a) + len(b) - same):
            for p, q in zip(ngram_join._prefixes(a, 75, 100), ngram_join._prefixes(b, 75, 100), strict=True):
                assert np.isin(p, q).any()


def naive_chunks(texts, min_run):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        starts = chunks.cuts(np.frombuffer(raw, np.uint8))
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        rep = []
        for a, b in zip(starts, ends, strict=True):
            rep.append(raw[a:b] in seen)
            seen.add(raw[a:b])
        keep, i = np.ones(len(raw), bool), 0
        while i < len(rep):
            j = i
            while j < len(rep) and rep[j]:
                j += 1
            if j > i and ends[j - 1] - starts[i] >= min_run:
                keep[starts[i] : ends[j - 1]] = False
            i = max(j, i + 1)
        out.append((len(starts), sum(rep), len(raw), int((~keep).sum())))
    return out


def test_chunks(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(chunks, "FLUSH", 3000)
    got = {r.doc_id: r for r in chunks.dedup_substrings(table(spark, odd_texts).repartition(3)).collect()}
    assert [(r.n_chunks, r.n_repeated, r.n_bytes, r.n_removed) for _, r in sorted(got.items())] == naive_chunks(odd_texts, chunks.MIN_RUN)
    assert got[0].text is None and got[1].text == "" and got[8].text == ""
    assert chunks.dedup_substrings(table(spark, [])).count() == 0


def test_chunks_follow_the_content():
    raw = np.random.default_rng(2).integers(32, 127, 20_000, dtype=np.uint8)
    shifted = np.concatenate([raw[:50], np.frombuffer(b"inserted", np.uint8), raw[50:]])
    a, b = ({bytes(x[s:e]) for s, e in zip(c, [*c[1:], len(x)], strict=True)} for x, c in ((raw, chunks.cuts(raw)), (shifted, chunks.cuts(shifted))))
    assert len(a & b) > 0.98 * len(a)
    assert all(np.diff(np.append(chunks.cuts(raw), len(raw))) <= chunks.MOST)
    h = [0]
    for c in raw[:40].tolist():  # the doubling gives what rolling does
        h.append(((h[-1] << 1) + int(chunks._GEAR[c])) & 0xFFFFFFFF)
    places = [i for i in range(1, 40) if h[i] & 0xF000 == 0]
    assert set(chunks.cuts(raw[:40])[1:]) <= set(places)


def naive_lines(texts):
    """The log-template tree with plain loops."""
    parsed = []
    for doc, t in enumerate(texts):
        for pos, line in enumerate(t.split("\n") if t is not None else []):
            w = [re.sub(r"[^ ]*[0-9][^ ]*", "<*>", x) for x in re.sub(r"[ \t\r\f\v]+", " ", line).strip(" ").split(" ")]
            if len(w) >= lines.MIN_WORDS:
                parsed.append((doc, pos, tuple(w)))
    in_leaf, docs_of = {}, {}
    for doc, _, w in parsed:
        in_leaf.setdefault((len(w), w[:3]), set()).add(doc)
    possible = {}
    for doc, pos, w in parsed:
        leaf = (len(w), w[:3])
        cut = [len(w) * i // 4 for i in range(5)]
        for k in range(4) if len(in_leaf[leaf]) >= lines.MIN_DOCS else ():
            template = (k, leaf, *(w[cut[i] : cut[i + 1]] for i in range(4) if i != k))
            docs_of.setdefault(template, set()).add(doc)
            possible.setdefault((doc, pos), []).append(template)
    groups = {}
    for at, templates in possible.items():
        best = min(templates, key=lambda t: (-len(docs_of[t]), t[0]))
        groups.setdefault(best, []).append(at)
    dropped = set()
    for at in groups.values():
        if len({d for d, _ in at}) >= lines.MIN_DOCS:
            dropped |= set(at) - {min(at)}
    return dropped


def test_lines(spark):
    rng = random.Random(5)
    texts = [None, "", "\n\n", "short line", "é \t x"]
    for i in range(40):
        own = [words(rng, rng.randrange(3, 14), 30) for _ in range(4)]
        own.insert(rng.randrange(4), f"Order {i} was shipped to customer c{i * 7} on day {i % 9}")
        own.insert(rng.randrange(4), "All rights are reserved by the usual owners" + rng.choice(["", "  ", "\t"]))
        own.insert(rng.randrange(4), f"The value of the thing is {rng.choice('abc')} and no more here today")
        own.insert(rng.randrange(4), f"The value of the other one was never {rng.choice('abcdefghijkl')} before")
        texts.append("\n".join(own))
    texts += texts[5:9]
    want = naive_lines(texts)
    got = {r.doc_id: r for r in lines.drop_recurring_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in want)
        assert (got[i].text, got[i].n_dropped) == (kept, sum(d == i for d, _ in want))
    assert lines.drop_recurring_lines(table(spark, [])).count() == 0
    assert got[5].source == "s" and got[5].comp == 7


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = docs.limit(0).unionByName(table(spark, [None, "", "x" * 300_000], 10**7).select(*docs.columns))
    got = quality.classify(docs.unionByName(odd), labels, common.crc_bucket("doc_id", 3) != 1)
    known = got.join(labels, "doc_id").where(common.crc_bucket("doc_id", 3) == 1).toPandas()
    assert ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.9
    all_ = got.toPandas()
    assert all_.score.between(0, 1).all() and len(all_) == docs.count() + 3
    none = quality.classify(docs, labels.limit(0), F.lit(True)).toPandas()
    assert (none.score == 0.5).all()


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, 5)) for n in (1, 4, 3)]
    net = quality.fit(bags, np.array([1.0, 0.0, 1.0]), hidden=4, gate=3, epochs=1)
    x, starts, y, weight = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0]), np.ones(3)
    g = net._gradient(x, starts, y, weight)

    def loss():
        s = net._forward(x, starts)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k in net.p:
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], abs=1e-6)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).round(1)
    v[50:120] = v[50]  # very many ties
    rows = [(i, [float(x) for x in r], i) for i, r in enumerate(v)] + [(1000, None, 0), (1001, [float("nan")] * 6, 0), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1003, [], 0)]
    df = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), "vec_id", "embedding")
    q = np.floor(1024 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        best = sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = topk_search.top_k(df, df.where(F.col("vec_id") % 20 == 0), 10, block=8)
    assert sorted(map(tuple, got.collect())) == want
    few = topk_search.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 10).collect()
    assert [r.vec_id for r in few] and len(few) == 2
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_tokens_are_the_tokenizer_s():
    text, pattern = queries.tokenizer_file()
    ids = TokenIds(text, pattern, most=50)
    odd = ["It's <|endoftext|> x", "a\x1cb c d\u0085e f　g", "İstanbul ΣΑΣ ǅ ﬁ é ́x", "they'll'd 're \"we're!!'s\" x's1234", "", "  ", "日本 한국 Å Å"]
    for t in odd * 2:
        assert np.frombuffer(ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids
    assert ids(None) == b""


def best_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - s)
    return len(room)


def test_packing(spark, odd_texts):
    text, pattern = queries.tokenizer_file()
    docs = table(spark, [*odd_texts, words(random.Random(8), 9000)])
    rows = packing.pack_documents(docs, text, pattern, 256).collect()
    plain = TokenIds(text).tokenizer
    want = []
    for r in docs.collect():
        all_ = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, n, a, len(all_[a : a + 256]), zlib.crc32(all_[a : a + 256].tobytes())) for n, a in enumerate(range(0, len(all_), 256))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= best_fit_decreasing([r.length for r in rows], 256)
    assert packing.pack_documents(table(spark, []), text, pattern).count() == 0


def test_packing_in_many_shards(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 900) for _ in range(1500)] + [1000] * 20
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    rows = packing.pack(pieces, 1000, shard=500).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1000 and len(fill) <= 1.02 * best_fit_decreasing(sizes, 1000)


def test_crossover_places_every_piece_once():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 90, 200))[::-1].astype(np.int32)
    a, b = (packing.evolve(sizes, [], 100, s)[-1] for s in (1, 2))
    for _ in range(20):
        child = packing.crossover(sizes, a, b, 100, rng)
        assert len(child) == 200 and np.bincount(child, sizes).max() <= 100 and len(np.unique(child)) == child.max() + 1


def naive_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        m = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            k = raw[i : i + length]
            if k in seen:
                m[i : i + length] = True
            seen.add(k)
        kept = bytes(np.frombuffer(raw, np.uint8)[~m])
        out.append((len(raw), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats(spark, odd_texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "FLUSH", 3000)
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = table(spark, odd_texts).repartition(3)
    got = [tuple(r)[1:] for r in sorted(repeats.dedup_repeats(docs).collect())]
    assert got == naive_repeats(odd_texts, 100)
    kept = repeats.dedup_repeats(docs, with_text=True).where("doc_id = 8").first()
    assert kept.kept == b"" and kept.n_removed == kept.n_bytes
    assert repeats.dedup_repeats(table(spark, [])).count() == 0


def test_repeats_across_blocks_of_a_text(monkeypatch):
    raw = np.random.default_rng(5).integers(97, 100, 3000, dtype=np.uint8)
    whole = repeats.segments(raw)
    monkeypatch.setattr(repeats, "BLOCK", 500)
    parts = repeats.segments(raw)
    expand = lambda s: [(int(g), p) for g, a, b in zip(*s, strict=True) for p in range(a, b + 1)]
    assert expand(whole) == expand(parts)


def test_maximal_repeats():
    texts = [b"xabcdefy", b"zabcdefw", b"qabcdr"]
    found = sorted((n, sorted(at)) for n, at in repeats.maximal_repeats(texts, [6, 6, 4], 4))
    assert (6, [(0, 1), (1, 1)]) in found and (4, [(0, 1), (1, 1), (2, 1)]) in found
    assert not any(n == 5 for n, _ in found)  # bcdef is not maximal: an a is always before it


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 40)) for i in range(12)] + [(12, None), (13, ""), (14, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def edited(text, n):
        t = list(text)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice("qzj")
        return "".join(t)

    texts = [None, "", words(rng, 300)]
    for i, t in items[:12]:
        texts.append(words(rng, 50) + ("\n" + t.upper().replace(" ", "  ") if i % 3 == 0 else " " + edited(t, i)) + " " + words(rng, 50))
    texts.append(" ".join(t for _, t in items[:3]))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_matches(table(spark, texts), bench).collect()}

    def closest(item, text):
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in text:
            last, row[0] = row[:], 0
            for j in range(1, len(item) + 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (item[j - 1] != c))
            best = min(best, row[-1])
        return best

    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            item, plain = decontaminate.normalized(item), decontaminate.normalized(t)
            if item and plain and (e := closest(item, plain)) <= len(item) // decontaminate.CHARS_PER_EDIT:
                want[d, i] = e
    assert got == want and len(want) >= 12
    left = decontaminate.clean(table(spark, texts), bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want} and left.columns[-1] == "bucket"
    assert decontaminate.find_matches(table(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.find_matches(table(spark, []), bench).count() == 0


def test_licences(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = [
        ("r/LICENSE", apache), ("r/a/x.txt", "plain words"), ("r/a/b/y.txt", f"{' '.join(f'word{i}' for i in range(40))}\n{mit}\nmore"), ("r/c/COPYING", mit), ("r/c/d/z.txt", None), ("r/c/d/e.txt", ""),
        ("s/none.txt", "nothing here"), (None, mit), ("r/a/x.txt", "plain words"), ("top.txt", "words"),
    ]
    got = {(r.path, r.licence, r.how, r.declared_by) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        ("r/LICENSE", "Apache-2.0", "file", "r/LICENSE"), ("r/a/x.txt", "Apache-2.0", "inherited", "r/LICENSE"), ("r/a/b/y.txt", "MIT", "header", "r/a/b/y.txt"), ("r/c/COPYING", "MIT", "file", "r/c/COPYING"),
        ("r/c/d/z.txt", "MIT", "inherited", "r/c/COPYING"), ("r/c/d/e.txt", "MIT", "inherited", "r/c/COPYING"), ("s/none.txt", None, None, None), (None, None, None, None), ("top.txt", None, None, None),
    }
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


@pytest.fixture(scope="module")
def char_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bad = ["idiot", "moron", "clown", "scum", "worthless", "pathetic", "trash", "loser", "stupid"]
    more = spark.createDataFrame([(10**6 + i, " ".join(bad)) for i in range(60)], "doc_id long, text string")
    return toxicity.CharModel(toxicity.char_counts(docs.unionByName(more)))


def test_deobfuscation(char_model):
    for seen, plain in (("id10t", "idiot"), ("m0r0n", "moron"), ("s.c.u.m", "scum"), ("stuuuupid", "stupid"), ("cl0wn", "clown"), ("p@thetic", "pathetic"), ("l0$er", "loser"), ("tr4sh", "trash"), ("i-d-i-o-t", "idiot")):
        assert plain in toxicity.restored_words(seen, char_model), seen
    assert toxicity.restore("an i d i o t here", char_model).startswith("an idiot")
    assert toxicity.restore("plain words, 2024 ### stay!", char_model) == "plain words, 2024 ### stay!"
    assert toxicity.restore(None, char_model) == "" == toxicity.restore("", char_model)


def test_char_counts_are_those_of_words(spark):
    counts = toxicity.char_counts(table(spark, ["Ab abc", None, ""])).reshape(toxicity.N, toxicity.N, toxicity.N)
    i = {c: toxicity.INDEX[c] for c in "abc"}
    assert counts[0, 0, i["a"]] == 2 and counts[0, i["a"], i["b"]] == 2 and counts[i["a"], i["b"], 0] == 1 and counts[i["b"], i["c"], 0] == 1 and counts.sum() == 7


def test_toxicity(spark):
    rng = random.Random(12)
    texts, y = [None, ""], [0, 0]
    for i in range(400):
        w = words(rng, 40).replace("w1", "via").split()
        if i % 4 == 0:
            w[rng.randrange(40)] = "idiot" if i % 8 else "moronic"
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    hidden = ["you are an id1ot " + words(rng, 30), "you i d i o t " + words(rng, 30), words(rng, 30)]
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r.predicted for r in toxicity.score(table(spark, texts + hidden), labels, F.lit(True)).collect()}
    assert [got[i] for i in range(len(y))] == y
    assert [got[len(y) + i] for i in range(3)] == [1, 1, 0]
    assert {r.score for r in toxicity.score(table(spark, texts), labels.limit(0), F.lit(True)).collect()} == {0.5}
