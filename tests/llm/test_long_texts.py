"""Very long words, lines and texts take time in proportion; repeated rows and odd values have a defined result."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import char_model, table, words  # noqa: F401

from runlake.llm import common, lines, quality, toxicity


def seconds(run):
    began = time.time()
    run()
    return time.time() - began


@pytest.mark.parametrize("word", ("ab-" * 350_000, "a" + "-" * 10**6 + "b", "漢字，" * 350_000, "x1y" * 350_000, "a" * 10**6, "!" * 10**6 + "a", "aabb" * 250_000))
def test_a_word_of_a_million_signs(char_model, word):  # noqa: F811
    assert seconds(lambda: toxicity.Words(char_model, None).of(word)) < 20
    assert seconds(lambda: toxicity.restore(word[:100_000], char_model)) < 20


def test_letters_set_apart_in_a_long_text(char_model):  # noqa: F811
    assert seconds(lambda: toxicity._APART.findall("a b " * 100_000 + "(" * 10 + " " * 100_000 + "word")) < 20


def test_disguises_within_a_long_word(char_model):  # noqa: F811
    assert "idiot" in toxicity.Words(char_model, None).of("xyz," * 100 + "id10t," + "xyz," * 100)


def naive_readings(model, seen):
    """Every way through the lattice of a word, with its cost."""
    best = {}
    runs = [m[0] for m in toxicity.re.finditer(r"(.)\1*", seen.lower())]
    for path in itertools.product(*(toxicity._options(r[0], len(r)) for r in runs)):
        text, total = "".join(p for p, _ in path), sum(c for _, c in path)
        a = b = 0
        for c in text:
            i = toxicity.INDEX.get(c, toxicity.N - 1)
            total += float(model.cost[0, 0, i] if b == 0 else model.cost[a, b, i])
            a, b = b, i
        total += float(model.cost[a, b, 0])
        best[text] = min(best.get(text, np.inf), total)
    return best


def test_viterbi_against_every_reading(char_model):  # noqa: F811
    rng = random.Random(2)
    for seen in ["id10t", "m0r0n", "@sshole", "cl*wn", *("".join(rng.choice("abcdeilost01345@$!|+-.ee") for _ in range(rng.randrange(2, 7))) for _ in range(150))]:
        every = naive_readings(char_model, seen)
        least = min(every.values())
        assert every[char_model.decode(seen)] == pytest.approx(least, abs=1e-4), seen
        assert all(every[w] <= least + toxicity.MARGIN + 1e-4 for w in char_model.readings(seen))


def test_a_text_of_many_lines(spark):
    rng = random.Random(4)
    shared = [f"the line number {i} of these texts recurs" for i in range(200)]
    text = "\n".join(shared[i % 200] if i % 2 else f"own words {rng.random()}" for i in range(200_000))
    docs = table(spark, [text, text, text]).repartition(3)
    began = time.time()
    got = {r.doc_id: r for r in lines.drop_recurring_lines(docs).collect()}
    assert time.time() - began < 120
    assert [got[i].n_lines for i in range(3)] == [200_000] * 3
    assert got[0].n_dropped < 200_000 and got[1].n_dropped == got[2].n_dropped >= 100_000
    assert got[1].text.count("\n") + 1 == 200_000 - got[1].n_dropped


def test_lines_of_repeated_rows(spark):
    line = "this line is in every one of these documents"
    a, b = f"one\n{line}\ntwo", f"{line}\n{line}"
    rows = [(1, a), (1, a), (2, f"x\n{line}"), (3, b), (3, "short"), (4, None), (None, line), (5, "")]
    got = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()))) == sorted(
        map(str, [(1, 3, 0, a), (1, 3, 0, a), (2, 2, 1, "x"), (3, 2, 2, ""), (3, 1, 1, ""), (4, 0, 0, None), (None, 1, 0, line), (5, 1, 0, "")])
    )


def test_classifiers_of_repeated_rows_and_no_rows(spark):
    rng = random.Random(6)
    texts = [("bad idiot " if i % 3 == 0 else "good ") + words(rng, 30) for i in range(150)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(150)], "doc_id long, toxic int, quality int")
    twice, label_twice = docs.unionByName(docs.where("doc_id < 5")).withColumn("score", F.lit("own")), labels.unionByName(labels.limit(3))
    common.small_batches(spark)
    for run in (toxicity.score, quality.classify):
        got = run(twice, label_twice, F.lit(True), **({"label": "quality"} if run is quality.classify else {})).collect()
        assert len(got) == 155 and len({(r.doc_id, r.score) for r in got}) == 150
        assert run(docs.limit(0), labels, F.lit(True)).count() == 0


def test_the_classifier_reads_every_passage_of_a_fitted_document(spark):
    texts = [" ".join(["word"] * 64 * 300), "one passage", None, ""]
    sample = table(spark, texts).withColumn("y", F.lit(1))
    assert [(r.doc_id, r.n) for r in quality.encoded(sample).orderBy("doc_id").collect()] == [(0, 300), (1, 1), (2, 1), (3, 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    assert quality.classifier(table(spark, texts), labels, F.lit(True), passages=1) is not None


@pytest.mark.parametrize(
    "text",
    ("7 3 " * 50_000, "\n".join(" ".join("0123456789"[(i * j) % 10] for j in range(50)) for i in range(10_000)), "a " + "1 " * 100_000 + "b c", "a c g t " * 50_000, "x 1 " * 10_000, "! ( " * 50_000, "1 a 2 b | c " * 2000),
)
def test_signs_set_apart_in_a_long_text(char_model, text):  # noqa: F811
    """Digits, tables of numbers, letters and both, apart by white space."""
    assert seconds(lambda: toxicity.Words(char_model, None).of(text)) < 20


def test_disguises_among_signs_set_apart(char_model):  # noqa: F811
    found = toxicity.Words(char_model, None).of
    numbers = "4 8 1 5 1 6 2 3 4 2 " * 300
    assert "idiot" in found(f"{numbers}\n you i d i o t and {numbers}") and "idiot" in found("you i d 1 0 t")
    assert toxicity.restore(numbers.strip(), char_model) == numbers.strip()
    assert "idiot" in toxicity.restore(f"{numbers} i d i o t", char_model)


@pytest.mark.parametrize("mark", ("id!ot", "id|ot", "id10t", "i.d.i.o.t", "id*ot", "1d1ot"))
def test_marks_stand_for_letters_in_a_long_word(char_model, mark):  # noqa: F811
    """Whatever comes before, also where a window ends within the disguise."""
    for before in (0, 20, 24):
        assert "idiot" in toxicity.Words(char_model, None).of(",".join(["xyz"] * (40 + before) + [mark] + ["xyz"] * 40)), (mark, before)


def test_long_lattices_read_like_short_ones(char_model, monkeypatch):  # noqa: F811
    rng = random.Random(5)
    seen = ["".join(rng.choice(("id10t", "m0ron", "w0rd", "pl@in", "st0p")) for _ in range(3)) for _ in range(20)]
    exact = [char_model.decode(w) for w in seen]
    monkeypatch.setattr(toxicity, "SHORT", 0)
    monkeypatch.setattr(toxicity, "SETTLED", 8)
    assert sum(a == char_model.decode(w) for a, w in zip(exact, seen, strict=True)) >= 19
