"""Language detection: held-out texts of the tables, sentences of every language, short and mixed texts, and both forms alike."""

import pytest
from pyspark.sql import functions as F

from runlake.operators import text

# None of these sentences is what the profile is built from.
SENTENCES = {
    "ar": "ذهب الأطفال أمس إلى المدرسة تحت المطر وعادوا إلى البيت متأخرين", "cs": "Včera šly děti do školy v dešti a vrátily se domů pozdě večer.", "da": "I går gik børnene i skole i regnen og kom sent hjem om aftenen.",
    "de": "Gestern sind die Kinder bei Regen zur Schule gegangen und spät heimgekommen.", "el": "Χθες τα παιδιά περπάτησαν στο σχολείο μέσα στη βροχή και γύρισαν αργά.", "en": "Yesterday the children walked to school through the rain and came home late.",
    "es": "Ayer los niños fueron a la escuela bajo la lluvia y volvieron tarde.", "fi": "Eilen lapset kävelivät kouluun sateessa ja tulivat myöhään kotiin.", "fr": "Hier soir, les enfants sont rentrés de l'école sous la pluie.",
    "he": "אתמול הילדים הלכו לבית הספר בגשם וחזרו הביתה מאוחר בערב", "hi": "कल बच्चे बारिश में स्कूल गए और देर से घर लौटे थे", "hu": "Tegnap a gyerekek esőben mentek iskolába, és későn értek haza.",
    "it": "Ieri i bambini sono andati a scuola sotto la pioggia e sono tornati tardi.", "ja": "昨日、子供たちは雨の中を学校まで歩いて、夜遅くに家に帰ってきました。そして寝ました", "ko": "어제 아이들은 비를 맞으며 학교에 걸어갔다가 밤늦게 집에 돌아왔습니다",
    "nl": "Gisteren zijn de kinderen door de regen naar school gelopen en laat thuisgekomen.", "pl": "Wczoraj dzieci poszły do szkoły w deszczu i późno wróciły do domu.", "pt": "Ontem as crianças foram para a escola na chuva e voltaram tarde.",
    "ro": "Ieri copiii au mers la școală prin ploaie și au ajuns târziu acasă.", "ru": "Вчера дети шли в школу под дождём и поздно вернулись домой.", "sv": "Igår gick barnen till skolan i regnet och kom hem sent på kvällen.",
    "tr": "Dün çocuklar yağmurda okula yürüdüler ve eve geç geldiler.", "uk": "Вчора діти йшли до школи під дощем і пізно повернулися додому.", "zh": "昨天孩子们冒着雨走路去上学，晚上很晚才回到家里，他们都很累，因为路很远，下次要坐车。",
}
ODD = [None, "", "short", "the cat and the dog are in", "12345 67890 12345 67890 12345 !!!", "the the " * 4, "\n\t" * 40 + "the", "ΑΒΓ " * 20, "☃" * 40, "x" * 10_000]
#: The part in the language that is named is the longer one.
MIXED = {"en": SENTENCES["en"] + " " + SENTENCES["en"] + " " + SENTENCES["de"], "ru": SENTENCES["ru"] + " " + SENTENCES["en"][:20], "ja": SENTENCES["ja"] + " the end"}


def detected(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string").repartition(3)
    return {r.n: r.language for r in text.detect_languages(df, "x", ["n"]).collect()}


def test_sentences_of_every_language(spark):
    assert len(SENTENCES) == len(text.CODES) == 24
    got = detected(spark, SENTENCES.values())
    assert dict(zip(SENTENCES, (got[i] for i in range(24)), strict=True)) == {c: c for c in SENTENCES}


def test_mixed_texts(spark):
    got = detected(spark, MIXED.values())
    assert [got[i] for i in range(len(MIXED))] == list(MIXED)


def test_both_forms_are_alike(spark):
    texts = [*SENTENCES.values(), *MIXED.values(), *ODD]
    got = detected(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", text.language("x").alias("language"))
    assert {r.n: r.language for r in df.collect()} == got == {i: None if t is None else text.language_of(t) for i, t in enumerate(texts)}
    assert all(got[len(texts) - len(ODD) + i] is None for i in (0, 1, 2, 3, 4, 8)) and got[len(texts) - len(ODD) + 5] == "en"


@pytest.mark.parametrize("size", ("sf0.001", "sf0.01"))
def test_accuracy_on_texts_that_the_profile_was_not_built_from(spark, size):
    """0.99 of 1,000 texts at sf0.01; of four languages out of 24, in invented words."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    found = text.detect_languages(docs, "text", ["lang"]).where("language IS NOT NULL")
    assert found.agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0] > 0.97


def test_rows_are_kept(spark):
    df = spark.createDataFrame([("a", "x", SENTENCES["fr"])] * 3 + [(None, "y", None)], "k string, __row string, t string")
    assert sorted(str(tuple(r)) for r in text.detect_languages(df, "t", ["k", "__row"]).collect()) == sorted(map(str, [*[("a", "x", "fr")] * 3, (None, "y", None)]))
    assert text.detect_languages(df.limit(0), "t", ["k"]).count() == 0


def test_many_texts_at_once_and_one_by_one(spark):
    """Looked up together, n-grams do not reach from text to text, and each text has the language that its n-grams one by one add up to."""
    texts = [*SENTENCES.values(), *(t for t in ODD if t), "q" * 600, ". " * 40, "a b c d e f g h i j k l m n o p q r", "\U0001f600\U00020000 the house in the garden of the king"] * 8
    known = text.profile()

    def plainly(t):
        words = [w for w in text.regex.split("[^\\p{L}\\p{M}]+", t[: text.LOOKED_AT].lower()) if w]
        hits = [known[g] for g in text.grams_of(f" {' '.join(words)} ") if g in known]
        sums = [sum(x) for x in zip(*hits, strict=True)]
        return text.CODES[sums.index(max(sums))] if hits and len(t) >= text.SHORTEST else None

    assert len(texts) > text.AT_ONCE
    assert text.languages_of([*texts, None]) == [*map(plainly, texts), None]
    assert [text.language_of(t) for t in texts] == [*map(plainly, texts)]


def test_detection_makes_no_rows_of_n_grams(spark):
    """Some 1,500 rows for each text, joined and added up, took most of the time."""
    plan = text.detect_languages(spark.createDataFrame([("x", "y")], "k string, t string"), "t", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Generate", "Join", "Exchange"))
