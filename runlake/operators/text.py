"""Language of texts by character n-grams: a profile of log probabilities, built from frequent words by one rule."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.operators.discovery import top_and_others

# Very frequent words of the languages that are told apart, the most frequent first.
WORDS = {
    "ar": "في من على أن إلى التي عن لا ما هذا الذي هذه كان مع ذلك بين كل قد بعد هو هي لم غير حتى إذا كما عند أو ثم منذ أي كانت العالم يوم ليس نحن أنت كيف لماذا حيث فقط جدا خلال",
    "cs": "a se v na je že to s z do o i ve si po ale jako za by jsem tak jeho k od bylo které který jsou pro až byl už jen nebo když její při podle také jak není má mezi přes můj této",
    "da": "og i at det er en til på som af de med den for der ikke jeg var han du et har vi om fra men havde hvad kan skal ville så ved eller også efter blev være sig hun mig dig meget mange hvor når",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über ich war haben nur oder aber vor zur bis mehr durch man kann",
    "el": "και το να του η της με που την από για ο είναι οι στο τα δεν θα ένα στην μια των τον αυτό σε ότι τη μας τους αλλά μου όταν πολύ ήταν έχει όπως μετά κατά εκεί πώς τώρα γιατί εγώ",
    "en": "the of and to in is that it was for on are with as at be this have from or by not but what all were when your can said there use an each which she do how their if will you he his they had we more would about",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno",
    "fi": "ja on ei se että en hän oli ne mutta niin kun minä kuin joka mitä myös ovat tämä sen sitä olen voi nyt jos vain sinä kuitenkin hänen sitten ole vielä mukaan tai jo minun näin mikä koko kanssa ennen jälkeen heidän",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont tout nous sa avec été aussi elle fait être deux cette ces lui vous je ans même son",
    "he": "של את על לא זה עם הוא אני כי כל היא אם גם או יש מה אל אבל היה רק הם אחד כמו אין לי יותר עד בין זאת אחרי לפני היום כך שלו איך כאן אנחנו אתה מאוד למה",
    "hi": "के है में की से को और का पर यह हैं ने एक भी नहीं कि तो ही था इस कर या हो वह जो लिए अपने कुछ साथ तक बाद गया मैं हम आप बहुत कोई सब जब दिया थे",
    "hu": "a az és hogy nem is egy ez volt de meg csak már van el ha mint vagy azt még ki be kell én te ő mi mert most majd lesz itt nagyon minden után között szerint valami lehet aki amely olyan sem",
    "it": "di e il la che in un a per è una sono del non con le si da della i al come più anche dei nel alla ma gli o se lo ha delle su questo due tra quando suo sua loro essere stato molto fra ho c'è dalla nella",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について です ます でした ません 私 日本 人 今日",
    "ko": "이 는 은 을 를 의 에 가 다 고 하는 그 있는 있다 것 수 들 한 에서 로 으로 도 과 와 나는 우리 그리고 하지만 그런 때 더 없다 않는 대한 위해 지금 오늘 사람 말 일 했다 합니다 입니다 습니다 까지 부터",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als bij door dan naar nog maar over uit hij ze wordt tot je ik was of heeft hebben worden deze we wel geen kan zou mijn meer dit al werd veel",
    "pl": "w i na z się nie do to że jest o jak za od po ale przez co dla są tak jego tym jako był ich przy już tylko jej może oraz było tego który które być jeszcze czy ma nad bardzo kiedy gdy mnie bez",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo",
    "ro": "de și în a la cu pe că nu o un din este să care mai pentru se au fost ce sau ca dar cei era prin le lui sunt după cum fi ei între fără acest această doar când foarte toate am poate astfel până",
    "ru": "и в не на я что он с это как по но они к у из за то все она так его от же бы для вы мы о было был или если ещё нет уже только меня когда даже очень чтобы быть который этого более может после",
    "sv": "och i att det som en på är av för med den till inte om har de ett var jag men han så vi från hon kan när nu eller sig där vid år mycket bara också skulle efter än under över hade alla vara blir någon varit",
    "tr": "ve bir bu da için de ile çok ne daha olarak gibi var en kadar sonra olan ben o mi ama ki her değil diye göre şey olduğu ya bunu içinde onun sen biz kendi zaman nasıl oldu yok iki hiç şimdi neden",
    "uk": "і в не на що з я до це як та він але за від вона їх для по так був було ми які ви його який у про або вже ще якщо коли є бути тільки дуже можна після щоб цього бо має також між",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自 之 年 过 发 后 作 里 我们 他们 没有 这个 什么 可以 自己 因为 所以",
}
#: Shorter texts have no language; of longer ones so many signs are looked at.
SHORTEST, LOOKED_AT = 30, 500
#: Lengths of the n-grams of words, which have a blank before and behind.
SIZES = (1, 2, 3)
CODES = tuple(sorted(WORDS))
_NO_LETTERS = regex.compile("[^\\p{L}\\p{M}]+")
#: Texts whose n-grams are looked up together, in about 10 MB.
AT_ONCE = 128


def word_weight(rank: int) -> int:
    """How often a word counts, by its place among the frequent ones of its language, from 0."""
    return 600 // (rank + 5) + 1


@cache
def profile() -> dict[str, tuple[int, ...]]:
    """Of each n-gram, for each of CODES, 1000 times the natural logarithm of its smoothed probability, rounded."""
    counts: dict[str, dict[str, int]] = {c: defaultdict(int) for c in CODES}
    for code in CODES:
        for rank, word in enumerate(WORDS[code].split()):
            for gram in grams_of(f" {word} "):
                counts[code][gram] += word_weight(rank)
    every = sorted(set().union(*counts.values()))
    totals = {c: sum(n.values()) + len(every) for c, n in counts.items()}
    return {g: tuple(round(1000 * math.log((counts[c].get(g, 0) + 1) / totals[c])) for c in CODES) for g in every}


def grams_of(padded: str) -> Iterator[str]:
    return (g for k in SIZES for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) != " ")


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """The profile for looking up many n-grams at once: numbers of signs, of pairs by their two signs and of triples by pair and sign, 0 where
    the profile has none; then the rows of the scores of signs, of pairs and of triples, row 0 being nought."""
    known = profile()
    signs = {c: i for i, c in enumerate(sorted(set("".join(known))), 1)}
    pairs = {g: i for i, g in enumerate(sorted({g[:2] for g in known if len(g) > 1}), 1)}
    triples = {g: i for i, g in enumerate(sorted(g for g in known if len(g) == 3), 1)}
    size, none = len(signs) + 1, (0,) * len(CODES)
    of_sign = np.zeros(ord(max(signs)) + 2, np.int32)
    of_sign[[ord(c) for c in signs]] = list(signs.values())
    of_pair, of_triple = np.zeros(size * size, np.int16), np.zeros((len(pairs) + 1) * size, np.int16)
    of_pair[[signs[g[0]] * size + signs[g[1]] for g in pairs]] = list(pairs.values())
    of_triple[[pairs[g[:2]] * size + signs[g[2]] for g in triples]] = list(triples.values())
    return of_sign, of_pair, of_triple, *(np.array([none, *(known.get(g, none) for g in grams)], np.int32) for grams in (signs, pairs, triples))


def _detect(padded: list[str]) -> list[str | None]:
    """Languages of texts whose words have one blank before and behind each; a known n-gram never has a blank within, so none reaches from text to text."""
    of_sign, of_pair, of_triple, *scores = _tables()
    size = np.int32(len(scores[0]))
    sign = of_sign[np.minimum(np.frombuffer("".join([*padded, "  "]).encode("utf-32-le", "surrogatepass"), np.uint32), len(of_sign) - 1)]
    pair = of_pair[sign[:-1] * size + sign[1:]]
    triple = of_triple[pair[:-1] * size + sign[2:]]
    length = np.fromiter(map(len, padded), np.int64, len(padded))
    starts = np.cumsum(length) - length
    sums = sum(np.add.reduceat(of[at], starts) for at, of in zip((sign, pair, triple), scores, strict=True))
    # every score is negative
    return [CODES[i] if hit else None for i, hit in zip(sums.argmax(1).tolist(), sums.any(1).tolist(), strict=True)]


def languages_of(texts: Iterable[str | None]) -> list[str | None]:
    """The language of each text: null for null, for texts of fewer than SHORTEST signs and for those without any known n-gram; ties go to the first in the alphabet."""
    texts = list(texts)
    out: list[str | None] = [None] * len(texts)
    long = [i for i, t in enumerate(texts) if isinstance(t, str) and len(t) >= SHORTEST]
    for at in range(0, len(long), AT_ONCE):
        part = long[at : at + AT_ONCE]
        for i, code in zip(part, _detect([f" {_NO_LETTERS.sub(' ', texts[i][:LOOKED_AT].lower()).strip(' ')} " for i in part]), strict=True):
            out[i] = code
    return out


def language_of(text: str) -> str | None:
    """The language of one text, by the same rule."""
    return languages_of([text])[0]


@F.pandas_udf(T.StringType())
def _language_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(languages_of(texts), dtype=object)


def language(text: Column | str) -> Column:
    """The language of a text as a column, in Arrow batches; only the part that is looked at leaves the JVM."""
    return _language_udf(F.left(F.col(text) if isinstance(text, str) else text, F.lit(LOOKED_AT)))


def detect_languages(df: DataFrame, text: str, keep: list[str], into: str = "language") -> DataFrame:
    """The columns `keep` of every row and its language `into`, as `languages_of` tells it; nothing is shuffled."""
    return df.select(*(F.col(c) for c in keep), language(text).alias(into))


def language_distribution(df: DataFrame, keys: list[str], text: str, top: int = 3) -> DataFrame:
    """By key, the `top` languages of a text field, the rest as 'others'; texts without a language are left out."""
    counts = detect_languages(df, text, keys).where(F.col("language").isNotNull()).groupBy(*keys, "language").agg(F.count("*").alias("n"))
    return top_and_others(counts, keys, "language", top)
