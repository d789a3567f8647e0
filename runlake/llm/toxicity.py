"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over every document. A word that looks disguised (marks or digits
among letters, letters repeated, letters set apart by spaces) becomes a lattice of characters it may stand
for, and Viterbi decoding under the character model picks the likeliest reading. The restored words are
scored by a logistic model of words and word beginnings, learned from labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import fit_sample

# Letters of the character model; index 0 is the edge of a word, the last any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
# What a mark or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "(": "c", "£": "l", "#": "h", "¡": "i", "*": "aeiou"}
#: Costs (natural logs) of the channel: a letter disguised, a separator dropped, another mark or digit dropped or kept as it is, a doubled letter made single, a run shortened, a space put in.
DISGUISED, DROPPED, LOST, KEPT, UNDOUBLED, SHORTENED, SPACED = 0.5, 1.5, 9.0, 12.0, 4.0, 0.3, 2.5
#: Second and third readings are used for scoring within this cost of the best.
MARGIN = 4.0
#: The scorer is fitted on at most this many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 6000
#: Words and word beginnings the scorer may use.
FEATURES = 4000
#: A word of more signs is parted at marks that never stand for letters, and what is still longer is decoded in
#: windows of so many signs, each with some signs of the one before.
LONG, OVERLAP = 100, 25
#: In a lattice of more signs only the best ways are kept at each step, and letters further back are settled.
SHORT, BEAM, SETTLED = 30, 24, 40

N = len(LETTERS) + 2
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_LETTER = re.compile(r"[^\W\d_]")
# a letter before one of the first marks, or one of the second before a letter, may be a disguise
_AFTER, _BEFORE = re.compile(r"[\d_@$!|+€(£#*.\-~^'/\\]"), re.compile(r"[\d@$!|+€(£#*]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
# what a long word is parted into: letters, digits, marks that stand for letters and those often put between them
_PIECE = re.compile(rf"[\w{re.escape(''.join(LEET))}.\-~^'’/\\]+")
# more than eight signs in a row without a letter, set apart: no part of a word
_QUIET = re.compile(r"((?:[\d_]|[^\w\s])(?:\s+(?:[\d_]|[^\w\s])){8,})")
# single signs with white space between, from a blank, an opening mark or (letters and digits) any mark, up to a blank or mark
_LAST = r"""(?:\w(?!\w)(?!['’\-@&/]\w)|[^\s\w.,;:?](?![^\s.,;:?!"')\]}»”’]))"""
_APART = re.compile(r"""(?<!\w['’\-])(?:(?<![^\s"'(\[{«“‘])[^\s.,;:?]|(?<!\w)(?<!\d[.,])\w)\s+(?:[^\s.,;:?]\s+)+""" + _LAST)
# the end of any such run, looked for first since it is found faster: most texts have none
_APART_END = re.compile(r"\s(?<!\w\w\s)[^\s.,;:?]\s+" + _LAST)
_WHITE = re.compile(r"\s+")
_TWICE = re.compile(r"(.)\1")
_THRICE = re.compile(r"(.)\1\1")


def _code_table() -> np.ndarray:
    """Code point -> letter index, small and capital alike; other letters share the last index, all else is an edge."""
    out = np.zeros(0x3000, np.uint32)
    for c in range(len(out)):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = INDEX.get(low, N - 1)
    return out


class CharModel:
    """Smoothed trigram log probabilities of letters within words."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(N, N, N).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + N)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.cost = -np.log(p3).astype(np.float32)

    @cached_property
    def costs(self) -> list[float]:
        """The same costs as one list, whose items are read faster."""
        return self.cost.ravel().tolist()

    def once_doubled(self, word: str, at: int) -> list[str]:
        """The readings of a word of at most SHORT small letters of which only those at `at` and behind it are a pair: two ways, which need no lattice."""
        costs, of = self.costs, [INDEX.get(c, N - 1) for c in word]
        a = b = 0
        head = 0.0
        for i in of[:at]:
            head += costs[(a * N + b) * N + i]
            a, b = b, i
        pair = of[at]
        step = costs[(a * N + b) * N + pair]
        ways = []
        for total, a, b, text in ((head + UNDOUBLED + step, b, pair, word[:at] + word[at + 1 :]), (head + step + costs[(b * N + pair) * N + pair], pair, pair, word)):
            for i in of[at + 2 :]:
                total += costs[(a * N + b) * N + i]
                a, b = b, i
            ways.append((total + costs[(a * N + b) * N], text))
        ways.sort()
        return [text for total, text in ways if total <= ways[0][0] + MARGIN]

    def readings(self, seen: str, apart: bool = False) -> list[str]:
        """Up to three readings of a disguised word, likeliest first; with `apart`, of letters written one by one, which may hold several words.

        Viterbi over (last letter but one, last letter), keeping the two best ways into each state. Of more than
        `SHORT` signs a beam of ways is kept, and all readings share the letters that are settled.
        """
        costs, long, settled = self.costs, len(seen) > SHORT, []
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for n, run in enumerate(re.finditer(r"(.)\1*", seen.lower(), re.DOTALL), 1):
            options = [(letters, extra, [INDEX.get(c, N - 1) for c in letters]) for letters, extra in _options(run[0][0], len(run[0]))]
            found: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), ways in states.items():
                for so_far, text in ways:
                    heads = [(a, b, so_far, text)]
                    if apart and b:
                        heads.append((b, 0, so_far + SPACED + costs[(a * N + b) * N], text + " "))
                    for x, y, base, head in heads:
                        for letters, extra, places in options:
                            p, q, total = x, y, base + extra
                            for i in places:
                                total += costs[(p * N + q) * N + i] if q else costs[i]
                                p, q = q, i
                            found.setdefault((p, q), []).append((total, head + letters))
            states = {k: sorted(set(v))[:2] for k, v in found.items()}
            if long:
                best = sorted((v, text, k) for k, ways in states.items() for v, text in ways)[:BEAM]
                done = max(0, len(best[0][1]) - SETTLED) if n % SETTLED == 0 else 0
                head = best[0][1][:done]
                settled.append(head)
                states = {}
                for v, text, k in best:
                    if text.startswith(head):
                        states.setdefault(k, []).append((v, text[done:]))
        ends = sorted((v + costs[(a * N + b) * N], text) for (a, b), ways in states.items() for v, text in ways)
        return ["".join([*settled, text]) for v, text in ends[:3] if v <= ends[0][0] + MARGIN]

    def decode(self, seen: str, apart: bool = False) -> str:
        return self.readings(seen, apart)[0]


def _options(char: str, length: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the cost of each reading."""
    if char.isalpha():
        if length == 1:
            return [(char, 0.0)]
        return [(char, UNDOUBLED if length == 2 else SHORTENED), (char * 2, 0.0 if length == 2 else SHORTENED)]
    out = [(c * k, DISGUISED * k) for c in LEET.get(char, "") for k in range(1, min(length, 2) + 1)]
    return [*out, ("", LOST if out and char != "*" else DROPPED), *([(char, KEPT)] if char.isdigit() else [])]


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents; at most N**3 numbers whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _code_table(), np.zeros(N**3, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    points = np.frombuffer(f"  {text} ".encode("utf-32-le", "replace"), np.uint32)
                    code = table[np.minimum(points, len(table) - 1)]
                    tri = (code[:-2] * N + code[1:-1]) * N + code[2:]
                    # two edges in a row are no trigram of a word
                    total += np.bincount(tri[(code[1:-1] > 0) | (code[2:] > 0)], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(N**3, np.int64)
    for r in docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    # after an edge the letter before it is forgotten
    grid = out.reshape(N, N, N)
    starts = grid[:, 0, :].sum(0)
    grid[:, 0, :] = 0
    grid[0, 0, :] = starts
    return grid.reshape(-1)


def core_of(word: str) -> str:
    """A word without marks at its ends; of marks that may stand for letters, a run of the same at the end goes. One pass over a word of any length."""
    low, high = 0, len(word)
    while low < high and not (word[low].isalnum() or word[low] in "_@$€£"):
        low += 1
    while high > low and not (word[high - 1].isalnum() or word[high - 1] in "_@$€£"):
        high -= 1
    if high == len(word) and high - low > 1 and word[-1] == word[-2] and word[-1] in "@$€£":
        while high > low and word[high - 1] == word[-1]:
            high -= 1
    return word[low:high]


def looks_odd(core: str) -> bool:
    """Whether marks or digits stand among letters, or a letter three times in a row; linear in the length."""
    letter = _LETTER.search(core)
    if not letter:
        return False
    mark = _BEFORE.search(core)
    return bool(_AFTER.search(core, letter.end()) or (mark and _LETTER.search(core, mark.end())) or _TRIPLE.search(core))


def pieces_of(word: str) -> Iterator[str]:
    """The parts of a word of more than LONG signs, in windows where a part is as long."""
    for part in _PIECE.finditer(word):
        low, high = part.span()
        for at in range(low, max(low + 1, high - OVERLAP), LONG - OVERLAP):
            yield word[at : min(at + LONG, high)]


def parts_apart(run: str) -> list[str]:
    """A run of single signs, parted at longer stretches without a letter: every second part is such a stretch."""
    return _QUIET.split(run) if _LETTER.search(run) else ["", run, ""]


def restored_words(word: str, model: CharModel, known: Container[str] = ()) -> Iterable[str]:
    """A word in small letters without marks at its ends, decoded where it looks disguised; letters may be doubled in any word that is not `known`."""
    if len(word) > LONG:
        return tuple(w for piece in pieces_of(word) for w in restored_words(piece, model, known))
    core = word.strip(".,;:?")
    if core.isalpha() and not _THRICE.search(core):
        return _undoubled(core.lower(), model, known)
    core = core_of(word)
    if not _LETTER.search(core):
        return ()
    if looks_odd(core):
        plain = re.split(r"[^\w]+", core.lower())
        return (*model.readings(core), *(p for p in plain if p.isalpha() and len(p) > 3))
    return _undoubled(core.lower(), model, known) if core.isalpha() else (core.lower(),)


def _undoubled(word: str, model: CharModel, known: Container[str]) -> Iterable[str]:
    pair = None if word in known else _TWICE.search(word)
    if pair is None:
        return (word,)
    once = len(word) <= SHORT and word.isalpha() and not _TWICE.search(word, pair.start() + 1)
    return (word, *(model.once_doubled(word, pair.start()) if once else model.readings(word)))


def restore(text: str | None, model: CharModel) -> str:
    """The whole text with disguised words in plain letters; other words stay as they are."""
    if not text:
        return ""

    def together(m: re.Match) -> str:
        parts = parts_apart(m[0])
        for i in range(0, len(parts), 2):
            if _LETTER.search(parts[i]):
                before, after = re.match(r"\s*", parts[i])[0], re.search(r"\s*\Z", parts[i])[0]
                parts[i] = before + model.decode(_WHITE.sub("", parts[i]), apart=True) + after
        return "".join(parts)

    joined = _APART.sub(together, text)

    def one(m: re.Match) -> str:
        return model.decode(core) if looks_odd(core := core_of(m[0])) else m[0]

    return re.sub(r"\S+", lambda m: one(m) if len(m[0]) <= LONG else _PIECE.sub(one, m[0]), joined)


def _beginnings(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in (4, 5) if len(word) > k)]


class Words(dict):
    """Word -> the features of its restored form; forgotten when `most` words are held."""

    def __init__(self, model: CharModel, known: dict[str, int] | None, most: int = 300_000):
        super().__init__()
        self.model, self.known, self.most = model, known, most
        # features that are word beginnings, without their mark
        self.heads = {f[:-1]: i for f, i in (known or {}).items() if f[-1:] == "-" and len(f) in (5, 6)}

    def _places(self, word: str) -> list[int]:
        """The places of the features of one restored word, those of `_beginnings` that are known."""
        known, heads = self.known, self.heads
        out = [known[word]] if word in known else []
        if len(word) > 4 and word[:4] in heads:
            out.append(heads[word[:4]])
        if len(word) > 5 and word[:5] in heads:
            out.append(heads[word[:5]])
        return out

    def __missing__(self, word: str):
        if len(word) > LONG:
            return tuple({f for piece in set(pieces_of(word)) for f in self[piece]})
        if len(self) >= self.most:
            self.clear()
        low = word.strip(".,;:?").lower()
        # most words are letters of which none stands twice in a row: they are as they are
        words = (low,) if low.isalpha() and not _TWICE.search(low) else [part for w in restored_words(word, self.model, self.known or ()) for part in w.split(" ")]
        if self.known is None:
            out = tuple([f for w in words for f in _beginnings(w)])
        elif len(words) == 1:
            out = tuple(self._places(words[0]))
        else:
            out = tuple({i for w in words for i in self._places(w)})
        self[word] = out
        return out

    def of(self, text: str | None) -> set:
        """Features of a whole text."""
        out: set = set()
        words = set(text.split() if text else ())
        for f in set(map(self.__getitem__, words)):
            out.update(f)
        for m in _APART.finditer(text) if 1 in map(len, words) and _APART_END.search(text) else ():
            for part in parts_apart(m[0])[::2]:
                if _LETTER.search(part):
                    for w in {w for reading in self.model.readings(_WHITE.sub("", part), apart=True) for w in reading.split(" ")}:
                        out.update(self[w])
        return out


class Scorer:
    """Logistic model over the presence of words and word beginnings."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias

    def __call__(self, active: set) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[list(active)].sum(), -30, 30)))) if active else float(1 / (1 + np.exp(-self.bias)))


def chosen_features(bags: DataFrame, features: int = FEATURES) -> list[str]:
    """The features of `bags` (y, names) most over-represented in label 1; counted on the executors, `features` at most come back."""
    n = bags.agg(F.sum("y").alias("one"), F.count("*").alias("n")).first()
    n1, n0 = max(1, n.one or 0), max(1, n.n - (n.one or 0))
    counts = bags.select("y", F.explode("names").alias("name")).groupBy("name").agg(F.sum("y").alias("one"), F.count("*").alias("n")).where("one >= 3")
    a, b = (F.col("one") + 0.5) / (n1 + 1), (F.col("n") - F.col("one") + 0.5) / (n0 + 1)
    best = counts.where(a > 3 * b).select("name", (F.col("one") * F.log(a / b)).alias("lift")).orderBy(F.desc("lift"), "name").limit(features)
    return [r.name for r in best.collect()]


def fit(rows: list[list[int]], labels: np.ndarray, names: list[str], steps: int = 1500) -> Scorer:
    """Weights of the features `names`, of which each row lists the places it has, by gradient descent with momentum."""
    n1, n0 = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    at, cols = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], np.int64)
    w, b, vw, vb = np.zeros(len(names)), float(np.log(n1 / n0)), np.zeros(len(names)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[cols], len(rows)), -30, 30)))
        d = (p - labels) / len(rows)
        vw, vb = 0.9 * vw - 2.0 * (np.bincount(cols, d[at], len(names)) + 1e-5 * w), 0.9 * vb - 0.5 * d.sum()
        w, b = w + vw, b + vb
    return Scorer({f: i for i, f in enumerate(names)}, w, float(b))


def learn(sample: DataFrame, model: CharModel) -> Scorer | None:
    """The scorer fitted on `sample` (doc_id, text, y): texts are read on the executors, the driver gets places of chosen features. None without rows."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value, None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([sorted(words.of(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["doc_id", "y", "names"])

    rows = sample.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int"))
    bags = written(rows.mapInArrow(names_of, "doc_id long, y int, names array<string>"), "bags")
    chosen = chosen_features(bags)
    of = {f: i for i, f in enumerate(chosen)}

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [[of[f] for f in names if f in of] for names in batch.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "y", "places"])

    found = sorted(bags.mapInArrow(places_of, "doc_id long, y int, places array<int>").collect())
    return fit([r.places for r in found], np.array([r.y for r in found], np.float64), chosen) if found else None


def score(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, predicted for every document, from its text alone (0.5 where there are no labels to learn from).

    Null and empty texts get the score of a text without words; repeated rows are scored alike. Long texts, words of
    any length and long runs of single signs are read as a whole, in time that grows with their length; signs set apart
    without a letter for a long stretch (numbers, tables) stand for no word.
    """
    model = CharModel(char_counts(docs))
    scorer = learn(fit_sample(docs, labels, label, allowed, rows), model)
    if scorer is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        words = Words(model, scorer.names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([scorer(words.of(t)) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scores, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
