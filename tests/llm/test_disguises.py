"""Disguises next to marks, with white space of any kind, and by doubled letters."""

import random

import pytest
from test_ops import char_model  # noqa: F401

from runlake.llm import toxicity


@pytest.mark.parametrize("seen", ("i d i o t", "i d i o t.", "i d i o t!", '"i d i o t"', "(i d i o t)", "i d i o t, and", "i  d  i  o  t!", "i\td\ti\to\tt.", "i\nd\ni\no\nt", "i d i o t?"))
def test_letters_set_apart(char_model, seen):  # noqa: F811
    words = toxicity.Words(char_model, None)
    assert "idiot" in words.of(f"you are an {seen}") and "idiot" in words.of(f"you are an {seen} yes"), seen
    assert toxicity.restore(f"they said {seen}", char_model).count("idiot") == 1


def test_no_letters_set_apart():
    for text in ("it's a b", "wow!! i am", "plain words here", "a b's", "x y"):
        assert not toxicity._APART.search(text), text
    assert toxicity._APART.search("wow! a b c d")[0] == "a b c d"


@pytest.mark.parametrize("seen", ("iddiiott", "iddiiott.", '"iddiiott"', "iddiiott!", "IDDIIOTT"))
def test_doubled_letters(char_model, seen):  # noqa: F811
    assert "idiot" in toxicity.restored_words(seen, char_model)
    assert tuple(toxicity.restored_words("letter", char_model, {"letter"})) == ("letter",)
    assert "letter" in toxicity.restored_words("letter", char_model)


def test_a_letter_doubled_once_needs_no_lattice(char_model, monkeypatch):  # noqa: F811
    rng = random.Random(5)
    words = ["aa", "aab", "baa", "letter", "λλab", "ßéé", "x" * 2 + "ab" * 14]
    for _ in range(300):
        word = "".join(rng.choice("abeiostéñжß") for _ in range(rng.randrange(1, 12)))
        word = "".join(c for c, after in zip(word, word[1:] + " ", strict=True) if c != after)
        at = rng.randrange(len(word))
        words.append(word[:at] + word[at] + word[at:])
    expected = {w: (w, *char_model.readings(w)) for w in words}

    def lattice(*_, **__):
        raise AssertionError("a lattice for a word with at most one pair of letters")

    monkeypatch.setattr(toxicity.CharModel, "readings", lattice)
    assert {w: tuple(toxicity.restored_words(w, char_model)) for w in words} == expected
    assert "letter" in toxicity.Words(char_model, None).of("A Letter, and plain words.")


def test_known_features_are_those_of_all_names(char_model):  # noqa: F811
    text = "Letter idiots id10t İİİ s.c.u.m stuuuupid bookkeeper words abcd abcde 4321 a-b i d i o t xx%%% " + "xyz," * 40 + "id10t"
    names = toxicity.Words(char_model, None).of(text)
    known = {f: i for i, f in enumerate(sorted(names)[::2])}
    assert toxicity.Words(char_model, known).of(text) == {i for f, i in known.items() if f in names}


def test_texts_without_runs_of_single_signs_are_not_searched_for_any(char_model, monkeypatch):  # noqa: F811
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \n aab1('-.,$é") for _ in range(14)) for _ in range(20000)]
    assert all(toxicity._APART_END.search(t) for t in texts if toxicity._APART.search(t))
    assert sum(bool(toxicity._APART.search(t)) for t in texts) > 100
    monkeypatch.setattr(toxicity, "_APART", None)
    assert "plain" in toxicity.Words(char_model, None).of("it is a plain text, as most are")
