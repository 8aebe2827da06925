import unicodedata

import pytest

from spanloom.functions import lookalike
from spanloom.functions.lookalike import PROTOTYPES, TWINS, fold, is_plain, skeleton


def test_tables_pair_one_character_with_one():
    assert all(len(a) == len(b) for a, b in TWINS.values()) and all(skeleton(b) == unicodedata.normalize("NFD", b) for b in PROTOTYPES.values())


@pytest.mark.parametrize("script,name", [("cyrillic", "CYRILLIC"), ("cyrillic, wider", "CYRILLIC"), ("greek", "GREEK"), ("greek, wider", "GREEK"), ("armenian", "ARMENIAN"), ("coptic", "COPTIC"), ("cherokee", "CHEROKEE"), ("lisu", "LISU")])
def test_letters_are_of_their_script_and_case(script, name):
    for a, b in zip(*TWINS[script]):
        assert unicodedata.name(a).startswith(name) and (a.islower() == b.islower() or script in ("lisu", "cherokee", "armenian", "cyrillic", "cyrillic, wider")), (a, b)


@pytest.mark.parametrize("a,b", [("ρ", "p"), ("ν", "v"), ("օ", "o"), ("ո", "n"), ("Ӏ", "I"), ("ү", "y"), ("ɑ", "a"), ("Ｂ", "B"), ("é", "é"), ("a\u00a0b", "a b"), ("a\u200bb", "ab"), ("ﬁ", "fi"), ("𝐀", "A"), ("ё", "ë"), ("へ", "ヘ"), ("۲", "٢"), ("ﺏ", "ب"), ("\u212a", "K"), ("⼈", "人")])
def test_twins_look_the_same(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("2", "²"), ("½", "1/2"), ("–", "-"), ("'", "’"), ("\n", "\r\n"), ("\n", " "), ("γ", "y"), ("l", "1"), ("ı", "i")])
def test_what_can_be_told_apart_stays_apart(a, b):
    assert skeleton(a) != skeleton(b)


def test_fold_maps_every_character_back():
    for t in ("plain", "", "Νаdіa\u200b Ｂay é e\u0301\u0323 x", "\u0301a", "ﬁn\u200b end\u200b", "x\U0001f600y𝐀", "は\u3099がา ำ"):
        plain, at = fold(t)
        if at is None:
            assert plain == t
            continue
        assert len(at) == len(plain) + 1 and at[-1] == len(t) and at == sorted(at) and fold(plain)[0] == plain
        back = "".join(fold(t[a:b])[0] for a, b in zip(sorted(set(at)), sorted(set(at))[1:]))
        assert skeleton(back) == skeleton(plain) == skeleton(t)
    assert is_plain("é日本語 ไทย") and not is_plain("e\u0301") and lookalike.fold("ｗ")[0] == "w"
