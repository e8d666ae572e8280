"""The published Spanish Snowball stemmer (R1, R2 and RV regions, steps 0 to 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
_VOWELS = frozenset("aeiouáéíóúü")
_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_BEFORE_ACCENTED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_BEFORE_PLAIN = ("iendo", "ando", "ar", "er", "ir")
_DELETE_R2 = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos")
_WITH_IC = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
_VERB_Y = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_VERB_GU = ("en", "es", "éis", "emos")
_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran "
    "ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _after_first_consonant(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if word[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def _longest(word: str, endings, start: int) -> str:
    found = [e for e in endings if word.endswith(e) and len(word) - len(e) >= start]
    return max(found, key=len, default="")


def stem(word: str) -> str:
    rv = _rv(word)
    r1 = _after_first_consonant(word, 0)
    r2 = _after_first_consonant(word, r1)
    word = _pronoun(word, rv)
    done, word = _standard(word, r1, r2)
    if not done:
        word = _verb(word, rv)
    return _residual(word, rv).translate(str.maketrans("áéíóú", "aeiou"))


def _pronoun(word: str, rv: int) -> str:
    if not (p := _longest(word, _PRONOUNS, rv)):
        return word
    rest = word[: -len(p)]
    if e := _longest(rest, _BEFORE_ACCENTED, rv):
        return rest[: -len(e)] + _BEFORE_ACCENTED[e]
    if _longest(rest, _BEFORE_PLAIN, rv) or (_longest(rest, ("yendo",), rv) and rest.endswith("uyendo")):
        return rest
    return word


def _drop(word: str, endings, start: int) -> str:
    e = _longest(word, endings, start)
    return word[: -len(e)] if e else word


def _standard(word: str, r1: int, r2: int) -> tuple[bool, str]:
    every = (*_DELETE_R2, *_WITH_IC, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos")
    e = max((x for x in every if word.endswith(x)), key=len, default="")
    if not e or len(word) - len(e) < (r1 if e == "amente" else r2):
        return False, word
    base = word[: -len(e)]
    if e in _WITH_IC:
        base = _drop(base, ("ic",), r2)
    elif e in ("logía", "logías"):
        base += "log"
    elif e in ("ución", "uciones"):
        base += "u"
    elif e in ("encia", "encias"):
        base += "ente"
    elif e == "amente":
        if base.endswith("iv") and len(base) - 2 >= r2:
            base = _drop(base[:-2], ("at",), r2)
        else:
            base = _drop(base, ("os", "ic", "ad"), r2)
    elif e == "mente":
        base = _drop(base, ("ante", "able", "ible"), r2)
    elif e in ("idad", "idades"):
        base = _drop(base, ("abil", "ic", "iv"), r2)
    elif e in ("iva", "ivo", "ivas", "ivos"):
        base = _drop(base, ("at",), r2)
    return True, base


def _verb(word: str, rv: int) -> str:
    if e := _longest(word, _VERB_Y, rv):
        if word[: -len(e)].endswith("u"):
            return word[: -len(e)]
    e = _longest(word, (*_VERB, *_VERB_GU), rv)
    if not e:
        return word
    word = word[: -len(e)]
    return word[:-1] if e in _VERB_GU and word.endswith("gu") else word


def _residual(word: str, rv: int) -> str:
    e = _longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if not e:
        return word
    word = word[: -len(e)]
    if e in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
        word = word[:-1]
    return word


#: Words whose stems a worker keeps.
STEMS = 100_000


class _Stems(dict):
    """Stems of the words that a worker has met; forgotten when there are many."""

    def __missing__(self, word: str) -> str:
        if len(self) >= STEMS:
            self.clear()
        self[word] = out = stem(word)
        return out


_STEMS = _Stems()


def stem_tokens(tokens: Column) -> Column:
    """Stems of an array of words, in Arrow batches; each distinct word is stemmed once a worker."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda words: None if words is None else list(map(_STEMS.__getitem__, words)))

    return run(tokens)
