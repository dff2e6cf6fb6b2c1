"""Porter stemmer (Porter 1980) with the NLTK-extension rules, for stemmed ROUGE.

A per-token helper: the metric applies it to tokens longer than three
characters through an Arrow UDF over token arrays, with a per-worker cache
(token frequencies are Zipfian, so most lookups hit the cache).

NLTK-extension differences from the published algorithm, as used by the
ROUGE scorer: a small table of irregular forms; ``-ies``/``-ied`` on
four-letter words keep ``ie``; ``y -> i`` needs a consonant before it and a
stem longer than one letter; a two-letter vowel-consonant stem counts as
``*o``; ``alli`` is handled before the other step-2 rules and re-run;
``bli -> ble``, ``fulli -> ful`` and ``logi -> log`` (measure taken with the
``l`` kept) are step-2 rules.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms of the NLTK extension (form -> stem).
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

_VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _consonant(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """Number of vowel-consonant transitions (the m of [C](VC)^m[V])."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _consonant(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double_consonant(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3:
        return (_consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1)
                and w[-1] not in "wxy")
    return len(w) == 2 and not _consonant(w, 0) and _consonant(w, 1)


def _m_gt(n: int):
    return lambda stem: _measure(stem) > n


def _apply(word: str, rules) -> str:
    """First rule whose suffix matches decides: replace if its condition holds, else stop."""
    for suffix, repl, cond in rules:
        if suffix == "*d":
            if _double_consonant(word):
                stem = word[:-2]
                return stem + repl(word) if cond(word) else word
            continue
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + repl if cond is None or cond(stem) else word
    return word


_STEP1A = (("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None))
_STEP2 = tuple((s, r, _m_gt(0)) for s, r in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")))
_STEP3 = tuple((s, r, _m_gt(0)) for s, r in (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
_STEP4 = tuple((s, "", _m_gt(1)) for s in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent")) + (
    ("ion", "", lambda stem: _measure(stem) > 1 and stem[-1:] in ("s", "t")),) + tuple(
    (s, "", _m_gt(1)) for s in ("ou", "ism", "ate", "iti", "ous", "ive", "ize"))


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    return _apply(w, _STEP1A)


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _measure(stem) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: len(w) - len(suffix)]):
            stem = w[: len(w) - len(suffix)]
            break
    else:
        return w
    return _apply(stem, (
        ("at", "ate", None), ("bl", "ble", None), ("iz", "ize", None),
        ("*d", lambda s: s[-1], lambda s: s[-1] not in "lsz"),
        ("", "e", lambda s: _measure(s) == 1 and _cvc(s)),
    ))


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _consonant(w, len(w) - 2):
        return w[:-1] + "i"
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-4] + "log" if _measure(w[:-3]) > 0 else w
    return _apply(w, _STEP2)


def _step5a(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            return stem
    return w


def _step5b(w: str) -> str:
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        return w[:-1]
    return w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Stem one lower-case token."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _step1a(word)
    w = _step1b(w)
    w = _step1c(w)
    w = _step2(w)
    w = _apply(w, _STEP3)
    w = _apply(w, _STEP4)
    w = _step5a(w)
    return _step5b(w)
