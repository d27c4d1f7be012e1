"""Stems of English, German and Spanish words, by the published suffix-stripping algorithms."""

from __future__ import annotations

from collections.abc import Callable


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first vowel with a consonant behind it, and the same again from there."""

    def after(at: int) -> int:
        for i in range(at + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = after(0)
    return r1, after(r1)


def _longest(w: str, suffixes: str, at: int = 0) -> str:
    """The longest of the suffixes that w has from place ``at`` on, or nothing."""
    return max((s for s in suffixes.split() if w.endswith(s) and len(w) - len(s) >= at), key=len, default="")


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    # u and y between vowels are consonants
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    r1, r2 = _regions(w, vowels)
    r1 = max(r1, 3)

    found = _longest(w, "em ern er e en es s")
    if found and len(w) - len(found) >= r1 and (found != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(found)]
        if found in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    found = _longest(w, "en er est st")
    if found and len(w) - len(found) >= r1 and (found != "st" or (len(w) >= 6 and w[-3] in "bdfghklmnt")):
        w = w[: -len(found)]

    inside = lambda s, r: w.endswith(s) and len(w) - len(s) >= r
    found = _longest(w, "end ung ig ik isch lich heit keit")
    if found and inside(found, r2) and not (found in ("ig", "ik", "isch") and w[: -len(found)].endswith("e")):
        w = w[: -len(found)]
        if found in ("end", "ung") and inside("ig", r2) and not w.endswith("eig"):
            w = w[:-2]
        elif found in ("lich", "heit") and (inside("er", r1) or inside("en", r1)):
            w = w[:-2]
        elif found == "keit":
            w = w[: -len(_longest(w, "lich ig", r2)) or None]
    return w.lower().translate(str.maketrans("äöü", "aou"))


_PLAIN = str.maketrans("áéíóú", "aeiou")
_VERBS = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos
erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an
aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis
abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"""
_NOUNS = {
    "cut": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias",
    "log": "logía logías",
    "u": "ución uciones",
    "ente": "encia encias",
    "amente": "amente",
    "mente": "mente",
    "idad": "idad idades",
    "iv": "iva ivo ivas ivos",
}


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    w = word
    r1, r2 = _regions(w, vowels)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in vowels:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
        elif w[0] in vowels:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
        else:
            rv = 3

    found = _longest(w, "me se sela selo selas selos la le lo las les los nos", rv)
    if found:
        base = w[: -len(found)]
        before = _longest(base, "iéndo ándo ár ér ír ando iendo ar er ir", rv)
        if before:
            w = base[: -len(before)] + before.translate(_PLAIN)
        elif _longest(base, "yendo", rv) and base.endswith("uyendo"):
            w = base

    start = w
    found = _longest(w, " ".join(_NOUNS.values()))
    kind = next((k for k, v in _NOUNS.items() if found and found in v.split()), "")
    inside = lambda s, r=r2: w.endswith(s) and len(w) - len(s) >= r
    if kind and inside(found, r1 if kind == "amente" else r2):
        w = w[: -len(found)]
        if kind in ("log", "u", "ente"):
            w += kind
        elif kind == "ic":
            w = w[:-2] if inside("ic") else w
        elif kind == "amente":
            if inside("iv"):
                w = w[:-2]
                w = w[:-2] if inside("at") else w
            elif inside("os") or inside("ic") or inside("ad"):
                w = w[:-2]
        elif kind == "mente":
            w = w[: -len(_longest(w, "ante able ible", r2)) or None]
        elif kind == "idad":
            w = w[: -len(_longest(w, "abil ic iv", r2)) or None]
        elif kind == "iv":
            w = w[:-2] if inside("at") else w
    if w == start:
        found = _longest(w, "ya ye yan yen yeron yendo yo yó yas yes yais yamos", rv)
        if found and w[: -len(found)].endswith("u"):
            w = w[: -len(found)]
        else:
            found = _longest(w, "en es éis emos " + _VERBS, rv)
            if found:
                w = w[: -len(found)]
                if found in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    found = _longest(w, "os a o á í ó e é", rv)
    if found:
        w = w[: -len(found)]
        if found in ("e", "é") and w.endswith("gu") and len(w) > rv:
            w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS: dict[str, Callable[[str], str]] = {"german": german, "spanish": spanish}
