"""Languages of short texts, by script and function words."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

# Frequent function words of each language, in alphabetical order.
FUNCTION_WORDS = {
    "de": "aber als am auch auf aus bei beim bin bis da dann das dass dazu dein dem den denn der des dich die dies dieser dir doch du durch ein eine einem einen einer er es euch für gibt hast hat heißt ich ihm ihn ihr im ist ja kann kein keine mal man mein mich mir mit mittels müssen nach nicht noch nur ob oder oft ohne sein sich sie sind so über um und uns unter vom von vor war wäre warum was weil weiß wenn wer werden wie wir wird wo wurde zu zum zur zwei zwischen würde würdest",
    "en": "a about after all also am an and any are as at be been both but by can could did do does first for from had has have he her him his how i if in into is it its just let like may me might more most my no nor not now of on one only or other our out over own shall she should so some such than that the their them then there these they this those though to too under until up us was we were what when where whether which while who whom whose why will with without would yet you your yours",
    "es": "a al algo aunque como con cual cuando de del desde dice donde dos e el ella ellos en entonces entre era es esa ese eso esta está este esto estos fue ha hace hacia hasta hay la las le les lo los más me mi mí mis muy nada ni no nos nunca o para pero poco por porque pues que qué quien se ser si sí siempre sin sobre son su sus también te tener tiene todo tras tu un una unas uno unos usted van y ya yo",
    "fr": "ai alors as au aussi autre aux avec avons bien car ce ceci cela ces cet cette chez comme dans de depuis des deux doit donc du elle elles en ensemble entre es est et eux fut ici il ils j'ai je la le les leur lui l'on ma mais me mes moi mon même n'a ne ni nos notre nous on ont ou où par parce pas peu peut plus pour pourquoi puis qu'il que quel quelle qui quoi sa sans se ses si son sont sous sur ta te tes toi ton toujours tous tout très tu un une va vers vont vos votre vous y à étaient était être",
}
#: What language_chars() tells apart; "" where nothing tells.
LANGUAGES = ("", "de", "en", "es", "fr", "ja", "ru")
# Names of the languages in these languages.
LANGUAGE_NAMES = {
    "de": "alemán allemand deutsch german",
    "en": "anglais englisch english inglés",
    "es": "espagnol español spanisch spanish",
    "fr": "francés français french französisch",
    "ja": "japanese japanisch japonais japonés",
    "ru": "russe russian russisch ruso",
}
_ASKED = re.compile(r"\b(" + "|".join(w for v in LANGUAGE_NAMES.values() for w in v.split()) + r")\b")
_NAMED = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}
#: Script ranges that settle the language of a passage by themselves.
_SCRIPTS = (("ja", re.compile(r"[぀-ヿ㐀-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")))
_ORDER = ("de", "en", "es", "fr")
_WHOLE, _BITS = 12, 32
# Word -> its weight for each language, packed into one number that can be summed: a word of several languages says less for
# each (12 is divided by up to four languages without rest).
_packed: dict[str, int] = {}
for _w in {w for v in FUNCTION_WORDS.values() for w in v.split()}:
    _of = [i for i, x in enumerate(_ORDER) if _w in FUNCTION_WORDS[x].split()]
    _packed[_w] = sum(_WHOLE // len(_of) << _BITS * i for i in _of)
_FRENCH = re.compile(r"(?<![^\W_])(?:[cdjlmnst]|qu)['’][^\W\d_]{2}")
_MARKS = (("es", "ñóíú"), ("fr", "èêçùœâîûë"), ("de", "äöüß"))


def _prepared(text: str) -> str:
    """Without case, and with one mark, ". ", at the ends of sentences and lines and none inside."""
    t = text.casefold().replace("! ", ". ").replace("? ", ". ").replace("\n", ". ")
    return t.replace(",", " ").replace("?", " ").replace(":", " ").replace("(", " ").replace("“", " ")


def _scores(folded: str) -> dict[str, float]:
    """Weight of function words by language; French elisions and the letters of a language count as well."""
    out: dict[str, float] = {}
    total = sum(map(_packed.get, folded.split(), repeat(0)))
    if total:
        for lang in _ORDER:
            n = total & (1 << _BITS) - 1
            if n:
                out[lang] = n / _WHOLE
            total >>= _BITS
    if "'" in folded or "’" in folded:
        n = len(_FRENCH.findall(folded))
        if n:
            out["fr"] = out.get("fr", 0.0) + n
    if not folded.isascii():
        if "¿" in folded or "¡" in folded:
            out["es"] = out.get("es", 0.0) + 2
        for lang, chars in _MARKS:
            n = sum(map(folded.count, chars))
            if n:
                out[lang] = out.get(lang, 0.0) + 0.5 * n
    return out


@lru_cache(maxsize=50_000)
def _language(folded: str) -> str:
    if not folded.isascii():
        letters = sum(map(str.isalpha, folded))
        for lang, script in _SCRIPTS:
            if len(script.findall(folded)) * 2 > letters > 0:
                return lang
    found = _scores(folded)
    if len(found) < 2:
        return next(iter(found), "")
    first, second = sorted(found, key=lambda k: (-found[k], k))[:2]
    return first if found[first] > found[second] else ""


def segment_language(segment: str) -> str:
    """Language of one short text, "" where nothing tells."""
    return _language(_prepared(segment).replace(".", " "))


def language_chars(text: str) -> dict[str, int]:
    """Characters of the text by language of the sentence or line that they stand in; "" where nothing tells."""
    out: dict[str, int] = {}
    for s in _prepared(text).rstrip(".").split(". "):
        if s:
            lang = _language(s)
            out[lang] = out.get(lang, 0) + len(s) + 2
    return out


@lru_cache(maxsize=20_000)
def question_language(question: str) -> str:
    """segment_language of a question; questions come again and again."""
    return segment_language(question)


@lru_cache(maxsize=20_000)
def asked_for(question: str) -> set[str]:
    """Languages that the question names."""
    return {_NAMED[w] for w in _ASKED.findall(question.casefold())}
