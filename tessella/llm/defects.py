"""Kinds of answers that are no answer: empty, refusal, question given back, other language. Truncation: see truncation.

Copies of the question are found by greedy string tiling of the two word lists, other languages by script and function
words, refusals by a grammar of clauses: an answer is one if each of its sentences refuses or is an aside, and at least one
refuses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from tessella.llm.language import asked_for, language_chars, question_language

#: Shortest tile of words (shorter ones only where the whole question is shorter); share of the question that tiles must
#: cover; words of framing allowed.
TILE, COVER, FRAME = 3, 0.8, 4
#: Share of an answer's attributable characters that must be in another language.
OTHER = 0.6

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。…])[\"”»)]*\s+|\n+")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”")

# The grammar of refusals, from parts. A clause refuses if somebody who speaks has no ability, leave or wish to speak or help; if
# they decline; if the matter is closed; or if others are to be asked. Parts are patterns over folded text.
_ADVERB = r"(?:(?:really|simply|truly|just|respectfully|politely|firmly|regretfully|kindly|sadly|afraid|honestly|therefore|in good (?:conscience|faith)|at this time|here) )*"
_UNABLE = (
    r"(?:(?:can ?not|can't|could not|couldn't|won't|will not|shall not|shan't|may not|must not|mustn't|do not|don't|would not|wouldn't"
    r"|(?:am|'m|are|'re) (?:not (?:able|permitted|allowed|free|willing|prepared|ready|going|supposed|here|at liberty|in a position)|in no position|unable|unwilling|forbidden) to"
    r"|have no (?:wish|intention|desire|mind|leave|right) (?:to|of)|(?:would|'d) (?:rather|prefer) not(?: to)?|prefer not(?: to)?|choose not to"
    r"|(?:must |have to |shall |will |'ll )?(?:refuse|decline) to"
    r"|(?:have been|was|am|'ve been) (?:asked|told|ordered|instructed|advised|taught) not to) )"
)
_SPEAK = (
    r"(?:help(?! \w+ing\b)|assist|answer|reply|respond|comply|discuss|provide|share|offer|give|produce|create|generate|talk|speak|say(?! that\b)|tell(?! (?:you )?how (?:much|often))|comment|advise|explain|reveal|disclose"
    r"|engage|oblige|go (?:into|along|there)|weigh in|take (?:part|this|that|it|on|up|questions)|do (?:that|this|so|it|questions)|fulfill?|support|participate|touch|get into|be (?:drawn|of (?:help|use|service))|entertain"
    r"|feel (?:comfortable|at ease|able|free)|be able to (?:help|assist|answer))\b"
)
_DECLINE = r"(?:decline|refuse|pass|abstain|demur|(?:keep|stay|remain) (?:silent|quiet)|say nothing|hold my (?:tongue|peace)|keep (?:that|this|it) to myself|leave .+ (?:alone|aside|unanswered|there))\b"
_MATTER = r"(?:that|this|it|(?:such|the|your|this|that|these|those|an?) (?:.+ )?(?:questions?|requests?|matters?|things?|subjects?|topics?|answers?|doors?|issues?|quer(?:y|ies))|(?:questions|requests|matters|things|topics|answers) (?:of|like) .+|(?:talking|speaking|writing|answering|discussing|giving|helping|commenting|advising|providing|sharing)(?: .+)?|.+ of (?:this|that) (?:kind|sort|nature))"
_WHO, _DO = r"(?:i|we)", r"(?:can|may|will|could|wish to|want to|care to|am|are|do|take|discuss|talk|speak|share|answer|accept)"
_IS = r"(?:is|are|'s|'re|falls?|lies?|goes|sits|stays?|remains?|must (?:stay|remain)|will (?:stay|remain)|would be|has to (?:stay|remain))"
_CLOSED = (
    rf"(?:{_IS} (?:shut|closed|sealed|off limits|off the table|out of bounds|private|secret|unanswered|between .+|with me|mine(?: .+)?)"
    rf"|{_IS} (?:well |far )?(?:outside|beyond|against|past|not within) (?:what|my|our|the|anything) ?.*"
    rf"|{_IS} ?(?:not|n't) (?:possible|permitted|allowed|mine|for me|(?:something|anything|an?|the|one|ones)(?: .+)? {_WHO} {_DO}\b.*)(?: .+)?"
    rf"|(?:isn't|aren't) (?:possible|permitted|allowed|mine|for me|(?:something|anything|an?|the|one|ones)(?: .+)? {_WHO} {_DO}\b.*)(?: .+)?"
    r"|(?:would not|wouldn't) be (?:right|proper|appropriate|fair|responsible|wise)(?: .+)?|would be (?:wrong|improper|inappropriate|irresponsible|unwise)(?: .+)?|stays? with me)"
)
_RULES = (
    rf"(?:.+ )?{_WHO}(?: |(?='))(?:am )?{_ADVERB}{_UNABLE}{_ADVERB}{_SPEAK}.*",
    rf"(?:.+ )?{_WHO}(?: |(?='))(?:(?:must|(?:'ll |will )?have to|shall|will|'ll|would|'d|am going to|'m going to|need to|(?:am|'m) afraid i must|(?:would|'d) (?:rather|prefer to)) )?{_ADVERB}{_DECLINE}.*",
    rf"(?:.+ )?{_MATTER} {_CLOSED}",
    rf".+ (?:outside|beyond) what (?:i|we) .+|.+ (?:is|are)(?: not|n't) (?:something|an? (?:topic|question|subject|matter|thing)|ones?) {_WHO} {_DO}\b.*|.+ of .+ (?:stays|remains) (?:with|between) .+",
    rf"(?:.+ )?{_WHO} ?(?:am|'m|are) (?:not the (?:one|person) to|the wrong (?:one|person) to) .+",
    r"(?:count|leave) me out.*|my lips are sealed.*|no comment.*|(?:.+ )?(?:you'll|you will|you shall) (?:get|have|hear|receive|find) (?:no|nothing)\b.*",
    r"(?:some|any)(?:one|body)(?: else)? (?:will have to|must|should|may have to|can) (?:tell|answer|help|advise|explain)\b.*",
    # the same in other languages
    r"(?:.+ )?(?:ich )?(?:kann|möchte|darf|will|werde) (?:.+ )?(?:nicht|nichts) (?:.+ )?(?:beantworten|antworten|helfen|sagen|reden|sprechen|äußern|schreiben)|(?:.+ )?ich (?:lehne|verweigere|weigere) .+",
    r"(?:.+ )?je (?:ne (?:peux|veux|puis|dois|saurais|souhaite)|préfère (?:ne )?|refuse|dois refuser)(?: .+)?(?: |^)(?:répondre|aider|parler|dire|commenter|écrire|décliner)(?: .+)?",
    r"(?:.+ )?(?:no (?:puedo|quiero|debo|voy a|me es posible)|prefiero no|me niego a|debo negarme a|tengo que negarme a) (?:.+ )?(?:responder|ayudar\w*|hablar|decir\w*|contestar|comentar|escribir)(?: .+)?",
    r"(?:申し訳|すみません|お答え|それには).*(?:できません|ません|ありません)",
    r"(?:.+ )?не (?:могу|буду|хочу|стану) (?:.+ )?(?:ответить|отвечать|помочь|говорить|обсуждать)(?: .+)?",
)
#: What may stand beside a refusal, as a clause or sentence of its own: apologies, addresses, requests to drop it or to ask elsewhere.
_ASIDES = (
    r"(?:no|alas|sorry|listen|leider|unfortunately|regrettably|regretfully|sadly|desgraciadamente|malheureusement|désolée?|perdón|(?:forgive|pardon|excuse) me|with (?:all (?:due )?)?respect|(?:my )?apologies|i (?:do )?apologi[sz]e|lo siento|(?:es )?tut mir leid|je suis désolée?|je regrette|thank you|thanks)"
    r"(?:,? (?:friend|my friend|dear .+|traveller|stranger|for .+))?",
    r"(?:i am|i'm|we are|we're) (?:so |very |truly |really |terribly )*(?:sorry|afraid)(?: (?:to|that|about|for) .+)?",
    r"i (?:hope|trust)(?: that)? you(?: can|'ll| will| may)? (?:understand|accept|forgive|respect) .*",
    r"(?:please )?(?:don't|do not) (?:press|push|tempt|insist)\b.*",
    r"(?:please )?(?:ask|try|consult|seek|turn to|speak to|talk to) (?:me about |someone|somebody|another|a |an |your |others?\b).*",
    r"(?:could|can|may|shall|might) (?:we|i) (?:choose|talk|speak|turn|help|move|change|discuss|pick|try)\b.*(?:else|another|other|different)\b.*",
    r"(?:let us|let's|perhaps we (?:can|could)) (?:talk|speak|turn|move|change|discuss|pick|choose|leave)\b.*",
    r"is there (?:anything|something) .*",
    r"(?:even |but |and )?as (?:a|an|the|your) [^,]+",
    r"good (?:night|day|bye).*|goodbye.*|farewell.*",
)
_REFUSES = re.compile("|".join(f"(?:{r})" for r in _RULES))
_ASIDE = re.compile("|".join(f"(?:{r})" for r in _ASIDES))
#: Where one clause ends and another begins that may take back what the first says.
_CLAUSE = re.compile(r"(?:[,;:]|\s[—–-])\s*(?:but|however|though|although|yet|aber|pero|mais|so here)\s+|;\s+|\s[—–]\s")
_LEAD = re.compile(r"(?:(?:no|alas|sorry|listen|leider|unfortunately|regrettably|sadly|désolée?|lo siento|tut mir leid|(?:forgive|pardon|excuse) me(?:, friend)?|my apologies|with respect|(?:even |but |and )?as (?:a|an|the) [^,;:]+|i'm sorry|i am sorry)[,;:]\s*)+")


@lru_cache(maxsize=50_000)
def _says(sentence: str) -> str:
    """What a folded sentence does: "refuses", "aside", or "" for anything else. Each of its clauses must do one of these."""
    said = ""
    for clause in _CLAUSE.split(sentence):
        bare = _LEAD.sub("", clause, count=1).strip(" ,;:")
        if _REFUSES.fullmatch(bare):
            said = "refuses"
        elif bare and not _ASIDE.fullmatch(bare) and not _ASIDE.fullmatch(clause.strip(" ,;:")):
            return ""
        else:
            said = said or "aside"
    return said


def is_refusal(output: str) -> bool:
    """Whether the answer consists of nothing but refusing: sentences that refuse, and asides. It stops at the first sentence
    that does neither, so an answer costs no more than its beginning, however long it is."""
    said = False
    for part in _sentences(output):
        p = part.strip().strip("\"“”«»*_#> ").casefold().replace("’", "'").replace("'s not ", " is not ").rstrip(".!?… 。")
        if p:
            kind = _says(p)
            if not kind:
                return False
            said |= kind == "refuses"
    return said


def _sentences(output: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE.finditer(output):
        yield output[at : m.start()]
        at = m.end()
    yield output[at:]


def tiles(a: list[str], b: list[str], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (begin in a, begin in b, words) of the longest common runs, longest first, no word used twice.

    Runs of fewer than `least` words are no tiles, unless b is shorter than that.
    """
    least = min(least, len(b)) or 1
    free_a, free_b = [True] * len(a), [True] * len(b)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    out: list[tuple[int, int, int]] = []
    while True:
        best: tuple[int, int, int] = (0, 0, 0)
        for i, w in enumerate(a):
            if not free_a[i]:
                continue
            for j in where.get(w, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


def copies_question(question: list[str], answer: list[str]) -> bool:
    """Whether the answer is the question again, once or several times, whole or almost, with at most a few framing words.

    Copies are taken off the front of the answer one after the other, each by tiling what the length of a question and its
    framing allows, until something else is left; so the work grows with the answer, not with its square.
    """
    if not question or not answer:
        return False
    at = rounds = own = 0
    size, words = len(question) + FRAME, set(question)
    while at < len(answer):
        part = answer[at : at + size]
        if sum(w in words for w in part) < COVER * len(question):
            break
        found = _ordered(part, question)
        if sum(n for *_, n in found) < COVER * len(question):
            break
        rounds += 1
        end = max(i + n for i, _, n in found)
        own += end - sum(n for *_, n in found)
        at += end
    left = answer[at:]
    return rounds > 0 and len(left) <= FRAME and own + len(left) <= FRAME * rounds + (1 - COVER) * len(answer)


def _ordered(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Tiles of a and b that stand in a as they do in b, so that shuffled words are no copy: the longest first, none of fewer
    than TILE words but those between or beside such tiles."""
    kept: list[tuple[int, int, int]] = []
    for i, j, n in tiles(a, b, 1):
        if n < min(TILE, len(b)) and not kept:
            break
        if all((i < x) == (j < y) for x, y, _ in kept):
            kept.append((i, j, n))
    return kept


@lru_cache(maxsize=20_000)
def _words_of(question: str) -> list[str]:
    return _WORD.findall(question.casefold())


def _may_copy(question: list[str], answer: list[str]) -> bool:
    """Whether the whole answer has enough words of the question, and few enough others: a quick check that no copy fails.

    Each copy takes up COVER of the question's words at least, so the shared words bound how many copies, and with them how
    many words of framing, copies_question can find.
    """
    own = set(question)
    shared = sum(w in own for w in answer)
    copies = shared / (COVER * len(question))
    return shared >= COVER * len(question) and len(answer) - shared <= FRAME * copies + (1 - COVER) * len(answer) + 1e-6


def defect_hint(question: str, output: str | None, languages: dict[str, int]) -> tuple[str | None, bool]:
    """(defect or None, whether the output is an echo of the question's words alone).

    output: the answer without thinking, None if it ends within; languages: its characters by language.
    """
    if output is None:
        return None, False
    if not _WORD.search(output):
        return "empty", True
    asked = _words_of(question)
    echo = False
    answer = _WORD.findall(output.casefold()) if asked else []
    if asked and _may_copy(asked, answer) and copies_question(asked, answer):
        # one word may be missing, but not the last: that would be a copy that breaks off
        return "copies_question", answer[-1] == asked[-1]
    if is_refusal(output):
        return "refusal", echo
    if asked and other_language(question, output, languages):
        return "other_language", echo
    return None, echo


def other_language(question: str, output: str, languages: dict[str, int]) -> bool:
    """Whether most of the answer is in a language other than the question's that the question doesn't ask for."""
    mine = question_language(question)
    if not mine:
        return False
    known = {k: n for k, n in languages.items() if k}
    if not known:
        return False
    if "«" in output or "“" in output:
        bare = _QUOTED.sub(lambda m: " " if len(m.group()) < len(output) / 2 else m.group(), output)
        known = {k: n for k, n in language_chars(bare).items() if k} or known
    top = max(known, key=lambda k: (known[k], k))
    return top != mine and top not in asked_for(question) and known[top] >= OTHER * sum(known.values())
