"""What a freely typed name of an organisation or a person is made of.

A name of an organisation is read as a core, the proper name, and concepts, the words that many
names have: kind of body, line of business, field. Which words these are, and which of two
languages mean the same, is learned from a register (lexicon.py); here they are found in names
with typing errors and abbreviated. Cores are compared as consonants, in which Hebrew and its
transliteration agree, or as letters.
"""

from __future__ import annotations

import re
import unicodedata

#: Legal forms and words for a body as such, which tell no organisations apart.
LEGAL_FORMS = "בעמ ltd limited inc co company חברת חברה group grp קבוצת קבוצה"
#: Words that say who speaks for an organisation, and words without meaning here.
ROLES = (
    "נציגי נציג נציגת יור דירקטוריון דירקטור דירקטורית בשם צוות לשכת בשליחות מטעם מנכל rep representative behalf board legal counsel ceo"
    " spokesperson director chairperson"
)
FILLERS = "of for and the on למען של &"
#: Placeholders in place of a name.
PLACEHOLDERS = "אחר|לא ידוע|תושב|תושבת|פרטי|עצמאי|אזרח|self employed|private|none|n/a|na|unknown|other|resident|retired|אין|ללא|citizen"

#: Titles of persons.
TITLES = (
    "mr mrs ms miss dr prof professor adv mk hon rev sir rabbi eng jr sr phd מר גב גברת דר פרופ פרופסור עוד חכ הרב אינג שר השר השרה"
    " סא אלמ תא נצמ"
)

#: Consonants of the Hebrew letters and of their usual transliteration.
HEBREW = dict(
    א="a", ב="b", ג="g", ד="d", ה="h", ו="w", ז="z", ח="C", ט="t", י="i", כ="k", ל="l", מ="m", נ="n", ס="s",
    ע="y", פ="p", צ="T", ק="q", ר="r", ש="S", ת="H",
)
FINALS = str.maketrans("ךםןףץ", "כמנפצ")
#: Hebrew letters that sound alike, which typing errors exchange.
ALIKE = str.maketrans("טקאשו", "תכעסב")
PAIRS = {"tz": "T", "ch": "C", "sh": "S", "th": "H"}

_QUOTES = re.compile("[\"'`´‘’‚‛“”„‟′″׳״]")
_DROPPED = re.compile("[​-‏‪-‮⁠-⁩﻿֑-ׇ]")
_HEBREW = re.compile("[א-ת]")


def words(name: str) -> list[str]:
    """The words of a name in lower case, without quotes and dots, final letters made plain."""
    text = unicodedata.normalize("NFKC", name).lower()
    text = _DROPPED.sub("", text)
    # a word in quotes loses them; an inner quote or dot belongs to an abbreviation
    text = re.sub(r"(?<=\w)['\"׳״’”]{1,2}(?=\w)", "", text)
    text = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", text)
    text = re.sub(r"\b(\w)\.(?=\w\.|\w\b)", r"\1", text)
    return re.findall(r"\w+", _QUOTES.sub(" ", text).replace("_", " ").translate(FINALS))


def within(a: str, b: str, most: int) -> bool:
    """Whether two words differ by at most so many insertions, deletions, substitutions or swaps of neighbours."""
    return distance(a, b, most) <= most


def distance(a: str, b: str, most: int = 9) -> int:
    """Edits between two words, swaps of neighbours counted as one; more than `most` may come out as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if earlier is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, earlier[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
    return row[-1]


def _deletions(word: str, most: int) -> set[str]:
    found = {word}
    layer = {word}
    for _ in range(most):
        layer = {w[:k] + w[k + 1 :] for w in layer for k in range(len(w))}
        found |= layer
    return found


def _errors(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


class Lexicon:
    """The generic words of a register: their concept, how often they occur and lead, and which concepts go together."""

    def __init__(self, words: dict[str, tuple[str, int, int]], together: dict[tuple[str, str], int]) -> None:
        plain = lambda text: [w.translate(FINALS) for w in text.split()]
        self.words, self.together = words, together
        self.weights: dict[str, int] = {}
        self.core_weight = 1
        self.held: dict[str, frozenset[str]] = {}
        self.initials: dict[str, str] = {}
        self.places: dict[str, set[str]] = {}
        self.void = {**dict.fromkeys(plain(FILLERS), ""), **dict.fromkeys(plain(LEGAL_FORMS), ""), **dict.fromkeys(plain(ROLES), "")}
        self.exact = {**{w: concept for w, (concept, _, _) in words.items()}, **self.void}
        self.near: dict[str, list[str]] = {}
        for word in self.exact:
            for d in _deletions(word, _errors(word)):
                self.near.setdefault(d, []).append(word)
        # abbreviations begin like their word
        self.by_first: dict[str, list[str]] = {}
        for word in words:
            self.by_first.setdefault(word[0], []).append(word)
        self._seen: dict[str, str | tuple[str, ...] | None] = {}

    def read(self, word: str) -> str | tuple[str, ...] | None:
        """The concept of a word, '' for one without meaning, several words it may abbreviate, None for a proper name."""
        if word not in self._seen:
            if len(self._seen) >= 1 << 17:
                self._seen.clear()
            self._seen[word] = self._read(word)
        return self._seen[word]

    def _read(self, word: str) -> str | tuple[str, ...] | None:
        found = self.exact.get(word)
        if found is not None:
            return found
        best = None
        for d in _deletions(word, 2 if len(word) >= 8 else 1 if len(word) >= 4 else 0):
            for other in self.near.get(d, ()):
                limit = min(_errors(other), 2 if len(word) >= 8 else 1 if len(word) >= 4 else 0)
                far = distance(word, other, limit)
                rank = (far, word.translate(ALIKE) != other.translate(ALIKE), other)
                if far <= limit and (best is None or rank < best):
                    best = rank
        if best:
            return self.exact[best[2]]
        longer = [w for w in self.by_first.get(word[0], ()) if len(w) > len(word)]
        begun = [w for w in longer if w.startswith(word)]
        if not begun and 2 <= len(word) <= LONGEST_ABBREVIATION:
            begun = [w for w in longer if 5 * len(word) <= 4 * len(w) and _in_order(word, w)]
        return tuple(begun) or None

    def concepts(self, parts: list[str]) -> tuple[list[str], set[str]]:
        """(proper words, concepts) of the words of a name; an abbreviation of several words goes with the other concepts, its place, and how often they occur."""
        read = [self.read(w) for w in parts]
        sure = {r for r in read if isinstance(r, str) and r}
        proper = [w for w, r in zip(parts, read) if r is None]
        found = set(sure)
        first = next((k for k, r in enumerate(read) if r != ""), 0)
        for k, (word, r) in enumerate(zip(parts, read)):
            if not isinstance(r, tuple):
                continue
            ranked = []
            for w in r:
                concept, often, leads = self.words[w]
                fits = sum(self.together.get((min(concept, c), max(concept, c)), 0) > 0 for c in sure if c != concept)
                ranked.append((fits, (leads * 2 > often) == (k == first), often, concept))
            ranked.sort(reverse=True)
            clear = len({x[3] for x in ranked}) == 1 or ranked[0][:2] > next(x for x in ranked if x[3] != ranked[0][3])[:2]
            if clear or len(word) > 1:
                found.add(ranked[0][3])
        # a word of one language that other concepts hold in themselves says nothing beside them
        return proper, {c for c in found if not self.held.get(c, frozenset()) & found}


    def phrases(self, parts: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """(concept, initials) of the generic words of a name, and of a name of two concepts alone (concept, its place).

        The place of the first is `1` and the initial of the small word after it, that of the last `2`.
        """
        concepts = [self.exact.get(w) for w in parts]
        present = {c for c in concepts if c}
        # words that another concept holds belong to its phrase
        owner = {c: min(self.held[c] & present) if self.held.get(c, frozenset()) & present else c for c in present}
        found: dict[str, str] = {}
        order: list[str] = []
        for word, concept in zip(parts, concepts):
            if concept:
                key = owner[concept]
                found[key] = found.get(key, "") + word[0]
                order.append(key)
        places = []
        if len(found) == 2 and None not in concepts:
            second = parts[1] if concepts[1] == "" else ""
            places = [(order[0], "1" + second[:1]), (order[-1], "2")]
        return list(found.items()), places

    def acronyms(self, concepts: list[str]) -> set[str]:
        """The initials of a body of two concepts, a kind and a field, in the places that the kind has in the register."""
        found = set()
        if len(concepts) == 2:
            for kind, field in (concepts, concepts[::-1]):
                a, b = self.initials.get(kind), self.initials.get(field)
                for place in self.places.get(kind, ()) if a and b else ():
                    found |= {a + place[1:] + b, a + b} if place[0] == "1" else {b + a}
        return found


#: Letters of the longest word that is read as an abbreviation which leaves letters out.
LONGEST_ABBREVIATION = 5


def _in_order(short: str, word: str) -> bool:
    """Whether all letters of an abbreviation occur in the word in their order."""
    rest = iter(word)
    return all(ch in rest for ch in short)


def is_hebrew(text: str) -> bool:
    return bool(_HEBREW.search(text))


def skeleton(core: str) -> str:
    """The consonants of a core, the same for Hebrew and its transliteration.

    Two Hebrew letters in a row that are written like one in transliteration count as that one.
    """
    if _HEBREW.search(core):
        found = "".join(HEBREW.get(ch, ch) for ch in core)
    else:
        found, k = "", 0
        while k < len(core):
            pair = PAIRS.get(core[k : k + 2])
            found += pair or ("" if core[k] in "aeiou" else core[k])
            k += 2 if pair else 1
    return found.replace("tz", "T").replace("sh", "S").replace("th", "H")


def grams(word: str, n: int = 3) -> list[str]:
    """The n-grams of a word, its ends marked; repeated ones numbered, so that they are a set."""
    padded = "^" * (n - 1) + word + "$" * (n - 1)
    seen: dict[str, int] = {}
    found = []
    for k in range(len(padded) - n + 1):
        gram = padded[k : k + n]
        seen[gram] = seen.get(gram, 0) + 1
        found.append(gram if seen[gram] == 1 else f"{gram}{seen[gram]}")
    return found


def organisation(name: str, lexicon: Lexicon) -> tuple[str, list[str]]:
    """(core, concepts) of a name; the core is the joined words that have no concept, concepts are sorted."""
    parts = [w for w in words(name) if w]
    proper, concepts = lexicon.concepts(parts)
    return "".join(w for w in proper if len(w) > 1 or w.isdigit()), sorted(concepts)


def acronyms(name: str) -> set[str]:
    """The initials of a name in Latin letters, with and without its small words, if there are at least two."""
    parts = words(name)
    if _HEBREW.search(name):
        return set()
    joined = {"".join(w[0] for w in parts if w != "and"), "".join(w[0] for w in parts), "".join(w[0] for w in parts if w not in FILLERS.split())}
    return {j for j in joined if len(j) > 1}


def is_placeholder(name: str) -> bool:
    plain = " ".join(words(name))
    return not plain or plain in {" ".join(words(p)) for p in PLACEHOLDERS.split("|")}


def person(name: str) -> list[str]:
    """The words of a person's name without titles, in written order."""
    titles = {w.translate(FINALS) for w in TITLES.split()}
    text = re.sub(r"(?<=[א-ת])[\"״”](?=[א-ת])", "", name)
    return [w for w in words(text) if w not in titles]
