"""Per-document text statistics and the structural form of a text (problem 8).

A text is cut into segments of like layout. Each segment's distribution over function words of a
language and over character classes of its other tokens is compared, by Jensen-Shannon divergence,
with the prose profiles of that language and with profiles of lists, tables and junk; the nearest
profile names the segment, and the characters of the segments decide on the document. A segment's
language is the one whose prose profiles are nearest. The prose profiles of a language are stated
seeds and what the whole corpus makes of them.
"""

from __future__ import annotations

import copy
import pickle
import re
import unicodedata
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import unescape
from graphloom.plans.runtime import cut, spread

#: Common function words by language. Articles are apart, as lists have them too.
ARTICLES = {
    "en": "the a an this that these those my your his her its our their",
    "de": "der die das den dem des ein eine einen einem einer eines mein meine dieser diese dieses",
    "fr": "le la les l un une des du mon ma mes son sa ses ce cet cette ces",
    "es": "el la los las un una unos unas mi mis su sus este esta estos estas",
    "it": "il lo la i gli le un uno una questo questa",
    "pt": "o a os as um uma uns umas este esta isso",
    "nl": "de het een deze dit die dat",
    "sv": "en ett den det de",
}
FUNCTION = {
    "en": "and or but of to in on at by for with from as is are was were be been have has had do does did not no it he she they we i you who which whose when where while because if than then so such there all any more most can could would should will may must just about after before over into out up only very too also me him them us what how even nothing hardly until yet",
    "de": "und oder aber von zu zum zur im in am an auf aus bei mit nach für über unter um ist sind war waren sein hat habe haben hatte wird werden wurde nicht kein keine ich du er sie es wir ihr man sich mir mich ihm ihn ihnen wer was wie wenn als weil dass denn so auch noch nur schon sehr mehr wieder alle hier dort dann wo bis durch gegen ohne vor bin gleich vorher",
    "fr": "et ou mais de à au aux en dans sur sous par pour avec sans chez est sont était être a ai as ont avait avoir fait ne pas plus que qui dont où quand si comme je tu il elle on nous vous ils elles me te se lui leur y c s d j m n qu t très bien tout tous toute été aurais dès jusqu",
    "es": "y o pero de del a al en con por para sin sobre entre es son era fue ser ha he han había haber no ni que quien cuando donde como si yo tú él ella nos me te se le lo les muy más también ya todo todos hay hasta desde porque está estoy tiene tenía",
    "it": "e o ma di a da in con su per tra è sono era ha ho hanno non che chi cui quando dove come se io tu lui lei noi mi ti si ci ne più anche molto del della dei delle al alla nel nella questo",
    "pt": "e ou mas de do da dos das em no na nos nas com por para sem é são era foi ser tem tinha não que quem quando onde como se eu ele ela nós me te lhe mais muito também já",
    "nl": "en of maar van in op aan bij met voor uit over is zijn was heeft heb had niet geen ik jij hij zij we ze wij je er om te als dan dat wie wat waar ook nog zo naar door",
    "sv": "och eller men av i på till med för från är var har hade inte jag du han hon vi de som när där om så också att sig",
}
#: Characters that end a sentence.
ENDS = ".!?…。！？"

#: Token classes, in the order of the profiles.
CLASSES = ("article", "function", "word", "name", "number", "garbled", "blob", "symbol", "code", "cell", "comma", "end", "item", "break", "repeat")
#: Profiles: share of each class in typical segments; what is not named is 0.
PROFILES: dict[str, dict[str, float]] = {
    "prose": {"article": 0.11, "function": 0.30, "word": 0.38, "name": 0.10, "number": 0.01, "comma": 0.03, "end": 0.07},
    "prose short": {"article": 0.10, "function": 0.14, "word": 0.46, "name": 0.20, "end": 0.10},
    "prose bare": {"article": 0.10, "function": 0.27, "word": 0.35, "name": 0.24, "number": 0.02, "comma": 0.02},
    "prose broken": {"article": 0.10, "function": 0.27, "word": 0.36, "name": 0.10, "break": 0.11, "comma": 0.02, "end": 0.04},
    "prose names": {"article": 0.07, "function": 0.22, "word": 0.33, "name": 0.20, "comma": 0.12, "end": 0.06},
    "list marked": {"article": 0.02, "function": 0.01, "word": 0.24, "name": 0.32, "number": 0.02, "item": 0.36, "break": 0.03},
    "list numbered": {"article": 0.02, "function": 0.01, "word": 0.20, "name": 0.25, "number": 0.20, "symbol": 0.06, "item": 0.26},
    "list bare": {"article": 0.02, "function": 0.01, "word": 0.32, "name": 0.35, "break": 0.30},
    "list articles": {"article": 0.18, "function": 0.02, "word": 0.32, "name": 0.18, "break": 0.15, "item": 0.15},
    "list strung": {"article": 0.03, "function": 0.01, "word": 0.32, "name": 0.34, "comma": 0.30},
    "list strung articles": {"article": 0.17, "function": 0.03, "word": 0.34, "name": 0.20, "comma": 0.26},
    "table": {"word": 0.08, "name": 0.28, "number": 0.27, "cell": 0.37},
    "table numbers": {"name": 0.08, "number": 0.45, "cell": 0.47},
    "table words": {"word": 0.18, "name": 0.42, "number": 0.03, "cell": 0.37},
    "junk garbled": {"garbled": 0.75, "word": 0.20, "symbol": 0.05},
    "junk blob": {"blob": 0.92, "symbol": 0.08},
    "junk symbols": {"symbol": 0.95, "word": 0.05},
    "junk numbers": {"number": 0.95, "word": 0.05},
    "junk code": {"code": 0.55, "word": 0.20, "number": 0.15, "blob": 0.10},
    "junk code rows": {"code": 0.34, "word": 0.24, "number": 0.14, "cell": 0.28},
    "junk repeated": {"repeat": 0.90, "word": 0.10},
}

#: Prose and strung lists in scripts in which no function word is known (neither Latin nor Chinese,
#: Japanese, Korean), and of which some have no capitals either.
FOREIGN_PROFILES: dict[str, dict[str, float]] = {
    "prose foreign": {"word": 0.74, "name": 0.07, "number": 0.01, "comma": 0.10, "end": 0.08},
    "prose foreign bare": {"word": 0.82, "name": 0.06, "comma": 0.02, "break": 0.10},
    "list foreign": {"word": 0.62, "name": 0.06, "comma": 0.32},
}
_FOREIGN = re.compile(r"[\u0370-\u1cff]")
_FOREIGN_MARKS = str.maketrans("،؛।॥؟", ",;..?")

_HTML_ROW = re.compile(r"</tr\s*>|<tr[^<>]*>", re.I)
_HTML_CELL = re.compile(r"(?:</?(?:td|th)[^<>]*>\s*)+", re.I)
_HTML_ITEM = re.compile(r"<li[^<>]*>", re.I)
_HTML_BREAK = re.compile(r"</?(?:p|div|br|ul|ol|h[1-6]|table|tbody|thead|section|pre|blockquote)\b[^<>]*>", re.I)
_HTML_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WRAPPER = re.compile(r'^\s*[\[{]\s*"[A-Za-z_]+"\s*:\s*"|",\s*"[A-Za-z_]+"\s*:\s*[^"{}\[\]]*[\]}]\s*$')
_BULLET = re.compile(
    r"^\s*(?:[-*+•·▪◦‣●○■□–—✔✓☐☑→»]\s+|\(?\d{1,3}[.):]\s+|\(?[A-Za-z][.)]\s+|\[[ xX]?\]\s*|(?:§|Ch\.|Cap\.|Kap\.|Chapter|Kapitel|Chapitre|Capítulo)\s*\d+\b|#\d+\s|(?:i{1,3}|iv|v|vi{1,3}|ix|x)[.)]\s+)"
)
_RULE = re.compile(r"^[\s|+\-=:─━│┃┌┐└┘├┤┬┴┼╔╗╚╝║═_]{3,}$")
_SPACES = re.compile(r"\S(?:\s{3,}|\t+)(?=\S)")
# The first alternative is but the quick way for a plain word before white space or a mark.
_TOKEN = re.compile(
    r"(?P<plain>[^\W\d_]{1,15}+(?=\s|$|[,.!?;:](?:\s|$)))"
    r"|(?P<blob>(?:https?://|www\.)\S+|(?:%[0-9A-Fa-f]{2}){2,}%?|[A-Za-z_$]+(?:\.[A-Za-z_$]+)+\([^()\s]*\)|[A-Za-z0-9+/_=-]{28,}|(?:0x)?[0-9a-fA-F]{16,})"
    r"|(?P<number>[-+]?\d+(?:[.,:/-]\d+)*%?)"
    r"|(?P<word>[^\W\d_]+(?:['’`][^\W\d_]+)*)"
    r"|(?P<other>[^\w\s]|_)"
)
_CODE = frozenset("{}()[]<>=;\\@#$&~^`_*/+")
_QUIET = frozenset("\"'’‘“”«»„‹›()-–—:;/¿¡`´*_[]")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzßñç]{6,}")
_ODD = re.compile(r"q(?![u])|[bcdfghjklmnpqrstvwxz]{5,}|[jvwxzq]{2,}|öö|ww|uu|[aeiouöäü]{5,}")
_TRIPLE = re.compile(r"(.)\1\1")
# Consonants that languages join; they count as one.
_JOINED = re.compile(r"sch|tsch|ch|th|ph|ng|st|ck|tz|sz|gh|pf")
_VOWEL = re.compile(r"[aeiouyäöüàâéèêëîïôùûáíóúæøåœãõ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힣ｦ-ﾟ]")
_KANA = re.compile(r"[぀-ゟ]")
_RUN = re.compile(r"(.)\1{5,}")
_ECHO = re.compile(r"(.{1,3})\1{3,}")
_APOSTROPHE = re.compile(r"['’`]")
_SHAPED = re.compile(r"[│|\t;¦─━┌┐└┘├┤┬┴┼╔╗╚╝║═]+|-{3,}")
_COMMA_SPACE = re.compile(r",\s")
_LONG_RUN = re.compile(r"(.)\1{30,}")
_QUOTES = re.compile(r"^\s*(?:>\s?)+")


#: Segments that make a profile.
LEARN_FROM = 30
#: Not used, as profiles are learned from every document of every file; a test sets the name.
SAMPLE_FILES = 16
#: Unit of the shares that are summed: whole numbers add up alike in any order.
UNIT = 1_000_000
#: Entries that make a list of lines without marks or of one line.
LIST_ITEMS = 3


def garbled(word: str) -> bool:
    """Whether no language spells a word so: no vowel, heaps of consonants, odd pairs in a long word."""
    if len(word) < 3 or not word.isascii() and _CJK.search(word):
        return False
    low = word.lower()
    if not all("a" <= c <= "z" or c in "äöüßàâéèêëîïôùûáíóúñçæøåœãõ'’" for c in low):
        return False
    if not _VOWEL.search(low):
        return len(low) > 3 or not low.isalpha()
    if len(low) > 22 or _CLUSTER.search(_JOINED.sub("k", low)):
        return True
    inner = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
    return inner >= 2 or len(low) >= 5 and bool(_ODD.search(_JOINED.sub("k", low)) or _TRIPLE.search(low))


def _cells(line: str) -> int:
    """Number of cells of a line that reads as a table row, 0 if it does not."""
    text = line.strip()
    if not text:
        return 0
    for mark in ("│", "|", "\t", ";", "¦"):
        if mark in text:
            parts = [p.strip() for p in text.strip(mark).split(mark)]
            if len(parts) >= 2 and sum(len(p.split()) for p in parts) <= 4 * len(parts) and not any(p.endswith((".", "!", "?")) and len(p.split()) > 3 for p in parts):
                return len(parts)
    parts = _SPACES.split(text)
    if len(parts) >= 2 and sum(len(p.split()) for p in parts) <= 3.5 * len(parts):
        return len(parts)
    if "," in text and not _COMMA_SPACE.search(text) and text[-1] not in ENDS:
        parts = text.split(",")
        if len(parts) >= 2 and sum(len(p.split()) for p in parts) <= 3.5 * len(parts):
            return len(parts)
    return 0


def _shape(line: str) -> str:
    if _RULE.match(line) and len(set(line.strip())) > 1 and not _LONG_RUN.search(line):
        return "row"
    if _BULLET.match(line):
        return "item"
    return "row" if _cells(line) else "text"


#: Languages with function words of their own, and the bit of each in the sets a word belongs to.
LANGUAGES = tuple(FUNCTION)
_AT = {name: i for i, name in enumerate(CLASSES)}
_TYPES = len(CLASSES)


def _word_sets() -> tuple[dict[str, int], dict[str, int]]:
    """Word -> bits of the languages in which it is an article, or another function word. Letters
    that stand alone are items of lists more often than words, but for the English pronoun."""
    found: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for at, words in zip(found, (ARTICLES, FUNCTION)):
        for bit, language in enumerate(LANGUAGES):
            for word in words[language].split():
                if at is not found[1] or word != "o":
                    at[word] = at.get(word, 0) | 1 << bit
    return found


_ARTICLE_BITS, _FUNCTION_BITS = _word_sets()


@dataclass
class Segment:
    """Lines of like layout: their characters, counts of token classes apart from function words,
    and of the function words by what they are elsewhere: (class, article bits, function bits)."""

    shape: str
    size: int
    lines: int
    foreign: bool = False
    counts: list[float] = field(default_factory=lambda: [0.0] * _TYPES)
    small: Counter = field(default_factory=Counter)

    def tokens(self) -> float:
        return sum(self.counts) + sum(self.small.values())

    def by_language(self) -> np.ndarray:
        """Counts of the token classes, a row for each language."""
        out = np.tile(np.array(self.counts), (len(LANGUAGES), 1))
        for (other, articles, functions), n in self.small.items():
            for bit in range(len(LANGUAGES)):
                out[bit, _AT["article"] if articles >> bit & 1 else _AT["function"] if functions >> bit & 1 else other] += n
        return out

    def pooled(self) -> np.ndarray:
        """Counts of the token classes with the function words of all languages: entries of a list
        or table need not be of one language."""
        out = np.array(self.counts)
        for (_, articles, _), n in self.small.items():
            out[_AT["article" if articles else "function"]] += n
        return out


#: What is known of a token: kind, class, weight, folded form, article bits, function bits.
_Known = tuple[int, int, float, str, int, int]
_MARK, _PLAIN, _SCRIPT, _WORD, _SMALL = range(5)


def _look_up(token: str, group: str) -> _Known:
    if group == "blob":
        return _PLAIN, _AT["blob"], max(1, len(token) // 6), token, 0, 0
    if group == "number":
        return _PLAIN, _AT["number"], 1 if len(token) < 12 else 2, token, 0, 0
    if group == "other":
        name = "end" if token in ENDS else "comma" if token in ",、;，·" else "code" if token in _CODE and token not in _QUIET else "symbol" if token not in _QUIET else ""
        return _MARK, _AT[name] if name else -1, 1, token, 0, 0
    if _CJK.search(token):
        kana = len(_KANA.findall(token))
        return _SCRIPT, _AT["function"], kana / 4, token, len(token) - kana, len(token)
    low = token.casefold()
    parts = _APOSTROPHE.split(low)
    articles = -1
    for part in parts:
        articles &= _ARTICLE_BITS.get(part, 0)
    functions = 0
    for part in {low, parts[0], parts[-1]}:
        functions |= _FUNCTION_BITS.get(part, 0)
    if _RUN.search(low) or _ECHO.fullmatch(low):
        return _WORD, _AT["repeat"], max(1, len(low) // 6), low, 0, 0
    name = "garbled" if garbled(token) else "name" if token[0].isupper() else "word"
    weight = max(1, len(low) / 8) if name == "garbled" else 1
    return (_SMALL if articles or functions else _WORD), _AT[name], weight, low, articles, functions


_seen: dict[str, _Known] = {}
_SEEN_MOST = 200_000


def _known(token: str, group: str) -> _Known:
    found = _seen.get(token)
    if found is None:
        found = _look_up(token, group)
        if len(_seen) >= _SEEN_MOST:
            _seen.clear()
        if len(token) <= 40:
            _seen[token] = found
    return found


def segment_of(shape: str, lines: list[str]) -> Segment:
    """The counts of a segment."""
    text = "\n".join(lines)
    out = Segment(shape, len(text) + 1, len(lines), foreign(text))
    if out.foreign:
        lines = [_plain(x) for x in lines]
    found, small = out.counts, out.small
    end, comma, symbol, word_, name_, repeat = (_AT[x] for x in ("end", "comma", "symbol", "word", "name", "repeat"))
    recent: deque[str] = deque(maxlen=4)
    distinct: set[str] = set()
    words = 0.0
    upper = sum(map(str.isupper, text)) > 0.6 * max(1, sum(map(str.isalpha, text)))
    for at, line in enumerate(lines):
        if shape == "item" and (m := _BULLET.match(line)):
            found[_AT["item"]] += 1
            line = line[m.end() :]
        if shape == "row":
            found[_AT["cell"]] += max(1, _cells(line))
            line = _SHAPED.sub(" ", line)
            if not _COMMA_SPACE.search(line):
                line = line.replace(",", " ")
        token = ""
        for m in _TOKEN.finditer(line):
            token = m[0]
            kind, cls, weight, low, articles, functions = _seen.get(token) or _known(token, m.lastgroup)
            if kind == _PLAIN:
                found[cls] += weight
            elif kind == _MARK:
                if cls == end:
                    found[end if not recent or recent[-1] != token else symbol] += 1
                elif cls >= 0:
                    found[cls] += 1
                elif recent and recent[-1] == token:
                    found[symbol] += 1
                recent.append(token)
            elif kind == _SCRIPT:
                found[cls] += weight
                found[word_] += articles / 3
                words += functions / 4
                distinct.add(token)
            else:
                words += 1
                if len(low) > 3 and low in recent:
                    found[repeat] += 1
                else:
                    if cls == name_ and upper:
                        cls = word_
                    if kind == _SMALL:
                        small[cls, articles, functions] += 1
                    else:
                        found[cls] += weight
                distinct.add(low)
                recent.append(low)
        if at < len(lines) - 1 and shape == "text" and token and token not in ENDS and token not in ",、":
            found[_AT["break"]] += 1
    if words >= 12 and len(distinct) < 0.2 * words:
        for x in (word_, name_, _AT["garbled"]):
            found[repeat] += found[x]
            found[x] = 0.0
    return out


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each row of p from each row of q."""
    out = np.zeros((len(p), len(q)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(p.shape[1]):
            a, b = p[:, k, None], q[None, :, k]
            m = (a + b) / 2
            out += (np.where(a > 0, a * np.log2(a / m), 0) + np.where(b > 0, b * np.log2(b / m), 0)) / 2
    return out


def divergence(p: dict[str, float], q: dict[str, float]) -> float:
    """Jensen-Shannon divergence of two distributions, in bits."""
    keys = sorted(p.keys() | q.keys())
    return float(divergences(np.array([[p.get(k, 0.0) for k in keys]]), np.array([[q.get(k, 0.0) for k in keys]]))[0, 0])


def foreign(text: str) -> bool:
    """Whether most letters of a segment are of scripts in which no function word is known."""
    if not _FOREIGN.search(text):
        return False
    return 2 * sum(_FOREIGN.match(c) is not None for c in text if c.isalpha()) > sum(map(str.isalpha, text))


def _plain(line: str) -> str:
    """A line of a foreign script with its marks of punctuation as here and no combining marks."""
    return "".join(c for c in line.translate(_FOREIGN_MARKS) if not unicodedata.category(c).startswith("M"))


def _flatten(text: str) -> str:
    text = unescape(text)
    text = _WRAPPER.sub("", text)
    if "<" in text:
        text = _HTML_ROW.sub("\n", text)
        text = _HTML_CELL.sub("\t", text)
        text = _HTML_ITEM.sub("\n• ", text)
        text = _HTML_BREAK.sub("\n", text)
        text = _HTML_TAG.sub("", text)
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _joined(lines: list[str]) -> list[str]:
    """lines with prose that was set one word to a line put back together."""
    if len(lines) < 8:
        return lines
    out: list[str] = []
    run: list[str] = []
    for line in [*lines, "two words"]:
        token = line.strip()
        if token and " " not in token:
            run.append(token)
            continue
        folded = [w.casefold() for w in run]
        common = sum(w in _FUNCTION_BITS or w in _ARTICLE_BITS for w in folded)
        out += [" ".join(run)] if len(run) >= 6 and common >= 0.2 * len(run) else run
        run = []
        out.append(line)
    return out[:-1]


def segments(text: str) -> list[tuple[str, list[str]]]:
    """(shape, lines) of runs of like lines; blank lines and sentence ends part text."""
    out: list[tuple[str, list[str]]] = []
    apart = True
    for raw in _joined(text.split("\n")):
        line = (_QUOTES.sub("", raw) if ">" in raw else raw).rstrip()
        if not line.strip():
            apart = True
            continue
        shape = _shape(line)
        if out and out[-1][0] == shape and (not apart or shape != "text"):
            out[-1][1].append(line)
        else:
            out.append((shape, [line]))
        apart = shape == "text" and line.rstrip("\"'»«”“)* ")[-1:] in tuple(ENDS)
    return out


class Profiles:
    """Profiles as arrays: prose by language, and the other forms."""

    def __init__(self, prose: dict[str, dict[str, dict[str, float]]], others: dict[str, dict[str, float]], foreign: dict[str, dict[str, float]]):
        row = lambda shares: [shares.get(c, 0.0) for c in CLASSES]
        self.prose = [np.array([row(x) for x in prose[language].values()]) for language in LANGUAGES]
        self.others = np.array([row(x) for x in others.values()])
        self.names = np.array([n.split()[0] for n in others])
        self.foreign_prose = np.array([row(x) for n, x in foreign.items() if n.startswith("prose")])
        self.foreign_list = np.array([row(x) for n, x in foreign.items() if n.startswith("list")])

    def nearest(self, segments: list[Segment]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: its form, the language of which a prose profile is nearest, which of
        them it is, and its shares of token classes when read in that language."""
        counts = np.array([s.by_language() for s in segments]).reshape(len(segments), len(LANGUAGES), _TYPES)
        sizes = counts[:, 0].sum(axis=1)
        shares = counts / np.maximum(sizes, 1e-9)[:, None, None]
        apart = [divergences(shares[:, i], profiles) for i, profiles in enumerate(self.prose)]
        language = np.stack([x.min(axis=1) for x in apart], axis=1).argmin(axis=1)
        at = np.arange(len(segments))
        shares = shares[at, language]
        prose = np.array([apart[i][k].min() for k, i in enumerate(language)])
        profile = np.array([apart[i][k].argmin() for k, i in enumerate(language)], dtype=np.int64)
        pooled = np.array([s.pooled() for s in segments]).reshape(len(segments), _TYPES) / np.maximum(sizes, 1e-9)[:, None]
        others = divergences(pooled, self.others)
        best = others.argmin(axis=1)
        other, names = others[at, best], self.names[best].astype(object)
        far = np.array([s.foreign for s in segments], dtype=bool)
        if far.any():
            prose[far] = np.minimum(prose[far], divergences(shares[far], self.foreign_prose).min(axis=1))
            strung = divergences(pooled[far], self.foreign_list).min(axis=1)
            names[far] = np.where(strung < other[far], "list", names[far])
            other[far] = np.minimum(strung, other[far])
        names = np.where(sizes > 0, np.where(prose <= other, "prose", names), "junk")
        return names.tolist(), language, profile, shares

    def learned(self, sums: dict[tuple[int, int], tuple[np.ndarray, int]]) -> Profiles:
        """These profiles and for each prose profile that LEARN_FROM segments or more are nearest to
        the mean of their shares, from (language, profile) -> (sum of shares, segments). A mean that
        is nearer to another form is of misjudged segments, however many, and is left out."""
        out = copy.copy(self)
        out.prose = []
        for i, rows in enumerate(self.prose):
            means = [sums[i, k][0] / sums[i, k][0].sum() for k in range(len(rows)) if (i, k) in sums and sums[i, k][1] >= LEARN_FROM]
            out.prose.append(np.array([*rows, *(m for m in means if divergences(m[None], rows).min() <= divergences(m[None], self.others).min())]))
        return out


#: The seeds of the profiles, the prose ones alike for all languages.
SEEDS = Profiles({language: {n: p for n, p in PROFILES.items() if n.startswith("prose")} for language in LANGUAGES}, {n: p for n, p in PROFILES.items() if not n.startswith("prose")}, FOREIGN_PROFILES)


def parsed(text: str | None) -> list[Segment] | Counter:
    """The segments of a text; sizes by form where its layout alone decides."""
    if text is None or not text.strip():
        return []
    flat = _flatten(text)
    visible = len("".join(flat.split()))
    if visible < 0.2 * len(text) and len(_HTML_TAG.findall(text)) >= 6 and "<t" not in text.lower():
        return Counter(junk=len(text))
    return [segment_of(shape, lines) for shape, lines in segments(flat)]


FORMS = ("prose", "list", "table", "junk")


def _form(name: str, part: Segment) -> str:
    """The form of a segment by the name of its nearest profile."""
    if name == "list" and part.shape == "text" and part.lines < LIST_ITEMS and part.counts[_AT["comma"]] < LIST_ITEMS:
        return "prose"  # too few entries for a list
    if name == "table" and part.lines < 2 and part.tokens() < 8:
        return "prose"
    return name


def forms_of(texts: Iterable[str | None], profiles: Profiles = SEEDS) -> list[Counter]:
    """Characters of each text by form: prose, list, table, junk."""
    out = [parsed(text) for text in texts]
    at = [i for i, parts in enumerate(out) if isinstance(parts, list) and parts]
    if at:
        names = iter(profiles.nearest([p for i in at for p in out[i]])[0])
        for i in at:
            sizes: Counter = Counter()
            for part in out[i]:
                sizes[_form(next(names), part)] += part.size
            out[i] = sizes
    return [x if isinstance(x, Counter) else Counter() for x in out]


def form_sizes(text: str | None) -> Counter:
    """Characters of one text by form."""
    return forms_of([text])[0]


def document_form(sizes: dict[str, float]) -> str:
    """prose, list, table or junk by form_sizes: the largest form but prose if more than half of
    the text is not prose; prose where there is no text."""
    whole = sum(sizes.values())
    other = {k: v for k, v in sizes.items() if k != "prose"}
    if not whole or sum(other.values()) * 2 <= whole:
        return "prose"
    return max(sorted(other), key=other.get)


#: (language, prose profile) -> (sum of the shares, in UNIT, of the segments of prose nearest to it,
#: number of them).
_Sums = dict[tuple[int, int], tuple[np.ndarray, int]]


def _add_prose(sums: _Sums, parts: list[Segment], nearest: tuple) -> None:
    """Add the segments of prose to sums. Segments of under eight tokens say too little."""
    names, language, profile, shares = nearest
    taken = np.array([name == "prose" and not part.foreign and part.tokens() >= 8 for part, name in zip(parts, names)], dtype=bool)
    language, profile, units = language[taken], profile[taken], np.rint(shares[taken] * UNIT).astype(np.int64)
    for i, k in set(zip(language.tolist(), profile.tolist())):
        at = (language == i) & (profile == k)
        total, n = sums.get((i, k), (0, 0))
        sums[i, k] = (total + units[at].sum(axis=0), n + int(at.sum()))


def prose_sums(texts: Iterable[str | None], profiles: Profiles = SEEDS) -> _Sums:
    """The sums of the segments of prose of the texts."""
    flat = [s for parts in map(parsed, texts) if isinstance(parts, list) for s in parts]
    sums: _Sums = {}
    if flat:
        _add_prose(sums, flat, profiles.nearest(flat))
    return sums


def survey(texts: Iterable[str | None], sums: _Sums) -> list[tuple[Counter, list[Segment]]]:
    """Of each text the characters by form as far as the seeds settle them, and the other segments;
    the prose is added to sums.

    Learning only adds prose profiles, so prose stays prose and another form stays or becomes prose.
    Only a foreign segment with function words may be read in another language and change otherwise."""
    found = [parsed(text) for text in texts]
    flat = [s for parts in found if isinstance(parts, list) for s in parts]
    names: Iterator[str] = iter(())
    if flat:
        nearest = SEEDS.nearest(flat)
        _add_prose(sums, flat, nearest)
        names = iter(nearest[0])
    out: list[tuple[Counter, list[Segment]]] = []
    for parts in found:
        if isinstance(parts, Counter):
            out.append((parts, []))
            continue
        sizes, rest = Counter(), []
        for part in parts:
            form = _form(next(names), part)
            if part.tokens() > 0 and (form != "prose" or part.foreign and part.small):
                rest.append(part)
            else:
                sizes[form] += part.size
        out.append((sizes, rest))
    return out


def settle(surveyed: list[tuple[Counter, list[Segment]]], profiles: Profiles) -> list[Counter]:
    """Characters of each surveyed text by form, the remaining segments being judged by profiles."""
    flat = [part for _, rest in surveyed for part in rest]
    names = iter(profiles.nearest(flat)[0] if flat else [])
    out = []
    for sizes, rest in surveyed:
        sizes = Counter(sizes)
        for part in rest:
            sizes[_form(next(names), part)] += part.size
        out.append(sizes)
    return out


def _packed(parts: list[Segment]) -> bytes | None:
    return pickle.dumps([(p.shape, p.size, p.lines, p.foreign, p.counts, dict(p.small)) for p in parts]) if parts else None


def _unpacked(packed: bytes | None) -> list[Segment]:
    return [Segment(*fields, Counter(small)) for *fields, small in pickle.loads(packed)] if packed else []


def _surveyed(df: DataFrame, kept: list[str]) -> DataFrame:
    """One pass over every text of df: a row for each with the kept columns, its settled characters
    by form and its remaining segments; and from each partition a few dozen rows of sums (language,
    profile, segments, shares), with all else NULL."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: _Sums = {}
        for batch in batches:
            found = [x for at in range(0, len(batch), 1000) for x in survey(batch["text"].iloc[at : at + 1000], sums)]
            sizes = {f: [x[f] for x, _ in found] for f in FORMS}
            yield batch[kept].assign(**sizes, rest=[_packed(parts) for _, parts in found], sums=None)
        rows = [[i, k, n, *total.tolist()] for (i, k), (total, n) in sums.items()]
        yield pd.DataFrame({**dict.fromkeys([*kept, *FORMS, "rest"], pd.Series([None] * len(rows), dtype=object)), "sums": pd.Series(rows, dtype=object)})

    types = dict(df.dtypes)
    return df.mapInPandas(measure, ", ".join([f"{c} {types[c]}" for c in kept] + [f"{f} bigint" for f in FORMS] + ["rest binary", "sums array<bigint>"]))


def _learned(surveyed: DataFrame) -> Profiles:
    """The seeds and what the sums of a survey make of them. One row for each prose profile of a
    language comes to the driver, whatever the size of the corpus."""
    at = F.col("sums")
    added = [F.sum(at[j]).alias(f"s{j}") for j in range(2, 3 + _TYPES)]
    rows = surveyed.where(at.isNotNull()).groupBy(at[0].alias("language"), at[1].alias("profile")).agg(*added).collect()
    return SEEDS.learned({(r[0], r[1]): (np.array(r[3:], dtype=np.float64), r[2]) for r in rows})


def learn_profiles(documents: DataFrame) -> Profiles:
    """The seeds and the prose profiles of the corpus, learned from every document, whatever the
    order and partitions of the rows."""
    return _learned(_surveyed(spread(documents.select("text")), []))


#: Letters, digits and white space as Java's and DuckDB's regular expressions have them alike.
WORD = r"[\p{L}\p{Nl}\p{No}]+"
SPACE = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
#: What a line may end in to count as punctuated.
LINE_ENDS = ENDS + ",;:"
COMMON_WORDS = sorted({*_ARTICLE_BITS, *_FUNCTION_BITS})


def counts(text: Column) -> dict[str, Column]:
    """Word count, mean word length, symbol ratio (characters that are neither letter, digit nor
    space), share of lines ending in punctuation, share of common words (of any language), by
    Spark's own functions. 0 where there are none."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.size(found)
    common = F.size(F.filter(found, lambda w: F.lower(w).isin(COMMON_WORDS)))
    symbols = F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{SPACE}]", ""))
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), lambda x: F.regexp_replace(x, rf"[{SPACE}]+$", "")), lambda x: x != "")
    ended = F.size(F.filter(lines, lambda x: F.contains(F.lit(LINE_ENDS), F.right(x, F.lit(1)))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "words": n.cast("bigint"),
        "mean_word_length": share(F.length(F.array_join(found, "")), n),
        "symbol_ratio": share(symbols, F.length(text)),
        "punctuated_lines": share(ended, F.size(lines)),
        "common_words": share(common, n),
    }


def text_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, punctuated_lines, common_words) of each row."""
    return documents.select("doc_id", *[c.alias(n) for n, c in counts(F.col("text")).items()])


def _shares(batch: pd.DataFrame, kept: list[str], sizes: list[Counter]) -> pd.DataFrame:
    """The kept columns of batch and non_prose and form by the sizes."""
    whole = [sum(x.values()) for x in sizes]
    return batch[kept].assign(non_prose=[(n - x["prose"]) / n if n else 0.0 for x, n in zip(sizes, whole)], form=[document_form(x) for x in sizes])


def _formed(df: DataFrame, profiles: Profiles | None, kept: list[str]) -> DataFrame:
    """The kept columns of df (with a text) and non_prose and form. Without profiles they are learned
    from all rows, in the pass that reads the texts; its survey is kept in the checkpoint folder."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _shares(batch, kept, [x for at in range(0, len(batch), 1000) for x in forms_of(batch["text"].iloc[at : at + 1000], profiles)])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            settled = [Counter(dict(zip(FORMS, x))) for x in zip(*(batch[f].tolist() for f in FORMS))]
            found = list(zip(settled, map(_unpacked, batch["rest"])))
            yield _shares(batch, kept, [x for at in range(0, len(found), 1000) for x in settle(found[at : at + 1000], learned)])

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", non_prose double, form string"
    if profiles is not None:
        return df.mapInPandas(measure, schema)
    surveyed = cut(_surveyed(df, kept))
    learned = _learned(surveyed)
    return surveyed.where("sums IS NULL").drop("sums").mapInPandas(finish, schema)


def text_forms(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(doc_id, non_prose, form), a row per row of `documents` (doc_id, text; other columns are
    ignored).

    non_prose is the share of characters that are not prose. NULL and blank texts have 0 and the
    form prose. Texts of any length are read whole, once. Without `profiles` they are learned from
    all rows.
    """
    return _formed(spread(documents.select("doc_id", "text")), profiles, ["doc_id"])


def text_statistics(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, punctuated_lines, common_words, non_prose,
    form), a row per row of `documents`: text_counts and text_forms in one pass."""
    measured = counts(F.col("text"))
    counted = spread(documents.select("doc_id", "text")).select("doc_id", "text", *[c.alias(n) for n, c in measured.items()])
    return _formed(counted, profiles, ["doc_id", *measured])
