"""Statistics of one text that tell natural prose from lists, tables and junk. Pure Python, run inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from itertools import chain

import numpy as np

# Common words of each language, mostly function words.
COMMON_WORDS = {
    "en": "the of and to in a is that was for it on as with by be are this had has not at from or an were which have but who their been its could if into than then they them what when where why how would will can so no nobody each before after because until although however did do does made more most one two some any all he she his her we our you i there about only very between through during other also while both may must",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei dem noch einen einer eines wer wie was warum wenn so um am im vor wollte konnte hatte schon nie obwohl weil alle fast seit zwischen beiden war über ob zum zur durch oder aber man sind haben kann nur mehr sehr noch einmal niemand einige sie ihr ihre wurde wurden bis bevor sagte musste",
    "fr": "le la les de des et en un une du que qui est dans pour pas au il sur ne se par plus ce avec sont a son sa ses mais ou où bien même si était ont aux cette ces leur leurs nous vous ils elle elles on y été avait jamais déjà encore sans entre depuis après avant tous tout toute comme quand dont ni deux parce quoi fût pourquoi comment ainsi car très peu être avoir fait",
    "es": "el la los de que y en un una del se las por con no para su al es lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque qué quién cómo por ni donde nunca ya aunque uno otra vez quería podía todos unos unas hay tan antes después quien cual sido tiene esta estos",
    "it": "il di che è la e un in per una sono non con si da le del come ma al dei nel alla della gli i lo ha o questo anche più su se ci dal delle nella era essere hanno stato cui fra dopo prima tra quando quanto perché chi dove mai già ancora sua suo",
    "pt": "o a de que e do da em um para com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft ze hij was door over hun wordt dit die had werd worden kan zou geen tot al wel meer moet hebben deze na onder tussen wie wat waarom toen",
}
COMMON = {lang: frozenset(x for x in w.split() if len(x) > 1) for lang, w in COMMON_WORDS.items()}
LANGUAGES = tuple(COMMON)
ANY_COMMON = frozenset().union(*COMMON.values())
LANGUAGES_OF = {w: tuple(lang for lang, common in COMMON.items() if w in common) for w in ANY_COMMON}

WORD = re.compile(r"[^\W\d_]+")
ASCII_WORD = re.compile(r"[a-z]+")
BULLET = re.compile(r"\s*(?:[-*•‣▪◦–—+·]{1,2}\s+|\[[ xX✓]?\]\s*|\(?\d{1,4}[.)\]:]\s+|\[\d{1,4}\]\s*|\(?[a-zA-Z][.)]\s+|\(?[ivxlcIVXLC]{1,6}[.)]\s+|[☐☑✓✗]\s*)")
LEADER = re.compile(r"(?:\.{4,}|(?:\. ){3,}|_{4,}|…{2,})\s*\S{0,8}\s*$")
RULE = re.compile(r"^[\s|+:=\-─━│┼┌┐└┘├┤┬┴*_]+$")
HTML = re.compile(r"</?(?:table|tr|td|th|thead|tbody)\b", re.I)
HTML_LIST = re.compile(r"</?(?:ul|ol|li|dl|dt|dd)\b", re.I)
TEMPLATE = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|</?[a-zA-Z][^<>]*>")
ENDINGS = frozenset(".!?…:;,\"'”’»)]")
#: Marks of a broken encoding: replacement signs, control characters, two-byte letters read as two, a ? within a word.
ODD = re.compile(r"[\ufffd□\u0080-\u009f¢¤¶™©€®]")
TWO_BYTES = re.compile(r"[ÃÂ](?=[^\w\s]|[\u0080-\u00ff])")
WITHIN = re.compile(r"(?<=\w)\?(?=\w)")
HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{2,}:?")
SEPARATORS = ("\t", "|", ";", " & ", "  ", "¦", ",", "~", "^")
ROW_MARKS = ("; ", " · ", " • ", " / ", " | ", ", ", " – ", " - ", " + ", " * ")

KINDS = ("prose", "list", "table", "junk")


def language(words: Counter, total: int) -> tuple[str, float]:
    """The language whose common words make up the largest share of the words, and that share."""
    sums = dict.fromkeys(LANGUAGES, 0)
    for w in words.keys() & ANY_COMMON:
        for lang in LANGUAGES_OF[w]:
            sums[lang] += words[w]
    best, most = "und", 0
    for lang, s in sums.items():
        if s > most:
            best, most = lang, s
    return best, most / total if total else 0.0


def _fields(line: str, sep: str) -> list[str]:
    if sep == "  ":
        return re.split(r"\s{2,}", line.strip())
    if sep == "|":
        line = line.strip().strip("|")
    if sep in ",;" and '"' in line:
        line = re.sub(r'"[^"]*"', "q", line)
    return line.split(sep)


def _natural(word: str) -> bool:
    """Whether a word looks like one of a natural language: not too many consonants in a row, some vowel."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
        if not word.isascii():
            return True
    if len(word) > 22 or not re.search(r"[aeiouy]", word):
        return len(word) <= 2
    return not re.search(r"[^aeiouy]{5,}|[^aeiouy]{4,}$|(.)\1\1|q(?!u)|[jqvwxz]{2}", word)


def _junk_line(line: str, words: list[str], shared: float) -> bool:
    """Whether a line without many common words says nothing: symbols, codes, random letters, letters set apart."""
    tokens = line.split()
    size = sum(map(len, tokens))
    letters = sum(map(len, words))
    if "{{" in line or "{%" in line:
        return sum(map(len, TEMPLATE.findall(line))) > 0.4 * len(line)
    if letters < 0.25 * size and not any(c.isdigit() for c in line):
        return size > 3 and not RULE.match(line)
    longest = max(map(len, tokens))
    if longest > 45 and longest > 0.4 * len(line):
        return True
    if len(tokens) > 6 and sum(len(t) for t in tokens if HEX.fullmatch(t) and (len(t) == 2 or any(c.isdigit() for c in t))) > 0.6 * size and sum(t.isdigit() for t in tokens) < 0.6 * len(tokens):
        return True
    if len(tokens) >= 12 and sum(len(t) == 1 for t in tokens) > 0.7 * len(tokens) and letters > 0.5 * size:
        return True
    if len(words) >= 4 and shared < 0.15:
        return sum(len(w) for w in words if not _natural(w)) > 0.35 * letters
    return False


def _table_lines(lines: list[str], plain: list[bool]) -> set[int]:
    """Lines that belong to a block of at least two records in columns. plain: the lines that read as prose."""
    found: set[int] = set()
    whole = "\n".join(x for x, p in zip(lines, plain) if not p)
    for sep in SEPARATORS:
        if sep not in whole:
            continue
        need = 3 if sep in (",", "~", "^") else 2
        i = 0
        while i < len(lines):
            if plain[i] or i in found or sep not in lines[i] or (n := len(_fields(lines[i], sep))) < need:
                i += 1
                continue
            block, j, same = [i], i + 1, 1
            while j < len(lines) and not plain[j] and lines[j].strip():
                m = len(_fields(lines[j], sep))
                if m == n or (sep == "  " and m >= 2 and abs(m - n) <= 2):
                    same += 1
                elif not RULE.match(lines[j]):
                    break
                block.append(j)
                j += 1
            if same >= 2:
                cells = [c for k in block if not RULE.match(lines[k]) for c in _fields(lines[k], sep)]
                if sum(len(c.split()) <= 5 for c in cells) >= 0.8 * len(cells):
                    bullets = sum(bool(BULLET.match(lines[k])) for k in block)
                    leaders = sum(bool(LEADER.search(lines[k])) for k in block)
                    if bullets < 0.6 * len(block) and leaders < 0.5 * len(block):
                        found.update(block)
            i = max(j, i + 1)
    return found


def _row_list(line: str, shared: float) -> bool:
    """Whether a line is a list in a row: short items between one mark, hardly any common words."""
    if shared >= 0.2:
        return False
    for mark in ROW_MARKS:
        if mark in line and len(items := line.split(mark)) >= 4 and sum(len(i.split()) <= 7 for i in items) >= 0.9 * len(items):
            return True
    return False


def _odd_share(text: str, size: int) -> float:
    n = len(WITHIN.findall(text)) if "?" in text else 0
    if not text.isascii():  # of all odd marks only ? is ASCII
        n += len(ODD.findall(text))
        if "Ã" in text or "Â" in text:
            n += len(TWO_BYTES.findall(text))
    return n / size if size else 0.0


#: ASCII letters in lower case, line ends as they are, all else blank: what is left between blanks are the words.
_LETTERS = str.maketrans({c: chr(c).lower() if chr(c).isalpha() else chr(c) if chr(c) in "\n\r\x0b\x0c\x1c\x1d\x1e" else " " for c in range(128)})


def words_by_line(text: str) -> list[list[str]]:
    """Lower-case words of each line."""
    if text.isascii():
        return [line.split() for line in text.translate(_LETTERS).splitlines()]
    return [_lower_words(line) for line in text.splitlines()]


def _lower_words(text: str) -> list[str]:
    return text.translate(_LETTERS).split() if text.isascii() else WORD.findall(text.lower())


def line_kinds(text: str, share: float, by_line: list[list[str]] | None = None) -> dict[str, int]:
    """Characters (without white space) of the text in prose, list, table and junk lines; see ``told_lines``."""
    return told_lines(text, share, by_line)[0]


def told_lines(text: str, share: float, by_line: list[list[str]] | None = None) -> tuple[dict[str, int], int]:
    """(characters without white space by kind of line, characters of the lines with several common words).

    share: the text's share of common words. by_line: words_by_line(text), if known. A line with several common words is prose; other lines are told by
    their form; a line without any form takes the kind of its neighbours.
    """
    chars = dict.fromkeys(KINDS, 0)
    lines = text.splitlines()
    words = words_by_line(text) if by_line is None else by_line
    size, shared, plain, whole = [], [], [], "<" not in text
    code = "{{" in text or "{%" in text
    for line, w in zip(lines, words):
        n = len([x for x in w if x in ANY_COMMON])
        s = n / len(w) if w else 0.0
        size.append(len("".join(line.split())))
        shared.append(s)
        plain.append(n >= 2 and s >= 0.2 and len(w) >= 5 and not (code and ("{{" in line or "{%" in line)))
        whole = whole and (plain[-1] and len(w) >= 8 or not size[-1])
    plain_chars = sum(n for n, p in zip(size, plain) if p)
    if whole:  # long lines of common words only: no rule below would call any of them something else
        chars["prose"] = plain_chars
        return chars, plain_chars
    tables = _table_lines(lines, plain)
    order = [i for i, s in enumerate(size) if s]
    kinds: dict[int, str] = {}
    for i in order:
        line = lines[i]
        if "<" in line and HTML.search(line):
            kinds[i] = "table"
        elif "<" in line and HTML_LIST.search(line):
            kinds[i] = "list"
        elif i in tables:
            kinds[i] = "table"
        elif not plain[i] and _junk_line(line, words[i], shared[i]):
            kinds[i] = "junk"
        elif not plain[i] and LEADER.search(line):
            kinds[i] = "list"
        elif BULLET.match(line):
            kinds[i] = "prose" if plain[i] and len(words[i]) >= 8 else "bullet"
        elif _row_list(line, shared[i]):
            kinds[i] = "list"
        else:
            kinds[i] = "prose" if plain[i] or len(words[i]) >= 12 and shared[i] >= 0.12 else "bare"
    # A run of lines without form is a list; one or two next to prose belong to it: a heading, or wrapped text.
    n = 0
    while n < len(order):
        kind, m = kinds[order[n]], n
        while m + 1 < len(order) and kinds[order[m + 1]] == kind:
            m += 1
        before, after = (kinds[order[n - 1]] if n else None), (kinds[order[m + 1]] if m + 1 < len(order) else None)
        run = range(n, m + 1)
        if kind == "bullet":
            joined = m == n and before == "prose" and after in ("prose", "bare", None) and order[n] - order[n - 1] == 1
            for k in run:
                kinds[order[k]] = "prose" if joined else "list"
        elif kind == "bare":
            title = lines[order[n]].lstrip()[:1] in "#>" or lines[order[m]].rstrip().endswith(":")
            if len(run) >= 3 and not (before == after == "prose" and len(run) < 5 and order[m] - order[n] == m - n):
                told = "list"
            elif before in ("list", "bullet") and after in ("list", "bullet") or after == "bullet" and title:
                told = "list"
            elif "prose" in (before, after) or title and after is not None or share >= 0.15:
                told = "prose"
            else:
                told = "list" if "list" in (before, after) or after == "bullet" else before if before in ("table", "junk") else after if after in ("table", "junk") else "list" if len(run) == 2 else "junk"
            for k in run:
                kinds[order[k]] = told
        n = m + 1
    for i in order:
        chars[kinds[i]] += size[i]
    return chars, plain_chars


#: The statistics of a text, in order. None of them says what kind of line the text is made of.
STATISTICS = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "lines_ending_in_punctuation", "common_words", "neighbour_fit",
    "packed_size", "odd_characters", "log_words_a_line", "common_line_characters", "gap_ratio",
)
#: Below this share of common words a text's language can't be told from it.
LANGUAGE_SHARE = 0.15
#: A text that zlib packs this small, of at least this many words, says one thing over and over.
REPEATED, REPEATED_WORDS = 0.12, 12
ODD_SHARE = 0.02


class Neighbours:
    """How well common words and the words around them follow each other, from counts over all texts.

    A word is its place among its language's common words, or 0. The table holds, for each language, the pointwise
    mutual information of neighbours: above 0 on average in sentences, near 0 in words shuffled.
    """

    def __init__(self) -> None:
        self.place = {lang: {w: i + 1 for i, w in enumerate(sorted(common))} for lang, common in COMMON.items()}
        self.table: dict[str, np.ndarray] = {}

    def cells(self, words: list[str], lang: str) -> np.ndarray:
        get = self.place[lang].get
        at = np.array([get(w, 0) for w in words], np.int32)
        return at[:-1] * (len(self.place[lang]) + 1) + at[1:]

    def fit(self, counts: dict[str, np.ndarray], smoothing: float = 20.0) -> Neighbours:
        for lang, flat in counts.items():
            k = len(self.place[lang]) + 1
            n = flat.reshape(k, k).astype(float)
            follow = (n.sum(0) + 1) / (n.sum() + k)
            given = (n + smoothing * follow) / (n.sum(1, keepdims=True) + smoothing)
            self.table[lang] = np.log(given / follow).ravel()
        return self

    def means(self, lang: str, cells: np.ndarray, counts: np.ndarray, starts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Mean fit of the neighbours of texts of one language, drawn towards 0 in short ones.

        cells and counts of all the texts in a row, each from its place in starts on.
        """
        table = self.table.get(lang)
        if table is None or not len(cells):
            return np.zeros(len(n_words))
        total = np.concatenate([[0.0], np.cumsum(table[cells] * counts)])
        ends = np.append(starts[1:], len(cells))
        return (total[ends] - total[starts]) / (n_words + 9)


def told_language(words: list[str]) -> tuple[str, float]:
    """Language ('und' if it can't be told) and share of common words."""
    lang, share = language(Counter(filter(ANY_COMMON.__contains__, words)), len(words))
    return lang if share >= LANGUAGE_SHARE else "und", share


NO_CELLS = np.zeros(0, np.int32)


def text_statistics(text: str | None, neighbours: Neighbours) -> tuple[str, int, list[float], dict[str, int], bool, np.ndarray]:
    """(language, words, statistics, characters by kind of line, whether the text is broken or repeats itself, its neighbours).

    neighbour_fit is left at 0: it follows from the neighbours, a cell for each two words, once all texts are counted.
    """
    text = text or ""
    by_line = words_by_line(text)
    words = list(chain.from_iterable(by_line))
    lang, share = told_language(words)
    n = len(words)
    size = len("".join(text.split()))
    odd = _odd_share(text, size)
    raw = text.encode("utf-8", "replace")
    packed = min(1.0, len(zlib.compress(raw, 1)) / len(raw)) if raw else 0.0
    broken = odd > ODD_SHARE or (packed < REPEATED and n >= REPEATED_WORDS and len(raw) >= 100)
    chars, plain = told_lines(text, share, by_line) if size else (dict.fromkeys(KINDS, 0), 0)
    letters = len("".join(words))
    digits = sum(map(text.count, "0123456789"))
    lines = [x for x in map(str.rstrip, text.splitlines()) if x]
    ending = len([x for x in lines if x[-1] in ENDINGS]) / len(lines) if lines else 0.0
    gaps = text.count("\t") + text.count("  ")
    stats = [
        float(np.log1p(n)), letters / n if n else 0.0, max(0, size - letters - digits) / size if size else 0.0, digits / size if size else 0.0, ending, share,
        0.0, packed, min(1.0, odd), float(np.log1p(n / max(1, len(lines)))), plain / size if size else 0.0, gaps / len(text) if text else 0.0,
    ]
    cells = neighbours.cells(words, lang) if lang != "und" and n > 1 else NO_CELLS
    return lang, n, stats, chars, broken, cells
