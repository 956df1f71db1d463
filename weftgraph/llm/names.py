"""Names of people and organisations as typed: parsing, canonical form, and Monge-Elkan similarity. Pure Python."""

from __future__ import annotations

import re
import unicodedata

# Short forms of given names, with the names they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander alexandra", "al": "albert alan alfred", "sandy": "alexander sandra", "andy": "andrew", "tony": "anthony", "ant": "anthony",
    "becca": "rebecca", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "bella": "isabella", "izzy": "isabella", "isa": "isabella isabel", "beth": "elizabeth",
    "betsy": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lizzy": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "bill": "william", "billy": "william",
    "will": "william", "willy": "william", "liam": "william", "bob": "robert", "bobby": "robert roberta", "bobbie": "roberta robert", "rob": "robert", "robbie": "robert", "bert": "robert albert", "cathy": "catherine katherine",
    "charlie": "charles charlotte", "chuck": "charles", "lottie": "charlotte", "chris": "christopher christina christine", "kit": "christopher katherine", "kris": "christopher", "topher": "christopher",
    "dan": "daniel", "danny": "daniel", "dani": "danielle", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard", "rich": "richard", "rick": "richard", "richie": "richard", "ricky": "richard",
    "dot": "dorothy", "drew": "andrew", "ed": "edward edwin", "eddie": "edward", "ned": "edward", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "fran": "francesca frances francis", "frankie": "francesca francis", "franny": "francesca frances", "chesca": "francesca",
    "frank": "francis franklin", "fred": "frederick", "gabby": "gabriela gabriella", "gaby": "gabriela gabriella", "olya": "olga", "dima": "dmitri", "mitya": "dmitri", "pepe": "jose", "cesca": "francesca", "juergen": "jurgen", "bjoern": "bjorn", "soeren": "soren", "gabi": "gabriela", "gabe": "gabriel", "greg": "gregory", "hank": "henry", "harry": "henry harold", "jack": "john", "jim": "james", "jimmy": "james",
    "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "jerry": "gerald jerome", "jo": "josephine joanna", "josie": "josephine", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "kitty": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "lea": "leonora", "nora": "leonora eleanor", "leon": "leonard",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "margie": "margaret", "greta": "margaret", "marge": "margaret", "marty": "martin martha", "matt": "matthew", "matty": "matthew", "mike": "michael", "mick": "michael", "micky": "michael", "mickey": "michael", "mikey": "michael",
    "shelly": "michelle", "shell": "michelle", "nick": "nicholas", "nicky": "nicholas nicole", "nico": "nicholas", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip",
    "ron": "ronald", "sam": "samuel samantha", "sammy": "samuel", "steve": "steven stephen", "sue": "susannah susan", "susie": "susannah susan", "suzy": "susannah", "suzie": "susannah", "susan": "susannah", "anna": "susannah", "tom": "thomas", "tommy": "thomas", "tim": "timothy",
    "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "walt": "walter", "zach": "zachary", "robbi": "roberta", "berta": "roberta", "xander": "alexander", "sasha": "alexander", "lex": "alexander", "mags": "margaret", "jenna": "jennifer", "ellie": "eleanor", "max": "maximilian",
}
# Words that are no part of a person's name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame lady lord rev hon judge justice capt captain eng phd md esq jr sr ii iii iv mba msc bsc ma ba dds rn cpa jd llm author inventor physician patient student investor director".split())
# Small words within family names.
PARTICLES = frozenset("van von de der den di da del della la le du dos das ter ten al el bin ibn zu".split())
# Legal forms, with the form they are the same as.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "ltd": "ltd", "limited": "ltd", "llc": "llc", "plc": "plc", "gmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag",
    "sa": "sa", "oy": "oy", "oyj": "oy", "bv": "bv", "nv": "nv", "co": "corp", "company": "corp", "kg": "kg", "spa": "spa", "srl": "srl", "ab": "ab", "asa": "as", "sarl": "sarl", "lp": "lp", "llp": "llp",
}
# Abbreviations of words in names of organisations.
WORDS = {
    "intl": "international", "int": "international", "mfg": "manufacturing", "mfrs": "manufacturing", "grp": "group", "svcs": "services", "svc": "services", "sys": "systems", "syst": "systems", "labs": "laboratories", "lab": "laboratories", "ptnrs": "partners",
    "ptrs": "partners", "soln": "solutions", "solns": "solutions", "sol": "solutions", "trdg": "trading", "trd": "trading", "hldgs": "holdings", "hlgs": "holdings", "hldg": "holdings", "inds": "industries", "ind": "industries", "engg": "engineering", "eng": "engineering", "engr": "engineering", "wks": "works", "chem": "chemicals", "chems": "chemicals",
    "log": "logistics", "logs": "logistics", "pharmaceuticals": "pharma", "pharm": "pharma", "pharmaceutical": "pharma", "univ": "university", "uni": "university", "inst": "institute", "hosp": "hospital", "ins": "insurance", "insur": "insurance", "tech": "technology", "semi": "semiconductors", "semis": "semiconductors", "rlys": "railways", "rys": "railways", "rwys": "railways",
    "mar": "maritime", "shpg": "shipping", "tex": "textiles", "mat": "materials", "mats": "materials", "hyd": "hydraulics", "elec": "electronics", "assoc": "association", "dept": "department", "natl": "national", "bros": "brothers", "mgmt": "management", "aero": "aerospace", "robot": "robotics", "cer": "ceramics", "opt": "optics", "soft": "software", "sw": "software", "analyt": "analytics", "min": "mining", "bio": "biotech",
}
JOINERS = frozenset("and und et y e of the for de fur".split())
DIGITS = str.maketrans("01345", "oieas")


def plain(text: str) -> str:
    """Lower case without accents, digits within words read as letters."""
    text = text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("æ", "ae").replace("ł", "l").replace("đ", "d")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])[01345]|[01345](?=[a-z])", lambda m: m[0].translate(DIGITS), text.lower())


def parse_person(raw: str) -> tuple[list[str], list[str]]:
    """(given or unsure tokens, tokens that must be family names because they stand before a comma)."""
    text = plain(re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2,})(?<!Mc)(?<!Mac)", " ", raw))
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"['’`]", "", text)
    parts = [[w for w in re.findall(r"[a-z]+", p) if w not in TITLES and w not in PARTICLES] for p in text.split(",")]
    parts = [p for p in parts if p]
    if len(parts) >= 2:
        return [w for p in parts[1:] for w in p], parts[0]
    return (parts[0] if parts else []), []


def parse_organisation(raw: str) -> tuple[list[str], str]:
    """(tokens without legal form and small words, legal form or '')."""
    text = plain(raw)
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"['’`]", "", text)
    out, legal = [], ""
    # Letters set apart by full stops or blanks belong together: s.a. is sa.
    text = re.sub(r"\b[a-z](?:[. ]+[a-z]\b)+", lambda m: re.sub(r"[. ]+", "", m[0]), text)
    for w in re.findall(r"[a-z]+", text):
        if w in LEGAL and out:
            legal = LEGAL[w]
        elif w not in JOINERS:
            out.append(WORDS.get(w, w))
    return out, legal


def letters(word: str, known: dict[str, int] = {}) -> int:  # noqa: B006 (a cache)
    """The set of a word's letters as bits."""
    if word not in known:
        if len(known) > 500_000:
            known.clear()
        known[word] = sum(1 << (ord(c) % 61) for c in set(word))
    return known[word]


def edits(a: str, b: str, limit: int = 3) -> int:
    """Edit distance with swaps of neighbours, or limit + 1. An edit changes the set of letters by two at most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit or (letters(a) ^ letters(b)).bit_count() > 2 * limit:
        return limit + 1
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > limit:
            return limit + 1
        older, row = row, new
    return min(row[-1], limit + 1)


def typo_limit(n: int) -> int:
    return 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 9 else 3


def token_similarity(a: str, b: str, common: frozenset[str]) -> float:
    """1 for the same, less for each typing error, 0.85 for an initial; 0 for two known words that differ."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        if len(a) == len(b) == 1:
            return 0.0
        one, full = (a, b) if len(a) == 1 else (b, a)
        return 0.85 if one == full[0] or any(one == f[0] for f in NICKNAMES.get(full, "").split()) else 0.0
    na, nb = NICKNAMES.get(a, "").split(), NICKNAMES.get(b, "").split()
    if b in na or a in nb or set(na) & set(nb):
        return 0.95
    if a in common and b in common:
        return 0.0
    limit = typo_limit(min(len(a), len(b)))
    d = edits(a, b, limit)
    if d <= limit:
        return 1.0 - d / max(len(a), len(b))
    for formal in na:  # a typo in the name that a short form stands for
        if edits(formal, b, 1) <= 1:
            return 0.85
    for formal in nb:
        if edits(formal, a, 1) <= 1:
            return 0.85
    return 0.0


def assign(a: list[str], b: list[str], common: frozenset[str]) -> tuple[list[tuple[str, str, float]], list[str], list[str]]:
    """Best one-to-one pairs of tokens, greedily from the most similar, and what each side has left.

    A token may also match two neighbouring tokens of the other side written as one.
    """
    scored = sorted(((token_similarity(x, y, common), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda t: (-t[0], abs(t[1] - t[2]), t[1], t[2]))
    ua, ub, pairs = set(), set(), []
    for s, i, j in scored:
        if s <= 0:
            break
        if i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            pairs.append((a[i], b[j], s))
    ra, rb = [x for i, x in enumerate(a) if i not in ua], [y for j, y in enumerate(b) if j not in ub]
    for x, y, flip in ((ra, rb, False), (rb, ra, True)):
        for t in list(x):
            for k in range(len(y) - 1):
                for joined in (y[k] + y[k + 1], y[k + 1] + y[k]):
                    if len(joined) >= 6 and len(t) >= 6 and t in x and edits(t, joined, typo_limit(len(t))) <= typo_limit(len(t)):
                        x.remove(t)
                        pairs.append((joined, t, 0.95) if flip else (t, joined, 0.95))
                        del y[k : k + 2]
                        break
                else:
                    continue
                break
    return pairs, ra, rb


class Form:
    """One canonical spelling: its rare tokens (family or core names), known tokens, legal form, and whether it is
    complete enough to stand for the entity without its context."""

    __slots__ = ("rare", "known", "legal", "full", "acronym", "text")

    def __init__(self, rare: list[str], known: list[str], legal: str, full: bool, acronym: bool) -> None:
        self.rare, self.known, self.legal, self.full, self.acronym = rare, known, legal, full, acronym
        self.text = "|".join((" ".join(sorted(rare)), " ".join(sorted(known)), legal, "F" if full else "A" if acronym else "-"))

    @classmethod
    def read(cls, text: str) -> Form:
        rare, known, legal, kind = text.split("|")
        return cls(rare.split(), known.split(), legal, kind == "F", kind == "A")


def _nearest(word: str, common: frozenset[str], limit: int) -> str | None:
    best, found = limit + 1, []
    for c in common:
        if abs(len(c) - len(word)) <= limit and c[0] == word[0] or c[1:3] == word[1:3]:
            d = edits(word, c, limit)
            if d < best:
                best, found = d, [c]
            elif d == best:
                found.append(c)
    return found[0] if best <= limit and len(found) == 1 else None


def canonical_form(kind: str, raw: str, common: frozenset[str]) -> Form | None:
    """The canonical form of a typed name, or None if nothing is left of it. common: words that occur with many others."""
    if kind == "Person":
        loose, family = parse_person(raw)
        if not loose and not family:
            return None
        rare = list(family)
        known: list[str] = []
        unsure = []
        for w in loose:
            if len(w) == 1:
                known.append(w)
            elif w in common or w in NICKNAMES:
                formal = [f for f in NICKNAMES.get(w, "").split() if f in common]
                known.append(formal[0] if len(formal) == 1 else w)
            else:
                unsure.append(w)
        # Of several unknown words all but the least likely one may be known names with a typing error.
        spare = len(unsure) + len(rare) - 1
        near = sorted((edits(w, n), w, n) for w in unsure if len(w) >= 4 for n in [_nearest(w, common, 1 if len(w) <= 5 else 2)] if n)
        for _, w, n in near:
            if spare <= 0:
                break
            if w in unsure and not (known and any(len(k) > 1 for k in known) and len(rare) + len(unsure) <= 1):
                unsure.remove(w)
                known.append(n)
                spare -= 1
        rare += unsure
        if not rare:  # a family name that is also a given name stands last, or before the comma
            if len(known) < 2:
                return Form(known, [], "", False, False) if known else None
            rare = [known.pop()]
        return Form(rare, known, "", any(len(k) > 1 for k in known) or _whole(rare), False)
    tokens, legal = parse_organisation(raw)
    rare, known = [], []
    for w in tokens:
        if w in common:
            known.append(w)
            continue
        tail = next((c for c in common if len(c) >= 5 and len(w) - len(c) >= 3 and w.endswith(c)), None)
        if tail:
            rare.append(w[: -len(tail)])
            known.append(tail)
            continue
        near = _nearest(w, common, 1 if len(w) <= 5 else 2) if len(w) >= 4 else None
        if near and len(tokens) > 1 and (rare or any(x not in common and x != w for x in tokens)):
            known.append(near)
        else:
            rare.append(w)
    if not rare and not known:
        return None
    if not rare:
        rare = [known.pop(0)]
    acronym = len(tokens) == 1 and len(tokens[0]) <= 4
    return Form(rare, known, legal, (bool(known) or _whole(rare)) and not acronym, acronym)


def _whole(rare: list[str]) -> bool:
    """Two words are a whole name, even if the data are too few to tell which of them is the given or general one."""
    return sum(len(w) > 1 for w in rare) >= 2


def acronym_of(kind_order: list[str]) -> str:
    return "".join(w[0] for w in kind_order)


#: Weight of a context property that agrees or differs, in units of similarity.
AGREES, DIFFERS = 0.08, -0.12


def context_score(a: tuple, b: tuple) -> float:
    """Agreement of city, year and third property (affiliation, industry); missing ones count nothing. A year off by 1 or
    10 is a slip of the pen."""
    out = 0.0
    for x, y, weight in zip(a, b, (1.0, 1.2, 1.6)):
        if x and y:
            if x == y:
                out += AGREES * weight
            elif x.isdigit() and y.isdigit() and abs(int(x) - int(y)) in (1, 10):
                out += AGREES * 0.4
            else:
                out += DIFFERS * weight
    return out


#: Links need this much: Monge-Elkan similarity of the names plus what the context adds.
THRESHOLD = 0.80


def similarity(kind: str, a: Form, b: Form, ctx_a: tuple, ctx_b: tuple, common: frozenset[str]) -> float:
    """Monge-Elkan similarity of two forms with their context, 0 where they contradict each other.

    The mean runs over the shorter form's tokens: what only one side has does not count against it, unless both sides
    have something that the other lacks.
    """
    context = context_score(ctx_a, ctx_b)
    if kind != "Person" and a.acronym != b.acronym:
        return 0.82 + context if context >= AGREES * 0.9 else 0.0
    if a.legal and b.legal and a.legal != b.legal:
        return 0.0
    pairs, ra, rb = assign(a.rare, b.rare, common)
    if not pairs and not (a.known and b.rare or b.known and a.rare):
        return 0.0
    known, ka, kb = assign(a.known, b.known, common)
    if (ra or ka) and (rb or kb) and not pairs and not known:
        return 0.0
    # Words put into the wrong class by a typing error may still meet.
    if (ra or ka) and (rb or kb):
        more, xa, xb = assign(ra + ka, rb + kb, common)
        pairs_all = pairs + known + more
    else:
        more, xa, xb = [], ra + ka, rb + kb
        pairs_all = pairs + known
    if not pairs_all or not (pairs or any(x in a.rare or y in b.rare for x, y, _ in more)):
        return 0.0
    if xa and xb:
        return 0.0
    name = min((s for x, y, s in pairs if len(x) > 1 and len(y) > 1), default=0.75)
    if name < 0.6:
        return 0.0
    weights = [(2.0 if len(x) > 1 and len(y) > 1 and (x not in common or y not in common) else 1.0) for x, y, _ in pairs_all]
    mean = sum(w * s for w, (_, _, s) in zip(weights, pairs_all)) / sum(weights)
    left = xa or xb
    mean -= 0.06 * len([w for w in left if len(w) > 1 and w not in common]) + 0.02 * len([w for w in left if len(w) > 1 and w in common])
    if kind == "Person":
        full = any(len(x) > 1 and len(y) > 1 for x, y, _ in known + more)
        if not full and (a.known and b.known or not a.known or not b.known):
            # Only initials vouch for the given name: the context must not speak against it.
            return mean + context - 0.04 if context > -0.1 else 0.0
    # Between complete names that agree but for words left out, the context counts half.
    spelled = all(s >= 0.85 for _, _, s in pairs_all)
    return mean + 0.5 * context if a.full and b.full and spelled else mean + context
