"""Person names as typed: parts, nicknames, and whether two profiles may be one person."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .venues import plain

#: Short forms of given names and what they stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "andy": "andrew andreas", "annie": "anna anne", "becky": "rebecca", "ben": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "bob": "robert", "cathy": "catherine katherine", "cesca": "francesca", "charlie": "charles charlotte", "chiara": "clara", "chris": "christopher christine christian", "dan": "daniel",
    "dave": "david", "dick": "richard", "dolly": "dorothy dolores", "lola": "dolores", "dora": "theodora dorothea", "ed": "edward edmund", "eddie": "edward", "ella": "eleanor elizabeth", "frank": "francis franklin",
    "fred": "frederick", "fritz": "friedrich frederick", "gabi": "gabriele", "gerry": "gerald", "greg": "gregory gregor", "gus": "augustus gustav", "hal": "henry", "hank": "henry", "hanna": "johanna", "hans": "johannes",
    "harry": "henry harold", "heini": "heinrich", "hetty": "henrietta", "jack": "john", "jan": "johannes", "jenny": "jennifer", "jim": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jo": "josephine johanna",
    "josie": "josephine", "jurgen": "georg", "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kit": "christopher", "klaus": "nikolaus", "larry": "laurence", "leo": "leonard", "len": "leonard",
    "lena": "helena magdalena", "leni": "helene", "lenny": "leonard", "liz": "elizabeth", "lizzie": "elizabeth", "lotte": "charlotte", "lucy": "lucia", "maggie": "margaret", "matt": "matthew", "matze": "matthias", "max": "maximilian",
    "meg": "margaret", "mick": "michael", "mike": "michael", "misha": "mikhail", "molly": "mary", "nacho": "ignacio", "nan": "anne", "nat": "nathaniel natalie", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas",
    "pancho": "francisco", "paco": "francisco", "pasha": "pavel", "pat": "patricia patrick", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip philippa", "pippa": "philippa", "polly": "mary", "rick": "richard", "rob": "robert",
    "ron": "ronald", "rudi": "rudolf", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra", "sasha": "alexander alexandra", "sepp": "josef", "sigi": "siegfried", "steffi": "stefanie", "steve": "stephen steven", "sue": "susan susanna",
    "susi": "susanna", "ted": "edward theodore", "teddy": "theodore edward", "theo": "theodore", "tim": "timothy", "tina": "christina", "toby": "tobias", "tom": "thomas", "toni": "antonia anton", "tony": "anthony", "uli": "ulrich ulrike", "ulli": "ulrich",
    "liv": "olivia", "etta": "henrietta", "quin": "quentin", "beppe": "giuseppe", "tonio": "antonio", "lise": "elisabeth",
    "uschi": "ursula", "val": "valentina valentine", "vicky": "victoria", "vika": "victoria", "walt": "walter", "will": "william", "wolf": "wolfgang", "zhenya": "yevgenia", "genia": "yevgenia",
}
PARTICLES = frozenset("van von der den de del della di da du la le al el ter ten zu".split())
INITIALS = re.compile(r"(?:[^\W\d_]\.?[-.]?){1,4}")
DIGITS = str.maketrans("0156", "olsb")


def letters(text: str) -> str:
    return "".join(c for c in plain(text).lower().translate(DIGITS) if c.isalpha())


def _initials(token: str) -> bool:
    bare = re.sub(r"[.\-]", "", token)
    return 0 < len(bare) <= 4 and bare == bare.upper() and bare.isalpha() and INITIALS.fullmatch(token) is not None


@dataclass(frozen=True)
class Name:
    """``surname`` (letters only), ``initials`` in order, and the given name if it is spelled out."""

    surname: str
    initials: str
    given: str


def parse_name(text: str) -> Name | None:
    """The parts of a typed name, whatever their order; None if there is no surname."""
    text = text.strip()
    if "," in text:
        last, _, first = text.partition(",")
        lasts, firsts = last.split(), first.split()
    else:
        tokens = text.split()
        if len(tokens) > 1 and _initials(tokens[-1]) and (not _initials(tokens[0]) or len(re.sub(r"\W", "", tokens[0])) > 3):
            k = len(tokens)
            while k > 1 and _initials(tokens[k - 1]):
                k -= 1
            lasts, firsts = tokens[:k], tokens[k:]
        else:
            k = 0
            while k < len(tokens) - 1 and _initials(tokens[k]):
                k += 1
            if not k and len(tokens) > 1:
                k = 1
                while k < len(tokens) - 1 and _initials(tokens[k]):
                    k += 1
            firsts, lasts = tokens[:k], tokens[k:]
    surname = letters("".join(lasts))
    if len(surname) < 2 or not firsts:
        return None
    initials, given = "", ""
    for t in firsts:
        bare = re.sub(r"[.\-]", "", t)
        if _initials(t):
            initials += plain(bare).lower()
        else:
            parts = [letters(p) for p in t.split("-")]
            initials += "".join(p[:1] for p in parts)
            given = given or "".join(parts)
    return Name(surname, initials, given) if initials else None


def formal(given: str) -> set[str]:
    return {given, *NICKNAMES.get(given, "").split()} if given else set()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swapped neighbours, or ``most`` + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    older, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        low = i
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            now[j] = d
            low = min(low, d)
        if low > most:
            return most + 1
        older, row = row, now
    return row[-1]


def given_alike(a: str, b: str) -> bool:
    fa, fb = formal(a), formal(b)
    if fa & fb:
        return True
    return any(edits(x, y, 2 if min(len(x), len(y)) > 6 else 1) <= (2 if min(len(x), len(y)) > 6 else 1) for x in fa for y in fb if min(len(x), len(y)) > 3)


def reach(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 11 else 3


def near(a: str, b: str) -> int:
    """Edits between two surnames as far as they may be one, else 99; ``rn`` typed for ``m`` is one edit."""
    if a == b:
        return 0
    most = reach(a, b)
    d = edits(a, b, most)
    if "rn" in a or "rn" in b:
        d = min(d, 1 + edits(a.replace("rn", "m"), b.replace("rn", "m"), most))
    return d if d <= most else 99


@dataclass
class Profile:
    """What is known of one person: unions of what the merged spellings say."""

    ids: set[int] = field(default_factory=set)
    surnames: set[str] = field(default_factory=set)
    initials: set[str] = field(default_factory=set)
    givens: set[str] = field(default_factory=set)

    def leads(self) -> set[str]:
        """First letters under which the person may appear."""
        return {i[0] for i in self.initials} | {f[0] for g in self.givens for f in formal(g)}


def initials_agree(a: Profile, b: Profile) -> bool:
    """Every way of writing the initials of one continues or begins every way of the other;
    a short form may have another first letter."""
    firsts = a.leads() & b.leads()
    if not firsts:
        return False
    for x in a.initials:
        for y in b.initials:
            k = min(len(x), len(y))
            if x[:k] != y[:k] and x[1:k] != y[1:k]:
                return False
            if x[0] != y[0] and not (a.givens or b.givens):
                return False
    return True


def givens_agree(a: Profile, b: Profile) -> bool:
    return all(given_alike(x, y) for x in a.givens for y in b.givens)


def at_odds(a: Profile, b: Profile) -> bool:
    """What the two say of given names can't be true of one person, whatever the surnames."""
    return not initials_agree(a, b) or not givens_agree(a, b)
