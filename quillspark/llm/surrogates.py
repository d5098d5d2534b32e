"""Personal data replaced by surrogates.

An entity's surrogate is a keyed permutation of its own form: every letter is replaced by one of its script, case and kind (vowel or
consonant, so that names can be spoken), every digit by a digit its place allows; separators, titles and particles of names stay. Given
names that are listed are permuted among those of their gender and script. A permutation gives different entities of one form different
surrogates, equal ones the same one everywhere (spellings are brought to one form before: case, or the punctuation of a number), and none
keeps its value. Nothing has to be remembered or exchanged between tasks, and a new corpus under the same key continues the old one.

People are found by title, by a listed given name with a surname, and by title-case words (hyphens, apostrophes, initials, particles) beside
words that speak of people; names joined to a person found this way are people, too. A name without any of these is not found.

Every entity carries `original`, a keyed digest of its canonical form, so that distinctness and coreference are checked over a whole corpus
from the entities alone: `check` compares how many originals and surrogates there are, `clashing` lists surrogates that stand for two originals.

Defined results: a null text stays null; a text without entities stays as it is; of overlapping entities the first, then the longest counts; a match that
fails its check (card, address, common words in a name) is none, and hides nothing that begins inside it; very long texts are read whole; rows that
repeat get equal surrogates; an empty table gives an empty result. A column named entities is replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, written

# Given names by gender and script.
GIVEN = {
    ("female", "latin"): "Alice Amelie Anna Carmen Clara Claire Elena Emily Emma Eva Grace Hannah Helen Ines Isabel Jane Julia Karin Laura Lena Louise Lucia Maria Marie Martha Nora Paula Rosa Sarah Sofia Susan Ursula".split(),
    ("male", "latin"): "Adam Albert Andrew Antonio Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henry Hugo James John Jorge Juan Karl Louis Lukas Martin Michael Miguel Oscar Otto Paul Peter Pierre Robert Thomas Walter William".split(),
    ("female", "cyrillic"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("male", "cyrillic"): "Александр Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("female", "greek"): "Ελένη Μαρία Σοφία Κατερίνα Αθηνά Ειρήνη".split(),
    ("male", "greek"): "Νίκος Γιώργος Δημήτρης Πέτρος Αλέξανδρος Κώστας".split(),
}
_GIVEN = {name: group for group, names in GIVEN.items() for name in names}

# Letters that may replace each other.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùäöüâêîôûëï", "ñçß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
_CLASS = {c: (k, i) for k in CLASSES for i, c in enumerate(k)} | {c.upper(): (k.upper(), i) for k in CLASSES for i, c in enumerate(k) if len(c.upper()) == 1}
_ALL = "abcdefghijklmnopqrstuvwxyz"

# How people are addressed. After the first group a name may be in lower case.
TITLES = "Mr Mrs Ms Dr Herr Frau Mme Señor Señora".split()
MORE_TITLES = "Miss Prof Professor Sir Madam Madame Monsieur Mlle Sr Sra Señorita Doktor Sheikh Г-н Г-жа Господин Госпожа Κύριος Κυρία".split()
PARTICLES = "de del della da di du la le van von der den ten zu bin ibn al el dos das st".split()

# Words beside which title-case words are a person: before one name or more, before two words or more, after two words or more.
NAMING = "my name is|me llamo|je m'appelle|ich heiße|меня зовут|[Dd]ear|[Cc]her|[Cc]hère|[Ll]iebe|[Ll]ieber"
BEFORE = "name is|[Nn]ame:|named|called|I am|I'm|met|told|asked|thanked|[Cc]ontact|[Ss]igned:?|[Ss]incerely,?|[Rr]egards,?|[Aa]uthor:?|[Aa]ttn:?|[Pp]atient:?|wife|husband|son|daughter|brother|sister|mother|father|colleague|friend|neighbour|neighbor|teacher|written by|signed by"
AFTER = "said|says|met|wrote|writes|told|asked|added|replied|lives|lived|works|worked|was born|is married|married|died|joined|called|emailed|phoned|signed|sagte|schrieb|a dit|a écrit|dijo|escribió"
NO_NAMES = set("The This That These Those A An And But Or If In On At By For From With To Of New Old North South East West United University College School Institute Street Road Avenue Square City County State Bank Company Corporation Inc Ltd Group Press Times Post Journal Church Hospital Court House Museum Park River Lake Mountain Island Ocean January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())

# Family names before a title that follows in Chinese characters.
_HAN_FAMILY, _HAN_TITLE = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "先生|女士|小姐|教授|さん|様|氏"

_WORD = r"\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*"
_ONE = rf"(?:{_WORD}|[\p{{Lo}}\p{{M}}]+)"
_MORE = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}(?:{_WORD}|\p{{Lu}}\.))"
_TWO = rf"{_WORD}{_MORE}{{0,3}} (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD}"
_ANY = r"[\p{L}\p{M}\p{No}\p{Nl}]+"
_TITLE = rf"(?:{'|'.join(TITLES + MORE_TITLES)})\.?"
_GIVEN_RE = "|".join(sorted(_GIVEN, key=len, reverse=True))
_PERSON = regex.compile("|".join([
    rf"(?<!\w){_TITLE} {_ONE}{_MORE}{{0,3}}(?!\w)",
    rf"(?<!\w)(?:{'|'.join(TITLES)})\.? {_ANY}(?:['’-]{_ANY})*(?!\w)",
    rf"(?<![\w'’-])(?:{_GIVEN_RE}){_MORE}{{0,3}} (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD}(?!\w)",
    rf"(?<=(?<!\w)(?:{NAMING}) ){_WORD}{_MORE}{{0,3}}(?!\w)",
    rf"(?<=(?<!\w)(?:{BEFORE}) ){_TWO}(?!\w)",
    rf"(?<![\w'’-]){_TWO}(?= (?:{AFTER})(?!\w))",
    rf"[{_HAN_FAMILY}]\p{{Han}}{{1,2}}(?={_HAN_TITLE})",
]))
_JOINED = regex.compile(rf"(?:, and|,| and| und| et| y| и| &) ({_TWO})(?!\w)")
_HEAD = regex.compile(rf"{_TITLE} ")

_CARD_END = r"(?![\d-]|\.\d)"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "secret": re.compile(r"(?i:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?[A-Za-z0-9_/+-]{6,}"),
    "access_key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(rf"(?<![\d.-])\d(?:[ -]?\d){{12,18}}{_CARD_END}"),
    "social": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "address": re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])"),
    "person": _PERSON,
}
#: What a text must hold for a kind's pattern to match anywhere: the patterns without what they require around them. Arrow looks for it.
NEEDS = {
    "email": r"@[A-Za-z0-9-]",
    "secret": r"[=:]",
    "access_key": r"AKIA|ASIA",
    "iban": r"[A-Z]{2}\p{Nd}{2}",
    "card": r"\p{Nd}(?:[ -]?\p{Nd}){12}",
    "social": r"\p{Nd}-\p{Nd}{2}-\p{Nd}",
    "address": r"(?:\p{Nd}\.\p{Nd}{1,3}\.)",
    "phone": r"\p{Nd}[ .-]\p{Nd}{4}|\+\p{Nd}",
    "person": rf"(?:{'|'.join(TITLES + MORE_TITLES)})\.? |\p{{Lu}}[\p{{L}}\p{{M}}'’-]* (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}\p{{Lu}}|(?:{NAMING}) |{_HAN_TITLE}",
}
_CARD_ENDS = re.compile(_CARD_END)


class Permutation:
    """A keyed permutation without fixed points of the numbers below a * b, given as pairs."""

    def __init__(self, key: bytes, tweak: str, a: int, b: int):
        self.a, self.b = a, b
        self.keys = [hmac.digest(key, f"{tweak}|{a}|{b}|{r}".encode(), "sha256") for r in range(8)]
        self.shift = 1 + int.from_bytes(hmac.digest(key, f"{tweak}|{a}|{b}|shift".encode(), "sha256"), "big") % (a * b - 1) if a * b > 1 else 0

    def _round(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.keys[r], digest_size=32).digest(), "big")

    def __call__(self, x: int, y: int) -> tuple[int, int]:
        """The value whose image under a keyed bijection comes `shift` after that of (x, y): never (x, y) itself."""
        for r in range(0, 8, 2):
            x = (x + self._round(r, y)) % self.a
            y = (y + self._round(r + 1, x)) % self.b
        n = (x * self.b + y + self.shift) % (self.a * self.b)
        x, y = divmod(n, self.b)
        for r in range(6, -1, -2):
            y = (y - self._round(r + 1, x)) % self.b
            x = (x - self._round(r, y)) % self.a
        return x, y


@lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, a: int, b: int) -> Permutation:
    return Permutation(key, tweak, a, b)


def permuted(value: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """value with each symbol replaced by one of its place's alphabet ("" keeps it), as one permutation over all places."""
    free = [i for i, a in enumerate(alphabets) if len(a) > 1]
    if not free:
        return value
    half = (len(free) + 1) // 2
    sides = []
    for part in (free[:half], free[half:]):
        n, size = 0, 1
        for i in part:
            n, size = n * len(alphabets[i]) + alphabets[i].index(value[i]), size * len(alphabets[i])
        sides.append((part, n, size))
    form = "".join("*" if len(a) > 1 else c for c, a in zip(value, alphabets, strict=True)) + "|" + "|".join(dict.fromkeys(alphabets))
    new = _permutation(key, f"{tweak}|{form}", sides[0][2], sides[1][2])(sides[0][1], sides[1][1])
    out = list(value)
    for (part, _, _), n in zip(sides, new, strict=True):
        for i in reversed(part):
            n, d = divmod(n, len(alphabets[i]))
            out[i] = alphabets[i][d]
    return "".join(out)


def alphabet(c: str, spoken: bool = False) -> str:
    """The symbols that may stand for c."""
    if "0" <= c <= "9":
        return "0123456789"
    if not spoken and c.lower() in _ALL and len(c.lower()) == 1:
        return _ALL if c.islower() else _ALL.upper()
    return _CLASS[c][0] if c in _CLASS else ""


@lru_cache(maxsize=1)
def _others() -> dict[str, str]:
    """For letters outside CLASSES: those of their script, kind and case, with capitals apart that lower case doesn't lead back from."""
    groups: dict[tuple, list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c.isalnum() and c not in _CLASS and (kind := unicodedata.category(c)) != "Nd":
            name = tuple(unicodedata.name(c, "").split("-")[0].split()[:2])
            groups.setdefault((kind, name, ord(c) >> 16, len(c.upper()) == 1 and c.upper().lower() == c), []).append(c)
    few = "".join(x for g in groups.values() if len(g) == 1 for x in g)
    return {c: a for g in groups.values() for a in [few if len(g) == 1 else "".join(g)] for c in a}


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(chr(ord(c) - int(c) + int(next(it))) if c.isdigit() else c for c in shape)


def _digits(kind: str, value: str, key: bytes) -> str:
    digits = "".join(str(int(c)) for c in value if c.isdigit())  # of any script
    if kind == "card":
        inner = permuted(digits[1:-1], ["0123456789"] * (len(digits) - 2), key, f"card|{digits[0]}")
        return _refill(value, next(x for d in "0123456789" if luhn(x := digits[0] + inner + d)))
    if kind == "phone":  # the last ten digits are one number under any country code or punctuation
        code, rest = digits[:-10], digits[-10:]
        lead = lambda i: "23456789" if len(rest) == 10 and i in (0, 3) and rest[i] in "23456789" else "0123456789"
        return _refill(value, code + permuted(rest, [lead(i) for i in range(len(rest))], key, f"phone|{code if code != '1' else ''}"))
    return _refill(value, permuted(digits, ["0123456789"] * len(digits), key, kind))


def _address(value: str, key: bytes) -> str:
    octets = [int(x) for x in value.split(".")]
    x, y = _permutation(key, "address", 1 << 16, 1 << 16)(octets[0] << 8 | octets[1], octets[2] << 8 | octets[3])
    return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"


def _cased(shape: str, value: str) -> str:
    """value in the case of shape, place by place."""
    return "".join(v.upper() if s.isupper() and len(v.upper()) == 1 else v for s, v in zip(shape, value, strict=True))


def _word(word: str, key: bytes, tweak: str) -> str:
    """A word of a name; what hyphens and apostrophes join is replaced part by part, as it would be alone."""
    parts = re.split("(['’-])", word)
    return "".join(_part(x, key, tweak) if i % 2 == 0 else x for i, x in enumerate(parts))


def _part(word: str, key: bytes, tweak: str) -> str:
    low = word.lower()
    if len(low) != len(word):
        low = word
    alphabets = [alphabet(c, True) for c in low]
    if not any(alphabets):  # no letter of CLASSES: those of its own script
        alphabets = [_others().get(c, "") for c in low]
    new = permuted(low, alphabets, key, tweak)
    return new if low is word else _cased(word, new)


def _person(value: str, key: bytes) -> str:
    title = m[0] if (m := _HEAD.match(value)) else ""
    words = value[len(title) :].split(" ")
    out = []
    for i, w in enumerate(words):
        if w in _GIVEN:  # wherever it stands: alone, first, second or last, a listed name has one surrogate
            group = GIVEN[_GIVEN[w]]
            w = group[_permutation(key, "given|" + "|".join(_GIVEN[w]), len(group), 1)(group.index(w), 0)[0]]
        elif i == len(words) - 1 or w not in PARTICLES:
            w = _word(w, key, "surname")
            while w in _GIVEN:  # walks on through the permutation, which stays one of all words that aren't listed
                w = _word(w, key, "surname")
        out.append(w)
    return title + " ".join(out)


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one entity."""
    if kind == "email":
        low = value.lower()
        local, _, domain = low.partition("@")
        name, dot, top = domain.rpartition(".")
        new = permuted(local, [alphabet(c) for c in local], key, "local") + "@" + permuted(name, [alphabet(c) for c in name], key, "domain") + dot + top
        return _cased(value, new)
    if kind == "person":
        return _person(value, key)
    if kind == "address":
        return _address(value, key)
    if kind in ("card", "phone", "social"):
        return _digits(kind, value, key)
    if kind == "secret":
        at = re.match(r"[^=:]*[=:]\s*[\"']?", value).end()
        hexadecimal = re.fullmatch(r"[0-9a-f]+", value[at:])
        alphabets = ["0123456789abcdef" if hexadecimal else alphabet(c) for c in value[at:]]
        return value[:at] + permuted(value[at:], alphabets if any(alphabets) else ["_/+-"] * len(alphabets), key, "secret")
    keep = 4  # access keys and account numbers keep what names their kind or country
    tail = value[keep:]
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if kind == "access_key" else None
    return value[:keep] + permuted(tail, [mixed or alphabet(c) for c in tail], key, f"{kind}|{value[:keep]}")


def _checked(kind: str, text: str, start: int, end: int) -> int:
    """The end of the longest entity within a match that passes the check of its kind; 0 if there is none."""
    if kind == "address":
        return 0 if any(int(x) > 255 for x in text[start:end].split(".")) else end
    if kind == "person":
        return 0 if not NO_NAMES.isdisjoint(text[start:end].split(" ")) and not _HEAD.match(text, start) else end
    if kind != "card":
        return end
    digits, ends = "", []
    for i in range(start, end):
        if text[i].isdigit():
            digits += text[i]
            ends.append(i + 1)
    return next((ends[n - 1] for n in range(len(digits), 12, -1) if luhn(digits[:n]) and _CARD_ENDS.match(text, ends[n - 1])), 0)


def _next(kind: str, text: str, at: int) -> tuple[int, int] | None:
    """The first entity of a kind that begins at `at` or later. A match that fails its check hides nothing that begins inside it."""
    while m := PATTERNS[kind].search(text, at):
        if end := _checked(kind, text, m.start(), m.end()):
            return m.start(), end
        at = m.start() + 1
    return None


def entities(text: str, kinds: Iterable[str] = tuple(PATTERNS)) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in the order of the text, of the given kinds."""
    ahead = {k: found for k in kinds if (found := _next(k, text, 0))}
    while ahead:
        kind, (start, end) = min(ahead.items(), key=lambda x: (x[1][0], -x[1][1]))
        yield kind, start, end
        for k, (a, _) in list(ahead.items()):
            if a < end:
                if found := _next(k, text, end):
                    ahead[k] = found
                else:
                    del ahead[k]
        if kind == "person" and (m := _JOINED.match(text, end)) and _checked(kind, text, *m.span(1)):
            ahead[kind] = m.span(1)


def digest(kind: str, value: str, key: bytes) -> str:
    """What spellings of one entity have in common, keyed."""
    if kind in ("card", "phone", "social"):
        value = "".join(str(unicodedata.digit(c)) for c in value if c.isdigit())
        if kind == "phone":
            value = (value[:3] if len(value) > 11 else "") + value[-10:]
    elif kind == "email":
        value = value.lower()
    return hmac.digest(key, f"original|{kind}|{value}".encode("utf-8", "surrogatepass"), "sha256").hex()[:32]


ENTITIES = "array<struct<kind:string,start:int,end:int,surrogate:string,original:string>>"


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with surrogates in `text`, and entities: kind, start and end (code points in the old text), surrogate and original (a keyed digest) of each.

    Only texts that Arrow finds to hold what a kind needs are searched for that kind in Python.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "entities"]
    at_text = names.index(text)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("original", pa.string())]))

    def of(t: str, kinds: list[str]) -> tuple[str, list[dict]]:
        own = [{"kind": k, "start": a, "end": b, "surrogate": surrogate(k, t[a:b], key), "original": digest(k, t[a:b], key)} for k, a, b in entities(t, kinds)]
        cut = [0, *[x for e in own for x in (e["start"], e["end"])], len(t)]
        plain = [t[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)]
        return "".join(x for pair in zip(plain, [e["surrogate"] for e in own] + [""], strict=True) for x in pair), own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text)
            may = {k: pc.fill_null(pc.match_substring_regex(texts, need), False).to_numpy(zero_copy_only=False) for k, need in NEEDS.items()}
            some = np.flatnonzero(np.logical_or.reduce(list(may.values())))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            new = []
            for row, t in zip(some.tolist(), texts.take(pa.array(some)).to_pylist(), strict=True):
                t, found[row] = of(t, [k for k in NEEDS if may[k][row]])
                new.append(t)
            mask = np.zeros(batch.num_rows, bool)
            mask[some] = True
            columns = [*batch.columns, pa.array(found, kind_of)]
            columns[at_text] = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "entities"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}, entities {ENTITIES}")


def canonical(kind: F.Column, value: F.Column) -> F.Column:
    """What makes two spellings one entity."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(kind == "email", F.lower(value)).when(kind == "phone", F.concat(F.when(F.length(digits) > 11, F.substring(digits, 1, 3)).otherwise(""), F.right(digits, F.lit(10)))).when(kind.isin("card", "social"), digits).otherwise(value)


def collisions(docs: DataFrame, replaced: DataFrame, on: str = "doc_id", text: str = "text") -> DataFrame:
    """kind, surrogate, n for every surrogate that stands for n > 1 different entities; no row, if all is well. Only entities are shuffled,
    once per distinct pair, and originals as digests."""
    spans = replaced.select(on, F.explode("entities").alias("e")).join(docs.select(on, F.col(text).alias("_old")), on)
    old = F.substring(F.col("_old"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    pairs = spans.select(F.col("e.kind").alias("kind"), canonical(F.col("e.kind"), F.col("e.surrogate")).alias("surrogate"), F.sha2(canonical(F.col("e.kind"), old), 256).alias("old")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1")


def pairs_of(replaced: DataFrame) -> DataFrame:
    """kind, surrogate, original, n: every pair of a canonical surrogate and an original, with its mentions. Mentions are added up before they are shuffled."""
    e = replaced.select(F.explode("entities").alias("e"))
    return e.groupBy(F.col("e.kind").alias("kind"), canonical(F.col("e.kind"), F.col("e.surrogate")).alias("surrogate"), F.col("e.original").alias("original")).agg(F.count("*").alias("n"))


def clashing(replaced: DataFrame) -> DataFrame:
    """kind, surrogate, originals for every surrogate that stands for several originals; no row, if all is well."""
    return pairs_of(replaced).groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).filter("originals > 1")


def check(replaced: DataFrame) -> DataFrame:
    """kind, mentions, originals, surrogates, split (originals with several surrogates: broken coreference) and collisions (surrogates of several
    originals: broken distinctness), over a whole corpus."""
    pairs = pairs_of(replaced)
    by = lambda c, name: pairs.groupBy("kind", c).agg(F.count("*").alias("k"), F.sum("n").alias("n")).groupBy("kind").agg(F.sum("n").alias("mentions"), F.count("*").alias(f"{c}s"), F.count(F.when(F.col("k") > 1, 1)).alias(name))
    return by("original", "split").join(by("surrogate", "collisions").drop("mentions"), "kind").select("kind", "mentions", "originals", "surrogates", "split", "collisions")


#: Key of the query; a run of one's own takes its key from a secret store.
QUERY_KEY = b"surrogates of the test tables"


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its surrogates, how many entities it had, how many different ones, and how many of its surrogates stand for another
    entity as well, anywhere in the corpus."""
    from .text import read_table

    out = written(replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY), "surrogates")
    bad = written(clashing(out), "surrogate-clashes")
    if bad.limit(1).count():  # never under one key; else the documents that are concerned are marked
        e = out.select("doc_id", F.explode("entities").alias("e")).select("doc_id", F.col("e.kind").alias("kind"), canonical(F.col("e.kind"), F.col("e.surrogate")).alias("surrogate"))
        out = out.join(e.join(bad, ["kind", "surrogate"]).groupBy("doc_id").agg(F.count("*").alias("collisions")), "doc_id", "left")
    else:
        out = out.withColumn("collisions", F.lit(0).cast("long"))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.size(F.array_distinct(F.transform("entities", lambda e: F.struct(e["kind"], e["original"])))).alias("n_distinct"),
                      F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",").alias("kinds"), F.coalesce("collisions", F.lit(0)).alias("collisions"))


def surrogate_check(spark, sf_dir: str) -> DataFrame:
    """Distinctness and coreference of the surrogates of all documents, by kind."""
    from .text import read_table

    return check(replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY))
