"""Personal data: base patterns, and spans added by weak supervision.

Candidates beyond the base kinds come from loose patterns. Regex, gazetteer and context labelers each vote on every
candidate (personal, not, or none). Expectation-maximisation over the counts of vote patterns of all candidates
estimates how reliable each labeler is, for each kind; the resulting chances train a logistic span classifier over votes and
shape features, whose verdict decides which candidates are added. Patterns of votes and features are few (their number is
bounded by their definition, whatever the data), so training uses every candidate of every document. The classifier's
features are those of a kind by itself: no vote has to mean the same for two kinds.

Defined results for odd input: a null text is empty; ids may be null or repeated; further columns are ignored; whole texts are
searched, in time linear in their length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("credential", "key", "national_id", "loose_phone", "person", "hidden_email", "iban", "birth_date", "address")
KINDS = BASE_KINDS + ADDED_KINDS

# Possessive forms of the base patterns: a match starts at the head of a run of digits or not at all, so runs need no retries. Patterns begin
# with a character and look back over it, for the engine skips to the characters that can begin one only where no assertion comes first.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CREDENTIAL = re.compile(
    r"(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)(?:[_-](?:access|api|key|token|value|secret|hash)){0,3}"
    r"[\"']?[\x20]{0,2}[=:][\x20]{0,2}[\"']?([^\s\"',;]{4,}+)",
    re.I,
)
# A whole run, whatever its length; candidates() asks for a digit in it or a known prefix. Some prefixes end with a hyphen, some tokens have dots.
_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?=[A-Za-z0-9_-]{20})(?:xoxb|xoxp|glpat)-[A-Za-z0-9_-]++|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){1,4}+|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|[A-Za-z0-9_]{20,}+)"
)
#: Runs to base 64 that a slash or plus would cut, and whole blocks of private keys (the head alone where the end is missing).
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/._=-])(?=[A-Za-z0-9]{0,200}[+/])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/._-])")
_BLOCK = re.compile(r"-----BEGIN\x20(?:[A-Z0-9]{2,12}\x20){0,3}PRIVATE\x20KEY-----(?:[A-Za-z0-9+/=\s]*+-----END\x20(?:[A-Z0-9]{2,12}\x20){0,3}PRIVATE\x20KEY-----)?")
_DIGIT = re.compile(r"[0-9]")
_NATIONAL = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOOSE_PHONE = re.compile(r"[(0-9](?<![0-9+][(0-9])(?:(?<=\()[0-9]{3}\)\x20?|(?<=[0-9])[0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_UPPER = "A-ZÀ-ÖØ-Þ"
_TITLED = re.compile(r"[MDPHFS](?<![A-Za-z][MDPHFS])(?:(?<=M)(?:rs?|s|me)|(?<=D)r|(?<=P)rof|(?<=H)err|(?<=F)rau|(?<=S)ra)\.?\x20(\w\w++\x20\w\w++)")
#: Capitalised words of letters, in a row.
_NAME = rf"[{_UPPER}][^\W\d_]++(?!\w)"
_PERSON = re.compile(rf"[{_UPPER}](?<![\w-][{_UPPER}])[^\W\d_]++(?!\w)(?:\x20{_NAME}(?:-{_NAME})?)++")
_HIDDEN = re.compile(r"(?<![\w.+-])[\w.+-]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[\w-]++\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,}+(?!\w)", re.I)
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DATE = re.compile(r"[0-9](?<![0-9./-][0-9])(?:[0-9]?([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:(?<=1)9|(?<=2)0)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-]?[0-9])")

# The gazetteers.
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key", "private", "credential", "login", "bearer", "access")
CONTACT_WORDS = ("phone", "call", "tel", "mobile", "fax", "contact", "ssn", "social", "born", "patient", "dear", "signed")
NEUTRAL_WORDS = (
    "example", "sample", "dummy", "test", "version", "isbn", "order", "figure", "table", "page", "commit", "revision", "checksum", "digest", "serial", "model", "part no",
    "invoice", "published", "updated", "released", "deadline", "chapter", "article", "sku", "ticket", "build", "look", "placeholder", "museum", "hotel", "station", "festival",
)
#: Words before a span that speak for its kind.
KIND_WORDS = {
    "credential": SECRET_WORDS,
    "key": SECRET_WORDS,
    "national_id": ("ssn", "social", "security number", "national id", "identity", "tax id", "patient"),
    "loose_phone": ("phone", "call", "tel", "mobile", "fax", "contact", "reach", "dial", "cell", "text me", "whatsapp"),
    "person": ("dear", "signed", "contact", "patient", "born", "name", "by ", "sincerely", "regards", "met ", "with ", "from ", "employee", "customer", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "sra", "mme"),
    "hidden_email": ("mail", "contact", "write", "reach", "send", "address"),
    "iban": ("iban", "account", "bank", "transfer", "pay"),
    "birth_date": ("born", "birth", "dob", "né", "geboren", "nacid", "birthday"),
    "address": ("address", "live", "lives", "resid", "home", "ship to", "deliver", "send", "visit", "wohn", "habite", "vive"),
}
FIRST_NAMES = frozenset(
    """
    james mary john anna maria peter paul hans jean pierre jose luis carlos laura sophie thomas michael sarah david emma robert patricia
    jennifer linda elizabeth william barbara richard susan joseph jessica charles karen daniel lisa matthew nancy anthony betty mark sandra
    donald ashley steven emily andrew kimberly joshua margaret kenneth donna kevin michelle brian carol george amanda timothy melissa ronald
    deborah edward stephanie jason rebecca jeffrey helen ryan alice jacob julia gary ruth nicholas anne eric diana jonathan grace stephen
    larry justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis jerry olivia noah liam lucas hugo louis
    camille chloe manon julie nicolas antoine francois claire isabelle monique jacques michel klaus jürgen wolfgang stefan andreas markus
    sabine petra monika ursula katrin juan antonio manuel francisco javier miguel rosa carmen pilar lucia elena sofia pablo diego alejandro
    """.split()
)
#: Capitalised words that begin no name: greetings, titles, and words at the head of a sentence.
LEADS = frozenset(
    """
    dear hello hi hey signed mr mrs ms dr prof herr frau sra mme sir madam the this that these those there then when where while what who why how and but for
    from with yesterday today tomorrow our my your his her its their they she he we it in on at by as if so no yes please ask tell call meet met
    """.split()
)
#: Words that a name does not end with: places, months, days, institutions.
NOT_NAMES = frozenset(
    """
    hall garden museum station hotel university college school street road avenue lane park river lake mountain city county state house office bank
    january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    company group corporation limited inc ltd gmbh department ministry committee council festival church hospital airport bridge center centre
    report chapter section figure table version edition award prize league club team series
    """.split()
)
STREET_WORDS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Way", "Place", "Square", "Terrace")
STREETS_AHEAD = ("Calle", "Avenida", "Plaza", "Rue", "Avenue", "Boulevard", "Via")
DOMAIN_ENDS = frozenset("com org net edu gov io info biz co de fr es uk it nl eu us ca ch at be me dev app".split())
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb", "xoxp", "sk_live", "rk_live", "glpat", "eyJ", "SG.", "-----BEGIN")
#: Parts of values that stand for no real one.
DUMMIES = ("xxxx", "0000000", "1234567", "abcdef", "changeme", "your_", "your-", "example", "dummy", "none", "null", "<", "${", "...")

_ADDRESS = re.compile(
    rf"[0-9{_UPPER}](?<![\w-][0-9{_UPPER}])(?:(?<=[0-9])[0-9]{{0,4}}[A-Za-z]?,?\x20(?:[{_UPPER}]\w++\x20){{1,3}}?(?:{'|'.join(STREET_WORDS)})(?!\w)"
    rf"|(?:{'|'.join(f'(?<={w[0]}){w[1:]}' for w in STREETS_AHEAD)})\x20(?:\w++\x20){{1,4}}?[0-9]{{1,5}}(?!\w)|(?<=[{_UPPER}])\w*+(?<=straße)\x20[0-9]{{1,4}}[a-z]?(?!\w))"
)
#: (kind, pattern, group of the span, what a text must contain for the pattern to be tried)
_CANDIDATES = (
    ("credential", _CREDENTIAL, 1, ""), ("national_id", _NATIONAL, 0, "-"), ("loose_phone", _LOOSE_PHONE, 0, ""), ("person", _TITLED, 1, ""), ("person", _PERSON, 0, ""),
    ("hidden_email", _HIDDEN, 0, "dot"), ("iban", _IBAN, 0, ""), ("birth_date", _DATE, 0, ""), ("address", _ADDRESS, 0, ""), ("key", _BLOCK, 0, "-----BEGIN"), ("key", _KEY, 0, ""), ("key", _BASE64, 0, ""),
)

#: One of these is in every word that makes a credential.
_SECRET_PARTS = ("pass", "pwd", "token", "secret", "key")

LABELERS = ("shape", "proof", "entropy", "secret_words", "kind_words", "neutral_words", "names", "dummies", "plain_words")
_CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in found.group().split(".")):
            out.append((found.start(), 1, found.end()))
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = found.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((found.start(), 2, found.end()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= sum("0" <= ch <= "9" for ch in found.group()) <= 15:
                out.append((found.start(), 3, found.end()))
    return sorted(out)


def _pairs(run: re.Match) -> Iterator[tuple[int, int]]:
    """Spans in a row of capitalised words that may be a first and a last name: from each word that is a known first name; where there is none,
    and the row is no heading, its last two words."""
    words, at = [], run.start()
    for word in run.group().split(" "):
        words.append((at, at + len(word), word.lower()))
        at += len(word) + 1
    known, k = False, 0
    while k + 1 < len(words):
        if words[k][2] in FIRST_NAMES:
            yield words[k][0], words[k + 1][1]
            known, k = True, k + 1
        k += 1
    while not known and words and words[0][2] in LEADS:
        del words[0]
    if not known and 2 <= len(words) <= 3:
        yield words[-2][0], words[-1][1]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of spans that may be added; none overlaps a base span or an earlier candidate."""
    found = []
    low = text.lower() if text.isascii() else text.casefold()
    secret, slashed = any(word in low for word in _SECRET_PARTS), "/" in text or "+" in text
    for order, (kind, pattern, group, part) in enumerate(_CANDIDATES):
        if part and part not in text and part.upper() not in text:
            continue
        if (pattern is _CREDENTIAL and not secret) or (pattern is _BASE64 and not slashed):
            continue
        for m in pattern.finditer(text):
            if pattern is _KEY and not (_DIGIT.search(m.group()) or m.group().startswith(KEY_PREFIXES)):
                continue
            if pattern is _BASE64 and not (_DIGIT.search(m.group()) and re.search("[a-z]", m.group()) and re.search("[A-Z]", m.group())):
                continue
            spans = _pairs(m) if pattern is _PERSON else [m.span(group)]
            found += [(a, order, KINDS.index(kind), b) for a, b in spans]
    if not found:
        return []
    starts, reach, out, last = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max)), [], 0
    for start, _, kind, end in sorted(found):
        before = bisect_left(starts, end)
        if start >= last and not (before and reach[before - 1] > start):
            out.append((start, kind, end, code_of(text, start, end, kind)))
            last = end
    return out


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def iban_checks(value: str) -> bool:
    """Does an account number leave 1 when read as a number to base 36 and divided by 97 (ISO 13616)?"""
    plain = value.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 == 1


def _shape(name: str, value: str) -> int:
    digits = sum(ch.isdigit() for ch in value)
    if name == "credential":
        return 2 if digits and len(value) >= 8 else 1
    if name == "key":
        return 2 if re.fullmatch(r"[0-9a-f]{32,64}|[A-Z0-9]{20}|[A-Za-z0-9_-]{36,}", value) else 0
    if name == "national_id":
        return 1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" else 2
    if name == "loose_phone":
        return 1 if value.count("0") >= 8 or value.lstrip("(")[0] in "01" else 2
    if name == "hidden_email":
        return 2 if "[" in value or "(" in value else 0
    if name == "birth_date":
        numbers = [int(x) for x in re.split("[./-]", value)]
        return 2 if sum(x <= 12 for x in numbers) >= 1 and sum(x <= 31 for x in numbers) == 2 and 1900 <= max(numbers) <= 2015 else 1
    if name == "address":
        return 0
    return 2 if value.istitle() or name == "iban" else 1


def votes_of(text: str, start: int, end: int, kind: int) -> tuple[int, ...]:
    """A vote of each labeler: 2 personal, 1 not, 0 none."""
    value, before, after = text[start:end], text[max(0, start - _CONTEXT) : start].lower(), text[end : end + _CONTEXT // 2].lower()
    low, name = value.lower(), KINDS[kind]
    secret, bits = name in ("credential", "key"), _entropy(value)
    said = lambda words, where: any(w in where for w in words)
    names = 0
    if name == "person":
        first, last = low.split()[0], low.split()[-1]
        names = 1 if last in NOT_NAMES or first in NOT_NAMES else 2 if first in FIRST_NAMES else 0
    elif name == "hidden_email":
        names = 2 if re.split(r"[^a-z]+", low)[-1] in DOMAIN_ENDS else 1
    proof = 0
    if name == "iban":
        proof = 2 if iban_checks(value) else 1
    elif value.startswith(KEY_PREFIXES):
        proof = 2
    plain = 0
    if secret:
        words = re.split(r"[^A-Za-z]+", value)
        plain = 1 if all(w.islower() or w.isupper() or w.istitle() for w in words if w) and max(map(len, words)) < 12 and sum(map(len, words)) > 0.8 * len(value) - len(words) else 0
    return (
        _shape(name, value),
        proof,
        0 if not secret else 2 if bits >= 2.8 else 1 if bits < 1.5 else 0,
        2 if name == "key" and said(SECRET_WORDS, before) else 0,
        # The word that makes a credential is part of its pattern, and says nothing more.
        2 if name != "credential" and said(KIND_WORDS[name], before) else 0,
        1 if said(NEUTRAL_WORDS, before) or said(NEUTRAL_WORDS, low) or said(NEUTRAL_WORDS, after) else 0,
        names,
        1 if said(DUMMIES, low) else 0,
        plain,
    )


def code_of(text: str, start: int, end: int, kind: int) -> int:
    """Votes and shape features of a candidate as one number."""
    value = text[start:end]
    length = sum(end - start > b for b in (7, 15, 31))
    digits = sum(3 * sum(ch.isdigit() for ch in value) > b * len(value) for b in (0, 1, 2))
    code = 0
    for v in votes_of(text, start, end, kind):
        code = code * 3 + v
    return (code * 4 + length) * 4 + digits


def _decoded(code: int) -> tuple[list[int], int, int]:
    code, digits = divmod(code, 4)
    code, length = divmod(code, 4)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return votes[::-1], length, digits


def reliabilities(patterns: list[tuple[list[int], float]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over (votes, count): each pattern's chance of being personal, each labeler's accuracy.

    A labeler has a chance of each vote (none, not, personal) for either truth (Dawid and Skene, 1979), so that one that only
    ever speaks for one side tells by its silence too.
    """
    votes, weight = np.array([v for v, _ in patterns]), np.array([n for _, n in patterns], float)
    cast, yes = votes > 0, votes == 2
    shown = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    # A start from the plain majority of those that do not always say the same. Priors say that labelers are right more often
    # than not, and are as strong as 5 % of the rows; proofs (known prefixes, checksums) hardly ever err.
    tells = (np.abs(votes - votes[:1]).max(0) > 0) if len(votes) else np.zeros(votes.shape[1], bool)
    chance = 1 / (1 + np.exp(-1.4 * ((yes & tells).sum(1) - (cast & ~yes & tells).sum(1))))
    favour = np.tile(np.array([[5.0, 4.0, 1.0], [5.0, 1.0, 4.0]])[:, None, :], (1, votes.shape[1], 1))
    if votes.shape[1] == len(LABELERS):
        favour[:, LABELERS.index("proof")] = [[10.0, 20.0, 0.02], [10.0, 0.02, 20.0]]
    favour *= max(1.0, 0.005 * weight.sum())
    for _ in range(rounds):
        told = []
        for truth, prior in zip((1 - chance, chance), favour):
            n = ((weight * truth)[:, None, None] * shown).sum(0) + prior
            told.append(np.log(n / n.sum(1, keepdims=True)))
        share = np.clip(((weight * chance).sum() + 1) / (weight.sum() + 2), 0.05, 0.95)
        odds = np.log(share / (1 - share)) + (shown * (told[1] - told[0])).sum((1, 2))
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    right = (weight[:, None] * np.where(yes, chance[:, None], 1 - chance[:, None]) * cast).sum(0) + 8
    return chance, right / ((weight[:, None] * cast).sum(0) + 10)


_WIDTH = 1 + 3 * len(LABELERS) + 8


def _features(kind: int, code: int) -> np.ndarray:
    """One block for each kind: a constant, the votes, length and digits."""
    votes, length, digits = _decoded(code)
    out = np.zeros(len(KINDS) * _WIDTH)
    mine = out[kind * _WIDTH : (kind + 1) * _WIDTH]
    mine[0] = 1
    for i, v in enumerate(votes):
        mine[1 + 3 * i + v] = 1
    mine[1 + 3 * len(LABELERS) + length] = 1
    mine[-4 + digits] = 1
    return out


class SpanClassifier:
    """Logistic regression on features of candidates, trained on the estimated chances, weighted by counts."""

    def __init__(self, counts: dict[tuple[int, int], int], steps: int = 400, decay: float = 1e-3):
        keys = sorted(counts)
        target = np.zeros(len(keys))
        self.accuracy: dict[str, np.ndarray] = {}
        for kind in {k for k, _ in keys}:
            mine = [i for i, (k, _) in enumerate(keys) if k == kind]
            chance, self.accuracy[KINDS[kind]] = reliabilities([(_decoded(keys[i][1])[0], counts[keys[i]]) for i in mine])
            target[mine] = chance
        self.weights = np.zeros(len(_features(0, 0)))
        if keys:
            x = np.stack([_features(*key) for key in keys])
            n = np.array([counts[key] for key in keys], float)
            n /= n.sum()
            for _ in range(steps):
                p = 1 / (1 + np.exp(-x @ self.weights))
                slope = x.T @ (n * (p - target)) + decay * self.weights
                curve = (x * (n * p * (1 - p))[:, None]).T @ x + decay * np.eye(x.shape[1])
                step = np.linalg.solve(curve, slope)
                self.weights -= step
                if np.abs(step).max() < 1e-9:
                    break

    def accepts(self, kind: int, code: int) -> bool:
        if KINDS[kind] == "person" and 2 not in _decoded(code)[0][1:]:
            return False  # two capitalised words, and nothing that speaks for a name
        return float(_features(kind, code) @ self.weights) > 0


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<int>, more array<int>"
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans as flat (start, kind, end), candidates as flat (start, kind, end, code)."""
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        digests, base_lists, more_lists = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            for kind in range(4):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            base_lists.append([x for span in base for x in span])
            more_lists.append([x for span in candidates(text, base) for x in span])
        ints = pa.list_(pa.int32())
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(base_lists, ints), pa.array(more_lists, ints)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "more"])


def trained(found: DataFrame) -> SpanClassifier:
    """The span classifier from the candidates of all documents."""
    flat = found.where("size(more) > 0").select("more", F.explode(F.expr("sequence(0, size(more) div 4 - 1)")).alias("i"))
    flat = flat.select(F.expr("more[4 * i + 1]").alias("kind"), F.expr("more[4 * i + 3]").alias("code"))
    # At most len(ADDED_KINDS) * 3^len(LABELERS) * 16 patterns exist, a few hundred in practice.
    return SpanClassifier({(r.kind, r.code): r.n for r in flat.groupBy("kind", "code").agg(F.count("*").alias("n")).collect()})


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each row of docs. Texts are read once and not shuffled."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(texts.mapInArrow(_search, _FOUND), "pii")
    judge = trained(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], bool] = {}
        for batch in batches:
            spans, added = [], []
            for base, more in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                kept = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
                n = len(kept)
                for i in range(0, len(more), 4):
                    start, kind, end, code = more[i : i + 4]
                    if (kind, code) not in known:
                        known[kind, code] = judge.accepts(kind, code)
                    if known[kind, code]:
                        kept.append((start, kind, end))
                spans.append(_joined(kept))
                added.append(len(kept) - n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=[*batch.schema.names[:6], "spans", "n_added"])

    return found.mapInArrow(decide, SCHEMA)
