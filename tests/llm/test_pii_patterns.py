"""Patterns that begin with a character and look back over it find what their plain forms find."""

import random
import re

from syntaxframe.llm import pii

U = pii._UPPER
PLAIN = {
    "_IP": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "_CARD": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    "_NATIONAL": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "_LOOSE_PHONE": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "_TITLED": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sra|Mme)\.?\x20(\w\w++\x20\w\w++)"),
    "_PERSON": re.compile(rf"(?<![\w-]){pii._NAME}(?:\x20{pii._NAME}(?:-{pii._NAME})?)++"),
    "_IBAN": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "_DATE": re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-]?[0-9])"),
    "_ADDRESS": re.compile(
        rf"(?<![\w-])[0-9]{{1,5}}[A-Za-z]?,?\x20(?:[{U}]\w++\x20){{1,3}}?(?:{'|'.join(pii.STREET_WORDS)})(?!\w)"
        rf"|(?<![\w-])(?:{'|'.join(pii.STREETS_AHEAD)})\x20(?:\w++\x20){{1,4}}?[0-9]{{1,5}}(?!\w)|(?<![\w-])[{U}]\w*+(?<=straße)\x20[0-9]{{1,4}}[a-z]?(?!\w)"
    ),
}
PARTS = (
    "1 12 555 1999 2001-02-03 3/4/1987 03.04.2011 123-45-6789 (555) 555-123-4567 1.2.3.4 4111 1111-1111 + - . / ( ) , _ a x é Mr Mrs. Ms Mme Dr Prof. Herr Frau Sra Anna Maria "
    "Ödön Smith-Jones McX DE89 GB82 WEST 1234 5678 Main Oak Street St Calle Rue Avenue Hauptstraße de la password TOKEN ſecret: apiKey= key"
).split()


def test_patterns_find_what_their_plain_forms_find():
    rng, found = random.Random(5), dict.fromkeys(PLAIN, 0)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) + rng.choice((" ", " ", " ", "", "-", "\n")) for _ in range(rng.randrange(12)))
        for name, plain in PLAIN.items():
            want = [(m.span(), m.groups()) for m in plain.finditer(text)]
            assert [(m.span(), m.groups()) for m in getattr(pii, name).finditer(text)] == want, (name, text)
            found[name] += len(want)
    assert min(found.values()) > 20, found


def test_patterns_skip_to_characters_that_can_begin_them():
    """The engine skips ahead only if a pattern begins with a character."""
    for name in PLAIN:
        assert not getattr(pii, name).pattern.startswith("(?<"), name


def test_texts_without_words_of_credentials_need_no_search():
    for word in ("password", "Passwd", "PWD", "passphrase", "toKen", "ſecret", "api_Key", "access-key", "privateKey"):
        assert [k for _, k, _, _ in pii.candidates(f"the {word}: abc1x9z2", [])] == [pii.KINDS.index("credential")], word
