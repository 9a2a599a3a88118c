"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without
overlap per kind; a match that fails its check is dropped and not tried again.
Further kinds need a checksum or a context word: bank accounts (IBAN, mod 97;
they end at a word's end, as long as their country has them), cards of 13 to 15 digits (Luhn), local phone numbers and national numbers.
Secrets are kinds, too: private-key blocks, keys of a known prefix and length,
tokens that carry a checksum (CRC-32 in base 62) or are signed (two JSON parts),
and values after a word such as `token` or `password`, if they look random.

Scores: a kind's own value, plus CONTEXT_GAIN if one of its words stands within
CONTEXT characters before or after, minus CONTEXT_LOSS if a word of NEGATIVE
does. Further kinds are kept from MIN_SCORE on; base kinds always are.

Defined results: null is empty text and has no spans; offsets are code points,
end exclusive; equal texts get equal spans; texts are read whole, in time
linear in their length; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, quoted

#: The local part and the domain of the email pattern; it is tried where a run of local characters begins.
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]++@", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE = re.compile(LOCAL + DOMAIN)
EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])" + LOCAL + DOMAIN)
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account by country; other codes may have 15 to 34.
IBAN_LENGTH = {c: int(n) for n, codes in (part.split(":") for part in (
    "15:NO|16:BE|18:DK FI FO GL NL|19:MK SI|20:AT BA EE KZ LT LU XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ TL|"
    "24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:FR GR IT MC MR SM|28:AL AZ BY CY DO GT HU LB PL SV|29:BR EG PS QA UA|"
    "30:JO KW MU|31:MT SC|32:LC").split("|")) for c in codes.split()}
LOCAL_PHONE = re.compile(r"(?<![0-9+.A-Za-z-])(?:\(0?[0-9]{2,4}\) ?|0?[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z-])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

PRIVATE_KEY = re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY((?: BLOCK)?)-----(?:[A-Za-z0-9+/=\s:,.()]|-(?!-)){1,16384}+-----END \1PRIVATE KEY\2-----")
#: Public prefixes of keys, with what follows them.
API_KEY = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|xox[abprs]-[0-9A-Za-z-]{10,72}|[sr]k_(?:live|test)_[0-9A-Za-z]{24,99}|"
                     r"sk-(?:[a-z]{1,8}-)?[0-9A-Za-z_-]{32,180}|SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}|npm_[0-9A-Za-z]{36}|hf_[0-9A-Za-z]{34})(?![0-9A-Za-z])")
CHECKED_TOKEN = re.compile(r"(?<![A-Za-z0-9])gh[opsur]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
SIGNED_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,4000})\.(eyJ[A-Za-z0-9_-]{8,8000})\.[A-Za-z0-9_-]{16,2000}(?![A-Za-z0-9_-])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Names before a secret, without which its pattern is not tried.
SECRET_NAMES = ("token", "secret", "api_key", "api-key", "apikey", "api key", "access_key", "access-key", "access key", "auth_key", "private_key", "credential", "bearer")
PASSWORD_NAMES = ("password", "passwd", "pwd", "passphrase", "passwort", "kennwort", "contraseña", "mot de passe")
SECRET = re.compile(rf"(?<![a-z])(?:{'|'.join(SECRET_NAMES)})s?[\"'`]?\s{{0,3}}(?:=>|[:=])?\s{{0,3}}[\"'`]?([A-Za-z0-9+/_.=-]{{16,512}})(?![A-Za-z0-9+/_.=-])", re.I)
PASSWORD = re.compile(rf"(?<![a-z])(?:{'|'.join(PASSWORD_NAMES)})[\"'`]?\s{{0,3}}(?:=>|[:=])\s{{0,3}}[\"'`]?([^\s\"'`<>]{{6,128}})", re.I)
#: Bits a character of a random value at least, and classes of characters of a password.
RANDOM_BITS, CLASSES = 3.0, 2

CONTEXT, CONTEXT_GAIN, CONTEXT_LOSS, MIN_SCORE = 40, 0.35, 0.4, 0.6
#: Words that speak for a kind, and words that speak against all.
WORDS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "diners", "credit", "karte", "carte", "tarjeta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "national_id": ("ssn", "social security"),
    "private_key": ("key", "pem", "ssh"),
    "api_key": ("key", "token", "secret"),
    "checked_token": ("token", "auth"),
    "signed_token": ("token", "jwt", "bearer", "authorization"),
    "secret": SECRET_NAMES,
    "password": PASSWORD_NAMES,
}
NEGATIVE = ("version", "isbn", "order number", "build", "example")
BASE = ("email", "ip", "card", "phone")
#: What a confirmed match is worth without context.
WORTH = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "account": 0.9, "short_card": 0.3, "local_phone": 0.3, "national_id": 0.4,
         "private_key": 1.0, "api_key": 1.0, "checked_token": 1.0, "signed_token": 1.0, "secret": 0.65, "password": 0.65}
KINDS = tuple(WORTH)
SECRETS = ("private_key", "api_key", "checked_token", "signed_token", "secret", "password")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := EMAIL_HERE.match(text, at) or EMAIL_NEXT.search(text, at):
        yield m.span()
        at = m.end()


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Of a match, the longest part up to a word's end that is an account; without one, the search goes on after its first four characters."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 4
        for end in (m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")):
            account = text[m.start() : end].replace(" ", "")
            if 15 <= len(account) <= 34 and IBAN_LENGTH.get(account[:2], len(account)) == len(account) and mod97(account):
                yield m.start(), end
                at = end
                break


def random_bits(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def checksum62(body: str) -> str:
    """CRC-32 of `body` as six digits of base 62."""
    crc, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        out = BASE62[d] + out
    return out


def _json(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def secrets(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of keys, tokens and passwords; of a named value the value."""
    if "PRIVATE KEY" in text:
        for m in PRIVATE_KEY.finditer(text):
            yield "private_key", *m.span()
    for m in API_KEY.finditer(text):
        yield "api_key", *m.span()
    if "gh" in text:
        for m in CHECKED_TOKEN.finditer(text):
            if checksum62(m[1]) == m[2]:
                yield "checked_token", *m.span()
    if "eyJ" in text:
        for m in SIGNED_TOKEN.finditer(text):
            if _json(m[1]) and _json(m[2]):
                yield "signed_token", *m.span()
    low = text.lower()
    if any(n in low for n in SECRET_NAMES):
        for m in SECRET.finditer(text):
            if random_bits(m[1]) >= RANDOM_BITS and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                yield "secret", *m.span(1)
    if any(n in low for n in PASSWORD_NAMES):
        for m in PASSWORD.finditer(text):
            if sum(bool(re.search(c, m[1])) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9.,;:)]")) >= CLASSES:
                yield "password", *m.span(1)


def _digits(m: re.Match) -> str:
    return re.sub("[^0-9]", "", m[0])


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every confirmed match. Texts without an `@` or a digit skip the patterns that need them."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    yield from secrets(text)
    if not re.search("[0-9]", text):
        return
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = _digits(m)
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card" if len(digits) >= 16 else "short_card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m)) <= 15:
                yield "phone", *m.span()
    for a, b in _accounts(text):
        yield "account", a, b
    for kind, pattern in (("local_phone", LOCAL_PHONE), ("national_id", NATIONAL)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


_WORD_PATTERN = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)") for k, w in {**WORDS, "": NEGATIVE}.items()}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT) : start] + "\0" + text[end : end + CONTEXT]).lower()
    value = WORTH[kind] + CONTEXT_GAIN * bool(_WORD_PATTERN[kind].search(near)) - CONTEXT_LOSS * bool(_WORD_PATTERN[""].search(near))
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind in the order of KINDS, then by start.

    A further span that overlaps a base one is left out: the base one covers it.
    A secret stays, as a base span inside it does not hide the rest, but not a
    `secret` or `password` inside a key or token.
    """
    text = text or ""
    spans = [(k, a, b, score(text, k, a, b)) for k, a, b in proposed(text)]
    base = sorted((a, b) for k, a, b, _ in spans if k in BASE)
    kept = [s for s in spans if s[0] in BASE]
    at = 0
    for s in sorted((s for s in spans if s[0] not in BASE and s[3] >= MIN_SCORE), key=lambda s: s[1]):
        while at < len(base) and base[at][1] <= s[1]:
            at += 1
        if s[0] in SECRETS and not (s[0] in SECRETS[-2:] and any(k in SECRETS[:-2] and a < s[2] and s[1] < b for k, a, b, _ in spans)):
            kept.append(s)
        elif s[0] not in SECRETS and (at == len(base) or base[at][0] >= s[2]):
            kept.append(s)
    return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1]))


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `spans`, an array of (kind, start, end, score), for every row of `docs`."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], [key, "spans"])

    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(
        run, f"{quoted(key)} {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(spans: list[tuple]) -> str:
    """What the query hashes: kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
