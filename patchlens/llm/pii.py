"""Personal data: fixed detectors, and a semi-Markov conditional random field that adds spans.

Base spans (email, ip, card, phone) come from four patterns, leftmost and without overlap within a kind, then checked (parts of
an address, digits and Luhn sum of a card, digits of a phone number). The field adds spans of the same kinds, of ``secret``
(keys, tokens, passwords), ``ssn`` and ``iban`` where no base span is.

The field. A line's words (runs without white space) that hold a digit or an ``@``, or that follow a credential's name and a
``:`` or ``=``, form runs (and the letters of an iban's second group); only there can an entity be. A run's tokens are letter-digit runs and single signs. A segmentation
labels stretches of at most ``MAX_TOKENS`` tokens with a kind and leaves the other tokens outside, at score 0. What a kind
must be is a condition (``possible``): an email has an ``@`` and a dotted domain, an address four parts up to 255 or groups of
hexadecimal digits, a card 13 to 19 digits, an iban its check sum, a secret no space. Among what is possible a stretch is
scored as a whole: its shape, length, digits, Luhn sum, letter-digit changes, and the words before it. Stretches begin at a
word, or behind a sign like ``=`` or a quote, and end likewise. Dynamic programming over token positions finds the best
segmentation of each run, boundaries and kinds at once. Weights are fitted on the driver by the gradient of the conditional
log-likelihood (forward-backward over segments), on sentences made from templates with a fixed seed; nothing is learnt from
the documents. Of segmentations of one score the one with fewer, later stretches is taken.

Texts are whole; work is within the task, row by row. Null texts count as empty: no spans. Repeated rows each get their row;
other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban")
MAX_TOKENS = 16

# A match can only begin where these look-behinds hold, so they change no result; they keep long runs linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, looking only around each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the field -------------------------------------------------------------------------------------------------------

CREDENTIAL = r"(?:passw(?:or)?d|passwort|passphrase|pwd|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|contraseña|mot de passe)"
HOLDER = re.compile(rf"[A-Z]{{2}}[0-9]{{2}} [A-Z]{{4}}(?= [0-9])|[0-9@]|(?i:(?<![^\W_]){CREDENTIAL}[\"']?[ ]?[=:][ ]?[\"']?[^\s\"'=:])")
NAMED = re.compile(rf"(?i:{CREDENTIAL}[\"']?[=:])")
WORDS = re.compile(r"\S+")
TOKEN = re.compile(r"[^\W_]+|[^\s]")
OPENING, CLOSING = set("=:\"'([{<,;|/`"), set("\"')]}>,;|.!?`#*%&$")
CUES = {
    "cred": "password passwd passphrase pwd pass token secret key apikey api_key auth credential credentials bearer authorization passwort contraseña clave motdepasse passe",
    "tel": "tel phone call fax mobile cell telefon teléfono téléphone telephone whatsapp",
    "mail": "mail email contact write e-mail correo",
    "net": "ip host server address from addr ping gateway dns",
    "card": "card visa mastercard amex kreditkarte karte tarjeta carte credit",
    "bank": "iban account konto cuenta compte bank",
    "social": "ssn social security",
    "hash": "commit md5 sha sha1 sha256 checksum hash revision rev etag uuid id digest blob",
    "number": "version section page chapter no figure year isbn part vol number order invoice row line article",
}
CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}
MAIL_FORM = re.compile(r"[^\W_][\w.+%-]*@[^\W_]+(?:[.-][^\W_]+)*\.[^\W\d_]{2,}")
QUAD_FORM = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
GROUPS_FORM = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}")
CARD_FORM = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}")
PHONE_FORM = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}")
SECRET_FORM = re.compile(r"[^\s\"'<>|]{8,}")
SSN_FORM = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
IBAN_FORM = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


def _iban(span: str) -> bool:
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def possible(span: str, cue: str) -> list[int]:
    """The kinds (by place) that a stretch may have."""
    out = []
    if "@" in span and MAIL_FORM.fullmatch(span):
        out.append(0)
    if QUAD_FORM.fullmatch(span) and all(int(p) <= 255 for p in span.split(".")) or ":" in span and GROUPS_FORM.fullmatch(span):
        out.append(1)
    if CARD_FORM.fullmatch(span) and len(set(span) - {" ", "-"}) > 1:
        out.append(2)
    if PHONE_FORM.fullmatch(span):
        out.append(3)
    kinds = any(map(str.isalpha, span)) + any(map(str.isdigit, span))
    if 0 not in out and kinds and (kinds == 2 or cue == "cred") and SECRET_FORM.fullmatch(span) and not NAMED.search(span):
        out.append(4)
    if SSN_FORM.fullmatch(span):
        out.append(5)
    if IBAN_FORM.fullmatch(span) and _iban(span):
        out.append(6)
    return out


def runs_of(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words that each hold a digit or an @ or follow a credential's name, one plain space between them."""
    start = end = -1
    at = 0
    while m := HOLDER.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        b = WORDS.match(text, m.end() - 1).end()
        if end >= 0 and a == end + 1 and text[end] == " ":
            end = b
        else:
            if end >= 0:
                yield start, end
            start, end = a, b
        at = b
    if end >= 0:
        yield start, end


def _shape(text: str) -> str:
    out = []
    for c in text:
        kind = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:24])


def features(text: str, start: int, end: int, cue: str) -> list[str]:
    """Names of what holds for the stretch as a whole."""
    span = text[start:end]
    digits = DIGITS.sub("", span)
    letters = sum(c.isalpha() for c in span)
    before, after = text[start - 1 : start], text[end : end + 1]
    found = ["bias", f"len={min(len(span) // 4, 12)}", f"digits={min(len(digits), 20)}", f"cue={cue}", f"cut={before.isalnum() or after.isalnum()}", f"assigned={before in OPENING and before != ''},{cue}"]
    signs = "".join(sorted({c for c in span if not c.isalnum()}))
    found += [f"signs={signs[:8]}", f"before={before}", f"after={after if not after.isalnum() else 'a'}"]
    if len(span) <= 40:
        found.append(f"shape={_shape(span)}")
    if span[:1] == "+" or span[:1] == "(":
        found.append(f"plus={span[0]}{10 <= len(digits) <= 15}")
    if not letters and len(digits) >= 10:
        found.append(f"luhn={13 <= len(digits) <= 19 and luhn(digits)}")
    if not letters:
        found += [f"groups={'-'.join(str(min(len(g), 9)) for g in re.split('[^0-9]+', span) if g)[:20]}", f"bare={span.isdigit()},{cue}"]
    if letters:
        head = re.match(r"[A-Za-z]{2,5}(?=[0-9_-])|[A-Z]{4}", span)
        found += [f"head={head[0] if head else ''}", f"path={'/' in span or '://' in span},{cue}", f"words={bool(re.fullmatch('[^0-9]+[0-9]{1,4}', span))},{cue}"]
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        cases = sum(c.isupper() for c in span[1:]) > 1 and sum(c.islower() for c in span) > 1
        varied = len(set(span)) / len(span)
        found += [f"changes={min(changes // 2, 6)}", f"mixed={len(span) >= 16},{changes >= 4},{varied > 0.3}", f"cases={cases},{len(span) >= 16},{len(digits) > 0}", f"hex={all(c in '0123456789abcdefABCDEF' for c in span)},{len(span) >= 16},{cue}", f"upper={span.upper() == span}"]
    return found


def lattice(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int], list[str]]]]:
    """(tokens' spans, stretches as (first token, token behind the last, kinds that are possible, features)) of a run."""
    tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
    begins = [a == start or text[a - 1].isspace() or text[a - 1] in OPENING for a, _ in tokens]
    ends = [b == end or text[b].isspace() or text[b] in CLOSING for _, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens):
        if not begins[i] or not (text[a].isalnum() or text[a] in "+("):
            continue
        # the last word before the stretch, unless other words end a sentence between
        names = re.findall(r"[^\W\d_]+", text[max(0, a - 32) : a].lower())
        cue = CUE_OF.get(names[-1], "none") if names else "none"
        if cue == "none" and len(names) > 1 and text[a - 1] in "=:\"' ":
            cue = CUE_OF.get(names[-2] + names[-1], "none")
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            b = tokens[j][1]
            closed = text[b - 1].isalnum() or cue == "cred" and text[b - 1] in "!$%*?#&" and (b == end or text[b].isspace() or text[b] in "\"'")
            if ends[j] and closed and (kinds := possible(text[a:b], cue)):
                out.append((i, j + 1, kinds, features(text, a, b, cue)))
    return tokens, out


Weights = dict[str, list[float]]


def scores(kinds: list[int], found: list[str], weights: Weights) -> list[float]:
    """The score of each possible kind."""
    out = [0.0] * len(kinds)
    for name in found:
        w = weights.get(name)
        if w is not None:
            for i, k in enumerate(kinds):
                out[i] += w[k]
    return out


def best_segments(n: int, stretches: list, weights: Weights) -> list[tuple[int, int, int]]:
    """(first token, token behind the last, kind) of the best segmentation of n tokens."""
    ending = defaultdict(list)
    for i, j, kinds, found in stretches:
        s = scores(kinds, found, weights)
        k = max(range(len(kinds)), key=s.__getitem__)
        if s[k] > 0:
            ending[j].append((i, kinds[k], s[k]))
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for i, k, s in ending[j]:
            if value[i] + s > value[j]:
                value[j], back[j] = value[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def _log_add(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def _gradient(n: int, stretches: list, gold: dict, weights: Weights) -> tuple[float, list[tuple[list[int], list[str], list[float]]]]:
    """Log-likelihood of a run's gold segments, and what each stretch adds to the gradient, by its possible kinds."""
    scored = [(i, j, kinds, found, scores(kinds, found, weights)) for i, j, kinds, found in stretches]
    to, frm = defaultdict(list), defaultdict(list)
    for i, j, _, _, s in scored:
        total = _log_add(s)
        to[j].append((i, total))
        frm[i].append((j, total))
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_add([alpha[j - 1], *(alpha[i] + s for i, s in to[j])])
    for i in range(n - 1, -1, -1):
        beta[i] = _log_add([beta[i + 1], *(s + beta[j] for j, s in frm[i])])
    likelihood, steps = -alpha[n], []
    for i, j, kinds, found, s in scored:
        shares = [-math.exp(alpha[i] + x + beta[j] - alpha[n]) for x in s]
        if (kind := gold.get((i, j))) in kinds:
            shares[kinds.index(kind)] += 1
            likelihood += s[kinds.index(kind)]
        steps.append((kinds, found, shares))
    return likelihood, steps


SYLLABLES = "an er sch tion el ou ci ar th le ment o ba ki ro sur de li na ter ing és ö ñu que st pre vo ha mi".split()
LETTERS, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


class Maker:
    """Makes values of kinds, things that look like them, and sentences around them."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def of(self, chars: str, n: int) -> str:
        return "".join(self.rng.choice(chars) for _ in range(n))

    def number(self, n: int) -> str:
        return self.of(DIGIT, n)

    def word(self) -> str:
        w = "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        return w.capitalize() if self.rng.random() < 0.15 else w

    def plain_word(self) -> str:
        return "".join(self.rng.choice("ban ker lo mi sun tar den ril sho pa wick".split()) for _ in range(self.rng.randint(1, 3)))

    def grouped(self, digits: str) -> str:
        sep = self.rng.choice(("", " ", "-"))
        return sep.join(re.findall(".{1,4}", digits)) if sep else digits

    def card(self) -> str:
        d = self.rng.choice("3456") + self.number(self.rng.choice((11, 13, 14, 14, 14)))
        return self.grouped(d + next(c for c in DIGIT if luhn(d + c)) if self.rng.random() < 0.8 else d + self.number(1))

    def phone(self) -> str:
        r, n = self.rng, self.number
        return r.choice((
            lambda: f"+{r.choice(('1', '34', '49', '33', '44'))} ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"+{r.choice(('1', '49', '33'))}{r.choice((' ', '-', '.'))}{n(3)}{r.choice((' ', '-', '.'))}{n(3)}{r.choice((' ', '-', '.'))}{n(4)}",
            lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"0{n(3)}/{n(7)}", lambda: f"+{n(11)}", lambda: f"0{n(2)} {n(3)} {n(4)}", lambda: f"+49 {n(3)} {n(6)}",
        ))()

    def email(self) -> str:
        r = self.rng
        local = r.choice((lambda: f"{self.plain_word()}{r.choice('._-')}{self.plain_word()}", lambda: f"{self.plain_word().capitalize()}{r.choice(('', '.'))}{self.number(2)}", lambda: f"{self.plain_word()}+{self.plain_word()}"))()
        return f"{local}@{r.choice((self.plain_word(), 'mail' + self.number(1)))}{r.choice(('.example', '', '-' + self.plain_word()))}.{r.choice(('com', 'org', 'net', 'co.uk', 'de', 'io'))}"

    def ip(self) -> str:
        if self.rng.random() < 0.7:
            return ".".join(str(self.rng.randint(0, 255)) for _ in range(4))
        groups = [self.of(HEX, self.rng.choice((1, 2, 3, 4, 4))) for _ in range(self.rng.choice((4, 8, 8)))]
        return ":".join(groups) if len(groups) == 8 else f"{groups[0]}:{groups[1]}::{groups[2]}:{groups[3]}"

    def secret(self) -> tuple[str, bool]:
        """(a key, token or password, whether it shows without a name before it)"""
        r, every = self.rng, LETTERS + LETTERS.upper() + DIGIT
        return r.choice((
            lambda: ("AKIA" + self.of(LETTERS.upper() + "234567", 16), True), lambda: (r.choice(("ghp_", "gho_", "glpat-", "npm_")) + self.of(every, r.choice((20, 36))), True),
            lambda: (r.choice(("sk-live-", "sk_test_", "pk_live_", "sk-", "rk_live_")) + self.of(every, r.choice((16, 24, 40))), True), lambda: (f"xoxb-{self.number(11)}-{self.of(every, 24)}", True),
            lambda: ("eyJ" + self.of(every, 18) + "." + self.of(every, 30) + "." + self.of(every, 22), True), lambda: ("AIza" + self.of(every, 35), True),
            lambda: (self.of(HEX, r.choice((18, 32, 40, 64))), False), lambda: (self.of(HEX, 40).upper(), False), lambda: (self.of(every, r.choice((20, 24, 36))), r.random() < 0.5), lambda: (self.of(HEX, 40), False),
            lambda: (f"{self.plain_word()}{self.number(r.choice((1, 2, 4)))}{self.plain_word()}{self.number(r.choice((1, 2)))}", False), lambda: (self.plain_word().capitalize() + "dor" + self.number(4) + r.choice("!$%*"), False),
            lambda: (f"{self.plain_word()}{self.plain_word()}{self.plain_word()}dor", False), lambda: (self.of(every + "!$%*-_", r.randint(10, 16)) + r.choice(DIGIT), False),
        ))()

    def ssn(self) -> str:
        return f"{self.rng.randint(100, 665)}-{self.rng.randint(10, 99)}-{self.rng.randint(1000, 9999)}"

    def iban(self) -> str:
        country, body = self.rng.choice((("DE", 18), ("ES", 20), ("FR", 23), ("GB", 18), ("NL", 14)))
        rest = (self.of(LETTERS.upper(), 4) + self.number(body - 4)) if country in ("GB", "NL") else self.number(body)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        plain = f"{country}{check:02d}{rest}"
        return " ".join(re.findall(".{1,4}", plain)) if self.rng.random() < 0.5 else plain

    def harmless(self) -> str:
        """Numbers, names and codes that are nobody's data."""
        r, n, w = self.rng, self.number, self.plain_word
        return r.choice((
            lambda: str(r.randint(0, 2100)), lambda: f"{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{n(2)}:{n(2)}:{n(2)}Z", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(2)}:{n(2)}:{n(2)}",
            lambda: f"${n(3)},{n(3)}.{n(2)}", lambda: f"{n(2)},{n(2)} €", lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"{n(1)}%", lambda: f"{n(2)}kg", lambda: f"{n(2)}-{n(2)}", lambda: n(r.randint(5, 12)), lambda: n(r.randint(5, 9)), lambda: f"3.{n(14)}",
            lambda: f"978-3-{n(2)}-{n(6)}-{n(1)}", lambda: f"#{n(6)}", lambda: f"INV-{n(4)}-{n(4)}", lambda: f"#{self.of(HEX, 6)}", lambda: f"{w()}{n(1)}", lambda: f"{w()}-{n(2)}", lambda: f"{w()}_{n(4)}.png", lambda: f"https://{w()}.com/{w()}/{n(3)}?{w()}={n(2)}",
            lambda: f"{w().upper()}{n(4)}", lambda: "x86_64", lambda: "utf-8", lambda: f"@{w()}", lambda: f"{w()}@{w()}", lambda: f"{r.randint(300, 900)}.{n(2)}.{n(1)}.{n(3)}", lambda: f"({n(1)})", lambda: "4.0.", lambda: f"{n(4)}/{n(2)}", lambda: f"{n(2)}.{n(4)},{n(1)}.{n(4)}",
            lambda: f"{n(3)}-{n(4)}", lambda: f"{w()}{n(2)}{w()}", lambda: f"{w()}/{w()}-{n(1)}.{n(1)}.{n(1)}.tar.gz", lambda: f"{self.of(HEX, 8)}-{self.of(HEX, 4)}-{self.of(HEX, 4)}-{self.of(HEX, 4)}-{self.of(HEX, 12)}", lambda: f"{n(1)}x{n(1)}", lambda: f"{n(2)}th",
        ))()

    def value(self, kind: str) -> tuple[str, str]:
        """(what stands before a value, the value)"""
        r = self.rng
        if kind == "secret":
            value, shows = self.secret()
            lead = r.choice(("password=", "password: ", "token = ", 'token = "', "api_key: ", "secret=", "key ", 'pwd="', "Authorization: Bearer ", "passwd ", "API key: ", "client_secret='", "access token ", '"token": "', "TOKEN = \"", "pass: "))
            if re.fullmatch(r"[^0-9]+", value):  # letters only: behind a name and a sign
                lead = r.choice(("password=", "password: ", "secret=", 'pwd="', "passwd=", "passphrase: "))
            return ("" if shows and r.random() < 0.5 else lead), value
        leads = {"email": ("mail: ", "contact ", "<", "e-mail "), "ip": ("host ", "server ", "from "), "card": ("card ", "visa: ", "card no. "), "phone": ("tel ", "call ", "phone: ", "Tel.: ", "fax "), "ssn": ("SSN ", "ssn: ", "social security "), "iban": ("IBAN ", "iban: ", "account ")}[kind]
        return (r.choice(leads) if r.random() < 0.35 else ""), getattr(self, kind)()

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        """(text, the spans in it)"""
        r, text, spans = self.rng, "", []
        after = r.choice((" ", " ", " ", "!! ", "### ", " | "))
        for _ in range(r.randint(1, 3)):
            text += " ".join(self.word() for _ in range(r.randint(1, 4))) + r.choice((" ", " ", " ", ". ", ": "))
            if r.random() < 0.5:
                name = r.choice(("", "", "", "version ", "section ", "page ", "commit ", "sha1 ", "order ", "no. ", "ISBN "))
                text += name + (self.of(HEX, r.choice((8, 32, 40))) if name in ("commit ", "sha1 ") else self.harmless()) + r.choice((" ", ". ", ", "))
                continue
            kind = r.choice(KINDS)
            lead, value = self.value(kind)
            text += lead
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + {'"': '"', "'": "'", "<": ">"}.get(lead[-1:], "") + r.choice((" ", " ", ". ", ", ", after))
        return text + self.word(), spans


def _examples(rng: random.Random, n: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences from templates, with the spans in them."""
    maker = Maker(rng)
    for _ in range(n):
        yield maker.sentence()


@cache
def trained(seed: int = 5, sentences: int = 1500, rounds: int = 6, penalty: float = 1e-3) -> Weights:
    """Weights by stochastic gradient ascent with adaptive steps; the same for the same arguments."""
    rng = random.Random(seed)
    runs = []
    for text, spans in _examples(rng, sentences):
        for a, b in runs_of(text):
            tokens, stretches = lattice(text, a, b)
            first, last = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            gold = {(first[s], last[e]): KINDS.index(k) for k, s, e in spans if s in first and e in last and a <= s < b}
            if stretches:
                runs.append((len(tokens), stretches, gold))
    weights: Weights = defaultdict(lambda: [0.0] * len(KINDS))
    squares: Weights = defaultdict(lambda: [1e-6] * len(KINDS))
    for _ in range(rounds):
        rng.shuffle(runs)
        for n, stretches, gold in runs:
            for kinds, found, shares in _gradient(n, stretches, gold, weights)[1]:
                if max(map(abs, shares)) < 1e-4:
                    continue
                for name in found:
                    w, q = weights[name], squares[name]
                    for k, g in zip(kinds, shares, strict=True):
                        g -= penalty * w[k]
                        q[k] += g * g
                        w[k] += 0.3 * g / math.sqrt(q[k])
    return dict(weights)


def added_spans(text: str, base: list[tuple[str, int, int]], weights: Weights) -> list[tuple[str, int, int]]:
    """The field's spans that overlap no base span."""
    starts = [s for _, s, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # base spans are in the order of their starts
    out = []
    for a, b in runs_of(text):
        tokens, stretches = lattice(text, a, b)
        for i, j, k in best_segments(len(tokens), stretches, weights):
            start, end = tokens[i][0], tokens[j - 1][1]
            before = bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                out.append((KINDS[k], start, end))
    return out


def all_spans(text: str | None, weights: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text or "")
    more = added_spans(text or "", base, weights)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row. The weights (some hundred names) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(trained() if weights is None else weights)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [all_spans(t, shared.value) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
                digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([written(x) for _, x in found], pa.string())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    slim = docs.select(id_col, text_col)
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
