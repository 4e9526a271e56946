"""Format-preserving pseudonyms for personal numbers, dates and addresses by a keyed Feistel permutation.

What a pattern finds is first validated (check digits, calendar, octets), then permuted within its own format under the key: a card number
becomes another of its length with a right check digit, a date another date of the same notation and widths, an e-mail address one of the same shape.
Being permutations, equal values get equal pseudonyms in all documents, and no two values of a format share one; in small formats a
value may stand for itself. Telephone numbers are equal if their digits are, letters of addresses whatever their case. Letters of an address beyond a to z become such
letters, the one case in which two values may share a pseudonym. The last label of a host stays. What does not validate stays as it is.

Results for odd rows: a null text stays null with no finds; a very long text is searched whole; rows with the same or a null doc_id are treated one by one; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, map_batches

KINDS = ("email", "card", "phone", "ip", "ip6", "ssn", "iban", "date", "secret")


class Feistel:
    """A keyed permutation of the whole numbers below any bound."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _network(self, x: int, half: int, tweak: bytes) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for i in range(self.rounds):
            f = blake2b(b.to_bytes((half + 7) // 8, "big"), key=self.key, salt=i.to_bytes(2, "big"), person=tweak, digest_size=max(1, min(64, (half + 7) // 8))).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        return a << half | b

    def permute(self, x: int, size: int, tweak: str = "") -> int:
        """Cycle walking: the network is applied until the result is below size. The tweak keeps formats apart."""
        if size <= 1:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        t = blake2b(f"{tweak}/{size}".encode(), digest_size=16).digest()
        y = self._network(x, half, t)
        while y >= size:
            y = self._network(y, half, t)
        return y


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: The formats looked for. One of each alternative's forms; white space and punctuation stay as found.
FORMATS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![\w(+-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w.+-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<=[\"'=: ])[0-9a-f]{32,128}(?![0-9A-Za-z])",
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS.items()))
#: All values hold one of these, and none is longer than LONGEST (an address of 64 characters, eight labels of 64 and a last one of 24; the others are far
#: shorter), so looking LONGEST characters and a few more around each finds all that looking everywhere would.
HINT = re.compile("[@0-9:]|[a-f]{32}").search
LONGEST = 64 + 1 + 8 * 64 + 24
NEAR = LONGEST + 8
#: The countries' codes of one and of two digits; all others have three.
CODES_1, CODES_2 = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
SECRET_NAME = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)\W{0,6}$")
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


class Pseudonyms:
    def __init__(self, key: str, memo: int = 100_000):
        self.feistel = Feistel(blake2b(key.encode(), digest_size=32).digest())
        self.memo = Memo(lambda found: getattr(self, "_" + found[0])(found[1]), memo)

    # each gives the pseudonym, or None where the value does not validate

    def _number(self, digits: str, tweak: str) -> str:
        return f"{self.feistel.permute(int(digits), 10 ** len(digits), tweak):0{len(digits)}d}"

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def _card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
            return None
        body = digits[0] + self._number(digits[1:-1], "card" + digits[0])  # the first digit tells the kind of card
        return self._fill(found, body + next(c for c in "0123456789" if luhn(body + c)))

    def _phone(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not 9 <= len(digits) <= 15:
            return None
        country = 0 if found[0] != "+" else 1 if digits[0] in CODES_1 else 2 if digits[:2] in CODES_2 else 3
        return self._fill(found, digits[:country] + self._number(digits[country:], "phone" + digits[:country]))

    def _ip(self, found: str) -> str | None:
        octets = [int(x) for x in found.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
            return None
        y = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        return ".".join(map(str, y.to_bytes(4, "big")))

    def _ssn(self, found: str) -> str | None:
        a, b, c = map(int, found.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        y = self.feistel.permute((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, "ssn")
        y, c = divmod(y, 9999)
        a, b = divmod(y, 99)
        return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"

    def _iban(self, found: str) -> str | None:
        s = found.replace(" ", "")
        if not 15 <= len(s) <= 34 or not iban_ok(s):
            return None
        x, size, parts = 0, 1, []
        for c in s[4:]:
            base = 10 if c.isdigit() else 26
            x, size = x * base + (int(c) if c.isdigit() else ord(c) - 65), size * base
        y = self.feistel.permute(x, size, "iban" + s[:2])
        for c in reversed(s[4:]):
            y, d = divmod(y, 10 if c.isdigit() else 26)
            parts.append(str(d) if c.isdigit() else chr(65 + d))
        body = "".join(reversed(parts))
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        it = iter(s[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in found)

    def _date(self, found: str) -> str | None:
        sep = re.search(r"\D", found)[0]
        parts = found.split(sep)
        try:
            if len(parts[0]) == 4:
                order, day = "ymd", date(*map(int, parts))
            elif sep == "." or int(parts[0]) > 12:
                order, day = "dmy", date(int(parts[2]), int(parts[1]), int(parts[0]))
            else:
                order, day = "mdy", date(int(parts[2]), int(parts[0]), int(parts[1]))
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None
        # permuted among the dates that have these widths; day-first dates with strokes stay recognisable as such, after the twelfth
        days = _days(len(parts[order.index("m")]), len(parts[order.index("d")]), order == "dmy" and sep == "/")
        at = bisect_left(days, day.toordinal())
        if at == len(days) or days[at] != day.toordinal():  # a width that the date does not have
            return None
        new = date.fromordinal(days[self.feistel.permute(at, len(days), f"date{order}{sep}")])
        widths = dict(zip(order, map(len, parts)))
        values = {"y": new.year, "m": new.month, "d": new.day}
        return sep.join(f"{values[c]:0{widths[c]}d}" for c in order)

    def _email(self, found: str) -> str | None:
        local, _, host = found.rpartition("@")
        labels = host.split(".")
        if ".." in local or local[0] == "." or local[-1] == ".":
            return None
        return f"{self._letters(local, 'local')}@{'.'.join([*(self._letters(x, 'label') for x in labels[:-1]), labels[-1]])}"

    def _ip6(self, found: str) -> str | None:
        try:
            ip_address(found)
        except ValueError:
            return None
        digits = found.replace(":", "").lower()
        new = f"{self.feistel.permute(int(digits, 16), 16 ** len(digits), f'ip6{[len(x) for x in found.split(chr(58))]}'):0{len(digits)}x}"
        it = iter(new.upper() if found != found.lower() else new)
        return "".join(c if c == ":" else next(it) for c in found)

    def _secret(self, found: str) -> str | None:
        return f"{self.feistel.permute(int(found, 16), 16 ** len(found), 'secret'):0{len(found)}x}"

    def _letters(self, s: str, tweak: str) -> str:
        """Letters stay letters, each place of its case; digits stay digits, all else stays."""
        small, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
        plain = [c.lower() if "A" <= c <= "Z" else c for c in s]
        kinds = [digit if c in digit else small if c.isalpha() else c for c in plain]
        other = "".join(c for c in plain if c.isalpha() and c not in small)
        x, size = 0, 1
        for c, kind in zip(plain, kinds):
            x, size = x * len(kind) + (kind.index(c) if c in kind else ord(c) % len(kind)), size * len(kind)
        y, out = self.feistel.permute(x, size, f"{tweak}{''.join(k[0] for k in kinds)}{other}"), []
        for c, kind in zip(reversed(s), reversed(kinds)):
            y, d = divmod(y, len(kind))
            out.append(kind[d].upper() if c.isupper() else kind[d])
        return "".join(reversed(out))

    @staticmethod
    def _candidates(text: str):
        """The patterns' matches, sought in the stretches of text within NEAR characters of a hint."""
        hint, done = HINT(text), 0
        while hint:
            begin = max(done, hint.start() - NEAR)
            end = hint.end()
            while (hint := HINT(text, end)) and hint.start() <= end + 2 * NEAR:
                end = hint.end()
            done = min(len(text), end + NEAR)
            yield from FINDER.finditer(text, begin, done)

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and the number of values replaced of each kind."""
        found: dict[str, int] = {}
        out, at = [], 0
        for m in self._candidates(text):
            kind, value = m.lastgroup, m[0]
            if kind == "secret" and not SECRET_NAME.search(text, max(0, m.start() - 24), m.start()):
                continue
            new = self.memo[kind, value]
            if new is not None:
                out += [text[at : m.start()], new]
                at = m.end()
                found[kind] = found.get(kind, 0) + 1
        return ("".join(out) + text[at:] if out else text), found


@lru_cache(maxsize=16)
def _days(month: int, day: int, late: bool) -> list[int]:
    """The days, as ordinals, that can be written with so many digits for month and day: all have two, those below ten may have one."""
    fits = lambda n, width: width == 2 or n < 10
    every = (FIRST + timedelta(i) for i in range((LAST - FIRST).days + 1))
    return [d.toordinal() for d in every if fits(d.month, month) and fits(d.day, day) and not (late and d.day <= 12)]


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_found and the number of each kind for each row. Who has the key can invert the pseudonyms."""
    if not key:
        raise ValueError("pseudonyms need a key")

    def make():
        names = Pseudonyms(key)

        def step(c: dict[str, list]) -> dict[str, object]:
            done = [(None, {}) if t is None else names.apply(t) for t in c["text"]]
            out = {"doc_id": c["doc_id"], "text": pa.array([t for t, _ in done], pa.string()), "n_found": [sum(f.values()) for _, f in done]}
            return out | {f"n_{k}": [f.get(k, 0) for _, f in done] for k in KINDS}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS))
