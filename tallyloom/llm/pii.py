"""PII surrogates (operator 2), with DataFrame functions only.

Detected: e-mail addresses; secrets after a key word (quoted, or unquoted with a digit) and keys of well-known forms; phone numbers,
international and in common local forms; payment card numbers, IBANs, IPv4 and IPv6 addresses, social security numbers; person
names after an honorific, or made of a known given name and a surname. Each entity gets a keyed surrogate of its own type: alphabets of one script,
case and kind (vowels, consonants, digits, hexadecimal digits; letters of any other script among themselves) permute, so script, case,
length and separators stay; card numbers keep their Luhn remainder and IBANs their check; private IPv4 addresses stay private, public ones public;
given names change within the list of their gender and script, honorifics stay.

The replacement is a keyed permutation of the strings of one form: a Feistel network h over the two halves of the string, and
h(next(h^-1(x))) as the surrogate, where next moves one letter on. A permutation never sends two entities to one, and
this one leaves none as it is; equal entities in any document get equal surrogates, and those that differ in case get surrogates that differ
in case. An entity without any letter or digit that has an alphabet gets letters from a keyed digest instead. collisions() checks all
entities of the rows at hand; should two surrogates meet, all are made again with a further key. A surrogate may by chance
be the text of another entity, which is itself replaced wherever it stands. Names that neither follow an honorific nor begin with a listed given
name are not found: there is no model of names here.

A text is searched once: its entities are marked, the text is cut at the marks and kept so in shared storage, and both the check
and the new text are made from the pieces.

Defined results: null text stays null, with no entities; empty text stays empty; text without entities stays byte by byte;
repeated rows are repeated; an empty table gives an empty table; input columns named n_entities are replaced, all others kept; a
surrogate is not sought again in the output.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import Workspace

# Given names by gender and script, and honorifics.
GIVEN = {
    "female latin": "Alice Anna Barbara Carmen Charlotte Clara Elena Elizabeth Emma Eva Hanna Ines Julia Katharina Laura Linda Lucia Maria Marie Mary Patricia Sofia Sophie Susan",
    "male latin": "Alexander Antonio Carlos Charles Daniel David Felix Hans James Jean John Jose Karl Louis Lukas Manuel Michael Miguel Paul Peter Pierre Robert Thomas William",
    "female cyrillic": "Анна Елена Екатерина Ирина Мария Наталья Ольга Светлана Татьяна Юлия",
    "male cyrillic": "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий",
    "female greek": "Άννα Ελένη Κατερίνα Μαρία Σοφία",
    "male greek": "Γιάννης Γιώργος Δημήτρης Κώστας Νίκος",
}
HONORIFICS = "Mr Mrs Ms Miss Mx Dr Prof Herr Frau Señor Señora Señorita Sr Sra Srta Mme Mlle Monsieur Madame Signor Signora Sig Господин Госпожа господин госпожа г-н г-жа Κύριος Κυρία κύριος κυρία"

# Alphabets (lower case) whose characters permute among themselves.
BASIC = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz",
    "àáâäèéêëìíîïòóôöùúûü", "çñ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
HEX = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF"}

_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
_TITLE = "(?:" + "|".join(HONORIFICS.split()) + r")\.?+"
_SURNAME = r"(?:\p{Lu}[\p{L}\p{M}'’-]++|\p{Lo}[\p{L}\p{M}]{0,6}+)"
_KEYWORD = r"(?i:(?:api|access|auth|client|private|secret)[_-]?(?:key|token|secret)|token|secret|password|passwd|pwd)"
_KEY_SHAPE = r"(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{20,}+|sk-[0-9A-Za-z_-]{20,}+|AIza[0-9A-Za-z_-]{30,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{4,}+)"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{M}\p{N}-]++\.)+[\p{L}\p{M}]{2,}+" + _END
#: What begins with a letter, and what with a digit.
_LETTERS = {
    "secret": _KEYWORD + r"\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{6,}+\"|'[^'\s]{6,}+'|(?=[^\s\"'<>,;]*\d)[^\s\"'<>,;]{6,}+)",
    "key": _KEY_SHAPE + _END,
    "iban": r"(?=[A-Z]{2}\d)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}+(?: ?[0-9A-Z]{1,3})?" + _END,
    "name": "(?:(?:" + _TITLE + " )++" + _SURNAME + "(?: " + _SURNAME + ")?|(?:" + "|".join(n for names in GIVEN.values() for n in names.split()) + ") " + _SURNAME + ")" + _END,
}
_NUMBERS = {
    "ipv4": r"(?<![.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}])",
    "ssn": r"\d{3}-\d{2}-\d{4}" + _END,
    "local": r"(?:\d{3}([-. ])\d{3}\1\d{4}|0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{2,5}){1,2}+)" + _END,
    "card": r"\d(?:[ -]?\d){12,18}+" + _END,
}
_IPV6 = r"(?=[A-Fa-f:]*+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}+)" + _END
_PHONE = r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}" + _END
_PARENS = r"\(\d{3,4}\) ?\d{3,4}[ -]?\d{4}" + _END
# the first characters that may begin an entity: all other places are passed at once
_MAYBE = r"(?=[0-9A-Z+(]|a[cpu]|cl|ey|gh|p[arw]|s[ek]|to|[гк]|[\x{80}-\x{10ffff}&&\p{Lu}])"
REST = _MAYBE + _EDGE + "(?:(?=[0-9])(?:" + "|".join(_NUMBERS.values()) + r")|(?=\+)" + _PHONE + r"|(?=\()" + _PARENS + r"|(?=\p{L})(?:" + "|".join(_LETTERS.values()) + "))"
EMAIL, IPV6 = _EMAIL, _EDGE + "(?=[0-9A-Fa-f]{1,4}:)" + _IPV6


def _any(email: bool, ipv6: bool) -> str:
    return "|".join(f"(?:{p})" for p in [EMAIL] * email + [IPV6] * ipv6 + [REST])


_MARK = ""


@lru_cache(maxsize=1)
def letter_tables() -> tuple[list[str], dict[str, str]]:
    """(alphabets of the letters with two cases, lower case, by script; arrays of the ranges of all other letters, as text).

    A letter has two cases here if lower and upper case lead to each other, one to one. The others are ranges of code points, which
    have places in a row of all of them; of each range, its script's places begin at `base` and are `size`.
    """
    taken, cased, plain = set("".join(BASIC)), {}, {}
    for c in map(chr, range(0x80, 0x32000)):
        if not unicodedata.category(c).startswith("L") or c in taken:
            continue
        low, up = c.lower(), c.upper()
        if low != c and len(low) == 1 and low.upper() == c:
            continue
        two = up != c and len(up) == 1 and up.lower() == c
        (cased if two else plain).setdefault(unicodedata.name(c, "?").split()[0].split("-")[0], []).append(c)
    ranges, at = [], 0
    few = [c for s in sorted(plain) if len(plain[s]) < 2 for c in plain[s]]
    for letters in [*(plain[s] for s in sorted(plain) if len(plain[s]) > 1), few]:
        base = at
        for c in sorted(letters):
            if ranges and at > base and ord(c) == ranges[-1][1] + 1:
                ranges[-1][1] += 1
            else:
                ranges.append([ord(c), ord(c), at, base, len(letters)])
            at += 1
    by_code = sorted(ranges)
    text = lambda rows, k: ",".join(str(r[k]) for r in rows)
    arrays = {n: text(by_code, k) for n, k in (("first", 0), ("last", 1), ("place", 2), ("base", 3), ("size", 4))}
    arrays |= {"code_at": text(ranges, 0), "place_at": text(ranges, 2)}
    return ["".join(cased[s]) for s in sorted(cased) if len(cased[s]) > 1], arrays


def kind_of(e: Column) -> Column:
    """The type of a detected entity."""
    out = F.lit("name")
    for kind, test in (
        ("iban", e.rlike(r"^[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?$")),
        ("ipv6", e.rlike(r"^[0-9A-Fa-f:]+$")),
        ("card", e.rlike(r"^\d(?:[ -]?\d){12,18}$")),
        ("phone", e.rlike(r"^[+(]|^(?:\d{3}([-. ])\d{3}\1\d{4}|0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{2,5}){1,2})$")),
        ("ssn", e.rlike(r"^\d{3}-\d{2}-\d{4}$")),
        ("ipv4", e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")),
        ("key", e.rlike("^" + _KEY_SHAPE + "$")),
        ("secret", e.rlike("^" + _KEYWORD + r"\s{0,3}[=:]")),
        ("email", e.rlike("^[^\"'=:\\s]+@")),
    ):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _fold(key: Column, half: Column, rnd: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the round and the half, not on its case."""
    return F.sha2(F.concat_ws("\u0001", key, rnd.cast("string"), F.lower(half)).cast("binary"), 256)


def _far(c: Column, step: Column) -> Column:
    """A letter of a script without cases, moved by step among the letters of its script; any other character as it is."""
    t = {n: F.split(F.lit(v), ",").cast("array<int>") for n, v in letter_tables()[1].items()}
    code = F.ascii(c)

    def moved(i: Column) -> Column:
        base, size = F.get(t["base"], i), F.get(t["size"], i)
        to = base + F.pmod(F.get(t["place"], i) + code - F.get(t["first"], i) - base + step, size)
        return _let(to, lambda p: _let(F.size(F.filter(t["place_at"], lambda x: x <= p)) - 1, lambda j: F.get(t["code_at"], j) + p - F.get(t["place_at"], j)))

    inside = lambda i: (i >= 0) & (code <= F.get(t["last"], F.greatest(i, F.lit(0))))
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return _let(F.size(F.filter(t["first"], lambda x: x <= code)) - 1, lambda i: F.when(inside(i), letter(moved(i))).otherwise(c))


def _char(c: Column, step: Column, mode: Column) -> Column:
    """A character moved by step in its alphabet, in its case; it stays if it has none. mode: text, hex, HEX or digits."""

    def within(b: Column, a: str, other: Column) -> Column:
        at = F.call_function("instr", F.lit(a), b)
        return F.when((at > 0) & (b != ""), F.substring(F.lit(a), F.pmod(at - 1 + step, F.lit(len(a))) + 1, F.lit(1))).otherwise(other)

    def text(b: Column) -> Column:
        out = F.when(F.ascii(b) < 128, b).otherwise(_far(b, step))
        for a in [*letter_tables()[0], *reversed(BASIC)]:
            out = within(b, a, out)
        return out

    low = F.lower(c)
    upper = (c != low) & (F.upper(low) == c)
    words = F.when(upper, F.upper(text(low))).otherwise(text(c))
    return F.when(mode == "hex", within(c, HEX["hex"], c)).when(mode == "HEX", within(c, HEX["HEX"], c)).when(mode == "digits", within(c, BASIC[0], c)).otherwise(words)


def _move(text: Column, stream: Column, sign: Column, mode: Column) -> Column:
    """Every character moved by the stream's digits."""
    step = lambda i: sign * F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _char(c, step(i), mode)), "")


def permuted(text: Column, key: Column, mode: Column) -> Column:
    """A keyed permutation of the strings with this text's form; its only fixed points are those that have nothing to move.

    Rounds 0..3 undo the network, round 4 moves the first character that has an alphabet on by one, rounds 5..8 apply it again.
    """
    cut = F.ceil(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.char_length(text)).alias("b"))

    def turn(h: Column, r: Column) -> Column:
        rnd = F.when(r < 4, 3 - r).otherwise(r - 5)
        # even rounds move the left half by the right one, odd rounds the right half by the left one
        even = rnd % 2 == 0
        mine, other = F.when(even, h.a).otherwise(h.b), F.when(even, h.b).otherwise(h.a)
        # in round 4 every character is moved by one, and the first that this changes is taken over
        stream = F.when(r == 4, F.lit("01" * 32)).otherwise(_fold(key, other, rnd))
        whole = F.when(r == 4, F.concat(h.a, h.b)).otherwise(mine)
        moved = _move(whole, stream, F.when(r < 4, F.lit(-1)).otherwise(F.lit(1)), mode)

        def put(m: Column) -> Column:
            old, new = F.split(whole, ""), F.split(m, "")
            at = F.array_position(F.zip_with(old, new, lambda x, y: x != y), True).cast("int")
            one = F.when(at > 0, F.concat(F.substring(whole, F.lit(1), at - 1), F.get(new, at - 1), F.substring(whole, at + 1, F.char_length(whole)))).otherwise(whole)
            left, right = F.when(even, m).otherwise(h.a), F.when(even, h.b).otherwise(m)
            stepped = F.struct(F.substring(one, F.lit(1), cut).alias("a"), F.substring(one, cut + 1, F.char_length(one)).alias("b"))
            return F.when(r == 4, stepped).otherwise(F.struct(left.alias("a"), right.alias("b")))

        return _let(moved, put)

    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), start, turn, lambda h: F.concat(h.a, h.b))


def _private(v: Column) -> Column:
    """How many low bits of an IPv4 address are free within its reserved block; 32 if it is public."""
    top = lambda bits: F.shiftright(v, 32 - bits)
    return F.when(top(8).isin(0, 10, 127), F.lit(24)).when(top(12) == 0xAC1, F.lit(20)).when(top(16) == 0xC0A8, F.lit(16)).otherwise(F.lit(32))


def _octets(text: Column, key: Column) -> Column:
    """A keyed permutation, without fixed points, of the IPv4 addresses of each reserved block, and of the public ones."""

    def run(v: Column, half: Column, back: bool) -> Column:
        start = F.struct(F.floor(v / half).cast("long").alias("a"), (v % half).alias("b"))

        def turn(h: Column, r: Column) -> Column:
            even = r % 2 == 0
            f = F.conv(F.substring(_fold(key, F.when(even, h.b).otherwise(h.a).cast("string"), r), F.lit(1), F.lit(4)), 16, 10).cast("long")
            f = -f if back else f
            return F.struct(F.when(even, F.pmod(h.a + f, half)).otherwise(h.a).alias("a"), F.when(even, h.b).otherwise(F.pmod(h.b + f, half)).alias("b"))

        return F.aggregate(F.array(*map(F.lit, [3, 2, 1, 0] if back else [0, 1, 2, 3])), start, turn, lambda h: h.a * half + h.b)

    def block(n: Column, bits: Column) -> Column:
        size = F.pow(F.lit(2), bits).cast("long")
        half = F.pow(F.lit(2), bits / 2).cast("long")
        one = lambda v: _let(_let(run(v, half, True), lambda x: F.pmod(x + 1, size)), lambda x: run(x, half, False))
        low = n % size
        # a public address is moved on while it lands in a reserved block (one in 80 does)
        walked = F.aggregate(F.sequence(F.lit(0), F.lit(6)), low, lambda v, i: F.when((i == 0) | ((bits == 32) & (_private(v) < 32)), one(v)).otherwise(v))
        return n - low + walked

    number = F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + o.cast("long"))
    new = _let(number, lambda n: _let(_private(n), lambda bits: block(n, bits)))
    return _let(new, lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


def _luhn(digits: Column) -> Column:
    """The check digit of a string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.get(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda n, x: n + x), F.lit(10))


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's letters and digits (the country and check digits at the end), as a check takes it."""
    value = lambda c: F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(F.pmod(n * F.when(value(c) < 10, 10).otherwise(100) + value(c), F.lit(97))))


def _spread(form: Column, chars: Column) -> Column:
    """chars (letters and digits) back into the places of the letters and digits of `form`."""
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(chars, F.char_length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), "[^0-9A-Z]", "")), F.lit(1))).otherwise(c)), "")


def given_name_map(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next of its gender and script in keyed order."""
    out: dict[str, str] = {}
    for names in GIVEN.values():
        order = sorted(names.split(), key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def surrogate(e: Column, key: str) -> Column:
    """The surrogate of a detected entity: it is cut into parts, each kept as it is or permuted, and put together again."""
    digest = lambda what: hmac.new(key.encode(), what.encode(), hashlib.sha256).hexdigest()
    table = F.create_map(*[F.lit(x) for pair in given_name_map(key).items() for x in pair])
    part = lambda text, what, mode="text": F.struct(text.alias("t"), F.lit(digest(what)).alias("k"), (mode if isinstance(mode, Column) else F.lit(mode)).alias("m"))
    same = lambda text: part(text, "", "keep")
    compact = F.regexp_replace(e, "[^0-9A-Z]", "")
    n = F.char_length(compact)
    at, dot = F.instr(e, "@"), F.char_length(e) - F.char_length(F.substring_index(e, ".", -1))
    secret = "^(" + _KEYWORD + r"\s{0,3}[=:]\s{0,3}[\"']?)(.*?)([\"']?)$"
    value = F.regexp_extract(e, secret, 2)
    form = F.when(value.rlike("^[0-9a-f]+$"), "hex").when(value.rlike("^[0-9A-F]+$"), "HEX").otherwise("text")
    country = F.when(e.startswith("+"), F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)).otherwise(F.regexp_extract(e, r"^0?", 0))
    behind = lambda c: F.substring(e, F.char_length(c) + 1, F.char_length(e))
    shape = F.regexp_extract(e, "^(AKIA|gh[opsu]_|sk-|AIza|eyJ)", 1)
    title = lambda w: w.rlike("^" + _TITLE + "$") | F.array_contains(F.map_keys(table), w)
    kind = kind_of(e)
    parts = (
        F.when(kind == "email", F.array(part(F.substring(e, F.lit(1), at - 1), "email"), same(F.lit("@")), part(F.substring(e, at + 1, dot - at - 1), "domain"), same(F.substring(e, dot, F.char_length(e)))))
        .when(kind == "secret", F.array(same(F.regexp_extract(e, secret, 1)), part(value, "secret", form), same(F.regexp_extract(e, secret, 3))))
        .when(kind == "key", F.array(same(shape), part(behind(shape), "key")))
        .when(kind == "phone", F.array(same(country), part(behind(country), "phone", "digits")))
        .when(kind == "ssn", F.array(part(e, "ssn", "digits")))
        .when(kind == "ipv6", F.array(part(e, "ipv6", F.when(e.rlike("[A-F]"), "HEX").otherwise("hex"))))
        .when(kind == "card", F.array(part(F.substring(compact, F.lit(1), n - 1), "card", "digits")))
        .when(kind == "iban", F.array(part(F.substring(compact, F.lit(5), n - 4), "iban")))
        .when(kind == "ipv4", F.array(same(e)))
        .otherwise(F.transform(F.split(e, " "), lambda w, i: F.struct(F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w).alias("t"), F.lit(digest("name")).alias("k"), F.when(title(w), "keep").otherwise("text").alias("m"))))
    )
    new = F.transform(parts, lambda p: F.when(p.m == "keep", p.t).otherwise(permuted(p.t, p.k, p.m)))

    def put(x: Column) -> Column:
        one = F.get(x, F.lit(0))
        # how far the last digit is from the check digit stays
        off = F.substring(compact, n, F.lit(1)).cast("int") - _luhn(F.substring(compact, F.lit(1), n - 1))
        card = _spread(e, F.concat(one, F.pmod(_luhn(one) + off, F.lit(10)).cast("string")))
        head = F.substring(compact, F.lit(1), F.lit(2))
        valid = _mod97(F.concat(F.substring(compact, F.lit(5), n), F.substring(compact, F.lit(1), F.lit(4)))) == 1
        check = F.when(valid, F.lpad((98 - _mod97(F.concat(one, head, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(compact, F.lit(3), F.lit(2)))
        named = F.array_join(F.transform(x, lambda w: F.coalesce(F.try_element_at(table, F.ltrim(w)), F.ltrim(w))), " ")
        return F.when(kind == "card", card).when(kind == "iban", _spread(e, F.concat(head, check, one))).when(kind == "ipv4", _octets(e, F.lit(digest("ipv4")))).when(kind == "name", named).otherwise(F.array_join(x, ""))

    letters = F.translate(F.substring(F.sha2(F.concat(F.lit(digest("rest")), e).cast("binary"), 256), 1, 16), "0123456789", "ghijklmnop")
    return _let(_let(new, put), lambda s: F.when(s == e, letters).otherwise(s))


def pieces_of(text: Column) -> Column:
    """The text cut at the edges of its entities: the odd pieces (from 0) are the entities. One search of the text."""
    # a text that holds the mark itself is marked by a digest of its own, which it can't hold
    mark = F.when(F.contains(text, F.lit(_MARK)), F.concat(F.lit(_MARK), F.sha2(text.cast("binary"), 256))).otherwise(F.lit(_MARK))
    put = F.concat(mark, F.lit("$0"), mark)
    # the pattern has only what the text can hold: addresses have an @, or two or seven colons
    email = F.contains(text, F.lit("@"))
    ipv6 = F.contains(text, F.lit("::")) | (F.octet_length(text) - F.octet_length(F.translate(text, ":", "")) >= 7)
    search = lambda e, v: F.regexp_replace(text, F.lit(_any(e, v)), put)
    marked = F.when(email & ipv6, search(True, True)).when(email, search(True, False)).when(ipv6, search(False, True)).otherwise(search(False, False))
    return F.split(marked, mark, -1)


def _own_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def cut_texts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """(docs with the pieces of the text in place of the text, the name of that column)."""
    name = _own_name(docs, "pieces")
    return docs.drop("n_entities").withColumn(name, pieces_of(F.col(text_col))).drop(text_col), name


def entity_table(cut: DataFrame, pieces: str, key: str) -> DataFrame:
    """(kind, entity, surrogate, n): every distinct entity of all texts, with its number of occurrences."""
    found = F.filter(F.col(pieces), lambda p, i: i % 2 == 1)
    seen = cut.select(F.explode(found).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    return seen.select(kind_of(F.col("entity")).alias("kind"), "entity", surrogate(F.col("entity"), key).alias("surrogate"), "n")


def collisions(table: DataFrame) -> DataFrame:
    """(kind, surrogate, n_entities): surrogates that stand for several entities, or for themselves."""
    checked = table.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities"), F.count_if(F.col("entity") == F.col("surrogate")).alias("same"))
    return checked.where("n_entities > 1 or same > 0").select("kind", "surrogate", "n_entities")


def replace_checked(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and n_entities, after a check of all entities of docs for collisions."""
    cut, name = cut_texts(docs, text_col)
    cut = Workspace(docs.sparkSession, "pii").cut(cut)
    for again in range(4):
        now = key if not again else hmac.new(key.encode(), f"again {again}".encode(), hashlib.sha256).hexdigest()
        if not collisions(entity_table(cut, name, now)).limit(1).collect():
            break
    # texts without entities are one piece, and have no surrogate to make
    new = F.when(F.size(name) > 1, F.array_join(F.transform(name, lambda p, i: F.when(i % 2 == 1, surrogate(p, now)).otherwise(p)), "")).otherwise(F.get(F.col(name), F.lit(0)))
    out = {c: F.col(f"`{c}`") for c in docs.columns if c != "n_entities"} | {text_col: new.alias(text_col)}
    return cut.select(*out.values(), F.coalesce(F.when(F.col(name).isNotNull(), F.floor(F.size(name) / 2)), F.lit(0)).cast("int").alias("n_entities"))
