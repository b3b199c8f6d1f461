"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions alone.

Found and validated in the whole text:

* payment card numbers (13 to 19 digits, Luhn), IBANs (check digits), social security numbers, calendar dates from 1800 to 2199;
* telephone numbers: E.164 with ``+`` and 7 to 15 digits, with single separators anywhere and a ``(0)``; North American ones;
  national ones with a trunk 0, in pairs of digits or in groups;
* IPv4 addresses, and IPv6 addresses of global, unique local and link-local range, shortened or not;
* e-mail addresses, access keys by the prefixes of known kinds, values of 16 characters and more assigned to a name such as
  ``token``, and values of 6 and more, with a letter and a digit, assigned to a password.

A number or date is permuted within its format by a keyed Feistel network, so equal values get equal pseudonyms in every
document, different ones stay different, and what comes out is valid again: a card number has its Luhn digit, an IBAN its
country and check digits, a telephone number its country code, an address its octets or groups, a date is a date, separators
stay in place. An IPv6 address is written in full, so that its notations are linked. E-mail addresses, keys and assigned values,
whose format has no natural numbering, become keyed hashes; a key keeps its prefix.

The round function is SHA-256 over key, kind, round and half. The key is a parameter; who holds it can undo the permutation.
What looks like a number but does not validate (a card number with a wrong check digit, a 13th month) is left alone. So are
local telephone numbers without trunk or area code, names, postal addresses, and shorter secrets without a name before them.

Defined cases: NULL text stays NULL and empty text empty; repeated rows get equal results; an empty table gives an empty
one; all columns are kept, only ``text`` changes; a column named ``n_replaced`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
ADDRESS = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
CARD = (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}"
        r"|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])")
PHONE = (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
         r"|(?<![0-9+])\+[0-9]{1,3} ?[0-9]{3} ?[0-9]{3} ?[0-9]{4}(?![0-9])"
         r"|(?<![0-9+])\+[1-9](?:[ ./-]?(?:\(0\)[ ]?)?\(?[0-9]\)?){6,14}(?![0-9])"
         r"|(?<![0-9+.,/-])0[1-9](?:([ .-])[0-9]{2})(?:\1[0-9]{2}){3}(?![0-9])"
         r"|(?<![0-9+.,/-])(?:\(0[1-9][0-9]{1,3}\) ?|0[1-9][0-9]{1,3}[ /-])[0-9]{3,4}(?:[ -][0-9]{3,4}|[0-9]{1,5})(?![0-9])")
#: The country codes of the telephone network that have one or two digits; all others have three.
_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
_GROUP = r"[0-9A-Fa-f]{1,4}"
IPV6 = (rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}"
        rf"|(?:[23][0-9A-Fa-f]{{3}}|[Ff][CcDd][0-9A-Fa-f]{{2}}|[Ff][Ee][89ABab][0-9A-Fa-f])(?::{_GROUP}){{0,6}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)"
        r"(?![0-9A-Za-z:])")
#: How access keys of known kinds begin, and what follows.
_KEYS = [(r"(?:AKIA|ASIA)", r"[0-9A-Z]{16}"), (r"gh[pousr]_", r"[0-9A-Za-z]{30,255}"), (r"github_pat_", r"[0-9A-Za-z_]{22,255}"),
         (r"glpat-", r"[0-9A-Za-z_-]{20,}"), (r"xox[abprs]-", r"[0-9A-Za-z-]{11,}"), (r"AIza", r"[0-9A-Za-z_-]{35}"),
         (r"[sr]k_(?:live|test)_", r"[0-9A-Za-z]{16,}"), (r"sk-", r"[0-9A-Za-z_-]{20,}"), (r"npm_", r"[0-9A-Za-z]{36}"),
         (r"eyJ", r"[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}")]
ACCESS = r"(?<![0-9A-Za-z_-])(?:" + "|".join(a + b for a, b in _KEYS) + r")(?![0-9A-Za-z_-])"
_PREFIX = "^(?:" + "|".join(a for a, _ in _KEYS) + ")"
SOCIAL = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = (r"(?<![0-9])(?:(?:18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}"
        r"|[0-9]{2}/[0-9]{2}/(?:18|19|20|21)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:18|19|20|21)[0-9]{2})(?![0-9])")
SECRET = (r"(?<![0-9A-Za-z_-])(?=[0-9A-Za-z_-]{16})"
          r"(?<=(?i:token|secret|password|passwd|api.?key)\s{0,2}[=:]\s{0,2}[\"']?)[0-9A-Za-z_-]{16,}")
PASSWORD = (r"(?<![^\s=:\"'])(?=[^\s\"',;]{0,64}[0-9])(?=[^\s\"',;]{0,64}[A-Za-z])"
            r"(?<=(?i:password|passwd|pwd)\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"',;]{6,64}")
#: Numbers and dates. The conditions in front hold for all that follows them; they spare most places of a text the rest.
NUMBERS = (rf"(?=[0-9+(])(?:{ADDRESS}|{DATE}|{SOCIAL}|{CARD}|{PHONE})|(?=[A-Z]{{2}}[0-9]{{2}}){IBAN}")
PATTERN = r"(?<![0-9A-Za-z])(?:" + "|".join([EMAIL, ACCESS, SECRET, PASSWORD, IPV6, IBAN]) + ")|" + NUMBERS
#: A text without any of this holds none of the other kinds, which are costlier to look for.
_OTHERS = (r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|(?i:token|secret|password|passwd|pwd|api.?key)\s{0,2}[=:]|(?:"
           + "|".join(a for a, _ in _KEYS) + ")[0-9A-Za-z]")
_MARK, _OWN = "\x01", "\x02"
#: Days of 400 Gregorian years from FIRST_DAY on: 27 * 5411, so a Feistel network over both factors permutes them exactly.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 27, 5411
#: Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
AREAS, REST = 898, 99 * 9999


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _random(key: Column, kind: Column, turn: Column, half: Column) -> Column:
    """60 pseudo-random bits."""
    digest = F.sha2(F.concat_ws("|", key, kind, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: Column, kind: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs with left below ``a`` and right below ``b``, as a struct (x, y)."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.cast("long").alias("x"), right.cast("long").alias("y")),
        lambda s, i: F.struct(
            s["y"].alias("x"),
            F.pmod(s["x"] + F.pmod(_random(key, kind, i, s["y"]), F.when(i % 2 == 1, a).otherwise(b)),
                   F.when(i % 2 == 1, a).otherwise(b)).alias("y")))


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10 ** i).cast("long") for i in range(16)]), n + 1)


def permuted_digits(key: Column, kind: str, digits: Column) -> Column:
    """A string of 2 to 30 digits, permuted among those of its length."""
    def permuted(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        out = feistel(key, F.concat(F.lit(kind), n.cast("string")), F.substring(d, F.lit(1), h),
                      F.substring(d, h + 1, n - h), _power(h), _power(n - h))
        return let(out, lambda o: F.concat(F.lpad(o["x"].cast("string"), h, "0"), F.lpad(o["y"].cast("string"), n - h, "0")))

    return let(digits, permuted)


def _luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Luhn sum of the digits from the right; ``first_doubled`` if a check digit is to follow."""
    def add(total: Column, i: Column, turned: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == (1 if first_doubled else 0), twice).otherwise(d)

    return let(F.reverse(digits), lambda turned: F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda total, i: add(total, i, turned)))


def _written(match: Column, signs: Column, kept: Callable[[Column], Column]) -> Column:
    """``match`` with its signs, but for those that are ``kept``, replaced by ``signs``, one by one."""
    return let(signs, lambda new: F.aggregate(
        F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(kept(c), F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(
            F.struct(F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))),
        lambda s: s["out"]))


def _in_place(match: Column, digits: Column) -> Column:
    return _written(match, digits, lambda c: ~c.rlike("^[0-9]$"))


def _card(key: Column, match: Column) -> Column:
    def new(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn_sum(body, True), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))

    def of(digits: Column) -> Column:
        body = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        return F.when(_luhn_sum(digits, False) % 10 == 0, _in_place(match, let(body, new))).otherwise(match)

    return let(F.regexp_replace(match, "[^0-9]", ""), of)


def _phone(key: Column, match: Column) -> Column:
    """All digits but the country code, or but the trunk 0, are permuted; a (0) stays as it is."""
    def of(trunk: Column, digits: Column) -> Column:
        code = F.when(digits.rlike(_CODE), F.length(F.regexp_extract(digits, _CODE, 0))).otherwise(3)
        kept = F.when(match.contains("+"), code).when(digits.startswith("0"), 1).otherwise(F.length(digits) - 10)
        return let(kept, lambda k: _in_place(trunk, F.concat(
            F.substring(digits, F.lit(1), k), permuted_digits(key, "phone", F.substring(digits, k + 1, F.length(digits) - k)))))

    trunk = F.when(match.contains("+"), F.regexp_replace(match, r"\(0\)", "(O)")).otherwise(match)
    new = let(trunk, lambda t: let(F.regexp_replace(t, "[^0-9]", ""), lambda digits: of(t, digits)))
    return F.regexp_replace(new, r"\(O\)", "(0)")


def _check_sum(text: Column) -> Column:
    """A string of digits and letters (10 to 35) as a number modulo 97."""
    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, (total * 100 + letter) % 97).otherwise((total * 10 + c.cast("int")) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(add(t, c)))


def _iban(key: Column, match: Column) -> Column:
    def of(country: Column, check: Column, account: Column) -> Column:
        def new(body: Column) -> Column:
            digits = F.lpad((98 - _check_sum(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, digits, body)

        digits = F.regexp_replace(account, "[^0-9]", "")
        signs = let(_in_place(account, permuted_digits(key, "iban", digits)), new)
        valid = (_check_sum(F.concat(account, country, check)) == 1) & F.length(digits).between(2, 30)
        return F.when(valid, _written(match, signs, lambda c: (c == " ") | (c == ""))).otherwise(match)

    return let(F.replace(match, F.lit(" "), F.lit("")), lambda p: let(
        F.substring(p, F.lit(5), F.length(p) - 4), lambda account: of(F.substring(p, 1, 2), F.substring(p, 3, 2), account)))


def _ipv6(key: Column, match: Column) -> Column:
    """The address in full: the network, and the interface within it, permuted as four groups each."""
    size = F.lit(1 << 32).cast("long")

    def half(value: Column, first: int, kind: Column) -> Column:
        left, right = (F.get(value, F.lit(i)) * 65536 + F.get(value, F.lit(i + 1)) for i in (first, first + 2))
        return feistel(key, kind, left, right, size, size)

    def groups(part: Column) -> list[Column]:
        return [F.lower(F.conv(g.cast("string"), 10, 16)) for n in (part["x"], part["y"]) for g in (F.floor(n / 65536), n % 65536)]

    def permuted(value: Column) -> Column:
        return let(half(value, 0, F.lit("network")), lambda net: let(
            half(value, 4, F.concat_ws("|", F.lit("interface"), net["x"].cast("string"), net["y"].cast("string"))),
            lambda host: F.concat_ws(":", *groups(net), *groups(host))))

    sides = F.split(F.lower(match), "::")
    head = F.filter(F.split(sides[0], ":"), lambda g: g != "")
    tail = F.filter(F.split(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))), tail)
    return let(F.transform(full, lambda g: F.conv(g, 16, 10).cast("long")),
               lambda value: F.when(F.size(value) == 8, permuted(value)).otherwise(match))


def _access(key: Column, match: Column) -> Column:
    prefix = F.regexp_extract(match, _PREFIX, 0)
    n = F.least(F.length(match) - F.length(prefix), F.lit(128))
    return F.concat(prefix, _hashed(key, "secret", match, n))


def _address(key: Column, match: Column) -> Column:
    def octets(out: Column) -> Column:
        parts = [F.floor(out["x"] / 256), out["x"] % 256, F.floor(out["y"] / 256), out["y"] % 256]
        return F.concat_ws(".", *[o.cast("string") for o in parts])

    part = [F.split_part(match, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    size = F.lit(65536).cast("long")
    return let(feistel(key, F.lit("address"), part[0] * 256 + part[1], part[2] * 256 + part[3], size, size), octets)


def _social(key: Column, match: Column) -> Column:
    def written(out: Column) -> Column:
        new = out["x"] + F.when(out["x"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"),
                           F.lpad((F.floor(out["y"] / 9999) + 1).cast("string"), 2, "0"),
                           F.lpad((out["y"] % 9999 + 1).cast("string"), 4, "0"))

    area, group, serial = (F.split_part(match, F.lit("-"), F.lit(i)).cast("long") for i in range(1, 4))
    return let(feistel(key, F.lit("social"), area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1,
                       F.lit(AREAS).cast("long"), F.lit(REST).cast("long")), written)


def _date(key: Column, match: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def new(day: Column, form: str) -> Column:
        out = feistel(key, F.lit("date"), F.floor(day / DAYS_RIGHT), day % DAYS_RIGHT,
                      F.lit(DAYS_LEFT).cast("long"), F.lit(DAYS_RIGHT).cast("long"))
        return let(out, lambda o: F.date_format(F.date_add(first, (o["x"] * DAYS_RIGHT + o["y"]).cast("int")), form))

    found = match
    for form in ("MM/dd/yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd"):  # the last that fits decides
        day = F.datediff(F.try_to_timestamp(match, F.lit(form)), first).cast("long")
        found = F.when(day.isNotNull(), new(day, form)).otherwise(found)
    return found


def _hashed(key: Column, kind: str, value: Column, n: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), value), 256)
    return F.substring(F.concat(digest, F.sha2(digest, 256)), F.lit(1), n)


def _email(key: Column, match: Column) -> Column:
    host = F.split_part(match, F.lit("@"), F.lit(2))
    return F.concat(F.lit("u"), _hashed(key, "name", F.lower(match), F.lit(12)), F.lit("@h"),
                    _hashed(key, "host", F.lower(host), F.lit(8)), F.lit(".invalid"))


def pseudonym(match: Column, key: Column) -> Column:
    """The pseudonym of one match of ``PATTERN``; the match itself where it does not validate."""
    def whole(pattern: str) -> Column:
        return match.rlike(f"^(?:{pattern})$")

    return (F.when(whole(EMAIL), _email(key, match))
            .when(whole(ACCESS), _access(key, match))
            .when(whole(IPV6), _ipv6(key, match))
            .when(whole(IBAN), _iban(key, match))
            .when(whole(ADDRESS), _address(key, match))
            .when(whole(DATE), _date(key, match))
            .when(whole(SOCIAL), _social(key, match))
            .when(whole(CARD), _card(key, match))
            .when(whole(PHONE), _phone(key, match))
            .otherwise(_hashed(key, "secret", match, F.least(F.length(match), F.lit(128)))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The documents with personal data replaced, and ``n_replaced``; the key must not be empty."""
    if not key:
        raise ValueError("an empty key gives no protection")
    # One pass puts each match between two marks; a mark in the text itself is doubled meanwhile.
    text, around = F.replace(F.col("text"), F.lit(_MARK), F.lit(_MARK + _OWN)), f"{_MARK}$0{_MARK}"
    marked = (F.when(F.col("text").contains("@") | F.col("text").rlike(_OTHERS), F.regexp_replace(text, PATTERN, around))
              .when(F.col("text").rlike("[0-9]"), F.regexp_replace(text, NUMBERS, around)))
    split = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text",
                        F.split(marked, f"{_MARK}(?!{_OWN})", -1).alias("pieces"))
    found = split.withColumn("masked", F.when(F.size("pieces") > 1, F.transform(
        "pieces", lambda p, i: F.when(i % 2 == 1, pseudonym(p, F.lit(key))).otherwise(p))))
    changed = F.size(F.filter(F.zip_with("pieces", "masked", lambda a, b: a != b), lambda x: x))
    joined = F.replace(F.array_join("masked", ""), F.lit(_MARK + _OWN), F.lit(_MARK))
    new = F.coalesce(F.when(F.col("masked").isNotNull(), joined), F.col("text"))
    return found.select(
        *[(new if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c != "n_replaced"],
        F.coalesce(F.when(F.col("masked").isNotNull(), changed), F.lit(0)).cast("long").alias("n_replaced"))
