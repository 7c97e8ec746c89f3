"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

A keyed Feistel network permutes the values of each kind within their format: a card
number becomes another card number with a right check digit, a date another valid date of
its century, an IPv4 address another one.  It is a permutation, so equal values stay
equal and different values stay different over all documents, and whoever has the key can undo it.

There is no key of the library's own: see ``key_of``.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
KEY_SETTING = "spark.mopup.pseudonym.key"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Candidates of each kind; the values are checked after that.  Runs are matched
#: possessively from their start, so a long run is passed in linear time and without recursion.
#: An email's local part has up to 64 characters of any alphabet; what follows the ``@`` stays as it is.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@(?=[\p{L}\p{N}-]{1,63}+\.[\p{L}\p{N}])[\p{L}\p{N}.-]++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:{_HEX}::?){{2,7}}+(?:{_HEX})?(?![0-9A-Za-z:])",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9])\+[1-9](?:[ ./()-]{0,2}+[0-9]){7,14}+(?![0-9])"
             r"|(?<![0-9A-Za-z_.,+-])[2-9][0-9]{9}(?![0-9A-Za-z_])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "date": r"(?<![0-9])(?:(?:1[89]|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/(?:1[89]|20)[0-9]{2}"
            r"|[0-9]{1,2}\.[0-9]{1,2}\.(?:1[89]|20)[0-9]{2})(?![0-9])",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: First day of the centuries of dates, and the two factors of their numbers of days.
CENTURIES = (("1800-01-01", 92, 397), ("1900-01-01", 92, 397), ("2000-01-01", 75, 487))
WALK = 64  # steps to the next date of a layout's own set; each one ends the walk with odds of about 3 in 5


def key_of(spark: SparkSession) -> str:
    """The secret key of the session's setting ``spark.mopup.pseudonym.key``.  Where none is set, a random one is
    drawn and set for the session: its pseudonyms link documents within the session, and no one can undo them."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _f(key: str, kind: Column, i: Column, side: Column, sizes: Column) -> Column:
    """The round function: 60 keyed bits."""
    text = F.concat_ws(":", F.lit(key), kind, sizes, i.cast("string"), side.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, kind, undo: bool = False) -> Column:
    """A keyed permutation of the pairs (x, y), 0 <= x < a, 0 <= y < b: the rounds add to x and y
    in turn.  Each round can be undone, so the whole is one to one on a * b values; ``undo`` gives the inverse."""
    sizes = F.concat_ws("x", a.cast("string"), b.cast("string"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    sign = -1 if undo else 1

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["x"] + sign * F.pmod(_f(key, kind, i, s["y"], sizes), a), a)).otherwise(s["x"]).alias("x"),
            F.when(even, s["y"]).otherwise(F.pmod(s["y"] + sign * F.pmod(_f(key, kind, i, s["x"], sizes), b), b)).alias("y"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("bigint")


def permute_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Another digit string of the same length, up to 36 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    left = F.coalesce(F.substr(digits, F.lit(1), u).try_cast("bigint"), F.lit(0).cast("bigint"))
    pair = feistel(left, F.substr(digits, u + 1, v).cast("bigint"), _power(u), _power(v), key, kind, undo)
    return F.aggregate(F.array(pair), F.lit(""), lambda _, p: F.concat(
        F.when(u > 0, F.lpad(p["x"].cast("string"), u, F.lit("0"))).otherwise(F.lit("")),
        F.lpad(p["y"].cast("string"), v, F.lit("0"))))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits, in order, replaced by ``digits``."""
    return _bound(digits, lambda new: F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(
            F.concat(s["out"], F.substr(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn terms; every second digit from the right but one is doubled."""
    return F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
        lambda s, c: F.struct(
            (s["sum"] + F.when(s["at"] % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(
                F.coalesce(c.try_cast("int"), F.lit(0)) * 2 - F.when(c >= "5", 9).otherwise(0))).alias("sum"),
            (s["at"] + F.when(c == "", 0).otherwise(1)).alias("at")), lambda s: s["sum"])


def _card(x: Column, key: str, undo: bool) -> Column:
    """First digit kept, the others permuted, the check digit made anew; as it is if the check fails."""
    d = _digits(x)
    payload = F.concat(F.substring(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", undo))
    whole = F.aggregate(F.array(payload), F.lit(""), lambda _, p: F.concat(
        p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(d) % 10 == 0, _refill(x, whole))


def _phone(x: Column, key: str, undo: bool) -> Column:
    """The country code stays: the one to three digits that a separator follows, two where none does, and none
    without a plus sign.  The other digits are permuted."""
    d = _digits(x)
    code = F.length(F.regexp_extract(x, r"^\+([0-9]+)", 1))
    kept = F.when(~F.startswith(x, F.lit("+")), F.length(d) - 10).when(code <= 3, code).otherwise(2)
    return _refill(x, F.concat(F.substr(d, F.lit(1), kept), permute_digits(
        F.substr(d, kept + 1, F.length(d) - kept), key, "phone", undo)))


def _iban(x: Column, key: str, undo: bool) -> Column:
    """The country and the letters stay, the account's digits are permuted, the check digits made anew; as
    it is if the check fails."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    account = F.substr(plain, F.lit(5), F.length(plain) - 4)
    fresh = _refill(account, permute_digits(_digits(account), key, "iban", undo))
    checked = F.aggregate(F.array(fresh), F.lit(""), lambda _, f: F.concat(
        F.substring(plain, 1, 2), F.lpad((98 - _mod97(F.concat(f, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, F.lit("0")), f))
    def spaced(text: Column) -> Column:
        return F.aggregate(
            F.split(x, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(
                F.concat(s["out"], F.substr(text, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))), lambda s: s["out"])

    right = _mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
    return F.when(right & (F.length(_digits(account)) > 0), _bound(checked, spaced))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that a text of digits and capital letters (10 to 35) spells."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(
        c.rlike("^[0-9]$"), (r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _ipv4(x: Column, key: str, undo: bool) -> Column:
    o = F.transform(F.split(x, "\\."), lambda p: p.cast("bigint"))
    pair = F.aggregate(F.array(o), F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y")),
                       lambda _, p: feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(1 << 16), F.lit(1 << 16),
                                            key, "ipv4", undo))
    return F.aggregate(F.array(pair), F.lit(""), lambda _, p: F.concat_ws(
        ".", *[F.floor(v / w).cast("bigint") % 256 for v in (p["x"], p["y"]) for w in (256, 1)]))


def _ipv6(x: Column, key: str, undo: bool) -> Column:
    """Each two of the eight groups permuted, so that neighbours in a network stay neighbours; written out in full.
    As it is if there aren't eight groups, or three and a gap with a digit somewhere (``a::b`` may be code)."""
    gap = F.contains(x, F.lit("::"))
    count = lambda part: F.size(F.filter(F.split(part, ":"), lambda g: g != ""))
    n = count(x)
    zeros = F.array_join(F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), ":")
    full = F.filter(F.split(F.when(gap, F.regexp_replace(x, "::", F.concat(F.lit(":"), zeros, F.lit(":")))).otherwise(x), ":"),
                    lambda g: g != "")
    groups = F.transform(full, lambda g: F.conv(g, 16, 10).cast("bigint"))
    def paired(g: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6), F.lit(2)), lambda i: _bound(
            feistel(F.get(g, i), F.get(g, i + 1), F.lit(1 << 16), F.lit(1 << 16), key,
                    F.concat(F.lit("ipv6:"), i.cast("string")), undo),
            lambda p: F.concat_ws(":", F.lower(F.hex(p["x"])), F.lower(F.hex(p["y"]))))), ":")

    one_gap = F.size(F.split(x, "::")) == 2
    right = F.when(gap, one_gap & (n >= 3) & (n <= 7) & x.rlike("[0-9]")).otherwise((n == 8) & ~x.rlike("^:|:$"))
    return F.when(right & ~x.rlike("[^:]:$"), _bound(groups, paired))


def _email(x: Column, key: str, undo: bool) -> Column:
    """The local part's letters and digits become others by a keyed permutation of each 8 characters
    (letters a-z and digits, as base 36); marks and the domain stay.  A local part with other letters is
    spelled by the hexadecimal digits of its bytes before that, so nothing of it is left."""
    at = F.instr(x, "@")
    given = F.lower(F.substr(x, F.lit(1), at - 1))
    local = F.when(given.rlike(r"[^\x00-\x7F]"), F.lower(F.hex(given.cast("binary")))).otherwise(given)
    plain = F.regexp_replace(local, "[^a-z0-9]", "")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain), F.lit(1)), F.lit(8)),
                         lambda i: F.substr(plain, i, F.lit(8)))

    def permuted(c: Column) -> Column:
        n = F.length(c)
        u = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(36.0), k).cast("bigint")
        number = lambda t: F.coalesce(F.conv(t, 36, 10).cast("bigint"), F.lit(0).cast("bigint"))
        text = lambda v, k: F.when(k > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, 36)), k, F.lit("0"))).otherwise(
            F.lit(""))
        pair = feistel(number(F.substr(c, F.lit(1), u)), number(F.substr(c, u + 1, n - u)), size(u), size(n - u),
                       key, "email", undo)
        return F.when(n == 0, F.lit("")).otherwise(F.aggregate(
            F.array(pair), F.lit(""), lambda _, p: F.concat(text(p["x"], u), text(p["y"], n - u))))

    fresh = F.concat_ws("", F.transform(chunks, permuted))
    filled = _bound(fresh, lambda new: F.aggregate(
        F.split(local, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("^[a-z0-9]$"), F.struct(
            F.concat(s["out"], F.substr(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"]))
    return F.concat(filled, F.substr(x, at))


def _date(x: Column, key: str, undo: bool) -> Column:
    """Another day of the same century in the same layout; null (not a date) for no real day.

    Slashes read month first where that can be a date, else day first; a day-first date becomes one that can only
    be read day first (the permutation is followed until one is met).  Day and month without leading zeros give the same."""
    part = F.split(x, "[-/.]")
    dash, slash = F.contains(x, F.lit("-")), F.contains(x, F.lit("/"))
    day_first = slash & (part[0].try_cast("int") > 12)
    year = F.when(dash, part[0]).otherwise(part[2])
    month = F.when(dash, part[1]).when(slash & ~day_first, part[0]).otherwise(part[1])
    day = F.when(dash, part[2]).when(slash & ~day_first, part[1]).otherwise(part[0])
    short = (F.length(month) == 1) | (F.length(day) == 1)
    real = F.concat_ws("-", year, month, day).try_cast("date")
    century = F.floor(F.year(real) / 100).cast("int") - 18

    def of(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), century)

    start = of([c[0] for c in CENTURIES]).cast("date")
    a, b = of([c[1] for c in CENTURIES]), of([c[2] for c in CENTURIES])
    kind = F.concat(F.lit("date"), of([c[0] for c in CENTURIES]))

    def step(at: Column) -> Column:
        pair = feistel(F.floor(at / b), at % b, a, b, key, kind, undo)
        return F.aggregate(F.array(pair), F.lit(0), lambda _, p: (p["x"] * b + p["y"]).cast("int"))

    steps = F.sequence(F.lit(1), F.when(day_first, F.lit(WALK)).otherwise(F.lit(1)))
    there = F.aggregate(steps, F.date_diff(real, start) - F.lit(0), lambda at, k: F.when(
        (k == 1) | (F.dayofmonth(F.date_add(start, at)) <= 12), step(at)).otherwise(at))
    def written(fresh: Column) -> Column:
        two = lambda v: F.when(short, v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, F.lit("0")))
        y, m, d = F.year(fresh).cast("string"), two(F.month(fresh)), two(F.dayofmonth(fresh))
        return F.when(dash, F.concat_ws("-", y, m, d)).when(day_first, F.concat_ws("/", d, m, y)).when(
            slash, F.concat_ws("/", m, d, y)).otherwise(F.concat_ws(".", d, m, y))

    return F.when(real.isNotNull(), _bound(F.date_add(start, there), written))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: text results only."""
    return F.aggregate(F.array(value), F.lit(None).cast("string"), lambda _, v: then(v))


_MAKERS = {"email": _email, "iban": _iban, "ipv6": _ipv6, "ipv4": _ipv4, "phone": _phone, "card": _card, "date": _date}


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """struct(kind, text): the pseudonym of one candidate; a candidate that fails its check keeps its
    text and has kind null."""
    kind = F.when(value.contains("@"), F.lit("email"))
    for k in KINDS[1:]:
        kind = kind.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k))
    fresh = F.lit(None).cast("string")
    for k, make in _MAKERS.items():
        fresh = F.when(kind == k, make(value, key, undo)).otherwise(fresh)
    return F.aggregate(F.array(fresh), F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text")),
                       lambda s, f: F.struct(F.when(f.isNotNull(), kind).alias("kind"),
                                             F.coalesce(f, value).alias("text")))


def _equal_to(kind: str):
    return lambda k: k == kind


def pseudonymize(docs: DataFrame, text_col: str = "text", *, key: str, counts: str | None = "pii",
                 undo: bool = False) -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced by their pseudonyms and, with
    ``counts``, a new column of that name: struct of the number replaced of each kind.  A column of ``docs`` that has
    that name already is an error.  ``undo`` turns pseudonyms made with the same key back: emails come back in lower
    case, IPv6 addresses written out, and local parts in other alphabets as the hexadecimal digits of their bytes.

    A null text stays null with counts of 0; an empty text stays empty.  Candidates that fail
    their check (Luhn sum, calendar) stay as they are.  Rows are treated each for itself, all
    other columns pass through, and an empty table gives an empty table.  Whole texts are searched, however
    long.  Built-in functions only; nothing is shuffled.  A value's pseudonym depends on the key and the value alone."""
    if not key:
        raise ValueError("a secret key is needed")
    if counts in docs.columns:
        raise ValueError(f"there is a column {counts!r} already: name another one for the counts")
    text = F.col(text_col)
    hits = "__mopup_pii_hits"
    has = text.rlike("[0-9]") | text.contains("@")
    found = F.when(has, F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), lambda m: pseudonym(m, key, undo)))
    out = docs.withColumn(hits, found)
    some = F.coalesce(F.size(F.col(hits)), F.lit(0)) > 0
    pieces = F.arrays_zip(F.split(text, _ANY, -1).alias("gap"), F.col(hits).alias("hit"))
    whole = F.concat_ws("", F.transform(pieces, lambda p: F.concat(
        p["gap"], F.coalesce(p["hit"]["text"], F.lit("")))))
    replaced = F.when(some, whole).otherwise(text)
    if counts:
        kinds = F.transform(F.col(hits), lambda h: h["kind"])
        out = out.withColumn(counts, F.struct(*[
            F.greatest(F.coalesce(F.size(F.filter(kinds, _equal_to(k))), F.lit(0)), F.lit(0)).cast("long").alias(k) for k in KINDS]))
    return out.withColumn(text_col, replaced).drop(hits)
