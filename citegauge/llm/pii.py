"""PII by format-preserving Feistel pseudonyms. Spark expressions only.

Found values are permuted within their own format by a keyed Feistel network over the pair of halves (L, R) of its
domain a x b: in turn L = (L + F(R)) mod a and R = (R + F(L)) mod b, F a keyed SHA-256. Every such step can be undone,
so equal values get equal pseudonyms in all documents, different values different ones, and the key takes them back.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: The queries' key where the session names none: public, so good for tests and for nothing else.
DEMO_KEY, KEY_CONF = "0f1e2d3c4b5a69788796a5b4c3d2e1f0", "spark.citegauge.pii.key"

_H = "[0-9A-Fa-f]{1,4}"
#: Heads of keys that services hand out.
HEADS = r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-proj-|sk[-_](?:live|test)_|sk-|AIza)"
#: Name, kind and pattern, in order of precedence where matches begin at the same place.
PATTERNS = [
    ("email", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", "date", r"(?<![0-9./-])(?:(?:1[89]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)(?:1[89]|2[01])[0-9]{2})(?![0-9/-])"),
    ("ssn", "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", "phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone_abroad", "phone", r"(?<![0-9A-Za-z])\+(?=[0-9](?:[ .-]?[0-9]){7,14}(?![ .-]?[0-9]))[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
    ("phone_spaced", "phone", r"(?<![0-9A-Za-z]|[0-9] )[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9A-Za-z]| [0-9])"),
    ("ip", "ip", r"(?<![0-9.vV])(?<!version )(?<!Version )(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("ipv6", "ip", rf"(?<![0-9A-Za-z:.])(?:(?:{_H}:){{7}}{_H}|{_H}(?::{_H}){{0,5}}::(?:{_H}(?::{_H}){{0,5}})?)(?![0-9A-Za-z:])"),
    ("card", "card", r"(?<![0-9A-Za-z])[0-9]{4,19}(?:[ -][0-9]{4,15}){0,4}(?:[ -][0-9]{1,3})?(?![0-9A-Za-z])"),
    ("key_id", "secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("token", "secret", rf"(?<![A-Za-z0-9]){HEADS}[A-Za-z0-9_-]{{20,}}(?![A-Za-z0-9])"),
    ("hex", "secret", r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{32})(?![A-Za-z0-9])"),
]
PATTERN = {name: pattern for name, _, pattern in PATTERNS}
KINDS = list(dict.fromkeys(kind for _, kind, _ in PATTERNS))
#: Kinds told by their check digits: a text's own valid values stand for their pattern in its search, so a longer or an earlier
#: run of characters that doesn't validate hides none. Below, the patterns of values at most as long that begin where one matches.
WITHIN = {
    "iban": [rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{tail}(?![A-Za-z0-9])" for n in range(2, 8) for tail in ("", "(?: ?[A-Z0-9]{1,3})")],
    "card": [rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9A-Za-z])" for n in range(13, 20)],
}
#: Groups of a card's digits: of four at least, but for the last. Rows of shorter numbers, as in tables, are no cards.
GROUPS = r"^[0-9]{4,19}(?:[ -][0-9]{4,15}){0,4}(?:[ -][0-9]{1,3})?$"
#: Cards as they are usually written; other groupings of digits count only where none of these begins within them.
USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: Where none of these occurs, no pattern can match: an @, two digits near each other, a digit and a colon, or a key's head.
MAYBE = rf"@|[0-9][ .)-]{{0,2}}[0-9]|[0-9]:|A[KS]IA|{HEADS}|[0-9A-Fa-f]{{32}}"
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 1800-01-01 and the 400 years of the calendar's cycle from it: 27 * 5411 days.
EPOCH, DAYS_A, DAYS_B = -62091, 27, 5411
#: SSN areas 1-899 but 666, groups 1-99, serials 1-9999.
AREAS, SERIALS = 898, 99 * 9999


def _tagged(key: str, tag: Column | str, r: int) -> Column:
    return F.lit(f"{key}:{tag}:{r}:") if isinstance(tag, str) else F.concat(F.lit(f"{key}:"), tag, F.lit(f":{r}:"))


def _hash(key: str, tag: Column | str, r: int, half: Column) -> Column:
    """Keyed round function: 60 bits of SHA-256."""
    said = F.concat(_tagged(key, tag, r), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column | str, back: bool = False) -> Column:
    """struct<l,r>: the pair (l < a, r < b) permuted; back undoes it. Each round is a lambda, so a half is computed once."""
    sign = -1 if back else 1

    def step(r: int):
        if r % 2 == 0:
            return lambda p: F.struct(F.pmod(p["l"] + sign * F.pmod(_hash(key, tag, r, p["r"]), a), a).alias("l"), p["r"].alias("r"))
        return lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + sign * F.pmod(_hash(key, tag, r, p["l"]), b), b).alias("r"))

    return _rounds(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step, back)


def _rounds(pair: Column, step, back: bool) -> Column:
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        pair = _once(pair, step(r))
    return pair


def _once(value: Column, fn) -> Column:
    """fn(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; 0 for valid numbers."""
    n = F.char_length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("long")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return _sum(F.transform(F.sequence(F.lit(0), n - 1), term)) % 10


def _mod97(digits: Column) -> Column:
    """A string of digits, and capitals that stand for 10 to 35, modulo 97."""
    at = lambda s, c: F.when(c == "", s).when(c >= "A", (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.split(digits, ""), F.lit(0).cast("long"), lambda s, c: at(s, c).cast("long"))


def _iban(value: Column) -> Column:
    """Whether the check digits are right, and the length that of an IBAN if there are letters in the account."""
    v = _only(value, " ")
    right = _mod97(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))) == 1
    return right & (~F.substring(v, 5, 40).rlike("[A-Z]") | F.char_length(v).between(15, 34))


def _spread(value: Column, chars: Column, pattern: str) -> Column:
    """value with its characters that match the class replaced, in order, by those of chars."""
    gaps = F.split(value, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.concat(F.split(chars, ""), F.array(F.lit(""))), lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))), "")


def _only(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "")


def _mixed(value: Column, alphabets: Column, key: str, tag: Column, back: bool) -> Column:
    """A string permuted among those with characters of the same alphabets in the same places.

    A Feistel network whose halves are strings: each round moves the characters of one half, each within the first
    alphabet that has it, by a keystream of the other half.
    """
    pair = _once(value, lambda v: F.struct(F.substring(v, F.lit(1), F.floor(F.char_length(v) / 2).cast("int")).alias("l"), F.substring(v, F.floor(F.char_length(v) / 2).cast("int") + 1, F.char_length(v)).alias("r")))
    sign = -1 if back else 1

    def moved(half: Column, other: Column, r: int) -> Column:
        said = F.sha2(F.concat(_tagged(key, tag, r), other), 512)

        def one(c: Column, i: Column, stream: Column) -> Column:
            k = F.conv(F.substring(stream, (i * 5) % 120 + 1, F.lit(7)), 16, 10).cast("long")

            def within(chars: Column) -> Column:
                at, n = F.call_function("instr", chars, c).cast("long") - 1, F.char_length(chars).cast("long")
                return F.when((c == "") | chars.isNull(), c).otherwise(F.substring(chars, (F.pmod(at + sign * F.pmod(k, n), n) + 1).cast("int"), F.lit(1)))

            return _once(F.get(F.filter(alphabets, lambda chars: F.contains(chars, c)), F.lit(0)), within)

        return _once(said, lambda stream: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(c, i, stream)), ""))

    def step(r: int):
        if r % 2 == 0:
            return lambda p: F.struct(moved(p["l"], p["r"], r).alias("l"), p["r"].alias("r"))
        return lambda p: F.struct(p["l"].alias("l"), moved(p["r"], p["l"], r).alias("r"))

    return _once(_rounds(pair, step, back), lambda p: F.concat(p["l"], p["r"]))


def _day(value: Column) -> Column:
    """Year-month-day, day.month.year or month/day/year as a date, null if there is no such day."""
    return F.when(value.contains("-"), F.try_to_date(value, "yyyy-MM-dd")).when(value.contains("."), F.try_to_date(value, "dd.MM.yyyy")).otherwise(F.try_to_date(value, "MM/dd/yyyy"))


def kind_of(value: Column) -> Column:
    """The kind of a match that also validates, else null: it stays as it is."""
    digits = _only(value, "[^0-9]")
    full = lambda name: value.rlike(f"^(?:{PATTERN[name]})$")
    octets = F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    ssn = ~F.substring(value, 1, 3).isin("000", "666") & (F.substring(value, 1, 1) != "9") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    # at most seven groups beside a ::, and a digit in the first: names in programs are often letters parted by ::
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    six = (~F.contains(value, F.lit("::")) | groups.between(2, 7)) & value.rlike("^[A-Fa-f]*[0-9]")
    return (
        F.when(full("email"), "email")
        .when(full("iban") & _iban(value), "iban")
        .when(full("date"), F.when(_day(value).isNotNull(), "date"))
        .when(full("ssn"), F.when(ssn, "ssn"))
        .when(full("ip"), F.when(octets, "ip"))
        .when(full("ipv6"), F.when(six, "ip"))
        .when(full("key_id") | full("token") | full("hex"), "secret")
        .when(full("phone") | full("phone_spaced"), "phone")
        .when(full("phone_abroad"), F.when(F.char_length(digits).between(8, 15), "phone"))
        .when(full("card"), F.when((luhn(digits) == 0) & (F.char_length(digits).between(13, 19)), "card"))
    )


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The value's pseudonym of the same kind and format; of a null kind, the value itself.

    What is permuted is taken out of the value by its kind, permuted by one of two networks, over pairs of numbers or over
    strings, and put back: an expression holds each network once, whatever the kinds.
    """
    parts = _once(F.struct(value.alias("v"), kind.alias("k"), _only(value, "[^0-9]").alias("d")), lambda s: F.struct(s["v"].alias("v"), s["k"].alias("k"), s["d"].alias("d"), _numbers(s["v"], s["k"], s["d"]).alias("n"), _strings(s["v"], s["k"]).alias("s")))

    def moved(p: Column) -> Column:
        n, s = p["n"], p["s"]
        pair = F.when(n.isNotNull(), feistel(n["l"], n["r"], n["a"], n["b"], key, n["tag"], back))
        text = F.when(s.isNotNull(), _mixed(s["s"], s["alphabets"], key, s["tag"], back))
        return _once(F.struct(p.alias("p"), pair.alias("pair"), text.alias("text")), lambda m: _put_back(m["p"]["v"], m["p"]["k"], m["p"]["d"], m["p"]["n"], m["pair"], m["text"]))

    return F.when(kind.isNull(), value).otherwise(_once(parts, moved))


def _phone_code(value: Column) -> Column:
    return F.when(value.rlike(PHONE_CODE), F.regexp_extract(value, PHONE_CODE, 1)).otherwise("")


def _is_spaced(value: Column) -> Column:
    return value.rlike(f"^(?:{PATTERN['phone_spaced']})$")


def _octets(value: Column) -> Column:
    """Of each octet its number above the base, how many have as many digits, and the base."""
    size = lambda o: F.when(F.char_length(o) == 1, 10).when(F.char_length(o) == 2, 90).otherwise(156)
    base = lambda o: F.when(F.char_length(o) == 1, 0).when(F.char_length(o) == 2, 10).otherwise(100)
    return F.transform(F.split(value, r"\."), lambda o: F.struct((o.cast("long") - base(o)).alias("n"), size(o).cast("long").alias("size"), base(o).cast("long").alias("base")))


def _numbers(value: Column, kind: Column, digits: Column) -> Column:
    """The pair (l < a, r < b) that stands for a value of digits, the length of l in digits, and a tag; null for other kinds."""
    n, account = F.char_length(digits), F.substring(_only(value, " "), 5, 40)
    spaced = (kind == "phone") & _is_spaced(value)
    # strings of digits, permuted among those of their length: a card's but the last, an account's, a phone's after its country code
    run = F.when(kind == "card", F.substring(digits, F.lit(1), n - 1)).when((kind == "iban") & ~account.rlike("[A-Z]"), account)
    run = run.when((kind == "phone") & ~spaced, F.substring(digits, F.char_length(_only(_phone_code(value), "[^0-9]")) + 1, n))
    pair = lambda l, r, a, b, tag, h=None: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(tag).alias("tag"), (F.lit(None) if h is None else h).cast("int").alias("h"))
    half = lambda d: F.floor(F.char_length(d) / 2).cast("int")
    of_run = _once(run, lambda d: F.when(d.isNotNull(), F.struct(F.substring(d, F.lit(1), half(d)).cast("long").alias("l"), F.substring(d, half(d) + 1, F.char_length(d)).cast("long").alias("r"), _ten(half(d)).alias("a"), _ten(F.char_length(d) - half(d)).alias("b"), kind.alias("tag"), half(d).alias("h"))))
    # ssn: over the valid areas, and groups with serials; date: over the days of 1800-2199
    area = F.substring(digits, 1, 3).cast("long")
    rest = (F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1
    ssn = pair(area - 1 - F.when(area > 666, 1).otherwise(0), rest, F.lit(AREAS), F.lit(SERIALS), "ssn")
    date = _once(F.datediff(_day(value), F.lit("1970-01-01").cast("date")) - EPOCH, lambda day: pair(F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), "date"))
    # a phone number in spaced groups: over those whose first two groups begin with 2 to 9
    first = lambda at: F.substring(digits, at, 3).cast("long") - 200
    groups = pair(first(1) * 800 + first(4), F.substring(digits, 7, 4), F.lit(640_000), F.lit(10_000), "phone_spaced")
    # an address: over those with as many digits in each octet
    ip = _once(_octets(value), lambda o: pair(o[0]["n"] * o[1]["size"] + o[1]["n"], o[2]["n"] * o[3]["size"] + o[3]["n"], o[0]["size"] * o[1]["size"], o[2]["size"] * o[3]["size"], "ip"))
    return F.when(kind == "ssn", ssn).when(kind == "date", date).when(spaced, groups).when((kind == "ip") & ~F.contains(value, F.lit(":")), ip).otherwise(of_run)


def _strings(value: Column, kind: Column) -> Column:
    """What of a value is permuted within alphabets, these, and a tag; null for kinds of numbers."""
    take = lambda s, alphabets, tag: F.struct(s.alias("s"), F.array(*map(F.lit, alphabets)).alias("alphabets"), F.lit(tag).alias("tag"))
    account = F.substring(_only(value, " "), 5, 40)
    tail = F.regexp_replace(value, SIX_HEAD, "")
    local, host = (F.regexp_extract(value, MAIL, k) for k in (1, 2))
    secret = F.when(value.rlike(f"^{HEADS}"), take(F.regexp_replace(value, f"^{HEADS}", ""), [DIGITS, UPPERS, LOWERS], "token"))
    secret = secret.when(value.rlike("^A[KS]IA"), take(F.substring(value, 5, 16), [DIGITS + UPPERS], "key"))
    secret = secret.when(value.rlike("[A-F]"), take(value, [DIGITS, "abcdef", "ABCDEF"], "hex")).otherwise(take(value, [DIGITS + "abcdef"], "hex"))
    return (
        F.when((kind == "iban") & account.rlike("[A-Z]"), take(account, [DIGITS, UPPERS], "iban"))
        .when((kind == "ip") & F.contains(value, F.lit(":")), take(_only(tail, ":"), [DIGITS, "abcdef", "ABCDEF"], "ipv6"))
        .when(kind == "email", take(F.concat(_only(local, "[^A-Za-z0-9]"), _only(host, "[^A-Za-z0-9]")), [DIGITS, UPPERS, LOWERS], "email"))
        .when(kind == "secret", secret)
    )


def _put_back(value: Column, kind: Column, digits: Column, n: Column, pair: Column, text: Column) -> Column:
    """The value with what was permuted in its place: what tells a kind stays, check digits follow."""
    two = lambda c, size: F.lpad(c.cast("string"), size, "0")
    run = F.concat(two(pair["l"], n["h"]), two(pair["r"], F.char_length(n["b"].cast("string")) - 1))
    card = _once(run, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
    cc = F.substring(value, 1, 2)
    iban = _once(F.coalesce(text, run), lambda x: F.concat(cc, two(98 - _mod97(F.concat(x, cc, F.lit("00"))), 2), x))
    ssn = F.concat(two(pair["l"] + 1 + F.when(pair["l"] >= 665, 1).otherwise(0), 3), two(F.floor(pair["r"] / 9999) + 1, 2), two(pair["r"] % 9999 + 1, 4))
    spaced = F.concat((F.floor(pair["l"] / 800) + 200).cast("string"), (pair["l"] % 800 + 200).cast("string"), two(pair["r"], 4))
    phone = F.when(_is_spaced(value), spaced).otherwise(F.concat(_only(_phone_code(value), "[^0-9]"), run))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (pair["l"] * DAYS_B + pair["r"] + EPOCH).cast("int"))
    date = _once(day, lambda d: F.when(value.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(value.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
    new = lambda o: [F.floor(pair["l"] / o[1]["size"]) + o[0]["base"], pair["l"] % o[1]["size"] + o[1]["base"], F.floor(pair["r"] / o[3]["size"]) + o[2]["base"], pair["r"] % o[3]["size"] + o[3]["base"]]
    four = _once(_octets(value), lambda o: F.concat_ws(".", *[c.cast("string") for c in new(o)]))
    # the longer addresses: hexadecimal digits in their places, those of the first group's head stay
    six = F.concat(F.regexp_extract(value, SIX_HEAD, 0), _spread(F.regexp_replace(value, SIX_HEAD, ""), text, "[0-9A-Fa-f]"))
    email = F.concat(_spread(F.concat(F.regexp_extract(value, MAIL, 1), F.lit("@"), F.regexp_extract(value, MAIL, 2)), text, "[A-Za-z0-9]"), F.regexp_extract(value, MAIL, 3))
    secret = F.when(value.rlike(f"^{HEADS}"), F.concat(F.regexp_extract(value, f"^{HEADS}", 0), text)).when(value.rlike("^A[KS]IA"), F.concat(F.substring(value, 1, 4), text)).otherwise(text)
    numbers = F.when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "phone", phone)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.when(F.contains(value, F.lit(":")), six).otherwise(four))
        .when(kind == "date", date)
        .when(kind == "secret", secret)
        .when(kind == "iban", _spread(value, iban, "[A-Z0-9]"))
        .when(kind.isin("card", "ssn", "phone"), _spread(value, numbers, "[0-9]"))
        .otherwise(value)
    )


#: A country code; the head of a longer address that stays; the parts of an e-mail address.
PHONE_CODE, SIX_HEAD, MAIL = r"^(\+[0-9]{1,3})[ .(-]", "^[A-Fa-f]*[0-9]", r"^([^@]+)@(.*)(\.[^.]+)$"


def _valid(text: Column, kind: str) -> Column:
    """The distinct values of a kind with check digits that validate, wherever in the text they begin and end, longest first."""
    whole = PATTERN[kind]
    head, body = whole.split(")", 1)
    begun = F.regexp_extract_all(text, F.lit(f"{head})(?=({body}))"), F.lit(1))
    tried = F.flatten(F.transform(begun, lambda v: F.array(*[F.regexp_extract(v, p, 0) for p in WITHIN[kind]])))
    tried = F.filter(F.array_distinct(tried), lambda v: v != "")
    good = F.filter(tried, lambda v: v.rlike(GROUPS) & (luhn(_only(v, "[^0-9]")) == 0) if kind == "card" else _iban(v))
    if kind == "card":
        both = lambda vs: F.struct(vs.alias("all"), F.filter(vs, lambda v: v.rlike(USUAL)).alias("usual"))
        apart = lambda s: F.filter(s["all"], lambda v: v.rlike(USUAL) | ~F.exists(s["usual"], lambda u: F.contains(v, F.substring(u, 1, 9))))
        good = _once(_once(good, both), apart)
    return F.array_sort(good, lambda a, b: F.char_length(b) - F.char_length(a))


def search_of(text: Column) -> Column:
    """The pattern of all values in a text, in order of precedence; null for null and for texts that can't hold one."""

    def one(kind: str, pattern: str) -> Column:
        if kind not in WITHIN:
            return F.lit(f"(?:{pattern})")
        some = lambda vs: F.when(F.size(vs) > 0, F.concat(F.lit("(?:(?<![0-9A-Za-z])(?:"), F.array_join(vs, "|"), F.lit(")(?![0-9A-Za-z]))"))).otherwise("(?!)")
        return _once(_valid(text, kind), some)

    return F.when(text.rlike(MAYBE), F.concat_ws("|", *[one(name, p) for name, _, p in PATTERNS]))


def found(text: Column, search: Column) -> Column:
    """All matches in order, leftmost first; empty where there is no search."""
    none = F.array().cast("array<string>")
    return F.when(search.isNotNull(), F.regexp_extract_all(text, search, F.lit(0))).otherwise(none)


def key_of(spark: SparkSession) -> str:
    """The key that the session's setting names. Where it names none, the public one of the tests, with a warning."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is unset, so the public key of the tests is used: whoever knows it can undo these pseudonyms", stacklevel=2)
    return key or DEMO_KEY


def pseudonymise(docs: DataFrame, key: str, text: str = "text", spans: str | None = None, back: bool = False) -> DataFrame:
    """docs with the validated values in `text` replaced by pseudonyms; the rest of each text stays byte for byte.

    Null texts stay null, empty ones empty; rows, order of columns and other columns stay, whatever their names.
    With `spans`, a column of that name is added: array<struct<kind,value,pseudonym>> in order of the text.
    No shuffle, and no state beyond a row. With `back`, pseudonyms under the same key are taken back, but for
    values whose pseudonym is no longer told apart by its surroundings. An empty key raises.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    if spans and spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"input already has a column {spans}")
    rows = docs.select(F.struct("*").alias("row"), search_of(F.col(text)).alias("any"))  # no other names beside the input's
    t = F.col("row")[text]
    hits = F.transform(found(t, F.col("any")), lambda v: _once(F.struct(v.alias("value"), kind_of(v).alias("kind")), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), pseudonym(s["value"], s["kind"], key, back).alias("pseudonym"))))
    rows = rows.select("row", "any", hits.alias("hits"))
    gaps = F.split(t, F.col("any"), -1)
    made = F.array_join(F.zip_with(gaps, F.col("hits"), lambda g, h: F.concat(g, F.coalesce(h["pseudonym"], F.lit("")))), "")
    new = F.when(F.size("hits") > 0, made).otherwise(t)
    cols = [new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if spans:
        cols.append(F.filter("hits", lambda h: h["kind"].isNotNull()).alias(spans))
    return rows.select(*cols)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after replacement and how many values of each kind were replaced."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark), spans="spans")
    n = lambda kind: F.size(F.filter("spans", lambda h: h["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *[n(k) for k in KINDS], F.size("spans").cast("long").alias("n_pii"))
