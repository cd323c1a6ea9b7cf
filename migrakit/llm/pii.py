"""PII: format-preserving pseudonyms from keyed Feistel networks.

Values that pass their format's own check are replaced by another valid value of
the same format; the replacement is a permutation under a secret key, so equal
values become equal pseudonyms in every document, different values different
ones, and the key's holder can invert it.

Kinds: payment cards (13-19 digits in one run, or in groups of 4-4-4-4 or
4-6-5; Luhn; first digit kept, check digit set anew), North American phone numbers, IPv4 addresses, social security numbers,
IBANs (of
the country's length, or of any length if none of that stands there; modulo 97; digits permuted, letters kept, check digits set anew),
calendar dates of the years 1800-2199 (year first or day first, with "-", "/" or
"."; month first where it is no date otherwise: the 57,600 = 240 x 240 days up to the 12th of a
month are permuted among themselves, and so are the 88,497 = 9 x 9,833 above it, so the date keeps one
pseudonym in all formats) and the letters and digits of an e-mail
address's local part.  Punctuation stays where it stood; a number that fails its
check stays as it is.

A value is a pair (l, r) in Z_a x Z_b; eight rounds add a keyed hash of one half
to the other, modulo the half's size, so every pair of sizes is permuted
exactly, without cycle walking.  Local parts use the same network letter by letter.

All of it is column expressions in one narrow stage: the text is cut where one
regular expression finds that a value may begin, also inside another such match; from
left to right, what passes its check is replaced, and the pieces are joined.  So a
match that fails hides no value in it.  On the way back, groups before a card that happen to
make a valid number with the pseudonym's first groups are taken first (one in ten
of the cards that follow four such digits): those are not inverted.
The key reaches the rows through a one-row frame and is no literal of the plan.
Nothing is shuffled, so keys and sources cannot be hot.

Defined results: a null text stays null, with no values; empty and repeated rows
are like others; texts without a digit are not searched; the caller's columns
travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import records
from .common import packed_columns

ROUNDS = 8
#: Values joined at a time: a text of n values costs about n * BLOCK + (n / BLOCK)^2 copied references.
BLOCK = 256
_D0, _D1 = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Length of an IBAN by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA YE", 30: "JO KW MU", 31: "MT SC",
    32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """The country's length, in groups of four or in one run; else any length."""
    fixed = "|".join(f"(?:{cc.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                     + _D1 for n, cc in IBAN_LENGTHS.items())
    return rf"(?:{fixed}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"


#: Fixed formats, tried in this order; the check decides whether a match is a value.
FORMATS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "iban": _iban_pattern(),
    "ymd": r"[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}",
    "dmy": r"[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/|-[0-9]{2}-)[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "phone": r"(?:\+?1[ .\-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})",
}
_EDGE = {"ip": (_D0 + r"(?<![0-9]\.)", _D1), "phone": (r"(?<![0-9A-Za-z+])", _D1), "email": (r"(?<![A-Za-z0-9._%+\-])", _D1)}
VALUE = "(?:" + "|".join(f"{_EDGE.get(k, (_D0, _D1))[0]}{p}{_EDGE.get(k, (_D0, _D1))[1]}" for k, p in FORMATS.items()) + ")"


def _hash(key: Column, tweak: str, i: Column, half: Column) -> Column:
    """60 bits of a keyed hash."""
    s = F.sha2(F.concat(key, F.lit(f"|{tweak}|"), i.cast("string"), F.lit("|"), half.cast("string"), F.lit("|"), key), 256)
    return F.conv(F.substring(s, 1, 15), 16, 10).cast("long")


def _permute(key: Column | str, tweak: str, l: Column, r: Column, a: Column, b: Column, back: bool = False) -> Column:  # noqa: E741
    """struct(l, r) permuted in Z_a x Z_b.  ``key``: a column, or the key itself."""
    key = F.lit(key) if isinstance(key, str) else key
    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    sign = -1 if back else 1

    def step(s, i):
        left = F.pmod(s["l"] + F.lit(sign) * F.pmod(_hash(key, tweak, i, s["r"]), a), a)
        right = F.pmod(s["r"] + F.lit(sign) * F.pmod(_hash(key, tweak, i, s["l"]), b), b)
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step)


def _chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _num(s: Column) -> Column:
    return s.try_cast("long")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(v: Column, new: Column) -> Column:
    """``v`` with its alphanumerics replaced, in turn, by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("[0-9A-Za-z]"), F.substr(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + F.when(c.rlike("[0-9A-Za-z]"), 1).otherwise(0)).alias("at"))
    return F.aggregate(_chars(v), start, step, lambda s: s["out"])


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _halves(key: Column, tweak: str, digits: Column, back: bool) -> Column:
    """A digit string of at most 36 permuted among those of its length."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    p = _permute(key, tweak, F.coalesce(_num(F.substr(digits, F.lit(1), u)), F.lit(0)),
                 _num(F.substr(digits, u + 1, n)), _power10(u), _power10(n - u), back)
    return F.transform(F.array(p), lambda s: F.concat(F.when(u > 0, _pad(s["l"], u)).otherwise(""), _pad(s["r"], n - u)))[0]


def _luhn_sum(digits: Column, check: bool) -> Column:
    """Sum of the digits from the right, every second one doubled; ``check``:
    the last one is the check digit."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(not check).alias("twice"))
    step = lambda s, c: F.struct(
        (s["sum"] + F.when(s["twice"], (c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int"))
         .otherwise(c.cast("int"))).alias("sum"), (~s["twice"]).alias("twice"))
    return F.aggregate(F.reverse(_chars(digits)), start, step, lambda s: s["sum"])


def _mod97(s: Column) -> Column:
    """A number with letters A = 10 .. Z = 35, modulo 97."""
    code = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(_chars(s), F.lit(0), lambda m, c: ((m * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97).cast("int"))


def _date_in(y: Column, m: Column, d: Column) -> Column:
    return F.when(F.substr(y, F.lit(1), F.lit(2)).isin("18", "19", "20", "21"), F.concat_ws("-", y, m, d).try_cast("date"))


def _new_date(key: Column, date: Column, back: bool) -> Column:
    """A day of 1800-2199 permuted among those up to the 12th of a month, or among those above
    it: so a date that is one only month first stays so, and a date has one pseudonym in
    every format."""
    low = (F.year(date) - 1800) * 144 + (F.month(date) - 1) * 12 + F.dayofmonth(date) - 1
    p = _permute(key, "low", (low / 240).cast("long"), low % 240, F.lit(240), F.lit(240), back)
    early = F.transform(F.transform(F.array(p), lambda s: (s["l"] * 240 + s["r"]).cast("int")), lambda i: F.make_date(
        (i / 144).cast("int") + 1800, (i / 12).cast("int") % 12 + 1, i % 12 + 1))[0]
    return F.when(F.dayofmonth(date) <= 12, early).otherwise(_late_date(key, date, back))


def _late_date(key: Column, date: Column, back: bool) -> Column:
    """A day above the 12th permuted among those of 1800-2199."""
    first = F.lit("1800-01-01").cast("date")
    months = (F.year(date) - 1800) * 12 + F.month(date)                   # so many times were 12 days left out
    at = F.datediff(date, first) - months * 12
    p = _permute(key, "month", (at / 9833).cast("long"), at % 9833, F.lit(9), F.lit(9833), back)
    before = lambda k: F.datediff(F.add_months(first, k), first) - k * 12

    def out(i):
        # The month is within one of the place in 4,800 equal months.
        k = (i * 4800 / 88497).cast("int")
        k = k - 1 + (before(k) <= i).cast("int") + (before(k + 1) <= i).cast("int")
        return F.date_add(first, i + (k + 1) * 12)

    return F.transform(F.transform(F.array(p), lambda s: (s["l"] * 9833 + s["r"]).cast("int")), out)[0]


def _letters(key: Column, v: Column, back: bool) -> Column:
    """A string permuted among those of the same kinds of letters, by halves."""
    n = F.length(v)
    u = (n / 2).cast("int")
    sign = -1 if back else 1

    def shifted(s: Column, i: Column, other: Column) -> Column:
        h = F.sha2(F.concat(key, F.lit("|mail|"), i.cast("string"), F.lit("|"), other, F.lit("|"), key), 256)
        def one(c, j):
            by = F.conv(F.substr(h, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
            turn = lambda first, size: F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)
            return (F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26))
                    .when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c))
        return F.array_join(F.transform(_chars(s), one), "")

    def step(s, i):
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(s["l"], i, s["r"])).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(shifted(s["r"], i, s["l"])).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.substr(v, F.lit(1), u).alias("l"), F.substr(v, u + 1, n).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["l"], s["r"]))


def _rules(key: Column, v: Column, back: bool) -> list[tuple[str, Column, Column, Column]]:
    """(kind, looks like it, is valid, pseudonym) in the order of FORMATS."""
    whole = lambda k: v.rlike(f"^(?:{FORMATS[k]})$")
    d, n = _digits(v), F.length(_digits(v))
    cut = lambda a, k: F.substr(d, F.lit(a), F.lit(k))
    flat = F.replace(v, F.lit(" "), F.lit(""))
    head, body = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
    body2 = _refill_digits(body, _halves(key, "iban", _digits(body), back))
    iban = F.transform(F.array(body2), lambda b: F.concat(head, _pad(F.lit(98) - _mod97(F.concat(b, head, F.lit("00"))), 2), b))[0]
    ymd = _date_in(cut(1, 4), cut(5, 2), cut(7, 2))
    dmy = _date_in(cut(5, 4), cut(3, 2), cut(1, 2))
    mdy = F.when(~v.contains("."), _date_in(cut(5, 4), cut(1, 2), cut(3, 2)))
    year_first = whole("ymd")
    date = F.when(year_first, ymd).otherwise(F.coalesce(dmy, mdy))
    new_date = F.transform(F.array(_new_date(key, date, back)), lambda t: F.when(
        year_first, F.replace(F.date_format(t, "yyyy-MM-dd"), F.lit("-"), F.substr(v, F.lit(5), F.lit(1)))).otherwise(F.replace(
            F.when(dmy.isNotNull(), F.date_format(t, "dd.MM.yyyy")).otherwise(F.date_format(t, "MM.dd.yyyy")),
            F.lit("."), F.substr(v, F.lit(3), F.lit(1)))))[0]
    ssn_l = (_num(cut(1, 3)) - 1 - F.when(_num(cut(1, 3)) > 666, 1).otherwise(0)) * 99 + _num(cut(4, 2)) - 1
    ssn = F.transform(F.array(_permute(key, "ssn", ssn_l, _num(cut(6, 4)) - 1, F.lit(88902), F.lit(9999), back)), lambda s: F.concat_ws(
        "-", _pad((s["l"] / 99).cast("long") + 1 + F.when(s["l"] >= 665 * 99, 1).otherwise(0), 3), _pad(s["l"] % 99 + 1, 2), _pad(s["r"] + 1, 4)))[0]
    octet = lambda i: _num(F.element_at(F.split(v, r"\."), i))
    ip = F.transform(F.array(_permute(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), back)),
                     lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in ((s[h] / 256).cast("long"), s[h] % 256)]))[0]
    ten = F.substr(d, n - 9, F.lit(10))
    at = lambda a, k: _num(F.substr(ten, F.lit(a), F.lit(k)))
    phone = F.transform(F.array(_permute(key, "phone", (at(1, 3) - 200) * 100 + at(7, 2), (at(4, 3) - 200) * 100 + at(9, 2),
                                         F.lit(80000), F.lit(80000), back)), lambda s: F.concat(
        F.substr(d, F.lit(1), n - 10), _pad((s["l"] / 100).cast("long") + 200, 3), _pad((s["r"] / 100).cast("long") + 200, 3),
        _pad(s["l"] % 100, 2), _pad(s["r"] % 100, 2)))[0]
    inner = F.concat(F.substr(d, F.lit(1), F.lit(1)), _halves(key, "card", F.substr(d, F.lit(2), n - 2), back))
    card = F.transform(F.array(inner), lambda c: F.concat(c, ((10 - _luhn_sum(c, False) % 10) % 10).cast("string")))[0]
    user = F.substring_index(v, "@", 1)
    return [
        ("email", whole("email"), F.lit(True), F.concat(_letters(key, user, back), F.lit("@"), F.substr(v, F.length(user) + 2, F.length(v)))),
        ("iban", whole("iban"), _mod97(F.concat(body, F.substr(flat, F.lit(1), F.lit(4)))) == 1, _refill(v, iban)),
        ("date", year_first | whole("dmy"), date.isNotNull(), new_date),
        ("ssn", whole("ssn"), _num(cut(1, 3)).between(1, 899) & (cut(1, 3) != "666") & (cut(4, 2) != "00") & (cut(6, 4) != "0000"), ssn),
        ("ip", whole("ip"), F.forall(F.split(v, r"\."), lambda o: (_num(o) <= 255) & ((o == "0") | ~o.startswith("0"))), ip),
        ("phone", whole("phone"), F.lit(True), _refill(v, phone)),
        ("card", whole("card"), (_luhn_sum(d, True) % 10 == 0) & (F.length(F.replace(d, F.lit("0"), F.lit(""))) > 0), _refill(v, card)),
    ]


def _refill_digits(v: Column, new: Column) -> Column:
    """``v`` with its digits replaced, in turn, by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substr(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("at"))
    return F.aggregate(_chars(v), start, step, lambda s: s["out"])


def pseudonym(v: Column, key: Column, back: bool = False) -> Column:
    """struct(kind, value) of a matched string; kind is null and the value
    unchanged if no format's check passes."""
    case = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, like, valid, new in reversed(_rules(key, v, back)):
        case = F.when(like, F.when(valid, F.struct(F.lit(kind).alias("kind"), new.alias("value")))).otherwise(case)
    return F.coalesce(case, F.struct(F.lit(None).cast("string").alias("kind"), v.alias("value")))


def _pieces(text: Column, begin: str) -> Column:
    """The text from every place where ``begin`` matches to the next one."""
    cut = F.split(text, begin, -1)
    return F.slice(cut, F.size(cut) - F.regexp_count(text, F.lit(begin)) + 1, F.regexp_count(text, F.lit(begin)))


def pseudonymise(docs: DataFrame, key: str, back: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(row, text, kinds): ``row`` holds the columns ``keep`` (default all), ``text`` the text
    with pseudonyms in place of the values, ``kinds`` the kind of every value in
    order.  ``back`` inverts a run with the same key."""
    text = F.col("text").cast("string")
    secret = records(docs.sparkSession, [(key,)], "key string").scalar()      # not a literal: a plan shows no key
    docs = docs.select(packed_columns(docs, keep), text.alias("text"), secret.alias("_key"))
    some = F.col("text").rlike("[0-9]|@")
    begin = f"(?=({VALUE}))"
    found = F.when(some, F.zip_with(F.regexp_extract_all("text", F.lit(begin), F.lit(1)), _pieces(F.col("text"), begin), lambda v, g: F.struct(
        pseudonym(v, F.col("_key"), back).alias("new"), F.length(v).alias("n"), g.alias("piece"))))
    none = F.array().cast("array<struct<new:struct<kind:string,value:string>,n:int,piece:string>>")
    # One row per text through a one-element generator: the values are worked out once.
    cut = docs.select("row", "text", F.explode(F.array(F.coalesce(found, none))).alias("found"))

    def step(s, f):
        """``over``: characters of the next pieces that belong to a value already replaced."""
        size, taken = F.length(f["piece"]), (s["over"] == 0) & f["new"]["kind"].isNotNull()
        over = F.when(taken, f["n"]).otherwise(s["over"])
        return F.struct(
            F.concat(s["parts"], F.array(F.concat(F.when(taken, f["new"]["value"]).otherwise(""), F.substr(f["piece"], over + 1, size)))).alias("parts"),
            F.when(taken, F.concat(s["kinds"], F.array(f["new"]["kind"]))).otherwise(s["kinds"]).alias("kinds"),
            F.greatest(over - size, F.lit(0)).alias("over"))

    strings, lists = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def block(s, at):
        """``BLOCK`` values at a time: an array that grows by one is copied whole, so it is kept short."""
        start = F.struct(strings.alias("parts"), strings.alias("kinds"), s["over"].alias("over"))
        done = F.transform(F.array(F.aggregate(F.slice("found", at, F.lit(BLOCK)), start, step)), lambda b: F.struct(
            F.concat(s["parts"], F.array(F.array_join(b["parts"], ""))).alias("parts"),
            F.concat(s["kinds"], F.array(b["kinds"])).alias("kinds"), b["over"].alias("over")))
        return done[0]

    start = F.struct(strings.alias("parts"), lists.alias("kinds"), F.lit(0).alias("over"))
    blocks = F.when(F.size("found") > 0, F.sequence(F.lit(1), F.size("found"), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    told = cut.select("row", "text", F.explode(F.array(F.aggregate(blocks, start, block))).alias("told"), F.aggregate(
        "found", F.lit(0), lambda n, f: n + F.length(f["piece"])).alias("rest"))
    whole = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("rest")), F.array_join("told.parts", ""))
    return told.select("row", F.when(F.size("told.parts") > 0, whole).otherwise(F.col("text")).alias("text"), F.flatten("told.kinds").alias("kinds"))
