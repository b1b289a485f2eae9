"""Operator 4: format-preserving pseudonyms of personal data, in native expressions only.

Method: a text is split at everything that looks like personal data; what validates (Luhn and
mod-97 checks, calendar, number ranges) is replaced by a keyed permutation of its format. The
permutation is a Feistel network over a short array of elements, each with its own base: one
half is added to, element by element and modulo the bases, with values drawn from a keyed digest
of the other half; the halves take turns. That is a bijection for any length and any bases, so
equal values get equal pseudonyms in all documents, different values different ones, and whoever
has the key can turn them back (``decrypt=True``).

| kind  | validated by                   | what is permuted; what stays                            |
|-------|--------------------------------|---------------------------------------------------------|
| card  | 13 to 19 digits, Luhn          | all digits but the check digit, which is made new       |
| iban  | country, mod 97                | the account part, by class; new check digits            |
| ssn   | ranges of area, group, serial  | the three numbers inside those ranges                   |
| phone | shape                          | the last ten digits (all, if fewer); country code stays |
| ip    | four octets                    | the octets                                              |
| date  | calendar                       | the day within its 400-year cycle, so any date is valid |
| email | shape                          | letters and digits of the local part; domain stays      |

Separators, case and digit counts stay (a day or month written with one digit may get two).
Values that do not validate are left alone. Cards and IBANs are read out of whole stretches of groups
(``_read``), since other numbers and words may stand beside them: readings begin and end at
separators, and what is left of a stretch stays as text. The usual layouts (cards of 4-4-4-4, 4-6-5 and 4-6-4
digits, an IBAN of its country's length) come first, then the longest reading. Where numbers beside
a value make readings ambiguous, the pseudonym may by chance allow an earlier one. A date that can only be read month first may give one
that can be read day first; all other values can be turned back from the text alone.

Edge cases: a null text stays null with zero counts; an empty one stays empty. Only texts with a
digit beside another digit or mark, or an ``@``, are scanned. Rows are independent: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common

KEY = "replace this key"
ROUNDS = 10

#: What ends a stretch of groups: an address, date, number or mail of its own behind a blank.
_OTHER = (
    r"\d{1,3}(?:\.\d{1,3}){3}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2}(?![\d-])|\d{3}-\d{2}-\d{4}(?![\d-])"
    r"|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|[A-Z0-9]*+[a-z._%+-]*+[A-Za-z0-9._%+-]*+@|[A-Z]{2}\d{2}[A-Z0-9]{8}"
)
#: The shapes looked for; of cards and IBANs the stretches of groups they stand in.
#: Order matters where shapes overlap.
SHAPES = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{8}})[A-Z0-9]++(?![a-z])(?: (?!{_OTHER})[A-Z0-9]++(?![a-z]))*+",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "card": rf"(?<![\d])\d(?:-?\d| (?!{_OTHER})\d){{12,}}+",
}
PATTERN = "|".join(f"(?:{shape})" for shape in SHAPES.values())
GATE = r"[0-9][0-9.\-/ )(]*[0-9]|@"
#: Usual layouts of cards, as lengths of groups, and lengths of IBANs by country.
LAYOUTS = {"4-4-4-4": 16, "4-6-5": 15, "4-6-4": 14}
IBAN_LENGTHS = {
    int(length): names.split()
    for length, names in {
        "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
        "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG",
        "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV", "29": "BR EG PS QA UA",
        "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU",
    }.items()
}
#: Groups in one value at most: 19 digits apart, or 34 letters and digits apart.
MOST_GROUPS = {"card": 19, "iban": 34}
#: Days of 400 years, their factors, and the first day of a cycle.
CYCLE, CYCLE_FACTORS, CYCLE_START = 146_097, (189, 773), "1800-01-01"


def _ints(*values) -> Column:
    return F.array(*[v.cast("bigint") if isinstance(v, Column) else F.lit(v).cast("bigint") for v in values])


def feistel(values: Column, bases: Column, tweak: Column | str, key: str, decrypt: bool = False, rounds: int = ROUNDS) -> Column:
    """Permute an array of numbers below ``bases``; ``tweak`` keeps kinds of values apart."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    half = F.floor(F.size(values) / 2).cast("int")
    sign = -1 if decrypt else 1

    def drawn(turn: Column, place: Column, other: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), place.cast("string"), F.array_join(other.cast("array<string>"), ","))
        return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("bigint")

    def added(side: Column, first: Column, other: Column, turn: Column) -> Column:
        return F.transform(
            side, lambda x, k: F.pmod(x + sign * (drawn(turn, k, other) % F.get(bases, k + first)), F.get(bases, k + first))
        )

    def step(state: Column, turn: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.when(turn % 2 == 1, F.struct(added(left, F.lit(0), right, turn).alias("left"), right.alias("right"))).otherwise(
            F.struct(left.alias("left"), added(right, half, left, turn).alias("right"))
        )

    start = F.struct(F.slice(values, 1, half).alias("left"), F.slice(values, half + 1, F.size(values) - half).alias("right"))
    turns = F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)) if decrypt else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(turns, start, step, lambda s: F.concat(s["left"], s["right"]))


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _numbers(value: Column) -> Column:
    return F.transform(_chars(value), lambda c: F.when(c.rlike("[0-9]"), c.cast("bigint")).otherwise(F.ascii(F.lower(c)).cast("bigint") - 97))


def _bases(value: Column) -> Column:
    return F.transform(_chars(value), lambda c: F.when(c.rlike("[0-9]"), F.lit(10).cast("bigint")).otherwise(F.lit(26).cast("bigint")))


def _spelled(value: Column, numbers: Column) -> Column:
    """Numbers as letters and digits of the same classes as those of ``value``."""
    def one(c: Column, n: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), n.cast("string"))
            .when(c.rlike("[A-Z]"), F.char(n + 65))
            .otherwise(F.char(n + 97))
        )

    return F.array_join(F.zip_with(_chars(value), numbers, one), "")


def _permuted(value: Column, kind: str, key: str, decrypt: bool) -> Column:
    """A string of letters and digits, permuted within its classes."""
    return _spelled(value, feistel(_numbers(value), _bases(value), kind, key, decrypt))


def _laid_out(shape: Column, content: Column, taken: str) -> Column:
    """``content`` put where ``shape`` has characters of the class ``taken``."""
    place = lambda k: F.length(F.regexp_replace(F.substring(shape, F.lit(1), k), f"[^{taken}]", ""))
    return F.array_join(
        F.transform(_chars(shape), lambda c, k: F.when(c.rlike(f"[{taken}]"), F.substring(content, place(k + 1), F.lit(1))).otherwise(c)), ""
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its check digit included."""
    doubled = lambda d, k: F.when(k % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.reverse(_numbers(digits)), doubled), F.lit(0).cast("bigint"), lambda a, b: a + b)


def _mod97(moved: Column) -> Column:
    """Digits and letters (A = 10) read as one number, modulo 97."""
    wide = F.transform(_chars(moved), lambda c: F.when(c.rlike("[0-9]"), c.cast("bigint")).otherwise(F.ascii(c).cast("bigint") - 55))
    return F.aggregate(wide, F.lit(0).cast("bigint"), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


def _valid_card(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)


def _layout(match: Column) -> Column:
    """Lengths of the groups of digits, as ``4-4-4-4``."""
    return F.array_join(F.transform(F.split(match, "[ -]"), lambda g: F.length(g).cast("string")), "-")


def _card(match: Column, key: str, decrypt: bool) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")

    def permuted(all_digits: Column) -> Column:
        payload = _permuted(F.substring(all_digits, F.lit(1), F.length(all_digits) - 1), "card", key, decrypt)
        check = lambda p: (F.lit(10) - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10
        return _bound(payload, lambda p: F.concat(p, check(p).cast("string")))

    # A value that goes on behind a usual layout is permuted until that part alone is no card, as before.
    longer = F.lit(0)
    for layout, length in LAYOUTS.items():
        longer = F.when(_layout(match).startswith(layout + "-"), length).otherwise(longer)
    mistaken = lambda d: (longer > 0) & (luhn_sum(F.substring(d, F.lit(1), longer)) % 10 == 0)
    new = F.aggregate(
        F.when(longer > 0, F.sequence(F.lit(1), F.lit(12))).otherwise(F.array(F.lit(1))),
        digits,
        lambda d, turn: F.when((turn == 1) | mistaken(d), permuted(d)).otherwise(d),
    )
    return _bound(new, lambda d: _laid_out(match, d, "0-9"))


def _valid_iban(match: Column) -> Column:
    packed = F.regexp_replace(match, " ", "")
    return packed.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$") & (_mod97(F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))) == 1)


def _country_long(match: Column) -> Column:
    """Whether an IBAN is as long as those of its country."""
    return F.length(F.regexp_replace(match, " ", "")) == F.coalesce(
        *(F.when(F.substring(match, 1, 2).isin(names), length) for length, names in IBAN_LENGTHS.items()), F.lit(0)
    )


def _iban(match: Column, key: str, decrypt: bool) -> Column:
    packed = F.regexp_replace(match, " ", "")
    country, account = F.substring(packed, 1, 2), F.substring(packed, F.lit(5), F.length(packed))
    fresh = _permuted(account, "iban", key, decrypt)
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return _bound(_bound(fresh, lambda new: F.concat(country, check(new), new)), lambda new: _laid_out(match, new, "A-Z0-9"))


def _ssn(match: Column, key: str, decrypt: bool) -> Column:
    area, group, serial = (F.split_part(match, F.lit("-"), F.lit(k)).cast("bigint") for k in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    # Areas 1 to 899 without 666, numbered from 0.
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel(_ints(place, group - 1, serial - 1), _ints(898, 99, 9999), "ssn", key, decrypt)
    new_area = F.when(F.get(new, F.lit(0)) >= 665, F.get(new, F.lit(0)) + 2).otherwise(F.get(new, F.lit(0)) + 1)
    return F.when(valid, F.format_string("%03d-%02d-%04d", new_area, F.get(new, F.lit(1)) + 1, F.get(new, F.lit(2)) + 1))


def _phone(match: Column, key: str, decrypt: bool) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    kept = F.greatest(F.length(digits) - 10, F.lit(0))
    tail = F.substring(digits, kept + 1, F.lit(10))
    return _laid_out(match, F.concat(F.substring(digits, F.lit(1), kept), _permuted(tail, "phone", key, decrypt)), "0-9")


def _ip(match: Column, key: str, decrypt: bool) -> Column:
    octets = F.split(match, r"\.").cast("array<bigint>")
    new = feistel(octets, _ints(256, 256, 256, 256), "ip", key, decrypt)
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(new.cast("array<string>"), "."))


def _date(match: Column, key: str, decrypt: bool) -> Column:
    iso = match.rlike("^[0-9]{4}-")
    parts = F.split(match, "[-./]")
    one, two, three = (F.get(parts, F.lit(k)) for k in range(3))
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day_first, month_first = made(three, two, one), made(three, one, two)
    value = F.when(iso, made(one, two, three)).otherwise(F.coalesce(day_first, month_first))
    days = F.date_diff(value, F.lit(CYCLE_START).cast("date")).cast("bigint")
    place = F.pmod(days, F.lit(CYCLE))
    big, small = CYCLE_FACTORS
    new = feistel(_ints(F.floor(place / small), place % small), _ints(big, small), "date", key, decrypt)
    moved = F.date_add(F.lit(CYCLE_START).cast("date"), (days - place + F.get(new, F.lit(0)) * small + F.get(new, F.lit(1))).cast("int"))
    mark = F.regexp_extract(match, "[./]", 0)
    wide = lambda part, long, brief: F.when(F.length(part) == 2, F.date_format(moved, long)).otherwise(F.date_format(moved, brief))
    year = F.date_format(moved, "yyyy")
    short = F.when(day_first.isNotNull(), F.concat(wide(one, "dd", "d"), mark, wide(two, "MM", "M"), mark, year)).otherwise(
        F.concat(wide(one, "MM", "M"), mark, wide(two, "dd", "d"), mark, year)
    )
    return F.when(value.isNotNull() & (F.year(value) > 0), F.when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(short))


def _email(match: Column, key: str, decrypt: bool) -> Column:
    local = F.substring_index(match, "@", 1)
    plain = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    return F.concat(_laid_out(local, _permuted(plain, "email", key, decrypt), "A-Za-z0-9"), F.lit("@"), F.substring_index(match, "@", -1))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(match: Column) -> Column:
    """Which shape a match of the joint pattern has: the first that matches it whole."""
    found = F.lit(None).cast("string")
    for kind, shape in reversed(SHAPES.items()):
        found = F.when(match.rlike(f"^(?:{shape})$"), kind).otherwise(found)
    return found


def _piece(kind: Column | str, old: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), old.alias("old"))


def _read(stretch: Column, kind: str, left: str, valid) -> Column:
    """A stretch of groups as pieces: from the left, at each group the longest valid reading that ends
    with a group; groups in none stay together as pieces of kind ``left``."""
    groups = F.regexp_extract_all(stretch, F.lit("[A-Z0-9]+[ -]?|[ -]"), F.lit(0))

    def reading(at: Column, group: Column) -> Column:
        """How many groups, from this one on, the reading takes; 0 for none."""
        most = F.least(F.size(group) - at, F.lit(MOST_GROUPS[kind[:4]]))
        joined = lambda n: F.regexp_replace(F.array_join(F.slice(group, at + 1, n), ""), "[ -]$", "")
        some = F.get(F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: valid(joined(n))), F.lit(0))
        return F.when(F.get(group, at).rlike("^[A-Z0-9]"), F.coalesce(some, F.lit(0))).otherwise(F.lit(0))

    def step(state: Column, token: Column) -> Column:
        """Adds a group to the open piece, or opens a piece."""
        opens = (state["todo"] == 0) & (token["n"] > 0)
        goes_on = state["todo"] > 0
        body = F.regexp_replace(token["text"], "[ -]$", "")
        mark = F.substring(token["text"], F.length(body) + 1, F.lit(1))
        todo = F.when(opens, token["n"]).otherwise(state["todo"]) - 1
        value = F.concat(F.when(opens, F.lit("")).otherwise(state["open"]), F.when(todo == 0, body).otherwise(token["text"]))
        before = F.when(opens, F.concat(state["out"], F.array(_piece(left, state["open"])))).otherwise(state["out"])
        taken = F.struct(
            todo.alias("todo"),
            F.when(todo == 0, F.concat(before, F.array(_piece(kind, value)))).otherwise(before).alias("out"),
            F.when(todo == 0, mark).otherwise(value).alias("open"),
        )
        plain = F.struct(F.lit(0).alias("todo"), state["out"].alias("out"), F.concat(state["open"], token["text"]).alias("open"))
        return F.when(opens | goes_on, taken).otherwise(plain)

    tokens = F.transform(groups, lambda text, at: F.struct(text.alias("text"), reading(at, groups).alias("n")))
    start = F.struct(F.lit(0).alias("todo"), F.array().cast("array<struct<kind:string,old:string>>").alias("out"), F.lit("").alias("open"))
    return F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], F.array(_piece(left, s["open"]))))


#: Readings of stretches in their order: which pieces are read, as what, and what their other groups are then.
_READINGS = (
    ("iban", "iban!", "iban?", lambda old: _country_long(old) & _valid_iban(old)),
    ("iban?", "iban!", "card", lambda old: _valid_iban(old)),
    ("card", "card!", "card?", lambda old: _layout(old).isin(*LAYOUTS) & _valid_card(old)),
    ("card?", "card!", "", lambda old: _valid_card(old)),
)


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, decrypt: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, the new ``text``, and per kind how many values were replaced."""
    docs = common.narrow(df, id_col, text_col)
    gated = F.col("text").rlike(GATE)
    matches = F.when(gated, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(gated, F.split("text", PATTERN, -1)).otherwise(F.array("text"))
    cut = docs.select("doc_id", "text", between.alias("between"), F.transform(matches, lambda m: F.array(_piece(_kind(m), m))).alias("pieces"))
    for wanted, kind, left, valid in _READINGS:
        read = lambda p: F.when(p["kind"] == wanted, _read(p["old"], kind, left, valid)).otherwise(F.array(p))  # noqa: B023, E731
        cut = cut.withColumn("pieces", F.transform("pieces", lambda pieces: F.flatten(F.transform(pieces, read))))  # noqa: B023

    def rewritten(piece: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, maker in _MAKERS.items():
            new = F.when(piece["kind"] == (name + "!" if name in MOST_GROUPS else name), maker(piece["old"], key, decrypt)).otherwise(new)
        return F.struct(F.regexp_replace(piece["kind"], "!", "").alias("kind"), new.alias("new"), piece["old"].alias("old"))

    done = cut.withColumn("done", F.transform("pieces", lambda pieces: F.transform(pieces, rewritten)))
    spelled = lambda pieces: F.array_join(F.transform(pieces, lambda x: F.coalesce(x["new"], x["old"])), "")
    tails = F.concat(F.transform("done", spelled), F.array(F.lit("")))
    text = F.array_join(F.zip_with("between", tails, lambda a, b: F.concat(a, b)), "")

    def count(kind: str) -> Column:
        return F.size(F.filter(F.flatten("done"), lambda x: (x["kind"] == kind) & x["new"].isNotNull())).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in SHAPES]
    return done.select("doc_id", F.when(F.col("text").isNotNull(), text).alias("text"), *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymised texts of all documents, with counts by kind."""
    return pseudonymise(common.table(spark, sf_dir, "documents"))
