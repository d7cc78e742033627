"""Format-preserving pseudonyms of personal data, as SQL expressions only.

One pattern finds candidates in whole texts. A candidate that passes its kind's validation is
replaced by a keyed pseudonym of the same kind and layout; others stay as they are.

==========  =========================================  ==========================================
kind        validation                                 pseudonym
==========  =========================================  ==========================================
card        13 to 19 digits, Luhn sum                  permuted digits with a new check digit
phone       North American plan or +country code and   permuted digits within the same plan
            number of 7 to 15 digits                   or after the same country code
ssn         area, group and serial in their ranges     permuted within those ranges
iban        two letters, mod-97 remainder              permuted account digits, new check digits
ip          four octets of 0 to 255                    permuted 32 bits
date        a day of the calendar, 1900 to 2099        a day of the same range and layout
email       local part, domain with a dot              keyed local part, class by class
==========  =========================================  ==========================================

Numbers and dates go through a Feistel network of ROUNDS rounds over their digits (or bits), whose
round function is SHA-256 of key, kind, round and the other half. Where the permuted number is not
valid in its format, it is permuted again until it is (cycle walking), so within a kind and layout
pseudonyms are one-to-one: equal values stay equal across documents, different ones different. The
layout (separators, order of a date's parts) is kept and isn't part of what is permuted.

An IBAN's letters (of the bank) and an address's domain stay. A local part comes from a hash, so two may get one
pseudonym, by chance of its letters; nothing else can. A number that WALKS steps don't bring into its format gets
zeros for digits.

Defined cases: a null text stays null with count 0; an empty text stays empty; a number inside a
longer run of letters or digits isn't a candidate; repeated rows get equal answers; other columns
are kept by ``pseudonymize``.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
#: Times that a number is permuted at most before its digits are masked; the least dense format (dates) is missed with probability below 1e-30.
WALKS = 256
_EDGE, _END = r"(?<![\w.+@-])", r"(?![\w@-]|\.\d)"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-][A-Za-z0-9.-]{0,250}\.[A-Za-z0-9-]{1,63}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ .-]?|1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]?\d{4}|(?:\+1[ .-]?|1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d(?:[ .-]?\d){6,14}",
    "card": r"\d{4}(?:[ -]?\d{4}){3}[ -]\d{1,3}(?![ .-]\d)|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5}",
}
#: A date is followed by its time in a timestamp.
PATTERN = _EDGE + "(?:(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")" + _END + r"|\d{4}-\d{2}-\d{2}(?=T\d))"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _pseudo(key: str, kind: str, i: Column, half: Column, size: Column) -> Column:
    """A number below ``size`` (at most 10^12) from key, kind, round and half."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") % size


def feistel(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Keyed permutation of the decimal strings of any one length from 2 to 36 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), u).alias("a"), F.substring(digits, u + 1, n - u).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        width = F.length(s["a"])
        size = F.rpad(F.lit("1"), (width + 1).cast("int"), F.lit("0")).cast("decimal(38,0)")
        moved = (s["a"].cast("decimal(38,0)") + _pseudo(key, kind, i, s["b"], F.least(size, F.lit(10**12))).cast("decimal(38,0)")) % size
        return F.struct(s["b"].alias("a"), F.lpad(moved.cast("string"), width, "0").alias("b"))

    def back(s: Column, i: Column) -> Column:
        width = F.length(s["b"])
        size = F.rpad(F.lit("1"), (width + 1).cast("int"), F.lit("0")).cast("decimal(38,0)")
        moved = (s["b"].cast("decimal(38,0)") + size - _pseudo(key, kind, i, s["a"], F.least(size, F.lit(10**12))).cast("decimal(38,0)")) % size
        return F.struct(F.lpad(moved.cast("string"), width, "0").alias("a"), s["a"].alias("b"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, start, back if inverse else turn, lambda s: F.concat(s["a"], s["b"]))


def _walk(value: Column, permute, ok) -> Column:
    """``permute`` applied once, and again until ``ok``; null if that takes over WALKS times."""
    step = lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(permute(s["v"])), lambda v: F.struct(v.alias("v"), ok(v).alias("done")))[0])
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, step, lambda s: F.when(s["done"], s["v"]))


def _laid_out(digits: Column, layout: Column) -> Column:
    """``layout`` with its digits replaced, in order, by ``digits``; null if these are."""
    at = lambda i: F.length(_digits(F.substring(layout, F.lit(1), i)))
    one = lambda i: F.substring(layout, i, F.lit(1))
    put = F.transform(F.sequence(F.lit(1), F.length(layout)), lambda i: F.when(one(i).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(one(i)))
    return F.when(digits.isNotNull(), F.array_join(put, ""))


def _masked(m: Column) -> Column:
    """What stands for a value that no pseudonym was found for."""
    return F.regexp_replace(F.regexp_replace(m, "[0-9]", "0"), "[A-Za-z]", "x")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits in which every second one from the right is doubled, beginning with the ``doubled``-th (0: the last)."""
    one = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == doubled, F.floor(one(i) * 2 / 10) + one(i) * 2 % 10).otherwise(one(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0).cast("bigint"), lambda s, i: s + part(i))


def is_card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0) & ~d.rlike(r"^0+$")


def card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    full = F.transform(F.array(body), lambda b: F.concat(b, ((F.lit(10) - _luhn_sum(b, 0) % 10) % 10).cast("string")))[0]
    return _laid_out(full, m)


def _plan(d: Column) -> Column:
    """A North American number without its country code."""
    return d.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")


def is_phone(m: Column) -> Column:
    d = _digits(m)
    return F.when(_national(m), F.length(d).isin(10, 11)).otherwise(m.startswith("+") & F.length(d).between(7, 15))


def _national(m: Column) -> Column:
    return m.rlike(r"^(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$")


# Country calling codes of one and of two digits; the others have three.
_SHORT_CODES = r"^[17]"
_TWO_DIGIT_CODES = r"^(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def phone(m: Column, key: str) -> Column:
    """The last ten digits of a North American number, within the plan if the number was; else all digits after the country's code."""
    d = _digits(m)
    code = F.when(d.rlike(_SHORT_CODES), 1).when(d.rlike(_TWO_DIGIT_CODES), 2).otherwise(3)
    head = F.when(_national(m), F.length(d) - 10).otherwise(code).cast("int")
    tail = F.substring(d, head + 1, F.length(d) - head)
    own = F.transform(F.array(tail), lambda t: F.when(_plan(t), _walk(t, lambda v: feistel(v, key, "phone"), _plan)).otherwise(_walk(t, lambda v: feistel(v, key, "phone"), lambda v: ~_plan(v) | (F.length(v) != 10))))[0]
    return _laid_out(F.concat(F.substring(d, F.lit(1), head), own), m)


def _ssn_ok(d: Column) -> Column:
    return d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")


def ssn(m: Column, key: str) -> Column:
    return _laid_out(F.transform(F.array(_digits(m)), lambda d: _walk(d, lambda v: feistel(v, key, "ssn"), _ssn_ok))[0], m)


def is_ip(m: Column) -> Column:
    return m.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$")


def ip(m: Column, key: str) -> Column:
    """A Feistel network over the two halves of 16 bits."""
    o = F.split(m, r"\.")
    n = lambda i: o[i].cast("bigint")
    start = F.struct((n(0) * 256 + n(1)).alias("a"), (n(2) * 256 + n(3)).alias("b"))
    turn = lambda s, i: F.struct(s["b"].alias("a"), ((s["a"] + _pseudo(key, "ip", i, s["b"].cast("string"), F.lit(65536))) % 65536).alias("b"))
    octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat_ws(".", octets(s["a"]), octets(s["b"])))


_DAYS = 73049  # from 1900-01-01 to 2099-12-31


def _day(m: Column) -> Column:
    """The candidate's day as a date, null if there is none; day first where slashes or dots part it, month first if only that is a date."""
    p = F.split(m, r"[-/.]")
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when(m.contains("-"), made(p[0], p[1], p[2])).otherwise(F.coalesce(made(p[2], p[1], p[0]), made(p[2], p[0], p[1])))


def is_date(m: Column) -> Column:
    d = _day(m)
    return F.coalesce(d.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))


def date(m: Column, key: str) -> Column:
    epoch = F.lit("1900-01-01").cast("date")
    number = F.lpad(F.datediff(_day(m), epoch).cast("string"), 5, "0")
    moved = _walk(number, lambda v: feistel(v, key, "date"), lambda v: v.cast("int") < _DAYS)
    day = F.transform(F.array(F.date_add(epoch, moved.cast("int"))), lambda x: x)[0]
    dotted = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
    swapped = F.try_to_date(F.concat_ws("-", F.split(m, r"[/.]")[2], F.lpad(F.split(m, r"[/.]")[1], 2, "0"), F.lpad(F.split(m, r"[/.]")[0], 2, "0")), "yyyy-MM-dd").isNull()
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    parts = lambda x: F.when(swapped, F.concat_ws("|", two(F.month(x)), two(F.day(x)))).otherwise(F.concat_ws("|", two(F.day(x)), two(F.month(x))))
    return F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.transform(F.array(day), lambda x: F.concat(F.replace(parts(x), F.lit("|"), dotted), dotted, F.year(x).cast("string")))[0])


def _mod97(c: Column) -> Column:
    """Of digits and capitals, a capital counting as two digits from 10 on."""
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda r, x: ((r * F.when(x.rlike("[0-9]"), 10).otherwise(100) + value(x)) % 97).cast("int"))


def is_iban(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    return F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def iban(m: Column, key: str) -> Column:
    """The digits after the check digits are permuted, where they are two or more; then the check digits follow."""
    country, rest = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    own = _digits(rest)
    moved = F.transform(F.array(F.when(F.length(own) >= 2, _laid_out(feistel(own, key, "iban"), rest)).otherwise(rest)), lambda x: x)[0]
    check = lambda r: F.lpad((F.lit(98) - _mod97(F.concat(F.replace(r, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0")
    return F.transform(F.array(moved), lambda r: F.concat(country, check(r), r))[0]


def email(m: Column, key: str) -> Column:
    """Letters and digits of the local part from a keyed hash of the whole address, each in its class; the domain stays."""
    local = F.substring_index(m, "@", 1)
    h = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m), i.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    one = lambda c, i: F.when(c.rlike("[0-9]"), (h(i) % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + h(i) % 26)).when(c.rlike("[A-Z]"), F.char(65 + h(i) % 26)).otherwise(c)
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), lambda i: one(F.substring(local, i, F.lit(1)), i)), ""), F.lit("@"), F.substring_index(m, "@", -1))


_FOLLOWED = r"^(\d{4}(?:[ -]?\d{4}){3})([ -]\d{1,3})$"

_RULES = {
    "email": (lambda m: F.lit(True), email),
    "iban": (is_iban, iban),
    "date": (is_date, date),
    "ip": (is_ip, ip),
    "ssn": (lambda m: _ssn_ok(_digits(m)), ssn),
    "phone": (is_phone, phone),
    "card": (is_card, card),
}


def replaced(m: Column, key: str) -> Column:
    """(kind, text): the pseudonym of a candidate, or itself with a null kind."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind, (ok, make) in reversed(_RULES.items()):
        fits = m.rlike(f"^(?:{KINDS[kind]})$") & F.coalesce(ok(m), F.lit(False))
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.coalesce(make(m, key), _masked(m)).alias("text"))).otherwise(out)
        if kind == "card":  # four groups are the card, and a number follows
            first, rest = F.regexp_extract(m, _FOLLOWED, 1), F.regexp_extract(m, _FOLLOWED, 2)
            parts = F.when(m.rlike(_FOLLOWED) & ~is_card(m) & is_card(first), F.struct(F.lit(kind).alias("kind"), F.concat(card(first, key), rest).alias("text")))
            out = F.coalesce(parts, out)
    return out


#: The setting that holds the key; by its name Spark leaves it out of its logs and pages.
KEY_SETTING = "spark.flatsieve.pii.secret"


def corpus_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING; where that is unset, a random one that holds for this application only."""
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given
    app = spark.sparkContext.applicationId
    if getattr(corpus_key, "of", None) != app:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are linked within this application only", stacklevel=2)
        corpus_key.of, corpus_key.key = app, secrets.token_hex(16)
    return corpus_key.key


def pseudonymize(df: DataFrame, text: str = "text", key: str | None = None, found: str | None = None) -> DataFrame:
    """``df`` with its ``text`` pseudonymized, and a column ``found`` of (kind, text) of the replaced values if one is named.

    The key is a secret of the corpus: whoever has it can undo the permutations (``feistel`` with ``inverse``). It
    is ``corpus_key`` by default, and a literal of the plan, so plans are as secret as it is.
    """
    key = key or corpus_key(df.sparkSession)
    body = F.col(f"`{text}`")
    made = F.transform(F.regexp_extract_all(body, F.lit(PATTERN), 0), lambda m: replaced(m, key))
    # most texts have no candidate, and only those that have are cut and put together again
    held = df.withColumn("__fs_made", F.when(body.rlike(PATTERN), made))
    between = F.split(body, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.col("__fs_made"), lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit("")))), "")
    out = held.withColumn(text, F.when(F.col("__fs_made").isNotNull(), joined).otherwise(body))
    return (out.withColumn(found, F.filter(F.col("__fs_made"), lambda x: x["kind"].isNotNull())) if found else out).drop("__fs_made")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of each kind it had."""
    out = pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), found="found")
    n = lambda k: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == k)), F.lit(0)).alias(f"n_{k}")
    return out.select("doc_id", "text", *map(n, KINDS))
