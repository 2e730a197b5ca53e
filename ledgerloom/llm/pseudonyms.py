"""Format-preserving pseudonyms: validated numbers and dates permuted by a keyed Feistel network within their format.

Only DataFrame functions run here.  A value becomes another valid value of the same format; equal values become equal ones in every document,
whatever their punctuation; without the key the permutation isn't known, so whoever runs the job must give one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps after which a walk has come back into its range, but for a chance of one in 10^14.
WALK = 100
#: Dates are permuted among the days of these years.
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

# The formats, each behind no word character.
MAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=[A-Za-z0-9])"
IP = r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d)"
PHONE = r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}([ .-])\d{3}\1\d{4}(?![ .-]?\d)"
SOCIAL = r"\d{3}-\d{2}-\d{4}(?!\d)"
CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
# The calling codes of one and of two digits; every other one has three.
CALLING = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ANY = rf"(?<![A-Za-z0-9_])(?:{MAIL}|{IP}|{DATE}|{SOCIAL}|{PHONE}|{CARD})"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(text: Column) -> Column:
    """Fifteen hex digits of a digest as a number."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(15)), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def feistel(digits: Column, key: Column) -> Column:
    """A keyed permutation of the digit strings of each length (2 to 30), by an alternating Feistel network on their halves."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = (F.length(digits) - u).cast("int")
    start = F.struct(F.left(digits, u).cast("long").alias("a"), F.substr(digits, u + 1).cast("long").alias("b"))

    def step(x: Column, k: Column) -> Column:
        word = lambda part: _number(F.concat_ws("|", key, k.cast("string"), F.length(digits).cast("string"), part.cast("string")))
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(x["a"] + F.pmod(word(x["b"]), _power(u)), _power(u))).otherwise(x["a"]).alias("a"),
            F.when(~odd, F.pmod(x["b"] + F.pmod(word(x["a"]), _power(v)), _power(v))).otherwise(x["b"]).alias("b"),
        )

    done = lambda x: F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), v, "0"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        x = F.substr(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _permute_card(digits: Column, key: Column) -> Column:
    body = feistel(F.left(digits, F.length(digits) - 1), key)
    # bound once, so that the network isn't evaluated for both uses
    return F.transform(F.array(body), lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))[0]


def _walk(value: Column, digits: int, below: int, key: Column, alike=lambda x: F.lit(True)) -> Column:
    """A keyed permutation of those of 0 .. below - 1 for which ``alike`` holds: the network on digit strings, again while it leaves them."""
    first = feistel(F.lpad(value.cast("string"), digits, "0"), key)

    def again(x: Column, _: Column) -> Column:
        n = x.cast("long")
        return F.when((n < below) & alike(n), x).otherwise(feistel(x, key))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, again).cast("long")


def fill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced by ``digits`` in order."""
    one = lambda k: F.substr(pattern, k, F.lit(1))
    put = lambda k: F.when(one(k).rlike("^[0-9]$"), F.substr(digits, F.length(digits_of(F.left(pattern, k))), F.lit(1))).otherwise(one(k))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), put), "")


def _date(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


# The formats of dates.
FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy")


def _day(value: Column) -> tuple[Column, Column]:
    """(days since the first day, or null; the format) of a date.  With slashes the day comes first, unless the year does, or only the month can."""
    part = F.split(value, "[-/.]")
    one, two, three = (F.get(part, F.lit(k)) for k in range(3))
    slashed, year_first, short = value.contains("/"), F.length(one) == 4, (F.length(one) < 2) | (F.length(two) < 2)
    american = slashed & ~year_first & (two.try_cast("int") > 12)
    form = (
        F.when(year_first & slashed, "yyyy/MM/dd").when(year_first, "yyyy-MM-dd").when(american & short, "M/d/yyyy").when(american, "MM/dd/yyyy")
        .when(slashed & short, "d/M/yyyy").when(slashed, "dd/MM/yyyy").when(short, "d.M.yyyy").otherwise("dd.MM.yyyy")
    )
    year, month, day = F.when(year_first, one).otherwise(three), F.when(american, one).otherwise(two), F.when(year_first, three).when(american, two).otherwise(one)
    date = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return F.datediff(date, F.lit(FIRST_DAY).cast("date")), form


def _social(n: Column) -> Column:
    """Whether nine digits are a social security number that can be given: the area isn't 0, 666 or from 900 on, group and serial aren't 0."""
    area = F.floor(n / 1_000_000)
    return (area > 0) & (area != 666) & (area < 900) & (F.floor(n / 10_000) % 100 > 0) & (n % 10_000 > 0)


def kind_of(value: Column) -> Column:
    """mail, ip, date, social, phone or card of a match; null where its check fails (no calendar day, a wrong check digit)."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    days, _ = _day(value)
    return (
        F.when(value.contains("@"), "mail").when(whole(IP), "ip").when(whole(DATE), F.when(days.between(0, DAYS - 1), "date")).when(whole(SOCIAL), F.when(_social(digits_of(value).try_cast("long")), "social"))
        .when(whole(PHONE), "phone").when(luhn_sum(digits_of(value)) % 10 == 0, "card")
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """Another value of the same kind and format; an unknown kind leaves the value."""
    k = F.concat(F.lit(key + "|"), kind)
    octets = F.split(value, r"\.")
    number = F.aggregate(F.transform(octets, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda t, x: t * 256 + x)
    ip = F.transform(F.array(_walk(number, 10, 1 << 32, k)), lambda n: F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))[0]
    days, form = _day(value)
    # days up to the 12th stay among themselves, so that a month that comes first can still be told
    late = lambda n: F.dayofmonth(_date(n)) > 12
    date = _date(F.when(late(days), _walk(days, 5, DAYS, k, late)).otherwise(_walk(days, 5, DAYS, k, lambda n: ~late(n))))
    dated = F.coalesce(*(F.when(form == x, F.date_format(date, x)) for x in FORMS))
    local = F.concat(F.lit("u"), F.left(F.sha2(F.concat_ws("|", k, F.lower(F.substring_index(value, "@", 1)), F.lower(F.substring_index(value, "@", -1))), 256), F.lit(12)))
    # a country code, read off the digits alone, stays; the rest of a phone number is permuted
    # a zero in brackets behind it is no digit of the number
    plain = F.when(value.startswith("+"), F.replace(value, F.lit("(0)"), F.lit("(o)"))).otherwise(value)
    phone_digits = digits_of(plain)
    code = F.when(value.startswith("+"), F.length(F.regexp_extract(phone_digits, CALLING, 1))).otherwise(0)
    phone = F.replace(fill(plain, F.concat(F.left(phone_digits, code), feistel(F.substr(phone_digits, code + 1), k))), F.lit("(o)"), F.lit("(0)"))
    social = F.lpad(_walk(digits_of(value).try_cast("long"), 9, 1_000_000_000, k, _social).cast("string"), 9, "0")
    return (
        F.when(kind == "mail", F.concat(local, F.lit("@"), F.substring_index(value, "@", -1))).when(kind == "ip", ip).when(kind == "date", dated)
        .when(kind == "social", fill(value, social)).when(kind == "phone", phone).when(kind == "card", fill(value, _permute_card(digits_of(value), k))).otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_values``: how many values each text had.

    ``key`` is the secret that whoever reads the result must not have.  Mail addresses keep their domain and get a keyed local part;
    phone numbers keep their country code (one without a code links with the same number behind +1) and a zero in brackets behind it; IPv4 addresses, calendar
    days, social security numbers and card numbers with a right check digit are permuted within their formats.  Of a date with slashes the day
    comes first unless only the month can; days from the 13th on stay such days.  What fails its check
    stays as it is.  A null text stays null with 0 values; a very long one is read whole; an empty table gives an empty result.  Repeated rows
    give repeated results; a column n_values is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col("text")
    some = text.rlike("[0-9@]")
    values = F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))
    columns = [c for c in docs.columns if c != "n_values"]
    d = docs.select(F.struct(*columns).alias("_row"), text.alias("_text"), F.when(some, values).alias("_values"))
    d = d.withColumn("_pieces", F.when(F.size("_values") > 0, F.split("_text", ANY, -1)))
    new = F.transform("_values", lambda x: pseudonym(x["v"], x["k"], key))
    joined = F.array_join(F.zip_with("_pieces", F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    new_text = F.when(F.col("_pieces").isNotNull(), joined).otherwise(F.col("_text"))
    n = F.coalesce(F.size(F.filter("_values", lambda x: x["k"].isNotNull())), F.lit(0)).cast("long")
    return d.select(*(new_text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in columns), n.alias("n_values"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (with pseudonyms), n_values for every document; the key is ``spark.ledgerloom.pseudonymKey``, and a test key where that is unset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get("spark.ledgerloom.pseudonymKey", "for tests only")).select("doc_id", "text", "n_values")
