"""Format-preserving pseudonyms for personal data in texts. DataFrame functions only.

Candidates are found by one pattern, validated by kind, and replaced by a keyed permutation of the kind's own domain, computed by a
Feistel network: two halves take turns being shifted by a keyed hash of the other. A pseudonym is so again valid in the same format,
and equal values get equal pseudonyms in all documents, which stay linked; without the key it cannot be undone.

============ ======================================================== =========================================================
kind         valid if                                                 permuted
============ ======================================================== =========================================================
card         13 to 19 digits, plain or 4-4-4-4, check digit right     all digits but the first and the last, which is recomputed
phone        ten digits with separators, optional +1                  numbers whose area and exchange are both, one or none from 200
ip           four octets without leading zeros                        the 2^32 addresses
ssn          ddd-dd-dddd, no part zero, area not 666 and below 900    the 898 * 99 * 9,999 numbers
date         y-m-d, y/m/d, d.m.y or d/m/y, two-digit d and m,         the 73,049 days of 1900 to 2099
             from 1900 to 2099
email        local part, @, domain with a dot                         letters and digits of the local part, each among its like
============ ======================================================== =========================================================

Runs of letters and digits are taken whole, so digits inside a longer token are not taken for a number. A run joined by dots, hyphens or
slashes that is not valid as a whole is tried again in parts (an address before a path or a prefix length, both ends of a range, the day of a
timestamp). What is not valid stays.

Defined cases: NULL stays NULL and empty stays empty; rows with a NULL ``doc_id`` are treated like others; repeated rows get equal results.
Each row is treated alone, nothing is shuffled. Only ``text`` is changed, and further columns are carried along by ``pseudonymize``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import unused

# Understood alike by the regular expressions of Java and of RE2: no look-around, ASCII classes only.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"
PHONE = r"(?:[+]1[ .-]?)?(?:[(][0-9]{3}[)][ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
SPACED_CARD = r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}"
RUN = r"[A-Za-z_]*[0-9][0-9A-Za-z_]*(?:[./-][0-9A-Za-z_]+)*"
CANDIDATE = f"{EMAIL}|(?:[+]1[ .-]?)?[(][0-9]{{3}}[)][ .-]?[0-9]{{3}}[ .-]{RUN}|[+]1[ .-][0-9]{{3}}[ .-][0-9]{{3}}[ .-]{RUN}|" \
            f"[0-9]{{3}} [0-9]{{3}}[ -]{RUN}|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}} {RUN}|{RUN}"
# Parts of a run that is not valid as a whole; every character lies in one of them.
PART = r"[0-9]+-[0-9]+-[0-9]+T|[0-9]+(?:-[0-9]+)+[0-9A-Za-z_]*|[0-9]+(?:[.][0-9]+)+[0-9A-Za-z_]*|[0-9]+(?:/[0-9]+)+[0-9A-Za-z_]*|[0-9A-Za-z_]+|[^0-9A-Za-z_]"
DAY_OF_TIME = r"^[0-9]+-[0-9]+-[0-9]+T$"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}$"
CARD = rf"^(?:[0-9]{{13,19}}|{SPACED_CARD}|{SPACED_CARD.replace(' ', '-')})$"
PHONE_PARTS = r"^((?:[+]1[ .-]?)?[(]?)([0-9]{3})([)]?[ .-]?)([0-9]{3})([ .-])([0-9]{4})$"
SSN = r"^([0-9]{3})-([0-9]{2})-([0-9]{4})$"
YMD = r"^([0-9]{4})([-/])([0-9]{2})([-/])([0-9]{2})$"
DMY = r"^([0-9]{2})([./])([0-9]{2})([./])([0-9]{4})$"
ROUNDS = 8
DAYS = (17, 4297)  # 17 * 4297 days from 1900-01-01 to 2099-12-31


@dataclass(frozen=True)
class PiiParams:
    key: str = "change me"  # the secret: whoever has it can undo the pseudonyms


def _long(c: Column) -> Column:
    return c.cast("long")


def _group(m: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(m, pattern, i)


def _digest(key: str, tag: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), value.cast("string")), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A permutation of the pairs (left below a, right below b), as a struct ``l``, ``r``."""
    def turn(s: Column, i: Column) -> Column:
        shift = F.conv(F.substring(_digest(key, tag, i, F.when(i % 2 == 0, s["r"]).otherwise(s["l"])), 1, 15), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 0, (s["l"] + shift) % a).otherwise(s["l"]).alias("l"),
                        F.when(i % 2 == 0, s["r"]).otherwise((s["r"] + shift) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(left).alias("l"), _long(right).alias("r")), turn)


def feistel_letters(left: Column, right: Column, key: str, tag: str) -> Column:
    """The same for strings: each letter or digit of a half moves among its like, other characters stay."""
    def shifted(s: Column, digest: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(s, i, F.lit(1))
            code = F.ascii(c)
            by = F.conv(F.substring(digest, 2 * ((i - 1) % 32) + 1, F.lit(2)), 16, 10).cast("int")
            move = lambda base, n: F.char(F.lit(base) + (code - base + by) % n)
            return F.when(c.between("0", "9"), move(48, 10)).when(c.between("A", "Z"), move(65, 26)).when(c.between("a", "z"), move(97, 26)).otherwise(c)

        return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), ""))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(s["l"], _digest(key, tag, i, s["r"])).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], _digest(key, tag, i, s["l"])).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), turn)


def luhn(digits: Column) -> Column:
    """The weighted digit sum; every second digit from the right, without the last, is doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _date(m: Column) -> Column:
    iso = m.rlike(YMD) & (_group(m, YMD, 2) == _group(m, YMD, 4))
    german = m.rlike(DMY) & (_group(m, DMY, 2) == _group(m, DMY, 4))
    text = F.when(iso, F.concat_ws("-", _group(m, YMD, 1), _group(m, YMD, 3), _group(m, YMD, 5))).when(
        german, F.concat_ws("-", _group(m, DMY, 5), _group(m, DMY, 3), _group(m, DMY, 1)))
    day = text.try_cast("date")
    return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), day)


def kind(m: Column) -> Column:
    """What a candidate is, NULL if it is nothing."""
    digits = F.regexp_replace(m, "[ -]", "")
    area = _group(m, SSN, 1)
    return (
        F.when(m.rlike(f"^{EMAIL}$"), "email").when(m.rlike(CARD), F.when(luhn(digits) % 10 == 0, "card")).when(m.rlike(IP), "ip")
        .when(m.rlike(SSN), F.when((area != "000") & (area != "666") & (area < "900") & (_group(m, SSN, 2) != "00") & (_group(m, SSN, 3) != "0000"), "ssn"))
        .when(m.rlike(PHONE_PARTS) & m.rlike(f"^{PHONE}$"), "phone").when(_date(m).isNotNull(), "date")
    )


def pseudonym(m: Column, k: Column, key: str) -> Column:
    """The pseudonym of a candidate ``m`` of kind ``k``."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")

    def bind(value: Column, use) -> Column:  # evaluates ``value`` once
        return F.element_at(F.transform(F.array(value), use), 1)

    digits = F.regexp_replace(m, "[ -]", "")
    inner = F.length(digits) - 2
    la = F.floor(inner / 2).cast("int")
    lb = inner - la
    mixed = feistel(F.substring(digits, F.lit(2), la), F.substring(digits, la + 2, lb), ten(la), ten(lb), key, "card")
    separator = F.regexp_extract(m, "[ -]", 0)

    def card(s: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), F.lpad(s["l"].cast("string"), la, "0"), F.lpad(s["r"].cast("string"), lb, "0"))

        def close(b: Column) -> Column:
            whole = F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))
            return F.when(separator == "", whole).otherwise(
                F.concat(F.substring(whole, 1, 4), separator, F.substring(whole, 5, 4), separator, F.substring(whole, 9, 4), separator, F.substring(whole, 13, 4)))

        return bind(body, close)

    o = [_long(_group(m, IP, i)) for i in range(1, 5)]
    ip = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    area, exchange, line = (_long(_group(m, PHONE_PARTS, i)) for i in (2, 4, 6))
    high = F.floor(line / 100)
    low = lambda c: F.when(c >= 200, 200).otherwise(0)  # noqa: E731  real codes start at 200; others stay others
    span = lambda c: F.when(c >= 200, 800).otherwise(200) * 100
    phone = feistel((area - low(area)) * 100 + high, (exchange - low(exchange)) * 100 + line % 100, span(area), span(exchange), key, "phone")
    part = lambda i: _group(m, PHONE_PARTS, i)
    number = _long(_group(m, SSN, 1))
    ssn = feistel((number - 1 - F.when(number > 666, 1).otherwise(0)) * 99 + _long(_group(m, SSN, 2)) - 1, _long(_group(m, SSN, 3)) - 1,
                  F.lit(898 * 99), F.lit(9999), key, "ssn")
    day = F.datediff(_date(m), F.lit("1900-01-01").cast("date"))
    date = feistel(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")

    def write_date(s: Column) -> Column:
        d = F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int"))
        sep = F.regexp_extract(m, "[./-]", 0)
        y, mo, da = (F.date_format(d, f) for f in ("yyyy", "MM", "dd"))
        return F.when(m.rlike(YMD), F.concat(y, sep, mo, sep, da)).otherwise(F.concat(da, sep, mo, sep, y))

    def write_ssn(s: Column) -> Column:
        index = F.floor(s["l"] / 99) + 1
        return F.concat(pad(index + F.when(index >= 666, 1).otherwise(0), 3), F.lit("-"), pad(s["l"] % 99 + 1, 2), F.lit("-"), pad(s["r"] + 1, 4))

    local = F.substring_index(m, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")
    mail = feistel_letters(F.substring(local, F.lit(1), half), F.substring(local, half + 1, F.length(local)), key, "email")
    return (
        F.when(k == "email", bind(mail, lambda s: F.concat(s["l"], s["r"], F.substring(m, F.length(local) + 1, F.length(m)))))
        .when(k == "card", bind(mixed, card))
        .when(k == "ip", bind(ip, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)))
        .when(k == "phone", bind(phone, lambda s: F.concat(
            part(1), pad(F.floor(s["l"] / 100) + low(area), 3), part(3), pad(F.floor(s["r"] / 100) + low(exchange), 3), part(5),
            pad((s["l"] % 100) * 100 + s["r"] % 100, 4))))
        .when(k == "ssn", bind(ssn, write_ssn)).when(k == "date", bind(date, write_date)).otherwise(m)
    )


def parts(m: Column) -> Column:
    """A candidate as pieces ``m``, ``kind``, ``tail`` (what follows the value in the piece), in order: itself, or its parts if it is not valid."""
    def piece(p: Column) -> Column:
        value = F.when(p.rlike(DAY_OF_TIME), F.substring_index(p, "T", 1)).otherwise(p)
        return F.struct(value.alias("m"), kind(value).alias("kind"), F.when(p.rlike(DAY_OF_TIME), "T").otherwise("").alias("tail"))

    whole = F.array(F.struct(m.alias("m"), kind(m).alias("kind"), F.lit("").alias("tail")))
    return F.when(F.get(whole, F.lit(0))["kind"].isNotNull() | ~m.rlike("[./-]"), whole).otherwise(
        F.transform(F.regexp_extract_all(m, F.lit(PART), F.lit(0)), piece))


def found(text: Column) -> Column:
    """The candidates of a text, each as its pieces, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), parts)


def marked(docs: DataFrame, params: PiiParams = PiiParams()) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more, and their names, which no other column has: the candidates (NULL if there can be none) and the text as replaced."""
    hits, new = unused("_found", docs), unused("_text", docs)
    out = docs.withColumn(hits, F.when(F.col("text").rlike("[0-9@]"), found(F.col("text"))))
    between = F.split("text", CANDIDATE, -1)
    word = lambda s: F.concat(F.when(s["kind"].isNull(), s["m"]).otherwise(pseudonym(s["m"], s["kind"], params.key)), s["tail"])
    words = F.transform(hits, lambda pieces: F.array_join(F.transform(pieces, word), ""))
    woven = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.get(between, i + 1))), ""))
    some = F.exists(hits, lambda pieces: F.exists(pieces, lambda s: s["kind"].isNotNull()))
    return out.withColumn(new, F.when(F.coalesce(some, F.lit(False)), woven).otherwise(F.col("text"))), hits, new


def pseudonymize(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced."""
    out, _, new = marked(docs, params)
    return out.withColumn("text", F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])


KINDS = ("card", "date", "email", "ip", "phone", "ssn")


def report(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``doc_id``, the number of values replaced by kind, ``text``: one row per row of ``docs``."""
    out, _, _ = marked(docs.select("doc_id", "text"), params)
    count = lambda k: F.coalesce(F.size(F.filter(F.flatten("_found"), lambda s: s["kind"] == k)), F.lit(0))
    counts = [F.when(F.col("_found").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.col("_text").alias("text"))


def report_sql(params: PiiParams = PiiParams()) -> str:
    """The same as ``report`` in SQL, with a step per turn of the networks."""
    key = params.key
    g = lambda pattern, i: f"regexp_extract(m, '{pattern}', {i})"
    n = lambda pattern, i: f"CAST({g(pattern, i)} AS BIGINT)"
    low = lambda c: f"CASE WHEN {c} >= 200 THEN 200 ELSE 0 END"
    span = lambda c: f"CASE WHEN {c} >= 200 THEN 80000 ELSE 20000 END"
    luhn_of = lambda c: (
        f"coalesce(list_sum(list_transform(range(0, length({c})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({c}, length({c}) - i, 1) AS BIGINT) "
        f"ELSE (2 * CAST(substr({c}, length({c}) - i, 1) AS BIGINT)) % 10 + (2 * CAST(substr({c}, length({c}) - i, 1) AS BIGINT)) // 10 END)), 0)")
    area, exchange, line = (n(PHONE_PARTS, i) for i in (2, 4, 6))
    number = n(SSN, 1)
    hashed = lambda tag, turn, v: f"sha256('{key}|' || {tag} || '|{turn}|' || {v})"
    turns, letters = [], []
    for i in range(ROUNDS):
        shift = f"CAST('0x' || substr({hashed('kind', i, 'l' if i % 2 else 'r')}, 1, 15) AS BIGINT)"
        turns.append(f"x{i + 1} AS (SELECT m, kind, digits, a, b, {'l' if i % 2 else f'(l + {shift}) % a'} AS l, {f'(r + {shift}) % b' if i % 2 else 'r'} AS r FROM x{i})")
        half, other = ("r", "l") if i % 2 else ("l", "r")
        c, by = "ascii(substr(h, i, 1))", "CAST('0x' || substr(d, 2 * ((i - 1) % 32) + 1, 2) AS INTEGER)"
        one = " ".join(f"WHEN {c} BETWEEN {base} AND {base + size - 1} THEN chr(CAST({base} + ({c} - {base} + {by}) % {size} AS INTEGER))"
                       for base, size in ((48, 10), (65, 26), (97, 26)))
        moved = f"coalesce(array_to_string(list_transform(range(1, length(h) + 1), lambda i: CASE {one} ELSE substr(h, i, 1) END), ''), '')"
        letters.append(f"y{i + 1} AS (SELECT m, {'l' if i % 2 else moved} AS l, {moved if i % 2 else 'r'} AS r FROM "
                       f"(SELECT *, {half} AS h, {hashed(chr(39) + 'email' + chr(39), i, other)} AS d FROM y{i}))")
    body = "substr(digits, 1, 1) || lpad(CAST(l AS VARCHAR), CAST(la AS INTEGER), '0') || lpad(CAST(r AS VARCHAR), CAST(lb AS INTEGER), '0')"
    ymd, dmy = f"regexp_matches(m, '{YMD}')", f"regexp_matches(m, '{DMY}')"
    value = f"CASE WHEN regexp_matches(x, '{DAY_OF_TIME}') THEN substr(x, 1, length(x) - 1) ELSE x END"
    counts = ", ".join(f"CAST(len(list_filter(vs, lambda x: kinds[x] = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[0-9@]') THEN regexp_extract_all(text, '{CANDIDATE}') ELSE [] END AS ms FROM documents),
c0 AS (SELECT DISTINCT unnest(ms) AS m FROM d),
c AS (SELECT m FROM c0 UNION SELECT {value} FROM (SELECT unnest(regexp_extract_all(m, '{PART}')) AS x FROM c0 WHERE regexp_matches(m, '[./-]'))),
v AS (SELECT m, regexp_replace(m, '[ -]', '', 'g') AS digits,
      CASE WHEN {ymd} AND {g(YMD, 2)} = {g(YMD, 4)} THEN TRY_CAST({g(YMD, 1)} || '-' || {g(YMD, 3)} || '-' || {g(YMD, 5)} AS DATE)
           WHEN {dmy} AND {g(DMY, 2)} = {g(DMY, 4)} THEN TRY_CAST({g(DMY, 5)} || '-' || {g(DMY, 3)} || '-' || {g(DMY, 1)} AS DATE) END AS day FROM c),
k AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(m, '^{EMAIL}$') THEN 'email'
      WHEN regexp_matches(m, '{CARD}') THEN CASE WHEN {luhn_of('digits')} % 10 = 0 THEN 'card' END
      WHEN regexp_matches(m, '{IP}') THEN 'ip'
      WHEN regexp_matches(m, '{SSN}') THEN CASE WHEN {g(SSN, 1)} NOT IN ('000', '666') AND {g(SSN, 1)} < '900' AND {g(SSN, 2)} <> '00' AND {g(SSN, 3)} <> '0000' THEN 'ssn' END
      WHEN regexp_matches(m, '{PHONE_PARTS}') AND regexp_matches(m, '^{PHONE}$') THEN 'phone'
      WHEN day BETWEEN DATE '1900-01-01' AND DATE '2099-12-31' THEN 'date' END AS kind FROM v),
x0 AS MATERIALIZED (
  SELECT m, kind, digits, CAST(rpad('1', CAST(la + 1 AS INTEGER), '0') AS BIGINT) AS a, CAST(rpad('1', CAST(lb + 1 AS INTEGER), '0') AS BIGINT) AS b,
    CAST(substr(digits, 2, la) AS BIGINT) AS l, CAST(substr(digits, la + 2, lb) AS BIGINT) AS r
  FROM (SELECT *, (length(digits) - 2) // 2 AS la, length(digits) - 2 - (length(digits) - 2) // 2 AS lb FROM k WHERE kind = 'card')
  UNION ALL SELECT m, kind, digits, 65536, 65536, {n(IP, 1)} * 256 + {n(IP, 2)}, {n(IP, 3)} * 256 + {n(IP, 4)} FROM k WHERE kind = 'ip'
  UNION ALL SELECT m, kind, digits, {span(area)}, {span(exchange)}, ({area} - {low(area)}) * 100 + {line} // 100, ({exchange} - {low(exchange)}) * 100 + {line} % 100
    FROM k WHERE kind = 'phone'
  UNION ALL SELECT m, kind, digits, {898 * 99}, 9999, ({number} - 1 - CASE WHEN {number} > 666 THEN 1 ELSE 0 END) * 99 + {n(SSN, 2)} - 1, {n(SSN, 3)} - 1 FROM k WHERE kind = 'ssn'
  UNION ALL SELECT m, kind, digits, {DAYS[0]}, {DAYS[1]}, (day - DATE '1900-01-01') // {DAYS[1]}, (day - DATE '1900-01-01') % {DAYS[1]} FROM k WHERE kind = 'date'),
{", ".join(turns)},
y0 AS MATERIALIZED (SELECT m, substr(o, 1, length(o) // 2) AS l, substr(o, length(o) // 2 + 1) AS r FROM (SELECT m, split_part(m, '@', 1) AS o FROM k WHERE kind = 'email')),
{", ".join(letters)},
z AS (SELECT *, (length(digits) - 2) // 2 AS la, length(digits) - 2 - (length(digits) - 2) // 2 AS lb FROM x{ROUNDS}),
w AS (SELECT *, CASE WHEN kind = 'card' THEN {body} || CAST((10 - {luhn_of("(" + body + " || '0')")} % 10) % 10 AS VARCHAR) END AS whole,
      CASE WHEN kind = 'date' THEN DATE '1900-01-01' + CAST(l * {DAYS[1]} + r AS INTEGER) END AS day FROM z),
p AS (SELECT m, kind, CASE kind
      WHEN 'card' THEN CASE WHEN regexp_matches(m, '[ -]') THEN substr(whole, 1, 4) || substr(m, 5, 1) || substr(whole, 5, 4) || substr(m, 5, 1) || substr(whole, 9, 4)
        || substr(m, 5, 1) || substr(whole, 13, 4) ELSE whole END
      WHEN 'ip' THEN l // 256 || '.' || l % 256 || '.' || r // 256 || '.' || r % 256
      WHEN 'phone' THEN {g(PHONE_PARTS, 1)} || lpad(CAST(l // 100 + {low(area)} AS VARCHAR), 3, '0') || {g(PHONE_PARTS, 3)}
        || lpad(CAST(r // 100 + {low(exchange)} AS VARCHAR), 3, '0') || {g(PHONE_PARTS, 5)} || lpad(CAST((l % 100) * 100 + r % 100 AS VARCHAR), 4, '0')
      WHEN 'ssn' THEN lpad(CAST(l // 99 + 1 + CASE WHEN l // 99 + 1 >= 666 THEN 1 ELSE 0 END AS VARCHAR), 3, '0') || '-' || lpad(CAST(l % 99 + 1 AS VARCHAR), 2, '0')
        || '-' || lpad(CAST(r + 1 AS VARCHAR), 4, '0')
      WHEN 'date' THEN CASE WHEN {ymd} THEN replace(strftime(day, '%Y-%m-%d'), '-', substr(m, 5, 1))
        ELSE replace(strftime(day, '%d-%m-%Y'), '-', substr(m, 3, 1)) END END AS word FROM w
  UNION ALL SELECT m, 'email', l || r || substr(m, length(l || r) + 1) FROM y{ROUNDS}
  UNION ALL SELECT m, '', m FROM k WHERE kind IS NULL),
t AS (SELECT m, [m] AS vs, word FROM p WHERE kind <> '' OR NOT regexp_matches(m, '[./-]')
  UNION ALL SELECT m, list(v ORDER BY i), string_agg(word || tail, '' ORDER BY i) FROM (
    SELECT u.m, i, {value} AS v, p2.word, CASE WHEN regexp_matches(x, '{DAY_OF_TIME}') THEN 'T' ELSE '' END AS tail
    FROM (SELECT c0.m, unnest(regexp_extract_all(c0.m, '{PART}')) AS x, generate_subscripts(regexp_extract_all(c0.m, '{PART}'), 1) AS i
          FROM c0 JOIN p USING (m) WHERE p.kind = '' AND regexp_matches(c0.m, '[./-]')) u JOIN p p2 ON p2.m = {value}) GROUP BY m),
q AS (SELECT map(list(m), list(kind)) AS kinds FROM p),
r AS (SELECT map(list(m), list(word)) AS words, map(list(m), list(vs)) AS pieces FROM t),
e AS (SELECT *, flatten(list_transform(ms, lambda x: pieces[x])) AS vs FROM d, q, r)
SELECT doc_id, {counts}, CASE WHEN len(list_filter(vs, lambda x: kinds[x] <> '')) = 0 OR text IS NULL THEN text ELSE
  array_to_string(list_transform(range(1, 2 * len(ms) + 2), lambda i: CASE WHEN i % 2 = 0 THEN words[ms[i // 2]]
    ELSE regexp_split_to_array(text, '{CANDIDATE}')[i // 2 + 1] END), '') END AS text FROM e
"""
