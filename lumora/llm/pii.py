"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses, in Spark SQL functions only.

A value is an array of symbols with radices: the digits of a number, the octets of an IP address, a day as
two digits of a 400-year span. A ten-round Feistel network adds to one half, symbol by symbol, a keystream
hashed from the key, the format, the round and the other half; being a bijection of the format, it maps
equal values to equal pseudonyms in every document and different ones to different ones.

Formats (a value that fails its check stays as it is):

- ``card``: 13 to 19 digits with a valid Luhn digit; all but that digit are permuted, and it is computed anew.
- ``iban``: a registered country, its length, and valid by modulus 97; the account's digits and letters are
  permuted, the check digits computed anew.
- ``ssn``: ddd-dd-dddd with area 001-899 but 666, group 01-99, serial 0001-9999; permuted among such.
- ``phone``: an international number of 8 to 15 digits, or a North American one of 3-3-4 digits; all digits
  but the country code are permuted, so that a number has one pseudonym in all notations.
- ``ip``: four octets up to 255; permuted among all addresses.
- ``date``: a calendar day of 1800 to 2199 as y-m-d, d.m.y or d/m/y (m/d/y only if d/m/y is none);
  permuted among the days of these 400 years, so one day in different notations stays one day.
- ``mail``: letters and digits before the @ are permuted within their kind.

A text is taken apart twice. All formats but cards are sought first: what fails its check is left to the
second pass, which takes runs of digit groups (however long) and tries every run of whole groups in them, so
that a card is found whatever numbers stand beside it. No pattern recurses: groups that repeat without a
bound are possessive, which Java matches in a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}"
DATE_ISO = r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![\w-])"
DATE_DMY = r"(?<![\w./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\w/])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
#: IBAN lengths by country, as registered under ISO 13616.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?<!\\w)(?:" + "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?!\\w)"
PHONE = r"(?<![\w+])\+\d(?:[ .-]?\(?\d\)?){7,14}(?!\w)"
PHONE_NANP = r"(?<![\w+(.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
#: Country codes of two digits (E.164); 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = (20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98)
COUNTRY = "^(?:[17]|" + "|".join(map(str, TWO_DIGIT_CODES)) + "|[0-9]{3})"
#: The first pass, in the order in which formats are sought at one place of a text.
ANY = "|".join((MAIL, DATE_ISO, DATE_DMY, SSN, IBAN, IP, PHONE, PHONE_NANP))
#: The second: groups of digits between single spaces, and a letter that spoils the last one.
DIGITS = r"(?<![\w.-])\d[\d-]*+(?: \d[\d-]*+)*+\w?+"
#: How the digits of cards are usually grouped.
USUAL = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})$"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _numbers(x: str) -> str:
    """Array of the digits of a string of digits."""
    return f"transform(filter(split({x}, ''), c -> c <> ''), c -> cast(c as int))"


def _luhn(v: str) -> str:
    """Luhn sum modulo 10 of an array of digits whose last is the check digit."""
    return f"aggregate({v}, struct(0 as s, size({v}) as n), (a, d) -> struct(a.s + case when a.n % 2 = 1 then d when d >= 5 then 2 * d - 9 else 2 * d end as s, a.n - 1 as n), a -> a.s % 10)"


def _mod97(x: str) -> str:
    """Remainder of an IBAN without spaces."""
    moved = f"concat(substring({x}, 5), substring({x}, 1, 4))"
    value = "case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end"
    return f"aggregate(transform(filter(split({moved}, ''), c -> c <> ''), c -> {value}), 0, (a, d) -> case when d < 10 then (a * 10 + d) % 97 else (a * 100 + d) % 97 end)"


def _day(y: str, m: str, d: str) -> str:
    return f"try_to_date(format_string('%04d-%02d-%02d', cast({y} as int), cast({m} as int), cast({d} as int)), 'yyyy-MM-dd')"


_PART = lambda i, sep: f"split(x, {_sql(sep)})[{i}]"


def _kinds() -> str:
    """``struct(kind, x)`` of a match x; kind is null where a check fails."""
    iso = _day(_PART(0, "-"), _PART(1, "-"), _PART(2, "-"))
    dmy = f"coalesce({_day(_PART(2, '[./]'), _PART(1, '[./]'), _PART(0, '[./]'))}, case when contains(x, '/') then {_day(_PART(2, '[./]'), _PART(0, '[./]'), _PART(1, '[./]'))} end)"
    span = lambda day: f"{day} between date'1800-01-01' and date'2199-12-31'"
    tests = (
        ("mail", "@", "true"),
        ("iso", r"^\d{4}-\d{2}-\d{2}$", span(iso)),
        ("dmy", r"^\d{1,2}([./])\d{1,2}\1\d{4}$", span(dmy)),
        ("ssn", r"^\d{3}-\d{2}-\d{4}$", f"cast({_PART(0, '-')} as int) between 1 and 899 and {_PART(0, '-')} <> '666' and {_PART(1, '-')} <> '00' and {_PART(2, '-')} <> '0000'"),
        ("iban", "^[A-Z]", f"{_mod97("replace(x, ' ', '')")} = 1"),
        ("ip", r"^\d+\.\d+\.\d+\.\d+$", "forall(split(x, '[.]'), o -> cast(o as int) <= 255)"),
        ("phone", "^[+]", f"length({_digits('x')}) between 8 and 15"),
        ("phone", r"^\(?\d{3}", f"length({_digits('x')}) = 10"),
    )
    cases = " ".join(f"when x rlike {_sql(p)} and ({check}) then '{kind}'" for kind, p, check in tests)
    return f"named_struct('kind', case {cases} end, 'x', x)"


def _between(text: str, pattern: str, made: str) -> str:
    """Array of structs (kind, x): the pieces of ``text``, those that match ``pattern`` as the arrays ``made`` (of x)."""
    gaps = f"transform(split({text}, {_sql(pattern)}, -1), g -> array(named_struct('kind', cast(null as string), 'x', g)))"
    found = f"concat(transform(regexp_extract_all({text}, {_sql(pattern)}, 0), x -> {made}), array({_NONE}))"
    return f"flatten(zip_with({gaps}, {found}, (g, m) -> concat(g, m)))"


_NONE = "slice(array(named_struct('kind', cast(null as string), 'x', '')), 1, 0)"


def _cards() -> str:
    """Pieces (kind, x) of a match x of DIGITS: from left to right the longest runs of whole groups that are cards.

    Runs in the usual groups of cards come first: another run that overlaps one of them is none.
    """
    run = "array_join(slice(w.g, i + 1, j - i + 1), ' ')"
    valid = f"length({_digits('r')}) between 13 and 19 and r rlike '^[0-9 ]+(?:-[0-9 ]+)*$' and {_luhn(_numbers(_digits('r')))} = 0"
    valid_ends = f"transform(sequence(0, size(w.g) - 1), i -> filter(sequence(i, least(i + 18, size(w.g) - 1)), j -> exists(array({run}), r -> {valid})))"
    usual = f"transform(w.v, (v, i) -> array_max(filter(v, j -> {run} rlike {_sql(USUAL)})))"
    ends = "transform(w.v, (v, i) -> coalesce(w.u[i], case when not exists(slice(w.u, i + 2, coalesce(array_max(v) - i, 0)), z -> z is not null) then array_max(v) end))"
    # the groups at which chosen runs start: the first run that begins after the last one chosen
    starts = "aggregate(sequence(0, size(w.g) - 1), named_struct('free', 0, 's', slice(array(0), 1, 0)), (a, i) -> case when i >= a.free and w.e[i] is not null then named_struct('free', w.e[i] + 1, 's', concat(a.s, array(i))) else a end, a -> a.s)"
    rest = lambda low, high: f"named_struct('kind', cast(null as string), 'x', array_join(slice(w.g, {low} + 1, {high} - {low}), ' '))"
    blank = "named_struct('kind', cast(null as string), 'x', ' ')"
    # before each chosen run what lies between it and the one before, blanks in their places
    low = "case when k = 0 then 0 else w.e[w.s[k - 1]] + 1 end"
    before = f"case when k > 0 then array({blank}) else {_NONE} end, case when w.s[k] > {low} then array({rest(low, 'w.s[k]')}, {blank}) else {_NONE} end"
    card = "array(named_struct('kind', 'card', 'x', array_join(slice(w.g, w.s[k] + 1, w.e[w.s[k]] - w.s[k] + 1), ' ')))"
    last = "w.e[w.s[size(w.s) - 1]] + 1"
    after = f"case when {last} < size(w.g) then array({blank}, {rest(last, 'size(w.g)')}) else {_NONE} end"
    pieces = f"concat(flatten(transform(sequence(0, size(w.s) - 1), k -> concat({before}, {card}))), {after})"
    whole = "array(named_struct('kind', cast(null as string), 'x', x))"
    with_v = f"transform(array(named_struct('g', split(x, ' '))), w -> named_struct('g', w.g, 'v', {valid_ends}))"
    with_u = f"transform({with_v}, w -> named_struct('g', w.g, 'v', w.v, 'u', {usual}))"
    with_e = f"transform({with_u}, w -> named_struct('g', w.g, 'e', {ends}))"
    with_s = f"transform({with_e}, w -> named_struct('g', w.g, 'e', w.e, 's', {starts}))"
    made = f"flatten(transform({with_s}, w -> case when size(w.s) > 0 then {pieces} else {whole} end))"
    return f"case when length({_digits('x')}) >= 13 then {made} else {whole} end"


def _symbols() -> str:
    """``struct(kind, x, v, r)``: symbols and radices of a checked match."""
    x = "s.x"
    part = lambda i, sep: f"split({x}, {_sql(sep)})[{i}]"
    iso = _day(part(0, "-"), part(1, "-"), part(2, "-"))
    dmy = f"coalesce({_day(part(2, '[./]'), part(1, '[./]'), part(0, '[./]'))}, {_day(part(2, '[./]'), part(0, '[./]'), part(1, '[./]'))})"
    days = lambda day: f"datediff({day}, date'1800-01-01')"
    two = lambda n: f"array(cast({n} div 773 as int), cast({n} % 773 as int))"
    area = f"cast({part(0, '-')} as int)"
    alnum = lambda t: f"filter(split({t}, ''), c -> c rlike '[A-Za-z0-9]')"
    code = "case when c between '0' and '9' then cast(c as int) else ascii(upper(c)) - 65 end"
    radix = "case when c between '0' and '9' then 10 else 26 end"
    local, account = f"substring_index({x}, '@', 1)", f"substring(replace({x}, ' ', ''), 5)"
    country = f"case when left({x}, 1) = '+' then regexp_extract({_digits(x)}, {_sql(COUNTRY)}, 0) else '' end"
    card, phone = _digits(x), f"substring({_digits(x)}, length({country}) + 1)"
    v = f"""case s.kind when 'iso' then {two(days(iso))} when 'dmy' then {two(days(dmy))} when 'ip' then transform(split({x}, '[.]'), o -> cast(o as int))
        when 'ssn' then array({area} - case when {area} > 666 then 2 else 1 end, cast({part(1, '-')} as int) - 1, cast({part(2, '-')} as int) - 1)
        when 'card' then {_numbers(f"left({card}, length({card}) - 1)")} when 'phone' then {_numbers(phone)}
        when 'iban' then transform({alnum(account)}, c -> {code}) when 'mail' then transform({alnum(local)}, c -> {code}) end"""
    r = f"""case s.kind when 'iso' then array(189, 773) when 'dmy' then array(189, 773) when 'ip' then array(256, 256, 256, 256) when 'ssn' then array(898, 99, 9999)
        when 'card' then array_repeat(10, length({card}) - 1) when 'phone' then array_repeat(10, length({phone}))
        when 'iban' then transform({alnum(account)}, c -> {radix}) when 'mail' then transform({alnum(local)}, c -> {radix}) end"""
    return f"named_struct('kind', s.kind, 'x', s.x, 'v', {v}, 'r', {r})"


def _feistel(key: str) -> str:
    """``struct(kind, x, v, r)`` with permuted symbols; one round adds to the left half, the next to the right."""
    tag = f"concat({_sql(key)}, '|', case when s.kind in ('iso', 'dmy') then 'date' else s.kind end, '|', cast(size(s.v) as string), '|', cast(k as string), '|'"
    stream = lambda half, i: f"conv(substring(sha2({tag}, array_join({half}, ','), '|', cast({i} div 8 as string)), 256), ({i} % 8) * 8 + 1, 8), 16, 10)"
    half = "size(s.v) div 2"
    left = f"transform(a.l, (d, i) -> cast((d + cast({stream('a.r', 'i')} as bigint)) % s.r[i] as int))"
    right = f"transform(a.r, (d, i) -> cast((d + cast({stream('a.l', 'i')} as bigint)) % s.r[i + {half}] as int))"
    start = f"named_struct('l', slice(s.v, 1, {half}), 'r', slice(s.v, {half} + 1, size(s.v)))"
    net = f"aggregate(sequence(1, {ROUNDS}), {start}, (a, k) -> case when k % 2 = 1 then named_struct('l', {left}, 'r', a.r) else named_struct('l', a.l, 'r', {right}) end, a -> concat(a.l, a.r))"
    return f"named_struct('kind', s.kind, 'x', s.x, 'v', case when s.kind is not null then {net} end, 'r', s.r)"


def _fill(x: str, v: str, pick: str, skip: str = "0") -> str:
    """x with its characters that match ``pick``, after the first ``skip``, replaced in turn by the symbols v."""
    char = f"case when c between '0' and '9' then cast(get({v}, a.n - ({skip})) as string) when c between 'a' and 'z' then chr(97 + get({v}, a.n - ({skip}))) else chr(65 + get({v}, a.n - ({skip}))) end"
    return f"aggregate(filter(split({x}, ''), c -> c <> ''), named_struct('o', '', 'n', 0), (a, c) -> named_struct('o', concat(a.o, case when c rlike '{pick}' and a.n >= {skip} and a.n - ({skip}) < size({v}) then {char} else c end), 'n', a.n + case when c rlike '{pick}' then 1 else 0 end), a -> a.o)"


def _written() -> str:
    """The pseudonym as text, in the notation of the match."""
    x, v = "s.x", "s.v"
    day = f"date_add(date'1800-01-01', {v}[0] * 773 + {v}[1])"
    sep = f"substring(regexp_extract({x}, '[./]', 0), 1, 1)"
    wide = f"case when length({x}) = 10 then 2 else 1 end"
    number = lambda f: f"case when {wide} = 2 then date_format({day}, '{f * 2}') else date_format({day}, '{f}') end"
    swapped = f"contains({x}, '/') and {_day(f'split({x}, {_sql("[./]")})[2]', f'split({x}, {_sql("[./]")})[1]', f'split({x}, {_sql("[./]")})[0]')} is null"
    dmy = f"case when {swapped} then concat({number('M')}, {sep}, {number('d')}, {sep}, date_format({day}, 'yyyy')) else concat({number('d')}, {sep}, {number('M')}, {sep}, date_format({day}, 'yyyy')) end"
    luhn = f"(10 - {_luhn(f'concat({v}, array(0))')}) % 10"
    bare = f"replace({x}, ' ', '')"
    account = _fill(f"substring({bare}, 5)", v, "[A-Z0-9]")
    country_digits = f"length({_digits(x)}) - size({v})"
    check = lambda body: f"lpad(cast(98 - {_mod97(f'concat(left({bare}, 2), {_sql("00")}, {body})')} as string), 2, '0')"
    # the new check digits and account, in the match's own spacing
    whole = f"concat({check(account)}, {account})"
    iban = f"concat(left({x}, 2), aggregate(filter(split(substring({x}, 3), ''), c -> c <> ''), named_struct('o', '', 'n', 1), (a, c) -> named_struct('o', concat(a.o, case when c = ' ' then c else substring({whole}, a.n, 1) end), 'n', a.n + case when c = ' ' then 0 else 1 end), a -> a.o))"
    return f"""case s.kind when 'iso' then date_format({day}, 'yyyy-MM-dd') when 'dmy' then {dmy} when 'ip' then array_join({v}, '.')
        when 'ssn' then format_string('%03d-%02d-%04d', {v}[0] + case when {v}[0] >= 665 then 2 else 1 end, {v}[1] + 1, {v}[2] + 1)
        when 'card' then {_fill(x, f'concat({v}, array({luhn}))', '[0-9]')} when 'phone' then {_fill(x, v, '[0-9]', country_digits)}
        when 'iban' then {iban} when 'mail' then concat({_fill(f"substring_index({x}, '@', 1)", v, '[A-Za-z0-9]')}, '@', substring_index({x}, '@', -1)) else {x} end"""


def pseudonymised(documents: DataFrame, key: str = "lumora-demo-key", text: str = "text") -> DataFrame:
    """``documents`` with all their columns, ``text`` rewritten, and column n_pseudonyms, the values replaced.

    The key belongs in a secret store; the default is for tests and demonstrations. Null texts stay null and
    empty ones empty, with 0 replaced. Repeated rows are rewritten each, alike. Texts of any length are taken
    whole. An empty table gives an empty one. Where ``documents`` has a column n_pseudonyms (in any case)
    of its own, that one stays and the new one has underscores appended.
    """
    made = "n_pseudonyms"
    while made in {c.lower() for c in documents.columns}:
        made += "_"
    source = f"`{text}`"
    # every format holds a digit or an @; most texts hold neither
    first = _between(source, ANY, f"array({_kinds()})")
    second = f"flatten(transform(p, q -> case when q.kind is null and q.x rlike '[0-9]' then {_between('q.x', DIGITS, _cards())} else array(q) end))"
    pieces = f"transform(array({first}), p -> {second})[0]"
    permuted = f"transform(transform({pieces}, s -> {_symbols()}), s -> {_feistel(key)})"
    steps = f"case when {source} rlike '[0-9@]' then transform({permuted}, s -> named_struct('k', s.kind, 't', {_written()})) end"
    rows = documents.withColumn(made, F.expr(steps))
    rows = rows.withColumn(text, F.expr(f"case when {made} is null then {source} else array_join(transform({made}, s -> s.t), '') end"))
    return rows.withColumn(made, F.expr(f"coalesce(size(filter({made}, s -> s.k is not null)), 0)").cast("long"))
