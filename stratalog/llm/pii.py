"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Each value found is replaced by a keyed permutation within its own format, so that equal values stay linked across documents
and different values stay different: digits and letters by a Feistel network that adds keyed digits to one half from
the other; payment cards (Luhn-valid only) with a fresh check digit; telephone numbers of ten digits; IPv4 addresses over their 2^32 values; dates over
the 146,097 days of a 400-year cycle, alike in each way of writing; social security numbers by walking the permutation's cycle to the next valid one;
keys in hexadecimal (32 to 64 characters) over the strings of their length. E-mail addresses keep their domain.

How a value is written stays and takes no part in the permutation: blanks, hyphens, brackets and the country code +1 are put back
round the new digits, and the case of an e-mail address's letters on the new letters. So a card, telephone number or address
is the same person's in each way of writing.

Every row is handled by itself: one projection, no shuffle, nothing broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.textbytes import unused

ROUNDS = 8
FIRST_DAY, DAYS, SIDE = "1700-01-01", 146_097, 5_411  # 27 * SIDE days

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What a value of each kind looks like; the first that fits is tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "day_date": r"(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|(?<![\d-])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
}
#: One pattern for all; the date's own group is written out, as a back reference would move.
_ANY = "|".join(p.replace(r"([./])\d{2}\1", r"(?:\.\d{2}\.|/\d{2}/)") for p in PATTERNS.values())


def _let(value: str, name: str, body: str) -> str:
    """Evaluate value once and use it under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _number(text: str, start: str = "1", digits: int = 8) -> str:
    return f"cast(conv(substr({text}, {start}, {digits}), 16, 10) as bigint)"


_HEX = "0123456789abcdef"


def _add(half: str, other: str, turn: str, key: str, hexadecimal: bool) -> str:
    """Add to each digit and small letter of one half a keyed number from the other, within its class or among the hexadecimal digits."""
    shift = lambda low, size: f"chr({low} + (ascii(c) - {low} + k) % {size})"
    char = f"substr('{_HEX}', cast(1 + (instr('{_HEX}', c) - 1 + k) % 16 as int), 1)" if hexadecimal else f"case when c between '0' and '9' then {shift(48, 10)} when c between 'a' and 'z' then {shift(97, 26)} else c end"
    each = f"transform(split({half}, ''), (c, j) -> {_let(_number('h', '1 + (j * 5) % 57', 6), 'k', char)})"
    return _let(f"sha2(concat('{key}:', {turn}, ':', {other}), 256)", "h", f"array_join({each}, '')")


def feistel_text(value: str, key: str, hexadecimal: bool = False) -> str:
    """A keyed permutation of the strings of value's format (length, and class of each character: digit, small letter, or itself)."""
    step = f"if(i % 2 = 1, named_struct('l', {_add('s.l', 's.r', 'i', key, hexadecimal)}, 'r', s.r), named_struct('l', s.l, 'r', {_add('s.r', 's.l', 'i', key, hexadecimal)}))"
    begin = f"named_struct('l', substr(v, 1, cast(length(v) / 2 as int)), 'r', substr(v, 1 + cast(length(v) / 2 as int)))"
    return _let(value, "v", f"aggregate(sequence(1, {ROUNDS}), {begin}, (s, i) -> {step}, s -> concat(s.l, s.r))")


def feistel_pair(left: str, right: str, left_size: int, right_size: int, key: str, finish: str) -> str:
    """A keyed permutation of the pairs below the two sizes; finish makes the result from s.l and s.r."""
    mix = lambda other, turn: _number(f"sha2(concat('{key}:', {turn}, ':', {other}), 256)", "1", 12)
    step = f"if(i % 2 = 1, named_struct('l', (s.l + {mix('s.r', 'i')}) % {left_size}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {mix('s.l', 'i')}) % {right_size}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step}, s -> {finish})"


def _refill(value: str, digits: str) -> str:
    """value with its digits replaced, in turn, by those of `digits`; all else stays."""
    step = f"if(c between '0' and '9', named_struct('t', concat(a.t, substr({digits}, a.k, 1)), 'k', a.k + 1), named_struct('t', concat(a.t, c), 'k', a.k))"
    return f"aggregate(split({value}, ''), named_struct('t', '', 'k', 1), (a, c) -> {step}, a -> a.t)"


def _cased(value: str, small: str) -> str:
    """The letters of `small` in the case of value's at the same places."""
    return f"array_join(zip_with(split({value}, ''), split({small}, ''), (c, s) -> if(c between 'A' and 'Z', upper(s), s)), '')"


def _luhn_sum(digits: str, first_doubled: int) -> str:
    """Sum of the digits from the right, every second one doubled, starting with the first or second."""
    one = "cast(c as int)"
    return f"aggregate(transform(split(reverse({digits}), ''), (c, j) -> if(j % 2 = {1 - first_doubled}, {one} * 2 - if({one} > 4, 9, 0), {one})), 0, (a, x) -> a + x)"


def _date(value: str, parsed: str, pattern: str, key: str) -> str:
    day = f"datediff({parsed}, date'{FIRST_DAY}')"
    done = feistel_pair(f"({day}) div {SIDE}", f"({day}) % {SIDE}", DAYS // SIDE, SIDE, key, f"date_format(date_add(date'{FIRST_DAY}', cast(s.l * {SIDE} + s.r as int)), {pattern})")
    return f"case when {parsed} is not null and {day} between 0 and {DAYS - 1} then {done} end"


def _pseudonym(key: str) -> str:
    """The SQL of x's pseudonym, or null if x is none of the kinds or not valid."""
    key = key.replace("\\", "\\\\").replace("'", "\\'")
    own = {k: "'^(?:" + p.replace("\\", "\\\\") + ")$'" for k, p in PATTERNS.items()}
    digits = "regexp_replace(x, '[^0-9]', '')"
    part = lambda k: f"cast(split(x, '[.]')[{k}] as bigint)"
    octets = "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)"
    day_first = "try_to_timestamp(concat(substr(x, 7, 4), '-', substr(x, 4, 2), '-', substr(x, 1, 2)), 'yyyy-MM-dd')"
    valid_ssn = lambda v: f"({v} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$')"
    walk = f"aggregate(sequence(1, 64), named_struct('v', x, 'ok', false), (w, n) -> if(w.ok, w, {_let(feistel_text('w.v', key), 'y', f'named_struct({chr(39)}v{chr(39)}, y, {chr(39)}ok{chr(39)}, {valid_ssn(chr(121))})')}), w -> w.v)"
    body = _let(feistel_text("substr(d, 1, length(d) - 1)", key), "p", f"concat(p, cast((10 - {_luhn_sum('p', 1)} % 10) % 10 as string))")
    card = _let(digits, "d", _let(body, "q", _refill("x", "q")))
    local = "substring_index(x, '@', 1)"
    email = _let(local, "u", _let(feistel_text("lower(u)", key), "p", _cased("u", "p")))
    own_part = "if(startswith(x, '+1'), substr(x, 3), x)"
    phone = _let(own_part, "u", _let(feistel_text("regexp_replace(u, '[^0-9]', '')", key), "p", _refill("u", "p")))
    return (
        "case "
        f"when x rlike {own['email']} then concat({email}, substr(x, instr(x, '@'))) "
        f"when x rlike {own['secret']} and not x rlike '^[0-9]+$' then {feistel_text('x', key, True)} "
        f"when x rlike {own['ip']} then {feistel_pair(part(0) + ' * 256 + ' + part(1), part(2) + ' * 256 + ' + part(3), 65536, 65536, key, octets)} "
        f"when x rlike {own['iso_date']} then {_date('x', 'to_date(try_to_timestamp(x, ' + repr('yyyy-MM-dd') + '))', repr('yyyy-MM-dd'), key)} "
        f"when x rlike {own['day_date']} then {_date('x', f'to_date({day_first})', 'if(substr(x, 3, 1) = ' + repr('.') + ', ' + repr('dd.MM.yyyy') + ', ' + repr('dd/MM/yyyy') + ')', key)} "
        f"when x rlike {own['ssn']} then case when {valid_ssn('x')} then {walk} end "
        f"when x rlike {own['phone']} then concat(if(startswith(x, '+1'), '+1', ''), {phone}) "
        f"when x rlike {own['card']} then case when {_luhn_sum(digits, 0)} % 10 = 0 then {card} end "
        "end"
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns of docs with the personal data in `column` replaced, plus n_pseudonyms (long).

    A null text stays null with 0; texts without a value are unchanged, byte for byte; values that fail their check (Luhn, calendar,
    ranges) are left; whole texts of any length are handled; a column named n_pseudonyms is replaced, all others stay. The permutation depends
    on key alone, so repeated rows give repeated rows; an empty table gives an empty result.
    """
    text = F.col(f"`{column}`")
    (held,) = unused(docs, "found")
    pattern = _ANY.replace("\\", "\\\\")
    new = f"transform(regexp_extract_all(`{column}`, '{pattern}', 0), x -> named_struct('old', x, 'new', {_pseudonym(key)}))"
    # every kind has a digit, an @ or 32 letters in a row, which is quicker to rule out
    found = docs.withColumn(held, F.when(text.rlike("[0-9@]|[a-f]{32}") & text.rlike(_ANY), F.expr(new)))
    parts = F.split(text, _ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.col(held), lambda p, h: F.array(p, F.coalesce(h["new"], h["old"], F.lit(""))))), "")
    count = F.size(F.filter(held, lambda h: h["new"].isNotNull())).cast("long")
    none = F.col(held).isNull()
    kept = [F.when(none, text).otherwise(joined).alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns if c != "n_pseudonyms"]
    return found.select(*kept, F.when(none, F.lit(0).cast("long")).otherwise(count).alias("n_pseudonyms"))
