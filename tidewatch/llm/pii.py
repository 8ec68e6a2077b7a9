"""Personal data by format-preserving Feistel pseudonyms, with column expressions only.

A value that passes its kind's validation (check digits, ranges, calendar) is moved by a keyed permutation within its own format: a card
number becomes a card number with a right check digit, a date a date. Equal values become equal pseudonyms in every document, whatever their
separators; the permutation is its own kind of secret: without the key it can't be undone.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare

# What each kind looks like (Java syntax), in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}){1,8}(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])(?:(?:ABIA|ACCA|AGPA|AIDA|AIPA|AKIA|ANPA|ANVA|AROA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[prs]k_(?:live|test)_[A-Za-z0-9]{16,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex_secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "password": r"(?<![A-Za-z0-9])(?i:password)(?:=[\"']?[^\s\"']{6,}|[ \t]{0,8}[:=][ \t]{0,8}[\"']?(?=[^\s\"']*(?:[0-9]|[!@#$%^&*+=~?_][A-Za-z0-9]))[^\s\"']{6,})",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])",
}
# What stays of a secret: the words before a password, the prefix of a key.
PASSWORD_HEAD = r"^(?i:password)[ \t]*[:=][ \t]*[\"']?"
KEY_HEAD = r"^(?:gh[oprsu]_|github_pat_|glpat-|xox[abeoprs]-|AIza|[prs]k_(?:live|test)_|A[A-Z]{3})"
# Every kind implies one of these: texts without any skip the search.
SIGN = r"[0-9@]|(?i:password)|A(?:BIA|CCA|GPA|IDA|IPA|KIA|NPA|NVA|ROA|SIA|Iza)|gh[oprsu]_|github_pat_|glpat-|xox[abeoprs]-|[prs]k_(?:live|test)_|[a-f]{32}|[A-F]{32}"
# Lengths of a country's IBAN (registry); other lengths and countries are taken where the check digits are right.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IS TR", 27: "BF BI CF CG CM DJ EG FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BJ BY CI CY DO GT HN HU LB ML NE NI PL SN SV TG",
    29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
OPEN_ENDED = ("email", "access_key", "hex_secret", "password")  # of any length, and always valid where they match
WINDOW = 64  # longer than any value of the other kinds (an IBAN in groups has 43) and the character after it
CHUNK = 64
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 8
FIRST_YEAR, MONTHS = 1900, 2400  # to 2099-12
EARLY, LATE = (160, 180), (200, 228)  # days to the 12th: 2,400 x 12; days after it: 2,400 x 19 places, of which 3 % are no days
WALK = 24  # steps within which a walk over the latter meets a day but once in 10^36 times
KEY_SETTING = "spark.tidewatch.pii.key"


@dataclass(frozen=True)
class PiiConfig:
    key: str  # kept by whoever may link or undo the pseudonyms; plans and logs have only what is derived from it for a kind
    kinds: tuple[str, ...] = tuple(KINDS)


def quoted(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """body with the name bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Feistel:
    """SQL text of keyed permutations."""

    def __init__(self, key: str, kind: str):
        self.key = hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()

    def digest(self, tweak: str, state: str, turn: str) -> str:
        return f"sha2(concat('{self.key}|{tweak}|', {turn}, '|', {state}), 512)"

    def pair(self, left: str, right: str, a: int, b: int, tweak: str) -> str:
        """A permutation of [0, a) x [0, b), as a struct of l and r."""
        add = lambda x, y, m: f"cast(({x} + cast(conv(substr({self.digest(tweak, y, 't')}, 1, 12), 16, 10) as bigint)) % {m} as bigint)"
        step = f"if(t % 2 = 0, named_struct('l', {add('s.l', 's.r', a)}, 'r', s.r), named_struct('l', s.l, 'r', {add('s.r', 's.l', b)}))"
        return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, t) -> {step})"

    def chars(self, text: str, alphabet: str, tweak: str) -> str:
        """The string with each character moved within its alphabet; `alphabet` is SQL over its character c and place i (from 0), the
        character itself to keep it. Even and odd places are the two halves, which take turns."""
        others = "array_join(transform(filter(v, (x, i) -> i % 2 <> t % 2), x -> cast(x as string)), ',')"
        moved = "transform(v, (x, i) -> if(i % 2 = t % 2, cast((x + cast(conv(substr(hs[i div 64], 1 + 4 * cast(floor(i / 2) % 32 as int), 4), 16, 10) as int)) % length(al[i]) as int), x))"
        # a digest for every 64 characters, so that long values don't repeat one
        digests = let(others, "o", f"transform(sequence(0, (size(v) - 1) div 64), b -> {self.digest(tweak, 'o', "concat(t, if(b = 0, '', concat('#', b)))")})")
        walk = f"aggregate(sequence(0, {ROUNDS - 1}), transform(ch, (c, i) -> cast(locate(c, al[i]) - 1 as int)), (v, t) -> {let(digests, 'hs', moved)})"
        out = f"array_join(transform({walk}, (x, i) -> substr(al[i], x + 1, 1)), '')"
        return let(f"split({text}, '')", "ch", let(f"transform(ch, (c, i) -> {alphabet})", "al", out))


def by_class(keep: str = "false") -> str:
    """Digits stay digits, small letters small and capitals capitals; anything else, and where `keep` holds, stays itself."""
    return f"case when {keep} then c when c rlike '[0-9]' then '{DIGITS}' when c rlike '[a-z]' then '{LOWER}' when c rlike '[A-Z]' then '{UPPER}' else c end"


def bare(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9A-Za-z]', '')"


def reformed(m: str, plain: str) -> str:
    """The characters of `plain` in the places of m's letters and digits; separators stay."""
    place = f"length({bare(f'substr({m}, 1, i + 1)')})"
    return let(plain, "p", f"array_join(transform(split({m}, ''), (c, i) -> if(c rlike '[0-9A-Za-z]', substr(p, {place}, 1), c)), '')")


def luhn_digit(payload: str) -> str:
    """Check digit after a payload of digits."""
    digit = f"cast(substr({payload}, length({payload}) - k, 1) as int)"
    doubled = f"if(k % 2 = 0, {digit} * 2 - if({digit} > 4, 9, 0), {digit})"
    return f"cast((10 - aggregate(sequence(0, length({payload}) - 1), 0, (a, k) -> a + {doubled}) % 10) % 10 as string)"


def mod97(text: str) -> str:
    """ISO 7064 remainder of letters (A is 10) and digits."""
    return f"aggregate(split({text}, ''), 0, (a, c) -> cast(if(c rlike '[0-9]', a * 10 + cast(c as int), a * 100 + ascii(c) - 55) % 97 as int))"


def parsed_date(m: str) -> str:
    """The date of yyyy-mm-dd, d.m.yyyy or d/m/yyyy (month first where the second number is no month); null if there is none."""
    flat = f"regexp_replace({m}, '[./]', '-')"
    return f"cast(if({m} rlike '^[0-9]{{4}}-', try_to_timestamp({m}, 'yyyy-MM-dd'), coalesce(try_to_timestamp({flat}, 'd-M-yyyy'), try_to_timestamp({flat}, 'M-d-yyyy'))) as date)"


def pseudonym(kind: str, m: str, cfg: PiiConfig) -> str:
    """SQL of the pseudonym of a match m; null where it fails the kind's validation."""
    f = Feistel(cfg.key, kind)
    if kind == "email":  # all but the last label
        top = f"substring_index({m}, '.', -1)"
        return f"concat({f.chars(f'left({m}, length({m}) - length({top}) - 1)', by_class(), kind)}, '.', {top})"
    if kind == "access_key":
        head = f"length(regexp_extract({m}, {quoted(KEY_HEAD)}, 0))"
        plain = f"if({m} rlike '^A[A-Z]{{3}}[0-9A-Z]{{16}}$', '{DIGITS}{UPPER}', {by_class()})"
        return let(head, "hd", f"concat(substr({m}, 1, hd), {f.chars(f'substr({m}, hd + 1)', plain, kind)})")
    if kind == "hex_secret":
        return f.chars(m, f"if({m} rlike '[A-F]', '{DIGITS}ABCDEF', '{DIGITS}abcdef')", kind)
    if kind == "password":
        head = f"length(regexp_extract({m}, {quoted(PASSWORD_HEAD)}, 0))"
        return let(head, "hd", f"concat(substr({m}, 1, hd), {f.chars(f'substr({m}, hd + 1)', by_class(), kind)})")
    if kind == "iban":
        moved, turned = f.chars("substr(b, 5)", by_class(), kind), mod97("concat(w, substr(b, 1, 2), '00')")
        whole = let(moved, "w", f"concat(substr(b, 1, 2), lpad(cast(98 - {turned} as string), 2, '0'), w)")
        return let(bare(m), "b", f"if(length(b) between 15 and 34 and {mod97('concat(substr(b, 5), substr(b, 1, 4))')} = 1, {reformed(m, whole)}, null)")
    if kind == "ip":
        octet = lambda k: f"cast(split({m}, '[.]')[{k}] as int)"
        valid = " and ".join(f"{octet(k)} < 256" for k in range(4))
        moved = f.pair(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, kind)
        dotted = "concat_ws('.', q.l div 256, q.l % 256, q.r div 256, q.r % 256)"
        return f"if({valid}, {let(moved, 'q', dotted)}, null)"
    if kind == "date":
        # days to the 12th and days after it are permuted apart: the latter must stay so where the month is written first, and then in all forms alike
        month = f"((year(d) - {FIRST_YEAR}) * 12 + month(d) - 1)"
        early = lambda i: f.pair(f"{i} div {EARLY[1]}", f"{i} % {EARLY[1]}", *EARLY, kind)
        late = lambda l, r: f.pair(l, r, *LATE, f"{kind} late")
        first = lambda n: f"make_date(cast({FIRST_YEAR} + {n} div 12 as int), cast({n} % 12 + 1 as int), 1)"
        place = f"(x.l * {LATE[1]} + x.r)"
        is_day = f"{place} % 19 + 13 <= day(last_day({first(f'({place} div 19)')}))"
        index = f"({month} * 19 + day(d) - 13)"
        walk = f"aggregate(sequence(1, {WALK}), {late(f'{index} div {LATE[1]}', f'{index} % {LATE[1]}')}, (x, u) -> if({is_day}, x, {late('x.l', 'x.r')}))"
        new_early = let(early(f"({month} * 12 + day(d) - 1)"), "q", let(f"(q.l * {EARLY[1]} + q.r)", "z", f"date_add({first('(z div 12)')}, cast(z % 12 as int))"))
        new_late = let(walk, "x", f"if({is_day}, date_add({first(f'({place} div 19)')}, cast({place} % 19 + 12 as int)), null)")
        month_first = f"{m} rlike '^[0-9]{{1,2}}[./](?:1[3-9]|2[0-9]|3[01])[./]'"
        mark = f"regexp_extract({m}, '[./]', 0)"
        wide = f"{m} rlike '^[0-9]{{2}}.[0-9]{{2}}.'"
        one, two = (f"if({wide}, {a}, {b})" for a, b in (("if(mf, 'MM', 'dd')", "if(mf, 'M', 'd')"), ("if(mf, 'dd', 'MM')", "if(mf, 'd', 'M')")))
        shown = f"if({m} rlike '^[0-9]{{4}}-', date_format(n, 'yyyy-MM-dd'), concat(date_format(n, {one}), {mark}, date_format(n, {two}), {mark}, date_format(n, 'yyyy')))"
        new = let(month_first, "mf", let(f"if(day(d) > 12, {new_late}, {new_early})", "n", f"if(n is null, null, {shown})"))
        return let(parsed_date(m), "d", f"if(d is null or year(d) < {FIRST_YEAR} or {month} >= {MONTHS}, null, {new})")
    if kind == "ssn":
        area, group, serial = (f"cast(split({m}, '-')[{k}] as int)" for k in range(3))
        valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
        index = f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1"
        moved = f.pair(index, f"{serial} - 1", 898 * 99, 9999, kind)
        new = "concat(lpad(cast(q.l div 99 + if(q.l div 99 > 664, 2, 1) as string), 3, '0'), '-', lpad(cast(q.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(q.r + 1 as string), 4, '0'))"
        return f"if({valid}, {let(moved, 'q', new)}, null)"
    if kind == "phone":
        kept = f"case when {m} like '+1%' then 1 when {m} like '+%' then 2 else 0 end"
        return let(bare(m), "b", f"if(length(b) between 8 and 15, {reformed(m, f.chars('b', by_class(f'i < {kept}'), kind))}, null)")
    if kind == "card":
        moved = f.chars("substr(b, 1, length(b) - 1)", by_class("i < 1"), kind)
        whole = let(moved, "w", f"concat(w, {luhn_digit('w')})")
        return let(bare(m), "b", f"if({luhn_digit('substr(b, 1, length(b) - 1)')} = right(b, 1), {reformed(m, whole)}, null)")
    raise ValueError(f"unknown kind {kind}")


def search_pattern(kinds: tuple[str, ...]) -> str:
    return "|".join(f"(?:{KINDS[k]})" for k in kinds)


def ends(kind: str, m: str) -> str:
    """SQL of the array of matches that start where m does, m the longest, in the order in which they are tried: an IBAN of its country's length first, then the longest."""
    if kind not in ("iban", "phone"):
        return f"array({m})"
    whole = quoted("^(?:" + KINDS[kind] + ")$")
    shorter = f"filter(transform(sequence(length({m}), 1, -1), i -> if(i = length({m}) or substr({m}, i + 1, 1) rlike '[^0-9A-Za-z]', substr({m}, 1, i), '')), e -> e rlike {whole})"
    if kind == "phone":
        return shorter
    cases = " ".join(f"when substr({m}, 1, 2) in ({', '.join(repr(c) for c in codes.split())}) then {n}" for n, codes in IBAN_LENGTHS.items())
    return let(shorter, "es", f"concat(filter(es, e -> length({bare('e')}) = case {cases} else 0 end), es)")


def replacement(w: str, cfg: PiiConfig) -> str:
    """SQL of what the window w (a place's text, after the character before it) starts with: the first valid match as new, kind and length; null if none is valid."""
    tries = []
    for kind in cfg.kinds:
        start = f"regexp_extract({w}, {quoted('^(?s:.)(' + KINDS[kind] + ')')}, 1)"
        named = let(pseudonym(kind, "e", cfg), "o", f"if(o is null, null, named_struct('new', o, 'kind', '{kind}', 'length', length(e)))")
        tries.append(let(start, "m", f"if(m = '', null, get(filter(transform({ends(kind, 'm')}, e -> {named}), x -> x is not null), 0))"))
    return f"coalesce({', '.join(tries)})"


def rewritten(steps: str) -> str:
    """SQL of an array of text and kind (null where nothing is replaced), from the pieces p of a text and the value r that each may start with.

    From left to right; a piece within a value taken is dropped so far. `left` is what is still to drop. Chunks keep the work linear.
    """
    unit = "array<struct<text:string,kind:string>>"
    more = "if(t.left = 0, x.r, null)"
    drop = "if(t.left = 0, coalesce(x.r.length, 0), t.left)"
    one = f"named_struct('left', greatest({drop} - length(x.p), 0), 'out', concat(t.out, array(named_struct('text', concat(coalesce({more}.new, ''), substr(x.p, {drop} + 1)), 'kind', {more}.kind))))"
    inner = f"aggregate(c, named_struct('left', s.left, 'out', cast(array() as {unit})), (t, x) -> {one})"
    outer = let(inner, "u", "named_struct('left', u.left, 'out', concat(s.out, array(u.out)))")
    chunks = f"transform(sequence(0, (size({steps}) - 1) div {CHUNK}), k -> slice({steps}, cast(k * {CHUNK} + 1 as int), {CHUNK}))"
    return f"flatten(aggregate({chunks}, named_struct('left', 0, 'out', cast(array() as array<{unit}>)), (s, c) -> {outer}).out)"


def pseudonymise(docs: DataFrame, cfg: PiiConfig) -> DataFrame:
    """docs with the text rewritten, and the columns pii_kinds (kind of each value replaced, in order) and pii_found (their number).

    Values that look like a kind but fail its validation stay as they are; at each place all kinds and lengths are tried, then the next places, those inside a failed match too. Null texts stay null, with no values; texts
    without values come back unchanged. Repeated rows change alike; an empty table gives no rows. Columns named pii_kinds or pii_found are replaced.

    Scale: one projection, no exchange, no Python; texts without a SIGN (a digit, @, the word password, a key's prefix or 32 hex letters) skip the search. A place's window holds the value there and 64 characters more.
    """
    pattern = f"(?={search_pattern(cfg.kinds)})"
    plain = docs.drop("pii_kinds", "pii_found")
    m, b, r = spare(plain, "__matches"), spare(plain, "__between"), spare(plain, "__replaced")
    # a place's window: what an open-ended kind matches there, whatever its length, and what the other kinds may need after it
    whole = "|".join(f"(?:{KINDS[k]})" for k in cfg.kinds if k in OPEN_ENDED)
    windows = F.regexp_extract_all("text", F.lit(f"{pattern}(?=((?:{whole})?+(?s:.{{0,{WINDOW}}})))" if whole else f"{pattern}(?=((?s:.{{1,{WINDOW}}})))"), F.lit(1))
    out = plain.withColumn(m, F.when(F.col("text").rlike(SIGN), windows))
    out = out.withColumn(b, F.when(F.size(m) > 0, F.split("text", pattern, -1)))  # one more than matches, unless the text starts with one
    before = f"coalesce(right(get({b}, i + size({b}) - size({m}) - 1), 1), ' ')"
    found = f"transform({m}, (v, i) -> {let(f'concat({before}, v)', 'w', replacement('w', cfg))})"
    out = out.withColumn(r, F.when(F.size(m) > 0, F.expr(found)))
    aligned = f"if(size({b}) > size({m}), concat(array(null), {r}), {r})"
    out = out.withColumn(r, F.when(F.size(F.expr(f"filter({r}, x -> x is not null)")) > 0, F.expr(f"zip_with({b}, {aligned}, (p, r) -> named_struct('p', p, 'r', r))")))
    out = out.withColumn(r, F.when(F.col(r).isNotNull(), F.expr(rewritten(r))))
    out = out.withColumn("text", F.when(F.col(r).isNotNull(), F.expr(f"array_join({r}.text, '')")).otherwise(F.col("text")))
    kinds = F.coalesce(F.expr(f"filter({r}.kind, k -> k is not null)"), F.expr("cast(array() as array<string>)"))
    return out.withColumn("pii_kinds", kinds).withColumn("pii_found", F.size("pii_kinds")).drop(m, b, r)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of the session's setting; without one, a key that anyone can read, good for trials only."""
    cfg = PiiConfig(spark.conf.get(KEY_SETTING, "trial"))
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), cfg).select("doc_id", "text", "pii_kinds", "pii_found")
