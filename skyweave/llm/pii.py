"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


def _luhn(match: Column) -> Column:
    """Of the digits in a match, the Luhn sum is a multiple of ten."""
    digit = lambda c, i: (F.ascii(c) - 48) * F.when(i % 2 == 1, 2).otherwise(1)
    each = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c, i: F.when(c == "", 0).otherwise(digit(c, i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """The IBAN check: first four characters last, letters as two digits whatever their case, remainder 1 by 97."""
    plain = F.upper(F.regexp_replace(match, "[ -]", ""))
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _count(match: Column, low: int, high: int) -> Column:
    return F.length(_digits(match)).between(low, high)


#: An IBAN's length by its country's code.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUP = r"\x20?[A-Z0-9]"
_IBAN_KNOWN = "(?:" + "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:{_GROUP}{{4}}){{{n // 4 - 1}}}" + (rf"{_GROUP}{{{n % 4}}}" if n % 4 else "") for n, codes in _IBAN_LENGTHS.items()) + r")\b"
#: In groups of four, joined by blanks, hyphens or nothing, in any case: a known code's length and, so that words do not pass, ten digits.
_IBAN_LOOSE = r"(?i:" + "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:[\x20-]?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"[\x20-]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in _IBAN_LENGTHS.items()) + r")\b"
_IBAN_LEAST_DIGITS = 10
#: Of other codes and lengths: as many groups as there are, but none that begins an IBAN of known length.
_IBAN_OTHER = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_IBAN_KNOWN}){_GROUP}{{4}}){{2,7}}(?:{_GROUP}{{1,3}})?\b"


def _iban_part(match: Column) -> Column:
    """The match, or where its length is none of its code's, the longest part up to a blank that passes the check, if any: the words after an IBAN look like more groups."""

    def longest(words: Column) -> Column:
        parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
        return F.get(F.filter(parts, lambda p: p.rlike(f"^{_IBAN_OTHER}$") & _mod97(p)), F.lit(0))

    return F.when(match.rlike(f"^(?:{_IBAN_KNOWN}|{_IBAN_LOOSE})$"), match).otherwise(F.coalesce(let(F.split(match, " "), longest), match))


def _iban(match: Column) -> Column:
    return _mod97(match) & (~match.rlike("[a-z-]") | (F.length(_digits(match)) >= _IBAN_LEAST_DIGITS))


#: A private key's header, with its body and foot where they follow; keys in program texts have \\n for a line's end.
_KEY_BODY = r"[A-Za-z0-9+/=:,.\\\x20\x09-\x0D]"
_PRIVATE_KEY = rf"-----BEGIN\x20(?:[A-Z0-9]{{1,12}}\x20){{0,4}}PRIVATE\x20KEY-----(?:{_KEY_BODY}*+(?:-(?!----){_KEY_BODY}*+){{0,16}}-----END\x20(?:[A-Z0-9]{{1,12}}\x20){{0,4}}PRIVATE\x20KEY-----)?"

_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """name; the pattern; what makes a match a finding; words that raise the score if near it; the part of a match that is meant, from its start.

    A match of score (prior, plus RAISE if a context word stands within `reach` characters before or after it) 0.5 or more that passes `check` is a span.
    Matches in a list, with no other words between them, have the context of any of them.
    Each pattern takes a run of its first class from the start or from the end of the last match, and gives
    nothing back: it finds what the plain pattern would, in time linear in the text.
    """

    name: str
    pattern: str
    hint: str
    check: Callable[[Column], Column]
    prior: float = 0.9
    context: str = ""
    reach: int = 40
    part: Callable[[Column], Column] = lambda m: m


BASE = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@", lambda m: F.lit(True), context=r"(?i)mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), context=r"(?i)\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", lambda m: F.when(_count(m, 13, 19), _luhn(m)).otherwise(False), context=r"(?i)card|visa|credit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: _count(m, 9, 15), context=r"(?i)phone|call|tel|mobile"),
)
EXTRA = (
    Kind("iban", rf"\b(?=[A-Za-z]{{2}}[0-9]{{2}})(?:{_IBAN_KNOWN}|{_IBAN_LOOSE}|{_IBAN_OTHER})", "", _iban, context=r"(?i)iban|account|bank", part=_iban_part),
    Kind("secret", r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|(?i:\b(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\x20\x09-\x0D]{6,})|" + _PRIVATE_KEY, "", lambda m: F.lit(True), context=r"(?i)key|login"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])|(?<![0-9+-])(?<![0-9][.,])(?!000|666|9)[0-9]{3}(\x20?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![.,]?[0-9]|-)", "", lambda m: F.lit(True), prior=0.3, context=r"(?i)ssn|social security|taxpayer"),
)
KINDS = BASE + EXTRA
RAISE = 0.3
#: What may stand between two matches of a list.
_LISTED = r"(?i)^[^\p{L}\p{N}]{0,8}(?:\b(?:and|or)\b[^\p{L}\p{N}]{0,4})?$"
#: Characters of a piece of a text; windows are cut from pieces, so many of them in a long text take no longer each.
_PIECE = 512
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _found(text: Column, kind: Kind) -> Column:
    """Spans of one kind. Places come from the lengths of what lies between the matches, so a text is searched twice, however many it holds."""

    def spans(matches: Column) -> Column:
        def placed(between: Column) -> Column:
            lengths = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: (F.length(b) + F.length(m)).cast("long"))

            def each(starts: Column) -> Column:
                begin = lambda i: F.get(starts, i) + F.length(F.get(between, i))

                def window(pieces: Column, start: Column, end: Column) -> Column:
                    first = F.floor(F.greatest(start, F.lit(0)) / _PIECE).cast("int")
                    around = F.array_join(F.slice(pieces, first + 1, F.lit(kind.reach // _PIECE + 2)), "")
                    return F.substring(around, (F.greatest(start, F.lit(0)) - first * _PIECE + 1).cast("int"), (end - F.greatest(start, F.lit(0))).cast("int"))

                def codes(pieces: Column) -> Column:
                    """A letter for each match: b with a context word near, a without, a capital where it begins a list."""

                    def code(m: Column, i: Column) -> Column:
                        start, end = begin(i), begin(i) + F.length(m)
                        near = window(pieces, start - kind.reach, start).rlike(kind.context) | window(pieces, end, end + kind.reach).rlike(kind.context)
                        letter = F.when(near, "b").otherwise("a")
                        return F.when((i > 0) & F.get(between, i).rlike(_LISTED), letter).otherwise(F.upper(letter))

                    return F.array_join(F.transform(matches, code), "")

                def scored(near: Column) -> Column:
                    def one(m: Column, i: Column) -> Column:
                        start, score = begin(i), F.lit(kind.prior) + F.when(F.get(near, i), F.least(F.lit(RAISE), F.lit(1 - kind.prior))).otherwise(0.0)
                        return let(kind.part(m), lambda p: F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(p)).alias("end"), score.alias("score"), kind.check(p).alias("ok")))

                    checked = F.filter(F.transform(matches, one), lambda x: x["ok"] & (x["score"] >= 0.5))
                    return F.transform(checked, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))

                if not kind.context:
                    return scored(F.array().cast("array<boolean>"))
                lists = F.regexp_extract_all(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), codes), F.lit("[AB][ab]*+"), F.lit(0))
                return let(F.flatten(F.transform(lists, lambda x: F.array_repeat(F.lower(x).contains("b"), F.length(x)))), scored)

            return let(prefix_sums(lengths), each)

        return F.when(F.size(matches) > 0, let(F.split(text, kind.pattern, -1), placed)).otherwise(F.array().cast(_SPANS))

    # a check of single matches comes first: most texts hold none of a kind
    some = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.exists(m, lambda x: kind.check(kind.part(x))), spans(m)).otherwise(F.array().cast(_SPANS)))
    return F.when(F.contains(text, F.lit(kind.hint)), some).otherwise(F.array().cast(_SPANS)) if kind.hint else some


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with `pii`: an array of (kind, start, end, score), by kind as listed, then start; code points, end exclusive.

    Null and empty texts hold none. Kinds do not see each other: spans of different kinds may overlap. A column
    of docs that is called pii is replaced; rows repeated are searched each; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("pii", F.concat(*[_found(text, k) for k in kinds]))


def masked(docs: DataFrame) -> DataFrame:
    """docs (as find_pii returns them) with each span of the text replaced by its kind in angle brackets; overlapping spans become one, named by the first."""

    def rebuilt(spans: Column) -> Column:
        merge = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] > x["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind"))))).otherwise(F.concat(a, F.array(x)))
        union = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), merge)
        part = lambda s, e: F.col("text").substr((s + 1).cast("int"), (e - s).cast("int"))
        pieces = lambda u: F.concat(F.transform(u, lambda x, i: F.concat(part(F.coalesce(F.get(u, i - 1)["end"], F.lit(0).cast("long")), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), F.array(part(F.element_at(u, -1)["end"], F.length("text").cast("long"))))
        return let(union, lambda u: F.array_join(pieces(u), ""))

    ordered = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return docs.withColumn("text", F.when(F.size("pii") > 0, let(ordered, rebuilt)).otherwise(F.col("text"))).drop("pii")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
