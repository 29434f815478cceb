"""Text and line primitives: a Column in, a Column out, no Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from adjudica import settings as S

NFKC = Callable[[Column], Column]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def held(x: Column) -> Column:
    """x as one value that the optimizer does not write out again wherever a part of it is read."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: x), 0)


def some(x: Column) -> Column:
    """Null if empty; ``nullif`` computes x twice where Catalyst cannot move it out, as in a lambda or a branch."""
    return let(x, lambda v: F.when(v != "", v))


def strip(x: Column) -> Column:
    """Without white space at the ends; a list of characters costs less than a pattern."""
    return F.btrim(x, F.lit(S.WHITE_SPACE))


def strip_each(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.when(is_ascii(x), F.btrim(x, F.lit(S.ASCII_WHITE_SPACE))).otherwise(strip(x)))


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def is_ascii(x: Column) -> Column:
    return F.length(x) == F.octet_length(x)


def is_plain(x: Column) -> Column:
    """ASCII but for the rupee sign, which is no letter, digit or white space either."""
    return is_ascii(F.replace(x, F.lit("\u20b9"), F.lit("")))


def ascii_form(pattern: str) -> str:
    """The pattern for plain texts: it finds the same there, without Unicode's classes and cases."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "")


def found(x: Column, pattern: str, group: int = 1, plain: Column | None = None) -> Column:
    """The first match's group; null where there is none or it is empty. ``plain``: whether the text is plain."""
    own = F.regexp_extract(x, pattern, group)
    if plain is not None and ascii_form(pattern) != pattern:
        own = F.when(plain, F.regexp_extract(x, ascii_form(pattern), group)).otherwise(own)
    return some(own)


def matches(x: Column, pattern: str, plain: Column) -> Column:
    return F.when(plain, x.rlike(ascii_form(pattern))).otherwise(x.rlike(pattern))


def printable_share(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\x20-\x7E\n\r\t]+", "")) / F.greatest(F.lit(1), F.length(x))


def is_gibberish(x: Column) -> Column:
    return (F.length(x) > 2000) & (printable_share(x) < 0.55)


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def split_lines(x: Column) -> Column:
    """The lines, without the empty one that a final line end would leave."""
    ended = let(F.split(x, S.LINE_END, -1), lambda parts: F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(ended)


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda text, i: F.struct(i.alias("index"), text.alias("text")))


def is_header(x: Column) -> Column:
    return x.rlike(S.HEADER)


def following(lines: Column, index: Column, most: int) -> Column:
    """Up to ``most`` stripped lines after the index, until a blank or a header, joined by spaces."""
    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("taken"))

    def step(held: Column, line: Column) -> Column:
        def after(over: Column) -> Column:
            return F.struct(over.alias("over"), F.when(over, held["taken"]).otherwise(F.concat(held["taken"], F.array(strip(line)))).alias("taken"))

        return let(held["over"] | let(strip(line), lambda own: (own == "") | is_header(own)), after)

    return F.aggregate(F.slice(lines, index + 2, most), start, step, lambda held: F.array_join(held["taken"], " "))


def joined(stripped: Column) -> Column:
    """Stripped lines with zero characters between them, which only a dot matches."""
    return F.array_join(stripped, "\x00")


def one_text(lines: Column) -> Column:
    return joined(strip_each(lines))


def before_first(joined: Column, pattern: str, plain: Column) -> Column:
    """How many lines of ``joined`` stand before the first that a pattern as for ``first_found`` matches; null if none."""
    return let(found(joined, "(?s)^.*?" + pattern, 0, plain), lambda upto: F.length(upto) - F.length(F.replace(upto, F.lit("\x00"), F.lit(""))))


def first_found(joined: Column, pattern: str, group: int = 1, plain: Column | None = None) -> Column:
    """From the first line of ``one_text`` that matches a pattern without a dot, anchors or negated classes: no such
    match can leave its line, so one search of the whole text finds it."""
    return found(joined, pattern, group, plain)


def context(text: Column, most: int = S.DEFAULTS.context_lines) -> Column:
    kept = F.filter(F.transform(split_lines(text), strip), lambda x: x != "")
    return F.array_join(F.slice(kept, 1, most), "\n")


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def repair_digits(x: Column) -> Column:
    """O and l misread for 0 and 1 next to digits; then only what an amount or date may hold stays."""
    for letters, digit in (("[Oo]", "0"), ("[lI]", "1")):
        for pattern in (rf"(?<=\d){letters}(?=\d)", rf"{letters}(?=\d)", rf"(?<=\d){letters}"):
            x = F.regexp_replace(x, "(?U)" + pattern, digit)
    x = F.regexp_replace(F.replace(x, F.lit("\u200b"), F.lit("")), r"(?U)[^\d.,\-₹Rs$ ]", "")
    return strip(x)


def nfkc(x: Column) -> Column:
    """NFKC by the Unicode library that Spark ships for its collations: only texts beyond ASCII reach it."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.when(x.isNull() | is_ascii(x), x).otherwise(made)


def clean_unicode(x: Column, nfkc: NFKC = nfkc) -> Column:
    """Nothing in ASCII changes, so only texts beyond it are worked on."""
    def folded(v: Column) -> Column:
        for old, new in S.PUNCTUATION.items():
            v = F.replace(v, F.lit(old), F.lit(new))
        return let(v, nfkc)

    return F.when(x.isNull() | is_ascii(x), x).otherwise(folded(x))


def float_or(x: Column, default: float | None = None) -> Column:
    return F.coalesce(strip(x.cast("string")).try_cast("double"), F.lit(default).cast("double"))


def float_plain(x: Column) -> Column:
    """Commas are taken out; null if that is no number."""
    return strip(F.replace(x, F.lit(","), F.lit(""))).try_cast("double")


def float_bare(x: Column) -> Column:
    """All but digits, dots and minus signs are taken out."""
    return F.regexp_replace(x, r"(?U)[^\d.\-]", "").try_cast("double")


def tolerant_json(x: Column) -> Column:
    """A variant of JSON text; single quotes and commas before a closing bracket are forgiven."""
    mended = F.regexp_replace(F.replace(x, F.lit("'"), F.lit('"')), r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(mended))


def title(x: Column) -> Column:
    """Each run of letters with its first letter in upper case and the rest in lower case."""
    parts = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def safe_name(path: Column) -> Column:
    """The last part of a path, without parent steps."""
    return F.replace(F.replace(F.regexp_extract(path, "[^/]*$", 0), F.lit(".."), F.lit("")), F.lit("/"), F.lit("_"))


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)


def two_places_or_null(x: Column) -> Column:
    """``format_string`` writes null out as a word."""
    return let(x, lambda v: F.when(v.isNotNull(), F.format_string("%.2f", v)))
