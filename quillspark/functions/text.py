"""Text functions as column expressions: tokens, normal forms, n-grams, paths, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fff}"
RUNS = rf"[{HAN}]+|[A-Za-z0-9_]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a lambda inside body uses it many times."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Runs of ASCII word characters in lower case; Han runs, those of three and more followed by all their bigrams. Null: no tokens."""
    t = F.coalesce(text, F.lit(""))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    one = lambda r: F.when(F.ascii(r) < 128, F.array(F.lower(r))).when(F.length(r) <= 2, F.array(r)).otherwise(F.concat(F.array(r), pairs(r)))
    mixed = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(RUNS), F.lit(0)), one))
    return F.when(~ascii_tokens(t), mixed).otherwise(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9_]+"), F.lit(0)))


def ascii_tokens(text: Column) -> Column:
    """Whether all tokens are runs of ASCII: without Han script, and without the two letters whose lower case is ASCII, no token needs a look of its own."""
    return ~text.rlike(rf"[{HAN}\x{{130}}\x{{212a}}]")


def token_estimate(text: Column) -> Column:
    """ASCII words plus single Han characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[A-Za-z0-9_]+|[{HAN}]")).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    """White space of any kind and length as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def rstrip_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), rstrip), "\n")


def letters_only(text: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(rstrip(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def preview(text: Column, limit: int = 120) -> Column:
    return let(collapse(text), lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t))


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def path_parts(path: Column, last: int) -> Column:
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return let(parts, lambda p: F.slice(p, F.greatest(F.lit(1), F.size(p) - last + 1), F.lit(last)))


def none_if_blank(value: Column) -> Column:
    return F.nullif(strip(value.cast("string")), F.lit(""))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def language_guess(text: Column) -> Column:
    """zh if Han characters are at least as many as ASCII letters, en if there are letters, else unknown."""
    han, latin = F.regexp_count(text, F.lit(f"[{HAN}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((han > 0) & (han >= latin), "zh").when(latin > 0, "en").otherwise("unknown")


def glob_pattern(glob: str) -> str:
    """A case-sensitive file glob as a regular expression for rlike; * crosses directories."""
    import fnmatch

    return "^" + fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")


def dedupe_fold(values: Column) -> Column:
    """Distinct values without regard to case, blank ones dropped; the first spelling stays, in order."""
    cleaned = F.filter(F.transform(values, strip), lambda v: v != "")
    low = F.transform(cleaned, F.lower)
    return let(F.arrays_zip(cleaned.alias("v"), low.alias("k")), lambda z: F.transform(F.filter(z, lambda e, i: F.array_position(F.transform(z, lambda x: x["k"]), e["k"]) == i + 1), lambda e: e["v"]))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits after the point, rounded by what the double is exactly, halves to even, as C and SQL engines print it
    (format_string rounds the shortest decimal that stands for the double). For numbers of up to 2**53 / 10**digits."""
    by, split = float(10**digits), float((1 << 27) + 1)

    def of(x: Column) -> Column:
        high = let(x * split, lambda c: c - (c - x))
        whole = F.floor(x * by)
        rest = x * by - whole - 0.5  # the product is off by `error`, which counts where it is a half as it stands
        error = (high * by - x * by) + (x - high) * by
        up = (rest > 0) | ((rest == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        n = F.when(up, whole + 1).otherwise(whole).cast("long")
        return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))

    return F.concat(F.when(value < 0, "-").otherwise(""), let(F.abs(value.cast("double")), of))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def stable_row_id(value: Column) -> Column:
    """The first 63 bits of a SHA-1 below the sign bit, as a number."""
    return F.conv(F.substring(F.sha1(value.cast("binary")), 1, 16), 16, -10).cast("long").bitwiseAND(F.lit(0x7FFF_FFFF_FFFF_FFFF))
