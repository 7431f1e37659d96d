"""Column functions over text: ratios, normalisers, tokens, headings, slugs, coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space of any kind.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


def falsy(text: Column) -> Column:
    """null for the empty string, for chains of defaults."""
    return F.nullif(text, F.lit(""))


def control_ratio(text: Column) -> Column:
    """Share of control characters other than tab, line feed and carriage return."""
    return F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]+", "")) / F.greatest(F.length(text), F.lit(1))


def non_latin_ratio(text: Column) -> Column:
    """Share of letters that are not ASCII; 0 without letters."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    foreign = F.length(F.regexp_replace(letters, r"[A-Za-z]+", ""))
    return F.coalesce(F.try_divide(foreign, F.length(letters)), F.when(text.isNotNull(), 0.0))


def has_nul(text: Column) -> Column:
    return F.contains(text, F.lit("\0"))


def digest_form(text: Column) -> Column:
    """Lower case with runs of white space as one blank, for digests."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def token_count(text: Column) -> Column:
    """Runs without ASCII white space: the default of a tokenizer that may be put in its place."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), r"\S+\s*", "x"))


def chat_tokens(system: Column, user: Column, overhead: int = 4) -> Column:
    return token_count(system) + token_count(user) + 2 * overhead


def words(text: Column) -> Column:
    """Lower-cased ASCII words and numbers, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def years(text: Column) -> Column:
    """Numbers of four digits, taken for years."""
    return F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1))


def headings(text: Column, least: int = 5) -> Column:
    """Titles of `== Title ==` lines."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: (F.length(x) >= least) & x.startswith("==") & x.endswith("=="))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^=+|=+$", ""))), lambda x: x != "")


def flat_sections(sections: Column) -> Column:
    """Texts of sections (text, else content) with a blank line between."""
    return F.array_join(F.transform(sections, lambda s: F.coalesce(falsy(s["text"]), s["content"], F.lit(""))), "\n\n")


# Titles of closing sections, on a line of their own.
CLOSING = ("references", "see also", "external links", "further reading", "notes", "bibliography", "sources", "citations", "updates")


def trim_tail(text: Column, titles: tuple[str, ...] = CLOSING, share: float = 0.4) -> Column:
    """text, stripped, up to its first closing section, if that comes after `share` of it; empty for null."""
    plain = strip(F.coalesce(text, F.lit("")))
    at = F.regexp_instr(plain, F.lit(r"(?iU)\n\s*(?:" + "|".join(titles) + r")\s*\n")) - 1
    return F.when((at >= 0) & (at >= F.floor(F.length(plain) * share)), F.regexp_replace(F.substring(plain, F.lit(1), at), r"(?U)\s+$", "")).otherwise(plain)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n"), lambda x: x != "")


def slug(text: Column, fallback: str = "item", width: int = 48) -> Column:
    """Lower case with runs of other characters as `_`, stripped and then cut."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.coalesce(falsy(F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, width)), F.lit(fallback))


def identifier(text: Column, default: str = "ent") -> Column:
    return F.coalesce(falsy(F.replace(F.trim(text), F.lit(" "), F.lit("_"))), F.lit(default))


def coverage_status(value: Column) -> Column:
    """covered, partial or missing for the words that notes use; partial for none."""
    word = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(word.isin("complete", "covered", "done"), "covered").when(word.isin("partial", "progress", "ongoing", "in_progress", ""), "partial").otherwise("missing")


def certainty(value: Column, default: float = 0.75) -> Column:
    """A number in [0, 1] from a word or a numeral."""
    word = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    number = F.when(word == "low", 0.35).when(word.isin("medium", "mid", "moderate"), 0.6).when(word == "high", 0.85).when(word == "sure", 0.9).when(word == "certain", 1.0)
    numeral = word.try_cast("double")
    return F.coalesce(number, F.when(numeral.between(0, 1), numeral), F.lit(default))


def boolean(value: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin("true", "yes", "1", "y"), True).when(word.isin("false", "no", "0", "n"), False).otherwise(F.lit(default))


def integer(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


#: Fixed value: a key and its value, which may be quoted, in a template.
KEY_VALUE = r"""(\w+)=('[^']*'|"[^"]*"|[^,]+)"""


def template_prefix(text: Column, bare: bool = True) -> Column:
    """The tag before a template's colon; TEXT without one, and nothing for blank text. bare: text is still to be stripped."""
    plain = strip(text) if bare else text
    return F.when(plain == "", plain).when(F.contains(plain, F.lit(":")), F.upper(strip(F.substring_index(plain, ":", 1)))).otherwise("TEXT")


def template_fields(text: Column, bare: bool = True) -> Column:
    """Fields of `TAG:key=value,key='value, with commas'` as a map; the last of equal keys wins. Without a tag: text."""
    plain = strip(text) if bare else text
    rest = F.regexp_replace(plain, r"(?s)^[^:]*:", "")
    unquoted = lambda x: strip(F.regexp_replace(strip(x), r"""(?s)^(['"])(.*)\1$""", "$2"))
    found = F.arrays_zip(F.regexp_extract_all(rest, F.lit(KEY_VALUE), F.lit(1)).alias("k"), F.regexp_extract_all(rest, F.lit(KEY_VALUE), F.lit(2)).alias("v"))
    entries = F.transform(found, lambda x: F.struct(x["k"].alias("key"), unquoted(x["v"]).alias("value")))
    tagged = F.map_from_entries(last_by(entries, lambda x: x["key"]))
    return F.when(F.contains(plain, F.lit(":")), tagged).otherwise(F.create_map(F.lit("text"), plain))


def first_by(items: Column, key) -> Column:
    """items without those whose key an earlier one has."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: key(y) == key(x)))


def last_by(items: Column, key) -> Column:
    """items without those whose key a later one has."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))), lambda y: key(y) == key(x)))


def aliases(text: Column) -> Column:
    """A JSON list, or parts between pipes, semicolons and slashes; ordered and without repeats."""
    listed = F.from_json(text, "array<string>")
    parts = F.split(text, r"[|;/]")
    found = F.coalesce(F.when(text.startswith("[") & text.endswith("]"), listed), parts)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def tolerant_json(text: Column) -> Column:
    """The first of these that parses: the text, a fenced block in it, its first { to its last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & (F.trim(t) != ""), t) for t in (text, fenced, braced)])


# Phrases by which one stream's text leans on another stream.
CROSS_STREAM = (
    r"\bstream\s*(?:one|two|three|1|2|3)\b",
    r"\bprevious\s+stream\b",
    r"\bprior\s+stream\b",
    r"\banother\s+stream\b",
    r"\bother\s+streams?\b",
    r"\bdepends?\s+on\s+stream\b",
    r"\buses?\s+stream\b",
    r"\bbuilds?\s+on\s+stream\b",
    r"\brefin(?:e|ing)\s+stream\b",
)


def cross_stream_reference(text: Column) -> Column:
    """Whether text leans on another stream."""
    return text.rlike("(?i)" + "|".join(CROSS_STREAM))
