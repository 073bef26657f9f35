"""Lyric cleaning and the other text expressions; the word lists of `functions.stopwords`.

All of them are JVM-side column expressions. Patterns avoid `\\s`, `\\w` and `.`, whose
meaning differs between regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cut marker, and the Unicode classes that "word" and "space" stand for.
CUT_MARKER = "____"
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
NO_WORD = f"[^{WORD}{SPACE}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# The characters of SPACE one by one, for trimming.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ANNOTATION = r"[\(\[][^\n\)\]]*[\)\]]"
LYRICS_FIELD = r'"lyrics"[\t-\r ]*:[\t-\r ]*("[^"\\]*(?:\\[^\n][^"\\]*)*")'

# Short stop-word lists, one per language that can be voted for.
STOP_WORDS = {
    "en": (
        "a about after all am an and any are as at be been but by can could did do does for from "
        "had has have he her him his how i if in into is it its just me my no nor not now of on "
        "only or our out over own same she so some such than that the their them then there these "
        "they this those through to too under until up very was we were what when where which "
        "while who whom why will with would you your"
    ).split(),
    "es": (
        "a al algo como con contra cuando de del desde donde durante e el ella ellas ellos en entre "
        "era es esa ese eso esta este esto fue ha hay la las le les lo los me mi mis mucho muy más "
        "nada ni no nos nosotros o os otra otro para pero poco por porque que quien se ser si sin "
        "sobre son su sus sí también tanto te tiene todo todos tu tus tú un una uno y ya yo él"
    ).split(),
    "fr": (
        "ai au aux avec c ce ces cette d dans de des du elle elles en est et eu il ils j je l la le "
        "les leur leurs lui m ma mais me mes moi mon même n ne nos notre nous on ont ou par pas "
        "pour qu que qui s sa se ses si son sont sur t ta te tes toi ton tu un une vos votre vous y "
        "à été être"
    ).split(),
    "de": (
        "aber als am an auch auf aus bei bin bis da das dass dem den der des dich die dir doch du "
        "ein eine einem einen einer er es für hat ich ihr im in ist ja kein man mein mich mir mit "
        "nach nicht noch nur oder sein sich sie sind so und uns vom von vor war was wenn wer wie "
        "wir wird zu zum zur über"
    ).split(),
}
# Which list filters which language; every other language takes the English one.
FILTER_LISTS = ("es", "fr")
DEFAULT_LANGUAGE = "en"
# Votes are compared in this order, so English wins a tie and an empty text.
VOTE_ORDER = ("en", "es", "fr", "de")


def cut_at_marker(text: Column, marker: str = CUT_MARKER) -> Column:
    return F.substring_index(text, marker, 1)


def trim_lines(text: Column) -> Column:
    """Strip every line and drop the ones that were blank."""
    lines = F.transform(F.split(text, LINE_END), lambda line: F.btrim(line, F.lit(SPACE_CHARACTERS)))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NO_WORD, "")


def clean(text: Column) -> Column:
    """Cut, trim lines, lower, strip punctuation; null stays null."""
    return strip_punctuation(trim_lines(cut_at_marker(text)))


def words_of(text: Column) -> Column:
    """The words of `clean(text)`. Trimming lines changes no word, so that step is left out."""
    return tokens(strip_punctuation(cut_at_marker(text)))


def tokens(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda word: word != "")


def strip_annotations(text: Column) -> Column:
    """Delete `(...)` and `[...]` within a line; the brackets need not match."""
    return F.regexp_replace(text, ANNOTATION, "")


def drop_empty_lines(text: Column) -> Column:
    """Drop lines of no characters; lines of blanks stay."""
    return F.array_join(F.filter(F.split(text, LINE_END), lambda line: line != ""), "\n")


def lyrics_from_body(body: Column) -> Column:
    """The `lyrics` string of a JSON body, decoded; null when there is none or it is empty."""
    token = F.regexp_extract(body, LYRICS_FIELD, 1)
    # Line breaks within the token are not JSON, but occur.
    options = {"allowUnquotedControlChars": "true"}
    return F.nullif(F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "ARRAY<STRING>", options), F.lit(0)), F.lit(""))


def normalise_slash(name: Column) -> Column:
    """U+2215 to a plain slash."""
    return F.translate(name, "\u2215", "/")


def query_string(artist: Column, title: Column) -> Column:
    return F.concat(normalise_slash(artist), F.lit(" "), normalise_slash(title))


def lyric_or_null(text: Column) -> Column:
    """The placeholder `no lyric` and blank text count as no lyric."""
    return F.when((F.btrim(text, F.lit(SPACE_CHARACTERS)) != "") & (text != "no lyric"), text)
