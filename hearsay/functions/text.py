"""Text expressions; Unicode folding that Spark lacks is a small Arrow function over distinct strings."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: numerals, with thousands' commas and decimals.
NUMERAL = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def has_content(text: Column) -> Column:
    """Does anything stay once control, format and unassigned characters and white space are gone."""
    return F.coalesce(F.length(strip(F.regexp_replace(text, r"\p{C}", ""))) > 0, F.lit(False))


def is_template(text: Column, marker: str = "---{") -> Column:
    """Checklist reviews: the marker, or at least three ballot boxes."""
    boxes = F.length(text) - F.length(F.translate(text, "☐☑☒", ""))
    return F.coalesce((boxes >= 3) | F.contains(text, F.lit(marker)), F.lit(False))


@lru_cache(1 << 16)  # labels come again and again
def _match_key(label: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKC", label) if unicodedata.category(c) != "Cf").casefold()
    return " ".join(re.sub(r"[_-]+", " ", text).split())


@F.pandas_udf(T.StringType())
def match_key(labels: pd.Series) -> pd.Series:
    """The key under which spellings of a label meet: compatibility forms, case, hyphens and spaces folded."""
    return labels.map(_match_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def match_keys(lists: pd.Series) -> pd.Series:
    """match_key of each label of a list."""
    return lists.map(lambda labels: [None if x is None else _match_key(x) for x in labels], na_action="ignore")


@F.pandas_udf(T.StringType())
def candidate_form(labels: pd.Series) -> pd.Series:
    """An open label's own form: case and underscores folded, hyphens kept."""
    return labels.map(lambda x: " ".join(x.casefold().replace("_", " ").split()), na_action="ignore")


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "“”„«»", '"""""')


def numerals(text: Column) -> Column:
    """Numeral tokens in order."""
    return F.regexp_extract_all(text, F.lit(f"({NUMERAL})"), 1)


def quoted_words(inner: Column) -> Column:
    """What a quotation says: without white space at its ends and without the closing punctuation."""
    return strip(F.regexp_replace(strip(inner), r"[.,!?;:…]+$", ""))


def quoted_parts(text: Column) -> Column:
    """What stands between pairs of double quotes, curly ones included; an unpaired last mark opens nothing."""
    parts = F.split(plain_quotes(text), '"', -1)
    inner = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: (x["i"] % 2 == 1) & (x["i"] < F.size(parts) - 1))
    return F.transform(inner, lambda x: quoted_words(x["p"]))


def _running(rows: DataFrame, key: str, order: str, width: Column) -> Column:
    """Sum of the widths of a key's rows before each."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(width).over(before), F.lit(0)).cast("int")


def prose_spans(prose: DataFrame, key: str, *others: str) -> DataFrame:
    """key (distinct), others, start, end, span, kind of prose (key, others, text; quotes plain): paired quotations with their
    marks (quote), numerals outside of them (numeral), and a last mark without a pair (unpaired).

    Texts are cut at their marks, then what lies outside at its numerals; places are running lengths of the pieces.
    """
    cut = prose.select(key, *others, F.size(F.split("text", '"', -1)).alias("n"), F.posexplode(F.split("text", '"', -1)).alias("i", "part"))
    parts = cut.withColumn("at", _running(cut, key, "i", F.length("part") + 1))
    odd, last = F.col("i") % 2 == 1, F.col("i") == F.col("n") - 1
    size, at = F.length("part"), F.col("at")
    marked = parts.filter(odd).select(
        key, *others, (at - 1).alias("start"), F.when(last, at).otherwise(at + size + 1).cast("int").alias("end"),
        F.when(last, F.lit('"')).otherwise(F.concat(F.lit('"'), "part", F.lit('"'))).alias("span"), F.when(last, "unpaired").otherwise("quote").alias("kind"),
    )
    outside = parts.filter(~odd | last).withColumn("numbers", numerals(F.col("part"))).filter(F.size("numbers") > 0)
    gaps = F.transform(F.split("part", NUMERAL, -1), lambda g: F.length(g))
    each = outside.select(key, *others, "at", "i", F.posexplode(F.arrays_zip(F.col("numbers").alias("number"), F.slice(gaps, F.lit(1), F.size("numbers")).alias("gap"))).alias("k", "x"))
    each = each.select(key, *others, "at", F.struct("i", "k").alias("place"), F.col("i").alias("i"), F.col("x.number").alias("span"), F.col("x.gap").alias("gap"))
    piece = Window.partitionBy(key, "i").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("at") + F.col("gap") + F.coalesce(F.sum(F.length("span") + F.col("gap")).over(piece), F.lit(0))
    numbers = each.select(key, *others, start.cast("int").alias("start"), (start + F.length("span")).cast("int").alias("end"), "span", F.lit("numeral").alias("kind"))
    return marked.unionByName(numbers)


#: In masked text: stops inside a quotation, its closing stops, and a mark without a pair.
_HELD, _CLOSING, _ALONE = "\u0001", "\u0002", "\u0003"


def masked(text: Column) -> Column:
    """Text of the same length in which stops inside quotations can be told from others."""
    parts = F.split(text, '"', -1)
    last = F.size(parts) - 1
    closing = lambda p: F.length(F.regexp_extract(p, "[.!?]*$", 0))
    inner = lambda p: F.concat(F.translate(F.left(p, F.length(p) - closing(p)), ".!?", _HELD * 3), F.repeat(F.lit(_CLOSING), closing(p)))
    shown = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < last), inner(p)).otherwise(p))
    whole = F.array_join(shown, '"')
    head = F.array_join(F.slice(shown, F.lit(1), last), '"')
    return F.when(last % 2 == 1, F.concat(head, F.lit(_ALONE), F.get(shown, last))).otherwise(whole)


#: A sentence with the white space after it. After a closing mark, a small letter goes on with the sentence.
_SENTENCE = rf"(?U)(?s:.*?)(?:[.!?]+(?=\s|$)|(?:{_CLOSING}+\"|[.!?]+{_ALONE})(?=\s+[^\sa-z]|\s*$))\s*|(?s:.+)$"


def sentences(prose: DataFrame, key: str) -> DataFrame:
    """key (distinct), place, start, end, sentence of prose (key, text; quotes plain)."""
    cut = prose.select(key, "text", F.posexplode(F.regexp_extract_all(masked(F.col("text")), F.lit(_SENTENCE), 0)).alias("place", "piece"))
    size = F.length("piece")
    placed = cut.withColumn("start", _running(cut, key, "place", size)).withColumn("end", (F.col("start") + size).cast("int"))
    return placed.select(key, "place", "start", "end", F.substring("text", F.col("start") + 1, size).alias("sentence"))


def _ascii(name: str) -> str:
    return unicodedata.normalize("NFKD", name.replace("™", "").replace("℠", "")).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def ascii_fold(names: pd.Series) -> pd.Series:
    """Base letters of accented ones; trade marks and all that has no ASCII form go."""
    return names.map(_ascii, na_action="ignore")


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    low = F.regexp_replace(F.lower(ascii_fold(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(low, r"^-+|-+$", ""), 1, most), r"-+$", "")


def report_path(app_id: Column, name: Column) -> Column:
    word = slug(name)
    return F.concat(F.lit("/reports/"), app_id.cast("string"), F.when(word != "", F.concat(F.lit("/"), word)).otherwise(""))


def _plain_name(name: str) -> str:
    name = unicodedata.normalize("NFKD", re.sub("[™®©℠]", "", name).casefold())
    kept = "".join(c if c.isalnum() else " " for c in name if not unicodedata.combining(c))
    return " ".join(kept.split())


@F.pandas_udf(T.StringType())
def plain_name(names: pd.Series) -> pd.Series:
    """A name's letters and digits alone: case, accents, trade marks and punctuation folded."""
    return names.map(_plain_name, na_action="ignore")


def _roman(token: Column) -> Column:
    """Value of a numeral of i, v and x: an i before the last larger letter counts against it, and so does a v before the last x."""
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
    to_last, to_x = F.regexp_extract(token, "^.*[vx]", 0), F.regexp_extract(token, "^.*x", 0)
    return 10 * count(token, "x") + 5 * (count(token, "v") - 2 * count(to_x, "v")) + count(token, "i") - 2 * count(to_last, "i")


def numeral_signature(plain: Column) -> Column:
    """The numbers in a plain name, digits and short roman numerals alike, in order."""
    tokens = F.filter(F.split(plain, " "), lambda t: t.rlike("^([0-9]+|[ivx]+)$"))
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), t.cast("long")).otherwise(_roman(t).cast("long")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block likeness of two strings, 0 to 1."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def same_name(wanted: Column, found: Column, least: float = 0.85) -> Column:
    """no-data, ok or mismatch of plain names: numbers must agree, then the likeness must reach ``least``, or the wanted name
    of two words or more must be how the found one begins."""
    likeness, begins = sequence_ratio(wanted, found), F.slice(F.split(found, " "), 1, F.size(F.split(wanted, " "))) == F.split(wanted, " ")
    numbers = numeral_signature(wanted) == numeral_signature(found)
    fits = numbers & ((likeness >= least) | ((F.size(F.split(wanted, " ")) >= 2) & begins))
    return F.when(found.isNull(), "no-data").when(fits, "ok").otherwise("mismatch")


def display_name(aspect: Column) -> Column:
    return F.replace(aspect, F.lit("_"), F.lit(" "))


def spaced_keys(text: Column, keys: Column) -> Column:
    """Text in which keys with underscores, whole words alone, are written with spaces; the longest first."""
    long_first = F.array_sort(F.filter(keys, lambda k: F.contains(k, F.lit("_"))), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(long_first, text, lambda t, k: F.regexp_replace(t, F.concat(F.lit(r"\b"), k, F.lit(r"\b")), display_name(k)))


def containing_sentence(span: Column, text: Column, cap: int = 300) -> Column:
    """The span with the rest of its sentence, which .!?… and line feeds bound; past the cap a window of whole words."""
    at = F.instr(text, span)
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(span), F.length(text))
    # a $ would also match before a line end that is the text's last
    lead, tail = F.regexp_extract(before, r"([^.!?…\n]*)\z", 1), F.regexp_extract(after, r"^([^.!?…\n]*[.!?…]?)", 1)
    lead, tail = F.regexp_replace(lead, r"^[\s\p{Z}]+", ""), F.regexp_replace(tail, r"[\s\p{Z}]+\z", "")
    whole = strip(F.concat(lead, span, tail))
    margin = F.floor((F.lit(cap) - F.length(span)) / 2).cast("int")
    left = F.right(lead, margin)
    left = F.when(F.contains(left, F.lit(" ")), F.regexp_replace(left, r"^[^ ]* ", "")).otherwise(left)
    right = F.left(tail, margin)
    right = F.when(F.contains(right, F.lit(" ")), F.regexp_replace(right, r" [^ ]*\z", "")).otherwise(right)
    left = F.when(F.length(lead) > margin, F.concat(F.lit("… "), left)).otherwise(lead)
    right = F.when(F.length(tail) > margin, F.concat(right, F.lit(" …"))).otherwise(tail)
    window = F.when(margin <= 0, span).otherwise(F.concat(left, span, right))
    return F.when(text.isNull() | (at == 0), span).when(F.length(whole) > cap, window).otherwise(whole)


def breached(output: Column, beacon: Column) -> Column:
    """Does an output hold a canary's beacon, in any case."""
    return F.contains(F.lower(output), F.lower(beacon))


def highlighted(text: Column, part: Column, mark: str = "**") -> Column:
    """Text with the first occurrence of a part between marks."""
    at = F.instr(text, part)
    shown = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(mark), part, F.lit(mark), F.substring(text, at + F.length(part), F.length(text)))
    return F.when(at > 0, shown).otherwise(text)


def backtick_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1)


def is_snake_case(label: Column) -> Column:
    return label.rlike("^[a-z][a-z0-9_]*$")


def fence_for(text: Column) -> Column:
    """Backticks, three at least, and more than any run of them in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def visitor(header: Column, peer: Column) -> Column:
    """The last entry of a forwarding header, which the own proxy has written; without one the peer."""
    last = F.trim(F.element_at(F.split(header, ","), -1))
    return F.coalesce(F.when(last != "", last), peer)


def seed64(text: Column) -> Column:
    """The first eight bytes of a text's sha256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


#: Decimals at which a value can be told from its rounding: doubles have no more than 17 digits.
PLACES = 18


def numeral_value(token: Column) -> tuple[Column, Column]:
    """A numeral's own number of decimals and its value; a value of more decimals than PLACES (zeros at the end aside) is
    null, and so is one that is too large to be told from others."""
    bare = F.replace(token, F.lit(","), F.lit(""))
    places = F.length(F.regexp_extract(bare, r"\.(\d+)$", 1))
    short = F.when(places > PLACES, F.regexp_replace(bare, r"0+$", "")).otherwise(bare)
    fits = F.length(F.regexp_extract(short, r"\.(\d+)$", 1)) <= PLACES
    return F.least(places, F.lit(PLACES)), F.when(fits, short.try_cast("decimal(38,18)"))


def roundings(values: DataFrame, by: str) -> DataFrame:
    """by, value -> by, places, number, value: the least value that rounds, half up, to a number at a number of decimals."""
    exact = F.col("value").cast("string").try_cast("decimal(38,18)")
    every = F.array(*(F.struct(F.lit(p).alias("places"), F.round(exact, p).cast("decimal(38,18)").alias("number")) for p in range(PLACES + 1)))
    rows = values.select(by, "value", F.inline(every)).filter("number IS NOT NULL")
    return rows.groupBy(by, "places", "number").agg(F.min("value").alias("value"))
