"""One consistent form for text: a confusables skeleton.

Decompose, drop invisible characters, replace every character by its prototype from the look-alike table, decompose again. Two texts
look alike when their skeletons are equal. Letter case, visible accents, digits of other scripts, punctuation and wording stay as
they are, and ASCII characters are their own prototypes, so `l`, `1`, `I` and `|`, or `m` and `rn`, remain different. The look-alike table is Unicode's
public one, as the ICU library that comes with Spark holds it; the short table below serves where no session is at hand.

The skeleton is a key, never a text. A text is shown in its clean form: composed, plain in width and spaces, without invisible
characters, and with letters of another alphabet replaced only in words of mixed script, or where nothing in the text shows that alphabet to be meant.
Texts that look alike share one clean form, the smallest of theirs.

Defined results: null gives null, the empty text gives the empty text, texts of any length are taken whole, line breaks and tabs are
kept (they show), the kind of a space is not kept but its number is.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.sizes import broadcast_if_small
from starloom.lineage import cut

#: Fixed values, after Unicode's public confusables data: letters of other alphabets drawn like a Latin letter, by that letter.
LOOK_ALIKES = {
    "a": "ɑа", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "р", "q": "ԛ", "r": "ᴦ",
    "s": "ѕꜱ", "u": "սᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "G": "Ԍ",
    "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս",
    "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ",
}
#: Fixed values, from the same data: independent vowels drawn like a letter and a vowel sign, which Unicode does not decompose.
COMPOSED_VOWELS = {
    "\u0906": "\u0905\u093e", "\u0910": "\u090f\u0947", "\u0911": "\u0905\u0949", "\u0912": "\u0905\u094a", "\u0913": "\u0905\u094b", "\u0914": "\u0905\u094c",
    "\u0986": "\u0985\u09be", "\u0a06": "\u0a05\u0a3e", "\u0a86": "\u0a85\u0abe", "\u0a93": "\u0a85\u0acb", "\u0a94": "\u0a85\u0acc", "\u0b06": "\u0b05\u0b3e",
    "\u0b94": "\u0b92\u0bb3", "\u0c13": "\u0c12\u0c55", "\u0c14": "\u0c12\u0c4c",
}
#: And the length mark into which Unicode takes apart the vowel sign `au` of Tamil, drawn like a letter.
_LETTERS = COMPOSED_VOWELS | {"\u0bd7": "\u0bb3"} | {ch: latin for latin, drawn in LOOK_ALIKES.items() for ch in drawn}

#: Compatibility decompositions that keep the look: width, kind of space, ligatures and presentation forms.
KEEPS_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
VIRAMAS = {chr(base + 0x4D) for base in range(0x900, 0xD80, 0x80)}
JOINERS = {"\u200c", "\u200d"}


def invisible(ch: str) -> bool:
    """Characters that draw nothing: format characters, variation selectors, fillers."""
    code = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0)


class Prototypes(dict):
    """Prototype of a code point, worked out on first use: the one in `letters`, else its plain form if only width, kind of space, ligature or presentation differ."""

    def __init__(self, letters: dict[str, str]) -> None:
        super().__init__()
        self.letters = letters

    def __missing__(self, code: int) -> str:
        self[code] = out = self.find(chr(code))
        return out

    def find(self, ch: str) -> str:
        if ch in self.letters:
            return self.letters[ch]
        if ch in JOINERS:
            return ch  # decided with its neighbours
        if invisible(ch):
            return ""
        if unicodedata.category(ch) == "Zs":
            return " "
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if kind in KEEPS_LOOK or kind == "<compat>" and (unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl"):
            whole = "".join(chr(int(x, 16)) for x in rest.split())
            return "".join(self.find(x) for x in unicodedata.normalize("NFD", whole))
        return ch


#: The second leaves look-alike letters as they are.
PROTOTYPES, PLAIN = Prototypes(_LETTERS), Prototypes({ch: ch for letters in LOOK_ALIKES.values() for ch in letters})


def public_letters(spark: SparkSession) -> dict[str, str]:
    """Letters and marks with the prototypes of Unicode's public table (ideographs and syllables composed of letters aside), in one call to ICU.

    Left out are prototypes with ASCII characters that aren't letters, as digits and punctuation show. ICU draws `I`, `l` and `1`, and `m` and `rn`,
    together; here a capital drawn so is an `I`, any other letter an `l`, and `rn` an `m`.
    """
    jvm = spark.sparkContext._jvm
    checker = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    wide = ((0x3400, 0xA000), (0xAC00, 0xD800), (0x17000, 0x18D10), (0x20000, 0x110000))
    chars = [ch for code in range(0x80, 0x20000) if unicodedata.category(ch := chr(code))[0] in "LM" and not any(a <= code < b for a, b in wide)]
    drawn = checker.getSkeleton("\n".join("x" + ch for ch in chars)).split("\n")
    if len(drawn) != len(chars):
        raise ValueError("the look-alike table can't be read")
    out = {}
    for ch, form in zip(chars, drawn):
        form = form.removeprefix("x").replace("rn", "m")
        if ch != form and unicodedata.normalize("NFD", ch) != form and form and not any(x.isascii() and not x.isalpha() for x in form):
            out[ch] = form.replace("l", "I") if unicodedata.category(ch) == "Lu" else form
    out |= {ch: latin for latin, letters in LOOK_ALIKES.items() for ch in letters}
    for vowel, two in COMPOSED_VOWELS.items():
        # the public table takes some vowels apart further than their sign; the sign is then taken apart alike
        form = out.setdefault(vowel, two)
        if form != two and form[0] == two[0]:
            out.setdefault(two[1], form[1:])
    for _ in range(4):  # prototypes of prototypes
        table = Prototypes(out)
        out = {ch: skeleton(form, table) for ch, form in out.items()}
    return out


def skeleton(text: str | None, prototypes: Prototypes = PROTOTYPES) -> str | None:
    if text is None or text.isascii():
        return text
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes))
    return without_joiners(out)


def without_joiners(text: str) -> str:
    """A joiner shows only after a virama."""
    if JOINERS.isdisjoint(text):
        return text
    return unicodedata.normalize("NFD", "".join(ch for i, ch in enumerate(text) if ch not in JOINERS or i and text[i - 1] in VIRAMAS))


_WORD = regex.compile(r"(?:\p{L}\p{M}*)+")
_FOREIGN = {ord(ch): latin for latin, letters in LOOK_ALIKES.items() for ch in letters}
_ANY_FOREIGN = re.compile("[" + "".join(map(chr, _FOREIGN)) + "]")
_TWO_PARTS = {two: one for one, two in COMPOSED_VOWELS.items()}
_TWO = re.compile("|".join(_TWO_PARTS))


def _alphabet(ch: str) -> str:
    """The first word of a letter's name, which is its script."""
    return "LATIN" if ch.isascii() else unicodedata.name(ch, "?").split(" ")[0]


def clean(text: str | None) -> str | None:
    """The form for display: composed, plain, and with look-alike letters only where they are meant."""
    if text is None or text.isascii():
        return text
    out = without_joiners(unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(PLAIN)))
    out = _TWO.sub(lambda m: _TWO_PARTS[m[0]], unicodedata.normalize("NFC", out))
    if _ANY_FOREIGN.search(out):
        words = [(m, {_alphabet(ch) for ch in m[0] if ch.isalpha()}) for m in _WORD.finditer(out)]
        # an alphabet is meant where a word of its letters alone holds one that isn't drawn like a Latin one
        meant = {next(iter(a)) for m, a in words if len(a) == 1 and any(ch.isalpha() and ord(ch) not in _FOREIGN for ch in m[0])}
        pieces, at = [], 0
        for m, alphabets in words:
            if alphabets != {"LATIN"} and (len(alphabets) > 1 or not alphabets & meant):
                pieces += [out[at : m.start()], m[0].translate(_FOREIGN)]
                at = m.end()
        out = unicodedata.normalize("NFC", "".join([*pieces, out[at:]]))
    return out


def is_ascii(col: Column) -> Column:
    return col.rlike(r"\A\p{ASCII}*\z")


@F.pandas_udf(T.StringType())
def _clean(texts: pd.Series) -> pd.Series:
    return texts.map(clean, na_action="ignore")


def clean_of(col: Column) -> Column:
    """Clean forms; plain ASCII texts, which are their own, never leave the JVM."""
    return F.when(is_ascii(col), col).otherwise(_clean(col))


def skeleton_of(spark: SparkSession, col: Column) -> Column:
    """Skeletons by the public table."""
    letters = spark.sparkContext.broadcast(public_letters(spark))  # a few thousand letters, whatever the data

    @F.pandas_udf(T.StringType())
    def skeletons(texts: pd.Series) -> pd.Series:
        table = Prototypes(letters.value)
        return texts.map(lambda t: skeleton(t, table), na_action="ignore")

    return F.when(is_ascii(col), col).otherwise(skeletons(col))


def look_alikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id`, `own`, `class_id`, `texts`, `members`): the rows whose text looks like another one: hash of the text, the class's lowest id, and its number of different texts and of rows.

    Rows are first brought to one per id and text; null ids and null and empty texts are left out. Skeletons are worked out once and written.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    rows = cut(rows.select("id", F.md5(skeleton_of(df.sparkSession, F.col("text"))).alias("key"), F.xxhash64("text").alias("own")).distinct())
    own = rows.groupBy("key", "own").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    varied = own.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("texts"), F.sum("n").alias("members")).filter("texts > 1")
    return rows.join(broadcast_if_small(varied), "key").drop("key")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id_a`, `id_b`), id_a < id_b: rows whose texts differ as strings but have one skeleton.

    The pairs of each class between *different* texts; copies of one text are never paired with each other, and AQE splits a hot class.
    """
    left = cut(look_alikes(df, id_col, text_col).select("id", "own", "class_id"))
    right = left.select(F.col("id").alias("id_b"), "class_id", F.col("own").alias("own_b"))
    return left.join(right, "class_id").filter((F.col("own") != F.col("own_b")) & (F.col("id") < F.col("id_b"))).select(F.col("id").alias("id_a"), "id_b").distinct()


def one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id_col`, `text_col`, `consistent`): every row's clean form, or the smallest one of the texts that look like it."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(rows.select("id", "text", F.md5(skeleton_of(df.sparkSession, F.col("text"))).alias("key"), clean_of(F.col("text")).alias("own")))
    forms = rows.groupBy("key").agg(F.min("own").alias("form"), F.max("own").alias("other")).filter("form <> other").select("key", "form")
    return rows.join(broadcast_if_small(forms), "key", "left").select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.coalesce("form", "own").alias("consistent"))
