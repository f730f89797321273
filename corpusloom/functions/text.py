"""Scalar text functions as Column expressions; code points are the unit of length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.values import ALIASES, LANGS

# Character classes.
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F​-‏  ﻿]"
HANGUL = r"[가-힣ᄀ-ᇿ㄰-㆏]"
HAN = r"[一-鿿]"
CJK = r"[ᄀ-ᇿ　-ヿ㄰-㆏㐀-䶿一-鿿가-힯＀-￯]"
GLUED_KEY = r"(?<=[가-힣)\].!?])(?:Comment|GenericName|Name|Keywords)$"
SENTENCE_END = r"(?<=[.!?。！？…\n])\s*"


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """Removes control characters (CR among them), collapses white space, trims; null becomes empty. The part of normalisation without NFKC."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def strip_artifacts(text: Column) -> Column:
    """Drops one localisation key glued to the end."""
    return F.regexp_replace(text, GLUED_KEY, "")


def squash(text: Column) -> Column:
    """Letters and digits only, lower-cased with sharp s spelt out."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


def dedup_key(left: Column, right: Column) -> Column:
    return F.concat(squash(left), F.lit("\t"), squash(right))


def h60(key: Column) -> Column:
    """The first 60 bits of md5, as a long that is not negative."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def count_without(text: Column, others: str) -> Column:
    """How many characters are left without the runs of `others`; cheaper than one match for each that counts."""
    return F.length(F.regexp_replace(text, others, ""))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a bracketed class there are."""
    return count_without(text, f"[^{chars[1:]}+")


def count_asian(text: Column, chars: str) -> Column:
    """As count_of for a class from U+1100 on: one range tells texts without any, which is cheaper than a union of ranges."""
    return F.when(text.rlike("[\u1100-\uffff]"), count_of(text, chars)).when(text.isNotNull(), 0)


def profile(text: Column) -> Column:
    """Counts by script over characters that are not white space, and the shares taken from them."""
    hangul, han, kana = (count_asian(text, c) for c in (HANGUL, HAN, "[\u3040-\u30ff]"))
    latin = count_of(text, "[A-Za-z]")
    marks = count_of(text, r"[\p{N}\p{P}\p{S}]")
    total = count_without(text, r"(?U)\s+")
    letters = count_without(text, r"\P{L}+")
    return F.struct(
        hangul.alias("hangul"), latin.alias("latin"), han.alias("han"), kana.alias("kana"), marks.alias("digits_punct"), letters.alias("letters"), total.alias("total"),
        share(hangul, letters).alias("hangul_share"), share(latin, letters).alias("latin_share"), share(letters, total).alias("letter_share"),
    )


def detect_script(text: Column, fallback: Column) -> Column:
    """Language by script: Hangul or kana over 8 % of what counts, then Han against Latin, else the fallback."""
    text = F.coalesce(text, F.lit(""))
    hangul, kana, han = (count_asian(text, c) for c in ("[\uac00-\ud7af\u1100-\u11ff\u3130-\u318f]", "[\u3040-\u30ff]", "[\u4e00-\u9fff\u3400-\u4dbf]"))
    latin = F.length(text) - count_without(text, r"[\x00-\xFF&&\p{L}]+")

    def judged(c: Column) -> Column:
        total = c["hangul"] + c["kana"] + c["han"] + c["latin"]
        return (
            F.when(total == 0, fallback)
            .when(share(c["hangul"], total) > 0.08, "ko")
            .when(share(c["kana"], total) > 0.08, "ja")
            .when((c["han"] > 0) & (c["han"] >= c["latin"]), "zh")
            .when(c["latin"] > 0, "en")
            .otherwise(fallback)
        )

    return let(F.struct(hangul.alias("hangul"), kana.alias("kana"), han.alias("han"), latin.alias("latin")), judged)


def is_cjk(char: Column) -> Column:
    return F.coalesce(char.rlike(f"^{CJK}$"), F.lit(False))


def lang_from_code(code: Column) -> Column:
    """A known language of a code such as en_US or zh-Hans; null if unknown."""
    low = F.lower(F.trim(code))
    head = F.substring_index(low, "-", 1)
    head = F.when(F.contains(low, F.lit("-")), head).when(F.instr(low, "_") > 1, F.substring_index(low, "_", 1)).otherwise(low)
    known = F.create_map(*[F.lit(x) for k, v in (ALIASES | {k: k for k in LANGS}).items() for x in (k, v)])
    return F.try_element_at(known, head)


def from_code_or(code: Column, other: str) -> Column:
    return F.coalesce(lang_from_code(code), F.lit(other))


def user_facing_or(code: Column, other: str) -> Column:
    """The language of a code if users see it, else the other."""
    seen = lang_from_code(code)
    return F.when(seen.isin(*[k for k, (_, _, shown) in LANGS.items() if shown]), seen).otherwise(other)


def display_name(lang: Column) -> Column:
    """English alone bears one name; the others have their own in brackets."""
    names = {k: english if k == "en" else f"{english} ({native})" for k, (english, native, _) in LANGS.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), lang)


def title(text: Column, most: int = 60) -> Column:
    """The first line of the trimmed text, cut after `most` characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    line = F.when(F.instr(t, "\n") > 1, F.substring_index(t, "\n", 1)).otherwise(t)
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def direction_label(source: Column, target: Column) -> Column:
    return F.concat(F.upper(source), F.lit(" → "), F.upper(target))


def xml_escape(text: Column) -> Column:
    """The five entities; control characters but the tab go."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0A-\x1F]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(mark), F.lit(entity))
    return t


def markdown_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def sentences(text: Column) -> Column:
    """Pieces that end in a sentence mark; decimals split too."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def pieces_to_text(pieces: Column) -> Column:
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" ")))


def name_and_path(spec: Column) -> Column:
    """NAME=PATH, parted at the first equals sign."""
    at = F.instr(spec, "=")
    name = F.when(at > 0, F.left(spec, at - 1)).otherwise(spec)
    return F.struct(name.alias("name"), F.when(at > 0, F.substr(spec, at + 1)).otherwise(F.lit("")).alias("path"))


def size_label(size: Column) -> Column:
    """Bytes as megabytes with one decimal."""
    return F.format_string("%.1f MB", size / F.lit(1048576.0))


def topic_particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The particle by whether the last syllable ends in a consonant."""
    code = F.ascii(F.right(word, F.lit(1)))
    return F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), after_consonant).otherwise(after_vowel)
