"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and the Cyrillic letters that look like them.
LATIN_TWINS, CYRILLIC_TWINS = "aeopcxyAEOPCXBHKMT", "аеорсхуАЕОРСХВНКМТ"

# Spoken names of Arabic letters, for English and Russian readers.
ARABIC_EN = {
    "ع": "ain", "غ": "ghain", "ق": "qaf", "ك": "kaf", "م": "meem", "ن": "noon", "ث": "tha", "س": "seen", "ح": "ha",
    "ذ": "dhal", "ز": "zay", "ض": "dad", "ص": "sad", "ط": "ta", "ظ": "dha", "خ": "kha", "ج": "jeem", "ش": "sheen",
    "ب": "ba", "ت": "ta", "ف": "fa", "ل": "lam", "ر": "ra", "د": "dal", "و": "waw", "ي": "ya", "ه": "ha",
    "أ": "alif", "إ": "alif", "آ": "alif", "ا": "alif", "ة": "ta marbuta", "ء": "hamza", "ئ": "hamza", "ؤ": "hamza",
}
ARABIC_RU = {
    "ع": "айн", "غ": "гайн", "ق": "каф", "ك": "кяф", "م": "мим", "ن": "нун", "ث": "са", "س": "син", "ح": "ха",
    "ذ": "заль", "ز": "зай", "ض": "дад", "ص": "сад", "ط": "та", "ظ": "за", "خ": "ха", "ج": "джим", "ش": "шин",
    "ب": "ба", "ت": "та", "ف": "фа", "ل": "лям", "ر": "ра", "د": "даль", "و": "вав", "ي": "йа", "ه": "ха",
    "أ": "алиф", "إ": "алиф", "آ": "алиф", "ا": "алиф", "ة": "та марбута", "ء": "хамза", "ئ": "хамза", "ؤ": "хамза",
}
# Phrases that have a reading of their own, longest first within a script.
PHRASES = {
    "سوء إنشاء": "su insha", "يلا بينا": "yalla bina", "راح أروح": "rah arooh", "ماء": "maa", "ما": "ma", "نا": "na",
    "你慢慢來": "ni man man lai", "我好了": "wo hao le", "幹嘛": "gan ma", "沒錯": "mei cuo",
}
# Unicode ranges.
_CYRILLIC = r"\x{400}-\x{4ff}"
_ARABIC, _ARABIC_RUN, _DIACRITICS, _CJK = r"\x{600}-\x{6ff}", r"\x{600}-\x{6ff}\x{fb50}-\x{fdff}\x{fe70}-\x{fefe}", r"\x{64b}-\x{65f}\x{670}", r"\x{4e00}-\x{9fff}"
_SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def strip(text: Column) -> Column:
    """White space of any kind taken off the ends; inner space stays."""
    return F.regexp_replace(text, f"^{_SPACES}|(?<!{_SPACES[:-1]}){_SPACES}$", "")


def blank_to_null(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def count_of(text: Column, chars: str) -> Column:
    """How many characters are in a class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def main_script(text: Column) -> Column:
    """``ru`` if Cyrillic letters outnumber Latin ones, else ``en``; null for null."""
    return F.when(text.isNotNull(), F.when(count_of(text, _CYRILLIC) > count_of(text, "A-Za-z"), "ru").otherwise("en"))


def has_russian(text: Column) -> Column:
    """Whether any Russian letter occurs."""
    return text.rlike("[а-яА-ЯёЁ]")


def lower_stray_capitals(text: Column) -> Column:
    """Capitals after a small letter and not before a capital become small."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        before, after = F.get(chars, i - 1), F.get(chars, i + 1)
        stray = c.rlike(r"\p{Lu}") & before.rlike(r"[\p{L}&&[^\p{Lu}]]") & ~F.coalesce(after.rlike(r"\p{Lu}"), F.lit(False))
        return F.when((i > 0) & stray, F.lower(c)).otherwise(c)

    # Only texts with such a place are taken apart.
    return F.when(text.rlike(r"[\p{L}&&[^\p{Lu}]]\p{Lu}"), F.array_join(F.transform(chars, one), "")).otherwise(text)


def unify_scripts(text: Column) -> Column:
    """In words that mix scripts, look-alikes become letters of the prevailing one; a tie stays."""

    def one(word: Column) -> Column:
        cyrillic, latin = count_of(word, _CYRILLIC), count_of(word, "A-Za-z")
        mixed = (cyrillic > 0) & (latin > 0)
        return (
            F.when(mixed & (cyrillic > latin), F.translate(word, LATIN_TWINS, CYRILLIC_TWINS))
            .when(mixed & (latin > cyrillic), F.translate(word, CYRILLIC_TWINS, LATIN_TWINS))
            .otherwise(word)
        )

    return F.array_join(F.transform(F.split(squeeze(text), " "), one), " ")


def normalize(text: Column) -> Column:
    """Stray capitals, mixed scripts and white space put right."""
    return squeeze(unify_scripts(lower_stray_capitals(squeeze(text))))


def restore_quotes(original: Column, corrected: Column) -> Column:
    """Guillemets of the original back in place; invisible characters deleted, space collapsed."""
    lost = original.contains("«") & ~corrected.contains("«")
    quoted = F.when(lost, F.regexp_replace(corrected, '"([^"]*)"', "«$1»")).otherwise(corrected)
    return squeeze(F.regexp_replace(quoted, r"[\x{200b}-\x{200f}\x{feff}\x{a0}\x{2060}]+", ""))


def transliterate(text: Column) -> Column:
    """Texts with Arabic or Chinese letters get their reading appended after two spaces.

    Known phrases first, longest first; then Arabic runs letter by letter, without
    vowel signs, in the alphabet that prevails in the text. Other texts stay as they are.
    """
    known = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(PHRASES[p])), PHRASES, text)
    bare = F.regexp_replace(known, f"(?<=[{_ARABIC_RUN}&&[^{_DIACRITICS}]])[{_DIACRITICS}]+|[{_DIACRITICS}]+(?=[{_ARABIC_RUN}&&[^{_DIACRITICS}]])", "")
    spaced = F.regexp_replace(bare, f"([{_ARABIC_RUN}])(?=[{_ARABIC_RUN}])", "$1 ")

    def spoken(names: dict[str, str]) -> Column:
        return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(names[c])), names, spaced)

    read = F.when(main_script(text) == "ru", spoken(ARABIC_RU)).otherwise(spoken(ARABIC_EN))
    return F.when(text.rlike(f"[{_ARABIC}{_CJK}]") & (read != text), F.concat(text, F.lit("  "), read)).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def without_prefix(text: Column, prefix: str, to: str = "") -> Column:
    """The first occurrence of ``prefix`` replaced, wherever it is."""
    at = F.instr(text, prefix)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(to), F.substring(text, at + len(prefix), F.length(text)))).otherwise(text)
