"""What checks must know of languages: scripts, reading limits and words of negation, looked up by a language column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
#: The script of languages that are not written in Latin letters.
SCRIPTS = {
    "Arabic": ["ar", "fa", "ur", "ps", "ckb", "ug", "sd"], "Hebrew": ["he", "yi"],
    "Cyrillic": ["ru", "uk", "bg", "sr", "mk", "be", "kk", "ky", "mn", "tg"],
    "Greek": ["el"], "Armenian": ["hy"], "Georgian": ["ka"], "Thai": ["th"], "Lao": ["lo"], "Khmer": ["km"], "Myanmar": ["my"],
    "Ethiopic": ["am"], "Hangul": ["ko"], "Devanagari": ["hi", "mr", "ne", "sa"], "Bengali": ["bn"], "Tamil": ["ta"], "Telugu": ["te"],
    "Kannada": ["kn"], "Malayalam": ["ml"], "Gujarati": ["gu"], "Gurmukhi": ["pa"], "Sinhala": ["si"], "Han": ["zh", "yue"], "Han Hiragana Katakana": ["ja"],
}
#: Characters a second, characters a line, and the least and greatest length against the source; GENERIC for other languages.
GENERIC = (17, 42, 0.4, 2.5)
LIMITS = {"zh": (17, 16, 0.2, 1.5), "ja": (17, 16, 0.2, 1.5), "ko": (17, 16, 0.2, 1.5)}
#: Words that negate, in the language of the audio.
NEGATION_SOURCE = {
    "tr": ["değil", "yok"],
    "en": ["cannot", "neither", "never", "no", "nobody", "none", "nor", "not", "nothing", "without"],
    "fr": ["aucun", "aucune", "jamais", "n", "ne", "ni", "pas", "personne", "rien", "sans"],
    "de": ["kein", "keine", "keinem", "keinen", "nicht", "nichts", "nie", "niemals", "niemand", "ohne"],
    "es": ["jamás", "nada", "nadie", "ni", "ninguna", "ninguno", "ningún", "no", "nunca", "sin"],
    "it": ["mai", "nessuna", "nessuno", "niente", "non", "né", "senza"],
    "pt": ["jamais", "nada", "nem", "ninguém", "nunca", "não", "sem"],
    "nl": ["geen", "niemand", "niet", "niets", "noch", "nooit", "zonder"],
    "pl": ["ani", "bez", "nic", "nie", "nigdy", "nikt"],
    "ru": ["без", "не", "нет", "ни", "никогда", "никто", "ничего"],
    "ar": ["بدون", "غير", "لا", "لم", "لن", "ليس", "ليست", "ما"],
    "he": ["אין", "אף", "בלי", "לא"],
    "fa": ["بدون", "نمی", "نه", "نیست", "هیچ"],
}
#: The same in the language of the subtitles.
NEGATION_TARGET = {
    "ar": ["بدون", "غير", "لا", "لم", "لن", "ليس", "ليست", "ما", "ولا"],
    "fr": NEGATION_SOURCE["fr"], "de": NEGATION_SOURCE["de"], "es": NEGATION_SOURCE["es"], "ru": NEGATION_SOURCE["ru"], "he": NEGATION_SOURCE["he"], "fa": NEGATION_SOURCE["fa"],
    "tr": ["asla", "değil", "değildir", "hayır", "hiç", "ne", "yok"],
    "en": ["aren't", "can't", "cannot", "didn't", "doesn't", "don't", "isn't", "neither", "never", "no", "nobody", "none", "nor", "not", "nothing", "wasn't", "without", "won't"],
    "zh": ["不", "别", "无", "未", "没", "非"], "ja": ["じゃない", "ず", "ない", "なかった", "ません"], "ko": ["못", "아니", "안", "않", "없"],
}
#: Languages without spaces between words: their words of negation count anywhere in a line.
UNSPACED = ["zh", "ja", "ko"]
#: Turkish verbs that look negative, and common words that only look so.
TURKISH_NEGATIVE = r"(?iU)(\b\w{2,}(?:ma|me)(?:d[ıiuü]|yacak|yecek|mal[ıi]|meli|yor|z|m|n|s[ıiuü]n|d[ıiuü]k|d[ıiuü]n)\w*\b|\b\w{2,}m[ıiuü]yor\w*\b)"
TURKISH_OTHER = ["tamam", "tamamen", "hemen", "zaman", "zamanda", "madem", "memnun", "meme", "mama", "dama"]


def base_of(language: Column) -> Column:
    """The language of a code such as ``tr-TR``."""
    return F.lower(F.split(language, "[-_]")[0])


def _by_language(table: dict, language: Column) -> Column:
    """The array of a language in a small table of fixed arrays; null for others."""
    choice = None
    for code, words in table.items():
        value = F.array(*[F.lit(w) for w in words])
        choice = F.when(language == code, value) if choice is None else choice.when(language == code, value)
    return choice


def script_share(text: Column, language: Column) -> Column:
    """Share of a text's letters in the script of a language; null for languages in Latin letters, 1 without letters."""
    def share(letters: Column) -> Column:
        choice = None
        for scripts, codes in SCRIPTS.items():
            # What is left without the other letters: a match for each run of them, and no string for each letter.
            own = F.length(F.regexp_replace(letters, "[^" + "".join(rf"\p{{Is{s}}}" for s in scripts.split()) + "]+", ""))
            choice = F.when(base.isin(codes), own) if choice is None else choice.when(base.isin(codes), own)
        return F.when(letters == "", F.lit(1.0)).otherwise(choice / F.length(letters))

    base = base_of(language)
    return F.when(base.isin([c for codes in SCRIPTS.values() for c in codes]), let(F.regexp_replace(text, r"[^\p{L}]+", ""), share))


def wrong_script(target: Column, language: Column, least: float = 0.6) -> Column:
    """Fewer than ``least`` of the letters are in the language's script; false for languages in Latin letters."""
    return F.coalesce(script_share(target, language) < least, F.lit(False))


def limits(language: Column) -> Column:
    """Struct (cps, max_line, least_ratio, most_ratio) of a language."""
    names = ("cps", "max_line", "least_ratio", "most_ratio")
    struct = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v)])
    choice = None
    for code, v in LIMITS.items():
        choice = F.when(base_of(language) == code, struct(v)) if choice is None else choice.when(base_of(language) == code, struct(v))
    return choice.otherwise(struct(GENERIC))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w']+)"), F.lit(1))


def source_negates(text: Column, language: Column) -> Column:
    """A word of negation of the language, a word in n't, or in Turkish a verb that looks negative."""
    base = base_of(language)
    listed = F.coalesce(F.arrays_overlap(_words(text), _by_language(NEGATION_SOURCE, base)), F.lit(False))
    verb = (base == "tr") & F.exists(F.regexp_extract_all(text, F.lit(TURKISH_NEGATIVE), F.lit(1)), lambda v: ~F.lower(v).isin(TURKISH_OTHER))
    return listed | F.exists(_words(text), lambda w: w.endswith("n't")) | verb


def target_negates(text: Column, language: Column) -> Column:
    """The same in a target language; true for languages without a list, of which nothing can be said."""
    base = base_of(language)
    listed = _by_language(NEGATION_TARGET, base)
    spaced = F.arrays_overlap(_words(text), listed) | F.exists(_words(text), lambda w: w.endswith("n't"))
    anywhere = F.exists(listed, lambda w: F.contains(F.lower(text), w))
    return F.when(listed.isNull(), F.lit(True)).when(base.isin(UNSPACED), anywhere).otherwise(spaced)


def lost_negation(source: Column, target: Column, source_language: Column, target_language: Column) -> Column:
    """The source negates and the target does not."""
    return source_negates(source, source_language) & ~target_negates(target, target_language)
