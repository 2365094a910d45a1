"""Language tables and stop-word sources."""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files

from pyspark.ml.feature import StopWordsRemover

# Language code -> name of the stop-word list that Spark ships.
STOP_WORD_LISTS = {
    'da': 'danish', 'nl': 'dutch', 'en': 'english', 'fi': 'finnish', 'fr': 'french', 'de': 'german', 'hu': 'hungarian',
    'it': 'italian', 'no': 'norwegian', 'pt': 'portuguese', 'ru': 'russian', 'es': 'spanish', 'sv': 'swedish', 'tr': 'turkish',
}

# ISO 639-1 code -> language name ('xxx' marks an undetected language).
LANGUAGE_NAMES = {
    'xxx': 'unknown', 'ab': 'Abkhazian', 'af': 'Afrikaans', 'ak': 'Akan', 'sq': 'Albanian',
    'am': 'Amharic', 'ar': 'Arabic', 'an': 'Aragonese', 'hy': 'Armenian', 'as': 'Assamese',
    'av': 'Avaric', 'ae': 'Avestan', 'ay': 'Aymara', 'az': 'Azerbaijani', 'ba': 'Bashkir',
    'bm': 'Bambara', 'eu': 'Basque', 'be': 'Belarusian', 'bn': 'Bengali',
    'bh': 'Bihari languages', 'bi': 'Bislama', 'bo': 'Tibetan', 'bs': 'Bosnian',
    'br': 'Breton', 'bg': 'Bulgarian', 'my': 'Burmese', 'ca': 'Catalan; Valencian',
    'cs': 'Czech', 'ch': 'Chamorro', 'ce': 'Chechen', 'zh': 'Chinese', 'cu': 'Church Slavic',
    'cv': 'Chuvash', 'kw': 'Cornish', 'co': 'Corsican', 'cr': 'Cree', 'cy': 'Welsh',
    'da': 'Danish', 'de': 'German', 'dv': 'Divehi', 'nl': 'Dutch', 'dz': 'Dzongkha',
    'el': 'Greek', 'en': 'English', 'eo': 'Esperanto', 'et': 'Estonian', 'ee': 'Ewe',
    'fo': 'Faroese', 'fa': 'Persian', 'fj': 'Fijian', 'fi': 'Finnish', 'fr': 'French',
    'fy': 'Western Frisian', 'ff': 'Fulah', 'ka': 'Georgian', 'gd': 'Gaelic', 'ga': 'Irish',
    'gl': 'Galician', 'gv': 'Manx', 'gn': 'Guarani', 'gu': 'Gujarati', 'ht': 'Haitian',
    'ha': 'Hausa', 'he': 'Hebrew', 'hz': 'Herero', 'hi': 'Hindi', 'ho': 'Hiri Motu',
    'hr': 'Croatian', 'hu': 'Hungarian', 'ig': 'Igbo', 'is': 'Icelandic', 'io': 'Ido',
    'ii': 'Sichuan Yi', 'iu': 'Inuktitut', 'ie': 'Interlingue', 'ia': 'Interlingua',
    'id': 'Indonesian', 'ik': 'Inupiaq', 'it': 'Italian', 'jv': 'Javanese', 'ja': 'Japanese',
    'kl': 'Kalaallisut', 'kn': 'Kannada', 'ks': 'Kashmiri', 'kr': 'Kanuri', 'kk': 'Kazakh',
    'km': 'Central Khmer', 'ki': 'Kikuyu', 'rw': 'Kinyarwanda', 'ky': 'Kirghiz', 'kv': 'Komi',
    'kg': 'Kongo', 'ko': 'Korean', 'kj': 'Kuanyama', 'ku': 'Kurdish', 'lo': 'Lao',
    'la': 'Latin', 'lv': 'Latvian', 'li': 'Limburgan', 'ln': 'Lingala', 'lt': 'Lithuanian',
    'lb': 'Luxembourgish', 'lu': 'Luba-Katanga', 'lg': 'Ganda', 'mk': 'Macedonian',
    'mh': 'Marshallese', 'ml': 'Malayalam', 'mi': 'Maori', 'mr': 'Marathi', 'ms': 'Malay',
    'mg': 'Malagasy', 'mt': 'Maltese', 'mn': 'Mongolian', 'na': 'Nauru', 'nv': 'Navajo',
    'nr': 'Ndebele', 'nd': 'Ndebele', 'ng': 'Ndonga', 'ne': 'Nepali',
    'nn': 'Norwegian Nynorsk', 'nb': 'Bokmål', 'no': 'Norwegian', 'ny': 'Chichewa',
    'oc': 'Occitan', 'oj': 'Ojibwa', 'or': 'Oriya', 'om': 'Oromo', 'os': 'Ossetian',
    'pa': 'Panjabi', 'pi': 'Pali', 'pl': 'Polish', 'pt': 'Portuguese', 'ps': 'Pushto',
    'qu': 'Quechua', 'rm': 'Romansh', 'ro': 'Romanian', 'rn': 'Rundi', 'ru': 'Russian',
    'sg': 'Sango', 'sa': 'Sanskrit', 'si': 'Sinhala', 'sk': 'Slovak', 'sl': 'Slovenian',
    'se': 'Northern Sami', 'sm': 'Samoan', 'sn': 'Shona', 'sd': 'Sindhi', 'so': 'Somali',
    'st': 'Sotho', 'es': 'Spanish', 'sc': 'Sardinian', 'sr': 'Serbian', 'ss': 'Swati',
    'su': 'Sundanese', 'sw': 'Swahili', 'sv': 'Swedish', 'ty': 'Tahitian', 'ta': 'Tamil',
    'tt': 'Tatar', 'te': 'Telugu', 'tg': 'Tajik', 'tl': 'Tagalog', 'th': 'Thai',
    'ti': 'Tigrinya', 'to': 'Tonga', 'tn': 'Tswana', 'ts': 'Tsonga', 'tk': 'Turkmen',
    'tr': 'Turkish', 'tw': 'Twi', 'ug': 'Uighur', 'uk': 'Ukrainian', 'ur': 'Urdu',
    'uz': 'Uzbek', 've': 'Venda', 'vi': 'Vietnamese', 'vo': 'Volapük', 'wa': 'Walloon',
    'wo': 'Wolof', 'xh': 'Xhosa', 'yi': 'Yiddish', 'yo': 'Yoruba', 'za': 'Zhuang; Chuang',
    'zu': 'Zulu',
}

# Languages the entity and the tag annotators support.
ENTITY_LANGUAGES = ('en', 'es', 'fr', 'de', 'it', 'ru', 'zh')
TAG_LANGUAGES = ('en', 'es', 'fr', 'de', 'it', 'pt', 'ru', 'zh')


def stop_words(languages: list[str]) -> dict[str, tuple[str, ...]]:
    """The stop words that Spark ships for each language code; needs a running session.

    A language without a list is an error: its tokens would stay unfiltered in silence.
    """
    missing = [lang for lang in languages if lang not in STOP_WORD_LISTS]
    if missing:
        raise ValueError(f"no stop-word list for {', '.join(missing)}")
    found = {lang: StopWordsRemover.loadDefaultStopWords(STOP_WORD_LISTS[lang]) for lang in languages}
    return {lang: tuple(sorted({w.strip() for w in words if w.strip()})) for lang, words in found.items()}


@lru_cache(maxsize=None)
def recorded_stop_words(lang: str) -> tuple[str, ...]:
    """The same list from the file kept beside this module, for oracles built without a session."""
    text = files(__package__).joinpath("stop_words", f"{lang}.txt").read_text("utf-8")
    return tuple(sorted({w.strip() for w in text.split("\n") if w.strip()}))
