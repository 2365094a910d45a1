"""Text expressions: tokens, masking, entities, tags, lexical diversity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tokens

# A token is a maximal run of letters between white space, punctuation marks, sentence-ending
# dots and the ends of the text.  Words with digits, hyphens, apostrophes or inner dots drop out.
_EDGE = r'\s;@#$%&?!*,:()\[\]{}<>"'
WORD = rf'(?<![^{_EDGE}])\p{{L}}++(?=[{_EDGE}]|\.+(?:\s|\z)|\z)'
PADDED = r'([;@#$%&?!*,:()\[\]{}<>"]|\.+(?:\s|$))'


def tokens(text: Column) -> Column:
    """Lower-cased alphabetic word tokens; NULL text gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def without_stop_words(words: Column, lang: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """Drop the language's stop words; tokens of a language without a list stay as they are."""

    def outside(stop: tuple[str, ...]) -> Column:
        # an IN-set per language: a hash lookup per token, duplicates of kept tokens survive
        return F.filter(words, lambda w: ~w.isin(*stop))

    kept = words
    for code, stop in lists.items():
        kept = F.when(lang == code, outside(stop)).otherwise(kept)
    return kept


def pieces(text: Column) -> Column:
    """White-space separated pieces after padding punctuation, case kept."""
    padded = F.regexp_replace(text, PADDED, " $1 ")
    return F.filter(F.split(F.coalesce(padded, F.lit("")), r"\s+"), lambda p: p != "")


def root_ttr(words: Column) -> Column:
    """Distinct tokens over the square root of all tokens; 0 for none."""
    n = F.size(words)
    return F.when(n > 0, F.size(F.array_distinct(words)) / F.sqrt(n)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- personal data

# Patterns and placeholders ((?U) gives Unicode word boundaries).
PHONE = r"(?U)\b(\+?\d[-.\s()]*\d{3}[-.\s()]*(?:\d{2,}[-.\s()]*)?\d{2,})\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
STREET = (
    r"(?U)\b\d+\s+([A-Za-z]+\s*){1,4}"
    r"(Street|St|Rd|Road|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq)\b"
)
URL = r"(?U)http[s]?://\S+"
TAG = r"<[^>]+>"
MAIL_TRACKER = r"\.s\.hubspotemail\.net/[^ ]+"
NUMERIC_ADDRESS = r"(?U)\b\d+\b\s+\w+\b\s+\w+\b"
UNIT_ADDRESS = r"(?U)\b\d+\w*\b[-/]?\s*\b\d+\w*\b\s+\w+\b\s+\w+\b"
PO_BOX = r"(?U)(P\.O\. Box|PO Box)\s+\d+"
CITY_STATE_ZIP = r"(?U)\b\w+\b\s*,?\s*\b\w{2}\b\s+\d{5}(-\d{4})?"
PHONE_MASK = "<someones_phone_number>"
ADDRESS_MASK = "<some_address>"
URL_MASK = "<some_url>"
OWN_DOMAIN = "saascompany.com"
OWN_MASK = "rep@saascompany.com"
OTHER_MASK = "prospect@somemail.com"

PII_KINDS = {
    "phone": PHONE,
    "email": EMAIL,
    "street": STREET,
    "url": URL,
    "tag": TAG,
    "po_box": PO_BOX,
}


def mask_emails(text: Column, own_domain: str = OWN_DOMAIN, own: str = OWN_MASK, other: str = OTHER_MASK) -> Column:
    """Addresses that end in the own domain and all others get different placeholders.

    Each match is fenced first, so the decision is taken on the whole match.
    """
    fenced = F.regexp_replace(text, EMAIL, "\u0001$0\u0002")
    ending = own_domain.replace(".", r"\.")
    ours = F.regexp_replace(fenced, f"\u0001[^\u0002]*{ending}\u0002", own)
    return F.regexp_replace(ours, "\u0001[^\u0002]*\u0002", other)


def _mask(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, mask in steps:
        text = F.regexp_replace(text, pattern, mask)
    return text


def mask_pii(text: Column, mode: str = "strict", own_domain: str = OWN_DOMAIN) -> Column:
    """Mask phones, e-mails, addresses, links and tags.

    ``strict`` keeps the customary order, in which the tag step also rewrites the phone and
    street placeholders; ``clean`` masks links and tags first, so every placeholder survives.
    """
    links = [(URL, URL_MASK), (TAG, URL_MASK), (MAIL_TRACKER, URL_MASK)]
    places = [(p, ADDRESS_MASK) for p in (NUMERIC_ADDRESS, UNIT_ADDRESS, PO_BOX, CITY_STATE_ZIP)]
    if mode == "clean":
        text = _mask(text, links)
    elif mode != "strict":
        raise ValueError("mode must be 'strict' or 'clean'")
    text = mask_emails(F.regexp_replace(text, PHONE, PHONE_MASK), own_domain)
    text = F.regexp_replace(text, STREET, ADDRESS_MASK)
    return _mask(text, links + places if mode == "strict" else places)


def count_pii(text: Column) -> dict[str, Column]:
    return {kind: F.regexp_count(text, F.lit(pattern)) for kind, pattern in PII_KINDS.items()}


# ---------------------------------------------------------------- entities and tags

ENTITY_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+?[0-9][0-9()./ -]{6,}[0-9]",
    "URL": r"https?://[^\s<>\"]+",
    "PROPN": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+",
}

TAG_PATTERNS = {
    "NUM": r"^[0-9]+([.,][0-9]+)*$",
    "PROPN": r"^\p{Lu}\p{L}*$",
    "WORD": r"^\p{L}+$",
    "SYM": r"^[@#$%&<>*]+$",
    "PUNCT": r"^[;?!,:.()\[\]{}\"]+$",
}


def entities(text: Column, lang: Column | None = None, languages: tuple[str, ...] | None = None) -> Column:
    """``array<struct<text,type>>`` of pattern entities; empty for unsupported languages."""

    def of_kind(kind: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(matches, lambda m: F.struct(m.alias("text"), F.lit(kind).alias("type")))

    every = F.concat(*[of_kind(kind, pattern) for kind, pattern in ENTITY_PATTERNS.items()])
    if lang is None or languages is None:
        return every
    return F.when(lang.isin(*languages), every).otherwise(F.filter(every, lambda e: F.lit(False)))


def shape_tag(piece: Column) -> Column:
    """Coarse tag of one piece by its shape."""
    tag = F.lit("X")
    for name, pattern in reversed(TAG_PATTERNS.items()):
        tag = F.when(piece.rlike(pattern), F.lit(name)).otherwise(tag)
    return tag


def shape_tags(text: Column, lang: Column | None = None, languages: tuple[str, ...] | None = None) -> Column:
    tags = F.transform(pieces(text), shape_tag)
    if lang is None or languages is None:
        return tags
    return F.when(lang.isin(*languages), tags).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- n-grams

def ngrams(words: Column, n: int) -> Column:
    """Space-joined n-grams of a token list, in order; a short list gives none."""
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


# ---------------------------------------------------------------- MTLD

def mtld(words: Column, threshold: float = 0.72, min_factor: int = 10) -> Column:
    """Measure of textual lexical diversity (McCarthy & Jarvis 2010), mean of both directions.

    A factor ends where the running type-token ratio falls below the threshold, at the earliest
    after ``min_factor`` tokens; the unfinished rest counts as a partial factor.  The fold is
    sequential with a growing set, which SQL expressions cannot hold: it runs on Arrow batches.
    """

    def one_way(seq) -> float:
        factors, start, types, ttr = 0.0, 0, set(), 1.0
        for i, word in enumerate(seq):
            types.add(word)
            ttr = len(types) / (i - start + 1)
            if ttr < threshold and i - start + 1 >= min_factor:
                factors, start, types, ttr = factors + 1, i + 1, set(), 1.0
        if start < len(seq):
            factors += (1 - ttr) / (1 - threshold)
        return len(seq) / factors if factors else 0.0

    @F.pandas_udf("double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if w is None else (one_way(w) + one_way(w[::-1])) / 2 for w in batch], dtype="float64")

    return measure(words)
