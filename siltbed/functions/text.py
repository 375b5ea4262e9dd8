"""Text functions of columns: normal form, search terms, trigrams, token estimates, redaction."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Letters and digits that are unified, stop words, aliases, named entities, term and token classes.
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "ؤ": "و", "إ": "ا", "أ": "ا", "ۀ": "هٔ"}
PERSIAN_DIGITS, ARABIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
STOP_WORDS = ["از", "است", "با", "برای", "به", "چه", "چطور", "چطوریه", "چجوری", "چجوریه", "در", "را", "روی", "توی", "و", "یا", "دارد", "دارند", "کدام", "کنم", "کند", "می"]
ALIASES = {"node": "nodejs", "node.js": "nodejs", "next": "nextjs", "next.js": "nextjs", "postgres": "postgresql", "پستگرس": "postgresql", "پستگرسکیوال": "postgresql", "پایتون": "python", "ردیس": "redis"}
ENTITIES = ["django", "docker", "hnsw", "ivfflat", "kubernetes", "laravel", "mongodb", "mssql", "mysql", "nextjs", "nodejs", "pgvector", "php", "postgis", "postgresql", "python", "redis"]
TERM = r"[\p{L}\p{N}_\x{0600}-\x{06ff}.+#-]+"
TERM_EDGES = "؟?!.,،؛:«»()[]{}\"'"
WORD_TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06ff}]+"
#: What parts the words of the index into those that trigrams are cut from: the low line, and what is no letter and no number in the Arabic block.
WITHIN_WORDS = "[_" + "".join(c for c in map(chr, range(0x600, 0x700)) if unicodedata.category(c)[0] not in "LN") + "]+"
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters one by one, as trimming takes them.
WHITE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts of these characters only are in compatibility form already and need no Python.
PLAIN = r"^[\x00-\x7f\xc0-\xff]*$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


@pandas_udf(StringType())
def _normal_form(values: pd.Series) -> pd.Series:
    import re

    digits = {c: str(k) for row in (PERSIAN_DIGITS, ARABIC_DIGITS) for k, c in enumerate(row)}
    letters = str.maketrans(LETTERS | digits)
    gaps = re.compile("[\\s\u200c]+")
    one = lambda v: gaps.sub(" ", unicodedata.normalize("NFKC", v).translate(letters)).strip().casefold()
    return values.map(one, na_action="ignore")


def normalize(text: Column) -> Column:
    """Compatibility form, unified letters and digits, single blanks, trimmed, case-folded.

    Only texts beyond ASCII and the Latin-1 letters go to Python, in Arrow batches; the others stay in the JVM.
    """
    plain = F.replace(F.lower(F.trim(F.regexp_replace(text, r"[\x09-\x0d\x1c-\x20]+", " "))), F.lit("ß"), F.lit("ss"))
    return F.when(text.rlike(PLAIN), plain).otherwise(_normal_form(F.when(~text.rlike(PLAIN), text)))


def terms_of_normal(normal: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """array<string>: search terms of normalised text, in order, without stop words, short and repeated ones."""
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    found = F.transform(F.regexp_extract_all(normal, F.lit(TERM), F.lit(0)), lambda t: F.btrim(t, F.lit(TERM_EDGES)))
    found = F.transform(found, lambda t: F.coalesce(F.try_element_at(aliases, t), t))
    stop = literal_array(stop_words)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def search_terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return terms_of_normal(normalize(text), stop_words)


def search_query(text: Column) -> Column:
    """The terms joined by blanks, or the normalised text where there are none."""
    normal = normalize(text)
    terms = terms_of_normal(normal)
    return F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(normal)


def or_query(text: Column) -> Column:
    normal = normalize(text)
    terms = terms_of_normal(normal)
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(normal)


def tokens(normal: Column) -> Column:
    """array<string>: the words of the lexical index."""
    return F.regexp_extract_all(normal, F.lit(WORD_TOKEN), F.lit(0))


def piece_count(text: Column) -> Column:
    """Number of words and symbols; those of texts with white space between them add up."""
    return F.size(F.regexp_extract_all(text, F.lit(f"{WORD_TOKEN}|[^{WHITE}]"), F.lit(0)))


def tokens_of(pieces: Column, size: Column) -> Column:
    """token_count, from the number of words and symbols and that of characters."""
    return F.greatest(F.lit(1), pieces, F.floor((size + 3) / 4).cast("int"))


def token_count(text: Column) -> Column:
    """Estimate: the larger of words and symbols, and a quarter of the characters, at least 1."""
    return tokens_of(piece_count(text), F.length(text))


def spelled(normal: Column) -> Column:
    """array<string>: the words that trigrams are cut from."""
    return F.regexp_extract_all(normal, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(normal: Column) -> Column:
    """array<string>: distinct trigrams of words, each with two blanks before and one after it."""
    words = F.array_distinct(spelled(normal))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def overlap(query_terms: Column, terms: Column) -> Column:
    return F.size(F.array_intersect(query_terms, terms)) / F.greatest(F.lit(1), F.size(query_terms))


# The four redaction rules, in order, with what replaces a match.
REDACTIONS = {
    "environment_value": (r"""(\b([A-Z][A-Z0-9_]*(?:PASSWORD|PASS|TOKEN|SECRET|API_KEY))\s*=\s*["']?)([^\s"']+)(["']?)""", "$1<YOUR_$2>$4"),
    "bearer_token": (r"(?i)(\b(?:Authorization:\s*)?Bearer\s+)([A-Za-z0-9._~-]{12,})", "$1<YOUR_TOKEN>"),
    "connection_password": (r"(?i)(\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/@]+:)([^\s@/]+)(@)", "$1<YOUR_PASSWORD>$3"),
    "embedded_data_url": (r"(?i)(data:(?:image|audio|video)/[a-z0-9.+-]+;base64,)[a-z0-9+/=_-]{1024,}", "$1<REDACTED_EMBEDDED_ASSET>"),
}


def redact(text: Column) -> Column:
    for pattern, put in REDACTIONS.values():
        text = F.regexp_replace(text, pattern, put)
    return text


def redaction_counts(text: Column) -> list[Column]:
    """A count for each rule, on the text that the rules before it have left."""
    out = []
    for name, (pattern, put) in REDACTIONS.items():
        out.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, put)
    return out


def clean_sentence(text: Column) -> Column:
    """Markdown images dropped, link texts kept, URLs dropped, quote and list marks stripped, blanks collapsed."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(?i)https?://\S+", "")
    text = F.ltrim(F.trim(F.regexp_replace(text, f"[{WHITE}]+", " ")), F.lit(">-* "))
    return F.trim(text)


def snippet(text: Column, size: int = 280) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, f"[{WHITE}]+", " ")), 1, size)


def pieces(text: Column, size: int = 120) -> Column:
    """array<string>: consecutive parts of `size` characters; none for empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def any_marker(text: Column, markers: Sequence[str]) -> Column:
    """Whether the text contains one of the markers; one pattern, so that text is computed once."""
    import re

    return text.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", m) for m in markers)) if markers else F.lit(False)


def short_hash(text: Column, size: int = 24) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)
