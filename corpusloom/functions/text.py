"""Text expressions: cleaning, tokens, keyword hits, header parsing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters under them."""
    own = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ð": "d", "Ð": "D"}  # no mark to take off
    found = {}
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        plain = own.get(chr(k), bare)
        if plain != chr(k) and len(plain) == 1 and plain.isascii() and plain.isalpha():
            found[chr(k)] = plain
    return "".join(found), "".join(found.values())


#: Letters with marks, and what each folds to.  Letters that stand for two (such as ß) stay.
ACCENTED, PLAIN = _folding()

# The function words of the published Spanish stop list, verbs apart.
_FUNCTION_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre
cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella
estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya
tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas
"""
# Irregular forms of the four auxiliary verbs, and the endings of the regular ones.
_IRREGULAR = """
estoy estás está estamos estáis están esté estés estemos estéis estén estando estado estada estados estadas estad
he has ha hemos habéis han haya hayas hayamos hayáis hayan habiendo habido habida habidos habidas
soy eres es somos sois son sea seas seamos seáis sean siendo sido fui fuiste fue fuimos fuisteis fueron
tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan teniendo tenido tenida tenidos tenidas tened
era eras éramos erais eran estaba estabas estábamos estabais estaban
"""
_FUTURE = "é ás á emos éis án ía ías íamos íais ían"
_IMPERFECT = "ía ías íamos íais ían"
_PAST = "e iste o imos isteis ieron"
_SUBJUNCTIVE = {"ra": "ra ras rais ran", "se": "se ses seis sen"}


def _stop_words() -> tuple[str, ...]:
    out = [*_FUNCTION_WORDS.split(), *_IRREGULAR.split()]
    out += [stem + end for stem in ("estar", "habr", "ser", "tendr") for end in _FUTURE.split()]
    out += [stem + end for stem in ("hab", "ten") for end in _IMPERFECT.split()]
    out += [stem + end for stem in ("estuv", "hub", "tuv") for end in _PAST.split()]
    for stem, first in (("estuvie", "estuvié"), ("hubie", "hubié"), ("fue", "fué"), ("tuvie", "tuvié")):
        for mark, ends in _SUBJUNCTIVE.items():
            out += [*(stem + end for end in ends.split()), f"{first}{mark}mos"]
    return tuple(dict.fromkeys(out))


#: Spanish function words and auxiliary verbs; callers may pass their own.
STOP_WORDS = _stop_words()


def clean_text(text: Column) -> Column:
    """Lower case, no URLs, digits or marks, single blanks, untrimmed; null gives ''."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in ((r"http\S+|www\S+", ""), (r"[^\p{L}\p{N}_\s]", " "), (r"\p{Nd}+", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def fold_accents(text: Column) -> Column:
    """Letters without their marks; plain texts, known by their length in bytes, skip the table."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, ACCENTED, PLAIN))


def tokenize(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words over two letters that aren't stop words (tested before folding), accents folded."""
    long = F.filter(F.split(text, " "), lambda w: F.length(w) > 2)
    words = F.filter(long, lambda w: ~w.isin(*stop_words)) if stop_words else long  # a long list becomes a hash set
    return F.transform(words, fold_accents)


def with_bigrams(tokens: Column) -> Column:
    """The words, and each with the next."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)


def process(df: DataFrame, column: str = "body", stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> DataFrame:
    """``df`` with clean_text, tokens and processed_text (tokens joined by blanks); a null text gives empty ones."""
    from .stemmer import stem_tokens

    out = df.withColumn("clean_text", clean_text(F.col(column)))
    tokens = tokenize(F.col("clean_text"), stop_words)
    return out.withColumn("tokens", stem_tokens(tokens) if stemmed else tokens).withColumn("processed_text", F.array_join("tokens", " "))


def join_fields(*fields: Column) -> Column:
    """Fields joined for an embedder; a null field is empty."""
    return F.concat_ws(" [SEP] ", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))


def keyword_list(line: str) -> list[str]:
    return [w.strip() for w in line.split(",") if w.strip()]


def keyword_hits(text: Column, keyword: str) -> Column:
    """How often ``keyword`` occurs, literally, in any case, without overlaps."""
    low = F.lower(F.coalesce(text, F.lit("")))
    gone = F.replace(low, F.lit(keyword.lower()), F.lit(""))
    return ((F.length(low) - F.length(gone)) / len(keyword)).cast("long")


def mime_type(header: Column) -> Column:
    return F.trim(F.split(header, ";")[0])


def charset(header: Column, default: str = "utf-8") -> Column:
    return F.when(F.contains(header, F.lit("charset=")), F.trim(F.element_at(F.split(header, "charset="), -1))).otherwise(default)


def flatten_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def strip_fence(text: Column) -> Column:
    """The inside of a fenced code block, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)^```[a-z]*\n?(.*?)\n?```\s*$", 1)
    return F.when(F.startswith(text, F.lit("```")), inside).otherwise(text)
