"""Keywords, descriptions and transcripts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column, chars: str = " \t\n\r\x0b\f") -> Column:
    return F.btrim(text, F.lit(chars))


def fold(text: Column) -> Column:
    """Lower case, without accents, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTED, PLAIN)), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def natural_order(text: Column) -> Column:
    """What to sort names by so that case and accents don't count, as in a dictionary: the trimmed text under a collation."""
    return F.collate(F.trim(text), "UNICODE_CI_AI")


def json_list(text: Column) -> Column:
    """The strings of a JSON array, or null."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>"))


def split_keywords(value: Column) -> Column:
    """Parts of a JSON array or a comma list, without quotes and blanks at their ends; empty parts of a list go; null: none."""
    text = strip(F.coalesce(value, F.lit("")))

    def parts(t: Column) -> Column:
        plain = F.filter(F.transform(F.split(t, ","), strip), lambda x: x != "")
        return F.transform(F.coalesce(json_list(t), plain), lambda x: strip(strip(F.coalesce(x, F.lit(""))), "'\""))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(text, parts))


def clean_keyword(word: Column) -> Column:
    """Lower case; no punctuation at the ends, brackets, dots or leading article."""
    w = F.trim(strip(F.lower(F.trim(word)), "'\",.;:!?¿¡()[]"))
    w = F.trim(F.substring_index(F.substring_index(w, "(", 1), "...", 1))
    return strip(F.regexp_replace(w, r"^(la|el|los|las|un|una|unos|unas)\s+", ""), "'\",.;:")


def singular(word: Column) -> Column:
    """Without a final s after a plain a, i, o or u; words in -es and under four letters stay."""
    return F.when((F.length(word) >= 4) & word.rlike("[aiou]s$"), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def refine_keywords(words: Column, synonyms: Column, stop: list[str], junk: str, most: int = 7) -> Column:
    """Cleaned, singular keywords with synonyms replaced (``synonyms``: a map), junk removed, each once, in order, at most ``most``.

    Junk: what matches ``junk``, stands in ``stop``, is under three letters, or has three words or more and is no synonym.
    """

    def good(w: Column) -> Column:
        phrase = (F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit("")))) >= 2
        known = F.map_contains_key(synonyms, w) | F.array_contains(F.map_values(synonyms), w)
        return ~w.rlike(junk) & (F.length(w) >= 3) & ~w.isin(stop) & (~phrase | known)

    clean = F.filter(F.transform(words, clean_keyword), good)
    named = F.transform(F.transform(clean, singular), lambda w: F.coalesce(F.try_element_at(synonyms, w), w))
    return F.slice(F.array_distinct(F.filter(named, good)), 1, most)


def parse_model_keywords(answer: Column, most: int = 5) -> Column:
    """Keywords of a model's answer: a fenced or bare JSON array or object, strings in quotes, or a comma or line list; cleaned, each once."""
    body = strip(F.coalesce(F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), answer))
    quoted = F.regexp_extract_all(body, F.lit('"([^"]+)"'), F.lit(1))
    listed = F.from_json(body, "array<string>")
    inside = F.from_json(body, "struct<keywords:array<string>,palabras_clave:array<string>>")
    plain = F.split(body, r"[,;\n]+")
    found = F.coalesce(
        F.when(body.startswith("["), listed),
        F.when(body.startswith("{"), F.coalesce(inside["keywords"], inside["palabras_clave"])),
        F.when((F.size(quoted) > 0) & body.rlike(r"^[\[{]"), quoted),
        plain,
    )
    cleaned = F.transform(found, lambda w: clean_keyword(F.regexp_replace(w, r"^\s*(?:\d+[.)]|[-*•])\s*", "")))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda w: F.length(w) >= 2)), 1, most)


def strip_meta_intro(text: Column, prefixes: list[str], passes: int = 3, least: int = 15) -> Column:
    """``text`` without opening phrases that introduce a description, each followed by marks and blanks, up to ``passes`` times.

    What would leave under ``least`` characters stays as it was; so does a text that the result is no ending of.
    """
    longest_first = sorted(prefixes, key=len, reverse=True)
    pattern = "(?i)^(?:" + "|".join(rf"\Q{p}\E" for p in longest_first) + ")[ \\t\\n\\r:;,.\\-–—\"'’]*"
    bare = strip(strip(strip(text), '"'))
    done = reduce(lambda t, _: F.regexp_replace(t, pattern, ""), range(passes), bare)
    return F.when((done != bare) & (F.length(F.trim(done)) >= least) & F.endswith(bare, F.trim(done)), F.trim(done)).otherwise(text)


def cut_at_word(text: Column, n: int) -> Column:
    """At most ``n`` characters, cut at the last blank if that lies in the second half."""
    head = F.substring(text, 1, n)
    last = n - F.locate(" ", F.reverse(head)) + 1
    at_blank = (F.locate(" ", F.reverse(head)) > 0) & (last - 1 >= n // 2)
    return F.when(F.length(text) <= n, F.trim(text)).when(at_blank, F.rtrim(head.substr(F.lit(1), last - 1))).otherwise(F.rtrim(head))


SEGMENTS = "array<struct<inicio:double,fin:double,texto:string,promedio_logprob:double,no_hay_habla_prob:double,ratio_compresion:double>>"


def segments_to_text(json: Column) -> Column:
    """Texts of a JSON list of segments in order of their starts; an unreadable list gives an empty text."""
    parsed = F.coalesce(F.from_json(json, SEGMENTS), F.array().cast(SEGMENTS))
    placed = F.transform(parsed, lambda s, i: F.struct(F.coalesce(s["inicio"], F.lit(0.0)).alias("t"), i.alias("i"), F.trim(F.coalesce(s["texto"], F.lit(""))).alias("x")))
    return F.array_join(F.transform(F.array_sort(F.filter(placed, lambda s: s["x"] != "")), lambda s: s["x"]), " ")


def reliable_segments(segments: Column, logprob: float = -0.8, no_speech: float = 0.6, compression: float = 2.4, seconds: float = 1.5) -> Column:
    """Segments with text, long enough, whose confidence marks, where known, are good."""
    return F.filter(
        segments,
        lambda s: (F.trim(F.coalesce(s["texto"], F.lit(""))) != "")
        & (F.coalesce(s["promedio_logprob"], F.lit(0.0)) >= logprob)
        & (F.coalesce(s["no_hay_habla_prob"], F.lit(0.0)) < no_speech)
        & (F.coalesce(s["ratio_compresion"], F.lit(0.0)) < compression)
        & (F.coalesce(s["fin"], F.lit(0.0)) - F.coalesce(s["inicio"], F.lit(0.0)) >= seconds),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
