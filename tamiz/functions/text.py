"""Text expressions (STR-*). All take and give Columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1C-\x1F]+"


def normalize(t: Column) -> Column:
    """STR-01: NUL to space, words hyphenated over white space joined, white space collapsed and stripped."""
    joined = F.regexp_replace(F.regexp_replace(t, "\x00", " "), r"(?U)(?<=\w)-\s+(?=\w)", "")
    return F.trim(F.regexp_replace(joined, SPACE, " "))


def collapse(t: Column) -> Column:
    """STR-02: null as empty; white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), SPACE, " "))


def words(t: Column) -> Column:
    """STR-03: pieces between white space."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), SPACE), lambda w: w != "")


def tokens(t: Column) -> Column:
    """STR-04: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))


def token_count(t: Column) -> Column:
    """The number of ``tokens``, without making them."""
    return F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"(?U)\w+"))


def query_terms(t: Column) -> Column:
    """STR-05 as an array: tokens over two characters, lower-cased, first occurrences in order."""
    return F.array_distinct(F.transform(F.filter(tokens(t), lambda w: F.length(w) > 2), F.lower))


def match_expression(t: Column) -> Column:
    """STR-05 as text: the quoted terms joined by OR."""
    return F.array_join(F.transform(query_terms(t), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def word_count(t: Column) -> Column:
    """STR-06."""
    return F.size(words(t))


def match_key(path: Column) -> Column:
    """STR-07: lower-case tokens of the file's name without .pdf."""
    return F.array_join(F.transform(tokens(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf$", "")), F.lower), " ")


def title_key(t: Column) -> Column:
    """STR-08."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+", " "))


def doi(t: Column) -> Column:
    """STR-09: lower-case, without resolver or ``doi:`` prefix."""
    return F.regexp_replace(F.regexp_replace(F.lower(collapse(t)), r"^(https?://(dx\.)?doi\.org/|doi:)", ""), "^[/ ]+", "")


def work_id(t: Column) -> Column:
    """STR-10: an identifier without its URL, case kept."""
    return F.regexp_replace(collapse(t), r"^https?://openalex\.org/", "")


def cache_name(name: Column, digest: Column) -> Column:
    """STR-11: ``slug.<twelve digits>.jsonl`` of a valid SHA-256; an invalid one, or a name without letters and digits, is an error."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    checked = F.when(slug == "", F.raise_error(F.lit("a name without letters or digits"))).otherwise(slug)
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat(checked, F.lit("."), F.substring(digest, 1, 12), F.lit(".jsonl"))).otherwise(F.raise_error(F.lit("not a SHA-256 digest")))


def strip(t: Column) -> Column:
    """All white space off both ends, not only spaces."""
    return F.regexp_replace(t, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def sentences(t: Column) -> Column:
    """STR-12: split after . ! ? and white space before a capital or an opening mark."""
    return F.filter(F.transform(F.split(strip(F.coalesce(t, F.lit(""))), r'(?U)(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡"“«])'), strip), lambda s: s != "")


def is_evidence(s: Column) -> Column:
    """STR-13: at least eight words and no question."""
    return (word_count(s) >= 8) & ~strip(s).endswith("?")


def clip(t: Column, most: int = 40) -> Column:
    """STR-14: the first words, with an ellipsis if some are left out."""
    w = words(t)
    return F.concat(F.array_join(F.slice(w, 1, most), " "), F.when(F.size(w) > most, " …").otherwise(""))


def preview(t: Column, most: int = 24) -> Column:
    """STR-22: the first words and always an ellipsis."""
    return F.concat(F.array_join(F.slice(words(t), 1, most), " "), F.lit(" …"))


def is_grounded(quote: Column, chunk: Column) -> Column:
    """STR-15: the quote, without its ellipsis, occurs in the chunk, white space aside."""
    q = collapse(F.regexp_replace(quote, "…", " "))
    return (q != "") & F.contains(collapse(chunk), q)


def citations(t: Column) -> Column:
    """STR-16: all [n], in order; a number beyond 18 digits counts as -1, which no source has."""
    return F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(-1)))


def first_phrase(t: Column, phrases: list[str]) -> Column:
    """STR-17: the first of an ordered list of phrases that occurs as whole words; null if none does."""
    low = F.lower(F.coalesce(t, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(rf"(?U)\b{p}\b"), p) for p in phrases])


def has_stem(t: Column, stems: list[str]) -> Column:
    """STR-18."""
    return F.coalesce(F.lower(t).rlike("|".join(stems)), F.lit(False))


def page_range(a: Column, b: Column) -> Column:
    """STR-19: ``p. n`` or ``pp. a–b``; a reversed range is an error."""
    return F.when(b < a, F.raise_error(F.lit("reversed page range"))).when(a == b, F.concat(F.lit("p. "), a.cast("string"))).otherwise(F.concat(F.lit("pp. "), a.cast("string"), F.lit("–"), b.cast("string")))


def citation(author: Column, year: Column, title: Column) -> Column:
    """STR-20: author and year, or what there is of them, or the title."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(author) & given(year), F.concat(author, F.lit(" ("), year, F.lit(")"))).when(given(author), author).otherwise(title)


def source_line(n: Column, cited: Column, title: Column, pages: Column) -> Column:
    """STR-21."""
    return F.format_string("[%d] %s — %s — %s", n, cited, title, pages)


def identifiers(t: Column) -> Column:
    """STR-23: DOIs in prose, lower-case, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"10\.\d{4,9}/\S+"), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"[.,;)]+$", ""))))


def urls(t: Column) -> Column:
    """STR-24."""
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"https?://[^)\]\s]+"), F.lit(0))


def quoted(t: Column, most: int = 25) -> Column:
    """STR-25: ``> “…”`` passages of at most ``most`` words."""
    return F.filter(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("> “([^”]+)”"), F.lit(1)), lambda x: word_count(x) <= most)


def redact(t: Column, secret: str) -> Column:
    """STR-27: an empty secret hides nothing."""
    return F.replace(t, F.lit(secret), F.lit("***")) if secret else t


def keywords(t: Column) -> Column:
    """STR-28: words over two characters, then stripped of marks and lower-cased."""
    return F.transform(F.filter(words(t), lambda w: F.length(w) > 2), lambda w: F.lower(F.regexp_replace(w, "^[.,;:¿?¡!]+|[.,;:¿?¡!]+$", "")))


def record_keys(doi_: Column, id_: Column, title: Column) -> Column:
    """STR-32: (kind, value) of all identifiers, most trusted first; the title only if there is none."""
    key = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    ids = F.filter(F.array(key("doi", doi(doi_)), key("id", F.lower(work_id(id_)))), lambda x: x["v"] != "")
    return F.when(F.size(ids) > 0, ids).otherwise(F.filter(F.array(key("title", title_key(title))), lambda x: x["v"] != ""))


def items(t: Column) -> Column:
    """STR-33: a comma list as trimmed upper-case items."""
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
