"""Text functions as column expressions: chunking, slugs, ids, notes, resolution keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1000, 200


#: Blank as Python's strip sees it: every kind of space and the separators among the controls.
BLANK = r"^[\s\x0B\x1c-\x1f\x85\p{Z}]*$"


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP, uri_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, doc_id, chunk_index, body, ...), with the document's columns `keep`: windows of `size` code points, one every size - overlap.

    A window begins at every step below the text's length, so a tail that the window
    before already holds is a chunk too. Texts of blanks only have none. The id is the
    version 5 UUID of "uri:index", with the document's id for a uri by default.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))
    uri = F.col(uri_col or id_col).cast("string").alias("_uri")
    return (
        docs.where(F.col(text_col).isNotNull() & ~F.col(text_col).rlike(BLANK))
        .select(F.col(id_col).alias("doc_id"), uri, F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text_col), i + 1, F.lit(size)))).alias("chunk_index", "body"), *keep)
        .select(chunk_id(F.col("_uri"), F.col("chunk_index")).alias("id"), "doc_id", "chunk_index", "body", *keep)
    )


def chunk_id(uri: Column, position: Column) -> Column:
    return uuid5_dns(F.concat_ws(":", uri, position.cast("string")))


def slugify(label: Column) -> Column:
    """A label as an id: at most 128 of a-z, 0-9 and single underscores; 'unknown' for none."""
    plain = F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_")
    return F.when(F.coalesce(label, F.lit("")) == "", "unknown").otherwise(F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, 128))


def uuid5_dns(name: Column) -> Column:
    """Version 5 UUID of a name in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    at = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(variant, at(19, 2)), at(21, 12))


def short_hash(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def snippet(body: Column, size: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, size)


def wikilinks(text: Column) -> Column:
    """Distinct link targets, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))))


def frontmatter_block(text: Column) -> Column:
    """The block between a leading '---' and the next; null if there is none."""
    end = F.locate("---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.btrim(F.substring(text, F.lit(4), end - 4), F.lit(" \t\n\r")))


def note_body(text: Column) -> Column:
    end = F.locate("---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.btrim(F.substring(text, end + 3, F.length(text)), F.lit(" \t\n\r"))).otherwise(text)


def _bare(value: Column) -> Column:
    return F.btrim(F.btrim(F.trim(value), F.lit('"')), F.lit("'"))


def frontmatter(text: Column) -> Column:
    """Keys (lower case) to lists of values; a bracketed value is a list, another has one item. The last of equal keys wins."""
    lines = F.filter(F.split(F.coalesce(frontmatter_block(text), F.lit("")), "\n"), lambda x: x.contains(":"))

    def entry(line: Column) -> Column:
        key = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = _bare(F.substring(line, F.locate(":", line) + 1, F.length(line)))
        inner = F.substring(value, F.lit(2), F.length(value) - 2)
        items = F.transform(F.filter(F.split(inner, ","), lambda v: F.trim(v) != ""), _bare)
        return F.struct(key.alias("key"), F.when(value.startswith("[") & value.endswith("]"), items).otherwise(F.array(value)).alias("value"))

    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def tags(text: Column) -> Column:
    """Sorted tags: from the frontmatter (a list, or split at commas) and inline #tags."""
    given = F.coalesce(frontmatter(text)["tags"], F.array().cast("array<string>"))
    split = F.flatten(F.transform(given, lambda t: F.split(t, ",")))
    named = F.filter(F.transform(split, lambda t: F.regexp_replace(F.trim(t), "^#+", "")), lambda t: t != "")
    return F.array_sort(F.array_union(named, F.regexp_extract_all(text, F.lit(r"(?<!\S)#([a-zA-Z][a-zA-Z0-9_/-]*)"), F.lit(1))))


def decomposed(text: Column) -> Column:
    """The text under NFKD without its combining marks; Spark has no such function."""

    def plain(values):
        import unicodedata

        return values.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return F.pandas_udf(plain, "string")(text)


def normalize_label(label: Column) -> Column:
    """Decomposed without marks, lower case, apostrophes dropped, other marks to single blanks."""
    plain = F.replace(F.lower(decomposed(F.coalesce(label, F.lit("")))), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def label_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def singular(word: Column) -> Column:
    """A word without its plural ending; words in -is, -us, -ss stay."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(word.rlike("(is|us|ss)$"), word)
        .when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 3) & word.rlike("[sxzo]es$"), cut(2))
        .when((n > 3) & word.endswith("s"), cut(1))
        .otherwise(word)
    )


# Words that initials and blocking leave out, titles, company endings.
STOPWORDS = ("of", "the", "and", "for", "a", "an", "to", "in", "on", "&", "de", "von", "der")
HONORIFICS = ("dr", "mr", "mrs", "ms", "prof", "professor", "sir", "dame")
LEGAL_SUFFIX = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "plc")


def with_label_keys(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds norm, toks, sing (last token singular), initials and acronym (is one token of 2 to 6 letters)."""
    out = df.withColumn("norm", normalize_label(F.col(label))).withColumn("toks", label_tokens(F.col("norm")))
    last = F.element_at("toks", -1)
    kept = F.filter("toks", lambda t: ~t.isin(*STOPWORDS))
    return (
        out.withColumn("sing", F.when(F.size("toks") > 0, F.concat_ws(" ", F.slice("toks", 1, F.size("toks") - 1), F.array(singular(last)))).otherwise(""))
        .withColumn("initials", F.array_join(F.transform(kept, lambda t: F.substring(t, 1, 1)), ""))
        .withColumn("acronym", F.col("norm").rlike("^[a-z]{2,6}$"))
    )


def mentions_word(body: Column, surface: Column) -> Column:
    """Whether lower-cased `body` holds `surface` between non-word characters (of any script)."""
    return F.regexp_like(F.lower(body), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(surface), F.lit(r"\E(?!\w)")))


def strip_markup(html: Column) -> Column:
    """Text between tags, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
