"""Column expressions on texts. Null texts give null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters of Unicode white space, as a Java character class
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# fixed values: typographic punctuation and what stands for it
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
# fixed values: lines that repeat on support pages
BOILERPLATE = [r"was this (article|page) helpful.*", r"©\s*\d{4}.*all rights reserved.*", r"cookie (settings|policy).*", r"skip to (main )?content.*"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body of a value that is computed once a row; a plain expression inside a lambda function would
    be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{WS}+|{WS}+$", "")


def words(text: Column | str) -> Column:
    """Runs without white space, in order."""
    return F.filter(F.split(col(text), f"{WS}+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def url_hash(url: Column | str) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 16)


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(col(text), "UTF-8"), 256)


def chunk_id(url: Column | str, heading: Column | str, index: Column | str) -> Column:
    """A null heading counts as empty."""
    return F.substring(F.sha2(F.concat(col(url), F.lit("|"), F.coalesce(col(heading), F.lit("")), F.lit("|"), col(index).cast("string")), 256), 1, 16)


def shingles(text: Column | str, k: int = 5) -> Column:
    """Distinct k-word shingles in lower case; one of all words if there are fewer."""
    return let(words(F.lower(col(text))), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))))


def without_boilerplate(text: Column | str) -> Column:
    """Lines that match no boilerplate pattern, with at most one blank line in a row, stripped."""
    pattern = "(?i)^(" + "|".join(BOILERPLATE) + ")$"
    kept = F.filter(F.split(col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda line: ~strip(line).rlike(pattern))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def plain_punctuation(text: Column | str) -> Column:
    out = col(text)
    for old, new in PUNCTUATION.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def joined_lines(text: Column | str) -> Column:
    """A line that begins in lower case continues the line before it, unless that one is empty or
    ends a sentence, a label or a table row. Only the line before decides, so no fold is needed."""
    ends = lambda line: F.regexp_replace(line, f"{WS}+$", "")

    def piece(lines: Column, line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        joins = (before != "") & ~ends(before).rlike(r"[.:!?|]$") & (line.rlike(r"^\p{Ll}"))
        return F.when(i == 0, line).when(joins, F.concat(F.lit(" "), line)).otherwise(F.concat(F.lit("\n"), line))

    return let(F.split(col(text), "\n"), lambda lines: F.array_join(F.transform(lines, lambda line, i: piece(lines, line, i)), ""))


def plain_space(text: Column | str) -> Column:
    """Unix line ends, single spaces, no space before a line's text, at most one blank line, stripped."""
    out = F.replace(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern, new in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def distinct_blocks(text: Column | str, separator: str = "\n\n") -> Column:
    """Blocks in order, each that equals an earlier one left out; headings, table rows and blocks of
    under three characters always stay."""
    shown = lambda b: strip(b).startswith("#") | strip(b).startswith("|") | (F.char_length(strip(b)) < 3)
    kept = lambda blocks, bare: F.filter(blocks, lambda b, i: shown(b) | (F.array_position(bare, strip(b)) == i + 1))
    return F.array_join(let(F.split(col(text), separator), lambda blocks: let(F.transform(blocks, strip), lambda bare: kept(blocks, bare))), separator)


def normalized(text: Column | str) -> Column:
    """The cleaning stage in its order, but for compatibility characters (see udfs.nfkc)."""
    return distinct_blocks(plain_space(joined_lines(plain_punctuation(text))))


def heading_path(text: Column | str, most: int = 3) -> Column:
    heads = F.filter(F.split(col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda line: line.startswith("#"))
    return F.array_join(F.transform(F.slice(heads, 1, most), lambda h: strip(F.regexp_replace(h, "^#+", ""))), " > ")


def contains_any(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def first_rule(text: Column, rules: list[tuple[str, list[str]]], otherwise: str | None) -> Column:
    """The label of the first rule of which a keyword occurs in text."""
    out = F.when(contains_any(text, rules[0][1]), F.lit(rules[0][0]))
    for label, keywords in rules[1:]:
        out = out.when(contains_any(text, keywords), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty; null if none is."""
    return F.coalesce(*(F.nullif(col(v), F.lit("")) for v in values))


def similarity(distance: Column | str) -> Column:
    """Of a cosine distance."""
    return 1 - col(distance)


def titled(text: Column | str) -> Column:
    """Every run of letters with its first letter large and the others small; what follows a hyphen,
    an apostrophe or a digit starts a word."""
    runs = F.regexp_extract_all(col(text), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def metadata_prefix(brand: Column | str, category: Column | str, page_type: Column | str, heading: Column | str, text: Column | str) -> Column:
    """The text after a line of what is known about it; empty parts are left out, and the line if all are."""
    part = lambda label, x, shown: F.when(filled(x).isNotNull(), F.concat(F.lit(label), shown))
    line = F.concat_ws(
        " | ", part("Brand: ", brand, titled(brand)), part("Appliance: ", category, titled(category)), part("Support Type: ", page_type, titled(F.replace(col(page_type), F.lit("_"), F.lit(" ")))), part("Section: ", heading, col(heading))
    )
    return F.when(line == "", col(text)).otherwise(F.concat(line, F.lit("\n\n"), col(text)))


def embed_text(title: Column | str, category: Column | str, page_type: Column | str, heading: Column | str, text: Column | str) -> Column:
    """What an embedding model reads of a chunk: five labelled lines, missing values empty."""
    value = lambda x, other="": F.coalesce(filled(x), F.lit(other))
    lines = [("Title: ", value(title)), ("Appliance: ", value(category)), ("Page Type: ", value(page_type, "general_support")), ("Heading: ", value(heading)), ("Content: ", value(text))]
    return F.concat(*(x for k, (label, shown) in enumerate(lines) for x in (F.lit(("\n" if k else "") + label), shown)))


def metadata_map() -> Column:
    """A chunk's columns as a map of strings, missing ones empty."""
    value = lambda x, other="": F.coalesce(filled(x), F.lit(other))
    pairs = [*((c, value(c)) for c in ("strategy", "heading_path", "url", "brand", "category", "title")), ("page_type", value("page_type", "general_support")), ("has_table", F.when(F.coalesce("has_table", F.lit(False)), "True").otherwise("False"))]
    return F.create_map(*(x for c, v in pairs for x in (F.lit(c), v)))
