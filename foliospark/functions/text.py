"""Text expressions: all are built-in column functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The token pattern (words with inner - or _, runs of CJK, single characters).
TOKEN = r"[a-z0-9]+(?:[-_][a-z0-9]+)*|[\x{4e00}-\x{9fff}]+|\S"
#: The same of the tokens that count: no single marks, and no way back, as nothing follows a token.
KEPT = r"[a-z0-9]++(?:[-_][a-z0-9]++)*+|[\x{4e00}-\x{9fff}]++|[\p{L}\p{N}]"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"


#: Ids; where reference lists are split; the marks before an entry's title and what ends its first sentence; valid ids.
ARXIV_ID = r"(?i)(\d{4}\.\d{4,5}(?:v\d+)?)"
NEXT_ENTRY = r"\n(?=\s*\[\d+\]|\s*\d+\.\s)"
ENTRY_NUMBER = r"^\[?\d+\]?\.?\s*"
SENTENCE_END = r"[.。!！?？]\s+"
BEFORE_TITLE = r"(?:\)\.|,?\s*\d{4}[a-z]?\.?)\s*([^\n]+)"
VALID_ID = r"^[\w.-]+$"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; single characters only if alphanumeric."""
    return F.regexp_extract_all(F.lower(text), F.lit(KEPT), F.lit(0))


def bigram_tokens(text: Column) -> Column:
    """As ``tokens``, but CJK runs become overlapping pairs of characters."""
    pairs = lambda t: F.when(
        t.rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"),
        F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))),
    ).otherwise(F.array(t))
    return F.flatten(F.transform(tokens(text), pairs))


def cjk_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.round(F.regexp_count(text, F.lit(CJK)) / n, 4)).otherwise(F.lit(0.0))


def language(text: Column) -> Column:
    """zh where more than a tenth of the characters are CJK, else en."""
    share = F.regexp_count(text, F.lit(CJK)) / F.length(text)
    return F.when((F.length(text) > 0) & (share > 0.10), "zh").otherwise("en")


def arxiv_ids(text: Column) -> Column:
    """Sorted distinct ids, wherever they stand: in URLs, after "arXiv:" or "arXiv #", and bare."""
    found = F.regexp_extract_all(text, F.lit(ARXIV_ID), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 9)))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def reference_entries(text: Column) -> Column:
    """Entries of a reference list, split before ``[n]`` or ``n. `` at a line's start, or, without
    such numbers, at blank lines; short ones are left out."""
    numbered = F.split(text, NEXT_ENTRY)
    parts = F.when(F.size(numbered) > 1, numbered).otherwise(F.split(text, "\n\n"))
    return F.filter(F.transform(parts, stripped), lambda x: F.length(x) > 20)


def entry_title(entry: Column) -> Column:
    """The likely title: of the first sentence what follows ``).`` or a year, or all of it."""
    body = F.regexp_replace(stripped(entry), ENTRY_NUMBER, "")
    first = stripped(F.element_at(F.split(body, SENTENCE_END), 1))
    after = F.regexp_extract(first, BEFORE_TITLE, 1)
    return F.substring(F.when(after != "", stripped(after)).otherwise(first), 1, 200)


def base_id(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"v\d+$", "")


def valid_id(arxiv_id: Column) -> Column:
    return arxiv_id.rlike(VALID_ID) & ~F.contains(arxiv_id, F.lit(".."))


def preview(text: Column, n: int) -> Column:
    """The text, or its first n characters and an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def squeeze(text: Column) -> Column:
    """All runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeeze_lines(text: Column) -> Column:
    """Three and more line breaks as two."""
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def author_list(authors: Column) -> Column:
    return F.filter(F.transform(F.split(authors, ","), lambda x: F.trim(x)), lambda x: x != "")


def bibtex_key(authors: Column, published: Column) -> Column:
    """Last word of the first author, then the year."""
    first = F.trim(F.element_at(F.split(F.coalesce(authors, F.lit("")), ","), 1))
    name = F.element_at(F.split(first, r"\s+"), -1)
    year = F.substring(F.coalesce(published, F.lit("")), 1, 4)
    return F.concat(F.when(name == "", "Unknown").otherwise(name), F.when(year == "", "0000").otherwise(year))


def first_year(published: Column) -> Column:
    return F.regexp_extract(published, r"\d{4}", 0)


def call_signature(tool: Column, args: Column) -> Column:
    """First 12 hex digits of the md5 of a tool and its key-sorted arguments (a map)."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args))))
    return F.substring(F.md5(F.concat(tool, ordered)), 1, 12)


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


#: Seconds of the units of a rate, without plural s.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def rate_limit(text: Column) -> tuple[Column, Column]:
    """(number, seconds) of ``n/unit``; a bad number is 30, an unknown unit 60 seconds."""
    parts = F.split(F.trim(text), "/")
    unit = F.regexp_replace(F.lower(F.try_element_at(parts, F.lit(2))), "s+$", "")
    seconds = F.coalesce(*[F.when(unit == name, n) for name, n in UNITS.items()], F.lit(60))
    pair = F.size(parts) == 2
    n = F.coalesce(parts[0].try_cast("int"), F.lit(30))
    return F.when(pair, n).otherwise(30), F.when(pair, seconds).otherwise(60)


def client_key(forwarded: Column, real: Column, peer: Column) -> Column:
    """First forwarded address, else the real one, else the peer's, else ``unknown``."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(F.element_at(F.split(forwarded, ","), 1)), some(real), some(peer), F.lit("unknown"))


#: What the kind or message of a failure that shouldn't be tried again contains.
FINAL_ERRORS = ["valueerror", "typeerror", "keyerror", "filenotfounderror", "notfounderror", "404", "not found", "不存在"]


def retryable(kind: Column, message: Column) -> Column:
    said = F.lower(F.concat_ws("\n", kind, message))
    return ~F.exists(F.array(*[F.lit(x) for x in FINAL_ERRORS]), lambda x: F.contains(said, x))


def answer_key(task: Column, lang: Column, query: Column, context: Column) -> Column:
    """The key under which an answer to a query in a context is kept."""
    return content_key(task, lang, query, context)
