"""String expressions: code-aware tokens, query texts, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a segment of letters and digits splits: lower|Upper, ACRONYM|Word, letter|digit, digit|letter.
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])"

#: The same borders as a plain test.
CAMEL_BORDER = r"[a-z][A-Z]|[A-Z][A-Z][a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def code_tokens(text: Column | str) -> Column:
    """Tokens of prose and code: runs of letters and digits, split at case and digit borders, lower case; a segment
    that was split is also a token as a whole. Null gives no tokens."""
    segments = F.filter(F.split(F.coalesce(_col(text), F.lit("")), "[^a-zA-Z0-9]+"), lambda s: s != "")

    def parts(segment: Column) -> Column:
        # Few segments have a border; the others cost one plain test.
        split = F.transform(F.split(segment, CAMEL), F.lower)
        return F.when(segment.rlike(CAMEL_BORDER), F.concat(split, F.array(F.lower(segment)))).otherwise(F.array(F.lower(segment)))

    return F.flatten(F.transform(segments, parts))


def expand_camel(text: Column | str) -> Column:
    """Each word followed by its camel-case parts if it has several; white space stays as it is."""
    pieces = F.split(F.coalesce(_col(text), F.lit("")), r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")

    def grown(word: Column) -> Column:
        split = F.filter(F.split(word, CAMEL), lambda p: p != "")
        return F.when(F.regexp_like(word, F.lit(r"\S")) & (F.size(split) > 1), F.concat_ws(" ", F.array(word), split)).otherwise(word)

    return F.array_join(F.transform(pieces, grown), "")


#: The operator characters of full-text questions.
FTS_OPERATORS = r'["*^:()+\-]'


def plain_question(text: Column | str) -> Column:
    """A question without full-text operators, white space squeezed."""
    return F.regexp_replace(F.trim(F.regexp_replace(_col(text), FTS_OPERATORS, " ")), r"\s+", " ")


def clean_question(text: str) -> str:
    """``plain_question`` of one text on the driver."""
    return re.sub(r"\s+", " ", re.sub(FTS_OPERATORS, " ", text, flags=re.ASCII).strip(" "), flags=re.ASCII)


def template_query(text: Column | str, template: str = "Passages about: %s") -> Column:
    """The text put into a template, as a hypothetical passage for a retrieval."""
    return F.format_string(template, _col(text))


def format_confidence(value: Column | str) -> Column:
    """Four decimals."""
    return F.format_string("%.4f", _col(value).cast("double"))


def parse_confidence(text: Column | str) -> Column:
    return _col(text).try_cast("double")


def content_hash(text: Column | str) -> Column:
    """SHA-256 in hex."""
    return F.sha2(_col(text), 256)


def trend_name(series: str, trend: str, inner: str | None = None) -> str:
    """The column of a derived trend feature."""
    return f"{series}_{trend.lower()}_{inner}" if inner else f"{series}_{trend.lower()}"


#: The phrases of an explanation.
HEAD = "Retrieved %d %s (mode: %s, caseType: %s)."
TOP, FEATURES = "\nTop match:", "\nFeature breakdown: "


def explanation(count: Column, mode: Column | str, case_type: Column | str, top_id: Column, top_score: Column, confidence: Column, features: Column) -> Column:
    """A retrieval in words: number of cases, mode and type; then the best match and its features, best first.

    features: a map from name to similarity; parts that are null or empty are left out.
    """
    mode, case_type = (F.lit(x) if isinstance(x, str) else x for x in (mode, case_type))
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(features), order), lambda p: F.format_string("%s=%.2f", p["key"], p["value"])), ", ")
    head = F.format_string(HEAD, count, F.when(count == 1, "case").otherwise("cases"), mode, case_type)
    best = F.concat(
        F.lit(TOP),
        F.coalesce(F.concat(F.lit(" caseId="), top_id.cast("string"), F.lit(",")), F.lit("")),
        F.format_string(" score=%.2f", top_score),
        F.coalesce(F.when(confidence.isNotNull(), F.format_string(", confidence=%.2f", confidence)), F.lit("")),
        F.lit("."),
        F.when(F.size(F.map_keys(features)) > 0, F.concat(F.lit(FEATURES), shown, F.lit("."))).otherwise(""),
    )
    return F.when(count == 0, head).otherwise(F.concat(head, best))


def dedup_key(document: Column | str, content: Column | str) -> Column:
    """Document id, a NUL and the content."""
    return F.concat(_col(document).cast("string"), F.lit("\0"), _col(content))


def front_matter(text: Column | str) -> Column:
    """struct<metadata map, body>: a leading block of ``key: value`` lines between ``---`` lines, quotes stripped.

    Without a block, or with one that is never closed, the body is the whole text.
    """
    t = F.coalesce(_col(text), F.lit(""))
    pattern = r"(?s)\A---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n(.*))?\z"
    has = F.regexp_like(t, F.lit(pattern))
    lines = F.filter(F.split(F.regexp_extract(t, pattern, 1), r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*[^\s:#][^:]*:")))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^([^:]*):(.*)$", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^([^:]*):(.*)$", 2)), "^([\"'])(.*)\\1$", "$2").alias("value"),
        ),
    )
    # The last of lines with one key counts.
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.when(has, F.map_from_entries(last)).otherwise(empty).alias("metadata"), F.when(has, F.regexp_extract(t, pattern, 2)).otherwise(t).alias("body"))
