"""Text functions with UTF-16 lengths and Unicode white space where the semantics ask for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\uFEFF]"
#: Session path layouts and the home prefixes of their directory names.
CLAUDE_MARK, CLAUDE_SESSIONS, PI_SESSIONS = "/.claude/", "/.claude/projects/", "/.pi/agent/sessions/"
REPOS_NAME, HOME_NAME, HOME_ITSELF = r"^home-[^-]+-repos-(?:gh|work|3rd)-(.+)$", r"^home-[^-]+-(.+)$", r"^home-[^-]+$"
#: Token runs, what stands between them, and Hangul runs.
TOKEN, NO_TOKEN = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
HANGUL = r"[\uAC00-\uD7AF]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def left_utf16(text: Column, n: int) -> Column:
    """First n UTF-16 units; a pair cut in half is left out."""
    head = F.substring(F.encode(text, "UTF-16BE"), 1, 2 * n)
    half = F.hex(F.substring(head, 2 * n - 1, 1)).isin("D8", "D9", "DA", "DB")
    exact = F.decode(F.when(half, F.substring(head, 1, 2 * n - 2)).otherwise(head), "UTF-16BE")
    return F.when(utf16_length(text) == F.length(text), F.left(text, F.lit(n))).otherwise(exact)


def truncate(text: Column, n: int) -> Column:
    """Text of at most n units, with `...` added where it was cut."""
    return F.when(utf16_length(text) > n, F.concat(left_utf16(text, n), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def token_text(text: Column) -> Column:
    """The tokens in order with one blank between, as one string: less work than an array of them."""
    return F.trim(F.regexp_replace(F.lower(text), NO_TOKEN, " "))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets; both empty is 1, one empty is 0."""
    both = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
    return both.otherwise(bind(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common)))


def hangul_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HANGUL), F.lit(0))


def source_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(CLAUDE_MARK)), "claude").otherwise("pi")


def project_of(path: Column) -> Column:
    """Project name from a session path: the directory after the layout's marker, without its home prefix."""

    def after(parts, marker):
        at = F.array_position(parts, marker)
        return F.coalesce(F.get(parts, at.cast("int")), F.lit("unknown"))

    def named(parts):
        own = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.lit("."))
        return (
            F.when(F.contains(path, F.lit(CLAUDE_SESSIONS)), after(parts, "projects"))
            .when(F.contains(path, F.lit(PI_SESSIONS)), after(parts, "sessions"))
            .otherwise(own)
        )

    def short(name):
        return (
            F.when(F.regexp(name, F.lit(REPOS_NAME)), F.regexp_extract(name, REPOS_NAME, 1))
            .when(F.regexp(name, F.lit(HOME_NAME)), F.regexp_extract(name, HOME_NAME, 1))
            .when(F.regexp(name, F.lit(HOME_ITSELF)), "home")
            .when(name == "", "unknown")
            .otherwise(name)
        )

    return bind(F.regexp_replace(bind(F.split(path, "/"), named), r"^-+|-+$", ""), short)


def content_text(content: Column) -> Column:
    """Text of a message's content, a VARIANT: a string as it is, text parts joined by newlines, else empty."""
    kind = F.schema_of_variant(content)
    parts = F.try_variant_get(content, "$", "array<variant>")
    text = F.filter(
        F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))),
        lambda t: t.isNotNull() & (t != ""),
    )
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(text, "\n")).otherwise("")


def enriched(title: Column, filetags: Column, hierarchy: Column, heading_tags: Column, archived: Column, content: Column) -> Column:
    """The text that is embedded: title, [tags], > hierarchy, (extra tags), a blank line, content."""
    extra = F.filter(heading_tags, lambda t: ~F.array_contains(filetags, F.lower(t)))
    return F.concat_ws(
        "\n",
        F.when(title != "", title),
        F.when(F.size(filetags) > 0, F.concat(F.lit("["), F.array_join(filetags, ", "), F.lit("]"))),
        F.when((hierarchy != "") & (hierarchy != title), F.concat(F.lit("> "), hierarchy)),
        F.when(~archived & (F.size(extra) > 0), F.concat(F.lit("("), F.array_join(extra, ", "), F.lit(")"))),
        F.when(content != "", F.concat(F.lit("\n"), content)),
    )
