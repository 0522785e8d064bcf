"""HTML expressions, all on built-in regular-expression functions.

One pattern walks a page from left to right the way an HTML tokenizer does:
comments, script-like elements and quoted attribute values are stepped over
whole, so that markup inside them is not counted. Anything left open runs to
the end of the page, which keeps the walk linear in the page's length. Loops
are possessive, so long attributes do not deepen the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML white space, and the elements whose content is text only.
SPACE = r" \t\n\f\r"
TEXT_ONLY_ELEMENTS = (
    "iframe", "noembed", "noframes", "script", "style", "textarea", "xmp",
)

# A quote opens a value only right after the equals sign; anywhere else it is part of a
# name or an unquoted value. A quoted value that is never closed takes the rest of the page.
_VALUE = rf"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^{SPACE}"'>][^{SPACE}>]*+)"""
_EQUALS = rf"[{SPACE}]*+=[{SPACE}]*+"
_NAME = rf"[^{SPACE}/>][^{SPACE}/>=]*+"
_ATTRIBUTES = rf"(?:[{SPACE}/]++|{_NAME}(?:{_EQUALS}{_VALUE}?+)?+)*+"
_TAG_REST = rf"(?:[{SPACE}/]{_ATTRIBUTES})?+>"


def _element(name: str) -> str:
    """An element up to its end tag, without the opening bracket."""
    end = rf"/{name}[{SPACE}/>]"
    return rf"{name}{_TAG_REST}[^<]*+(?:<(?!{end})[^<]*+)*+(?:<{end}|\z)"


def _token_pattern(tags: tuple[str, ...]) -> str:
    """Match every token; group 1 holds a title or a wanted tag, without its ``<``.

    The bracket stands before all alternatives, so that text between tags costs
    one comparison per character.
    """
    wanted = [_element("title")]
    if tags:
        wanted.append(rf"(?:{'|'.join(tags)}){_TAG_REST}")
    alternatives = [
        f"({'|'.join(wanted)})",
        *[_element(name) for name in TEXT_ONLY_ELEMENTS],
        rf"/?[a-z][^{SPACE}/>]*+{_ATTRIBUTES}>",
        r"/?[a-z].*+\z",
        r"!---?>",
        r"!--[^-]*+(?:-(?!-!?>)[^-]*+)*+(?:--!?>|\z)",
        r"[!?/][^>]*+(?:>|\z)",
    ]
    return f"(?is)<(?:{'|'.join(alternatives)})"


def _attribute_pattern(tag: str, name: str) -> str:
    """Group 1 is the value, quotes included, of the first such attribute."""
    return (
        rf"(?is)^{tag}(?:[{SPACE}/]++|(?!{name}{_EQUALS}){_NAME}(?:{_EQUALS}{_VALUE}?+)?+)*+"
        rf"{name}{_EQUALS}({_VALUE})"
    )


def tokens(html: Column | str, *tags: str) -> Column:
    """The page's title elements and start tags of the given names, in order.

    Each is given as written but for its first bracket.
    """
    found = F.regexp_extract_all(html, F.lit(_token_pattern(tags)), F.lit(1))
    return F.array_remove(found, "")


def _is_tag(token: Column, name: str) -> Column:
    return token.rlike(rf"(?i)^{name}[{SPACE}/>]")


def count_tag(found: Column, name: str) -> Column:
    return F.size(F.filter(found, lambda token: _is_tag(token, name))).cast("bigint")


def attribute(tag_text: Column, tag: str, name: str) -> Column:
    """An attribute's value as written, or NULL if the tag has none."""
    raw = F.regexp_extract(tag_text, _attribute_pattern(tag, name), 1)
    quoted = raw.rlike("""^["']""")
    return (
        F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2))
        .when(raw != "", raw)
    )


def link_tags(found: Column) -> Column:
    """The ``a`` tags that carry a link target."""
    return F.filter(found, lambda token: token.rlike(_attribute_pattern("a", "href")))


def count_links(found: Column) -> Column:
    return F.size(link_tags(found)).cast("bigint")


def has_meta(found: Column, meta_name: str) -> Column:
    return F.exists(
        found,
        lambda token: F.coalesce(
            F.lower(F.trim(attribute(token, "meta", "name"))) == meta_name, F.lit(False)
        ),
    )


def title(found: Column) -> Column:
    """Text of the first title element, white space collapsed; '' if absent."""
    titles = F.filter(found, lambda token: _is_tag(token, "title"))
    first = F.coalesce(F.get(titles, F.lit(0)), F.lit(""))
    text = F.regexp_replace(first, rf"(?is)^title{_TAG_REST}|</title[{SPACE}/>]\z", "")
    collapsed = F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))
    return F.when(found.isNotNull(), collapsed)
