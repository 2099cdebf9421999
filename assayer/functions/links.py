"""Links and text of saved pages as Column expressions: parsing, resolution against the page's address, visible text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import normalized_url

#: What a reader of a page does not see.
UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
BASE = r"""(?is)<base\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
#: Character references that occur in addresses; &amp; comes last, so that none is read twice.
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def seen(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")


def unescaped(col: Column) -> Column:
    for name, char in REFERENCES:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def _bare(quoted: Column) -> Column:
    return F.trim(unescaped(F.regexp_replace(quoted, r"""^["']|["']$""", "")))


def _written(page: Column) -> Column:
    return F.transform(F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(1)), _bare)


def hrefs(html: Column) -> Column:
    """The addresses of a page's links as they are written, in their order; none for a null page."""
    return let(seen(html), _written)


def _without_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments; .. at the top stays there."""

    def joined(parts: Column) -> Column:
        none = F.array().cast("array<string>")
        kept = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
        end = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), end)

    return let(F.split(F.substr(path, F.lit(2)), "/"), joined)


def _address(url: Column) -> Column:
    """What a link needs of the address that it is relative to: an absolute one."""
    page = F.regexp_replace(url, "#.*$", "")
    bare = F.substring_index(page, "?", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1))
    folder = F.regexp_extract(bare, r"^[^/]*//[^/]*(/(?:.*/)?)", 1)
    return F.struct(scheme.alias("scheme"), origin.alias("origin"), page.alias("page"), bare.alias("bare"), F.when(folder == "", "/").otherwise(folder).alias("folder"))


def _joined(href: Column, at: Column) -> Column:
    def made(h: Column) -> Column:
        target, query = F.substring_index(h, "?", 1), F.regexp_extract(h, r"(\?.*)$", 1)
        path = F.when(h.startswith("/"), target).otherwise(F.concat(at["folder"], target))
        return (
            F.when(h.rlike("(?i)^https?://"), h)
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(h == "", at["page"])
            .when(h.startswith("//"), F.concat(at["scheme"], F.lit(":"), h))
            .when(h.startswith("?"), F.concat(at["bare"], h))
            .otherwise(F.concat(at["origin"], _without_dots(path), query))
        )

    return let(F.regexp_replace(href, "#.*$", ""), made)


def resolved(href: Column, url: Column) -> Column:
    """href as an address of its own, without its fragment; null for other schemes than http and https and for null.

    url: an absolute address. An empty href, or one that is a fragment only, is the page itself.
    """
    return F.when(href.isNotNull(), let(_address(url), lambda at: _joined(href, at)))


def targets(html: Column, url: Column) -> Column:
    """The normalised addresses a page links to, each once, in order of their first link; not the page itself.

    Links are relative to the page's <base>, or else to its address.
    """

    def found(page: Column) -> Column:
        base = let(_bare(F.regexp_extract(page, BASE, 1)), lambda b: F.when(b != "", resolved(b, url)).otherwise(url))
        return let(_address(base), lambda at: F.transform(_written(page), lambda h: let(_joined(h, at), lambda u: normalized_url(u))))

    own = normalized_url(url)
    return let(own, lambda me: F.array_distinct(F.filter(let(seen(html), found), lambda u: u.isNotNull() & (u != me))))


def visible_text(html: Column) -> Column:
    """The page's text: tags become spaces, character references of REFERENCES are read, white space is one space."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(seen(html), r"(?s)<[^>]*>", " ")), r"\s+", " "))
