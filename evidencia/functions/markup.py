"""Text out of HTML and the parts of web addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Named character references; the ampersand comes last so nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&micro;", "µ"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&bull;", "•"),
]

STEPS = [
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)</?[a-zA-Z!?][^>]*>", " "),
]


def _numeric_references(text: Column) -> Column:
    """Decode &#8211; and &#x2013; by cutting the text at `&#`."""

    def piece(p, i):
        dec = F.regexp_extract(p, r"^([0-9]{1,7});", 1)
        hexa = F.regexp_extract(p, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(dec != "", F.hex(dec.try_cast("bigint"))).when(hexa != "", hexa)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        rest = F.regexp_replace(p, r"^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", "")
        return (F.when(i == 0, p).when(code.isNotNull(), F.concat(char, rest))
                .otherwise(F.concat(F.lit("&#"), p)))

    decoded = F.array_join(F.transform(F.split(text, "&#"), piece), "")
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags out, references decoded, blanks and blank lines collapsed."""
    text = reduce(lambda t, step: F.regexp_replace(t, *step), STEPS, html)
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    text = F.replace(_numeric_references(text), F.lit("&amp;"), F.lit("&"))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(text, r"\n\s*\n+", "\n")


def flat_text(html: Column) -> Column:
    """As html_text, with all white space collapsed to single blanks."""
    return F.trim(F.regexp_replace(html_text(html), r"\s+", " "))
