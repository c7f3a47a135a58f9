"""Scalar text functions as Catalyst expressions: white space, relative times, URLs, attributes, entropy, tokens, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a relative time becomes.
TIME_MARK = "⟦TS⟧"
#: Characters that vanish, and white space, by code point.
VANISH = "[​‌‍﻿]"
SPACE = "[\\t-\\r\\x20\\x85   -     　]+"
#: Query keys that only track, attributes with URLs, classes of boilerplate, framework-made ids.
TRACKING = r"(?i)^(utm_.*|gclid|fbclid|ref|_ga)$"
URL_ATTRS = ["href", "src", "poster", "cite", "action", "data"]
BOILERPLATE = ["ad", "promo", "cookie", "banner", "newsletter", "social-share", "breadcrumb"]
FRAMEWORK_ID = r"^(:r[0-9a-z]+:|radix-|headlessui-|mui-|ember\d)"
VOLATILE_NAME = r"(nonce|csrf|^data-reactid$|^data-v-|^data-svelte-)"
TOKEN_ATTR = r"(token|nonce|csrf|session|^data-|^id$|^value$|^content$)"
#: Relative times.
_MANY, _UNIT = r"(?:\d+|an?|a\sfew|several)", r"(?:second|minute|hour|day|week|month|year)s?"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[A-Za-z]{2,4})?"
RELATIVE = rf"(?i)\b(?:{_MANY}\s+{_UNIT}\s+(?:ago|from\s+now)|in\s+{_MANY}\s+{_UNIT}|as\s+of\s+{_CLOCK}|(?:last\s+)?updated\s+{_CLOCK}|just\s+now|moments?\s+ago)\b"


def collapse(text: Column) -> Column:
    """Zero-width characters vanish; runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, VANISH, ""), SPACE, " "))


def mask_times(text: Column, patterns: list[str] = ()) -> Column:
    """Relative times, then the profile's own patterns in order, become TIME_MARK."""
    for p in (RELATIVE, *patterns):
        text = F.regexp_replace(text, p, TIME_MARK)
    return text


def normal_text(text: Column, patterns: list[str] = ()) -> Column:
    return mask_times(collapse(text), patterns)


def strip_fingerprint(path: Column) -> Column:
    """app.1a2b3c4d.js -> app.js, where the middle part has six hex digits or more and a decimal one."""
    return F.regexp_replace(path, r"\.(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,}(\.[A-Za-z0-9]+)$", "$1")


def _is_buster(key: Column, value: Column) -> Column:
    """v= and hash= with a number, dotted number or four hex digits or more."""
    return key.rlike(r"(?i)^(v|hash)$") & value.rlike(r"^([0-9]+(\.[0-9]+)*|[0-9a-fA-F]{4,})$")


def canonical_query(query: Column) -> Column:
    """Parameters without tracking keys and cache busters, sorted."""
    key = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).rlike(TRACKING) & ~_is_buster(key(p), value(p)))
    return F.array_join(F.array_sort(kept), "&")


def canonical_url(url: Column) -> Column:
    """Absolute http(s) URLs: scheme and host in lower case, no default port, fragment, tracking or fingerprint; query sorted.

    Other URLs (mailto:, relative ones) lose fragment, tracking keys and fingerprints only.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    body = F.regexp_replace(bare, r"\?.*$", "")
    query = canonical_query(F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise(""))
    tail = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    scheme = F.lower(F.regexp_extract(body, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(body, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    host = F.regexp_replace(host, F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), "")
    path = F.regexp_extract(body, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1)
    path = strip_fingerprint(F.when(path == "", "/").otherwise(path))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path, tail)).otherwise(F.concat(strip_fingerprint(body), tail))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(found == "", "/").when(found.startswith("?"), F.concat(F.lit("/"), found)).otherwise(found)


def robots_url(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/robots.txt"))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over the bytes of the value."""
    # As ISO-8859-1 each byte is one character. At most 256 values are counted, so the cost is linear in the length.
    data = F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")

    def bits(s: Column) -> Column:
        n = F.length(s).cast("double")
        counts = F.transform(F.array_distinct(F.split(s, "")), lambda b: n - F.length(F.replace(s, b, F.lit(""))))
        return F.when(s == "", 0.0).otherwise(F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n)

    # A lambda's argument is computed once; an expression inside a lambda is computed for each element.
    return F.when(value.isNotNull(), F.transform(F.array(data), bits)[0])


def is_random_token(value: Column) -> Column:
    """24 bytes or more without white space: all of [A-Za-z0-9_-], or of entropy over 3.5."""
    long = (F.octet_length(value) >= 24) & ~value.rlike(r"\s")
    return long & (value.rlike(r"^[A-Za-z0-9_-]{24,}$") | (entropy(value) > 3.5))


def is_volatile_attr(name: Column, value: Column, extra: list[str] = ()) -> Column:
    """Attributes that change from load to load."""
    by_name = name.rlike(VOLATILE_NAME)
    if extra:
        by_name = by_name | name.isin(list(extra))
    return by_name | ((name == "id") & value.rlike(FRAMEWORK_ID)) | (name.rlike(TOKEN_ATTR) & is_random_token(value))


def normal_attrs(attrs: Column, extra: list[str] = ()) -> Column:
    """attrs without volatile ones; URLs canonical."""
    kept = F.map_filter(attrs, lambda k, v: ~is_volatile_attr(k, v, extra))
    return F.transform_values(kept, lambda k, v: F.when(k.isin(URL_ATTRS), canonical_url(v)).otherwise(v))


def is_boilerplate(classes: Column) -> Column:
    """Whether any class contains one of the boilerplate words: by substring, so `header` is caught too."""
    return F.exists(F.split(F.lower(classes), r"\s+"), lambda c: c.rlike("|".join(BOILERPLATE)))


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles, comments and tags; white space collapsed."""
    html = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    return collapse(F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))


def needs_render(html: Column) -> Column:
    """Too little visible text for its bytes, or an empty root that a script fills."""
    seen = F.length(visible_text(html))
    poor = (seen < 200) & (seen.cast("double") / F.octet_length(html) < 0.05)
    return poor | html.rlike(r"""(?is)<div[^>]*\bid\s*=\s*["']?(root|__next|app-root)["']?[^>]*>\s*</div>""")


def page_title(html: Column) -> Column:
    """The first title, trimmed; null if empty."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def derived_tid(url: Column) -> Column:
    """A target's id from its URL."""
    slug = F.regexp_replace(F.lower(F.regexp_replace(url, r"^https?://", "")), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    return F.when(slug == "", "target").otherwise(slug)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores; runs of white space; single other characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """tokens without those of white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def overlap(cur: Column, prior: Column) -> Column:
    """Shared part of the prior array, as a set; 1 if there is none."""
    n = F.size(F.array_distinct(prior))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(cur, prior)).cast("double") / n)
