"""URL expressions.  Spark's parse_url keeps the host's case and fails on odd urls, so these use patterns."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One search for each part: short expressions keep the code that Spark generates small.
_SCHEME = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):"
_AUTHORITY = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?"
_HOST = _AUTHORITY + r"\[?([^/?#:@\[\]]*)"
_BRACKETS = _AUTHORITY + r"\[([^\]/?#]*)"
_PORT = _AUTHORITY + r"(?:\[[^\]]*\]|[^/?#:@]*):([0-9]{1,5})(?:[/?#]|$)"
_PATH = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"

# Suffixes of media files, which are of little interest to a crawl.
MEDIA_SUFFIXES = (".mp3", ".avi", ".pdf", ".png", ".vob", ".mpeg", ".mpg", ".mp4", ".jpeg", ".jpg")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def hostname(url: Column) -> Column:
    """Lower-cased host without user, port and brackets; null if there is none."""
    inside = F.regexp_extract(url, _BRACKETS, 1)
    found = F.when(inside != "", inside).otherwise(F.regexp_extract(url, _HOST, 1))
    return F.lower(F.nullif(found, F.lit("")))


def port(url: Column) -> Column:
    """The port named, else that of http or https, else null."""
    named = F.nullif(F.regexp_extract(url, _PORT, 1), F.lit("")).cast("int")
    return F.coalesce(F.when(named.between(1, 65535), named), F.when(url.rlike("^(?i)https:"), 443).when(url.rlike("^(?i)http:"), 80))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    """What is between the first ? and #; empty if there is none."""
    return F.regexp_extract(url, _QUERY, 1)


def url_fields(url: Column, prefix: str = "") -> list[Column]:
    """host, has_query, port, scheme and path of a url, named with the prefix."""
    p = f"{prefix}_" if prefix else ""
    return [
        hostname(url).alias(f"{p}host"),
        (F.length(query(url)) > 0).alias(f"{p}has_query"),
        port(url).alias(f"{p}port"),
        scheme(url).alias(f"{p}scheme"),
        path(url).alias(f"{p}path"),
    ]


def priority(url: Column) -> Column:
    """Crawl priority, 1 the best: depth of the path, media, length of the query and of the url make it worse."""
    p, q = path(url), F.length(query(url))
    depth = F.when(p == "/", 0).otherwise(F.least(F.length(F.regexp_replace(p, "[^/]", "")), F.lit(3)))
    media = F.lit(False)
    for suffix in MEDIA_SUFFIXES:
        media = media | F.lower(p).endswith(suffix)
    return (
        F.lit(1)
        + depth
        + F.when(media, 2).otherwise(0)
        + F.when(q >= 20, 2).when(q > 0, 1).otherwise(0)
        + F.when(F.length(url) > 150, 2).when(F.length(url) > 80, 1).otherwise(0)
    )


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as an absolute url without fragment; null if it cannot be resolved."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return urldefrag(urljoin(b or "", x)).url if x is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def absolutes(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links as absolute urls with their fragments, in order; those that cannot be resolved go, and null stays null."""

    def some(b: str | None, xs: list | None) -> list | None:
        if xs is None:
            return None
        out = []
        for x in xs:
            try:
                out.append(urljoin(b or "", x))
            except ValueError:
                continue
        return out

    return pd.Series([some(b, x) for b, x in zip(base, links)], dtype=object)


def is_ip(host: Column) -> Column:
    """Whether a host is an IPv4 address in dotted form, or an IPv6 address."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.coalesce(host.rlike(rf"^({octet}\.){{3}}{octet}$") | host.rlike(r"^[0-9a-fA-F]*:[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"), F.lit(False))


def ip_number(host: Column) -> Column:
    """An IPv4 address as a number, else null."""
    parts = F.split(host, r"\.")
    number = sum((F.element_at(parts, n + 1).cast("long") * 256 ** (3 - n) for n in range(4)), F.lit(0))
    return F.when(F.size(parts) == 4, F.when(is_ip(host), number))


def is_foreign(host: Column, suffixes: tuple[str, ...] = (".com", ".au", ".net", ".org")) -> Column:
    """Whether a host ends with none of the suffixes."""
    out = F.lit(True)
    for x in suffixes:
        out = out & ~host.endswith(x)
    return out


def is_translation(url: Column) -> Column:
    """Whether a url is a file of translations."""
    return F.lower(url).contains("/i18n/") | F.lower(url).contains("/lang/")


def fits_variant(url: Column, variant: str | None) -> Column:
    """Whether a file is of the wanted variant; the names of minimised files are synonyms."""
    if not variant:
        return F.lit(True)
    return url.contains(".min.js") if variant in ("min", "minimised", "minimized") else url.contains(variant)


def fits_version(version: Column, wanted: str | None) -> Column:
    return version.contains(wanted) if wanted else F.lit(True)


# Families whose releases are spread over files of many names, in the order in which they apply.
SUBFAMILY_PREFIXES = (
    ("admin-", "admin"),
    ("chunk-googlesitekit-adminbar-", "googlesitekit-adminbar"),
    ("chunk-googlesitekit-setup-wizard-", "googlesitekit-setup-wizard"),
    ("chunk-googlesitekit-setup-wrapper-", "googlesitekit-setup-wrapper"),
    ("date-", "date"),
    ("editor", "editor"),
    ("edit-", "edit"),
    ("editor-", "editor"),
    ("eland-tracker-", "eland-tracker"),
    ("jquery-spservices-", "jquery-spservices"),
    ("login-", "login"),
    ("modernizr-", "modernizr"),
    ("moment-timezone-with-data-", "moment-timezone-with-data"),
    ("chunk-googlesitekit-", "googlesitekit"),
    ("admin-ajaxwatcher-", "admin-ajaxwatcher"),
    ("authorizenet-accept-", "authorizenet"),
    ("jquery-ui-timepicker-addon-", "jquery-ui-timepicker-addon"),
    ("ui-bootstrap-", "ui-bootstrap"),
    ("vendors-chunk-googlesitekit-adminbar-", "googlesitekit-adminbar"),
    ("woocommerce-admin-", "woocommerce-admin"),
    ("woocommerce-product-", "woocommerce-product"),
)


def _prefix_rule() -> tuple[str, str]:
    """SUBFAMILY_PREFIXES as one pattern and its replacement: what is left by the first prefix that fits, and by those after it."""
    groups = []
    for n, (prefix, short) in enumerate(SUBFAMILY_PREFIXES):
        for later, other in SUBFAMILY_PREFIXES[n + 1 :]:
            short = other if short.startswith(later) else short
        before, _, after = prefix.partition(short)
        groups.append(f"{before}({short}){after}.*")
    return rf"(?s)^(?:{'|'.join(groups)})$", "".join(f"${n + 1}" for n in range(len(groups)))


def subfamily(url: Column) -> Column:
    """The subfamily that a control's file name stands for; null for a url without a slash behind its first character.

    Suffixes of minimised and plain scripts go, runs of punctuation become one hyphen, and a chain of
    fixed rules maps names of many releases to one.  A rule sees what the rule before it made.
    """
    # each step names the step before once: a second mention would compute all steps again
    name = F.substring_index(url, "/", -1)
    name = F.regexp_replace(name, r"([.-])min\.js$", "$1")
    name = F.regexp_replace(name, r"\.js$", "")
    name = F.lower(F.regexp_replace(F.regexp_replace(name, r"[-_.]+$", ""), r"[-_.#~/]+", "-"))
    kind = F.when(url.contains("woocommerce-admin"), "woocommerce-admin-").otherwise("woocommerce-")
    name = F.when(url.contains("woocommerce"), F.concat(kind, F.substring(name, 1, 20))).otherwise(name)
    name = F.regexp_replace(name, "-+$", "")
    name = F.regexp_replace(name, r"(?s)^(kendo-culture).*\z", "$1")
    name = F.regexp_replace(name, r"^(?:wp-)?tinymce\z", "tiny-mce")
    name = F.regexp_replace(name, "-dev$", "")
    name = F.regexp_replace(name, *_prefix_rule())
    return F.when(F.instr(url, "/") > 0, F.when(url.rlike(r"(?s)^.+/"), name))
