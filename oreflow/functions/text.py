"""Text, map and record expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that make a differing literal suspicious.
SUSPICIOUS_TERMS = (
    "cart", "password", "login", "account", "submit", "eval", "script", "https://", "http://", "encode", "decode", "URI",
    "network", "dns", "get", "post", "fromCharCode", "xmlHttpRequest", "ajax", "charCodeAt", "createElement", "insertBefore", "appendChild",
)


def safe_keys(counts: Column) -> Column:
    """A map whose keys that begin with $, or are _id, get a leading F."""
    return F.transform_keys(counts, lambda k, _: F.when(k.startswith("$") | (k == "_id"), F.concat(F.lit("F"), k)).otherwise(k))


def truncate_literals(counts: Column, size: int = 200) -> Column:
    """A map with keys cut to a size; of keys that become equal the last one's value stays."""
    # built without a map of duplicate keys, so that it holds under any setting of mapKeyDedupPolicy
    entries = F.transform(F.map_entries(counts), lambda e: F.struct(F.substring(e["key"], 1, size).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, n: ~F.exists(F.slice(entries, n + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    too_long = F.exists(F.map_keys(counts), lambda k: F.length(k) > size)
    return F.when(too_long, F.map_from_entries(last)).otherwise(counts)


def join_literals(keys: Column) -> Column:
    """Keys joined by commas, with their own commas as %2C."""
    return F.array_join(F.transform(keys, lambda k: F.replace(k, F.lit(","), F.lit("%2C"))), ",")


def functions_list(names: Column) -> Column:
    """A blank-separated list as an array; empty for an empty text."""
    return F.when(F.length(names) < 1, F.array().cast("array<string>")).otherwise(F.split(names, " "))


def words(text: Column) -> Column:
    """The words between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_counts(rows: DataFrame, keys: list[str], text_col: str = "text", name: str = "counts") -> DataFrame:
    """keys and a map of each text's words to how often they occur; texts without words have an empty map.

    Words are counted by partial aggregation before the maps are built; keys should be unique.
    """
    each = rows.select(*keys, F.explode(words(F.col(text_col))).alias("_w")).groupBy(*keys, "_w").agg(F.count("*").cast("int").alias("_n"))
    maps = each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_w", "_n")))).alias(name))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return rows.select(*keys).join(maps, keys, "left").withColumn(name, F.coalesce(name, empty))


def decoded(data: Column) -> Column:
    """Bytes as text: UTF-8 if they are that, else Latin-1, which any bytes are."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def shortened(reason: Column, size: int = 300) -> Column:
    """A failure's reason, cut with three dots from `size` characters on."""
    return F.when(F.length(reason) < size, reason).otherwise(F.concat(F.substring(reason, 1, size), F.lit("...")))


def suspicious_terms(literals: Column, fold_terms: bool = False) -> Column:
    """Over an array of comma-joined literals, how many (literal, term) pairs have the term in the lower-cased literal.

    Terms with capitals can match only if fold_terms lowers them too.
    """
    tokens = F.transform(F.filter(F.flatten(F.transform(literals, lambda x: F.split(x, ","))), lambda t: t != ""), F.lower)
    terms = [t.lower() for t in SUSPICIOUS_TERMS] if fold_terms else [t for t in SUSPICIOUS_TERMS if t == t.lower()]
    hits = lambda t: sum((t.contains(x).cast("int") for x in terms), F.lit(0))
    return F.coalesce(F.aggregate(tokens, F.lit(0), lambda n, t: n + hits(t)), F.lit(0))


def total_length(texts: Column) -> Column:
    return F.coalesce(F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t)), F.lit(0))


def is_packed(code: Column) -> Column:
    """Whether a script is packed by a well-known packer."""
    return F.coalesce(code.rlike(r"eval\s*\(\s*function\s*\(\s*p\s*,\s*a\s*,\s*c\s*,\s*k\s*,\s*e\s*,"), F.lit(False))


def javascript_only(content_type: Column, size_bytes: Column, other_type: Column | None = None, least: int = 1500) -> Column:
    """Whether a record is a script of some size; content_type wins over the other name of the field."""
    kind = F.coalesce(content_type, *([other_type] if other_type is not None else []), F.lit(""))
    return F.coalesce(kind.contains("javascript") & (size_bytes >= least), F.lit(False))


def log_fields(line: Column) -> list[Column]:
    """What a dynamic analysis log line tells: analysis id, script redirection, link, http and anchor targets (empty: nothing)."""
    at = r"^\[[^\]]*\]\s+"
    return [
        F.regexp_extract(line, at + r"\[MongoDB\] Analysis ID: (\S+)", 1).alias("analysis_id"),
        F.regexp_extract(line, at + r"\[script src redirection\] (\S+) -> (\S+)", 1).alias("redirected_from"),
        F.regexp_extract(line, at + r"\[script src redirection\] (\S+) -> (\S+)", 2).alias("redirected_to"),
        F.regexp_extract(line, at + r"\[link[^\]]*\] (\S+)", 1).alias("link"),
        F.regexp_extract(line, at + r"\[HTTP\] URL: (\S+)", 1).alias("http"),
        F.regexp_extract(line, at + r"\[anchor[^\]]*\] (\S+)", 1).alias("anchor"),
    ]


def hrefs(html: Column) -> Column:
    """The quoted href values of a page's anchors."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))


def script_sources(html: Column) -> Column:
    """The quoted src values of a page's scripts."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<script\s[^>]*?src=["']([^"']*)["']"""), F.lit(1))


def inline_scripts(html: Column) -> Column:
    """The texts of a page's scripts that have no src."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<script(?![^>]*\ssrc=)[^>]*>(.*?)</script>"), F.lit(1)), lambda x: F.trim(x) != "")


def short_date(time: Column) -> Column:
    """A time's date as month/day/year."""
    return F.date_format(time, "MM/dd/yyyy")


def log_time(time: Column) -> Column:
    """A time as day-month-year hours:minutes:seconds and zone."""
    return F.date_format(time, "dd-MMM-yyyy HH:mm:ssxx")


def chosen(options: Column, seed: int) -> Column:
    """One of an array's values for each row, at random but the same for the same seed and partitions."""
    return F.element_at(options, F.floor(F.rand(seed) * F.size(options)).cast("int") + 1)
