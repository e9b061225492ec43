"""URL rules by a cascade of Bloom filters, in DataFrame functions only.

A rule's key is its host and path; a url's keys are all endings of its host at dots, with all
beginnings of its path as long as some rule's path.  Level 1 of a cascade encodes the listed keys.
Level 2 encodes the keys of the corpus that level 1 takes for listed ones, level 3 the listed keys
that level 2 takes for those, and so on until a level makes no mistakes.  As the levels were built
over every key of the corpus, the first level that rejects a key tells exactly whether it is listed:
no join.  The filters are constants of the plan; their size follows the listed keys, which are
bounded by `max_listed`, while the corpus may have any size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: A rule: verdict (allow or block), host, path.
Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: Listed keys that a plan holds as constants (some megabytes of filters); more are joined.
MAX_LISTED = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: Sequence[int], labels: int) -> Column:
    """All keys under which a rule may fit, as structs (size, host_size, key).

    lengths are those of the rules' paths, labels the most that a rule's host has: longer endings of a
    host fit no rule, so a host of many labels costs no more than a short one.
    """
    last = F.split(host, r"\.", -1)
    last = F.slice(last, F.greatest(F.size(last) - labels + 1, F.lit(1)), F.lit(labels))
    endings = F.transform(F.sequence(F.lit(1), F.size(last)), lambda n: F.array_join(F.slice(last, n, F.size(last)), "."))
    endings = F.filter(endings, lambda x: x != "")

    def keys(ending: Column) -> Column:
        found = F.array(*(F.when(F.length(path) >= n, F.concat(ending, F.substring(path, 1, n))) for n in lengths))
        return F.transform(F.array_compact(found), lambda k: F.struct(F.length(k).alias("size"), F.length(ending).alias("host_size"), k.alias("key")))

    return F.flatten(F.transform(endings, keys))


class Filter:
    """A Bloom filter as a constant array of 64-bit words."""

    def __init__(self, keys: DataFrame, level: int, n: int, rate: float) -> None:
        self.level = level
        self.bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        self.probes = max(1, round(-math.log2(rate)))
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        word, bit = F.floor(F.col("at") / 64).cast("int"), (F.col("at") % 64).cast("int")
        # at most one row for each word of the filter
        rows = places.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("set")).collect()
        words = [0] * (self.bits // 64)
        for row in rows:
            words[row["word"]] = row["set"]
        self.words = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def _places(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.level))
        first, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        return [(first + step * n) % self.bits for n in range(self.probes)]

    def test(self, key: Column) -> Column:
        """Whether key may be in the filter."""
        out = F.lit(True)
        for at in self._places(key):
            word = F.element_at(self.words, F.floor(at / 64).cast("int") + 1)
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def cascade(listed: DataFrame, others: DataFrame, n_others: int, max_listed: int = MAX_LISTED) -> Callable[[Column], Column]:
    """A test that is true for the keys of listed and false for those of others that are not listed.

    n_others is about how many distinct keys others has; it only sets the size of the first level.
    """
    listed = listed.select("key").distinct()
    n = listed.limit(max_listed + 1).count()
    if n > max_listed:
        raise ValueError("more listed keys than a constant filter may hold")
    if not n:
        return lambda key: F.lit(False)
    levels, inside, outside = [], listed, others.select("key").join(listed, "key", "left_anti")
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n / max(n, n_others)))
    while n:
        level = Filter(inside, len(levels) + 1, n, rate)
        wrong = cut(outside.where(level.test(F.col("key"))).distinct(), "mistakes")
        levels.append(level)
        inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def test(key: Column) -> Column:
        out = F.lit(len(levels) % 2 == 1)
        for number, level in reversed(list(enumerate(levels))):
            out = F.when(~level.test(key), F.lit(number % 2 == 1)).otherwise(out)
        return out

    return test


def _joined(rows: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """rows with rule and own (the rule's verdict), by joining the keys of each distinct host and path with the listed ones."""
    each = rows.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("k"))
    each = each.select("host", "path", "k", F.col("k.key").alias("key")).join(listed, "key")
    best = each.groupBy("host", "path").agg(F.max(F.struct("k.size", "k.host_size", "key", "verdict")).alias("best"))
    found = rows.join(best, ["host", "path"], "left")
    return found.select(*rows.columns, F.col("best.key").alias("rule"), F.col("best.verdict").alias("own"))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    max_listed: int = MAX_LISTED,
) -> DataFrame:
    """page_id, host, path, rule and verdict for each url.

    A rule fits its host and that host's subdomains if the path begins with the rule's; the longest
    key wins, and the longer host among equals.  rule is the key, like `net/`, or null; verdict is the rule's, or
    default.  Of two rules with one key block wins; repeated rules are one.  Null urls and urls without :// have empty
    host and path and fit no rule; urls and hosts of any length are read whole.  Repeated rows and null ids are
    kept; an empty table gives no rows; other columns are not read.  Ids must be numbers.

    More than max_listed rules are too many for constants of a plan: their keys are joined instead, with
    the same result.
    """
    if any(v not in ("allow", "block") or not h for v, h, _ in rules):
        raise ValueError("a rule is allow or block, a host and a path")
    spark: SparkSession = pages.sparkSession
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    keys = candidate_keys(F.col("host"), F.col("path"), lengths, max((h.count(".") + 1 for _, h, _ in rules), default=1))
    listed = spark.createDataFrame(sorted({(v, h + p) for v, h, p in rules}), "verdict string, key string")
    if len(rules) > max_listed:
        ruled = _joined(rows, keys, listed)
    else:
        universe = rows.select(F.explode(keys).alias("k")).select("k.key")
        n = universe.agg(F.approx_count_distinct("key")).first()[0]
        member = cascade(listed, universe, n, max_listed)
        blocked = cascade(listed.where("verdict = 'block'"), listed.where("verdict <> 'block'"), len(rules), max_listed)
        best = F.array_max(F.filter(keys, lambda k: member(k["key"])))
        ruled = rows.withColumn("rule", best["key"]).withColumn("own", F.when(blocked(F.col("rule")), "block").otherwise("allow"))
    verdict = F.when(F.col("rule").isNull(), default).otherwise(F.col("own"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: The rules above, the longest first, in plain SQL.
ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
