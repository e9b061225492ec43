"""The record types of the pipeline's topics and tables, and helpers that fill them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.vector import AST_FEATURES


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,int>": T.MapType(T.StringType(), T.IntegerType()),
}


def _struct(fields: str) -> T.StructType:
    """A type from `name type, ...`; no session is needed."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in fields.split(", "))])


_COUNTS = "map<string,int>"

PAGE_STATS = _struct(
    "url string, when string, scripts string, n_hrefs int, n_hrefs_max_permitted int, n_external int, n_external_accepted int, "
    "n_internal int, n_internal_accepted int, n_scripts int, n_scripts_accepted int"
)
DOWNLOAD_FAILURE = _struct("reason string, url string, origin string, http_status int, when string")
JAVASCRIPT_LOCATION = _struct("country string, origin string, script string, when string, ip string")
DOWNLOAD_ARTEFACT = _struct("url string, origin string, host string, checksum string, path string, when string, js_id string, status string")
JAVASCRIPT_ARTEFACT = _struct("url string, sha256 string, md5 string, js_id string, inline boolean, content_type string, when string, size_bytes int, origin string")
CALLS_BY_COUNT = _struct("dollar int, createElement int, ajax int")
THUG_LOG = _struct("origin string, log string, user_agent string, scripts string, script_countries string, when string, thug_analysis_id string")
ANALYSIS = _struct(f"statements_by_count {_COUNTS}, calls_by_count {_COUNTS}, literals_by_count {_COUNTS}")
BEST_CONTROL = _struct(
    "control_url string, origin_url string, sha256_matched boolean, ast_dist double, function_dist double, diff_functions string, cited_on string, "
    "origin_js_id string, literal_dist double, xref string, literals_not_in_control int, literals_not_in_origin int, n_diff_literals int, diff_literals string"
)
_URL_FIELDS = "{0}_host string, {0}_has_query boolean, {0}_port int, {0}_scheme string, {0}_path string"
CONTROL_HIT = _struct(
    "control_url string, origin_url string, sha256_matched boolean, ast_dist double, function_dist double, diff_functions array<string>, cited_on string, "
    "origin_js_id string, literal_dist double, xref string, literals_not_in_control int, literals_not_in_origin int, n_diff_literals int, diff_literals string, "
    + _URL_FIELDS.format("origin") + ", " + _URL_FIELDS.format("cited_on") + ", control_family string"
)
FEATURE_VECTOR = T.StructType([*_struct("sha256 string, md5 string, size_bytes int, first_url string, n long").fields, *(T.StructField(x, T.IntegerType()) for x in AST_FEATURES)])
VECTOR_SUMMARY = _struct("origin string, sum_of_ast_features long, sum_of_functions long, last_updated string, sum_of_literals long")
CONTROL_PROBABILITY = _struct("control_url string, function_name string, sites array<string>, n_sites long, n_pages long, n_sites_subfamily long, n_pages_subfamily long")
SUBFAMILY_PROBABILITY = _struct("function_name string, subfamily string, n_sites long, n_pages long")
FUNCTION_PROBABILITY = _struct("control_family string, function_name string, sites array<string>, n_sites long, n_pages long")
JAVASCRIPT_CONTROL = _struct(
    "family string, origin string, do_not_load boolean, size_bytes int, variant string, release string, content_type string, provider string, subfamily string, "
    f"sha256 string, md5 string, statements_by_count {_COUNTS}, calls_by_count {_COUNTS}, literals_by_count {_COUNTS}"
)
URL = _struct("url_id string, url string, last_visited timestamp, origin string")
SCRIPT = _struct("js_id string, sha256 string, md5 string, size_bytes int, code binary")
SCRIPT_URL = _struct("url_id string, script string")


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The columns of schema in its order: missing ones null, others cast; nulls replaced by defaults; the rest dropped."""
    defaults, out = defaults or {}, []
    for field in schema.fields:
        c = F.col(f"`{field.name}`") if field.name in df.columns else F.lit(None)
        c = c.cast(field.dataType)
        out.append((F.coalesce(c, F.lit(defaults[field.name]).cast(field.dataType)) if field.name in defaults else c).alias(field.name))
    return df.select(out)
