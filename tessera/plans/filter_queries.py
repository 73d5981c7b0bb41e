"""One query per construct of the filter language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.catalogue import query
from tessera.plans.base import SQL, files
from tessera.plans.filters import find, where

#: name -> (filter, DuckDB condition)
CASES = {
    "filter_alias_compare": ("score > 40 AND exposure = public", "risk_score > 40 AND exposure_level = 'PUBLIC'"),
    "filter_not_equal": ("tier != minimal and name != '1.txt'", "risk_tier <> 'MINIMAL' AND upper(file_name) <> '1.TXT'"),
    "filter_null_not_equal": ("nothing != 5 AND score >= 80", "risk_score >= 80"),
    "filter_lexicographic_tier": ("tier > HIGH", "risk_tier > 'HIGH'"),
    "filter_regex": (r"path ~ '^/src1/.*1\\.txt$'", r"regexp_matches(upper(file_path), '^/SRC1/.*1\.TXT$')"),
    "filter_regex_upper_trap": (r"path ~ '\\d'", r"regexp_matches(upper(file_path), '\D')"),
    "filter_contains": ("path contains 'SRC7/FR'", "contains(lower(file_path), 'src7/fr')"),
    "filter_has": ("has(EMAIL) OR has(credit_card)", "n_email > 0 OR n_card > 0"),
    "filter_count": ("count(ip_address) >= 2", "n_ip >= 2"),
    "filter_missing": ("missing(entity_counts) AND path contains src3", "total_entities = 0 AND contains(lower(file_path), 'src3')"),
    "filter_not_precedence": ("NOT has(EMAIL) AND has(PHONE) OR score >= 90", "((NOT n_email > 0) AND n_phone > 0) OR risk_score >= 90"),
    "filter_parentheses": ("NOT (has(EMAIL) OR has(PHONE)) AND has(IP_ADDRESS)", "NOT (n_email > 0 OR n_phone > 0) AND n_ip > 0"),
}


def _case(name: str, text: str, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return where(files(spark, sf_dir), text).select("doc_id", "risk_score")

    f.__name__ = name
    query(name, SQL + f"SELECT doc_id, risk_score FROM files WHERE {sql}")(f)


for _n, (_t, _s) in CASES.items():
    _case(_n, _t, _s)


@query("filter_find", SQL + "SELECT file_path, risk_score FROM files WHERE total_entities > 0 AND n_email > 0 ORDER BY risk_score DESC, file_path LIMIT 7")
def filter_find(spark, sf_dir):
    return find(files(spark, sf_dir), "total > 0 AND has(email)", sort="score", limit=7).select("file_path", "risk_score")
