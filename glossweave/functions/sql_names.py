"""The scalar functions under SQL names, as temporary SQL functions.

Their bodies are the Column expressions of this package, written as SQL, so they
run in the JVM and are inlined by the optimizer. Functions that need a lambda
have no name here, as a lambda has no SQL text of its own; escaping has a body
without one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import scripts as S
from . import text as X
from .collation import builtin_collation, collation_key

# Name, parameters (all strings), body.
FUNCTIONS: Mapping[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "gw_strip": (("text",), X.strip),
    "gw_html_escape": (("text",), X.html_escape_plain),
    "gw_headword": (("word",), X.headword),
    "gw_dsl_quote": (("text",), X.dsl_quote),
    "gw_capitalize": (("text",), X.capitalize),
    "gw_contains_ci": (("text", "part"), X.contains_ci),
    "gw_language_name": (("code",), X.language_name),
    "gw_dictionary_name": (("name", "source", "target", "entry"), X.dictionary_name),
    "gw_stem": (("name",), S.stem),
    "gw_alphanumeric": (("text",), S.alphanumeric),
    "gw_is_page_name": (("name",), S.is_page_name),
    "gw_latin_key": (("word",), lambda word: collation_key(word, builtin_collation("eng"))),
    "gw_cyrillic_key": (("word",), lambda word: collation_key(word, builtin_collation("rus"))),
    **{f"gw_is_{name}": (("ch",), lambda ch, name=name: S.is_in_script(ch, name)) for name in S.SCRIPT_NAMES},
}


def sql_body(spark: SparkSession, parameters: tuple[str, ...], body: Callable[..., Column]) -> tuple[str, str]:
    """SQL text and type of a Column expression over parameters."""
    typed = spark.range(0).select(*[F.lit("").alias(p) for p in parameters])
    frame = typed.select(body(*map(F.col, parameters)).alias("value"))
    plan = frame._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql(), frame.dtypes[0][1]


def register_functions(spark: SparkSession) -> list[str]:
    """Create all functions in the session; gives their names."""
    for name, (parameters, body) in FUNCTIONS.items():
        text, kind = sql_body(spark, parameters, body)
        declared = ", ".join(f"`{p}` STRING" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {kind} RETURN {text}")
    return list(FUNCTIONS)
