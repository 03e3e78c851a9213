"""Fixed schemas of all records."""

from pyspark.sql import types as T

S, A = T.StringType(), T.ArrayType


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONFIG = struct(lang_code=S, query_string=S)
PROFILE = struct(email=S, keywords_for_display=A(S), search_configs=A(CONFIG))
PUBLISHER = struct(title=S)
RAW_ARTICLE = T.StructType([T.StructField("title", S), T.StructField("url", S), T.StructField("description", S), T.StructField("published date", S), T.StructField("publisher", PUBLISHER)])
ENRICHED_ARTICLE = T.StructType([T.StructField("titulo", S), T.StructField("link", S), T.StructField("resumo", S), T.StructField("published date", S), T.StructField("publisher", PUBLISHER)])
EVENT = struct(principal=ENRICHED_ARTICLE, outros_sites=A(ENRICHED_ARTICLE))


def response(categories: str, languages: str) -> T.StructType:
    choices = struct(results=A(S))
    return struct(Author=struct(EMail=S), Modified=S, **{categories: choices, languages: choices})
