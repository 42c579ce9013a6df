"""The queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import chat_format, clustering, decontam, neardup, quality_rules, secret_scan, spelling, url_filter, warc
from .chat_format import op5_chat_format
from .clustering import op11_centroid_clustering
from .decontam import op6_decontamination
from .deleted_interpolation import op13_lm_scoring
from .neardup import op3_minhash_neardup
from .packing import op2_packing
from .quality_rules import op7_quality_rules
from .secret_scan import op1_secret_scan
from .spelling import op12_spelling_variants
from .toxicity import op9_toxicity
from .url_filter import op4_url_filter
from .warc import op10_warc
from .word_model import op8_quality_classifier

QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_packing, op3_minhash_neardup, op4_url_filter, op5_chat_format, op6_decontamination, op7_quality_rules, op8_quality_classifier, op9_toxicity, op10_warc, op11_centroid_clustering, op12_spelling_variants, op13_lm_scoring)
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express; tests hold the others (op2, op8, op9, op13) against brute force. That of op1 has its trained model in it, and Spark trains that: it is there while a session is active."""
    spark = SparkSession.getActiveSession()
    running = spark is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped()
    own = {"op1_secret_scan": secret_scan.sql(secret_scan.default_model(spark))} if running else {}
    return own | {"op3_minhash_neardup": neardup.SQL, "op4_url_filter": url_filter.sql(), "op5_chat_format": chat_format.SQL, "op6_decontamination": decontam.SQL, "op7_quality_rules": quality_rules.SQL, "op10_warc": warc.SQL, "op11_centroid_clustering": clustering.sql(), "op12_spelling_variants": spelling.SQL}
