"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from ..session import bounded_batches, table
from . import chat, fixity
from .decontaminate import contaminated
from .html_text import extract
from .matroska import media_digest
from .packing import pack_documents
from .quality import quality_report
from .secrets import secret_report
from .simhash import simhash_components
from .toxicity import toxicity


def op1_chat_formatting(spark, sf_dir):
    return chat.formatted_conversations(table(spark, sf_dir, "conversations"))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


def op7_warc_fixity(spark, sf_dir):
    return fixity.fixity_report(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media_columns(spark, sf_dir):
    return media_digest(table(spark, sf_dir, "documents"))




def _bounded(query):
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _bounded(f)
    for f in (
        op1_chat_formatting,
        op2_simhash_near_dedup,
        op3_packing,
        op4_toxicity,
        op5_quality,
        op6_secret_scan,
        op7_warc_fixity,
        op8_html_extraction,
        op9_decontamination,
        op10_media_columns,
    )
}

ORACLE: dict[str, str] = {"op1_chat_formatting": chat.ORACLE_SQL, "op7_warc_fixity": fixity.ORACLE_SQL}
