"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import op4_bpe
from tessera.llm.codes import OP12_SQL, op12_codes
from tessera.llm.decontaminate import op2_decontaminate
from tessera.llm.html import op8_html
from tessera.llm.katz import op13_katz
from tessera.llm.langid import op6_langid
from tessera.llm.matroska import op7_matroska
from tessera.llm.minhash import op10_minhash
from tessera.llm.pii import op1_pii
from tessera.llm.quality import op3_quality
from tessera.llm.search import OP11_SQL, op11_search
from tessera.llm.secrets import op9_secrets
from tessera.llm.suffix import op5_suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_decontaminate": op2_decontaminate,
        "op3_quality": op3_quality,
        "op4_bpe": op4_bpe,
        "op5_suffix": op5_suffix,
        "op6_langid": op6_langid,
        "op7_matroska": op7_matroska,
        "op8_html": op8_html,
        "op9_secrets": op9_secrets,
        "op10_minhash": op10_minhash,
        "op11_search": op11_search,
        "op12_codes": op12_codes,
        "op13_katz": op13_katz,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_search": OP11_SQL, "op12_codes": OP12_SQL}
