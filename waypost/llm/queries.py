"""The queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from . import chunks, conversations, decontaminate, mixing, quality, secret_scan, sharding, simhash, sstable, toxicity


def queries() -> dict[str, Callable]:
    return {"op1_sharding": sharding.op1_sharding, "op2_simhash": simhash.op2_simhash, "op3_chat": conversations.op3_chat, "op4_sstable": sstable.op4_sstable, "op5_secrets": secret_scan.op5_secrets, "op6_mixing": mixing.op6_mixing, "op7_quality": quality.op7_quality, "op8_toxicity": toxicity.op8_toxicity, "op9_decontamination": decontaminate.op9_decontamination, "op10_chunks": chunks.op10_chunks, "mixing_targets": mixing.mixing_targets, "quality_base": quality.quality_base}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": conversations.ORACLE, "op5_secrets": secret_scan.oracle(), "op9_decontamination": decontaminate.ORACLE, "mixing_targets": mixing.TARGETS_ORACLE, "quality_base": quality.BASE_ORACLE}
