"""Queries of the corpus operators, each over its whole table, and their DuckDB equivalents where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, embeddings, jaccard, substrings
from .chat import op4_chat
from .decontamination import op6_decontamination
from .embeddings import op5_embeddings
from .jaccard import op8_jaccard
from .lines import op9_lines
from .packing import op7_packing
from .passages import op10_passages
from .secrets import op1_secrets
from .substrings import op2_substrings
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_substrings": op2_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_embeddings": op5_embeddings,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_jaccard": op8_jaccard,
    "op9_lines": op9_lines,
    "op10_passages": op10_passages,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substrings": substrings.ORACLE_SQL,
    "op4_chat": chat.ORACLE_SQL,
    "op5_embeddings": embeddings.ORACLE_SQL,
    "op6_decontamination": decontamination.ORACLE_SQL,
    "op8_jaccard": jaccard.ORACLE_SQL,
}
