"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .ann import op5_ann
from .balls import op11_balls
from .decontamination import op7_decontamination
from .html import op10_html
from .lines import op9_lines
from .minhash import op6_minhash
from .packing import op2_packing
from .quality import op4_quality
from .quotes import op8_quotes
from .repeats import op3_suffix_array
from .sharding import op1_sharding
from .toxicity import op12_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_suffix_array, op4_quality, op5_ann, op6_minhash, op7_decontamination, op8_quotes, op9_lines, op10_html, op11_balls, op12_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
