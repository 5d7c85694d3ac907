"""The registered queries of this folder and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import collocations, divergence, quality, suffix
from .collocations import op11_collocations
from .decontam import op4_decontamination
from .divergence import op12_divergence
from .html import op2_html
from .linededup import op3_line_dedup
from .lm import op1_lm
from .packing import op7_packing
from .patterns import op13_pattern_packing
from .pii import op9_pii
from .quality import op10_quality
from .repair import op5_repair
from .simhash import op6_simhash
from .suffix import op8_suffix

QUERIES = {
    "op1_lm": op1_lm,
    "op2_html": op2_html,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_repair": op5_repair,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_suffix": op8_suffix,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_divergence": op12_divergence,
    "op13_pattern_packing": op13_pattern_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op8_suffix": suffix.ORACLE,
    "op10_quality": quality.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
