"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .fingerprints import op7_fingerprints
from .mixing import ORACLE_SQL as MIXING_SQL
from .mixing import op6_mixing
from .packing import op3_packing
from .pii import op1_pii
from .quality_model import op9_quality_model
from .quality_rules import ORACLE_SQL as RULES_SQL
from .quality_rules import op2_quality_rules
from .secrets import op8_secrets
from .simhash import op5_simhash
from .substrings import ORACLE_SQL as SUBSTRINGS_SQL
from .substrings import op4_substrings
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op10_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_substrings": op4_substrings,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_secrets": op8_secrets,
    "op9_quality_model": op9_quality_model,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": RULES_SQL,
    "op4_substrings": SUBSTRINGS_SQL,
    "op6_mixing": MIXING_SQL,
    "op10_warc": WARC_SQL,
}
