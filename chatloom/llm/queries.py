"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import ORACLE as CHAT_SQL
from .chat_format import op2_chat_windows
from .decontaminate import op9_decontaminate
from .jaccard_join import op10_jaccard_join
from .language_id import op3_language_id
from .lattice import op7_lattice_score
from .nearest import op1_multi_index_hashing
from .packing import op8_best_fit_packing
from .licenses import op4_license_scan
from .quality import op6_quality_classifier
from .warc import ORACLE as WARC_SQL
from .warc import op5_warc_from_arc

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_chat_windows": op2_chat_windows,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_warc_from_arc": op5_warc_from_arc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_lattice_score": op7_lattice_score,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_windows": CHAT_SQL, "op5_warc_from_arc": WARC_SQL}
