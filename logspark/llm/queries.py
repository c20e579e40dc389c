"""The queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from .bpe import op6_bpe
from .html import op2_html
from .importance import op13_importance
from .media import op4_media
from .merkle import SQL as MERKLE_SQL
from .merkle import op12_merkle
from .mixing import op8_mixing
from .neardup import op7_neardup
from .neighbours import op1_neighbours
from .passages import op3_passages
from .pii import op10_pii
from .quality import op5_quality
from .suffix import op9_suffix
from .tokenfiles import op11_tokenfiles

QUERIES = {"op1_neighbours": op1_neighbours, "op2_html": op2_html, "op3_passages": op3_passages, "op4_media": op4_media, "op5_quality": op5_quality, "op6_bpe": op6_bpe, "op7_neardup": op7_neardup, "op8_mixing": op8_mixing, "op9_suffix": op9_suffix, "op10_pii": op10_pii,
           "op11_tokenfiles": op11_tokenfiles, "op12_merkle": op12_merkle, "op13_importance": op13_importance}
ORACLE_SQL: dict[str, str] = {"op12_merkle": MERKLE_SQL}
