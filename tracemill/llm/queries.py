"""The training-data queries, one per operator, over whole tables."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat
from .decontaminate import OP8_SQL, op8_decontaminate
from .media import op4_media
from .packing import op1_packing
from .pii import op7_pii
from .quality import op2_quality
from .secret_scan import op5_secret_scan
from .sharding import op6_sharding
from .simhash import op9_simhash
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_chat, op4_media, op5_secret_scan, op6_sharding, op7_pii, op8_decontaminate, op9_simhash, op10_toxicity)}
ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op8_decontaminate": OP8_SQL}
