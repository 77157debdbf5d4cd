"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, repeats, secrets
from .chat import op2_chat
from .decontaminate import op5_decontamination
from .language_model import op10_language_model
from .mixing import op9_mixing
from .quality import op8_quality
from .repeats import op7_repeats
from .secrets import op4_secrets
from .simhash import op1_simhash
from .toxicity import op6_toxicity
from .vptree import op3_neighbours

QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat, op3_neighbours, op4_secrets, op5_decontamination, op6_toxicity, op7_repeats, op8_quality, op9_mixing, op10_language_model)}
ORACLE_SQL: dict[str, str] = {"op2_chat": chat.ORACLE, "op4_secrets": secrets.ORACLE, "op7_repeats": repeats.ORACLE}
