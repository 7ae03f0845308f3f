"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import oracles
from .ann import op9_ann
from .mixing import op8_mixing
from .near_dedup import op6_near_dedup
from .pieces import op1_pieces
from .pivots import op13_pivots
from .ppm import op2_ppm
from .quality import op4_quality
from .sharding import SHARD_SQL, op7_sharding
from .template import op5_template
from .token_files import op3_token_files
from .tput import TPUT_SQL, op11_tput
from .warc import op10_warc
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_pieces, op2_ppm, op3_token_files, op4_quality, op5_template, op6_near_dedup, op7_sharding, op8_mixing, op9_ann, op10_warc, op11_tput, op12_whitening, op13_pivots)}
ORACLES = {"op4_quality": oracles.QUALITY_SQL, "op6_near_dedup": oracles.NEAR_SQL, "op7_sharding": SHARD_SQL, "op10_warc": oracles.WARC_SQL, "op11_tput": TPUT_SQL}
