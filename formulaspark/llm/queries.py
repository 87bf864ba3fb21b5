"""Queries of the training-data operators, by name, and their SQL where there is one."""

from __future__ import annotations

from . import centroids, divergence, windows
from .centroids import op11_centroids
from .decontaminate import op1_decontaminate
from .divergence import op13_divergence
from .jaccard import op10_jaccard
from .licenses import op5_licenses
from .neighbours import op8_neighbours
from .packing import op3_pack
from .quality import op4_quality
from .records import op7_token_records
from .secrets import op2_secrets
from .suffixes import op9_repeats
from .warc import op6_warc
from .windows import op12_windows

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_pack": op3_pack,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_token_records": op7_token_records,
    "op8_neighbours": op8_neighbours,
    "op9_repeats": op9_repeats,
    "op10_jaccard": op10_jaccard,
    "op11_centroids": op11_centroids,
    "op12_windows": op12_windows,
    "op13_divergence": op13_divergence,
}

#: The first ten cannot be stated in DuckDB SQL; tests hold them against brute force.
SQL: dict[str, str] = {"op11_centroids": centroids.SQL, "op12_windows": windows.SQL, "op13_divergence": divergence.SQL}
