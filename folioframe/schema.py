"""Schemas of the document tables and the codes of directions and corrections."""

from __future__ import annotations

from pyspark.sql import types as T

#: Key columns of a page; every operator is keyed by them.
KEYS = ("doc_id", "page_num")
HORIZONTAL, VERTICAL = "h", "v"
ROTATION, SKEW_X, SKEW_Y = "r", "sx", "sy"


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
PAGES = _schema(("doc_id", _S), ("page_num", _I), ("page_seq", _I), ("image", _S), ("width", _I), ("height", _I))
BOXES = _schema(
    ("doc_id", _S), ("page_num", _I), ("box_seq", _I), ("left", _D), ("top", _D), ("width", _D), ("height", _D),
    ("right", _D), ("bottom", _D), ("value", _S), ("font", _S),
)
LINES = _schema(("doc_id", _S), ("page_num", _I), ("line_seq", _I), ("rho", _D), ("theta", _D), ("theta_norm", _D), ("dir", _S))
POSITIONS = _schema(("doc_id", _S), ("page_num", _I), ("axis", _S), ("pos_idx", _I), ("pos", _D))
GRID_CELLS = _schema(("doc_id", _S), ("page_num", _I), ("row_idx", _I), ("col_idx", _I), ("l", _D), ("t", _D), ("r", _D), ("b", _D))


def check_direction(direction: str) -> str:
    if direction not in (HORIZONTAL, VERTICAL):
        raise ValueError("direction must be 'h' or 'v'")
    return direction


def borders(direction: str) -> tuple[str, str, str]:
    """(low edge, high edge, extent) of boxes along the axis of positions."""
    return ("top", "bottom", "height") if check_direction(direction) == VERTICAL else ("left", "right", "width")
