"""The engine's functions by name: detectors (text -> spans), predicates and
measures on columns. `call("fold", "name")` is the column; own functions can be
added. All are built from Spark's functions, so calls stay in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import text as t


def _detectors() -> dict[str, Callable]:
    from veilwork.operators import spans

    return dict(spans.DETECTORS)


def _measures() -> dict[str, Callable]:
    from veilwork.operators import fuzzy, names

    return {
        "letters_of": t.letters_of, "plain": t.plain, "squeeze": t.squeeze, "fold": t.fold, "word_count": t.word_count, "normalise_label": t.normalise_label, "token_kind": t.token_kind,
        "shape_relief": t.shape_relief, "phrase_parts": t.phrase_parts, "pdf_number": t.pdf_number, "pdf_string": t.pdf_string, "base64url": t.base64url, "line_pieces": names.pieces,
        "levenshtein": F.levenshtein, "osa_distance": lambda a, b: fuzzy.osa_udf()(a, b),
    }


def _predicates() -> dict[str, Callable]:
    from veilwork.operators import fuzzy, names

    return {
        "confusable": t.confusable, "fragment_of": t.fragment_of, "near": t.near, "host_contradicts": t.host_contradicts, "looks_like_name": t.looks_like_name,
        "fuzzy_part": t.fuzzy_part, "gap_ok": fuzzy.gap_ok, "is_name": names.is_name, "is_role_line": names.is_role_line,
    }


_OWN: dict[str, Callable] = {}


def functions() -> dict[str, Callable]:
    """All functions by name; those added later win."""
    return _detectors() | _measures() | _predicates() | _OWN


def add(name: str, function: Callable) -> None:
    """Adds a function of columns under a name, or puts it in the place of one."""
    _OWN[name] = function


def call(name: str, *args: Column | str) -> Column:
    """The column that a function makes of columns (or their names)."""
    known = functions()
    if name not in known:
        raise KeyError(f"no function {name!r}; there are {', '.join(sorted(known))}")
    return known[name](*[F.col(a) if isinstance(a, str) else a for a in args])
