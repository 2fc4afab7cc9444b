"""Column expressions over ``array<float>`` vectors and metadata maps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_GUARD = 1e-9  # FIXED VALUE: added to both norms in cosine similarity


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """V2: v / ||v|| (a zero vector stays zero)."""
    a = _col(a)
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine_guarded(a, b) -> Column:
    """V3: dot(a, b) / ((||a|| + 1e-9) * (||b|| + 1e-9))."""
    return dot(a, b) / ((norm(a) + F.lit(NORM_GUARD)) * (norm(b) + F.lit(NORM_GUARD)))


def cosine(a, b) -> Column:
    """1 - cosine distance (no guard); null when a norm is zero."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)


def has_dimension(a, dim: int) -> Column:
    """V4: the vector exists and has exactly ``dim`` components."""
    a = _col(a)
    return a.isNotNull() & (F.size(a) == F.lit(dim))


def metadata_contains(meta, flt: dict[str, str] | None) -> Column:
    """V6 (flat form): every key of ``flt`` is present in ``meta`` with the same value."""
    if not flt:
        return F.lit(True)
    meta = _col(meta)
    cond = F.lit(True)
    for k, v in flt.items():
        cond = cond & (meta.getItem(k) == F.lit(v))
    return F.coalesce(cond, F.lit(False))


def variant_contains(variant_col, flt: dict[str, object]) -> Column:
    """V6 (nested form): each dotted path of ``flt`` equals the value inside a
    VARIANT column (``parse_json`` of JSON metadata)."""
    v = _col(variant_col)
    cond = F.lit(True)
    for path, val in flt.items():
        typ = "bigint" if isinstance(val, int) and not isinstance(val, bool) else (
            "double" if isinstance(val, float) else ("boolean" if isinstance(val, bool) else "string"))
        cond = cond & (F.try_variant_get(v, "$." + path, typ) == F.lit(val))
    return F.coalesce(cond, F.lit(False))


def _member(key: str) -> str:
    """The path of a key, whatever characters it has but both kinds of quotes."""
    quote = '"' if "'" in key else "'"
    if quote in key:
        raise ValueError(f"a key with both kinds of quotes has no path: {key}")
    return f"$[{quote}{key}{quote}]"


def _is_scalar(v: Column, kind: Column, want) -> Column:
    if want is None:
        return kind == "VOID"
    if isinstance(want, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(want))
    if isinstance(want, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(want))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    exact = F.try_variant_get(v, "$", "decimal(38,12)") == F.lit(Decimal(str(want))).cast("decimal(38,12)")
    return number & F.coalesce(exact, F.try_variant_get(v, "$", "double") == F.lit(float(want)))


def _some(items: Column, want) -> Column:
    return F.exists(items, lambda x: json_contains(x, want, False))


def json_contains(variant_col, want, top: bool = True) -> Column:
    """V6: ``variant_col @> want`` for a VARIANT column and a Python value.  An object
    contains an object when it has each of its keys with a containing value; an array
    contains an array when each of its elements is contained in some element; scalars
    are equal by type and value (1 equals 1.0, never "1"); at the top an array also
    contains a scalar that is one of its elements."""
    v = _col(variant_col)
    kind = F.schema_of_variant(v)
    if isinstance(want, dict):
        cond = kind.startswith("OBJECT")
        for key, value in want.items():
            cond = cond & json_contains(F.try_variant_get(v, _member(key), "variant"), value, False)
    else:
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        if isinstance(want, (list, tuple)):
            cond = kind.startswith("ARRAY")
            for value in want:
                cond = cond & _some(items, value)
        else:
            cond = F.coalesce(_is_scalar(v, kind, want), F.lit(False))
            if top:
                cond = cond | F.coalesce(F.exists(items, lambda x: F.coalesce(_is_scalar(x, F.schema_of_variant(x), want), F.lit(False))), F.lit(False))
    return F.coalesce(cond, F.lit(False))
