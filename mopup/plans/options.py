"""Cleaning options (the plain options dict, frozen) and recipe merging."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame

from ..functions.exprs import normalize_name


@dataclass(frozen=True)
class CleanOptions:
    """Options of :func:`mopup.plans.clean.clean`; names follow the options dict.

    Defaults are those of a direct library call ("everything on", fill missing
    values with mean / mode).  ``quantiles`` ("exact" | "approx") and ``stage``
    ("auto" | "checkpoint" | "none") are Spark-side knobs.  ``cell_updates`` and ``missing_cell_updates``
    are lists of edits or DataFrames of them.  ``audit`` says which changed cells are recorded:
    "cells" those of edits, trimming and fills, "all" also replaced placeholders, values that a conversion
    could not read, and clipped values.
    """
    remove_duplicates: bool = True
    duplicates_subset: tuple | None = None
    missing_strategy: str = "fill"
    fill_numeric: object = "mean"
    fill_categorical: str = "mode"
    drop_empty_columns: bool = True
    rename_columns: bool = True
    trim_whitespace: bool = True
    convert_dtypes: bool = True
    handle_outliers: dict | None = None
    encode_categoricals: object = False
    drop_constant_columns: bool = True
    column_renames: dict = field(default_factory=dict)
    cell_updates: tuple = ()
    missing_cell_updates: tuple = ()
    audit: str = "cells"
    drop_selected_columns: tuple = ()
    selected_outlier_rows: tuple = ()
    dtype_map: dict | None = None
    categorical_constant: str | None = None
    categorical_columns: tuple | None = None
    quantiles: str = "exact"
    stage: str = "auto"

    @classmethod
    def from_dict(cls, d: dict | None = None) -> "CleanOptions":
        d = dict(d or {})
        known = {f.name for f in fields(cls)}
        unknown = set(d) - known
        if unknown:
            raise ValueError(f"unknown option(s): {sorted(unknown)}")
        for k in ("cell_updates", "missing_cell_updates", "drop_selected_columns",
                  "selected_outlier_rows"):
            if k in d and d[k] is not None and not isinstance(d[k], DataFrame):
                d[k] = tuple(d[k])
        for k in ("duplicates_subset", "categorical_columns"):
            if d.get(k) is not None:
                d[k] = tuple(d[k])
        return cls(**d)

    def to_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_(self, **kw) -> "CleanOptions":
        return replace(self, **kw)


# Options an interactive session starts from: nothing applied, missing values ignored.
SCOPED_DEFAULTS = dict(
    remove_duplicates=False, drop_empty_columns=False, drop_constant_columns=False,
    trim_whitespace=False, convert_dtypes=False, rename_columns=True,
    handle_outliers=None, encode_categoricals=False, missing_strategy="ignore",
    fill_numeric="mean", fill_categorical="mode",
)


def merge_recipe(applied: list[dict], base: dict | None = None) -> CleanOptions:
    """Fold feature steps, in the order they were applied, into one option set.

    Later steps override earlier keys; list-valued edits accumulate.  A step that
    sets only the numeric fill implies text fill ``skip`` (and vice versa) unless
    already chosen, and either implies ``missing_strategy="fill"``.  A
    step that drops rows with gaps drops columns only where it says so itself.
    Column names in steps are normalised the way cleaning normalises them.
    """
    merged: dict = dict(SCOPED_DEFAULTS if base is None else base)
    for idx, raw in enumerate(applied):
        step = dict(raw)
        prior = set().union(*[set(s) for s in applied[:idx]]) if idx else set()
        for k in ("cell_updates", "missing_cell_updates"):
            if k in step:
                ups = [dict(u, column=normalize_name(u["column"])) for u in step.pop(k)]
                merged[k] = list(merged.get(k, [])) + ups
        if "drop_selected_columns" in step:
            merged["drop_selected_columns"] = list(dict.fromkeys(
                list(merged.get("drop_selected_columns", []))
                + [normalize_name(c) for c in step.pop("drop_selected_columns")]))
        if "column_renames" in step:
            ren = dict(merged.get("column_renames", {}))
            for o, n in step.pop("column_renames").items():
                o2, n2 = normalize_name(o), normalize_name(n)
                if n2 and n2 != o2:
                    ren[o2] = n2
            merged["column_renames"] = ren
        if "dtype_map" in step:
            dm = dict(merged.get("dtype_map") or {})
            for c, v in step.pop("dtype_map").items():
                if v and v != "auto":
                    dm[normalize_name(c)] = v
            merged["dtype_map"] = dm or None
        has_num, has_cat = "fill_numeric" in step, "fill_categorical" in step
        if has_num and not has_cat and "fill_categorical" not in prior:
            merged["fill_categorical"] = "skip"
        if has_cat and not has_num and "fill_numeric" not in prior:
            merged["fill_numeric"] = "skip"
        if (has_num or has_cat) and "missing_strategy" not in step:
            merged["missing_strategy"] = "fill"
        merged.update(step)
    return CleanOptions.from_dict(merged)
