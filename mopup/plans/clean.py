"""The cleaning plan: C1-C20 in order (C21), the summary (C22) and the audit
frames (A1, A2, A5), all as DataFrames.

Phases and barriers (what must be known before the plan can be built):

* A  C1-C6: narrow projections, no job.
* B  type decisions (C7/C8) and emptiness / constancy (C10/C11) — one fused
     aggregate over every form a column may take (raw, parsed number, parsed
     timestamp, explicit target); a second one only for an unforeseen chain.
* C  C12 dedupe: hash aggregate (partial aggregation map-side).
* D  C13 removal by key: hash-set filter.
* E  C14/C15 bounds: distributed exact quantiles (or approx).
* F  C16-C18: one gap-statistics aggregate shared by both fills, (column, value)
     counts for modes of the text columns that have gaps.
* G  C19: bounded dictionaries.

When E-G need several passes over the deduplicated table, it is staged once
(checkpoint to the cluster's checkpoint folder) so that later passes do not
re-run the scan and the dedupe shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..functions import exprs as X
from ..functions.exprs import col
from ..functions.frames import IN_LIST_MAX, agg_chunked, flag_ids, side_by_side, with_ids
from ..operators import outliers as O
from ..operators import transforms as TR
from ..operators.transforms import KEY
from .options import CleanOptions

LOG_SCHEMA = "seq int, action string, affected bigint, columns string, detail string, success boolean"
CHANGE_SCHEMA = "row_id bigint, column string, action string, old_value string, new_value string"
REMOVED_SCHEMA = "row_id bigint, action string, detail string"


# columns that a cleaning run carries along beside the table's own: the changes made to a row so far, and
# the numbers of its cells that C1 and C6 change
TRAIL, PLACEHOLDERS, TRIMMED = "__mopup_trail", "__mopup_placeholders", "__mopup_trimmed"
_HIDDEN = {TRAIL, PLACEHOLDERS, TRIMMED}


class Counts:
    """Row and cell counts of a run by name: known numbers, and aggregates over a frame still to be run.
    Those asked for together cost one pass over each frame."""

    def __init__(self, spark):
        self._spark, self._known, self._later = spark, {}, {}

    def know(self, name: str, value: int) -> None:
        self._known[name] = int(value or 0)

    def later(self, name: str, frame: DataFrame, aggregate) -> None:
        self._later[name] = (frame, aggregate)

    def row(self, names) -> DataFrame:
        """One row with these counts."""
        frames: dict[int, tuple[DataFrame, list]] = {}
        for n in dict.fromkeys(names):
            if n not in self._known:
                frame, aggregate = self._later[n]
                frames.setdefault(id(frame), (frame, []))[1].append(aggregate.cast("bigint").alias(n))
        known = [F.lit(self._known[n]).cast("bigint").alias(n) for n in dict.fromkeys(names) if n in self._known]
        parts = [agg_chunked(frame, aggs) for frame, aggs in frames.values()]
        if not parts:
            return self._spark.range(1).select(F.lit(1).alias("_one"), *known)
        return (parts[0] if len(parts) == 1 else side_by_side(*parts)).select("*", *known)


@dataclass
class _Entry:
    action: str
    affected: object = None          # a number, or the names of counts: the first less the others
    columns: list = field(default_factory=list)
    detail: object = None
    success: bool = True


@dataclass
class CleanResult:
    df: DataFrame
    entries: list
    changes: list
    removals: list
    report: dict
    counts: Counts
    _spark: object = None
    key: str = KEY

    # ---------------- A1
    @property
    def log(self) -> DataFrame:
        """The operations in order.  Counts that deciding the steps has not given yet cost one pass over the
        input, one over the deduplicated table, or both."""
        rows, needs = [], []
        for i, e in enumerate(self.entries):
            detail = e.detail if isinstance(e.detail, str) or e.detail is None else json.dumps(
                e.detail, sort_keys=True, default=str)
            affected = F.lit(None if e.affected is None else e.affected) if not isinstance(e.affected, tuple) else F.col(
                e.affected[0])
            for n in e.affected[1:] if isinstance(e.affected, tuple) else ():
                affected = affected - F.col(n)
            needs += e.affected if isinstance(e.affected, tuple) else ()
            rows.append(F.struct(
                F.lit(i + 1).alias("seq"), F.lit(e.action).alias("action"), affected.cast("bigint").alias("affected"),
                F.lit(",".join(e.columns)).alias("columns"), F.lit(detail).cast("string").alias("detail"),
                F.lit(e.success).alias("success")))
        if not rows:
            return self._spark.createDataFrame([], LOG_SCHEMA)
        return self.counts.row(needs).select(F.inline(F.array(*rows)))

    # ---------------- A2
    @property
    def changed_cells(self) -> DataFrame:
        """One row for each changed cell.  The changes of a row travel with it as an array, so there is one pass over
        the input and one over the deduplicated table."""
        out = self._spark.createDataFrame([], CHANGE_SCHEMA)
        for d in self.changes:
            out = out.unionByName(d)
        return out

    # ---------------- A5
    @property
    def removed_rows(self) -> DataFrame:
        out = self._spark.createDataFrame([], REMOVED_SCHEMA)
        for d in self.removals:
            d = d() if callable(d) else d
            out = out.unionByName(d.withColumnRenamed(self.key, "row_id")
                                  .select("row_id", "action", "detail"))
        return out

    def report_frames(self) -> dict:
        """The frames of a cleaning report (S9 writes them as JSON)."""
        return {"summary": self.summary, "operations": self.log, "changed_cells": self.changed_cells,
                "removed_rows": self.removed_rows}

    # ---------------- C22
    @property
    def summary(self) -> DataFrame:
        r = self.report
        k = self.key
        c = F.col
        one = self.counts.row(["rows", "deduped", "live", "after"])
        return one.select(
            c("rows").alias("rows_before"), c("after").alias("rows_after"),
            F.lit(r["original_cols"]).cast("bigint").alias("cols_before"),
            F.lit(len([x for x in self.df.columns if x != k])).cast("bigint").alias("cols_after"),
            (c("rows") - c("deduped")).alias("duplicates_removed"),
            (c("deduped") - c("live")).alias("outliers_removed"),
            F.lit(r["filled_cells"]).cast("bigint").alias("filled_cells"),
            F.lit(r["columns_renamed"]).cast("bigint").alias("columns_renamed"),
            F.lit(r["empty_columns_removed"]).cast("bigint").alias("empty_columns_removed"),
            F.lit(",".join(x for x in self.df.columns if x != k)).alias("cleaned_columns"))


def _number_form(target: T.DataType) -> str:
    """The form of ``candidate_forms`` that a numeric target takes."""
    return "int" if isinstance(target, T.LongType) else "num"


def _resolve(names, renamed: dict[str, str]):
    """Names given before renames follow the renames."""
    return [renamed.get(n, n) for n in names]


def _changed(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(key).cast("bigint").alias("row_id"), F.explode(col(TRAIL)).alias("_c")).select(
        "row_id", "_c.column", "_c.action", "_c.old_value", "_c.new_value")


def clean(df: DataFrame, options: CleanOptions | dict | None = None, key: str = KEY) -> CleanResult:
    opts = options if isinstance(options, CleanOptions) else CleanOptions.from_dict(options)
    spark = df.sparkSession
    entries: list[_Entry] = []
    changes: list[DataFrame] = []
    removals: list = []
    counts = Counts(spark)
    everything = opts.audit == "all"
    report: dict = {"original_cols": len(TR.data_columns(df, key))}

    # ---- C1
    ph = {c: X.placeholder_expr(c, "clean") for c in TR.text_columns(df, key)}
    w = df.select("*", X.sum_all([F.when(p, 1).otherwise(0) for p in ph.values()]).cast("bigint").alias(PLACEHOLDERS))
    if everything:
        w = TR.with_changes(w, TRAIL, [TR.change(c, "replace_placeholders", p, col(c), F.lit(None)) for c, p in ph.items()])
    w = TR.replace_placeholders(w, key, "clean")
    entries.append(_Entry("replace_placeholders", ("placeholders",), list(ph)))

    # ---- C2
    renamed: dict[str, str] = {}
    if opts.rename_columns:
        w, m = TR.normalize_columns(w, key)
        if m:
            renamed.update(m)
            entries.append(_Entry("rename_columns", len(m), list(m.values()), m))
    report["columns_renamed"] = len(renamed)

    # ---- C3 / C4
    for ups, action in ((opts.cell_updates, "manual_cell_updates"),
                        (opts.missing_cell_updates, "manual_missing_cell_updates")):
        if not isinstance(ups, DataFrame) and not ups:
            continue
        ce = TR.apply_cell_updates(w, ups if isinstance(ups, DataFrame) else list(ups), key, TRAIL, action)
        w = ce.df
        if ce.count:
            entries.append(_Entry(action, ce.count, ce.columns, {"retyped": ce.retyped}))

    # ---- C5
    manual: dict[str, str] = {}
    if opts.column_renames:
        w, manual = TR.rename_columns(w, dict(opts.column_renames), key)
        if manual:
            entries.append(_Entry("manual_column_renames", len(manual), list(manual.values()), manual))

    # ---- C6
    if opts.trim_whitespace:
        trimmed = TR.trim_changes(w, key)
        w = TR.with_changes(w.withColumn(TRIMMED, X.sum_all([F.when(x.isNotNull(), 1).otherwise(0) for x in trimmed]).cast("bigint")),
                            TRAIL, trimmed)
        w, tcols = TR.trim_whitespace(w, key)
        entries.append(_Entry("trim_whitespace", ("trimmed",), tcols))

    # ---- phase B: C7 / C8 / C9 / C10 / C11 — one fused aggregate decides them all
    dtype_map = {manual.get(c, c): v for c, v in (opts.dtype_map or {}).items()}
    fields = dict((f.name, f.dataType) for f in w.schema.fields if f.name != key and f.name not in _HIDDEN)
    text_cols = [c for c, t in fields.items() if X.is_text(t)]
    dates = {c: dtype_map.get(c, "auto") for c in text_cols
             if dtype_map and dtype_map.get(c, "auto") in ("auto", "datetime")}
    need_drop = opts.drop_empty_columns or opts.drop_constant_columns
    parsed_cols = text_cols if (opts.convert_dtypes or dtype_map) else []
    forms = TR.candidate_forms(fields, parsed_cols, dtype_map)
    totals = {"placeholders": F.sum(PLACEHOLDERS), **({"trimmed": F.sum(TRIMMED)} if TRIMMED in w.columns else {})}
    if need_drop or opts.convert_dtypes or dtype_map:
        fs = TR.form_stats(w, forms, fields, parsed_cols, dates, totals)
        counts.know("rows", fs["rows"])
        for name in totals:
            counts.know(name, fs["totals"][name])
    else:
        fs = {"columns": {}, "rows": None}
        for name, total in {"rows": F.count(F.lit(1)), **totals}.items():
            counts.later(name, w, F.coalesce(total, F.lit(0)))
    w = w.drop(PLACEHOLDERS, TRIMMED)
    st = fs["columns"]
    form_of = {c: "raw" for c in fields}
    new_cols: dict = {}
    categories: set = set()
    cur_type = dict(fields)
    c7_changes = []
    if opts.convert_dtypes:
        for c in text_cols:
            if TR.auto_numeric_decision(st[c]):
                nt = TR.numeric_target(st[c])
                new_cols[c] = TR.converted(col(c), fields[c], "numeric", nt)
                cur_type[c] = nt
                form_of[c] = _number_form(nt)
                c7_changes.append({"column": c, "new_dtype": nt.simpleString(), "reason": "numeric_conversion"})
        if c7_changes:
            entries.append(_Entry("convert_dtypes", len(c7_changes), [x["column"] for x in c7_changes],
                                  c7_changes))
    if dtype_map:
        meta = {}
        for c in fields:
            choice = dtype_map.get(c, "auto")
            t0 = cur_type[c]
            src = new_cols.get(c, col(c))
            info = {"from": t0.simpleString(), "requested": choice, "to": choice, "coerced": 0, "success": True}
            s = st.get(c)
            if choice == "auto":
                if X.is_numeric(t0) or X.is_temporal(t0) or isinstance(t0, T.BooleanType):
                    info["to"] = "numeric" if X.is_numeric(t0) else t0.simpleString()
                else:
                    dec = TR.convert_auto_decision(s) if s else "string"
                    info["to"] = dec
                    if dec == "numeric":
                        nt = TR.numeric_target(s)
                        new_cols[c] = TR.converted(src, t0, "numeric", nt)
                        cur_type[c] = nt
                        form_of[c] = _number_form(nt)
                        info["coerced"] = s["nonnull"] - s["num"]
                    elif dec == "datetime":
                        new_cols[c] = TR.converted(src, t0, "datetime", layouts=s["layouts"])
                        cur_type[c] = T.TimestampNTZType()
                        form_of[c] = "ts"
                        info["coerced"] = s["nonnull"] - s["ts"]
            elif choice in ("numeric", "datetime", "string", "category", "bool"):
                was_text = X.is_text(t0)
                nt = TR.numeric_target(s) if (was_text and s) else T.DoubleType()
                new_cols[c] = TR.converted(src, t0, choice, nt, s["layouts"] if was_text and s else None)
                on_raw = form_of[c] == "raw"
                if choice == "numeric":
                    cur_type[c] = t0 if X.is_numeric(t0) else nt
                    info["coerced"] = (s["nonnull"] - s["num"]) if (was_text and s) else 0
                    if on_raw and was_text:
                        form_of[c] = _number_form(nt)
                elif choice == "datetime":
                    cur_type[c] = T.TimestampNTZType()
                    info["coerced"] = (s["nonnull"] - s["ts"]) if (was_text and s) else None
                    form_of[c] = f"x:{choice}" if on_raw else None
                elif choice == "bool":
                    cur_type[c] = T.BooleanType()
                    info["coerced"] = (s["nonnull"] - s["bool"]) if (was_text and s) else None
                    form_of[c] = f"x:{choice}" if on_raw else None
                else:
                    cur_type[c] = T.StringType()
                    form_of[c] = "raw" if on_raw else None
                if choice == "category":
                    categories.add(c)
                    new_cols[c] = new_cols[c].alias(c, metadata={"logical": "category"})
            else:
                info.update({"success": False, "note": "unknown_choice"})
            info["actual"] = cur_type[c].simpleString()
            meta[c] = info
        entries.append(_Entry("manual_convert_dtypes", len(meta), list(meta), meta))
        failed = [c for c, m in meta.items() if not m["success"]]
        if failed:
            entries.append(_Entry("manual_convert_dtypes_failed", len(failed), failed,
                                  {c: meta[c]["note"] for c in failed}, success=False))
        # C8 report as a lazy aggregate over the table before conversion: values
        # present before and missing after each requested conversion
        pre = w
        rep = []
        for c, m in meta.items():
            conv = new_cols.get(c, col(c))
            rep.append(F.struct(F.lit(c).alias("column"), F.lit(m["from"]).alias("from_type"),
                                F.lit(m["requested"]).alias("requested"), F.lit(m["to"]).alias("to_type"),
                                (F.count(col(c)) - F.count(conv)).cast("bigint").alias("coerced"),
                                F.lit(bool(m["success"])).alias("success")))
        report["conversions"] = pre.agg(F.array(*rep).alias("_r")).select(F.inline("_r"))
    if new_cols:
        if everything:
            w = TR.with_changes(w, TRAIL, [
                TR.change(c, "convert_dtypes" if c in {x["column"] for x in c7_changes} else "manual_convert_dtypes",
                          col(c).isNotNull() & x.isNull(), col(c), F.lit(None)) for c, x in new_cols.items()])
        w = w.select(*[(new_cols[c] if c in categories else new_cols[c].alias(c)) if c in new_cols
                       else col(c) for c in w.columns])
    if TRAIL in w.columns:
        changes.append(_changed(w, key))
        w = w.drop(TRAIL)

    # ---- C9
    if opts.drop_selected_columns:
        w, dropped = TR.drop_columns(w, _resolve(opts.drop_selected_columns, manual), key)
        if dropped:
            entries.append(_Entry("drop_selected_columns", len(dropped), dropped))

    # ---- C10 / C11 (read off the fused aggregate; a second one only for a
    # conversion chain the first did not foresee)
    report["empty_columns_removed"] = 0
    if need_drop:
        live = [c for c in w.columns if c != key]
        known = {c: fs["forms"].get((c, form_of.get(c))) for c in live}
        unknown = [c for c in live if known[c] is None]
        if unknown:
            e2, k2 = TR.empty_and_constant(w.select(col(key), *[col(c) for c in unknown]), key)
            for c in unknown:
                known[c] = {"count": 0 if c in e2 else 1, "const": c in k2}
        empty = [c for c in live if known[c]["count"] == 0]
        const = [c for c in live if known[c]["count"] > 0 and known[c]["const"]]
        if opts.drop_empty_columns:
            if empty:
                w = w.drop(*empty)
                entries.append(_Entry("drop_empty_columns", len(empty), empty))
            report["empty_columns_removed"] = len(empty)
            report["empty_columns"] = empty
        if opts.drop_constant_columns:
            const = [c for c in const if c in w.columns]
            if const:
                w = w.drop(*const)
                entries.append(_Entry("drop_constant_columns", len(const), const))

    # ---- C12
    pre_dedupe = w
    if opts.remove_duplicates:
        subset = [c for c in _resolve(opts.duplicates_subset or [], manual) if c in w.columns] or None
        w = TR.dedupe(w, subset, key)
        # the list of removed rows is only made when it is asked for
        removals.append(lambda: TR.duplicate_removals(pre_dedupe, subset, key).select(
            col(key), F.lit("drop_duplicates").alias("action"),
            F.concat(F.lit("duplicate of "), F.col("duplicate_of").cast("string")).alias("detail")))
        entries.append(_Entry("drop_duplicates", ("rows", "deduped"), list(subset or []), {"subset": subset}))

    # ---- staging: later phases make several passes over w
    later_passes = (bool(opts.handle_outliers) + (opts.missing_strategy == "fill")
                    + (opts.encode_categoricals == "label"))
    how = opts.stage
    if how == "auto":
        how = "checkpoint" if later_passes >= 1 and opts.remove_duplicates else "none"
    w = session.stage(w, how)
    after_dedupe = w
    # which of its rows the later steps take out: counted together, in one pass over this table
    gone = F.lit(False)

    def lost(name: str, flag) -> None:
        """Count the rows of ``after_dedupe`` that ``flag`` takes out and no step before it did."""
        nonlocal gone
        counts.later(name, after_dedupe, F.count(F.when(flag & ~gone, 1)))
        gone = gone | flag

    # ---- C13
    if opts.selected_outlier_rows:
        ids = sorted({int(x) for x in opts.selected_outlier_rows})
        chosen = with_ids(w, ids, key)
        removals.append(chosen.select(col(key), F.lit("manual_outlier_removal").alias("action"),
                                      F.lit(None).cast("string").alias("detail")))
        w = TR.remove_rows(w, ids, key)
        if len(ids) <= IN_LIST_MAX:
            lost("manual", col(key).isin(ids))
        else:
            after_dedupe, flag = flag_ids(after_dedupe, ids, key)
            lost("manual", flag)
        entries.append(_Entry("manual_outlier_removal", ("manual",), [], {"selected_rows": ids}))

    # ---- C14 / C15
    ho = opts.handle_outliers
    if ho:
        method = ho.get("method", "iqr")
        action = ho.get("action", "remove")
        mult = float(ho.get("multiplier", 1.5))
        if method == "iqr" and action == "remove":
            w, removed, b = O.remove_outliers(w, mult, opts.quantiles, key)
            removals.append(removed.select(col(key), F.lit("outlier_removal").alias("action"),
                                           F.lit(None).cast("string").alias("detail")))
            lost("outliers", O.any_outlier(b))
            entries.append(_Entry("outlier_removal", ("outliers",), list(b), {"multiplier": mult}))
        elif method == "iqr" and action == "clip":
            w, b = O.clip_outliers(w, mult, opts.quantiles, key, TRAIL if everything else None)
            entries.append(_Entry("outlier_clip", None, list(b), {"multiplier": mult}))
    counts.later("live", after_dedupe, F.count(F.when(~gone, 1)))

    # ---- C16 - C18
    filled = 0
    if opts.missing_strategy == "drop":
        w = _snapshot(w, changes, key)
        removals.append(w.where(TR.missing_any(w, key)).select(
            col(key), F.lit("drop_missing_rows").alias("action"), TR.missing_list(w, key).alias("detail")))
        lost("missing", TR.missing_any(w, key))
        entries.append(_Entry("drop_missing_rows", ("missing",), []))
        w = TR.drop_missing_rows(w, key)
    elif opts.missing_strategy == "fill":
        num_filled = 0
        # one aggregate serves both fills: numeric filling only touches numeric
        # columns, so the text columns' gap counts stay valid after it
        gaps = TR.gap_stats(w.drop(TRAIL), key)
        counts.know("live", gaps["rows"])
        if not opts.selected_outlier_rows and not ho:
            counts.know("deduped", gaps["rows"])
        if opts.fill_numeric != "skip":
            w, details, skipped = TR.fill_numeric(w, opts.fill_numeric, opts.quantiles, key, gaps, TRAIL)
            for d in details:
                gaps["count"][d["column"]] = gaps["rows"]
            num_filled = sum(d["filled"] for d in details)
            entries.append(_Entry("fill_numeric", num_filled, [d["column"] for d in details],
                                  {"strategy": str(opts.fill_numeric), "skipped": skipped}))
        else:
            entries.append(_Entry("fill_numeric", 0, [], {"strategy": "skip"}))
        filled += num_filled
        if opts.fill_categorical != "skip":
            if opts.fill_categorical == "drop":
                w = _snapshot(w, changes, key)
            w, details, dropped = TR.fill_categorical(
                w, opts.fill_categorical, opts.categorical_constant,
                list(opts.categorical_columns) if opts.categorical_columns else None, key, gaps, TRAIL)
            cat_filled = sum(d["filled"] for d in details.values())
            filled += cat_filled
            det = {"strategy": opts.fill_categorical, "values": {c: d["value"] for c, d in details.items()}}
            aff = cat_filled
            if dropped is not None:
                removals.append(dropped.select(col(key), F.lit("fill_categorical_drop").alias("action"),
                                               F.lit(None).cast("string").alias("detail")))
                filled_already = set() if opts.fill_numeric == "skip" else {
                    c for c, n in gaps["count"].items() if n == gaps["rows"]}
                lost("dropped", X.any_of([col(c).isNull() for c in TR.categorical_columns(
                    w, opts.categorical_columns, key) if c not in filled_already]))
                aff = ("dropped",)
            entries.append(_Entry("fill_categorical", aff, list(details), det))
    else:
        entries.append(_Entry("skip_missing_values", 0, [], {"reason": "not selected"}))
    report["filled_cells"] = filled
    if TRAIL in w.columns:
        changes.append(_changed(w, key))
        w = w.drop(TRAIL)
    counts.later("deduped", after_dedupe, F.count(F.lit(1)))
    counts.later("after", after_dedupe, F.count(F.when(~gone, 1)))
    if opts.missing_strategy == "fill" and opts.fill_categorical != "drop":
        counts.know("after", gaps["rows"])

    # ---- C19
    if opts.encode_categoricals == "label":
        w, enc = TR.label_encode(w, key)
        if enc:
            entries.append(_Entry("label_encode", len(enc), enc))

    return CleanResult(w, entries, changes, removals, report, counts, spark, key)


def _snapshot(w: DataFrame, changes: list, key: str) -> DataFrame:
    """Hand over the changes so far, before a step takes rows out."""
    if TRAIL not in w.columns:
        return w
    changes.append(_changed(w, key))
    return w.drop(TRAIL)
