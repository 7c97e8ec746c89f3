"""DuckDB SQL oracles for the catalogue queries (same names as ``catalog.QUERIES``).

Each text is independent SQL over the pre-registered base tables: the dirty
views are CTEs, and every cleaning step is written out as plain SQL.  Where
the Spark side makes a data-dependent schema decision (which columns convert,
which are empty or constant), the SQL states the outcome for the fixture as a
fixed choice — SQL cannot change a column's type by data — and the decision
itself is checked by the values that follow from it.

Numeric rounding goes through DECIMAL so that both engines round the decimal
text half-up.
"""

from __future__ import annotations

from ..functions import tokens
from ..functions.exprs import TIMESTAMP_FORMATS, normalize_name
from .catalog import CELL_EDITS, CHANGED_CELLS_OPTS, DROP_COLS, MISSING_EDITS, REMOVE_IDS, SEARCH
from .fixtures import view_sql

NUM_RE = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
THOUSANDS_RE = r"-?\d{1,3}(\.\d{3})+(\.\d+)?"

_JAVA_TO_STRPTIME = {
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S",
    "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M",
    "yyyy-MM-dd": "%Y-%m-%d",
    "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S",
    "yyyy-MM-dd'T'HH:mm": "%Y-%m-%dT%H:%M",
    "MM/dd/yyyy HH:mm:ss": "%m/%d/%Y %H:%M:%S",
    "MM/dd/yyyy": "%m/%d/%Y",
    "yyyy/MM/dd": "%Y/%m/%d",
    "dd-MMM-yyyy": "%d-%b-%Y",
}


# ------------------------------------------------------------------ SQL helpers
def qi(n: str) -> str:
    return '"' + n.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(vals) -> str:
    return ", ".join(lit(v) for v in vals)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _ph_cs(x: str, vocab) -> str:
    s = strip(x)
    return f"({x} is not null and ({s} in ({inlist(vocab)}) or starts_with({s}, '###')))"


def c1(x: str, vocab=tokens.PH_CLEAN) -> str:
    return f"case when {_ph_cs(x, vocab)} then null else {x} end"


def ph_score(x: str, text: bool = True) -> str:
    t = x if text else f"cast({x} as varchar)"
    s = f"lower({strip(t)})"
    return f"({x} is null or {s} in ({inlist(tokens.PH_SCORE)}) or regexp_full_match({s}, '#+'))"


def parse_num(x: str) -> str:
    s = strip(x)
    return f"(case when regexp_full_match({s}, '{NUM_RE}') then try_cast({s} as double) end)"


def parse_ts(x: str) -> str:
    s = strip(x)
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{_JAVA_TO_STRPTIME[f]}')"
                                   for f, _ in TIMESTAMP_FORMATS) + ")"


def to_bool(x: str) -> str:
    return (f"(case when {x} in ({inlist(tokens.BOOL_TRUE)}) then true "
            f"when {x} in ({inlist(tokens.BOOL_FALSE)}) then false end)")


def coerce_like(x: str) -> str:
    t = f"regexp_replace(lower({strip(x)}), '[$€£₹,\\s]', '', 'g')"
    t2 = f"(case when regexp_full_match({t}, '{THOUSANDS_RE}') then replace({t}, '.', '') else {t} end)"
    return f"(case when regexp_full_match({t2}, '{NUM_RE}') then try_cast({t2} as double) end)"


def rnd(x: str, d: int) -> str:
    return f"cast(round(cast(({x}) as decimal(38,10)), {d}) as double)"


def cif(pred: str) -> str:
    return f"cast(count_if({pred}) as bigint)"


def with_views(names, *ctes, body: str) -> str:
    parts = [f"{n} as ({view_sql(n, 'duckdb')})" for n in names]
    parts += [f"{n} as ({s})" for n, s in ctes]
    return "with " + ",\n".join(parts) + "\n" + body.strip()


def mode_of(src: str, x: str) -> str:
    return (f"(select {x} from {src} where {x} is not null group by {x} "
            f"order by count(*) desc, {x} asc limit 1)")


# ------------------------------------------------------------------ fixtures' columns
CUST = [("Name", "t"), ("Mkt Segment", "t"), ("acctbal", "n"), ("nation_txt", "t"), ("notes", "t"),
        ("origin", "t"), ("Unnamed: 7", "t"), ("Unnamed: 8", "t")]
CUST_TEXT = [n for n, k in CUST if k == "t"]
ODUP = ["cust_bucket", "o_orderstatus", "o_orderpriority"]
EVG = [("user_id", "n"), ("event_type", "t"), ("value", "n"), ("ts", "o")]
DOCL = [("lang", "t"), ("source", "t"), ("n_chars", "n"), ("quality", "n"), ("toxic", "n")]


def sel(cols, f=lambda n, k: qi(n), rename=lambda n: n) -> str:
    return ", ".join(f"{f(n, k)} as {qi(rename(n))}" for n, k in cols)


def c1_cols(cols, vocab=tokens.PH_CLEAN):
    return lambda n, k: c1(qi(n), vocab) if k == "t" else qi(n)


# customer_dirty after C1 (names kept) and after C1 + C2 (names normalised)
CUST_C1 = f"select row_id, {sel(CUST, c1_cols(CUST))} from customer_dirty"
CUST_C1N = f"select row_id, {sel(CUST, c1_cols(CUST), normalize_name)} from customer_dirty"
CUSTN = [(normalize_name(n), k) for n, k in CUST]


def _null_long(src: str, cols, extra: str = "") -> str:
    """(position, column, missing, rows) in long form."""
    parts = []
    for i, (n, _) in enumerate(cols):
        parts.append(f"select {i} as position, {lit(n)} as {qi('column')}, "
                     f"{cif(qi(n) + ' is null')} as missing, cast(count(*) as bigint) as rows from {src}")
    return " union all ".join(parts)


# ------------------------------------------------------------------ score
def score_sql(src: str, cols) -> str:
    """Components D1-D10 over relation ``src`` with columns [(name, kind)]:
    kind t = text, n = numeric, o = other."""
    n_cols = len(cols)
    aggs = ["count(*) as _rows"]
    for i, (n, k) in enumerate(cols):
        x = qi(n)
        aggs += [f"count_if({x} is null) as m{i}", f"count_if({ph_score(x, k == 't')}) as p{i}",
                 f"coalesce(count({x}) > 0 and min({x}) = max({x}), false) as k{i}"]
        if k == "t":
            ok = f"not {ph_score(x)}"
            s = strip(x)
            aggs += [f"count_if({ok}) as np{i}",
                     f"count_if({ok} and regexp_matches({s}, '[0-9]')) as dg{i}",
                     f"count_if({ok} and regexp_matches({s}, '[A-Za-z]')) as al{i}",
                     f"count_if({ok} and regexp_matches({s}, '[0-9]') and {coerce_like(x)} is null) as is{i}"]
        if k == "n":
            aggs += [f"count({x}) as n{i}", f"quantile_cont({x}, 0.25) as q1_{i}",
                     f"quantile_cont({x}, 0.75) as q3_{i}"]
    share = " + ".join(f"cast({ph_score(qi(n), k == 't')} as int)" for n, k in cols)
    aggs.append(f"count_if(({share}) / {float(n_cols)} >= {tokens.ROW_PLACEHOLDER_SHARE}) as _rowph")
    nums = [(i, n) for i, (n, k) in enumerate(cols) if k == "n"]
    outs = []
    for i, n in nums:
        x = qi(n)
        lo = f"(a.q1_{i} - 1.5 * (a.q3_{i} - a.q1_{i}))"
        hi = f"(a.q3_{i} + 1.5 * (a.q3_{i} - a.q1_{i}))"
        outs.append(f"case when max(a.n{i}) > 2 then count_if(s.{x} < {lo} or s.{x} > {hi}) else 0 end as o{i}")
    ocols = ", ".join(outs) if outs else "0 as _none"
    group = ", ".join(qi(n) for n, _ in cols)

    def pct(num, den):
        return f"(case when ({den}) > 0 then ({num}) * 100.0 / ({den}) else 0.0 end)"

    from ..operators.quality import name_is_numeric_hint
    cells = f"(a._rows * {float(n_cols)})"
    missing = pct(" + ".join(f"a.m{i}" for i in range(n_cols)), cells)
    placeholder = pct(" + ".join(f"a.p{i}" for i in range(n_cols)), cells)
    const = pct(" + ".join(f"cast(a.k{i} as int)" for i in range(n_cols)), str(float(n_cols)))
    iss = []
    for i, (n, k) in enumerate(cols):
        if k != "t":
            continue
        cand = "true" if name_is_numeric_hint(n) else (
            f"(a.np{i} >= {tokens.CANDIDATE_MIN_VALUES} and a.dg{i} / a.np{i} >= {tokens.CANDIDATE_DIGIT_RATIO}"
            f" and a.al{i} / a.np{i} <= {tokens.CANDIDATE_ALPHA_RATIO})")
        iss.append(f"(case when {cand} then a.is{i} else 0 end)")
    issues = pct(" + ".join(iss) if iss else "0", cells)
    dup = pct("(a._rows - d._distinct)", "a._rows")
    rowph = pct("a._rowph", "a._rows")
    outl = pct(" + ".join(f"o.o{i}" for i, _ in nums) if nums else "0", f"(a._rows * {float(len(nums))})")
    w = tokens.SCORE_WEIGHTS
    raw = (f"100 - ({w['missing_pct']} * {missing} + {w['placeholder_pct']} * {placeholder} + "
           f"{w['dup_pct']} * {dup} + {w['numeric_issue_pct']} * {issues} + "
           f"{w['row_placeholder_pct']} * {rowph} + {w['outlier_pct']} * {outl} + "
           f"{w['const_col_pct']} * {const})")
    return f"""
select cast(a._rows as bigint) as n_rows, cast({n_cols} as bigint) as n_cols,
  {rnd(missing, 4)} as missing_pct, {rnd(dup, 4)} as dup_pct, {rnd(const, 4)} as const_col_pct,
  {rnd(placeholder, 4)} as placeholder_pct, {rnd(issues, 4)} as numeric_issue_pct,
  {rnd(rowph, 4)} as row_placeholder_pct, {rnd(outl, 4)} as outlier_pct,
  case when a._rows = 0 then 0.0 else {rnd(f'greatest(0.0, least(100.0, {raw}))', 2)} end as score
from (select {', '.join(aggs)} from {src}) a,
     (select count(*) as _distinct from (select distinct {group} from {src})) d,
     (select {ocols} from {src} s, (select {', '.join(aggs)} from {src}) a) o
"""


# ------------------------------------------------------------------ customer_dirty
def _cust(body, *ctes):
    return with_views(["customer_dirty"], *ctes, body=body)


def _edits(col_sql: str, edits, typ: str):
    whens = " ".join(f"when row_id = {e['row_index']} then "
                     f"{'null' if str(e['value']).strip() == '' else (str(float(e['value'])) if typ == 'n' else lit(str(e['value'])))}"
                     for e in edits)
    return f"case {whens} else {col_sql} end"


def _clean_default_cust(cell_updates=None, fill="mean"):
    """CTE list for customer_dirty cleaned with the default options
    (+ optional acctbal cell updates, numeric fill strategy)."""
    c1n = CUST_C1N
    if cell_updates:
        cols = []
        for n, k in CUSTN:
            x = qi(n)
            ed = [e for e in cell_updates if e["column"] == n]
            cols.append(f"{_edits(x, ed, k) if ed else x} as {x}")
        s1 = f"select row_id, {', '.join(cols)} from c1n"
    else:
        s1 = "select * from c1n"
    s2 = "select row_id, " + ", ".join(
        (f"{strip(qi(n))} as {qi(n)}" if k == "t" else qi(n)) for n, k in CUSTN) + " from s1"
    # C7 converts nation_txt and unnamed:_7; C10 drops notes, unnamed:_8; C11 drops origin
    s3 = (f"select row_id, name, mkt_segment, acctbal, {parse_num('nation_txt')} as nation_txt, "
          f"{parse_num(qi('unnamed:_7'))} as {qi('unnamed:_7')} from s2")
    if fill == "mean":
        fv = {c: f"(select avg({qi(c)}) from s3)" for c in ("acctbal", "nation_txt", "unnamed:_7")}
    else:
        fv = {c: "0.0" for c in ("acctbal", "nation_txt", "unnamed:_7")}
    s4 = (f"select row_id, name, coalesce(mkt_segment, {mode_of('s3', 'mkt_segment')}) as mkt_segment, "
          + ", ".join(f"coalesce({qi(c)}, {fv[c]}) as {qi(c)}" for c in ("acctbal", "nation_txt", "unnamed:_7"))
          + " from s3")
    return [("c1n", c1n), ("s1", s1), ("s2", s2), ("s3", s3), ("s4", s4)]


CUST_CLEANED = [("name", "t"), ("mkt_segment", "t"), ("acctbal", "n"), ("nation_txt", "n"), ("unnamed:_7", "n")]


def _cust_oracles() -> dict:
    o = {}
    o["replace_placeholders"] = _cust(CUST_C1)
    o["normalize_columns"] = _cust(f"select row_id, {sel(CUST, rename=normalize_name)} from customer_dirty")
    o["rename_columns"] = _cust(
        f"select row_id, {sel(CUST, rename=lambda n: 'balance' if n == 'acctbal' else n)} from customer_dirty")
    o["trim_whitespace"] = _cust(
        f"select row_id, {sel(CUST, lambda n, k: strip(c1(qi(n))) if k == 't' else qi(n))} from customer_dirty")
    o["auto_numeric"] = _cust(
        f"select row_id, {sel(CUST, lambda n, k: parse_num(qi(n)) if n in ('nation_txt', 'Unnamed: 7') else qi(n))}"
        f" from c1", ("c1", CUST_C1))
    o["drop_columns"] = _cust(
        f"select row_id, {sel([c for c in CUST if c[0] not in DROP_COLS])} from customer_dirty")
    o["drop_empty_columns"] = _cust(
        f"select row_id, {sel([c for c in CUST if c[0] not in ('notes', 'Unnamed: 8')])} from c1", ("c1", CUST_C1))
    o["drop_constant_columns"] = _cust(
        f"select row_id, {sel([c for c in CUST if c[0] != 'origin'])} from c1", ("c1", CUST_C1))
    fills = {"mean": "(select avg(acctbal) from c1)", "median": "(select quantile_cont(acctbal, 0.5) from c1)",
             "zero": "0.0", "constant": "123.5"}
    for k, v in fills.items():
        o[f"fill_numeric_{k}"] = _cust(
            f"select row_id, {sel(CUST, lambda n, kk: rnd(f'coalesce(acctbal, {v})', 4) if n == 'acctbal' else qi(n))}"
            f" from c1", ("c1", CUST_C1))
    # label encoding: every text column but Name (1500 distinct > 1000 classes)
    enc = [n for n in CUST_TEXT if n != "Name"]
    dicts = [(f"d{i}", f"select v, row_number() over (order by v) - 1 as code from "
                       f"(select distinct coalesce({qi(n)}, 'nan') as v from c1)") for i, n in enumerate(enc)]

    def enc_col(n, k):
        if n in enc:
            i = enc.index(n)
            return f"(select code from d{i} where d{i}.v = coalesce(c1.{qi(n)}, 'nan'))"
        return f"c1.{qi(n)}"
    o["label_encode"] = _cust(f"select row_id, {sel(CUST, enc_col)} from c1", ("c1", CUST_C1), *dicts)

    an = f"select row_id, {sel(CUST, c1_cols(CUST, tokens.PH_ANALYZE))} from customer_dirty"
    nulls = " + ".join(f"count_if({qi(n)} is null)" for n, _ in CUST)
    distinct = f"(select count(*) from (select distinct {', '.join(qi(n) for n, _ in CUST)} from a))"
    o["profile_summary"] = _cust(f"""
select cast(count(*) as bigint) as rows, cast({len(CUST)} as bigint) as cols,
  cast({nulls} as bigint) as missing_count,
  case when count(*) = 0 then 0.0 else {rnd(f'({nulls}) * 100.0 / (count(*) * {len(CUST)})', 2)} end
    as missing_percent,
  cast(count(*) - {distinct} as bigint) as duplicate_count
from a""", ("a", an))
    dtype = {"t": "string", "n": "double"}
    lg = _null_long("a", CUST)
    o["profile_columns"] = _cust(f"""
select position, l.{qi('column')}, t.dtype, missing, rows - missing as non_missing, missing = rows as is_empty
from ({lg}) l join (values {', '.join(f"({lit(n)}, {lit(dtype[k])})" for n, k in CUST)}) t(c, dtype)
  on l.{qi('column')} = t.c""", ("a", an))
    o["missing_by_column"] = _cust(f"""
select position, {qi('column')}, missing,
  case when rows = 0 then 0.0 else {rnd('missing * 100.0 / rows', 2)} end as percent
from ({lg}) where missing > 0""", ("a", an))
    miss_list = "concat_ws(',', " + ", ".join(f"case when {qi(n)} is null then {lit(n)} end" for n, _ in CUST) + ")"
    miss_cnt = " + ".join(f"cast({qi(n)} is null as int)" for n, _ in CUST)
    o["missing_rows"] = _cust(f"""
select row_id, {miss_list} as missing_columns, cast({miss_cnt} as bigint) as missing_count
from a where {' or '.join(f'{qi(n)} is null' for n, _ in CUST)}""", ("a", an))
    o["unnamed_columns"] = _cust(f"""
select position, {qi('column')}, rows - missing as non_missing, missing,
  case when rows = 0 then 0.0 else {rnd('missing * 100.0 / rows', 2)} end as percent_missing,
  missing = rows as safe_to_drop
from ({lg}) where lower({qi('column')}) like 'unnamed%'""", ("a", an))
    lgn = _null_long("c1n", CUSTN)
    tot = " + ".join(f"cast({qi(n)} is null as int)" for n, _ in CUSTN)
    o["missing_remaining"] = _cust(f"""
select position, {qi('column')}, missing,
  case when rows = 0 then 0.0 else {rnd('missing * 100.0 / rows', 2)} end as percent,
  t.missing_total, t.rows_with_missing
from ({lgn}),
  (select cast(sum({tot}) as bigint) as missing_total,
          cast(count_if({' or '.join(f'{qi(n)} is null' for n, _ in CUSTN)}) as bigint) as rows_with_missing
   from c1n) t
where missing > 0""", ("c1n", CUST_C1N))
    # the columns without any value go, the numbers have no gaps left
    left = [(n, k) for n, k in CUSTN if n not in ("notes", "unnamed:_8")]
    filled = f"select row_id, {sel(left, lambda n, k: qi(n) if k == 't' else f'coalesce({qi(n)}, 0)')} from c1n"
    tot = " + ".join(f"cast({qi(n)} is null as int)" for n, _ in left)
    o["missing_remaining_after_fill"] = _cust(f"""
select position, {qi('column')}, missing,
  case when rows = 0 then 0.0 else {rnd('missing * 100.0 / rows', 2)} end as percent,
  t.missing_total, t.rows_with_missing
from ({_null_long("f", left)}),
  (select cast(sum({tot}) as bigint) as missing_total,
          cast(count_if({' or '.join(f'{qi(n)} is null' for n, _ in left)}) as bigint) as rows_with_missing
   from f) t
where missing > 0""", ("c1n", CUST_C1N), ("f", filled))
    o["cell_diff_versions"] = _cust("""
select coalesce(b.row_id, a.row_id) as row_id, 'nation_txt' as "column", b.nation_txt as old_value, a.nation_txt as new_value,
  case when a.row_id is null then 'removed' when b.row_id is null then 'added' else 'changed' end as change
from b full join a on a.row_id = b.row_id
where a.row_id is null or b.row_id is null or a.nation_txt is distinct from b.nation_txt
union all select row_id, 'origin', origin, null, 'removed' from b
union all select row_id, 'note', null, note, 'added' from a""",
        ("b", "select row_id, nation_txt, origin from customer_dirty where row_id % 5 <> 0"),
        ("a", "select row_id, upper(nation_txt) as nation_txt, 'n' as note from customer_dirty where row_id % 7 <> 0"))
    o["placeholder_cells"] = _cust(" union all ".join(
        f"select {i} as position, {lit(n)} as {qi('column')}, {cif(ph_score(qi(n), k == 't'))} as placeholder_cells "
        f"from customer_dirty" for i, (n, k) in enumerate(CUST)))
    o["numeric_candidates"] = _cust(_candidates_sql("customer_dirty", CUST))
    o["dq_components"] = _cust(score_sql("customer_dirty", CUST))
    o["data_quality_score"] = _cust(f"select score from ({score_sql('customer_dirty', CUST)})")
    cleaned = _clean_default_cust()
    o["dq_improvement"] = _cust(f"""
select b.score as quality_before, a.score as quality_after,
  {rnd('a.score - b.score', 2)} as improvement
from ({score_sql('customer_dirty', CUST)}) b, ({score_sql('s4', CUST_CLEANED)}) a""",
                                ("c1n", CUST_C1N), *cleaned[1:])
    o["cell_updates"] = _cust(
        f"select row_id, {sel(CUST, lambda n, k: _edits(qi(n), [e for e in CELL_EDITS if e['column'] == n], k) if any(e['column'] == n for e in CELL_EDITS) else qi(n))}"
        f" from c1", ("c1", CUST_C1))
    o["missing_cell_updates"] = _cust(
        f"select row_id, {sel(CUST, lambda n, k: _edits(qi(n), MISSING_EDITS, k) if n == 'acctbal' else qi(n))}"
        f" from c1", ("c1", CUST_C1))
    o["cell_search"] = _cust(" union all ".join(
        f"select row_id, {lit(n)} as {qi('column')}, coalesce(cast({qi(n)} as varchar), '') as value "
        f"from customer_dirty where contains(lower(coalesce(cast({qi(n)} as varchar), '')), {lit(SEARCH)})"
        for n, _ in CUST))
    o["cell_diff"] = _cust(" union all ".join(
        f"select row_id, {lit(n)} as {qi('column')}, {qi(n)} as old_value, {strip(c1(qi(n)))} as new_value, "
        f"'changed' as change from customer_dirty where {qi(n)} is distinct from {strip(c1(qi(n)))}"
        for n in CUST_TEXT))
    ups = CHANGED_CELLS_OPTS["cell_updates"]
    cc = _clean_default_cust(ups, fill="zero")
    parts = [f"select row_id, 'acctbal' as {qi('column')}, 'manual_cell_updates' as action, "
             f"cast(acctbal as varchar) as old_value, cast({float(ups[0]['value'])} as varchar) as new_value "
             f"from c1n where row_id = {ups[0]['row_index']}"]
    for n, k in CUSTN:
        if k == "t":
            parts.append(f"select row_id, {lit(n)}, 'trim_whitespace', {qi(n)}, {strip(qi(n))} from s1 "
                         f"where {qi(n)} is not null and {strip(qi(n))} <> {qi(n)}")
    for n in ("acctbal", "nation_txt", "unnamed:_7"):
        parts.append(f"select row_id, {lit(n)}, 'fill_numeric', null, '0' from s3 where {qi(n)} is null")
    parts.append(f"select row_id, 'mkt_segment', 'fill_categorical', null, {mode_of('s3', 'mkt_segment')} "
                 f"from s3 where mkt_segment is null")
    o["changed_cells"] = _cust(" union all ".join(parts), *cc)
    # C1, C7 and C15 as well; the fills are those of the clipped table, which has the same gaps
    more = list(parts)
    for n, k in CUST:
        if k == "t":
            more.append(f"select row_id, {lit(n)}, 'replace_placeholders', {qi(n)}, null "
                        f"from customer_dirty where {_ph_cs(qi(n), tokens.PH_CLEAN)}")
    for n in ("nation_txt", "unnamed:_7"):
        more.append(f"select row_id, {lit(n)}, 'convert_dtypes', {qi(n)}, null from s2 "
                    f"where {qi(n)} is not null and {parse_num(qi(n))} is null")
    bounds = []
    for i, n in enumerate(("acctbal", "nation_txt", "unnamed:_7")):
        x = qi(n)
        q1, q3 = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
        bounds.append((f"b{i}", f"select {q1} - 0.5 * ({q3} - {q1}) as lo, {q3} + 0.5 * ({q3} - {q1}) as hi from s3"))
        more.append(f"select row_id, {lit(n)}, 'outlier_clip', cast({x} as varchar), "
                    f"cast(least(greatest({x}, lo), hi) as varchar) from s3, b{i} where {x} < lo or {x} > hi")
    o["changed_cells_all"] = _cust(" union all ".join(more), *cc, *bounds)
    # the second edit wins, a blank one clears the cell
    o["cell_updates_table"] = _cust(f"""select row_id, {sel(CUST, lambda n, k: {
        'acctbal': "case when row_id % 14 = 0 then row_id + 0.5 when row_id % 7 = 0 then 17.0 else acctbal end",
        'Mkt Segment': "case when row_id % 21 = 0 then null when row_id % 7 = 0 then 'EDITED' else " + qi(n) + " end",
        }.get(n, qi(n)))} from c1""", ("c1", CUST_C1))
    o["operation_log"] = _cust(_oplog_sql(), *_clean_default_cust())
    o["cleaning_completeness"] = _cust(
        "select cast(0 as bigint) as failed_operations, cast(100.0 as double) as completeness "
        "from (select count(*) from customer_dirty)")
    o["clean_minimal"] = _cust(CUST_C1N)
    o["stream_profile"] = _cust(
        "select cast(count(*) as bigint) as rows, " + ", ".join(
            f"{cif(qi(n) + ' is null')} as {qi('missing__' + normalize_name(n))}" for n, _ in CUST)
        + " from a", ("a", f"select row_id, {sel(CUST, c1_cols(CUST, tokens.PH_ANALYZE))} from customer_dirty"))
    keep = [n for n, _ in CUSTN if n not in ("notes", "unnamed:_8")]

    def streamed(n):
        x = strip(qi(n)) if dict(CUSTN)[n] == "t" else qi(n)
        return parse_num(x) if n == "nation_txt" else x
    o["stream_clean"] = _cust(
        "select * from (select row_id, " + ", ".join(
            f"{streamed(n)} as {qi('segment' if n == 'mkt_segment' else n)}" for n in keep)
        + " from c1n) where " + " and ".join(
            f"{qi('segment' if n == 'mkt_segment' else n)} is not null" for n in keep), ("c1n", CUST_C1N))
    na = f"in ({inlist(tokens.READ_NA_TOKENS)})"
    o["read_csv_roundtrip"] = _cust(f"""
select row_id, "Name", case when "Mkt Segment" {na} then null else "Mkt Segment" end as "Mkt Segment",
  acctbal, case when nation_txt {na} then null else nation_txt end as nation_txt,
  cast(null as double) as notes, origin, cast("Unnamed: 7" as double) as "Unnamed: 7",
  cast(null as double) as "Unnamed: 8"
from customer_dirty""")
    o["clean_recipe"] = _cust(
        "select row_id, " + ", ".join(
            (f"{strip(qi(n))} as {qi('segment' if n == 'mkt_segment' else n)}" if k == "t"
             else f"{rnd('coalesce(acctbal, (select quantile_cont(acctbal, 0.5) from c1n))', 4)} as acctbal")
            for n, k in CUSTN if n != "unnamed:_7") + " from c1n", ("c1n", CUST_C1N))
    return o


def _decisions_sql() -> str:
    """One row for each column after C6: whether it converts (C7), is empty (C10) or constant (C11), and its gaps
    afterwards, all from the data."""
    parts = []
    for i, (n, k) in enumerate(CUSTN):
        x = qi(n)
        num = parse_num(x) if k == "t" else x
        parts.append(
            f"select {i} as position, {lit(n)} as c, {'true' if k == 't' else 'false'} as was_text, count(*) as n_rows, "
            f"count({x}) as present, count({num}) as numbers, coalesce(min({x}) = max({x}), false) as same_text, "
            f"coalesce(min({num}) = max({num}), false) as same_number from s2")
    return (
        "select *, converts or not was_text as numeric, present = 0 as empty, "
        "present > 0 and (case when converts or not was_text then same_number else same_text end) as constant, "
        "n_rows - (case when converts or not was_text then numbers else present end) as gaps from (select *, "
        f"was_text and numbers > 0 and numbers >= {tokens.AUTO_NUMERIC_RATIO} * present as converts from ("
        + " union all ".join(parts) + "))")


def _oplog_sql() -> str:
    text_raw = ",".join(CUST_TEXT)
    ph_cells = " + ".join(f"count_if({_ph_cs(qi(n), tokens.PH_CLEAN)})" for n in CUST_TEXT)
    renamed = [normalize_name(n) for n, _ in CUST if normalize_name(n) != n]
    text_n = [n for n, k in CUSTN if k == "t"]
    trim_cells = " + ".join(f"count_if({qi(n)} is not null and {strip(qi(n))} <> {qi(n)})" for n in text_n)
    dec = f"({_decisions_sql()})"
    names = "coalesce(string_agg(c, ',' order by position), '')"
    left = "not empty and not constant"
    rows = [
        f"select 'replace_placeholders' as action, cast({ph_cells} as bigint) as affected, "
        f"{lit(text_raw)} as {qi('columns')}, 1 as step, true as always from customer_dirty",
        f"select 'rename_columns', {len(renamed)}, {lit(','.join(renamed))}, 2, true",
        f"select 'trim_whitespace', cast({trim_cells} as bigint), {lit(','.join(text_n))}, 3, true from c1n",
        f"select 'convert_dtypes', count(*), {names}, 4, false from {dec} where converts",
        f"select 'drop_empty_columns', count(*), {names}, 5, false from {dec} where empty",
        f"select 'drop_constant_columns', count(*), {names}, 6, false from {dec} where constant",
        "select 'drop_duplicates', cast((select count(*) from s3) - (select count(*) from "
        "(select distinct name, mkt_segment, acctbal, nation_txt, \"unnamed:_7\" from s3)) as bigint), '', 7, true",
        f"select 'fill_numeric', coalesce(sum(gaps), 0), {names}, 8, true from {dec} where {left} and numeric and gaps > 0",
        f"select 'fill_categorical', coalesce(sum(gaps), 0), {names}, 9, true from {dec} where {left} and not numeric",
    ]
    return ("select cast(row_number() over (order by step) as int) as seq, action, cast(affected as bigint) as affected, "
            f"{qi('columns')}, true as success from (" + " union all ".join(rows) + ") where always or affected > 0")


def _candidates_sql(src: str, cols) -> str:
    from ..operators.quality import name_is_numeric_hint
    parts = []
    for n, k in cols:
        if k != "t":
            continue
        x = qi(n)
        ok = f"not {ph_score(x)}"
        s = strip(x)
        by_name = name_is_numeric_hint(n)
        cand = "true" if by_name else (
            f"(np >= {tokens.CANDIDATE_MIN_VALUES} and dg / np >= {tokens.CANDIDATE_DIGIT_RATIO}"
            f" and al / np <= {tokens.CANDIDATE_ALPHA_RATIO})")
        parts.append(f"""
select {lit(n)} as {qi('column')}, {str(by_name).lower()} as by_name, np as non_placeholder,
  case when np > 0 then {rnd('dg / np', 4)} end as digit_ratio,
  case when np > 0 then {rnd('al / np', 4)} end as alpha_ratio,
  {cand} as is_candidate, case when {cand} then iss else 0 end as numeric_issues
from (select {cif(ok)} as np, {cif(f"{ok} and regexp_matches({s}, '[0-9]')")} as dg,
             {cif(f"{ok} and regexp_matches({s}, '[A-Za-z]')")} as al,
             {cif(f"{ok} and regexp_matches({s}, '[0-9]') and {coerce_like(x)} is null")} as iss
      from {src})""")
    return " union all ".join(parts)


# ------------------------------------------------------------------ orders_dup
def _odup_oracles() -> dict:
    o = {}
    w = lambda body, *c: with_views(["orders_dup"], *c, body=body)
    g = ", ".join(ODUP)
    o["duplicate_count"] = w(f"""
select cast(count(*) as bigint) as rows, cast((select count(*) from (select distinct {g} from orders_dup)) as bigint)
  as distinct_rows, cast(count(*) - (select count(*) from (select distinct {g} from orders_dup)) as bigint)
  as duplicate_count from orders_dup""")
    o["dedupe_full"] = w(f"select min(row_id) as row_id, {g} from orders_dup group by {g}")
    o["dedupe_subset"] = w(
        "select d.* from orders_dup d join (select min(row_id) as r from orders_dup "
        "group by cust_bucket, o_orderstatus) m on d.row_id = m.r")
    cond = " and ".join(f"d.{c} is not distinct from f.{c}" for c in ODUP)
    o["removed_rows"] = w(f"""
select d.row_id, 'drop_duplicates' as action, 'duplicate of ' || cast(f.first as varchar) as detail
from orders_dup d join (select {g}, min(row_id) as first from orders_dup group by {g}) f on {cond}
where d.row_id <> f.first""")
    o["drop_missing_rows"] = w(
        f"select * from orders_dup where {' and '.join(f'{c} is not null' for c in ODUP)}")
    o["fill_categorical_drop"] = w(
        "select * from orders_dup where o_orderstatus is not null and o_orderpriority is not null")
    return o


# ------------------------------------------------------------------ orders_text
def _otext_oracles() -> dict:
    o = {}
    w = lambda body, *c: with_views(["orders_text"], *c, body=body)
    ts = parse_ts("order_date_txt")
    conv = {
        "convert_numeric": (ts, parse_num("total_txt"), "flag_txt"),
        "convert_datetime": (ts, "total_txt", "flag_txt"),
        "convert_string": (ts, "total_txt", "flag_txt"),
        "convert_category": (ts, "total_txt", "flag_txt"),
        "convert_bool": (ts, "total_txt", to_bool("flag_txt")),
        "convert_auto": (ts, "total_txt", "flag_txt"),
    }
    for k, (a, b, c) in conv.items():
        o[k] = w(f"select row_id, {a} as order_date_txt, {b} as total_txt, {c} as flag_txt from orders_text")
    o["convert_report"] = w(f"""
select 'total_txt' as {qi('column')}, 'string' as from_type, 'numeric' as requested, 'numeric' as to_type,
  cast(count(total_txt) - count({parse_num('total_txt')}) as bigint) as coerced, true as success from orders_text
union all
select 'flag_txt', 'string', 'bool', 'bool', cast(count(flag_txt) - count({to_bool('flag_txt')}) as bigint), true
from orders_text
union all
select 'order_date_txt', 'string', 'datetime', 'datetime',
  cast(count(order_date_txt) - count({ts}) as bigint), true from orders_text""")
    o["coerce_numeric_like"] = w(f"select row_id, total_txt, {coerce_like('total_txt')} as coerced from orders_text")
    o["numeric_issues"] = w(_candidates_sql("orders_text", [("order_date_txt", "t"), ("total_txt", "t"),
                                                            ("flag_txt", "t")]))
    return o


# ------------------------------------------------------------------ events_gaps
def _bounds_cte(src: str, cols):
    parts = [f"cast(count({qi(c)}) as bigint) as n_{c}, quantile_cont({qi(c)}, 0.25) as q1_{c}, "
             f"quantile_cont({qi(c)}, 0.75) as q3_{c}" for c in cols]
    return f"select {', '.join(parts)} from {src}"


def _flag(c: str) -> str:
    return (f"coalesce({qi(c)} < b.q1_{c} - 1.5 * (b.q3_{c} - b.q1_{c}) or "
            f"{qi(c)} > b.q3_{c} + 1.5 * (b.q3_{c} - b.q1_{c}), false)")


def _evg_oracles() -> dict:
    o = {}
    w = lambda body, *c: with_views(["events_gaps"], *c, body=body)
    evc1 = f"select row_id, {sel(EVG, c1_cols(EVG))} from events_gaps"
    nums = ["user_id", "value"]
    b = ("b", _bounds_cte("e", nums))
    o["iqr_bounds"] = w(" union all ".join(f"""
select {i} as position, {lit(c)} as {qi('column')}, b.n_{c} as n_values, {rnd(f'b.q1_{c}', 4)} as q1,
  {rnd(f'b.q3_{c}', 4)} as q3, {rnd(f'b.q1_{c} - 1.5 * (b.q3_{c} - b.q1_{c})', 4)} as lower,
  {rnd(f'b.q3_{c} + 1.5 * (b.q3_{c} - b.q1_{c})', 4)} as upper,
  (select {cif(_flag(c))} from e, b) as n_outliers
from b""" for i, c in enumerate(nums)), ("e", "select * from events_gaps"), b)
    evo = f"select row_id, {sel(EVG, c1_cols(EVG, tokens.PH_OUTLIER))} from events_gaps"
    o["detect_outliers"] = w(f"""
select row_id, case when {_flag('user_id')} then 'user_id' else 'value' end as {qi('column')},
  case when {_flag('user_id')} then cast(user_id as double) else value end as value
from e, b where {_flag('user_id')} or {_flag('value')}""", ("e", evo), b)
    flagged = f"""
select row_id, case when {_flag('user_id')} then 'user_id' else 'value' end as {qi('column')},
  case when {_flag('user_id')} then cast(user_id as double) else value end as value
from e, b where {_flag('user_id')} or {_flag('value')}"""
    o["detect_outliers_after_fill"] = w(flagged, ("e", "select * replace (coalesce(value, 0) as value) from events_gaps"), b)
    o["outlier_totals"] = w(f"""
select 'user_id,value' as columns_checked,
  cast(count_if({_flag('user_id')} or {_flag('value')}) as bigint) as total_rows,
  cast(count_if({_flag('user_id')}) + count_if({_flag('value')}) as bigint) as total_cells from e, b""", ("e", evo), b)
    o["outlier_review"] = w(f"""
select row_id, {qi('column')}, value from (
  select row_id, case when {_flag('user_id')} then 'user_id' else 'value' end as {qi('column')},
    case when {_flag('user_id')} then cast(user_id as double) else value end as value,
    case when {_flag('user_id')} then 0 else 1 end as pos
  from e, b where {_flag('user_id')} or {_flag('value')})
order by pos, row_id limit 100""", ("e", evo), b)
    o["remove_rows"] = w(f"select * from e where row_id not in ({', '.join(str(i) for i in REMOVE_IDS)})",
                         ("e", evc1))
    o["outlier_remove"] = w(f"select e.* from e, b where not ({_flag('user_id')} or {_flag('value')})",
                            ("e", evc1), b)

    def clip(c):
        lo = f"b.q1_{c} - 1.5 * (b.q3_{c} - b.q1_{c})"
        hi = f"b.q3_{c} + 1.5 * (b.q3_{c} - b.q1_{c})"
        return f"case when {c} is null then null else {rnd(f'greatest(least({c}, {hi}), {lo})', 4)} end"
    # a column without outliers keeps its type and values
    o["outlier_clip"] = w(f"select row_id, user_id, event_type, {clip('value')} as value, ts "
                          f"from e, b", ("e", evc1), b)
    o["fill_categorical_mode"] = w(
        f"select row_id, user_id, coalesce(event_type, {mode_of('e', 'event_type')}) as event_type, value, ts "
        f"from e", ("e", evc1))
    o["fill_categorical_constant"] = w(
        "select row_id, user_id, coalesce(event_type, 'no_type') as event_type, value, ts from e", ("e", evc1))
    o["preview"] = w(
        f"select row_id, user_id, {c1('event_type', tokens.PH_ANALYZE)} as event_type, value, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from events_gaps order by row_id limit 1000")
    return o


# ------------------------------------------------------------------ documents
def _doc_oracles() -> dict:
    o = {}
    w = lambda body, *c: with_views(["documents_labeled"], *c, body=body)
    g = ", ".join(n for n, _ in DOCL)
    d = ("d", f"select min(row_id) as row_id, {g} from documents_labeled group by {g}")
    o["clean_default"] = w(
        "select row_id, lang, source, n_chars, "
        + rnd("coalesce(cast(quality as double), (select avg(quality) from d))", 4) + " as quality, "
        + rnd("coalesce(cast(toxic as double), (select avg(toxic) from d))", 4) + " as toxic from d", d)
    o["clean_summary"] = w(f"""
select cast((select count(*) from documents_labeled) as bigint) as rows_before,
  cast((select count(*) from d) as bigint) as rows_after, cast(5 as bigint) as cols_before,
  cast(5 as bigint) as cols_after,
  cast((select count(*) from documents_labeled) - (select count(*) from d) as bigint) as duplicates_removed,
  cast(0 as bigint) as outliers_removed,
  cast((select count_if(quality is null) + count_if(toxic is null) from d) as bigint) as filled_cells,
  cast(0 as bigint) as columns_renamed, cast(0 as bigint) as empty_columns_removed,
  {lit(','.join(n for n, _ in DOCL))} as cleaned_columns""", d)
    nums = ["n_chars", "quality", "toxic"]
    b = ("b", _bounds_cte("documents_labeled", nums))
    first = "case " + " ".join(f"when {_flag(c)} then {lit(c)}" for c in nums) + " end"
    val = "case " + " ".join(f"when {_flag(c)} then cast({qi(c)} as double)" for c in nums) + " end"
    o["detect_outliers_after_clean"] = w(f"""
select row_id, {first} as {qi('column')}, {val} as value from documents_labeled, b
where {' or '.join(_flag(c) for c in nums)}""", b)
    o["dedupe_text"] = with_views(["documents_text"], body="""
select t.* from documents_text t join (select min(row_id) as r from documents_text group by text) m
  on t.row_id = m.r""")
    return o


LINEITEM = [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"),
            ("l_quantity", "n"), ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"),
            ("l_returnflag", "t"), ("l_linestatus", "t"), ("l_shipdate", "o")]


def _lineitem_oracles() -> dict:
    return {"lineitem_quality": score_sql("lineitem", LINEITEM).strip()}


def _new_oracles() -> dict:
    def w(view: str, body: str) -> str:
        return f"with {view} as ({view_sql(view, 'duckdb')})\n{body}"

    ids = "cast(9007199254740993 + row_id as bigint)"
    day = "cast(o_orderdate as date)"
    gone = ("select row_id, min(row_id) over (partition by cust_bucket, o_orderstatus, o_orderpriority) as f "
            "from orders_dup")
    return {
        "completeness_with_failure": "select cast(1 as bigint) as failed_operations, cast(80.0 as double) as completeness",
        "auto_bigint": w("orders_ids", f"select row_id, {ids} as big_txt, o_orderstatus from orders_ids"),
        "clean_bigint_ids": w("orders_ids", f"select row_id, {ids} as big_txt, o_orderstatus from orders_ids"),
        "cell_update_bigint": w("orders_bigint", "select row_id, case row_id when 1 then 1234567890123456789 "
                                "when 2 then null else big_id end as big_id, o_orderstatus from orders_bigint"),
        "convert_datetime_mixed": f"""
select o_orderkey as row_id, cast(case o_orderkey % 5 when 1 then {day} + interval '10 hours 11 minutes 12.5 seconds'
    when 3 then {day} + interval '21 hours 30 minutes' when 4 then {day} + interval '15 hours 4 minutes'
    else cast({day} as timestamp) end as timestamp) as when_txt from orders""",
        "read_quoted_newlines": w("customer_notes", "select * from customer_notes"),
        "read_header_order": w("customer_notes", """select *, case when row_id % 2 = 0 then 'e' end as even,
  case when row_id % 2 = 1 then 'o' end as odd from customer_notes"""),
        "read_mixed_charset": w("customer_notes", "select * from customer_notes"),
        "read_json_array": w("customer_notes", "select * from customer_notes"),
        "read_tsv": w("orders_dup", "select * from orders_dup"),
        "read_rejects": w("orders_dup", "select concat(row_id, ',', o_orderstatus, ',surplus') as line "
                          "from orders_dup where row_id % 10 = 0"),
        "read_header_repair": w("orders_dup", """select row_id, cust_bucket as a, o_orderstatus as "a.1",
  'x' as "Unnamed: 3" from orders_dup"""),
        "write_report": w("orders_dup", f"select row_id, 'drop_duplicates' as action, concat('duplicate of ', f) as detail "
                          f"from ({gone}) where row_id <> f"),
        "json_safe": w("events_odd", "select row_id, case when isfinite(value) then value end as value from events_odd"),
        "missing_rows_data": w("orders_dup", """select row_id, 'o_orderpriority' as missing_columns,
  cast(1 as bigint) as missing_count, cast(cust_bucket as varchar) as cust_bucket, '' as o_orderpriority
from orders_dup where o_orderpriority is null"""),
    }


def oracles() -> dict[str, str]:
    out = {}
    for f in (_new_oracles, _cust_oracles, _odup_oracles, _otext_oracles, _evg_oracles, _doc_oracles, _lineitem_oracles):
        out.update(f())
    return out
