"""Options and recipe merging (A6): later steps override, edits accumulate,
one-sided fill choices imply the other side's skip, drop implies empty-column drop."""

import pytest

from mopup.plans.options import CleanOptions, merge_recipe


def test_defaults_are_library_defaults():
    o = CleanOptions()
    assert (o.remove_duplicates, o.missing_strategy, o.fill_numeric, o.fill_categorical) == (True, "fill", "mean", "mode")
    assert o.encode_categoricals is False and o.handle_outliers is None


def test_unknown_option_rejected():
    with pytest.raises(ValueError):
        CleanOptions.from_dict({"remove_dupes": True})


def test_scoped_start_and_fill_implications():
    r = merge_recipe([{"fill_numeric": "median"}])
    assert (r.missing_strategy, r.fill_numeric, r.fill_categorical) == ("fill", "median", "skip")
    r = merge_recipe([{"fill_categorical": "constant"}])
    assert (r.fill_numeric, r.fill_categorical) == ("skip", "constant")
    # a text choice made earlier is not overridden by a later numeric-only step
    r = merge_recipe([{"fill_categorical": "mode"}, {"fill_numeric": "zero"}])
    assert (r.fill_numeric, r.fill_categorical) == ("zero", "mode")
    assert merge_recipe([]).missing_strategy == "ignore"


def test_drop_strategy_leaves_columns_alone():
    r = merge_recipe([{"missing_strategy": "drop"}])
    assert r.missing_strategy == "drop" and not r.drop_empty_columns


def test_edits_accumulate_and_names_normalise():
    r = merge_recipe([
        {"cell_updates": [{"row_index": 1, "column": "Mkt Segment", "value": "x"}]},
        {"cell_updates": [{"row_index": 2, "column": "acctbal", "value": "1"}]},
        {"drop_selected_columns": ["Unnamed: 7"]},
        {"drop_selected_columns": ["Unnamed: 7", "notes"]},
        {"column_renames": {"Mkt Segment": "Segment"}, "dtype_map": {"Total": "numeric", "x": "auto"}},
    ])
    assert [u["column"] for u in r.cell_updates] == ["mkt_segment", "acctbal"]
    assert list(r.drop_selected_columns) == ["unnamed:_7", "notes"]
    assert r.column_renames == {"mkt_segment": "segment"}
    assert r.dtype_map == {"total": "numeric"}


def test_later_step_overrides_flag():
    r = merge_recipe([{"trim_whitespace": True}, {"trim_whitespace": False}])
    assert r.trim_whitespace is False
