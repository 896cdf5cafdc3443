import datetime

import pytest

from tradewind.filters import FilterError, FilterSpec


def test_there_are_85_filters_in_nine_groups():
    assert len(FilterSpec.kinds()) == 85
    groups = FilterSpec.groups()
    assert len(groups) == 9
    assert sum(map(len, groups.values())) == 85


def test_unknown_names_and_empty_values_are_absent():
    spec, errors = FilterSpec.parse({"nope": 1, "id_min": "", "payment": None, "module": "  "})
    assert spec == FilterSpec() and errors == []


@pytest.mark.parametrize(
    "raw, value",
    [("12", 12), (7, 7), ("12.9", 12), ("1e3", 1000), (0, 0), ("-0.5", 0)],
)
def test_integers_are_truncated(raw, value):
    assert FilterSpec.from_dict({"id_min": raw}).id_min == value


@pytest.mark.parametrize("raw", ["-1", "x", "12 ", [1], True, float("nan")])
def test_bad_integers_are_errors(raw):
    spec, errors = FilterSpec.parse({"id_min": raw, "id_max": 5})
    assert len(errors) == 1 and errors[0].startswith("id_min")
    assert spec == FilterSpec(id_max=5)


def test_lists_drop_bad_items():
    spec = FilterSpec.from_dict(
        {"current_state": "1, x,3", "has_product": ["4", -1, "", 6.7], "dept_code": " 75 ,, 974"}
    )
    assert spec.current_state == [1, 3]
    assert spec.has_product == [4, 6]
    assert spec.dept_code == ["75", "974"]
    assert FilterSpec.from_dict({"current_state": "x,y"}).current_state is None


def test_floats_may_be_negative_and_booleans_follow_truth():
    spec = FilterSpec.from_dict({"ltv_min": "-2.5", "has_coupon": "0", "has_slip": 1})
    assert (spec.ltv_min, spec.has_coupon, spec.has_slip) == (-2.5, False, True)


def test_dates():
    spec = FilterSpec.from_dict(
        {"date_add_from": "2024-02-29", "date_add_to": datetime.date(2024, 3, 1)}
    )
    assert (spec.date_add_from, spec.date_add_to) == ("2024-02-29", "2024-03-01")
    for bad in ("2023-02-29", "01/02/2024", "2024-1-1"):
        with pytest.raises(FilterError):
            FilterSpec.from_dict({"date_add_from": bad})


def test_errors_accumulate():
    with pytest.raises(FilterError) as e:
        FilterSpec.from_dict({"address_type": "home", "id_min": "x", "ltv_min": "y"})
    assert len(e.value.errors) == 3
    with pytest.raises(FilterError):
        FilterSpec(address_type="home")


def test_json_round_trip():
    spec = FilterSpec(payment="Chèque", current_state=[2, 5], has_coupon=False, ltv_min=1.5)
    assert "Chèque" in spec.to_json()
    assert FilterSpec.from_json(spec.to_json()) == spec
    with pytest.raises(FilterError):
        FilterSpec.from_json("[1]")


def test_given_ignores_zero_like_values():
    spec = FilterSpec(total_paid_tax_incl_min=0.0, postcode="0", current_state=[], has_coupon=False)
    assert not spec.any_given(
        "total_paid_tax_incl_min", "postcode", "current_state", "has_coupon", "id_min"
    )
