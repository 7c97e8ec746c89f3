"""Every format changes, equal values stay linked, different ones different, and only the key undoes it."""

import re

import pytest

from mopup.llm import pii

SCHEMA = "doc_id long, text string, pii_of string"
VALUES = ["25/12/2020", "3/4/1985", "1.2.2020", "1885-03-04", "2020-1-5", "12/25/1999", "31.12.1999", "+49 30 1234567",
          "+33 6 12 34 56 78", "+442071838750", "5551234567", "(555) 123-4567", "+1 555-123-4567", "3782 822463 10005",
          "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "2001:db8:85a3::8a2e:370:7334",
          "2001:db8::1", "fe80:0:0:0:1:2:3:4", "192.168.1.77", "jane.doe@example.com", "müller@example.com", "jörg.b@x.de",
          "иван@почта.рф"]
PLAIN = ["30.02.2021", "2021-13-01", "12:34:56", "std::vector", "a::b", "x::y::z", "4111 1111 1111 1112", "DE00 3704 0044 0532 0130 00",
         "1700000000", "version 1.2.3", "no personal data"]


def changed(spark, texts, key="secret", **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    return [r["text"] for r in pii.pseudonymize(df, key=key, **more).orderBy("doc_id").collect()]


def test_every_format_changes_and_comes_back(spark):
    new = changed(spark, VALUES)
    for old, fresh in zip(VALUES, new):
        assert old != fresh and len(set(re.findall("[^\\W_]+", old.split("@")[0])) & set(re.findall("[^\\W_]+", fresh.split("@")[0]))) <= 1, (old, fresh)
    assert len(set(new)) == len(VALUES)
    back = changed(spark, new, undo=True)
    for old, again in zip(VALUES, back):
        if old.isascii() and "::" not in old:
            assert again == old
    assert back[VALUES.index("2001:db8::1")] == "2001:db8:0:0:0:0:0:1"
    assert changed(spark, new, key="other", undo=True) != back
    assert changed(spark, PLAIN) == PLAIN


def test_formats_hold(spark):
    new = dict(zip(VALUES, changed(spark, [f"see {v}, please" for v in VALUES])))
    new = {k: v[4:-8] for k, v in new.items()}
    d, m, y = map(int, new["25/12/2020"].split("/"))
    assert 12 < d <= 31 and 1 <= m <= 12 and 2000 <= y < 2100
    assert re.fullmatch(r"18\d\d-\d\d-\d\d", new["1885-03-04"]) and re.fullmatch(r"\d{1,2}\.\d{1,2}\.20\d\d", new["1.2.2020"])
    assert re.fullmatch(r"\+49 \d\d \d{7}", new["+49 30 1234567"]) and re.fullmatch(r"\+33 \d( \d\d){4}", new["+33 6 12 34 56 78"])
    digits = [int(c) for c in re.sub(r"\D", "", new["3782 822463 10005"])][::-1]
    assert re.fullmatch(r"3\d{3} \d{6} \d{5}", new["3782 822463 10005"])
    assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0
    iban = new["DE89 3704 0044 0532 0130 00"]
    plain = iban.replace(" ", "")
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", iban) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}", new["2001:db8::1"])
    assert new["müller@example.com"].endswith("@example.com") and new["müller@example.com"].isascii()


def test_equal_values_stay_linked_and_different_ones_different(spark):
    days = [f"{d:02d}/{m:02d}/19{y:02d}" for y in range(0, 100, 7) for m in range(1, 13) for d in range(13, 29)]
    out = changed(spark, [" ".join(days), "on " + days[5]])
    fresh = out[0].split(" ")
    assert len(set(fresh)) == len(days) and out[1] == "on " + fresh[5]
    phones = changed(spark, ["+1 555-123-4567 or (555) 123-4567 or 5551234567"])[0]
    assert len({re.sub(r"\D", "", p)[-10:] for p in phones.split(" or ")}) == 1


def test_key_is_required(spark):
    df = spark.createDataFrame([(1, "a@b.de", "x")], SCHEMA)
    with pytest.raises(TypeError):
        pii.pseudonymize(df)
    with pytest.raises(ValueError):
        pii.pseudonymize(df, key="")
    with pytest.raises(ValueError):
        pii.pseudonymize(df, key="k", counts="pii_of")
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) >= 32
