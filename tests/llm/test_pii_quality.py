"""Values beside other characters, phones in several notations, and texts without common lines."""

import pytest

from tessera.llm import pii, quality


@pytest.mark.parametrize(
    ("text", "kinds", "kept"),
    [
        ("card 4539 1488 0343 6467 12/27", ["card"], ("card ", " 12/27")),
        ("pay 3 4539148803436467", ["card"], ("pay 3 ", "")),
        ("12 4539-1488-0343-6467 2024-01-01", ["card", "date_ymd"], ("12 ", "")),
        ("+1 4539 1488 0343 6467", ["card"], ("+1 ", "")),
        ("BE68 5390 0754 7034 EUR", ["iban"], ("BE", " EUR")),
        ("AB12 BE68 5390 0754 7034 4539 1488 0343 6467 now", ["iban", "card"], ("AB12 BE", " now")),
        ("call +44 20 7946 0958.", ["phone"], ("call +44 ", ".")),
        ("+353 1 234 5678", ["phone"], ("+353 ", "")),
        ("+15551234567", ["phone"], ("+1", "")),
        ("5551234567 or 15551234567", ["phone", "phone"], ("", "")),
        ("1700000000 5551234567.25 12345678901234567890123", [], ("", "")),
    ],
)
def test_values_beside_other_characters_are_replaced(text, kinds, kept):
    got, found = pii.Pseudonyms(b"key").replace(text)
    values = pii.Pseudonyms(b"key").found(text)
    assert found == kinds and got.startswith(kept[0]) and got.endswith(kept[1]) and len(got) == len(text)
    assert [v[2] for v in pii.Pseudonyms(b"key").found(got)] == kinds
    assert all(new != text[start:end] and new in got for start, end, _, new in values)
    assert all(digits not in got for digits in ("4539 1488", "45391488", "0343 6467", "5390 0754", "7946 0958", "234 5678")) and (not kinds or "5551234567" not in got)


def test_one_phone_in_any_notation_has_one_pseudonym():
    own = pii.Pseudonyms(b"key")
    forms = ["+1 (212) 555-0123", "212-555-0123", "2125550123", "+12125550123", "+1 212 555 0123 12 items"]
    assert len({"".join(c for c in own.found(t)[0][3] if c.isdigit())[-10:] for t in forms}) == 1


def test_quality_rules_return_the_text_without_common_lines(spark):
    texts = [(i, f"own {'y' * (i + 1)}\n\nShared Line {i % 10}\nend {'x' * i}\n", "h") for i in range(9)] + [(50, "Shared line 1\nshared LINE 2", "h"), (51, "shared line 3\nz", "other"), (52, None, "h"), (None, "", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, most_documents=5).collect()}
    assert {i: got[i]["remaining"] for i in range(9)} == {i: f"own {'y' * (i + 1)}\n\nend {'x' * i}\n" for i in range(9)}
    assert got[50]["remaining"] == got[52]["remaining"] == got[None]["remaining"] == "" and got[51]["remaining"] == texts[10][1]
    assert all(r["n_words"] - len(r["remaining"].split()) == r["n_removed_words"] for r in got.values())
