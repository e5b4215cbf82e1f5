import pytest

from .test_decontam import found

GSM = "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"
APPLES = "John has 3 apples. Mary has 5 apples. Tom has 7 more apples than Mary. How many apples do they have?"
DENSE = ["What is 17 * 23?", "Solve 3 x 4 + 5 x 6 - 7 = 8 and 9 x 10 = 11", "Paris London Rome Berlin Madrid Vienna Prague Oslo: which is the largest?", "Define osmosis", "Riddle"]


@pytest.mark.parametrize("case", [str, str.lower, str.upper])
def test_dense_items_are_found(spark, case):
    docs = [(i, f"some words before it, {case(t)} and some after") for i, t in enumerate(DENSE)] + [(9, "Solve 1 x 2 + 3 x 4 - 5 = 6 and 7 x 8 = 9, what is 18 * 23? Define it")]
    got = found(spark, docs, DENSE)
    assert set(got) == {(i, i) for i in range(len(DENSE))} and not any(r["changed"] for r in got.values())
    assert got[1, 1]["n_windows"] == got[1, 1]["n_matched"] == 7


def test_names_in_any_case_and_place(spark):
    other = APPLES.replace("John", "Aisha").replace("Mary", "Peter").replace("Tom", "Olga")
    several = GSM.lower().replace("48", "92")
    docs = [(1, GSM.lower()), (2, GSM.upper()), (3, f"Now this. {other}"), (4, APPLES), (5, several), (6, "John has 3 pears. Mary had none, and Tom knows how many apples they have?")]
    got = found(spark, docs, [GSM, APPLES])
    assert set(got) == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)}
    assert [got[k]["changed"] for k in sorted(got)] == [False, False, True, False, True]


def test_different_values_may_become_equal(spark):
    item = "There are 4 cats and 6 dogs in the small house near the river and all of them sleep"
    assert set(found(spark, [(1, item.replace("4", "5").replace("6", "5"))], [item])) == {(1, 0)}
